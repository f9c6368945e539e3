"""Program-graph dataflow and lineage analytics expressed as Spark DataFrame jobs."""
