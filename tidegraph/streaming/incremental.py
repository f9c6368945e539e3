"""Incremental analysis: as events arrive, only the units they belong to are solved again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.operators import dataflow
from tidegraph.sources.programs import blocks


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Event files as they come into a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def keep_current(stream: DataFrame, log: str, facts: str, checkpoint: str, analysis: Callable[[DataFrame], DataFrame] = dataflow.reach) -> StreamingQuery:
    """Appends each batch to log and writes changed units' facts under facts, one folder a batch.

    A unit's facts are those of the last batch that has the unit (`current`).
    A batch that runs again rewrites its own folders, so a retry changes nothing.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/events.parquet/batch={number}")
        changed = batch.select("user_id").distinct()
        known = spark.read.parquet(f"{log}/events.parquet").where(F.col("batch") <= number)
        whole = known.join(changed, "user_id", "left_semi").drop("batch")
        analysis(blocks(spark, whole)).write.mode("overwrite").parquet(f"{facts}/batch={number}")

    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, facts: str) -> DataFrame:
    """The facts of each unit as of the last batch that had it."""
    every = spark.read.parquet(facts)
    last = every.groupBy("unit").agg(F.max("batch").alias("batch"))
    return every.join(last, ["unit", "batch"]).drop("batch")
