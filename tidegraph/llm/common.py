"""What the training-data operators share: tables, checkpoints and word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; where none is set, one in the warehouse, which they share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder that all executors share, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parallel(df: DataFrame, per_core: int = 1) -> DataFrame:
    """df dealt over every core where its input has fewer splits than that.

    A scan of few files gives few partitions, which would leave cores idle in
    CPU-bound stages. Wide inputs are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over every core where fewer of its partitions have rows, as those of a file of few row groups.

    Counting them reads no column of a table. Others are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    full = df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    return df if full >= cores else df.repartition(cores)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame, *beside: Column) -> DataFrame:
    """row, all columns of df in a struct, and what stands beside it: names of working columns can't clash with df's."""
    return df.select(F.struct(*(quoted(c) for c in df.columns)).alias("row"), *beside)


def from_row(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of a struct `row`, some of them changed."""
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with sums over all rows before each one, in order.

    Ranges of rows are summed up first, so that no task sees more than a range
    or the sums of all ranges. Ties must be broken by order.
    """
    # written once: where ranges are cut may differ from run to run
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items())).select("_part", *(F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(before), "_part")  # a row a range
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *(f"_{n}" for n in sums))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
