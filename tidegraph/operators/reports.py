"""Reports over results: statistics, differences, gaps, answered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timing_stats(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, n, mean, median, p95 (nearest rank, from 20 values on), low, high, slowest (its name)."""
    order = Window.partitionBy(key).orderBy(value, name)
    ranked = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    near = F.max(F.when((F.col("_n") >= 20) & (F.col("_rank") == F.ceil(F.col("_n") * 95 / 100)), F.col(value)))
    return ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.percentile(value, 0.5), 6).alias("median"),
        near.alias("p95"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.max(F.when(F.col("_rank") == F.col("_n"), F.col(name))).alias("slowest"),
    )


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, lost, gained: of two multisets (key, value), how many values went and came for each key."""
    gone = before.exceptAll(after).groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
    came = after.exceptAll(before).groupBy("key").agg(F.count(F.lit(1)).alias("gained"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return gone.join(came, "key", "full").select("key", zero("lost"), zero("gained"))


def gaps(issues: DataFrame) -> DataFrame:
    """code, occurrences, n_units of facts that weren't admitted."""
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("unit").alias("n_units"))


def deduplicated(requests: DataFrame) -> DataFrame:
    """batch, raw, distinct_queries: point queries of several consumers, each to be answered once."""
    return requests.groupBy("batch").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("unit", "pos", "cell").alias("distinct_queries"))


def answered(requests: DataFrame, facts: DataFrame, asked: Column) -> DataFrame:
    """Each distinct request (consumer, unit, pos, cell) with its value count and status; asked says which batches were run."""
    held = facts.groupBy("unit", "pos", "cell").agg(F.count(F.lit(1)).alias("n"))
    met = requests.distinct().join(held, ["unit", "pos", "cell"], "left")
    return met.withColumn("status", F.when(~asked, "NOT_STARTED").when(F.col("n").isNull(), "UNREACHABLE").otherwise("COMPLETE")).withColumn("n", F.when(asked, F.col("n")))
