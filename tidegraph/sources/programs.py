"""Programs as DataFrames, read from the events table by a fixed encoding.

A unit is a user's events in order of time; each event is a block with one
instruction and one terminator. With k, the number in its props, a block writes
cell k mod 4: a literal (its kind in capitals), a copy of cell (k + 1) mod 4, or
something unknown, for k mod 3 of 0, 1 and 2. Its kind names the terminator:
see `terminators`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LITERAL, COPY, HAVOC = 0, 1, 2
#: Places that are no block: a normal return, a halt.
RETURN_AT, HALT_AT = -1, -2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, events: str | DataFrame) -> DataFrame:
    """unit, pos, event_id, event_type, k, cell, action, source, literal, of events or of a folder's events table."""
    events = table(spark, events, "events") if isinstance(events, str) else events
    events = events.select("event_id", "ts", F.col("user_id").alias("unit"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    pos = (F.row_number().over(Window.partitionBy("unit").orderBy("ts", "event_id")) - 1).cast("long")
    return events.select(
        "unit",
        pos.alias("pos"),
        "event_id",
        "event_type",
        "k",
        (F.col("k") % 4).alias("cell"),
        (F.col("k") % 3).alias("action"),
        ((F.col("k") + 1) % 4).alias("source"),
        F.upper("event_type").alias("literal"),
    )


def terminators(blocks: DataFrame) -> DataFrame:
    """unit, pos, kind, target (before targets past the end become returns): a row for each labelled successor."""
    k, pos, kind = F.col("k"), F.col("pos"), F.col("event_type")
    rare = k % 10 == 0
    back = (kind == "signup") & rare & (pos > k % 5)
    first = F.when(kind == "click", "BRANCH_TRUE").when((kind == "error") & rare, "HALT").when(kind == "error", "INVOKE_NORMAL").otherwise("JUMP")
    ways = F.array(
        F.struct(first.alias("kind"), F.when(back, pos - k % 5).otherwise(pos + 1).alias("target")),
        F.when(kind == "click", F.struct(F.lit("BRANCH_FALSE").alias("kind"), (pos + 2 + k % 3).alias("target"))),
    )
    return blocks.select("unit", "pos", F.inline(F.filter(ways, lambda w: w.isNotNull())))


def units(blocks: DataFrame) -> DataFrame:
    """unit, last (its last block's place), n."""
    return blocks.groupBy("unit").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
