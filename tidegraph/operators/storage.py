"""Byte ranges: segments, overlaps, coalescing; aliases; components of copied cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.shared import checkpointed


def writes(blocks: DataFrame) -> DataFrame:
    """unit, base, pos, start, end: the half-open range that a block writes in its base."""
    return blocks.select("unit", F.col("cell").alias("base"), "pos", (F.col("k") % 16).alias("start"), (F.col("k") % 16 + F.length("event_type")).cast("long").alias("end"))


def segments(ranges: DataFrame) -> DataFrame:
    """unit, base, start, end: the elementary segments between neighbouring boundaries."""
    bounds = ranges.select("unit", "base", F.explode(F.array("start", "end")).alias("at")).distinct()
    after = F.lead("at").over(Window.partitionBy("unit", "base").orderBy("at"))
    return bounds.select("unit", "base", F.col("at").alias("start"), after.alias("end")).where("end is not null")


def covered_segments(ranges: DataFrame) -> DataFrame:
    """unit, base, start, end, n: segments with how many ranges cover them: joined on the base, then by overlap."""
    s, r = segments(ranges).alias("s"), ranges.alias("r")
    met = s.join(r, (F.col("s.unit") == F.col("r.unit")) & (F.col("s.base") == F.col("r.base")) & (F.col("s.start") < F.col("r.end")) & (F.col("r.start") < F.col("s.end")))
    return met.groupBy("s.unit", "s.base", "s.start", "s.end").agg(F.count(F.lit(1)).alias("n"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """unit, base, start, end, n, other_start, other_end, other_n: ranges of a base that overlap, with their numbers of writes.

    Distinct ranges meet, not writes, so a base written often costs no pairs of writes; a range that two writes share overlaps itself.
    """
    keys = ["unit", "base", "start", "end"]
    a = ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).alias("a")
    b = ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).alias("b")
    same = (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
    ordered = F.struct("a.start", "a.end") < F.struct("b.start", "b.end")
    met = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.base") == F.col("b.base")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    other = [F.col(f"b.{c}").alias(f"other_{c}") for c in ("start", "end", "n")]
    return a.join(b, met & (ordered | same & (F.col("a.n") > 1))).select(*(f"a.{c}" for c in (*keys, "n")), *other)


def coalesced(ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (unit, base), start, end: ranges that overlap or touch made one (gaps and islands)."""
    keys = keys or ["unit", "base"]
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(*keys, "start", "end").distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def copies(blocks: DataFrame) -> DataFrame:
    """unit, a, b: cells that a copy connects."""
    return blocks.where("action = 1").select("unit", F.col("source").alias("a"), F.col("cell").alias("b")).distinct()


def copy_components(blocks: DataFrame, cells: int = 4) -> DataFrame:
    """unit, cell, component (its smallest cell): cells that copies connect, a label's minimum passed on round by round.

    A unit has few cells, so few rounds do, whatever the number of units.
    """
    ties = copies(blocks)
    both = checkpointed(ties.union(ties.select("unit", "b", "a")).toDF("unit", "a", "b").distinct())
    labels = blocks.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")).withColumn("component", F.col("cell"))
    for _ in range(cells - 1):
        least = both.join(labels, (both["unit"] == labels["unit"]) & (both["a"] == labels["cell"])).groupBy(both["unit"], F.col("b").alias("cell")).agg(F.min("component").alias("low"))
        labels = checkpointed(labels.join(least, ["unit", "cell"], "left").select("unit", "cell", F.least("component", F.coalesce("low", "component")).alias("component")))
    return labels


def aliases(blocks: DataFrame) -> DataFrame:
    """unit, id, of: each block with k divisible by 5 stands for the block k mod 7 + 1 places before it (after it, for k divisible by 35)."""
    step = F.col("k") % 7 + 1
    to = F.when(F.col("k") % 35 == 0, F.col("pos") + 1).otherwise(F.col("pos") - step)
    return blocks.where("k % 5 = 0").select("unit", F.col("pos").alias("id"), to.alias("of"))


def resolved(aliases: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(unit, id, root) of aliases that end in something that is no alias, and (unit, id) of those that never do.

    Pointers are doubled, so a chain of n takes log n rounds.
    """
    at = checkpointed(aliases.select("unit", "id", "of"))
    steps = 1
    n = at.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while steps <= 2 * n and most_rounds:
        over = at.select("unit", F.col("id").alias("of"), F.col("of").alias("further"))
        at = checkpointed(at.join(over, ["unit", "of"], "left").select("unit", "id", F.coalesce("further", "of").alias("of")))
        steps, most_rounds = steps * 2, most_rounds - 1
    still = aliases.select("unit", F.col("id").alias("of"))
    return at.join(still, ["unit", "of"], "left_anti").select("unit", "id", F.col("of").alias("root")), at.join(still, ["unit", "of"], "left_semi").select("unit", "id")
