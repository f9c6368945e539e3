"""Control with several entries and abnormal outcomes, and what occurrences are qualified by.

A unit has entries, and its graph is one for each entry: the blocks that the
entry reaches, with their edges, returns leading to that entry's own exit. An
invocation that fails goes to the handler of the innermost scope around it (an
EXCEPTION edge), or leaves the unit to its caller (CONTROL_EXIT to PROPAGATE);
a halt leaves it for good (CONTROL_EXIT to HALT). Scopes are ranges of blocks,
met by an equi-join on the unit and containment.

An occurrence is qualified by the ways on which control reaches it: from the
unit's entry, or through control whose targets are only bounded. Its values
are closed only if every block that makes one is a literal that control
reaches by known ways alone: a second stratum, which asks for what does not
hold in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import cfg
from tidegraph.operators.dataflow import REACH, REACHED, UNKNOWN, _inside, reach, value_support
from tidegraph.operators.fixpoint import GROUP, solve
from tidegraph.sources.programs import HALT_AT, LITERAL, RETURN_AT

#: A place that is no block: the unit's caller, which gets what no handler takes.
PROPAGATE_AT = -3


def entries(blocks: DataFrame) -> DataFrame:
    """unit, entry: the first block, and signups with a number divisible by five."""
    return blocks.where("pos = 0 OR event_type = 'signup' AND k % 5 = 0").select("unit", F.col("pos").alias("entry"))


def scopes(blocks: DataFrame) -> DataFrame:
    """unit, handler, first, last: purchases with an even number handle what fails in the blocks before them, three and a third of their number."""
    n = 3 + F.floor(F.col("k") / 3)
    return blocks.where("event_type = 'purchase' AND k % 2 = 0").select("unit", F.col("pos").alias("handler"), (F.col("pos") - n).alias("first"), (F.col("pos") - 1).alias("last"))


def failing(blocks: DataFrame) -> DataFrame:
    """unit, pos of the invocations that can fail: errors with an odd number."""
    return blocks.where("event_type = 'error' AND k % 2 = 1").select("unit", "pos")


def handlers(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """unit, pos, handler: of each site the handler of the innermost scope around it (the shortest, of those the latest), null if there is none."""
    s, r = sites.alias("s"), ranges.alias("r")
    inside = (F.col("s.unit") == F.col("r.unit")) & (F.col("s.pos") >= F.col("r.first")) & (F.col("s.pos") <= F.col("r.last"))
    size = F.col("r.last") - F.col("r.first")
    met = s.join(r, inside, "left").groupBy("s.unit", "s.pos")
    return met.agg(F.min_by("r.handler", F.struct(size, -F.col("r.handler"))).alias("handler"))


def outcome_edges(blocks: DataFrame) -> DataFrame:
    """unit, src, dst, kind: all edges of blocks, abnormal outcomes among them."""
    normal = cfg.edges(blocks)
    halting = F.col("kind") == "HALT"
    normal = normal.withColumn("kind", F.when(halting, "CONTROL_EXIT").otherwise(F.col("kind")))
    caught = handlers(failing(blocks), scopes(blocks))
    kind = F.when(F.col("handler").isNull(), "CONTROL_EXIT").otherwise("EXCEPTION")
    abnormal = caught.select("unit", F.col("pos").alias("src"), F.coalesce("handler", F.lit(PROPAGATE_AT)).cast("long").alias("dst"), kind.alias("kind"))
    return normal.unionByName(abnormal)


def graphs(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, entry, src, dst, exit, kind: the graph of each entry; exit names what is left to (NORMAL, HALT, PROPAGATE), and dst is null there."""
    edges = outcome_edges(blocks)
    own = F.col("entry").cast("string")
    seeds = entries(blocks).select("unit", F.col("entry").alias("pos"), F.lit(REACHED).cast("long").alias("cell"), own.alias("val"), F.lit(-1).cast("long").alias("prod"))
    reached = solve(blocks, _inside(edges), seeds, REACH, group).select("unit", "pos", F.col("val").cast("long").alias("entry"))
    met = reached.withColumnRenamed("pos", "src").join(edges, ["unit", "src"])
    to = F.when(F.col("dst") == RETURN_AT, "NORMAL").when(F.col("dst") == HALT_AT, "HALT").when(F.col("dst") == PROPAGATE_AT, "PROPAGATE")
    return met.select("unit", "entry", "src", F.when(F.col("dst") >= 0, F.col("dst")).alias("dst"), to.alias("exit"), "kind").distinct()


def exit_counts(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, entry, normal, halt, propagate: how many blocks leave each entry's graph by each of its exits."""
    out = graphs(blocks, group)
    left = [F.count_distinct(F.when(F.col("exit") == x.upper(), F.col("src"))).alias(x) for x in ("normal", "halt", "propagate")]
    return out.groupBy("unit", "entry").agg(*left)


def under_unknown_control(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos of the blocks that control of bounded targets may lead to, at once or on its way."""
    opened = cfg.open_edges(blocks)
    first = opened.join(reach(blocks, group).withColumnRenamed("pos", "src"), ["unit", "src"], "left_semi").select("unit", F.col("dst").alias("pos")).distinct()
    seeds = first.select("unit", "pos", F.lit(REACHED).cast("long").alias("cell"), F.lit("").alias("val"), F.lit(-1).cast("long").alias("prod"))
    every = _inside(cfg.edges(blocks)).unionByName(opened.select("unit", "src", "dst")).distinct()
    return solve(blocks, every, seeds, REACH, group).select("unit", "pos")


def qualified(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, status, n, remainder, names (sorted, joined by |): the occurrences (purchases) with what their first cell may name.

    Status, first match: CONTROL_UNAVAILABLE in units without a graph (of one
    block), NOT_QUALIFIED where no control leads, POSSIBLE_UNDER_UNKNOWN_CONTROL
    where unknown control may lead, QUALIFIED_POSSIBLE. Names are values of
    qualified occurrences; remainder: there may be others, because a producer
    is no literal or stands under unknown control, or because the status is not
    the last one.
    """
    at = ["unit", "pos"]
    sizes = blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"))
    known = reach(blocks, group).withColumn("known", F.lit(True))
    unsure = under_unknown_control(blocks, group).withColumn("unsure", F.lit(True))
    sites = blocks.where("event_type = 'purchase'").select(*at).join(sizes, "unit").join(known, at, "left").join(unsure, at, "left")
    status = F.when(F.col("blocks") < 2, "CONTROL_UNAVAILABLE").when(F.col("unsure"), "POSSIBLE_UNDER_UNKNOWN_CONTROL").when(F.col("known"), "QUALIFIED_POSSIBLE").otherwise("NOT_QUALIFIED")
    sites = sites.select(*at, status.alias("status"))
    made = value_support(blocks, group).where("cell = 0")
    literal = blocks.where(F.col("action") == LITERAL).join(unsure, at, "left_anti").select("unit", F.col("pos").alias("producer_pos"), F.lit(True).alias("closed"))
    origins = made.join(literal, ["unit", "producer_pos"], "left").groupBy(*at).agg(
        F.collect_set(F.when(F.col("val") != UNKNOWN, F.col("val"))).alias("names"), F.bool_and(F.coalesce("closed", F.lit(False))).alias("closed")
    )
    met = sites.join(origins, at, "left")
    shown = F.when(F.col("status").isin("QUALIFIED_POSSIBLE", "POSSIBLE_UNDER_UNKNOWN_CONTROL"), F.coalesce("names", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    remainder = (F.col("status") != "QUALIFIED_POSSIBLE") | ~F.coalesce("closed", F.lit(False))
    return met.select(*at, "status", F.size(shown).cast("long").alias("n"), remainder.alias("remainder"), F.array_join(F.array_sort(shown), "|").alias("names"))
