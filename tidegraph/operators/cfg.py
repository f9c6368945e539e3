"""Control-flow graphs: projection of blocks into nodes and labelled edges, admission, and validation as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.sources.programs import HALT_AT, RETURN_AT, terminators, units

#: Edge kinds by what they may end in.
TO_BLOCK = ("JUMP", "BRANCH_TRUE", "BRANCH_FALSE", "INVOKE_NORMAL", "ENTRY")


def nodes(blocks: DataFrame) -> DataFrame:
    """unit, kind, pos, ordinal: sequences, then the entry, its normal exit and one exit for each halting block.

    Ordinals number a unit's nodes in canonical order (kind, place), whatever order they came in.
    """
    halting = terminators(blocks).where("kind = 'HALT'").select("unit", F.lit("HALT_EXIT").alias("kind"), "pos")
    ends = units(blocks).select("unit", F.explode(F.array(F.lit("ENTRY"), F.lit("NORMAL_EXIT"))).alias("kind"), F.lit(0).cast("long").alias("pos"))
    every = blocks.select("unit", F.lit("SEQUENCE").alias("kind"), "pos").unionByName(ends).unionByName(halting)
    return every.withColumn("ordinal", (F.row_number().over(Window.partitionBy("unit").orderBy("kind", "pos")) - 1).cast("long"))


def edges(blocks: DataFrame) -> DataFrame:
    """unit, src, dst, kind; both ways of a branch are kept, blocks that nothing reaches too."""
    met = terminators(blocks).join(units(blocks), "unit")
    halt = F.col("kind") == "HALT"
    past = F.col("target") > F.col("last")
    return met.select(
        "unit",
        F.col("pos").alias("src"),
        F.when(halt, F.lit(HALT_AT)).when(past, F.lit(RETURN_AT)).otherwise(F.col("target")).cast("long").alias("dst"),
        F.when(~halt & past, "RETURN").otherwise(F.col("kind")).alias("kind"),
    )


def entry_edges(blocks: DataFrame) -> DataFrame:
    return blocks.where("pos = 0").select("unit", F.lit(None).cast("long").alias("src"), F.col("pos").alias("dst"), F.lit("ENTRY").alias("kind"))


def kind_counts(edges: DataFrame) -> DataFrame:
    total = Window.partitionBy()
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 9))


def invalid(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges whose ends do not fit their kind: a missing block, a return or halt into one."""
    known = blocks.select("unit", F.col("pos").alias("dst"), F.lit(True).alias("there"))
    into = edges.join(known, ["unit", "dst"], "left")
    fits: Column = F.when(F.col("kind") == "RETURN", F.col("dst") == RETURN_AT).when(F.col("kind") == "HALT", F.col("dst") == HALT_AT).when(F.col("kind").isin(*TO_BLOCK), F.col("there").isNotNull()).otherwise(False)
    return into.where(~fits).select("unit", "src", "dst", "kind")


def duplicates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("unit", "src", "dst", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def count_mismatches(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks whose number of edges is not what their kind alone asks for."""
    asked = blocks.select("unit", F.col("pos").alias("src"), F.when(F.col("event_type") == "click", 2).otherwise(1).cast("long").alias("asked"))
    got = edges.groupBy("unit", "src").agg(F.count(F.lit(1)).alias("got"))
    return asked.join(got, ["unit", "src"], "full").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("asked is null or asked <> got")


def open_edges(blocks: DataFrame) -> DataFrame:
    """unit, src, dst of control that may go to a bounded set of labels: from open blocks to the unit's signup blocks.

    Open are purchases with k divisible by 25. The bound is resolved once, as an equi-join on the unit.
    """
    source = blocks.where("event_type = 'purchase' and k % 25 = 0").select("unit", F.col("pos").alias("src"))
    label = blocks.where("event_type = 'signup' and k % 10 = 0").select("unit", F.col("pos").alias("dst"))
    return source.join(label, "unit")


def issues(blocks: DataFrame) -> DataFrame:
    """unit, pos, code: facts that a strict projection doesn't admit."""
    rows = blocks.select("unit", "pos", F.explode(F.array_compact(F.array(
        F.when((F.col("event_type") == "purchase") & (F.col("k") % 25 == 0), "OPEN_CONTROL"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 10 == 0), "ABNORMAL_END"),
        F.when((F.col("action") == 2) & (F.col("k") > 90), "UNBOUNDED_EFFECT"),
    ))).alias("code"))
    return rows


def build_status(blocks: DataFrame) -> DataFrame:
    """unit, inventory, status: of each unit under the strict policy, first match of the ladder."""
    found = issues(blocks).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("code") == "OPEN_CONTROL", 1).otherwise(0)).alias("open"))
    inventory = blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("blocks"))
    met = inventory.join(found, "unit", "left")
    status = F.when(F.col("blocks") < 2, "INVALID").when(F.col("open") == 1, "UNSUPPORTED_CONTROL").when(F.col("n") > 0, "PARTIAL").otherwise("COMPLETE")
    return met.select("unit", F.when(F.col("n").isNull(), "COMPLETE").otherwise("PARTIAL").alias("inventory"), status.alias("status"))


def unsupported(blocks: DataFrame, supported: list[str]) -> DataFrame:
    """Kinds of blocks that are asked for and not supported, with how often."""
    have = blocks.sparkSession.createDataFrame([(x,) for x in supported], "event_type string")
    return blocks.join(F.broadcast(have), "event_type", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
