"""Values over rules that need all their premises and let only some values through.

A rule has a head, carriers whose values it passes on, premises that all have
to have a value before it passes any, and predicates that narrow what it
passes. Rules may feed back into each other; what only supports itself has no
values.

Rules only pass values on, so all values are among the seeds': a node's are
bits in blocks of 64, a row for each block, and predicates are masks of blocks.
The row of block 0 is there for every node that has a value. Rules of a carrier
alone take what is new in a round (semi-naive); rules with premises look up
what all their carriers have once one of them has something new. Rules are not
copied, and a round's results are a checkpoint of what is new only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.shared import Pieces, checkpointed, shuffles_dropped, small, span

#: Values that one task numbers.
NUMBERED = 1_000_000


def passes(kind: Column, arg: Column, val: Column) -> Column:
    """Whether a predicate lets a value through: ANY, NOT (anything but arg), PREFIX (what begins with arg)."""
    return F.when(kind == "NOT", val != arg).when(kind == "PREFIX", val.startswith(arg)).otherwise(True)


def _values(seeds: DataFrame) -> tuple[DataFrame, int]:
    """val, block, bit of all values (null is one), and their number."""
    vals = checkpointed(seeds.select("val").distinct())
    n = vals.count()
    ids = vals.coalesce(1 + n // NUMBERED).select("val", F.monotonically_increasing_id().alias("id"))
    return checkpointed(ids.select("val", F.expr("id div 64").alias("block"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bit"))), n


def _masks(rules: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind, arg, pred, rest: each predicate with the mask of blocks that pred, block, mask don't name."""
    tests = checkpointed(rules.where("kind in ('NOT', 'PREFIX')").select("kind", "arg").distinct())
    rest = F.when((F.col("kind") == "NOT") & F.col("arg").isNotNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    tests = checkpointed(tests.select("kind", "arg", F.monotonically_increasing_id().alias("pred"), rest.alias("rest")))
    known = values.where("val is not null")
    prefixes = known.select("block", "bit", F.explode(F.expr("transform(sequence(0, length(val)), i -> substring(val, 1, i))")).alias("arg"))
    let = tests.where("kind = 'PREFIX'").join(prefixes, "arg").groupBy("pred", "block").agg(F.bit_or("bit").alias("mask"))
    stopped = tests.where("rest = -1").join(known.withColumnRenamed("val", "arg"), "arg").select("pred", "block", "bit")
    stopped = stopped.union(tests.where("rest = -1").crossJoin(values.where("val is null")).select("pred", "block", "bit"))
    stopped = stopped.groupBy("pred", "block").agg(F.bitwise_not(F.bit_or("bit")).alias("mask"))
    return tests, checkpointed(let.union(stopped))


def derived_values(rules: DataFrame, premises: DataFrame | None, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, val: the values that follow from seeds (node, val).

    rules: rule, head, carrier, kind, arg: a rule and head may have several carriers, a row each; one whose rule is null needs its carrier
    alone. premises: rule, premise (the carriers are such without being named). Rules are read in several rounds, so what is
    costly to derive should be a checkpoint. Copies of rows do no harm.
    """
    rules = rules.select("rule", "head", "carrier", "kind", "arg")
    with shuffles_dropped(rules.sparkSession):
        values, n_values = _values(seeds)
        found = _found(rules, premises, seeds, values, n_values > 64, most_rounds)
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return found.join(small(values, n_values), "block").where(has).select("node", "val")


def _found(rules: DataFrame, premises: DataFrame | None, seeds: DataFrame, values: DataFrame, many: bool, most_rounds: int) -> DataFrame:
    """node, block, bits: pieces that have no bit in common. many: whether there are other blocks than 0."""
    tests, masks = _masks(rules, values)
    n_tests, n_masks = tests.count(), masks.count()

    free = F.coalesce(F.col("kind").isin("NOT", "PREFIX"), F.lit(False))
    tested = rules.alias("r").join(small(tests, n_tests).alias("t"), (F.col("r.kind") == F.col("t.kind")) & F.col("r.arg").eqNullSafe(F.col("t.arg")))
    rules = rules.where(~free).select("rule", "head", "carrier", F.lit(None).cast("long").alias("pred"), F.lit(-1).cast("long").alias("rest"))
    rules = rules.union(tested.select("rule", "head", "carrier", "pred", "rest")) if n_tests else rules

    def narrowed(met: DataFrame) -> DataFrame:
        """met (with pred, rest, block, bits) with the bits that its predicates let through."""
        if not n_tests:
            return met
        return met.join(small(masks, n_masks), ["pred", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.coalesce("mask", "rest"))).drop("mask")

    def rows(facts: DataFrame) -> DataFrame:
        """facts without empty rows but those of block 0."""
        facts = facts.select("node", F.col("block") if many else F.lit(0).cast("long").alias("block"), "bits").where("bits <> 0")
        return facts.union(facts.select("node", F.lit(0).cast("long"), F.lit(0).cast("long"))) if many else facts

    edges = rules.where("rule is null").drop("rule")
    needs = rules.where("rule is not null").withColumnRenamed("carrier", "need")
    if premises is not None:
        of = needs.select("rule", "head").distinct().join(premises.select("rule", F.col("premise").alias("need")), "rule")
        needs = needs.union(of.select("rule", "head", "need", F.lit(None).cast("long"), F.lit(0).cast("long")))  # a mask of nothing: they pass none on
        needs = checkpointed(needs)
    asked, fires = span(needs, "need"), span(needs, "head")

    def carried(new: DataFrame, near: DataFrame, n: int) -> DataFrame:
        met = near.join(small(new, n), near["carrier"] == new["node"])
        return narrowed(met).select(F.col("head").alias("node"), "block", "bits")

    def fired(held: DataFrame) -> DataFrame:
        met = needs.join(held.withColumnRenamed("node", "need"), "need", "left").withColumn("has", F.col("bits").isNotNull())
        met = narrowed(met.withColumn("block", F.coalesce("block", F.lit(0)) if many else F.lit(0).cast("long")))
        met = met.withColumn("bits", F.col("bits").bitwiseAND(F.col("rest")) if not n_tests else F.col("bits"))
        by = met.groupBy("rule", "head", "block").agg(F.bit_or("bits").alias("bits"), F.min("has").alias("has"))
        if many:  # a need without a value shows in block 0
            by = by.withColumn("has", F.min(F.when(F.col("block") == 0, F.col("has"))).over(Window.partitionBy("rule", "head")))
        return by.where("has").select(F.col("head").alias("node"), "block", "bits")

    known = Pieces()
    given = seeds.alias("s").join(values.alias("v"), F.col("s.val").eqNullSafe(F.col("v.val"))).select("s.node", "block", F.col("bit").alias("bits"))
    new = checkpointed(rows(given).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
    for _ in range(most_rounds):
        at = known.add(new)
        made, heads = [], []
        if at.low is not None:
            near = edges.where(F.col("carrier").between(at.low, at.high))
            if (goes := span(near, "head")).rows:
                made.append(carried(new, near, at.rows))
                heads.append(goes)
            if asked.low is not None and at.meets(asked):
                made.append(fired(known.meeting(asked)))
                heads.append(fires)
        if not made:
            return known.all()
        facts = rows(reduce(DataFrame.union, made)).select("node", "block", "bits", F.lit(0).cast("long").alias("old"), F.lit(False).alias("had"))
        if (had := known.meeting(*heads)) is not None:
            facts = facts.union(had.select("node", "block", F.lit(0).cast("long"), F.col("bits").alias("old"), F.lit(True)))
        facts = facts.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"), F.max("had").alias("had"))
        more = F.col("bits").bitwiseAND(F.bitwise_not("old"))
        new = checkpointed(facts.select("node", "block", more.alias("bits"), "had").where("bits <> 0 or not had").drop("had"))
        if new.isEmpty():
            return known.all()
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
