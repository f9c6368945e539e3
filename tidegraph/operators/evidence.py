"""Slices, premises and proofs: what a question depends on, and what is well founded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.shared import checkpointed


def demanded_cells(blocks: DataFrame, asked: int = 0, cells: int = 4) -> DataFrame:
    """unit, cell: cells whose values a question about one cell can depend on, backward over copies (a unit has few cells, so few rounds)."""
    copies = checkpointed(blocks.where("action = 1").select("unit", F.col("cell").alias("to"), F.col("source").alias("cell")).distinct())
    known = checkpointed(blocks.select("unit").distinct().select("unit", F.lit(asked).cast("long").alias("cell")))
    for _ in range(cells - 1):
        further = copies.join(known.withColumnRenamed("cell", "to"), ["unit", "to"]).select("unit", "cell")
        known = checkpointed(known.union(further).distinct())
    return known


def separations(blocks: DataFrame) -> DataFrame:
    """unit, a, b, n: pairs of cells with how many premises (blocks of one kind and k) keep them apart: both cells are members.

    A unit has four cells, so a premise has at most four members.
    """
    members = blocks.select("unit", "event_type", F.floor(F.col("k") / 20).alias("premise"), "cell").distinct()
    a, b = members.alias("a"), members.alias("b")
    same = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.event_type") == F.col("b.event_type")) & (F.col("a.premise") == F.col("b.premise"))
    return a.join(b, same & (F.col("a.cell") < F.col("b.cell"))).groupBy(F.col("a.unit").alias("unit"), F.col("a.cell").alias("a"), F.col("b.cell").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def local_rules(blocks: DataFrame) -> DataFrame:
    """unit, pos, rule, to: calls (push and go to the body), the boundaries that resume after them, and unwinding halts. None is an edge."""
    last = Window.partitionBy("unit")
    rows = blocks.withColumn("last", F.max("pos").over(last))
    call = (F.col("event_type") == "error") & (F.col("k") % 4 == 0) & (F.col("k") % 10 != 0)
    rules = F.array_compact(
        F.array(
            F.when(call & (F.col("pos") < F.col("last")), F.struct(F.lit("INVOKE").alias("rule"), (F.col("pos") + 1).alias("to"))),
            F.when(call & (F.col("pos") + 2 <= F.col("last")), F.struct(F.lit("RESUME").alias("rule"), (F.col("pos") + 2).alias("to"))),
            F.when((F.col("event_type") == "view") & (F.col("k") % 2 == 0), F.struct(F.lit("BOUNDARY").alias("rule"), F.col("pos").alias("to"))),
            F.when((F.col("event_type") == "error") & (F.col("k") % 10 == 0), F.struct(F.lit("UNWIND").alias("rule"), F.lit(0).cast("long").alias("to"))),
        )
    )
    return rows.select("unit", "pos", F.inline(rules))


def ungrounded(proofs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """proof: those in or behind a cycle of dependencies (proof, needs): what is left when proofs without open needs are peeled off, layer by layer."""
    every = proofs.select("proof").union(proofs.select("needs")).where("proof is not null").distinct()
    left = checkpointed(every)
    needs = checkpointed(proofs.where("needs is not null").select("proof", "needs").distinct())
    for _ in range(most_rounds):
        blocked = needs.join(left.select(F.col("proof").alias("needs")), "needs", "left_semi").select("proof").distinct()
        rest = checkpointed(left.join(blocked, "proof", "left_semi"))
        if rest.count() == left.count():
            return rest
        left = rest
    raise RuntimeError(f"not settled within {most_rounds} rounds")


def images(writes: DataFrame) -> DataFrame:
    """unit, base, start, end, pos: who wrote each segment last, neighbouring segments of one writer made one.

    writes: unit, base, pos, start, end. Segments meet writes by overlap inside their base.
    """
    from tidegraph.operators.storage import segments

    s, w = segments(writes).alias("s"), writes.alias("w")
    met = s.join(w, (F.col("s.unit") == F.col("w.unit")) & (F.col("s.base") == F.col("w.base")) & (F.col("w.start") < F.col("s.end")) & (F.col("s.start") < F.col("w.end")))
    held = met.groupBy("s.unit", "s.base", "s.start", "s.end").agg(F.max("w.pos").alias("pos"))
    order = Window.partitionBy("unit", "base").orderBy("start")
    new = F.when((F.lag("pos").over(order) == F.col("pos")) & (F.lag("end").over(order) == F.col("start")), 0).otherwise(1)
    parts = held.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("unit", "base", "part", "pos").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("unit", "base", "start", "end", "pos")


def met_on_all_ways(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """unit, pos, cell: cells that are closed (unit, pos, cell) at every predecessor of a block (intersection: as many as predecessors)."""
    ways = edges.where("dst >= 0").select("unit", "src", "dst").distinct()
    asked = ways.groupBy("unit", "dst").agg(F.count(F.lit(1)).alias("asked"))
    held = ways.join(closed.withColumnRenamed("pos", "src"), ["unit", "src"]).groupBy("unit", "dst", "cell").agg(F.count(F.lit(1)).alias("held"))
    return held.join(asked, ["unit", "dst"]).where("held = asked").select("unit", F.col("dst").alias("pos"), "cell")


def system_context(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, mode, candidates: of view blocks; EXPLICIT with the values of cell 3 for k from 50 on, else DEFAULT."""
    held = values.where("cell = 3 and val <> '?'").groupBy("unit", "pos").agg(F.array_join(F.array_sort(F.collect_set(F.substring("val", 1, 4))), "|").alias("names"))
    views = blocks.where("event_type = 'view'").join(held, ["unit", "pos"], "left")
    explicit = F.col("k") >= 50
    return views.select("unit", "pos", F.when(explicit, "EXPLICIT").otherwise("DEFAULT").alias("mode"), F.when(explicit, F.coalesce("names", F.lit(""))).alias("candidates"))


def conflicts(occurrences: DataFrame, operations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_occurrences, n_operations: correlations by keys that are not one to one, which a consumer must refuse."""
    left = occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_occurrences"))
    right = operations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_operations"))
    return left.join(right, keys).where("n_occurrences > 1 or n_operations > 1")


def contradictory(blocks: DataFrame) -> DataFrame:
    """unit, cell, n: cells for which the first literals of a unit's kinds of writers contradict each other, and how many there are."""
    first = blocks.where("action = 0").groupBy("unit", "cell", "event_type").agg(F.min_by("literal", "pos").alias("literal"))
    return first.groupBy("unit", "cell").agg(F.count_distinct("literal").alias("n")).where("n > 1")


def literal_runs(blocks: DataFrame) -> DataFrame:
    """unit, start, n, literal: runs of blocks with one literal, as islands of places less their rank among that literal's."""
    rank = F.row_number().over(Window.partitionBy("unit", "literal").orderBy("pos"))
    return blocks.withColumn("island", F.col("pos") - rank).groupBy("unit", "literal", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n")).drop("island")


def differences(received: DataFrame, expected: DataFrame) -> DataFrame:
    """side and the rows that one of both frames has more often than the other; empty if both are equal as bags."""
    sides = [a.exceptAll(b).withColumn("side", F.lit(side)) for side, a, b in (("received", received, expected), ("expected", expected, received))]
    return sides[0].unionByName(sides[1])


def assumptions(blocks: DataFrame) -> DataFrame:
    """unit, pos, labels: what has to be assumed for a block's candidates, comma-joined; blocks that need nothing are left out."""
    copied = F.when(F.col("action") == 1, F.lit("SOURCE_CELL_IS_CLOSED"))
    unknown = F.when(F.col("action") == 2, F.lit("EFFECT_IS_BOUNDED"))
    open_way = F.when((F.col("event_type") == "purchase") & (F.col("k") % 25 == 0), F.lit("CONTROL_IS_CLOSED"))
    labels = F.array_compact(F.array(copied, unknown, open_way))
    return blocks.select("unit", "pos", F.array_join(labels, ",").alias("labels")).where("labels <> ''")
