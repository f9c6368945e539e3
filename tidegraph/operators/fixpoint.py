"""Monotone fixpoints over units, in two physical ways behind one call.

A fact (cell, val, prod) holds at a block's entry; a transfer says what a block
makes of it, and the results hold at the entry of every successor. All analyses
are inside a unit. Units of up to `GROUP` blocks are solved each by itself in a
task, which costs one shuffle; larger ones by a loop of joins over whatever is
new (semi-naive), with a checkpoint a round, so that no unit has to fit a task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.shared import Pieces, checkpointed, shuffles_dropped, small, span

#: Blocks of a unit that one task solves.
GROUP = 20_000
FACT = "unit long, pos long, cell long, val string, prod long"
Fact = tuple[int, str, int]


class Transfer(NamedTuple):
    """A block's effect on a fact, for a task and for a join.

    alone: (block, fact) to facts; block has pos, cell, action, source, literal.
    joined: array of facts, of columns f_cell, f_val, f_prod and the block's.
    """

    alone: Callable[[dict, Fact], Iterable[Fact]]
    joined: Callable[[], Column]


def fact(cell: Column, val: Column, prod: Column) -> Column:
    return F.struct(cell.cast("long").alias("cell"), val.alias("val"), prod.cast("long").alias("prod"))


def by_unit(flow: DataFrame, solve: Callable[[list[dict]], Iterable[tuple]], shape: str = FACT) -> DataFrame:
    """Rows (facts, or of another shape of longs and strings that begins with the unit) that solve finds from all rows of a unit, unit after unit of sorted partitions.

    Partitions hold many units each, and are read as a stream: one unit is in memory at a time.
    """

    names, kinds = zip(*(x.split() for x in shape.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []
        types = [pa.int64() if k == "long" else pa.string() for k in kinds]

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["unit"] != held[-1]["unit"]:
                    out.extend((held[0]["unit"], *f) for f in solve(held))
                    held = []
                    if len(out) > 50_000:
                        yield given()
                        out.clear()
                held.append(row)
        if held:
            out.extend((held[0]["unit"], *f) for f in solve(held))
        if out:
            yield given()

    return flow.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, shape)


def _grouped(flow: DataFrame, transfer: Transfer) -> DataFrame:
    alone = transfer.alone

    def solve(rows: list[dict]) -> Iterable[tuple]:
        after: dict[int, list[int]] = {}
        block: dict[int, dict] = {}
        found: set[tuple[int, Fact]] = set()
        for r in rows:
            at = r["pos"]
            block[at] = r
            if r["dst"] is not None:
                after.setdefault(at, []).append(r["dst"])
            found.update((at, f) for f in zip(r["s_cell"], r["s_val"], r["s_prod"], strict=True))
        work = deque(found)
        while work:
            at, held = work.popleft()
            to = after.get(at)
            for made in alone(block[at], held) if to else ():
                for x in to:
                    new = (x, made)
                    if new not in found:
                        found.add(new)
                        work.append(new)
        return [(at, *f) for at, f in found]

    return by_unit(flow, solve)


def _rounds(flow: DataFrame, transfer: Transfer, most_rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """What is known after the rounds, and what the last of them found newly; None where nothing is left to find."""
    flow = checkpointed(flow)
    known = flow.select("unit", "pos", F.explode(F.arrays_zip("s_cell", "s_val", "s_prod")).alias("s")).select("unit", "pos", F.col("s.s_cell").alias("cell"), F.col("s.s_val").alias("val"), F.col("s.s_prod").alias("prod")).distinct()
    known = new = checkpointed(known)
    steps = flow.where("dst is not null").drop("s_cell", "s_val", "s_prod")
    for _ in range(most_rounds):
        held = new.select("unit", "pos", F.col("cell").alias("f_cell"), F.col("val").alias("f_val"), F.col("prod").alias("f_prod"))
        made = held.join(steps, ["unit", "pos"]).select("unit", F.col("dst").alias("pos"), F.inline(transfer.joined())).distinct()
        new = checkpointed(made.join(known, ["unit", "pos", "cell", "val", "prod"], "left_anti"))
        if new.isEmpty():
            return known, None
        known = checkpointed(known.unionByName(new))
    return known, new


def _joined(flow: DataFrame, transfer: Transfer, most_rounds: int) -> DataFrame:
    known, left = _rounds(flow, transfer, most_rounds)
    if left is not None:
        raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
    return known


def budgeted(blocks: DataFrame, edges: DataFrame, seeds: DataFrame, transfer: Transfer, rounds: int) -> DataFrame:
    """unit, pos, cell, val, prod, limited: the facts of at most so many steps; limited, in all rows of a unit, says that the unit's last step still found some.

    Such a unit may have more facts, so nothing of it is closed.
    """
    known, left = _rounds(_flow(blocks, edges, seeds), transfer, rounds)
    if left is None:
        return known.withColumn("limited", F.lit(False))
    open_units = left.select("unit", F.lit(True).alias("limited")).distinct()
    return known.join(open_units, "unit", "left").withColumn("limited", F.coalesce("limited", F.lit(False)))


def _flow(blocks: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """A row for each block and successor, with the block's effect and seeds."""
    given = seeds.groupBy("unit", "pos").agg(F.collect_list(F.struct("cell", "val", "prod")).alias("s"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return (
        blocks.select("unit", "pos", "cell", "action", "source", "literal")
        .join(edges.select("unit", F.col("src").alias("pos"), "dst"), ["unit", "pos"], "left")
        .join(given, ["unit", "pos"], "left")
        .select("*", F.coalesce("s.cell", empty("bigint")).alias("s_cell"), F.coalesce("s.val", empty("string")).alias("s_val"), F.coalesce("s.prod", empty("bigint")).alias("s_prod"))
        .drop("s")
    )


def solve(blocks: DataFrame, edges: DataFrame, seeds: DataFrame, transfer: Transfer, group: int = GROUP, most_rounds: int = 100_000) -> DataFrame:
    """unit, pos, cell, val, prod: all facts at blocks' entries.

    edges: unit, src, dst between blocks. seeds: unit, pos, cell, val, prod.
    """
    flow = _flow(blocks, edges, seeds)
    large = blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("unit")
    if large.isEmpty():
        return _grouped(flow, transfer)
    large = checkpointed(large)
    return _grouped(flow.join(large, "unit", "left_anti"), transfer).unionByName(_joined(flow.join(large, "unit", "left_semi"), transfer, most_rounds))


def closure(edges: DataFrame, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node: everything that seeds (node) reach over edges (src, dst), across all units, a frontier at a time."""
    edges = checkpointed(edges.select("src", "dst").distinct())  # read in every round
    known = new = checkpointed(seeds.select("node").distinct())
    for _ in range(most_rounds):
        made = edges.join(new, edges["src"] == new["node"]).select(F.col("dst").alias("node")).distinct()
        new = checkpointed(made.join(known, "node", "left_anti"))
        if new.isEmpty():
            return known
        known = checkpointed(known.union(new))
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")


def and_closure(rules: DataFrame, seeds: DataFrame, edges: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """node: what follows from seeds by rules (rule, premise, head), a rule and head firing when all their premises hold.

    edges (premise, head) are rules of one premise each, and need no name. Neither is copied: both are read in the rounds that find
    nodes within the range of their premises, so what is costly to derive should be a checkpoint. Copies of rows do no harm.
    A rule's premises are looked up together, so no counts are kept from round to round.
    """
    rules = rules.select("rule", "premise", "head")
    edges = None if edges is None else edges.select("premise", "head")
    spark, known = rules.sparkSession, Pieces()
    with shuffles_dropped(spark):
        new = checkpointed(seeds.select("node").distinct())
        asked, fires = span(rules, "premise"), span(rules, "head")
        for _ in range(most_rounds):
            found = known.add(new)
            made, heads = [], []
            if edges is not None and found.low is not None:
                near = edges.where(F.col("premise").between(found.low, found.high))
                if (goes := span(near, "head")).rows:
                    made.append(near.join(small(new, found.rows), near["premise"] == new["node"]).select(F.col("head").alias("node")))
                    heads.append(goes)
            if asked.low is not None and found.meets(asked):
                held = known.meeting(asked).select(F.col("node").alias("premise"), F.lit(True).alias("held"))
                fired = rules.join(held, "premise", "left").groupBy("rule", "head").agg(F.min(F.coalesce("held", F.lit(False))).alias("fires")).where("fires")
                made.append(fired.select(F.col("head").alias("node")))
                heads.append(fires)
            if not made:
                break
            nodes = reduce(DataFrame.union, made).withColumn("had", F.lit(False))
            had = known.meeting(*heads)
            nodes = nodes if had is None else nodes.union(had.select("node", F.lit(True)))
            new = checkpointed(nodes.groupBy("node").agg(F.max("had").alias("had")).where("not had").select("node"))
            if new.isEmpty():
                break
        else:
            raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
    return known.all()
