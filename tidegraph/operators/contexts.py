"""Ordered replay inside units, activation stacks, and values under branch conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators import cfg
from tidegraph.operators.dataflow import CELLS, REACHED, UNKNOWN, _entry, _inside, _valued
from tidegraph.operators.fixpoint import GROUP, Transfer, by_unit, fact, solve
from tidegraph.sources.programs import LITERAL

#: Blocks of a straight run between replay points.
RUN = 8


def last_writes(blocks: DataFrame) -> DataFrame:
    """unit, run, cell, pos, val: the last write to each cell in each run of blocks."""
    runs = blocks.withColumn("run", F.floor(F.col("pos") / RUN).cast("long"))
    last = F.max_by(F.struct("pos", "val"), "pos")
    value = F.when(F.col("action") == LITERAL, F.col("literal")).when(F.col("action") == 1, F.concat(F.lit("copy of "), F.col("source").cast("string"))).otherwise(UNKNOWN)
    return runs.withColumn("val", value).groupBy("unit", "run", "cell").agg(last.alias("w")).select("unit", "run", "cell", "w.pos", "w.val")


def replay(blocks: DataFrame) -> DataFrame:
    """unit, pos, cell, val: the literal last put into the block's own cell before it in its run, if any was."""
    runs = blocks.withColumn("run", F.floor(F.col("pos") / RUN).cast("long"))
    before = Window.partitionBy("unit", "run", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("action") == LITERAL, F.col("literal")), True).over(before)
    return runs.select("unit", "pos", "cell", seen.alias("val")).where("val is not null")


def _stacked(block: dict, held: tuple) -> list:
    stack = held[1]
    if block["event_call"]:
        return [(REACHED, f"{stack}/{block['pos']}", -1)]
    if block["event_return"] and stack:
        return [(REACHED, stack.rsplit("/", 1)[0], -1)]
    return [held]


def _with_events(blocks: DataFrame) -> DataFrame:
    """Blocks whose literal also tells calls (C) and returns (R)."""
    call = (F.col("event_type") == "error") & (F.col("k") % 4 == 0) & (F.col("k") % 10 != 0)
    back = (F.col("event_type") == "view") & (F.col("k") % 2 == 0)
    return blocks.withColumn("literal", F.when(call, "C").when(back, "R").otherwise("-"))


STACKS = Transfer(
    lambda block, held: _stacked(block | {"event_call": block["literal"] == "C", "event_return": block["literal"] == "R"}, held) if not _active(block, held) else [],
    lambda: F.when(
        (F.col("literal") == "C") & F.array_contains(F.split("f_val", "/"), F.col("pos").cast("string")), F.array().cast("array<struct<cell:bigint,val:string,prod:bigint>>")
    ).otherwise(
        F.array(
            fact(
                F.lit(REACHED),
                F.when(F.col("literal") == "C", F.concat("f_val", F.lit("/"), F.col("pos").cast("string")))
                .when((F.col("literal") == "R") & (F.col("f_val") != ""), F.regexp_replace("f_val", r"/\d+$", ""))
                .otherwise(F.col("f_val")),
                F.lit(-1),
            )
        )
    ),
)


def _active(block: dict, held: tuple) -> bool:
    """A call whose place is in the stack already is recursion: it stops, and `recursive` reports it. Depth has no limit."""
    return block["literal"] == "C" and str(block["pos"]) in held[1].split("/")


def stacks(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, stack: explicit activation stacks (places of calls, innermost last) under which a block is entered."""
    marked = _with_events(blocks)
    found = solve(marked, _inside(cfg.edges(blocks)), _entry(blocks, (REACHED, "", -1)), STACKS, group)
    return found.select("unit", "pos", F.col("val").alias("stack"))


def recursive(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, stack of calls that are active already where they are met: an error, not an approximation."""
    calls = _with_events(blocks).where("literal = 'C'").select("unit", "pos")
    return stacks(blocks, group).join(calls, ["unit", "pos"], "left_semi").where(F.array_contains(F.split("stack", "/"), F.col("pos").cast("string")))


def pruned_values(blocks: DataFrame) -> DataFrame:
    """unit, pos, cell, val: possible values when a click's true branch needs cell 0 to be able to be VIEW, its false branch to be able not to be.

    Whether a branch is feasible depends on all values of a cell at once, which
    is no fact by itself, so units are solved in a task each.
    """
    edges = cfg.edges(blocks).where("dst >= 0").select("unit", F.col("src").alias("pos"), "dst", "kind")
    flow = blocks.select("unit", "pos", "cell", "action", "source", "literal").join(edges, ["unit", "pos"], "left")

    def solve_unit(rows: list[dict]) -> list[tuple]:
        after: dict[int, list] = {}
        block = {}
        for r in rows:
            block[r["pos"]] = r
            if r["dst"] is not None:
                after.setdefault(r["pos"], []).append((r["dst"], r["kind"]))
        start = {(REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(CELLS))}
        state, work = {0: start}, [0]
        while work:
            at = work.pop()
            held = state[at]
            first = {v for c, v, _ in held if c == 0}
            out = {(c, v, -1) for f in held for c, v, _ in _valued(block[at], f)}
            for to, kind in after.get(at, ()):
                if kind == "BRANCH_TRUE" and not first & {"VIEW", UNKNOWN} or kind == "BRANCH_FALSE" and not first - {"VIEW"}:
                    continue
                old = state.get(to, set())
                if not out <= old:
                    state[to] = old | out
                    work.append(to)
        return [(at, *f) for at, s in state.items() for f in s if f[0] != REACHED]

    return by_unit(flow, solve_unit).drop("prod")
