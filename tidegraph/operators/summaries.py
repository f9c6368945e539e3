"""Values and reach through matched calls and returns, by exit summaries.

A call enters a procedure of its unit, and the procedure's exits lead back to
the place after that call alone. Contexts are not enumerated: an activation is
known by its entry and the fact that holds there, and a summary says which
facts hold at its exits when that fact held at its entry. Summaries grow with
the facts and are joined at every call that enters with the fact, so a
procedure is followed once for each fact, from however many places and through
however many calls it is reached; recursion needs nothing of its own. There
are at most (facts at an entry) x (facts at a block) rows for each block.

As in `fixpoint`, units of up to `group` blocks are solved each by itself in a
task, larger ones by a loop of joins over what is new.

Defined results: a call whose procedure never returns goes nowhere; an exit in
the unit's own activation (entry -1) goes on to its successors; a call without a
place to come back to only enters; facts of different activations that meet at a
block are told apart by entry and entry fact in `activations`, and joined in `values`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import cfg
from tidegraph.operators.dataflow import CELLS, REACHED, UNKNOWN, VALUES, _entry, _inside
from tidegraph.operators.fixpoint import GROUP, Transfer, by_unit
from tidegraph.operators.shared import checkpointed

#: The activation of the unit itself, and what an activation is told apart by.
MAIN = -1
PATH = ["unit", "entry", "e_cell", "e_val", "e_prod", "pos", "cell", "val", "prod"]
_OUT = "unit long, entry long, e_cell long, e_val string, e_prod long, pos long, cell long, val string, prod long"
#: Of the unit's own activation, entry facts are not told apart.
_WHOLE = (REACHED, "", -1)


def calls(blocks: DataFrame) -> DataFrame:
    """unit, pos, to, back: each call's procedure and the place after it (null past the unit's end).

    In the event encoding, errors whose number divides by four but not by ten
    call the block two to eight places on, if there is one.
    """
    last = blocks.groupBy("unit").agg(F.max("pos").alias("last"))
    k, pos = F.col("k"), F.col("pos")
    called = blocks.where("event_type = 'error' AND k % 4 = 0 AND k % 10 <> 0").join(last, "unit")
    return called.select("unit", "pos", (pos + 2 + k % 7).alias("to"), F.when(pos < F.col("last"), pos + 1).alias("back"), "last").where("to <= last").drop("last")


def exits(blocks: DataFrame) -> DataFrame:
    """unit, pos of the blocks that end a procedure: views with an even number."""
    return blocks.where("event_type = 'view' AND k % 2 = 0").select("unit", "pos")


def _flow(blocks: DataFrame, edges: DataFrame, called: DataFrame, ends: DataFrame, seeds: DataFrame) -> DataFrame:
    """A row a block: its effect, successors, call, whether it ends a procedure, and seeds."""
    after = edges.groupBy("unit", F.col("src").alias("pos")).agg(F.collect_set("dst").alias("after"))
    given = seeds.groupBy("unit", "pos").agg(F.collect_list(F.struct("cell", "val", "prod")).alias("seeds"))
    keys = ["unit", "pos"]
    return (
        blocks.select("unit", "pos", "cell", "action", "source", "literal")
        .join(after, keys, "left")
        .join(called.select("unit", "pos", "to", "back"), keys, "left")
        .join(ends.select("unit", "pos", F.lit(True).alias("ends")), keys, "left")
        .join(given, keys, "left")
    )


def _alone(transfer: Transfer):
    def solve(rows: list[dict]) -> Iterable[tuple]:
        block = {r["pos"]: r for r in rows}
        found: set[tuple] = set()
        work: deque[tuple] = deque()
        ends: dict[tuple, list] = {}  # of an activation, its exit facts so far
        waiting: dict[tuple, list] = {}  # and the activations and places that it comes back to

        def add(activation: tuple, at: int | None, fact: tuple) -> None:
            if at is not None and (activation, at, fact) not in found:
                found.add((activation, at, fact))
                work.append((activation, at, fact))

        for r in rows:
            for s in r["seeds"] or ():
                add((MAIN, *_WHOLE), r["pos"], (s["cell"], s["val"], s["prod"]))
        while work:
            activation, at, fact = work.popleft()
            b = block[at]
            for made in transfer.alone(b, fact):
                if b["to"] is not None:
                    inner = (b["to"], *made)
                    held = waiting.setdefault(inner, [])
                    if (activation, b["back"]) not in held:
                        held.append((activation, b["back"]))
                        for x in list(ends.get(inner, ())):
                            add(activation, b["back"], x)
                    add(inner, b["to"], made)
                elif b["ends"] and activation[0] != MAIN:
                    told = ends.setdefault(activation, [])
                    if made not in told:
                        told.append(made)
                        for outer, back in list(waiting.get(activation, ())):
                            add(outer, back, made)
                else:
                    for x in b["after"] or ():
                        add(activation, x, made)
        return [(*activation, at, *fact) for activation, at, fact in found]

    return solve


def _made(held: DataFrame, flow: DataFrame, transfer: Transfer) -> DataFrame:
    """What blocks make of the facts that hold at them (PATH), with the blocks' successors, call and end."""
    met = held.withColumnsRenamed({"cell": "f_cell", "val": "f_val", "prod": "f_prod"}).join(flow, ["unit", "pos"])
    return met.select("unit", "entry", "e_cell", "e_val", "e_prod", "after", "to", "back", "ends", F.inline(transfer.joined()))


def _joined(flow: DataFrame, transfer: Transfer, most_rounds: int) -> DataFrame:
    flow = checkpointed(flow)
    steps = flow.drop("seeds")
    whole = [F.lit(x).cast(t).alias(n) for n, x, t in zip(PATH[1:5], (MAIN, *_WHOLE), ("long", "long", "string", "long"), strict=True)]
    seeds = flow.where("seeds IS NOT NULL").select("unit", *whole, "pos", F.inline("seeds")).distinct()
    known = new = checkpointed(seeds.select(*PATH))
    inner = ["entry", "e_cell", "e_val", "e_prod"]
    waits, told = None, None
    for _ in range(most_rounds):
        made = checkpointed(_made(new, steps, transfer))
        stepped = made.where(F.col("to").isNull() & (F.col("ends").isNull() | (F.col("entry") == MAIN))).select(*PATH[:5], F.explode("after").alias("pos"), "cell", "val", "prod")
        # out of a struct: a union of plans in which a column stands twice can't be checkpointed
        both = F.struct(F.col("to").alias("entry"), F.col("cell").alias("e_cell"), F.col("val").alias("e_val"), F.col("prod").alias("e_prod"), F.col("to").alias("pos"), "cell", "val", "prod")
        entered = made.where("to IS NOT NULL").select("unit", F.inline(F.array(both)))
        outer = [F.col(c).alias(f"o_{c}") for c in inner]
        wait = made.where("to IS NOT NULL AND back IS NOT NULL").select("unit", F.col("to").alias("entry"), F.col("cell").alias("e_cell"), F.col("val").alias("e_val"), F.col("prod").alias("e_prod"), *outer, "back").distinct()
        tell = made.where(F.col("to").isNull() & F.col("ends") & (F.col("entry") != MAIN)).select("unit", *inner, "cell", "val", "prod").distinct()
        all_waits = wait if waits is None else waits.unionByName(wait)
        key = ["unit", *inner]
        back = lambda w, t: w.join(t, key).select("unit", *(F.col(f"o_{c}").alias(c) for c in inner), F.col("back").alias("pos"), "cell", "val", "prod")
        returned = back(all_waits, tell) if told is None else back(all_waits, tell).unionByName(back(wait, told))
        every = stepped.unionByName(entered).unionByName(returned).select(*PATH).distinct()
        new = checkpointed(every.join(known, PATH, "left_anti"))
        if new.isEmpty():
            return known
        known = checkpointed(known.unionByName(new))
        waits = checkpointed(all_waits.distinct())
        told = checkpointed(tell if told is None else told.unionByName(tell).distinct())
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")


def activations(blocks: DataFrame, edges: DataFrame, called: DataFrame, ends: DataFrame, seeds: DataFrame, transfer: Transfer, group: int = GROUP, most_rounds: int = 100_000) -> DataFrame:
    """unit, entry, e_cell, e_val, e_prod, pos, cell, val, prod: the facts at blocks of each activation (entry -1: the unit's own, of any entry fact).

    edges: unit, src, dst between blocks; called: unit, pos, to, back; ends: unit, pos; seeds: unit, pos, cell, val, prod.
    """
    flow = _flow(blocks, edges, called, ends, seeds)
    large = checkpointed(blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("unit"))
    if large.isEmpty():
        return by_unit(flow, _alone(transfer), _OUT)
    return by_unit(flow.join(large, "unit", "left_anti"), _alone(transfer), _OUT).unionByName(_joined(flow.join(large, "unit", "left_semi"), transfer, most_rounds))


def _of(blocks: DataFrame, group: int) -> DataFrame:
    seeds = _entry(blocks, (REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(CELLS)))
    return activations(blocks, _inside(cfg.edges(blocks)), calls(blocks), exits(blocks), seeds, VALUES, group)


def values(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, cell, val, producer_pos: values at a block's entry on ways whose calls and returns match."""
    found = _of(blocks, group).where(F.col("cell") != REACHED)
    return found.select("unit", "pos", "cell", "val", F.col("prod").alias("producer_pos")).distinct()


def reach(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, entry, pos: the blocks that each entered procedure (-1: the unit) reaches."""
    return _of(blocks, group).where(F.col("cell") == REACHED).select("unit", "entry", "pos").distinct()


def exit_summaries(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, entry, entry_cell, entry_val, cell, val: of entered procedures, the values at exits when a value holds at the entry (cell -1: entered at all)."""
    held = _of(blocks, group).where(F.col("entry") != MAIN)
    ends = blocks.join(exits(blocks), ["unit", "pos"], "left_semi").join(calls(blocks), ["unit", "pos"], "left_anti")
    met = held.withColumnsRenamed({"cell": "f_cell", "val": "f_val", "prod": "f_prod"}).join(ends, ["unit", "pos"])
    return met.select("unit", "entry", F.col("e_cell").alias("entry_cell"), F.col("e_val").alias("entry_val"), F.inline(VALUES.joined())).drop("prod").distinct()


def unique_contexts(blocks: DataFrame, group: int = GROUP, most_rounds: int = 100_000) -> DataFrame:
    """unit, pos, callers: the calls (innermost last, joined by /) of blocks that are reached in one context alone, and null where there are more.

    A lattice of none, one and many instead of counted stacks: a procedure has one
    context if one call alone enters it, from one activation that has one itself.
    Nothing is followed that is entered twice, so rows and rounds are linear.
    """
    reached = checkpointed(reach(blocks, group))
    sites = reached.join(calls(blocks).select("unit", "pos", "to"), ["unit", "pos"])
    once = sites.groupBy("unit", "to").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("entry", "pos")).alias("from")).where("n = 1")
    once = checkpointed(once.select("unit", F.col("to").alias("entry"), F.col("from.entry").alias("outer"), F.col("from.pos").alias("site")))
    known = new = reached.where(F.col("entry") == MAIN).select("unit", "entry", F.lit("").alias("callers")).distinct()
    for _ in range(most_rounds):
        found = once.join(new.withColumnRenamed("entry", "outer"), ["unit", "outer"])
        new = checkpointed(found.select("unit", "entry", F.concat("callers", F.lit("/"), F.col("site").cast("string")).alias("callers")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    else:
        raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
    held = reached.join(known, ["unit", "entry"], "left")
    # a block of one activation alone has that activation's context
    return held.groupBy("unit", "pos").agg(F.when(F.count(F.lit(1)) == 1, F.max("callers")).alias("callers"))
