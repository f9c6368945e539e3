"""The dataflow analyses, each a transfer and its seeds over the one fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import cfg
from tidegraph.operators.fixpoint import GROUP, Transfer, budgeted, fact, solve
from tidegraph.sources.programs import COPY, LITERAL

#: The cell of the fact that a block is reached, and the value of anything.
REACHED, UNKNOWN = -1, "?"
CELLS = 4

_own = lambda: fact(F.col("f_cell"), F.col("f_val"), F.col("f_prod"))


def _inside(edges: DataFrame) -> DataFrame:
    return edges.where("dst >= 0").select("unit", "src", "dst").distinct()


def _entry(blocks: DataFrame, *facts: tuple[int, str, int]) -> DataFrame:
    every = F.array(*(fact(F.lit(c), F.lit(v), F.lit(p)) for c, v, p in facts))
    return blocks.where("pos = 0").select("unit", "pos", F.inline(every))


REACH = Transfer(lambda block, held: (held,), lambda: F.array(_own()))


def reach(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos of blocks that the entry reaches."""
    found = solve(blocks, _inside(cfg.edges(blocks)), _entry(blocks, (REACHED, "", -1)), REACH, group)
    return found.select("unit", "pos")


def reverse_reach(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos of blocks from which a return or halt is reached."""
    edges = cfg.edges(blocks)
    ends = edges.where("dst < 0").select("unit", F.col("src").alias("pos")).distinct()
    seeds = ends.select("unit", "pos", F.lit(REACHED).cast("long").alias("cell"), F.lit("").alias("val"), F.lit(-1).cast("long").alias("prod"))
    turned = _inside(edges).select("unit", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return solve(blocks, turned, seeds, REACH, group).select("unit", "pos")


def _defined(block: dict, held: tuple) -> list:
    if held[0] == REACHED:
        return [held, (block["cell"], "", block["pos"])]
    return [] if held[0] == block["cell"] else [held]


DEFINITIONS = Transfer(
    _defined,
    lambda: F.when(F.col("f_cell") == REACHED, F.array(_own(), fact(F.col("cell"), F.lit(""), F.col("pos")))).otherwise(F.when(F.col("f_cell") != F.col("cell"), F.array(_own())).otherwise(F.array().cast("array<struct<cell:bigint,val:string,prod:bigint>>"))),
)


def reaching_definitions(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, cell, def_pos: writes that hold at a block's entry; -1 is the entry's own."""
    seeds = _entry(blocks, (REACHED, "", -1), *((c, "", -1) for c in range(CELLS)))
    found = solve(blocks, _inside(cfg.edges(blocks)), seeds, DEFINITIONS, group)
    return found.where(F.col("cell") != REACHED).select("unit", "pos", "cell", F.col("prod").alias("def_pos"))


def _valued(block: dict, held: tuple) -> list:
    out = []
    if held[0] == REACHED:
        out.append(held)
        if block["action"] != COPY:
            out.append((block["cell"], block["literal"] if block["action"] == LITERAL else UNKNOWN, block["pos"]))
    else:
        if held[0] != block["cell"]:
            out.append(held)
        if block["action"] == COPY and held[0] == block["source"]:
            out.append((block["cell"], held[1], held[2]))
    return out


_new = lambda: fact(F.col("cell"), F.when(F.col("action") == LITERAL, F.col("literal")).otherwise(UNKNOWN), F.col("pos"))
VALUES = Transfer(
    _valued,
    lambda: F.array_compact(
        F.array(
            F.when((F.col("f_cell") == REACHED) | (F.col("f_cell") != F.col("cell")), _own()),
            F.when((F.col("f_cell") == REACHED) & (F.col("action") != COPY), _new()),
            F.when((F.col("f_cell") == F.col("source")) & (F.col("action") == COPY), fact(F.col("cell"), F.col("f_val"), F.col("f_prod"))),
        )
    ),
)


def value_support(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, cell, val, producer_pos: values at a block's entry with the block that made them; -1 is the entry."""
    seeds = _entry(blocks, (REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(CELLS)))
    found = solve(blocks, _inside(cfg.edges(blocks)), seeds, VALUES, group)
    return found.where(F.col("cell") != REACHED).select("unit", "pos", "cell", "val", F.col("prod").alias("producer_pos"))


def _forgotten(block: dict, held: tuple) -> list:
    return [(c, v, -1) for c, v, _ in _valued(block, held)]


PLAIN_VALUES = Transfer(_forgotten, lambda: F.transform(VALUES.joined(), lambda x: x.withField("prod", F.lit(-1).cast("long"))))


def possible_values(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, cell, val: values that a cell may have at a block's entry; '?' stands for any."""
    seeds = _entry(blocks, (REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(CELLS)))
    found = solve(blocks, _inside(cfg.edges(blocks)), seeds, PLAIN_VALUES, group)
    return found.where(F.col("cell") != REACHED).select("unit", "pos", "cell", "val")


def candidates(values: DataFrame) -> DataFrame:
    """unit, pos, cell, n, open, vals (sorted, joined by |): each reached cell's closed candidates and whether there may be others."""
    known = F.collect_set(F.when(F.col("val") != UNKNOWN, F.col("val")))
    return values.groupBy("unit", "pos", "cell").agg(F.size(known).cast("long").alias("n"), F.bool_or(F.col("val") == UNKNOWN).alias("open"), F.array_join(F.array_sort(known), "|").alias("vals"))


def budgeted_candidates(blocks: DataFrame, rounds: int) -> DataFrame:
    """unit, pos, cell, n, open, limited, vals: candidates as far as so many steps find them; those of units with more to find are open."""
    seeds = _entry(blocks, (REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(CELLS)))
    found = budgeted(blocks, _inside(cfg.edges(blocks)), seeds, PLAIN_VALUES, rounds).where(F.col("cell") != REACHED)
    known = F.collect_set(F.when(F.col("val") != UNKNOWN, F.col("val")))
    limited = F.bool_or("limited")
    return found.groupBy("unit", "pos", "cell").agg(
        F.size(known).cast("long").alias("n"), (F.bool_or(F.col("val") == UNKNOWN) | limited).alias("open"), limited.alias("limited"), F.array_join(F.array_sort(known), "|").alias("vals")
    )
