"""Definitions by byte: ranges that strong writes cut, and writes that only may happen.

A base is a run of bytes, and a definition holds for ranges of it. A write
that must happen takes its own range out of every other definition of the
base, of which up to two pieces are left over; one that may happen takes nothing
away, and holds beside what was there. A write to an unknown place may change
every byte of every base. Pieces are facts of the one fixpoint; since ways cut
them differently, the result joins a definition's pieces into its longest ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import cfg
from tidegraph.operators.dataflow import CELLS, REACHED, _entry, _inside
from tidegraph.operators.fixpoint import GROUP, Transfer, fact, solve
from tidegraph.operators.storage import coalesced, writes
from tidegraph.sources.programs import HAVOC

#: Bytes of a base in the event encoding.
SIZE = 32
MUST, MAY, ANYWHERE = "must", "may", "anywhere"


def strength(blocks: DataFrame) -> DataFrame:
    """unit, pos, strength: literals and copies are written for sure, unknown values perhaps, with numbers above 90 perhaps anywhere."""
    return blocks.select("unit", "pos", F.when(F.col("action") != HAVOC, MUST).when(F.col("k") > 90, ANYWHERE).otherwise(MAY).alias("strength"))


def _marked(blocks: DataFrame) -> DataFrame:
    """Blocks whose literal tells the range and strength of what they write."""
    ranges = writes(blocks).select("unit", "pos", "start", "end")
    met = blocks.join(ranges, ["unit", "pos"]).join(strength(blocks), ["unit", "pos"])
    return met.withColumn("literal", F.concat_ws(":", "start", "end", "strength"))


def _pieces(start: int, end: int, cut_start: int, cut_end: int) -> list[tuple[int, int]]:
    """What is left of a range outside of another."""
    return [(a, b) for a, b in ((start, min(end, cut_start)), (max(start, cut_end), end)) if a < b]


def _alone(block: dict, held: tuple) -> list:
    start, end, how = block["literal"].split(":")
    if held[0] == REACHED:
        if how == ANYWHERE:
            return [held, *((base, f"0:{SIZE}", block["pos"]) for base in range(CELLS))]
        return [held, (block["cell"], f"{start}:{end}", block["pos"])]
    if held[0] != block["cell"] or how != MUST:
        return [held]
    a, b = held[1].split(":")
    return [(held[0], f"{x}:{y}", held[2]) for x, y in _pieces(int(a), int(b), int(start), int(end))]


def _joined() -> Column:
    own = fact(F.col("f_cell"), F.col("f_val"), F.col("f_prod"))
    number = lambda c, i: F.split(c, ":").getItem(i).cast("long")
    start, end, how = number("literal", 0), number("literal", 1), F.split("literal", ":").getItem(2)
    a, b = (F.when(F.col("f_cell") != REACHED, number("f_val", i)) for i in (0, 1))
    piece = lambda x, y: F.when(x < y, fact(F.col("f_cell"), F.concat_ws(":", x, y), F.col("f_prod")))
    every = F.array(*(fact(F.lit(c), F.lit(f"0:{SIZE}"), F.col("pos")) for c in range(CELLS)))
    new = F.when(how == ANYWHERE, every).otherwise(F.array(fact(F.col("cell"), F.concat_ws(":", start, end), F.col("pos"))))
    cut = F.array_compact(F.array(piece(a, F.least(b, start)), piece(F.greatest(a, end), b)))
    return F.when(F.col("f_cell") == REACHED, F.concat(F.array(own), new)).when((F.col("f_cell") != F.col("cell")) | (how != MUST), F.array(own)).otherwise(cut)


WRITES = Transfer(_alone, _joined)


def pieces(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, base, start, end, def_pos: ranges in which a definition (-1: the entry's) holds at a block's entry, as ways have cut them."""
    seeds = _entry(blocks, (REACHED, "", -1), *((c, f"0:{SIZE}", -1) for c in range(CELLS)))
    found = solve(_marked(blocks), _inside(cfg.edges(blocks)), seeds, WRITES, group).where(F.col("cell") != REACHED)
    at = F.split("val", ":")
    return found.select("unit", "pos", F.col("cell").alias("base"), at.getItem(0).cast("long").alias("start"), at.getItem(1).cast("long").alias("end"), F.col("prod").alias("def_pos"))


def byte_definitions(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, base, start, end, def_pos, strength: the longest ranges of each definition at a block's entry, and how it writes (the entry: must)."""
    keys = ["unit", "pos", "base", "def_pos"]
    whole = coalesced(pieces(blocks, group), keys)
    how = strength(blocks).withColumnRenamed("pos", "def_pos")
    return whole.join(how, ["unit", "def_pos"], "left").select(*keys, "start", "end", F.coalesce("strength", F.lit(MUST)).alias("strength"))


def surely_written(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """unit, pos, base, n: bytes of a base that were written on every way to a block, as the entry's own definition holds there no more."""
    every = pieces(blocks, group)
    left = coalesced(every.where("def_pos = -1"), ["unit", "pos", "base"]).groupBy("unit", "pos", "base").agg(F.sum(F.col("end") - F.col("start")).alias("held"))
    met = every.select("unit", "pos", "base").distinct().join(left, ["unit", "pos", "base"], "left")
    return met.select("unit", "pos", "base", (F.lit(SIZE) - F.coalesce("held", F.lit(0))).cast("long").alias("n")).where("n > 0")
