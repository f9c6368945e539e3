"""Checkpoints in the folder that all executors share, and what loops over them have in common."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of nodes that are broadcast at most.
SMALL = 100_000
#: Pieces that are kept before they become one.
PIECES = 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the session's checkpoint folder, its lineage cut; where none is set, one in the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go when it has run; else they stay until the driver's garbage is collected. For loops that keep checkpoints only."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Span(NamedTuple):
    """How many rows a column has, how many of them are null, and its smallest and largest value."""

    rows: int
    nulls: int
    low: Any
    high: Any

    def meets(self, other: Span) -> bool:
        """Whether both may have a value, or a null, in common."""
        return bool(self.nulls and other.nulls) or (self.low is not None and other.low is not None and self.low <= other.high and other.low <= self.high)


def span(df: DataFrame, column: str) -> Span:
    return Span(*df.agg(F.count(F.lit(1)), F.count(F.when(F.col(column).isNull(), 1)), F.min(column), F.max(column)).first())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows; known so before a plan, its other side isn't shuffled."""
    return F.broadcast(df) if rows <= SMALL else df


class Pieces:
    """What a loop has found about nodes, a checkpoint a round, each with its nodes' span: a round reads those that can matter to it."""

    def __init__(self) -> None:
        self._held: list[tuple[DataFrame, Span]] = []

    def add(self, piece: DataFrame) -> Span:
        self._held.append((piece, found := span(piece, "node")))
        if len(self._held) > PIECES:
            whole = checkpointed(reduce(DataFrame.unionByName, (x for x, _ in self._held)).coalesce(max(x.rdd.getNumPartitions() for x, _ in self._held)))
            self._held = [(whole, span(whole, "node"))]
        return found

    def meeting(self, *spans: Span | None) -> DataFrame | None:
        """The pieces that meet one of the spans; those without rows don't; None where there are none."""
        at = [(x, s) for x, s in self._held if any(y is not None and y.rows and s.meets(y) for y in spans)]
        return small(reduce(DataFrame.unionByName, (x for x, _ in at)), sum(s.rows for _, s in at)) if at else None

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (x for x, _ in self._held))
