"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import checkpointed


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's higher neighbours are tied to its lowest neighbour (or to itself)."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    low = _lowest(both).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lower neighbours are tied to the lowest of them; repeated ties are left out."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = down.join(_lowest(down), "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (lowest node of its component) for every node of edges (u, v) but the roots.

    Every round is written to the checkpoint folder, so a lost executor costs
    no more than the round under way. Only two numbers a round reach the driver.
    """
    state = checkpointed(_small_star(checkpointed(edges.select("u", "v").distinct())))
    seen = None
    for _ in range(most_rounds):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        state = checkpointed(_small_star(_large_star(state)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
