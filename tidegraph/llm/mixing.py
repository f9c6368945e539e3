"""Mixing sources to target weights: floor(rate) copies and one Bernoulli copy.

One aggregate gives the tokens of each source; the total is shared out over that
small table (a row a source) by weight under a limit on repetition; every
document then takes floor(rate) copies and one more where a hash of its id falls
under the rate's fraction. Documents are never shuffled: the source table is
broadcast after its size is checked, and joined by Spark's own choice beyond
that. Ranks and running sums over sources go by ranges, so that there may be as
many sources as web hosts.

Defined results: null text has size 0; a text of any length is counted whole; a
null source is a source of its own, ordered last; a source whose size is 0 has
target 0 and rate 0; repeated rows with one id draw the same number, so they are
taken together; rows without an id draw by their text and their place in the
table as it is read; an empty table gives an empty result. Extra columns of any
name pass through `emit` unchanged; `mix` doesn't read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import as_row, checkpointed, from_row, n_words, running, spread

#: Source tables of up to so many rows are broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) made of 48 bits of a digest of key and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def source_targets(sized: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """A row per source: source, source_size, target, rate.

    sized has source and size. Sources by code point take the weights in turn
    and share the total; none gets over limit times its size, and what is over
    goes to the rest by weight. That is the level L at which targets
    min(limit * size, L * weight) add up to the total: by rising
    limit * size / weight, L is that of the first source it doesn't exceed.
    """
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    capped = (
        ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(limit))
        .withColumn("bound", F.col("cap") / F.col("weight"))
    )
    below = checkpointed(running(capped, [F.col("bound"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")}))
    total, weight = below.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total).cast("long") - F.col("caps")) / (F.lit(weight).cast("long") - F.col("weights"))
    lowest = below.withColumn("level", level).agg(F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "level")))["level"]).first()[0]
    share = F.lit(lowest).cast("double")
    target = F.when(F.col("bound") < share, F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share * F.col("weight")))
    return below.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _copies(docs: DataFrame, weights: tuple[int, ...], limit: int, seed: int) -> DataFrame:
    """row (docs' columns), size, source_size, target and copies of each document."""
    docs = spread(docs)
    words = n_words(F.col("text"))
    targets = checkpointed(source_targets(docs.select("source", words.alias("size")), weights, limit))
    sources = targets.select(F.col("source").alias("of"), "source_size", "target", "rate")
    if targets.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    nameless = F.concat(F.lit("without id:"), F.md5(F.coalesce("text", F.lit(""))), F.lit(":"), F.monotonically_increasing_id())
    key = F.coalesce(F.col("doc_id").cast("string"), nameless)
    sized = as_row(docs, F.col("source"), words.alias("size"), draw(key, seed).alias("drawn"))
    joined = sized.join(sources, F.col("source").eqNullSafe(F.col("of")), "inner")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + F.when(F.col("drawn") < F.col("rate") - whole, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 20260101) -> DataFrame:
    """doc_id, size, source_size, target and copies, how often the document is taken, of each row of docs (doc_id, text, source)."""
    return _copies(docs.select("doc_id", "text", "source"), weights, limit, seed).select("row.doc_id", "size", "source_size", "target", "copies")


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: int = 20260101) -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' columns."""
    taken = _copies(docs, weights, limit, seed).where("copies > 0")
    return from_row(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)
