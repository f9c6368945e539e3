"""How the sources of a language differ in their words, exactly: sparse pairs with a baseline, and radix selection of the largest differences.

Terms are counted inside tasks, by language and source, and go out as partial
counts; documents are not shuffled. A group's smoothed rate of a kept term is
p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V)), so all terms that a
source lacks have one rate, its baseline.

Pairs: if all V terms had their baselines, two sources would differ by
V * |base - base'|. Terms of one source alone correct that by
|p - base'| - |base - base'|, summed over its distinct rates; terms of both
correct it once more, where the sources meet by term. So work grows with the
terms that sources have, never with V for each pair.

Terms: a group's `most` largest values are found by their bits. A pass counts,
for each group, how many of the values that agree with the threshold so far
have each next digit (of eleven bits), and takes the digit in which the
`most`-th largest lies. Values equal to the threshold are told apart by the
bytes of their items in the same way: each pass skips what all candidates of a
group share and counts their next two bytes. No group is ever sorted or held
in one task; only rows up to the limit are ranked.

Defined results: null texts have no terms, and null languages and sources are
'' ; a group without terms still has a baseline, and pairs; without kept terms
a language's pairs have 0 and there are no terms; repeated rows count each,
also as documents; ties of values go by the UTF-8 bytes of the item; texts of
any length count whole; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.batches import pieces
from tidegraph.llm.common import checkpointed, parallel

#: Bytes of terms stay, A-Z are lowered, all others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms that a task holds before it sends its counts.
HELD = 400_000
#: Bits of a digit.
DIGIT = 11
#: Groups up to which thresholds are broadcast.
BROADCAST_GROUPS = 20_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), in parts; a row with a null term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, within) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [[lang] * len(some), [source] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [n[t] for t in some], [within[t] for t in some]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((lang, source, None, 0, 0), _COUNTS, strict=True)], schema=_COUNTS)
            counts.clear()

        for part, texts in pieces(batches):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
                n, within = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                terms = text.translate(_TERM).split()
                held -= len(n)
                n.update(terms)
                within.update(set(terms))
                held += len(n)
            if held > HELD:
                yield from sent()
                held = 0
        yield from sent()

    return parallel(docs.select("lang", "source", "text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _rate(n: Column, total: Column, kept: Column, scale: int, add: int) -> Column:
    """1 + floor(scale * (n + add) / (total + add * kept)), in decimals: products pass 64 bits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(scale)) * wide(n + add), wide(total + add * kept))


def _near(df: DataFrame) -> DataFrame:
    """A written table of groups, broadcast while it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def audit(docs: DataFrame, least_docs: int = 30, most: int = 50, scale: int = 1_000_000_000, add: int = 5) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of docs (text, lang, source)."""
    counts = checkpointed(partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.where("term IS NULL").select("lang", "source")
    words = counts.where("term IS NOT NULL")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = checkpointed(words.drop("docs").join(vocabulary.drop("docs"), ["lang", "term"]))
    # every kept term occurs in its language, so both counts of a language can be taken from its groups' rows
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    sizes = groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    some = F.col("kept") > 0
    sizes = checkpointed(sizes.withColumn("base", F.when(some, _rate(F.lit(0), F.col("total"), F.col("kept"), scale, add)).otherwise(F.lit(0))))
    rated = kept.join(_near(sizes), ["lang", "source"]).select(
        "lang", "source", "term", _rate(F.col("n"), F.col("total"), F.col("kept"), scale, add).alias("p"), _rate(F.col("all"), F.col("lang_total"), F.col("kept"), scale, add).alias("q")
    )
    rated = checkpointed(rated)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs(rated, sizes).withColumnRenamed("other", "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    above = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = largest(checkpointed(above), ["lang", "source"], most)
    return pair.unionByName(term.withColumn("part", F.lit("term")).select("lang", "source", "part", "item", "value", "rank"))


def pairs(rated: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, other, value: the sum of |p - q| over all kept terms, for every two sources of a language.

    rated: lang, source, term, p of the terms that a source has; sizes: lang, source, kept (terms of the language), base.
    """
    small = sizes.select("lang", "source", "kept", "base")
    other = _near(small.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base")))
    apart = F.abs(F.col("base") - F.col("other_base"))
    lacking = small.join(other, "lang").where("source <> other").select("lang", "source", "other", (F.col("kept") * apart).alias("value"))
    # what the terms of one source add where the other has its baseline: by distinct rates, in both directions
    rates = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).join(_near(small), ["lang", "source"])
    alone = rates.join(other, "lang").where("source <> other").select("lang", "source", "other", (F.col("m") * (F.abs(F.col("p") - F.col("other_base")) - apart)).alias("value"))
    alone = alone.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    # what is wrong with that where both have the term
    based = rated.join(_near(small), ["lang", "source"]).select("lang", "term", "source", "p", "base")
    second = based.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("base").alias("other_base"))
    over = F.abs(F.col("p") - F.col("q")) + apart - F.abs(F.col("p") - F.col("other_base")) - F.abs(F.col("q") - F.col("base"))
    met = based.join(second, ["lang", "term"]).where("source < other").select("lang", "source", "other", over.alias("value"))
    met = met.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    every = lacking.unionByName(alone).unionByName(turned(alone)).unionByName(met).unionByName(turned(met))
    return every.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def _taken(bins: DataFrame, group: list[str], order: Column) -> DataFrame:
    """For each group, the bin in which the row that is still wanted lies: group, bin, wanted (from that bin), n (rows in it)."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = bins.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ahead.where("ahead < wanted AND ahead + n >= wanted").select(*group, "bin", (F.col("wanted") - F.col("ahead")).alias("wanted"), "n")


def thresholds(rows: DataFrame, group: list[str], most: int, digit: int = DIGIT) -> DataFrame:
    """Each group's most-th largest value (its smallest, if it has fewer): group, threshold, wanted (rows to take of those equal to it), n (rows equal).

    rows: group, value (0 or more), written already. A pass a digit, from the largest.
    """
    top = rows.agg(F.max("value")).first()[0] or 0
    places = range((max(top.bit_length(), 1) - 1) // digit * digit, -1, -digit)
    state = None
    for place in places:
        part = F.shiftright("value", place)
        if state is None:
            open_rows = rows.select(*group, part.alias("bin"))
            counted = open_rows.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
            whole = Window.partitionBy(*group)
            bins = counted.withColumn("wanted", F.least(F.lit(most), F.sum("n").over(whole)))
        else:
            agree = rows.join(_near(state.select(*group, "threshold", "wanted")), group).where(F.shiftright("value", place + digit) == F.col("threshold"))
            bins = agree.groupBy(*group, part.alias("bin"), "wanted").agg(F.count(F.lit(1)).alias("n"))
        state = checkpointed(_taken(bins, group, F.desc("bin")).withColumnRenamed("bin", "threshold"))
    return state


def largest(rows: DataFrame, group: list[str], most: int, digit: int = DIGIT) -> DataFrame:
    """group, item, value, rank of each group's most largest values, equal ones by their items' bytes.

    rows: group, item (distinct in a group), value (0 or more), written already.
    """
    cut = thresholds(rows, group, most, digit)
    near = _near(cut)
    above = rows.join(near, group).where("value > threshold").select(*group, "item", "value")
    equal = rows.join(near, group).where("value = threshold").select(*group, "item", "value", "wanted", "n")
    taken = above.unionByName(equal.where("wanted = n").select(*group, "item", "value"))
    tied = checkpointed(equal.where("wanted < n").select(*group, "item", "value", "wanted"))
    while not tied.isEmpty():
        settled, tied = refined(tied, group)
        taken = taken.unionByName(settled)
    rank = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return taken.withColumn("rank", F.row_number().over(rank))


def refined(tied: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass over tied rows (group, item, value, wanted: fewer than a group has): those settled as taken, and those still tied.

    What all items of a group share is skipped: the beginning that the smallest and the largest have in common.
    """
    raw = F.col("item").cast("binary")
    ends = tied.groupBy(*group).agg(F.min("item").alias("low"), F.max("item").alias("high"))
    ends = ends.select(*group, shared(F.col("low"), F.col("high")).alias("skip"))
    placed = tied.join(_near(checkpointed(ends)), group).withColumn("bin", F.hex(F.substring(raw, F.col("skip") + 1, F.lit(2))))
    bins = placed.groupBy(*group, "bin", "wanted").agg(F.count(F.lit(1)).alias("n"))
    cut = checkpointed(_taken(bins, group, F.col("bin")).select(*group, F.col("bin").alias("at"), F.col("wanted").alias("rest"), "n"))
    told = checkpointed(placed.join(_near(cut), group))
    settled = told.where("bin < at OR (bin = at AND rest = n)").select(*group, "item", "value")
    return settled, told.where("bin = at AND rest < n").select(*group, "item", "value", F.col("rest").alias("wanted"))


def shared(a: Column, b: Column) -> Column:
    """How many bytes two texts begin with in common, by halving (up to 2 GB)."""
    x, y = a.cast("binary"), b.cast("binary")
    at = F.lit(0)
    return F.aggregate(
        F.array(*(F.lit(1 << k) for k in range(30, -1, -1))),
        at,
        lambda n, step: F.when((n + step <= F.least(F.octet_length(a), F.octet_length(b))) & (F.substring(x, n + 1, step) == F.substring(y, n + 1, step)), n + step).otherwise(n),
    )
