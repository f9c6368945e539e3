"""Quality rules: base limits, then robust outliers of each language and source.

Every document becomes a vector of transformed statistics. For each group of
language and source the minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps from two deterministic starts (medians
and quartiles; mean and scatter of all vectors). A step takes the h
vectors nearest under the last estimate: distances are put into fine logarithmic
bins, the lowest bins are taken whole and the bin at the border by the weight
that makes up exactly h, and their weighted sums give the next estimate. A start
goes on while its determinant falls; of a group's starts the one with the least
determinant judges. A step is one aggregate of a narrow table of vectors, so a
group of any size is only ever summed up. A document is rejected if its squared
Mahalanobis distance exceeds the cut-off.

All of it is column expressions; texts are read once and never shuffled, but
where a table has fewer partitions than there are cores.

Documents that fail the base limits have no part in the estimates and do not
count. Groups of fewer than `least` others (five for each statistic by default)
are judged by the estimate of all documents of their language, languages of
fewer by that of the whole corpus; only if the corpus itself falls short is
nothing rejected by the method.

Defined results: null text has no words and fails the base; a text of any length
is measured whole; null languages and sources are values of their own; equal
distances share the weight of their bin, and a distance at the cut-off is kept;
repeated rows count each; each row is kept or not by its own verdict, whatever
its id; an empty table gives an empty result; a constant statistic keeps the
least scatter of `FLOORS`. Extra columns of any name pass through `kept`;
`judged` doesn't read them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import WORD, as_row, checkpointed, from_row, spread

#: Group tables of up to so many rows are broadcast (about 300 bytes a row).
BROADCAST_GROUPS = 20_000
#: Least scatter of each statistic: what of it says nothing about quality.
FLOORS = (0.04, 0.06, 0.06, 0.12, 0.15)
D = len(FLOORS)
#: Bins for each doubling of the squared distance.
_FINE = 64


def chi_square(x: float, d: int) -> float:
    """P(chi-square with d degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, half = d / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = 1
    while abs(term) > 1e-17 * total and k < 10_000:
        term *= half / (a + k)
        total += term
        k += 1
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, d) < p else (low, middle)
    return high


def statistics(docs: DataFrame, width: int = 5) -> DataFrame:
    """row (docs' columns), lang, source and _words, _chars, _symbols, _upper, _lines, _dup_lines, _repeats of their texts."""
    docs = as_row(docs, F.col("lang"), F.col("source"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_list": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_held": lines})
    out = out.withColumns(
        {
            "_words": F.size("_list").cast("long"),
            "_chars": F.length(F.array_join("_list", "")).cast("long"),
            "_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "_lines": F.size("_held").cast("long"),
            "_dup_lines": (F.size("_held") - F.size(F.array_distinct("_held"))).cast("long"),
        }
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_list") - width), lambda i: F.xxhash64(*(F.get("_list", i + k) for k in range(width))))
    out = out.withColumn("_hashes", F.when(F.size("_list") >= width, windows).otherwise(F.array().cast("array<long>")))
    # documents in which no window comes twice, nearly all, stop here
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get("_sorted", j)["h"] == F.get("_sorted", k)["h"]
    repeated = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    out = out.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(repeated, lambda j: F.get("_sorted", j)["i"]))))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_at") - 1),
        F.lit(0).cast("long"),
        lambda n, j: n + F.least(F.lit(width), F.coalesce(F.get("_at", j + 1) - F.get("_at", j), F.lit(width))).cast("long"),
    )
    return out.withColumn("_repeats", F.when(F.col("_at").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_text", "_list", "_held", "_hashes", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("_words") < 10) | (100 * F.col("_repeats") > 20 * F.col("_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; the constants keep short texts near the middle."""
    ratio = lambda n, of, more: F.sqrt(F.col(n) / (F.col(of) + more))
    return {
        "_x0": ratio("_symbols", "_chars", 40),
        "_x1": ratio("_upper", "_chars", 40),
        "_x2": F.log((F.col("_chars") + 60) / (F.col("_words") + 12)),
        "_x3": ratio("_repeats", "_words", 20),
        "_x4": ratio("_dup_lines", "_lines", 5),
    }


def _grouped(rows: DataFrame, least: int) -> tuple[DataFrame, bool]:
    """rows with _group, whose estimate judges them, and _uses, the groups whose estimates they are part of; and whether groups are few enough to broadcast."""
    sizes = checkpointed(rows.groupBy("lang", "source").agg(F.count_if(~F.col("_failed")).alias("_n")))
    lang, every = Window.partitionBy("lang"), Window.partitionBy()
    sizes = sizes.withColumn("_lang_n", F.sum("_n").over(lang)).withColumn("_all_n", F.sum("_n").over(every))
    sizes = sizes.withColumn("_level", F.when(F.col("_n") >= least, 0).when(F.col("_lang_n") >= least, 1).when(F.col("_all_n") >= least, 2))
    used = lambda level, over: F.max(F.coalesce(F.col("_level") == level, F.lit(False))).over(over)
    sizes = sizes.withColumn("_lang_used", used(1, lang)).withColumn("_all_used", used(2, every))
    key = lambda level, *cols: F.to_json(F.struct(F.lit(level).alias("level"), *cols))
    keys = key(0, "lang", "source"), key(1, "lang"), key(2)
    group = F.when(F.col("_level") == 0, keys[0]).when(F.col("_level") == 1, keys[1]).when(F.col("_level") == 2, keys[2])
    uses = F.array_compact(F.array(F.when(F.col("_level") == 0, keys[0]), F.when(F.col("_lang_used"), keys[1]), F.when(F.col("_all_used"), keys[2])))
    of = checkpointed(sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), group.alias("_group"), uses.alias("_uses")))
    few = of.count() <= BROADCAST_GROUPS
    met = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(F.broadcast(of) if few else of, met, "left").drop("_lang", "_source"), few


_KEYS = ("_group", "_start")
_MOMENTS = [f"s{i}" for i in range(D)] + [f"p{i}{k}" for i in range(D) for k in range(i, D)]


def _moments(weight: Column, x: list[Column]) -> list[Column]:
    """Weighted sums of a vector and of its products, by the names of _MOMENTS."""
    return [F.sum(weight).alias("n"), *(F.sum(weight * x[i]).alias(f"s{i}") for i in range(D)), *(F.sum(weight * x[i] * x[k]).alias(f"p{i}{k}") for i in range(D) for k in range(i, D))]


def _joined(rows: DataFrame, estimates: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(estimates) if few else estimates, "_group", how)


def _started(rows: DataFrame) -> DataFrame:
    """Estimates to start from: medians with quartiles, and all vectors."""
    x = [F.col(f"_x{i}") for i in range(D)]
    quartiles = [F.percentile_approx(x[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(D)]
    sums = checkpointed(rows.groupBy("_group").agg(*quartiles, *_moments(F.lit(1.0), x)))
    spread_of = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(D)]
    medians = sums.select("_group", F.lit(0).alias("_start"), *(F.col(f"q{i}")[1].alias(f"_m{i}") for i in range(D)), *((1 / spread_of[i] if i == k else F.lit(0.0)).alias(f"_l{i}{k}") for i in range(D) for k in range(i + 1)), F.lit(float("inf")).alias("_det"))
    return medians.unionByName(_estimated(sums.withColumn("_start", F.lit(1)), 1.0).withColumn("_det", F.lit(float("inf"))))


def _distance() -> Column:
    y = [sum((F.col(f"_l{i}{k}") * (F.col(f"_x{k}") - F.col(f"_m{k}")) for k in range(i + 1)), F.lit(0.0)) for i in range(D)]
    return sum((v * v for v in y), F.lit(0.0))


def _estimated(sums: DataFrame, share: float) -> DataFrame:
    """Centre, inverse of the Cholesky factor of the scatter and logarithm of its determinant, from weighted sums of `share` of a group."""
    larger = share / chi_square(chi_quantile(share, D), D + 2) if share < 1 else 1.0  # so that normal data keep their scatter
    out = sums.withColumns({f"_m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)})
    out = out.withColumns({f"c{i}{k}": (F.col(f"p{i}{k}") / F.col("n") - F.col(f"_m{i}") * F.col(f"_m{k}")) * F.lit(larger) + F.lit(FLOORS[i] ** 2 if i == k else 0.0) for i in range(D) for k in range(i, D)})
    for k in range(D):  # the factor column by column, its inverse row by row
        rest = {i: F.col(f"c{k}{i}") - sum((F.col(f"g{i}{j}") * F.col(f"g{k}{j}") for j in range(k)), F.lit(0.0)) for i in range(k, D)}
        out = out.withColumn(f"g{k}{k}", F.sqrt(F.greatest(rest[k], F.lit(FLOORS[k] ** 2 / 4))))
        out = out.withColumns({f"g{i}{k}": rest[i] / F.col(f"g{k}{k}") for i in range(k + 1, D)}) if k + 1 < D else out
    for i in range(D):
        inner = {k: sum((F.col(f"g{i}{j}") * F.col(f"_l{j}{k}") for j in range(k, i)), F.lit(0.0)) for k in range(i)}
        out = out.withColumns({f"_l{i}{i}": 1 / F.col(f"g{i}{i}"), **{f"_l{i}{k}": -inner[k] / F.col(f"g{i}{i}") for k in range(i)}})
    det = 2 * sum((F.log(F.col(f"g{i}{i}")) for i in range(1, D)), F.log("g00"))
    return out.select(*_KEYS, *(f"_m{i}" for i in range(D)), *(f"_l{i}{k}" for i in range(D) for k in range(i + 1)), det.alias("_det"))


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float, few: bool) -> DataFrame:
    """The next estimates: of the h nearest vectors of each group, the bin at the border by its part of the weight."""
    binned = _joined(rows, estimates, few, "inner").withColumn("_bin", F.floor(F.log2(_distance() + 1e-6) * _FINE))
    bins = binned.groupBy(*_KEYS, "_bin").agg(*_moments(F.lit(1.0), [F.col(f"_x{i}") for i in range(D)]))
    below = Window.partitionBy(*_KEYS).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    h = F.ceil(F.sum("n").over(Window.partitionBy(*_KEYS)) * F.lit(share))
    kept = bins.withColumn("_weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (h - F.coalesce(F.sum("n").over(below), F.lit(0.0))) / F.col("n"))))
    return _estimated(kept.groupBy(*_KEYS).agg(*(F.sum(F.col("_weight") * F.col(n)).alias(n) for n in ("n", *_MOMENTS))), share)


def robust(sound: DataFrame, share: float = 0.6, steps: int = 6, few: bool = True) -> DataFrame:
    """The minimum-covariance-determinant estimate of each _group of sound (_group, _x0, _x1, ...): centre and inverse factor.

    few: whether the groups' estimates may be broadcast.
    """
    best = checkpointed(_started(sound).withColumn("_fell", F.lit(True)))
    columns = [c for c in best.columns if c not in (*_KEYS, "_det", "_fell")]
    for _ in range(steps):  # only starts whose determinant fell go on
        after = _concentrated(sound, best.where("_fell").drop("_fell"), share, few)
        both = best.select(*_KEYS, "_det", *columns, F.col("_det").alias("_before")).unionByName(after.withColumn("_before", F.lit(None).cast("double")))
        least = both.groupBy(*_KEYS).agg(F.min(F.struct("_det", *columns)).alias("e"), F.min("_before").alias("_before"))
        best = checkpointed(least.select(*_KEYS, "e.*", (F.col("e._det") < F.col("_before") - 1e-6).alias("_fell")))
        if best.where("_fell").isEmpty():
            break
    least = best.groupBy("_group").agg(F.min(F.struct("_det", "_start", *columns)).alias("e"))
    return least.select("_group", *(F.col(f"e.{c}").alias(c) for c in columns))


def _verdicts(measured: DataFrame, share: float = 0.6, steps: int = 6, cut: float = 1e-8, least: int = 5 * D) -> DataFrame:
    """measured (rows with their statistics) with _failed, _distance (null without an estimate) and _kept.

    cut: the part of normal data that may be rejected.
    """
    rows, few = _grouped(checkpointed(measured.withColumn("_failed", base_failed()).withColumns(vector())), least)
    sound = checkpointed(rows.where(~F.col("_failed")).select(F.explode("_uses").alias("_group"), *(f"_x{i}" for i in range(D))))
    out = _joined(rows.drop("_uses"), checkpointed(robust(sound, share, steps, few)), few, "left").withColumn("_distance", _distance())
    kept = ~F.col("_failed") & F.coalesce(F.col("_distance") <= F.lit(chi_quantile(1 - cut, D)), F.lit(True))
    return out.withColumn("_kept", kept)


def judged(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, the statistics, _failed, _distance, _group (whose estimate it was) and _kept of each row of docs (doc_id, text, lang, source)."""
    measured = statistics(spread(docs.select("doc_id", "text", "lang", "source"))).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    return _verdicts(measured, **settings)


def kept(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows that the rules reject, each by its own verdict; texts are held in a checkpoint instead of joined again."""
    return from_row(_verdicts(statistics(spread(docs)), **settings).where("_kept"), docs.columns)
