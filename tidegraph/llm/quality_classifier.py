"""Quality classifier: a factorisation machine over hashed words and the text's structure.

Features are hashed words (logarithm of their counts, scaled to length one) and
structure statistics and sizes of the text. Pairwise interactions have low rank
and are scored in linear time: half the sum over factors of (sum v x) squared
minus sum of (v x) squared.

Training is data-parallel: labelled documents become sparse features once;
in each round every partition takes an epoch of adaptive gradient steps from
the shared parameters, and their average (by rows) starts the next round. Only
parameters pass through the driver. Labelled rows are bounded by `most`, taken
by a hash of their ids, so that their ids may be broadcast.

Defined results: null and empty texts are scored by bias and size alone;
labels without a document or without a value are left out; a document labelled
twice counts twice; without any labels every score is 0.5; a score of exactly
`least` (a tie) is predicted 1; texts of any length count whole; repeated rows
are scored each; an empty table gives an empty result. Only doc_id and text are
read, so extra columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.batches import byte_class, joined, pieces, runs, span_hashes
from tidegraph.llm.common import checkpointed, parallel

BITS, FACTORS = 14, 4
_WORD = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>~^_=+@\\")
_UPPER = byte_class(lambda b: 65 <= b <= 90)
_DIGIT = byte_class(lambda b: 48 <= b <= 57)
_MARK = byte_class(lambda b: chr(b) in "!?.,;:")
_LOUD = byte_class(lambda b: chr(b) in "!?")
STATISTICS = 12
#: Rows of a gradient step, and the least steps of a partition in a round.
BATCH, STEPS = 32, 60
SIZE = (1 << BITS) + STATISTICS


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def start(seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    return Model(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each begins (and the end), feature numbers, values."""
    n = len(texts)
    data, at = joined(texts)
    starts, ends = runs(_WORD[data])
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    pair, times = np.unique((doc << BITS) | (words & np.uint64((1 << BITS) - 1)).astype(np.int64), return_counts=True)
    row, value = pair >> BITS, np.log1p(times).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm[row], 1e-6).astype(np.float32)
    size = np.maximum(np.diff(at) - 1, 0)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask[data], dtype=np.int64))[at]) if len(data) else np.zeros(n, np.int64)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    wide = np.maximum(size, 1)
    loud = np.zeros(len(words), bool)
    if len(words):
        loud = np.isin(data[ends - 1], np.frombuffer(b"!?#*$%&|", np.uint8))
    per_word = lambda mask: np.bincount(doc, mask, n) / np.maximum(count, 1)
    dense = np.stack(
        [
            np.sqrt(sums(_SYMBOL) / wide),
            np.sqrt(sums(_UPPER) / wide),
            np.sqrt(sums(_DIGIT) / wide),
            np.sqrt(sums(_MARK) / wide),
            np.sqrt(sums(_LOUD) / wide),
            per_word(again),
            per_word(loud),
            np.bincount(row, minlength=n) / np.maximum(count, 1),
            np.bincount(doc, ends - starts, n) / np.maximum(count, 1) / 10,
            np.log1p(count) / 10,
            np.log1p(size) / 12,
            (count > 0).astype(float),
        ],
        1,
    ).astype(np.float32)
    row = np.concatenate([row, np.repeat(np.arange(n), STATISTICS)])
    feature = np.concatenate([pair & ((1 << BITS) - 1), np.tile(np.arange(1 << BITS, SIZE), n)])
    value = np.concatenate([value, dense.ravel()])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(n + 1)), feature[order].astype(np.int32), value[order]


def raw_scores(model: Model, begin: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and each row's sums of v x."""
    vx = model.factors[feature] * value[:, None]
    sums = np.add.reduceat(vx, begin[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(1), begin[:-1])
    linear = np.add.reduceat(model.linear[feature] * value, begin[:-1])
    return model.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def epoch(model: Model, rows: list[tuple[np.ndarray, np.ndarray, float]], rate: float, batch: int = BATCH, decay: float = 1e-5) -> Model:
    """One pass of AdaGrad over rows (features, values, label)."""
    bias, linear, factors = model.bias, model.linear.copy(), model.factors.copy()
    seen, seen_linear, seen_factors = 1e-2, np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32)
    for at in range(0, len(rows), batch):
        some = rows[at : at + batch]
        sizes = [len(f) for f, _, _ in some]
        begin = np.append(0, np.cumsum(sizes))
        feature, value = np.concatenate([f for f, _, _ in some]), np.concatenate([v for _, v, _ in some])
        score, sums = raw_scores(Model(bias, linear, factors), begin, feature, value)
        wrong = (logistic(score) - np.array([y for _, _, y in some])).astype(np.float32)
        each = np.repeat(wrong, sizes)
        used, back = np.unique(feature, return_inverse=True)
        g = np.bincount(back, each * value, len(used)).astype(np.float32) / len(some) + decay * linear[used]
        own = factors[feature]
        slope = (each * value)[:, None] * (np.repeat(sums, sizes, axis=0) - own * value[:, None])
        h = np.stack([np.bincount(back, slope[:, k], len(used)) for k in range(FACTORS)], 1).astype(np.float32) / len(some) + decay * factors[used]
        seen_linear[used] += g * g
        seen_factors[used] += h * h
        linear[used] -= rate * g / np.sqrt(seen_linear[used])
        factors[used] -= rate * 0.3 * h / np.sqrt(seen_factors[used])
        b = float(wrong.mean())
        seen += b * b
        bias -= rate * b / seen**0.5
    return Model(bias, linear, factors)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, rounds: int = 6, parts: int = 6) -> Model:
    """A model of labels.quality, learnt from at most `most` labelled rows that aren't held out."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)
    rows = parallel(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")  # at most `most` pairs of numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            begin, feature, value = features_of(texts)
            cut = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), pa.array([feature[a:b].tobytes() for a, b in cut]), pa.array([value[a:b].tobytes() for a, b in cut])], ["doc_id", "label", "feature", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sparse = rows.mapInArrow(features, f"doc_id {kind}, label double, feature binary, value binary")
    dealt = checkpointed(sparse.repartition(parts, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "label"))
    sc = docs.sparkSession.sparkContext
    model = start()
    for number in range(rounds):
        shared = sc.broadcast(tuple(model))

        def local(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            held = []
            for b in batches:
                for f, v, y in zip(*(b.column(c).to_pylist() for c in ("feature", "value", "label")), strict=True):
                    held.append((np.frombuffer(f, np.int32), np.frombuffer(v, np.float32), y))
            if held:
                rng, out = np.random.default_rng(number), Model(*shared.value)
                for _ in range(max(1, -(-STEPS * BATCH // len(held)))):  # few rows are gone through more often
                    out = epoch(out, [held[i] for i in rng.permutation(len(held))], 0.3 / (1 + number) ** 0.5)
                yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([out.bias]), pa.array([out.linear.tobytes()]), pa.array([out.factors.tobytes()])], ["n", "bias", "linear", "factors"])

        learnt = dealt.mapInArrow(local, "n long, bias double, linear binary, factors binary").collect()  # a row of parameters a partition
        if not learnt:
            return model
        total = sum(r["n"] for r in learnt)
        mean = lambda name, shape: sum(np.frombuffer(r[name], np.float32) * np.float32(r["n"] / total) for r in learnt).reshape(shape)
        model = Model(sum(r["bias"] * r["n"] / total for r in learnt), mean("linear", -1), mean("factors", (SIZE, FACTORS)))
        shared.unpersist()
    return model


def scores(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Model(*shared.value)
        for part, texts in pieces(batches):
            score, _ = raw_scores(given, *features_of(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(logistic(score.astype(np.float64)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = parallel(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
