"""Benchmark decontamination by an FM-index of each training shard.

A shard is some megabytes of a partition's documents. Its words become numbers
of the benchmark's vocabulary; runs of such words that could hold a window are
indexed (Burrows-Wheeler transform, wavelet-tree ranks, sampled suffix
positions), all windows of the benchmark are searched backward at once, their
occurrences located, and the spans merged into the words to remove. Nothing is
shuffled: the documents stay where they are read.

The benchmark is the stated query set. It goes out in blocks of bounded bytes,
each collected and broadcast by itself, and a task has one block in memory at a
time, so it may be of any size.

Defined results: null text and null benchmark text have no words; an item of
fewer than `width` words is one window, one of none is none; repeated items
count once; the windows of an item without an id are hit, but it is not
counted; repeated rows are judged each; empty tables give empty results (an
empty benchmark: nothing is hit); a text of any length is searched whole (a
shard of its own). Words are told apart by their bytes. Extra columns of any
name pass through `decontaminate`; `contamination` doesn't read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.batches import pieces, runs
from tidegraph.llm.common import parallel
from tidegraph.llm.fm_index import FMIndex

#: Letters A-Z in lower case; digits, letters and all of other scripts as they are; a space for the rest.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words(NamedTuple):
    """Words of some texts as numbers of a vocabulary (0: not in it), and the first word of each text (and the end)."""

    ids: np.ndarray
    first: np.ndarray


def split(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's words start and end."""
    return runs(np.frombuffer(text.translate(_FOLD), np.uint8) != 32)


def words_of(lists: list[list[bytes]], vocabulary: dict[bytes, int]) -> Words:
    first = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=first[1:])
    return Words(np.fromiter(map(vocabulary.get, chain.from_iterable(lists), repeat(0)), np.int64, first[-1]), first)


class Block(NamedTuple):
    """Windows of some items: vocabulary (words by their bytes, from 1), windows by width, and each window's items."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[tuple[np.ndarray, np.ndarray]]
    names: list[str | None]


def block_of(rows: list[tuple[object, str | None]], width: int) -> Block:
    """The windows of rows (id, text)."""
    names = sorted({str(i) for i, _ in rows if i is not None})
    number = {x: i for i, x in enumerate(names)}
    lists = [split((t or "").encode()) for _, t in rows]
    vocabulary = {x: i for i, x in enumerate(sorted(set(chain.from_iterable(lists))), 1)}
    w = words_of(lists, vocabulary)
    by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, (name, _) in enumerate(rows):
        own = w.ids[w.first[k] : w.first[k + 1]]
        if len(own):
            n = min(width, len(own))
            by_width.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(own, n), -1 if name is None else number[str(name)]))
    windows, items = [], []
    for n in sorted(by_width):
        distinct, back = np.unique(np.concatenate([x for x, _ in by_width[n]]), axis=0, return_inverse=True)
        owner = np.repeat([i for _, i in by_width[n]], [len(x) for x, _ in by_width[n]])
        pair = np.unique(np.stack([back.ravel(), owner], 1), axis=0)
        windows.append(distinct)
        items.append((np.searchsorted(pair[:, 0], np.arange(len(distinct) + 1)), pair[:, 1]))
    return Block(vocabulary, windows, items, names)


def search(w: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and the pairs (text, item) by number."""
    hit, none = np.zeros(len(w.ids), bool), np.zeros((0, 2), np.int64)
    if not block.vocabulary or not len(w.ids):
        return hit, none
    known = w.ids > 0
    # a run ends with its text: an edge of known words, or a text's first word
    broken = np.flatnonzero(known[1:] != known[:-1]) + 1
    cuts = np.unique(np.concatenate([[0], broken, w.first[w.first < len(known)]]))
    sizes = np.diff(np.append(cuts, len(known)))
    worth = known[cuts] & (sizes >= min(x.shape[1] for x in block.windows))
    begin, sizes = cuts[worth], sizes[worth]
    if not len(begin):
        return hit, none
    # words of the runs, a zero after each
    to = np.cumsum(sizes + 1)
    place = np.arange(to[-1]) - np.repeat(to - sizes - 1, sizes + 1) + np.repeat(begin, sizes + 1)
    text = w.ids[np.minimum(place, len(w.ids) - 1)]
    text[to - 1] = 0
    index = FMIndex(text, len(block.vocabulary) + 1)
    pairs = [none]
    cover = np.zeros(len(w.ids) + 1, np.int64)
    for windows, (item_at, item) in zip(block.windows, block.items, strict=True):
        low, high = index.search(windows)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        count = (high - low)[found]
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
        word = place[index.locate(rows)]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + windows.shape[1], -1)
        seen = np.unique(np.stack([np.searchsorted(w.first, word, "right") - 1, np.repeat(found, count)], 1), axis=0)
        n = (item_at[1:] - item_at[:-1])[seen[:, 1]]
        of = item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(item_at[seen[:, 1]], n)]
        pairs.append(np.stack([np.repeat(seen[:, 0], n), of], 1))
    return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def benchmark_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """Broadcast blocks of the benchmark (item_id, text), each of about block_bytes of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(n)))
    return [spark.sparkContext.broadcast(block_of([(r[0], r[1]) for r in dealt.where(F.col("block") == i).drop("block").collect()], width)) for i in range(n)]


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    parts: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    held = 0
    for part, own in pieces(batches):
        size = sum(map(len, own))
        if texts and held + size > shard_bytes:
            yield parts, texts
            parts, texts, held = [], [], 0
        parts.append(part)
        texts += own
        held += size
    if texts:
        yield parts, texts


def _marked(texts: list[bytes], blocks: list) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """The first word of each text (and the end), which words are hit, and the items of each text, over all blocks."""
    lists = [split(t) for t in texts]
    first, hit = np.append(0, np.cumsum([len(x) for x in lists])), None
    items: list[list[str]] = [[] for _ in texts]
    for held in blocks:
        block = held.value
        found, pairs = search(words_of(lists, block.vocabulary), block)
        hit = found if hit is None else hit | found
        for text, item in pairs.tolist():
            if item >= 0:
                items[text].append(block.names[item])
        if len(blocks) > 1:
            held.__dict__.pop("_value", None)  # one block in memory at a time
    return first, hit, items


def _shard_size(shard_bytes: int, blocks: list) -> int:
    """With many blocks, shards are larger, so that each block is read less often."""
    return shard_bytes * min(4, len(blocks))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first and last hit word) of each row of docs."""
    blocks = benchmark_blocks(benchmark, width, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, texts in _shards(batches, _shard_size(shard_bytes, blocks)):
            first, hit, items = _marked(texts, blocks)
            hits = np.append(0, np.cumsum(hit))
            n_hit = hits[first[1:]] - hits[first[:-1]]
            spans: list[list[dict]] = [[] for _ in texts]
            for k in np.flatnonzero(n_hit).tolist():
                a, b = runs(hit[first[k] : first[k + 1]])
                spans[k] = [{"first": x, "last": y - 1} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.chunked_array([p.column("doc_id") for p in parts]).combine_chunks(),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                    pa.array(n_hit > 0),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first: long, last: long>>"
    return parallel(docs.select("doc_id", "text")).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with hit spans cut out of their texts; a text of which no word is left goes, others keep their bytes."""
    blocks = benchmark_blocks(benchmark, width, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, texts in _shards(batches, _shard_size(shard_bytes, blocks)):
            word, hit, _ = _marked(texts, blocks)
            hits = np.append(0, np.cumsum(hit))
            n_hit, n = hits[word[1:]] - hits[word[:-1]], np.diff(word)
            gone = (n_hit > 0) & (n_hit == n)
            cut: dict[int, str] = {}
            for k in np.flatnonzero((n_hit > 0) & ~gone).tolist():
                kept, at = [], 0
                starts, ends = places(texts[k])
                first, last = runs(hit[word[k] : word[k + 1]])
                for x, y in zip(first.tolist(), (last - 1).tolist(), strict=True):
                    kept.append(texts[k][at : int(starts[x])])
                    at = int(ends[y])
                cut[k] = b"".join([*kept, texts[k][at:]]).decode("utf-8", "replace")
            done = 0
            for part in parts:
                m = part.num_rows
                changed = [k for k in range(done, done + m) if k in cut]
                if changed:
                    own, i = part.column("text").to_pylist(), part.schema.get_field_index("text")
                    for k in changed:
                        own[k - done] = cut[k]
                    part = part.set_column(i, part.schema.field(i), pa.array(own, part.schema.field(i).type))
                yield part.filter(pa.array(~gone[done : done + m]))
                done += m

    return docs.mapInArrow(run, docs.schema)
