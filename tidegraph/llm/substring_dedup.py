"""Removal of passages repeated across documents: a count-min prefilter, then exact grouping.

Documents are packed into chunks (some megabytes, compressed), written once to
the checkpoint folder. A window of `width` words is known by its hash, whose
high bits name a shard. First pass: every chunk sends to each shard the cells
its distinct windows have in the shard's count-min sketch, as sorted and packed
lists; a shard adds the chunks' sketches up and answers with a bit for each
cell sent: whether its count is two or more. A window is estimated repeated if
all its cells are, which no window of two chunks can fail. Second pass: chunks
send those windows alone, by 128 bits of hash and with the smallest document
they have them in; the shard groups them by all these bits and answers, a bit
each, which of them a smaller document elsewhere has. Windows within a
chunk are compared there, by the same bits.

However often a window comes, a chunk sends it once, so no key is hot; the
sketch is spread over shards of equal size instead of being broadcast. A chunk
sends a message to each shard that it has windows of: chunks times shards of
them, though never more than there are windows; at 100 TB both sizes have to be
raised.

Defined results: null and empty texts have no words; texts of fewer than
`width` words lose none; a text of any length is a chunk of its own at most;
repeated rows with one id do not remove each other's words, as neither has a
smaller id; a null id counts as the largest; an empty table gives an empty
result. Ids are integers. Only doc_id and text are read, so extra columns of
any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.batches import pieces, window_hashes
from tidegraph.llm.common import checkpointed, parallel

#: Bits of a cell in each of the sketch's two rows, and of a hash's part that names the shard.
CELL, SHARD = 22, 20
_NONE = np.iinfo(np.int64).max
#: Of the words' hash.
SEED = 0x7469646567726170


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte place, compressed: small numbers cost what they need."""
    import zstandard

    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _risen(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpack(raw, kind), dtype=kind)


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An order by both halves; by the first alone unless it has ties that the second tells apart."""
    order = np.argsort(high)
    a, b = high[order], low[order]
    return np.lexsort((low, high)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


class Chunk:
    """The windows of a chunk's documents, told apart by 128 bits of hash.

    Each word has 128 bits of a hash of its bytes, and a window's halves are
    made of its words' first and second halves.
    """

    def __init__(self, blob: bytes, width: int):
        from xxhash import xxh3_128_digest

        self.width = width
        batch = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()
        self.part = batch[0]
        self.words = [t.split() for t in self.part.column("text").to_pylist()]
        n = np.array([len(w) for w in self.words], np.int64)
        self.first = np.append(0, np.cumsum(n))
        self.n_words = int(self.first[-1])
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(self.words)))}
        halves = np.frombuffer(b"".join([xxh3_128_digest(w, SEED) for w in number]), np.uint64).reshape(-1, 2)
        of = np.fromiter(map(number.__getitem__, chain.from_iterable(self.words)), np.int64, self.n_words)
        ids = self.part.column("doc_id").cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)
        self.at = np.flatnonzero(np.arange(self.n_words) + width <= np.repeat(self.first[1:], n))  # windows inside a document
        high, low = (window_hashes(halves[of, k], width)[self.at] if len(self.at) else np.zeros(0, np.uint64) for k in range(2))
        order = _order(high, low)
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        #: Both halves of the distinct windows' hashes, in order.
        self.high, self.low = high[order][new], low[order][new]
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.of = np.repeat(ids, n)[self.at]
        self.least = np.full(len(self.high), _NONE)
        np.minimum.at(self.least, self.back, self.of)

    def shards(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The shards that the distinct windows fall into, and where each begins (and the end)."""
        shard = ((self.high >> np.uint64(64 - SHARD)) * np.uint64(n)) >> np.uint64(SHARD)
        found, begin = np.unique(shard, return_index=True)
        return found.astype(np.int64), np.append(begin, len(shard))

    def cells(self, row: int) -> np.ndarray:
        return ((self.high >> np.uint64(CELL * row)) & np.uint64((1 << CELL) - 1)).astype(np.uint32)

    def asked(self, n: int, answers: list[dict] | None) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The distinct windows estimated repeated, by number, and the part of them that each shard is asked about."""
        shards, begin = self.shards(n)
        said = {x["shard"]: x["answer"] for x in answers or ()}
        repeated = np.ones(len(self.high), bool)
        for row in range(2):
            cells = self.cells(row)
            for s, shard in enumerate(shards.tolist()):
                a, b = begin[s], begin[s + 1]
                half = len(said[shard]) // 2
                bits = np.unpackbits(np.frombuffer(said[shard], np.uint8)[half * row : half * (row + 1)], count=b - a).astype(bool)
                repeated[a:b][np.argsort(cells[a:b], kind="stable")[~bits]] = False
        which = np.flatnonzero(repeated)
        cut = np.searchsorted(which, begin)
        return which, [(shard, slice(cut[s], cut[s + 1])) for s, shard in enumerate(shards.tolist()) if cut[s] < cut[s + 1]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chunks(docs: DataFrame, width: int, chunk_bytes: int) -> DataFrame:
    """chunk, blob, n (words at most) of docs in the order they are read."""
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part, texts in pieces(batches, limit=chunk_bytes):
            held = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(held)
            blob = out.getvalue().to_pybytes()
            yield _batch([(np.uint64(xxh64_intdigest(blob)).view(np.int64).item(), blob, sum(map(len, texts)) // 4)], schema)

    made = checkpointed(parallel(docs.select("doc_id", "text")).mapInArrow(run, "chunk long, blob binary, n long"))
    return made


def _answered(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """chunks with all answers to each, as an array of that name."""
    return chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(name)), "chunk", "left")


def _estimated(chunks: DataFrame, width: int, n: int) -> DataFrame:
    """chunk, shard, answer: for each of the sketch's rows, bits of the cells sent whose counts are two or more."""
    sent = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("row0", pa.binary()), ("row1", pa.binary())])
    told = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                chunk = Chunk(blob, width)
                shards, begin = chunk.shards(n)
                rows = [chunk.cells(r) for r in range(2)]
                for lo in range(0, len(shards), 512):
                    some = range(lo, min(lo + 512, len(shards)))
                    yield _batch([(int(shards[s]), name, *(_rising(np.sort(c[begin[s] : begin[s + 1]])) for c in rows)) for s in some], sent)

    def add_up(table: pa.Table) -> pa.Table:
        answers = []
        for row in ("row0", "row1"):
            lists = [_risen(x, np.uint32) for x in table.column(row).to_pylist()]
            counts = np.bincount(np.concatenate(lists), minlength=1)
            answers.append([np.packbits(counts[x] >= 2).tobytes() for x in lists])
        rows = list(zip(table.column("chunk").to_pylist(), table.column("shard").to_pylist(), (a + b for a, b in zip(*answers, strict=True)), strict=True))
        return pa.Table.from_batches([_batch(rows, told)])

    return chunks.select("chunk", "blob").mapInArrow(send, "shard long, chunk long, row0 binary, row1 binary").groupBy("shard").applyInArrow(add_up, "chunk long, shard long, answer binary")


def _matched(asked: DataFrame, width: int, n: int) -> DataFrame:
    """chunk, shard, answer: a bit for each window asked about, whether a smaller document has it."""
    sent = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary())])
    told = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "blob", "estimates")), strict=True):
                chunk = Chunk(blob, width)
                which, parts = chunk.asked(n, answers)
                for lo in range(0, len(parts), 512):
                    rows = [(shard, name, _rising(chunk.high[own]), _pack(chunk.low[own]), _pack(chunk.least[own])) for shard, own in ((shard, which[part]) for shard, part in parts[lo : lo + 512])]
                    yield _batch(rows, sent)

    def group(table: pa.Table) -> pa.Table:
        first = [_risen(x, np.uint64) for x in table.column("first").to_pylist()]
        second = np.concatenate([_unpack(x, np.uint64) for x in table.column("second").to_pylist()])
        least = np.concatenate([_unpack(x, np.int64) for x in table.column("least").to_pylist()])
        sizes, whole = [len(x) for x in first], np.concatenate(first)
        order = _order(whole, second)
        new = np.append(True, (whole[order][1:] != whole[order][:-1]) | (second[order][1:] != second[order][:-1]))
        smallest = np.empty(len(whole), np.int64)
        smallest[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        elsewhere, at, rows = smallest < least, 0, []
        for name, shard, size in zip(table.column("chunk").to_pylist(), table.column("shard").to_pylist(), sizes, strict=True):
            flagged = elsewhere[at : at + size]
            at += size
            if flagged.any():
                rows.append((name, shard, np.packbits(flagged).tobytes()))
        return pa.Table.from_batches([_batch(rows, told)])

    return asked.mapInArrow(send, "shard long, chunk long, first binary, second binary, least binary").groupBy("shard").applyInArrow(group, "chunk long, shard long, answer binary")


def without_repeats(docs: DataFrame, width: int = 13, chunk_bytes: int = 4 << 20, shard_windows: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by spaces) for each row of docs."""
    chunks = _chunks(docs, width, chunk_bytes)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    n = min(int(total // shard_windows) + 1, 1 << SHARD)
    asked = _answered(chunks.select("chunk", "blob"), _estimated(chunks, width, n), "estimates")
    found = _answered(asked, _matched(asked, width, n), "answers")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, estimates, answers in zip(*(batch.column(c).to_pylist() for c in ("blob", "estimates", "answers")), strict=True):
                chunk = Chunk(blob, width)
                elsewhere = np.zeros(len(chunk.high), bool)
                which, parts = chunk.asked(n, estimates)
                said = {x["shard"]: x["answer"] for x in answers or ()}
                for shard, part in parts:
                    if shard in said:
                        elsewhere[which[part]] = np.unpackbits(np.frombuffer(said[shard], np.uint8), count=part.stop - part.start)
                gone = elsewhere[chunk.back] | (chunk.least[chunk.back] < chunk.of)
                cover = np.zeros(chunk.n_words + 1, np.int64)
                np.add.at(cover, chunk.at[gone], 1)
                np.add.at(cover, chunk.at[gone] + width, -1)
                removed = np.cumsum(cover[:-1]) > 0
                sums = np.append(0, np.cumsum(removed))
                kept = []
                for k, words in enumerate(chunk.words):
                    mine = slice(chunk.first[k], chunk.first[k + 1])
                    kept.append(b" ".join(words if not removed[mine].any() else [w for w, r in zip(words, removed[mine].tolist(), strict=True) if not r]))
                yield pa.RecordBatch.from_arrays(
                    [chunk.part.column("doc_id"), pa.array(np.diff(chunk.first), pa.int64()), pa.array(np.diff(sums[chunk.first]), pa.int64()), pa.array([sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "replace") for x in kept])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
