"""Near duplicates by similarity: SimHash fingerprints of 256 bits, whose keys grow with the table.

Texts whose sets of word shingles have a Jaccard similarity s differ in a share
acos(2 s / (1 + s)) / pi of their bits: at 0.8 in 39 of 256, where unrelated texts
differ in 128. A pair is taken for near up to `distance` bits, which is that
mean and some deviations more. 64 bits would leave such pairs no keys to meet by.

The bits are laid on several rings, each in another order, and each ring is cut
into segments. Fingerprints that agree in one segment of one ring meet there.
Segments are as long as the table asks for (a few bits more than its number of
fingerprints has), and there are as many as a pair at the similarity needs
to meet with probability `found`; so a key has few unrelated fingerprints at any size,
at the price of n ** 0.24 keys each. Where fingerprints meet, pigeonring chains prune:
from the segment that agrees on, running differences must stay within their share
of the distance and `slack` bits more (the segment is given, not the best start); what
is left is checked in full. As in `simhash`, only distinct fingerprints meet, and
within a key a search gives a spanning forest instead of pairs. Most keys have one
fingerprint alone: keys travel with hashes of fingerprints first, and the
fingerprints themselves only to the keys that two or more have.

Defined results are those of `simhash`: wordless texts have fingerprint zero, a
text of fewer than `width` words is one shingle, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.batches import mixed, pieces
from tidegraph.llm.common import as_row, checkpointed, from_row, parallel
from tidegraph.llm.simhash import counted_bits, members, shingle_hashes

#: 64-bit words of a fingerprint, and what makes each word's hashes of a shingle's.
WORDS = 4
_SALTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BITS = 64 * WORDS
#: A key is a segment's value, below this bit, and the segment's number.
KEY_AT = 48


class Plan(NamedTuple):
    """Bits of a segment, orders of the bits on each ring, and how many bits may differ."""

    width: int
    rings: list[np.ndarray]
    distance: int
    slack: int

    def keys(self) -> list[tuple[int, int]]:
        """Ring and segment of each key."""
        return [(r, s) for r in range(len(self.rings)) for s in range(BITS // self.width)]


def share(similarity: float) -> float:
    """The share of bits in which texts of this similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def plan(n: int, similarity: float = 0.8, found: float = 0.96, deviations: float = 1.2, slack: int = 6) -> Plan:
    """Keys for n fingerprints."""
    p = share(similarity)
    width = min(48, max(14, math.ceil(math.log2(max(n, 2))) + 3))
    keys = math.ceil(math.log(1 - found) / math.log(1 - (1 - p) ** width))
    order = np.random.default_rng(20260101)
    rings = [order.permutation(BITS) for _ in range(math.ceil(keys / (BITS // width)))]
    return Plan(width, rings, math.floor(BITS * p + deviations * math.sqrt(BITS * p * (1 - p))), slack)


def fingerprints_of(texts: list[bytes], width: int = 5, seed: int = 42) -> np.ndarray:
    """A fingerprint of WORDS numbers for each text, of its distinct shingles."""
    hashes, owner = shingle_hashes(texts, width, seed)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return np.stack([counted_bits(mixed(hashes ^ salt), owner, len(texts)) for salt in _SALTS], axis=1)


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp (32 bytes) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            prints = np.ascontiguousarray(fingerprints_of(texts, width, seed))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in prints], pa.binary())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return parallel(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp binary")


def hashed(fps: np.ndarray) -> np.ndarray:
    """A 64-bit number of each fingerprint; those that collide only meet a key too many."""
    out = np.zeros(len(fps), np.uint64)
    for w in range(WORDS):
        out = mixed(out ^ fps[:, w])
    return out.view(np.int64)


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of BITS zeros and ones for each fingerprint of WORDS numbers."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def parts(fps: np.ndarray, of: Plan) -> np.ndarray:
    """The value of each key's segment, for each fingerprint."""
    bits, weights = _bits(fps).astype(np.float64), 2.0 ** np.arange(of.width)
    return np.concatenate([(bits[:, ring[: BITS // of.width * of.width]].reshape(len(fps), -1, of.width) @ weights) for ring in of.rings], axis=1).astype(np.int64)


def chain_masks(of: Plan, key: int) -> np.ndarray:
    """The bits of each segment of a key's ring, from the key's own on."""
    ring, segment = of.keys()[key]
    count = BITS // of.width
    out = np.zeros((count, WORDS), np.uint64)
    for s in range(count):
        at = (segment + s) % count * of.width
        for b in of.rings[ring][at : at + of.width].tolist():
            out[s, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out


def near(difference: np.ndarray, masks: np.ndarray, of: Plan) -> np.ndarray:
    """Which differences are within the distance: by the chain of segments first, then in full."""
    ok, total = np.ones(len(difference), bool), np.zeros(len(difference), np.int64)
    for length, mask in enumerate(masks[:-1], 1):
        at = np.flatnonzero(ok)
        total[at] += np.bitwise_count(difference[at] & mask).sum(axis=1, dtype=np.int64)
        ok[at] = total[at] <= length * of.distance // len(masks) + of.slack
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(difference[at]).sum(axis=1, dtype=np.int64) <= of.distance
    return ok


def forest(fps: np.ndarray, masks: np.ndarray, of: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one key's fingerprints."""
    out, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = near(at ^ left, masks, of)
            if close.any():
                found, left = left[close], left[~close]
                out.append((np.repeat(at[None], len(found), axis=0), found))
                queue.extend(found)
    return out


def links(fps: DataFrame, of: Plan) -> DataFrame:
    """u, v: enough pairs of near fingerprints that meet under a key to keep all their connections."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    keys = of.keys()

    def read(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = read(batch.column(0).slice(at, 4096))
                values = parts(some, of) | (np.arange(len(keys), dtype=np.int64) << KEY_AT)
                yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(hashed(some), len(keys)))], ["key", "id"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(hashed(read(batch.column(0)))), batch.column(0)], ["id", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        known: dict[int, np.ndarray] = {}

        def found() -> Iterator[pa.RecordBatch]:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            begin, size = np.append(0, edge), np.diff(np.concatenate([[0], edge, [len(key)]]))
            k = key >> KEY_AT
            out = [(fp[:0], fp[:0])]
            for which in np.unique(k[begin[size > 1]]).tolist():
                masks = known[which] if which in known else known.setdefault(which, chain_masks(of, which))
                two = begin[(size == 2) & (k[begin] == which)]
                close = near(fp[two] ^ fp[two + 1], masks, of)
                out.append((fp[two][close], fp[two + 1][close]))
                more = (size > 2) & (k[begin] == which)
                for b, n in zip(begin[more].tolist(), size[more].tolist(), strict=True):
                    out += forest(fp[b : b + n], masks, of)
            u, v = (np.concatenate([x[j] for x in out]) for j in (0, 1))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.ascontiguousarray(w)], pa.binary()) for w in (u, v)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column(0).to_numpy(zero_copy_only=False), read(batch.column(1)))
            changes = np.flatnonzero(new[0][1:] != new[0][:-1])
            if held and held[-1][0][-1] != new[0][0]:
                yield from found()
            if not len(changes):
                held.append(new)
                continue
            cut = int(changes[-1]) + 1  # the last key may go on in the next batch
            held.append(tuple(x[:cut] for x in new))
            yield from found()
            held.append(tuple(x[cut:] for x in new))
        if held:
            yield from found()

    keyed = fps.select("fp").mapInArrow(dealt, "key long, id long")
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("key", "id")
    rows = shared.join(fps.select("fp").mapInArrow(named, "id long, fp binary"), "id").select("key", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(met, "u binary, v binary")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for each row of docs (doc_id, text)."""
    return members(checkpointed(fingerprints(docs, width, seed)), lambda distinct, n: links(distinct, plan(n, similarity)))


def deduplicate(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id.

    Rows without an id stay; rows that repeat an id are one document and stay together.
    """
    found = near_duplicates(docs, similarity, width, seed)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return from_row(as_row(docs, F.col("doc_id")).join(gone, "doc_id", "left_anti"), docs.columns)
