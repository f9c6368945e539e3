"""Near duplicates by SimHash: pigeonring candidates, then Hamming distance, then components.

Fingerprints of 64 bits that differ in at most t bits are cut into t + 1
segments on a ring. By the pigeonring principle some segment starts a chain of
consecutive segments whose running differences stay within floor(l * t / (t+1))
for every length l: the first agrees, the second differs in one bit at most,
the second and third in two at most. With the second and third halved, the
first and two of the four halves therefore agree wholly, and they are not both
halves of the third (from t = 5 on, a fourth segment adds two halves, of which
one more agrees). Each of these five (fourteen) choices from each of the t + 1
starts is a key; fingerprints meet by key, the chain from that start prunes pairs,
and what is left is checked in full. Nothing is missed: a pair within t has
such a start, and meets under one of that start's keys.

Only distinct fingerprints meet, so exact copies cost nothing. Inside a key the
pairs are never emitted: a search through the fingerprints not yet reached
gives a spanning forest, at most one link for each fingerprint, which keeps
every connection. How many distinct fingerprints share a key is bounded by the
bits left free, not by the number of copies.

Defined results: null and wordless texts have fingerprint zero and link like
any other; a text of fewer than `width` words is one shingle; repeated rows
and ties are in one component; a null id is never a component's id (null, if
it is the only id); a text of any length counts whole, with all its shingles; an
empty table gives an empty result. `near_duplicates` reads doc_id and text only,
and extra columns of any name pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.batches import pieces
from tidegraph.llm.common import as_row, checkpointed, from_row, parallel
from tidegraph.llm.components import components

#: For each byte, the bits of its two halves as counters of 16 bits.
_NIBBLE = np.array([sum(((n >> b) & 1) << (16 * b) for b in range(4)) for n in range(16)], np.uint64)
_LOW, _HIGH = _NIBBLE[np.arange(256) & 15], _NIBBLE[np.arange(256) >> 4]
#: Hashes added up in counters of 16 bits at a time.
_BLOCK = 32768
#: A fingerprint is hot from one row in so many on.
SHARES = 1000


def shingle_hashes(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles (of fewer words: the whole text), and the number of the text that each is of."""
    from xxhash import xxh64_intdigest

    raw = b"".join([b" ".join(t.lower().split()) + b"\n" for t in texts])
    data = np.frombuffer(raw, np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10))
    last = np.flatnonzero(data[stops] == 10)  # for each text, its last word
    first = np.append(0, last[:-1] + 1)
    starts = np.append(0, stops[:-1] + 1)
    n = last - first + 1
    empty = starts[first] == stops[first]
    shingles = np.where(empty, 0, np.maximum(n - width + 1, 1))
    begin = np.append(0, np.cumsum(shingles))
    owner = np.repeat(np.arange(len(texts)), shingles)
    word = first[owner] + np.arange(begin[-1]) - begin[owner]
    to = np.minimum(word + width - 1, last[owner])
    return np.fromiter((xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[word].tolist(), stops[to].tolist(), strict=True)), np.uint64, len(word)), owner


def counted_bits(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A number for each of n texts: its bits are set in over half of the text's hashes. owner is in order."""
    if not len(hashes):
        return np.zeros(n, np.uint64)
    shingles = np.bincount(owner, minlength=n)
    starts = np.append(0, np.cumsum(shingles))[:-1][shingles > 0]
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(hashes), _BLOCK)]))
    of = owner[cuts]
    set_bits = np.zeros((n, 64), np.int64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        for half, counters in enumerate((_LOW, _HIGH)):
            sums = np.add.reduceat(counters[columns[:, byte]], cuts)
            for bit in range(4):
                np.add.at(set_bits[:, 8 * byte + 4 * half + bit], of, ((sums >> np.uint64(16 * bit)) & np.uint64(0xFFFF)).astype(np.int64))
    ones = 2 * set_bits > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text's word shingles, of XXH64 hashes, as unsigned numbers."""
    return counted_bits(*shingle_hashes(texts, width, seed), len(texts))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (64 bits as a signed number) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(texts, width, seed).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return parallel(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """Shift and width of distance + 1 segments of 64 bits, in the ring's order."""
    cuts = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(shift: int, width: int) -> int:
    return ((1 << width) - 1) << shift


def key_masks(distance: int) -> list[tuple[int, int]]:
    """Start of the chain and the bits that agree, for each key.

    Of the segments after the first (two, or three for distances above 4, where
    segments are short) the first j together have at most j halves that differ.
    """
    ring = segments(distance)
    after = 2 if distance <= 4 else 3
    if distance < after:
        raise ValueError(f"the distance has to be {after} at least")
    differing = [x for x in combinations(range(2 * after), after) if all(sum(h < 2 * j for h in x) <= j for j in range(1, after))]
    out = []
    for i in range(len(ring)):
        own, *rest = (ring[(i + j) % len(ring)] for j in range(after + 1))
        halves = [(s + (w // 2) * h, w // 2 if not h else w - w // 2) for s, w in rest for h in (0, 1)]
        out += [(i, sum((_bits(*x) for h, x in enumerate(halves) if h not in gone), _bits(*own))) for gone in differing]
    return out


def chain_holds(difference: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether the chain from start keeps each running difference within its share."""
    ring = segments(distance)
    total, ok = np.zeros(difference.shape, np.int64), np.ones(difference.shape, bool)
    for length in range(1, len(ring) + 1):
        total += np.bitwise_count(difference & np.uint64(_bits(*ring[(start + length - 1) % len(ring)])))
        ok &= total <= length * distance // (distance + 1)
    return ok


def close(difference: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Pigeonring test, then the full Hamming check of what it leaves."""
    ok = chain_holds(difference, start, distance)
    ok[ok] = np.bitwise_count(difference[ok]) <= distance
    return ok


def spanning_links(fps: np.ndarray, start: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one key's fingerprints, from reached ones to those not yet reached."""
    links, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = close(left ^ queue[-1], start, distance)
            at = queue.pop()
            if near.any():
                found, left = left[near], left[~near]
                links.append((np.full(len(found), at), found))
                queue.extend(found)
    return links


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """u, v: enough pairs of fingerprints within distance that nothing linked falls apart."""
    masks = key_masks(distance)
    signed = [m - (1 << 64) if m >> 63 else m for _, m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)))
    met = fps.select("fp", F.explode(keys).alias("key")).select("key.k", "key.part", "fp")
    dealt = met.repartition("k", "part").sortWithinPartitions("k", "part", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(k: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1])) + 1
            begin, size = np.append(0, edge), np.diff(np.concatenate([[0], edge, [len(k)]]))
            out = []
            two = begin[size == 2]
            for start in range(distance + 1):
                pair = two[np.array([masks[i][0] for i in k[two].tolist()], np.int64) == start]
                ok = close(fp[pair] ^ fp[pair + 1], start, distance)
                out.append((fp[pair][ok], fp[pair + 1][ok]))
            for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out += spanning_links(fp[b : b + n], masks[int(k[b])][0], distance)
            u, v = (np.concatenate([x[j] for x in out]).view(np.int64) for j in (0, 1))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            k, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            changes = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1]))
            new = (k, part, fp.view(np.uint64))
            if held and (held[-1][0][-1] != k[0] or held[-1][1][-1] != part[0]):
                yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if not len(changes):
                held.append(new)
                continue
            cut = int(changes[-1]) + 1  # the last key may go on in the next batch
            held.append(tuple(x[:cut] for x in new))
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [tuple(x[cut:] for x in new)]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(run, "u long, v long")


def members(printed: DataFrame, linked_by: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of written rows (doc_id, fp); linked_by gives links (u, v) of distinct fingerprints (fp), of which there are so many."""
    distinct = checkpointed(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(linked_by(distinct.select("fp"), distinct.count()))
    linked = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    of = checkpointed(distinct.join(linked.join(least, "root").select("fp", "least"), "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")))
    # at most SHARES fingerprints can have that share of all rows: those are broadcast, the others have no hot key left
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of.where(F.col("n") * SHARES >= total).select("fp", "component_id"))
    rest = of.where(F.col("n") * SHARES < total).select("fp", "component_id")
    every = printed.join(hot, "fp").unionByName(printed.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return every.select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for each row of docs (doc_id, text)."""
    return members(checkpointed(fingerprints(docs, width, seed)), lambda distinct, _: links(distinct, distance))


def deduplicate(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id.

    Rows without an id stay; rows that repeat an id are one document and stay together.
    """
    found = near_duplicates(docs, distance, width, seed)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return from_row(as_row(docs, F.col("doc_id")).join(gone, "doc_id", "left_anti"), docs.columns)
