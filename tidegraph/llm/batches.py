"""Arrow batches in bounded pieces, and hashes of the words of a whole piece at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy pass takes; a longer text is a piece of its own.
PIECE = 1 << 20

_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in pieces of about limit bytes, each with its column as bytes; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "").cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, PIECE + PIECE // 2), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 4 * PIECE:
            _powers[base] = known
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit number for each byte, so that a word's polynomial isn't one in small coefficients.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]: differences of one running polynomial.

    For features, where words may collide; they do not tell words apart.
    """
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * _power(_ODD, n)[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every width consecutive numbers, which have to be random themselves; none if there are fewer."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(_ODD, n)[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _power(_INVERSE, n)[: n - width + 1])


def byte_class(members: Callable[[int], bool]) -> np.ndarray:
    return np.array([members(b) for b in range(256)])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, each followed by a separator, and where each starts (and the end)."""
    data = np.frombuffer(between.join([*texts, b""]), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(between) for t in texts], out=at[1:])
    return data, at
