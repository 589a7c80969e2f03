"""Vectorised text helpers that run inside Arrow tasks on bounded slices of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Known:
    """A bounded map from 64-bit hashes to numbers, as sorted arrays: 16 bytes an entry, whatever it has seen.

    The first `most` hashes are kept (frequent ones come early); from then on it does not change.
    """

    def __init__(self, most: int):
        self.most = most
        self.keys, self.values = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> int:
        """Adds new, distinct, sorted keys as far as there is room; returns how many."""
        n = max(0, min(len(keys), self.most - len(self.keys)))
        if n:
            at = np.searchsorted(self.keys, keys[:n])
            self.keys, self.values = np.insert(self.keys, at, keys[:n]), np.insert(self.values, at, values[:n])
        return n


def _table(fold_case: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        t = mix(np.arange(1, 257, dtype=U64) * _BASE)
    if fold_case:
        t[65:91] = t[97:123]
    return t


FOLDED, PLAIN = _table(True), _table(False)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"], _powers["down"]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums for `span_hash`; values are 64-bit codes of the symbols."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans [start, end)."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * _STEP)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `limit` bytes of text, or one row if that is longer."""
    text = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0))
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of each (nulls are empty)."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that do not cross texts: their starts and ends, and per text its first and past-last run."""
    if not len(inside):
        zero = np.zeros(len(offsets) - 1, dtype=np.int64)
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), zero, zero
    cuts = offsets[offsets < len(inside)]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    edges = np.searchsorted(starts, offsets)
    return starts, ends, edges[:-1], edges[1:]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: hashes with A-Z folded, and per text the first and past-last word."""
    starts, ends, first, last = spans(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    return (span_hash(rolling(FOLDED[data]), starts, ends) if len(starts) else np.zeros(0, dtype=U64)), first, last


def shingles(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles (a shorter non-empty text is one shingle), and the number per text."""
    n = last - first
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), counts)
    at = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    reach = np.minimum(n[row], width)
    out = reach.astype(U64) * _BASE
    odd = U64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            odd = odd * _STEP
            inside = k < reach
            if inside.all():
                out += hashes[at + k] * odd
            else:
                out[inside] += hashes[at[inside] + k] * odd
    return mix(out), counts
