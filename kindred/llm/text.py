"""Whole Arrow batches of texts as numpy arrays: words, word hashes, shingle and window hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All hashes are 64-bit polynomials modulo
2**64 over the bytes (then over the words), finished by a mixing permutation. Work goes in slices of
whole documents of about SLICE bytes, so temporaries stay in the cache; one longer document is a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes outside letters, where bytes over 0x7F count as letters.
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False
_BASE = U(0x9E3779B97F4A7C15 | 1)


class _Cache(dict):
    """A dict that travels to workers empty."""

    def __reduce__(self):
        return _Cache, ()


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = _Cache()


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, min(SLICE + (SLICE >> 2), 1 << (n - 1).bit_length()))
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, U(base)), np.full(size, U(inverse))
        up[0] = down[0] = 1
        _tables[base] = have = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return have[0][:n], have[1][:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """The words of a run of documents.

    data: the bytes; starts, ends: of the words in data; first: index of each document's first word,
    with the number of words at the end; lo: index of the run's first document in its batch.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lo: int, letters: bool = False):
        self.data, self.lo, self.n_docs = data, lo, len(bounds) - 1
        n = len(data)
        solid = ~(_OTHER if letters else _SPACE)[data]
        before = np.ones(n + 1, bool)
        before[1:] = ~solid
        after = np.ones(n + 1, bool)
        after[:n] = ~solid
        inner = bounds[1:-1]
        cut = np.zeros(n + 1, bool)
        cut[inner] = True
        self.starts = np.flatnonzero(solid & (before[:n] | cut[:n]))
        self.ends = np.flatnonzero(solid & (after[1:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """One 64-bit hash per word; another salt, another hash function."""
        h = spans(self.data, self.starts, self.ends, int(_BASE) + 2 * (salt + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        return mix(h + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """Document k's words, those of a mask of its own words if given, joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        raw = self.data[s[0] : e[-1]].tobytes()
        if keep is None and len(raw) == int((e - s).sum()) + len(s) - 1 and raw.count(b" ") == len(s) - 1:
            return raw
        at = int(s[0])
        return b" ".join([raw[i - at : j - at] for i, j in zip(s.tolist(), e.tolist(), strict=True)])


def large_binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """UTF-8 bytes of a column of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.cast(pa.large_binary())
    return out.fill_null(b"") if out.null_count else out


def runs(column: pa.Array, lower: bool = False, letters: bool = False, limit: int = SLICE) -> Iterator[Words]:
    """The words of a batch, in runs of whole documents; lower: A-Z as a-z; letters: words are runs of letters."""
    arr = large_binary(column)
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        yield Words(_LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo], lo, letters)
        lo = hi


def grams(w: Words, h: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one document, and the index of their first words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    fits = np.ones(len(h), bool)
    for j in range(1, k):
        back = w.first[1:] - j
        fits[back[back >= w.first[:-1]]] = False
    at = np.flatnonzero(fits[:n])
    g = spans(h, at, at + k, int(_BASE) + 2 * (salt + 77) * 0x2545F4914F6CDD1D & (1 << 64) - 1 | 1)
    return mix(g), at


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
