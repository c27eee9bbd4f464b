"""Array kernels over Arrow text: words, rolling hashes and shingles of whole texts, many documents at a time.

All functions work on slices of a bounded number of bytes (`slices`), so the memory of a Python worker does not follow
the size of an Arrow batch. A single long document makes one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: ASCII letters and digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
SLICE_BYTES = 1_000_000

U = np.uint64
_SEEDS = np.random.default_rng(20240601)
_TABLE = _SEEDS.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_BASE = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse modulo 2**64) for i in 0..n."""
    key = which, inverse
    if (p := _POWERS.get(key)) is None or len(p) <= n:
        base = _BASE[which] if not inverse else pow(_BASE[which], -1, 2**64)
        size = max(SLICE_BYTES + 100_000, n)
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        _POWERS[key] = p = np.multiply.accumulate(steps)
    return p[: n + 1]


def _trimmer():
    """glibc's malloc_trim, where there is one."""
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = _trimmer()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim(0)


@dataclass
class Docs:
    """Texts as one buffer; document i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def docs_of(column: pa.Array | pa.ChunkedArray) -> Docs:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return Docs(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return Docs(data, offsets - offsets[0])


def slices(docs: Docs, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Docs]]:
    """Runs of documents (from, to, part) of about `most` bytes, at least one document each."""
    at = 0
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(docs.offsets, docs.offsets[at] + most, "right")) - 1)
        to = min(to, len(docs))
        off = docs.offsets[at : to + 1]
        yield at, to, Docs(docs.data[off[0] : off[-1]], off - off[0])
        at = to
    release()


@dataclass
class Words:
    """Words of some documents: byte ranges in the buffer, and the range of words of each document."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def place(self) -> np.ndarray:
        """Each word's number in its document."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))


def words_of(docs: Docs, outside: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes for which `outside` is false; no word crosses documents."""
    n = len(docs.data)
    inside = ~outside[docs.data]
    head = np.zeros(n + 1, bool)
    head[docs.offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | head[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | head[1:])) + 1
    return Words(start, end, np.searchsorted(start, docs.offsets))


def hashes(docs: Docs, words: Words, fold: np.ndarray = SAME, which: int = 0) -> np.ndarray:
    """64-bit hashes of words after the byte map `fold`; `which` picks one of two independent functions."""
    n = len(docs.data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[which][fold][docs.data] * powers(which, n)[:-1], out=total[1:])
    return mix((total[words.end] - total[words.start]) * powers(which, n, True)[words.start])


def grams(h: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that begin at each word, and a mask of the words where one fits in the document."""
    n = len(h)
    fits = np.zeros(n, bool)
    ends = np.repeat(first[1:], np.diff(first))
    fits = np.arange(n) + k <= ends
    out = np.zeros(n, np.uint64)
    if n >= k:
        base = U(_BASE[which])
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc *= base
            acc += h[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out, fits


def shingle_hashes(docs: Docs, k: int = 5, fold: np.ndarray = LOWER, outside: np.ndarray = SPACE, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each document's range of them; a shorter text has its whole sequence as one."""
    words = words_of(docs, outside)
    h = hashes(docs, words, fold, which)
    g, fits = grams(h, words.first, k, which)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    for i in short:
        a, b = words.first[i], words.first[i + 1]
        acc = U(b - a)
        with np.errstate(over="ignore"):
            for x in h[a:b]:
                acc = acc * U(_BASE[which]) + x
        g[a] = mix(np.array([acc], np.uint64))[0]
        fits[a] = True
    count = np.maximum(n - k + 1, np.minimum(n, 1))
    return g[fits], np.concatenate([[0], np.cumsum(count)])


def distinct(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and without repeats."""
    parts = [np.unique(g[a:b]) for a, b in zip(first[:-1], first[1:])]
    return (np.concatenate(parts) if parts else g[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
