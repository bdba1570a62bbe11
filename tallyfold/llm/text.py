"""Vectorised text helpers used inside Spark tasks.

A *blob* is a run of whole documents of one Arrow batch, held as one byte
array.  Words and their 64-bit hashes are computed for a blob at a time with
numpy; a document is never cut.  Memory per blob is about 60 bytes per byte
of text; a blob holds at least one whole document and otherwise at most
``BLOB_BYTES``.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOB_BYTES = 1 << 19
# White space of the contracts, `[\x20\x09-\x0D]`.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U = np.uint64
_PRIME = 0x9E3779B97F4A7C15


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    name = "_tallyfold_llm_process_cache"
    m = sys.modules.get(name)
    if m is None:
        m = sys.modules[name] = types.ModuleType(name)
        m.values = {}
    return m.values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = process_cache()
    got = c.get("powers")
    if got is None or len(got[0]) < n:
        size = max(n, BLOB_BYTES + 1)
        a = np.full(size, _PRIME, U)
        b = np.full(size, pow(_PRIME, -1, 1 << 64), U)
        a[0] = b[0] = 1
        got = c["powers"] = (np.cumprod(a, dtype=U), np.cumprod(b, dtype=U))
    return got


def byte_table(lower: bool) -> np.ndarray:
    """Random 64-bit value of each byte; with ``lower`` A-Z equal a-z."""
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U)
    if lower:
        t[65:91] = t[97:123]
    return t


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of ``values[s:e]`` for every (s, e)."""
    p, ip = _powers(len(values) + 1)
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], dtype=U, out=c[1:])
    return mix((c[ends] - c[starts]) * ip[starts])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    s = np.arange(n)
    return range_hashes(h, s, s + k)


class Blob:
    """Whole documents ``rows[0..n)`` as bytes, with word spans and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray, table: np.ndarray):
        self.data, self.offsets, self.table = data, offsets, table
        self.n = len(offsets) - 1
        word = ~space[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.word = word
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = range_hashes(self.table[self.data], self.starts, self.ends)
        return self._hashes

    @property
    def doc(self) -> np.ndarray:
        """Index of the document of every word."""
        return np.repeat(np.arange(self.n), self.n_words)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array for every document."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-word array for every document."""
        c = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else float)
        np.cumsum(values, out=c[1:])
        return c[self.word_offsets[1:]] - c[self.word_offsets[:-1]]


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def space_table(extra: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """256 booleans: which bytes end a word."""
    s = np.zeros(256, bool)
    s[list(SPACES)] = True
    if extra is not None:
        s |= extra(np.arange(256))
    return s


def not_alnum(b: np.ndarray) -> np.ndarray:
    """ASCII bytes that are no letter or digit (bytes >= 0x80 stay in words)."""
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 48) & (b <= 57)
    return (b < 128) & ~letter


def blobs(col: pa.Array, lower: bool = False, space: np.ndarray | None = None,
          limit: int = BLOB_BYTES) -> Iterator[tuple[int, int, Blob]]:
    """(first row, end row, Blob) over a text column, whole documents each."""
    data, off = binary_parts(col)
    space = space_table() if space is None else space
    table = byte_table(lower)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, Blob(data[off[a]: off[b]], (off[a: b + 1] - off[a]).astype(np.int64), space, table)
        a = b
