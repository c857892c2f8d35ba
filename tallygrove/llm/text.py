"""Whole texts as flat byte arrays: slicing of Arrow batches, word spans, span hashes, code point classes."""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes of text worked on at once; a longer text is a slice of its own
SLICE = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Memory that was freed goes back to the system: a worker process outlives its task and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have about ``limit`` bytes; no text is cut.  At their end freed memory is given back."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
        batch = None
    give_back()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and where each row begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more entry than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SEPARATOR[data], out=inside[1:-1])
    starts_here = inside[1:] & ~inside[:-1]
    ends_here = starts_here.copy()
    np.logical_and(inside[:-1], ~inside[1:], out=ends_here)
    cut = offsets[1:-1]
    both = inside[cut] & inside[cut + 1]  # a word may not cross from one row into the next
    starts_here[cut[both]] = ends_here[cut[both]] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(20, int(n).bit_length()))
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of any span is a difference of two entries (see ``span_hash``)."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever its bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# --- code points -------------------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: code points with the property White_Space (fixed values)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def lower_letter_table() -> np.ndarray:
    """Lower case of every letter; 0 for any code point that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(class_table() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte where each begins (and the end), and the index of each row's first one.

    Spark's text is UTF-8; a byte that is not part of a valid sequence counts as one code point U+FFFD.
    """
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        points, places = [], []
        at = 0
        for ch in data.tobytes().decode("utf-8", "surrogateescape"):
            places.append(at)
            escaped = 0xDC80 <= ord(ch) <= 0xDCFF
            points.append(0xFFFD if escaped else ord(ch))
            at += 1 if escaped else len(ch.encode("utf-8"))
        points, begins = np.array(points, np.uint32), np.array(places, np.int64)
    return points, np.append(begins, len(data)), np.searchsorted(begins, offsets)
