"""Vector code compression: product codes by memoised grid cells.

Integer vectors are cut into equal parts, and each part is coded by its nearest codebook entry.  A part is hashed to
its coarse cell, a box of ``cell`` integers a side.  The first part that falls into a cell settles which entries can
be nearest to anything in it: with m the entry nearest to the box's middle, an entry stays unless even the smallest
value over the box of (its squared distance - that of m) is above 0, which for integers is exact.  The list of a cell
is kept, and parts are compared with the entries of their cell's list alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..semantics import join_on
from .store import stored

PARTS, ENTRIES, ROUNDS, SCALE, CELL = 4, 256, 4, 1024, 128
#: components beyond this are refused: squared distances of such vectors would leave 64 bits
LARGEST = 1 << 27
#: cells that a task keeps for each part, and entries it compares at once
CELLS, AT_ONCE = 50_000, 1 << 18


class Cells:
    """Nearest entries of one codebook (int64, an entry a row); lists of cells are kept between calls."""

    def __init__(self, book: np.ndarray, cell: int = CELL):
        self.book, self.cell, self.lists = book, cell, {}
        self.square = (book * book).sum(1)
        self.apart = np.abs(book[:, None, :] - book[None, :, :]).sum(2)
        self.looked = self.compared = 0

    def _settle(self, cells: np.ndarray) -> None:
        """Lists of new cells: 2 p e is linear in p, so its extremes over a box are its value in the middle and half a side times |e - m|."""
        twice = 2 * cells * self.cell + (self.cell - 1)  # the middle of the box, doubled to stay an integer
        for a in range(0, len(cells), 1024):
            excess = self.square[None, :] - twice[a : a + 1024] @ self.book.T  # distance to the middle, without a common term
            m = excess.argmin(1)
            least = excess - excess[np.arange(len(m)), m][:, None] - (self.cell - 1) * self.apart[m]
            for key, row in zip(cells[a : a + 1024], least <= 0, strict=True):
                self.lists[key.tobytes()] = np.flatnonzero(row)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and its squared distance, for every row."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.lists) > CELLS:
            self.lists.clear()
        cells = parts // self.cell
        names = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.shape[1] * 8))).ravel() if cells.shape[1] else np.zeros(len(cells), "V1")
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        keys = [cells[i].tobytes() for i in first]
        new = [i for i, k in zip(first, keys, strict=True) if k not in self.lists]
        if new:
            self._settle(cells[new])
        lists = [self.lists[k] for k in keys]
        each = np.array([len(x) for x in lists], np.int64)[which]
        self.looked, self.compared = self.looked + len(parts), self.compared + int(each.sum())
        index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        block = np.cumsum(each) // AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(parts)]
        for a, b in zip(edges, edges[1:], strict=False):
            entry = np.concatenate([lists[i] for i in which[a:b]])
            begin = np.concatenate([[0], np.cumsum(each[a:b])[:-1]])
            gap = self.book[entry] - np.repeat(parts[a:b], each[a:b], axis=0)
            far = np.einsum("ij,ij->i", gap, gap)
            low = np.minimum.reduceat(far, begin)
            hit = np.flatnonzero(far == np.repeat(low, each[a:b]))
            index[a:b], error[a:b] = entry[hit[np.searchsorted(hit, begin)]], low
        return index, error


def _whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v`` (integers) of the rows that take part."""
    v = F.col("_v")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    level = lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit squared distances")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("_v")).where(sound)
    return rows.select("id", "label", F.transform(v, level).alias("v"))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, size)


def _first(rows: DataFrame, entries: int, size: int) -> np.ndarray:
    """The vectors of the smallest ids, null last; of an id that repeats with several vectors, the smallest."""
    ids = [r["id"] for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.col("id").isin(known) if len(known) == len(ids) else F.col("id").isin(known) | F.col("id").isNull()
    got = rows.where(wanted).groupBy("id").agg(F.min("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: (r["id"] is None, r["id"] or 0))], np.int64).reshape(len(got), size)


def _moved(rows: DataFrame, books: list[np.ndarray], cell: int) -> list[np.ndarray]:
    """Each entry replaced by the floor of its parts' mean; entries that nothing is nearest to stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Cells(b, cell) for b in shared.value]
        count = np.zeros((len(grids), len(grids[0].book)), np.int64)
        total = np.zeros((*count.shape, width), np.int64)
        for batch in batches:
            x = _matrix(batch, width * len(grids))
            for k, grid in enumerate(grids):
                part = x[:, k * width : (k + 1) * width]
                index, _ = grid.nearest(part)
                np.add.at(total[k], index, part)
                count[k] += np.bincount(index, minlength=count.shape[1])
        for k, e in zip(*np.nonzero(count), strict=True):
            n = np.full(width + 1, count[k, e])
            n[:width] = total[k, e]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, k, np.int32)), pa.array(np.full(width + 1, e, np.int32)), pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(n)], names=["part", "entry", "at", "amount"])

    sums = rows.select("v").mapInArrow(run, "part int, entry int, at int, amount long").groupBy("part", "entry", "at").agg(F.sum("amount").alias("amount"))
    made = {}
    for r in sums.collect():  # as many rows as the codebooks have components
        made.setdefault((r["part"], r["entry"]), {})[r["at"]] = r["amount"]
    books = [b.copy() for b in books]
    for (k, e), x in made.items():
        books[k][e] = [x[i] // x[width] for i in range(width)]
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, cell: int = CELL) -> DataFrame:
    """Per vector: id, ``code`` (two hex digits a part), ``error`` (squared distances summed over parts), ``label_error`` (errors summed over equal labels, nulls together), ``codebooks_sha256``.

    Components become floor(``scale`` * x).  Codebooks start as the parts of the vectors with the ``entries`` smallest
    ids (null last; an id with several vectors gives its smallest) and move to the floor of their parts' mean
    ``rounds`` times; an entry that nothing is nearest to stays.  Vectors that are null or hold null or non-finite
    components take no part; a row that repeats counts as often as it stands.  The rest must be of one length, a
    multiple of ``parts``, and below 2^27 after scaling, or an error says so.  An empty table gives an empty result;
    other columns are left out, whatever their names.  The driver holds the codebooks alone.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    rows = stored(_whole(vectors, id_col, vec_col, label_col, scale), "integers")
    sizes = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1 or sizes and sizes[0] % parts:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    size = sizes[0] if sizes else 0
    width = size // parts
    first = _first(rows, entries, size)
    books = [first[:, k * width : (k + 1) * width] for k in range(parts)]
    for _ in range(rounds if sizes else 0):
        books = _moved(rows, books, cell)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = rows.select("id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Cells(b, cell) for b in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, size)
            found = [grid.nearest(x[:, k * width : (k + 1) * width]) for k, grid in enumerate(grids)]
            raw = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [raw[a : a + 2 * parts] for a in range(0, len(raw), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=schema.names)

    coded = stored(rows.mapInArrow(run, schema), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_on(coded, sums, ["label"]).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
