"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  Both begin with the words that are most
frequent in ordinary text (those cost the same with either) and end with what is most particular to their class: whole
words and beginnings of words, by the log likelihood ratio of their occurrences.  Text is compressed in windows of one
word, followed by a fixed piece of common text because the compressor does not look for matches in the last bytes of its
input; what the toxic dictionary saves against the ordinary one is the window's distance.  How much a distance on a word
of some length speaks for either class is counted on labelled texts, and a logistic curve over the sum of that evidence
and its strongest part gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .text import LOWER, flat, prefix_hash, slices, span_hash, word_spans

#: labelled texts of each class for dictionaries and curve, at most: those with the lowest hashes of their ids
FIT = 6000
#: bytes of a dictionary's common part
COMMON = 9000
#: fragments particular to a class that are kept, at most: with every fragment that passes the test below this, none is left out
PARTICULAR = 8000
#: a fragment is particular with this log likelihood ratio or more, in three texts or more, and four times its share
CERTAIN, TEXTS, TIMES = 20.0, 3, 4.0
#: lengths of beginnings of words, with the blank before them
BEGINS = (5, 6, 7, 8, 9, 10)
#: occurrences that a text adds to a fragment, and to a distance, at most
PER_TEXT, PER_CELL = 8, 40
#: distances from -3 to 9 bytes, lengths up to 16 bytes
_LOW, _HIGH, _LONG = -3, 9, 16
CELLS = (_HIGH - _LOW + 1) * (_LONG + 1)
#: evidence of a word that counts as strong
STRONG = 0.7
_ROOM = 1_000_000


class Model:
    """Two dictionaries, evidence by distance and length, and a curve: some kilobytes, by what the labelled sample holds."""

    def __init__(self, common: list[bytes], toxic: list[bytes], ordinary: list[bytes]):
        join = lambda parts: b"".join(reversed(parts))  # noqa: E731  the first ones come last, where references are cheapest
        own, other = join(toxic), join(ordinary)
        self.dictionaries = [join(common) + own, join(common) + other[-len(own) :].rjust(len(own))]
        self.tail = b" " + join(common)[-64:]
        self.evidence = np.zeros(CELLS)
        self.curve = np.zeros(6)
        self.empty = not toxic

    def ready(self) -> Model:
        """Opens the compressors and an empty store in a task."""
        shape = zstandard.ZstdCompressionParameters.from_level(12, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.compress = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d or b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=shape).compress for d in self.dictionaries]
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int16)
        return self

    def saved(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes the toxic dictionary saves on each of some distinct words (by rising hash)."""
        if len(self.keys) + len(hashes) > _ROOM:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int16)
        place = np.searchsorted(self.keys, hashes)
        known = np.append(self.keys, np.uint64(0))[place] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        known &= place < len(self.keys)
        new = np.flatnonzero(~known)
        toxic, ordinary = self.compress
        windows = [b" " + raw[a:b] + self.tail for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        got = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.int64).clip(-99, 99).astype(np.int16)
        self.keys, self.values = np.insert(self.keys, place[new], hashes[new]), np.insert(self.values, place[new], got)
        return self.values[np.searchsorted(self.keys, hashes)].astype(np.int64)

    def cells(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every word of every text its cell (distance and length), and where each text's words begin."""
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        hashes, sample, entry = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        saving = self.saved(hashes, data.tobytes(), starts[sample], ends[sample])[entry]
        return (np.clip(saving, _LOW, _HIGH) - _LOW) * (_LONG + 1) + np.minimum(ends - starts, _LONG), first

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: strong words (logarithm, share), evidence (by root of the words, logarithm), share of strong evidence; 0 without words."""
        cell, first = self.cells(texts)
        value = np.append(self.evidence[cell], 0.0)
        strong = np.where(value > STRONG, value, 0.0)
        n = np.diff(first)
        total = lambda x: np.where(n > 0, np.add.reduceat(x, np.minimum(first[:-1], len(x) - 1)), 0.0) if len(n) else np.zeros(0)
        words, hits, whole, weight = np.maximum(n, 1), total((strong > 0).astype(float)), total(value), total(strong)
        return np.column_stack([np.log1p(hits), np.minimum(20 * hits / words, 3), whole / words**0.5, np.minimum(20 * weight / words, 6), np.log1p(np.maximum(whole, 0))])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fragments(fit: DataFrame) -> DataFrame:
    """``f`` (whole word with its blanks, or the beginning of a word), occurrences ``a`` in toxic and ``b`` in ordinary texts, and texts ``ta``, ``tb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text", 1 << 22):
            raw, offsets = flat(piece.column("_text"))
            lowered, sums = LOWER[raw].tobytes(), {}
            for a, b, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), piece.column("_y").to_pylist(), strict=True):
                own = Counter()
                for w, n in Counter(lowered[a:b].split()).items():
                    word = b" " + w
                    own[word + b" "] += n
                    for k in BEGINS:
                        if len(word) > k:
                            own[word[:k]] += n
                for f, n in own.items():
                    row = sums.setdefault(f, [0, 0, 0, 0])
                    row[1 - y] += min(n, PER_TEXT)
                    row[3 - y] += 1
            columns = list(zip(*sums.values(), strict=True)) if sums else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], names=["f", "a", "b", "ta", "tb"])

    return fit.mapInArrow(run, "f binary, a long, b long, ta long, tb long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("a", "b", "ta", "tb")])


def _particular(counts: DataFrame, own: str, other: str, share: float) -> list[bytes]:
    """Fragments of one class, most telling first; of fragments within each other the longest that is about as frequent stays."""
    expected = (F.col(other) + 0.5) * share
    ratio = F.col(own) * F.log((F.col(own) + 0.5) / expected) - F.greatest(F.col(own) + 0.5 - expected, F.lit(0.0))
    telling = counts.where((F.col(f"t{own}") >= TEXTS) & (F.col(own) > TIMES * share * F.col(other))).withColumn("s", ratio).where(F.col("s") >= CERTAIN)
    rows = telling.orderBy(F.col("s").desc(), "f").limit(PARTICULAR).select("f", own).collect()
    size, begin = {bytes(r["f"]): r[own] for r in rows}, {}
    for f in size:
        for k in range(2, len(f) + 1):
            begin.setdefault(f[:k], []).append(f)
    chosen: dict[bytes, None] = {}
    for f in size:
        longest = max((x for x in begin[f] if size[x] >= 0.8 * size[f]), key=lambda x: (len(x), size[x], x))
        stem = longest.rstrip()
        if not any(longest[:k] in chosen or longest[:k] + b" " in chosen for k in range(2, len(longest) + 1)) and not any(x in chosen for x in begin.get(stem, ())):
            chosen[longest] = None
    return list(chosen)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Dictionaries, evidence and curve from at most ``FIT`` labelled texts of each class.

    Null labels, ids and texts teach nothing; a document labelled twice counts with its higher label.  Without labelled
    texts of both classes, or without anything particular to the toxic ones, every score is 0.  Only fragments that are
    kept, the evidence table, and five numbers for each fitted text reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).alias("_y"))
    by = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_labelled"), "_labelled").limit(FIT)
    chosen = F.broadcast(by(0).union(by(1)))  # at most 2 x FIT ids
    fit = stored(docs.join(chosen, docs[id_col] == chosen["_labelled"]).select(F.col(text_col).alias("_text"), F.col("_y").cast("int").alias("_y")).where("_text is not null"), "labelled")
    counts = stored(_fragments(fit), "fragments")
    whole = F.col("f").endswith(F.lit(b" "))
    words = counts.where(whole).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if not words["a"] or not words["b"]:
        return Model([], [], [])
    toxic, ordinary = _particular(counts, "a", "b", words["a"] / words["b"]), _particular(counts, "b", "a", words["b"] / words["a"])
    frequent = counts.where(whole & (F.col("b") >= 3)).orderBy(F.col("b").desc(), "f").limit(COMMON // 2).select("f").collect()
    model = Model(_fitting([bytes(r["f"])[:-1] for r in frequent], COMMON), toxic, ordinary)
    if model.empty:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = shared.value.ready(), np.zeros((2, CELLS), np.int64)
        for piece in slices(batches, "_text"):
            cell, first = m.cells(piece.column("_text"))
            for y, a, b in zip(piece.column("_y").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                sums[y] += np.minimum(np.bincount(cell[a:b], minlength=CELLS), PER_CELL)
        y, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(cell), pa.array(sums[y, cell])], names=["y", "cell", "n"])

    seen = np.zeros((2, CELLS))
    for r in fit.mapInArrow(distances, "y long, cell long, n long").groupBy("y", "cell").agg(F.sum("n").alias("n")).collect():  # 2 x CELLS rows at most
        seen[r["y"], r["cell"]] = r["n"]
    model.evidence = np.where(seen.sum(0) > 0, np.log((seen[1] + 1) / (seen[1].sum() + 100)) - np.log((seen[0] + 1) / (seen[0].sum() + 100)), 0.0)
    again = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = again.value.ready()
        for piece in slices(batches, "_text"):
            x = m.features(piece.column("_text"))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x[:, i])) for i in range(5)], piece.column("_y")], names=["x0", "x1", "x2", "x3", "x4", "y"])

    got = fit.mapInArrow(measure, "x0 double, x1 double, x2 double, x3 double, x4 double, y int").toPandas()  # 2 x FIT rows at most
    got = got.sort_values(list(got.columns))  # sums in one order, whatever the partitions
    model.curve = _logistic(got[["x0", "x1", "x2", "x3", "x4"]].to_numpy(), got["y"].to_numpy(float))
    return model


def _fitting(words: list[bytes], room: int) -> list[bytes]:
    upto = np.cumsum([len(w) for w in words])
    return words[: int((upto <= room).sum())]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on) of every row; the whole text counts.

    Null, empty and blank texts have no evidence and get the curve's value for that; a text of any length is read whole.  Rows are scored one by one;
    other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not m.empty:
            m.ready()
        for piece in slices(batches, "_text", 1 << 21):
            s = np.zeros(piece.num_rows) if m.empty else m.score(m.features(piece.column("_text")))
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(s, pa.float64()), pa.array(s >= 0.7).cast(pa.int32())], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
