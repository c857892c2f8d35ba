"""Language ID by multilingual mixture inference.

Training counts letter trigrams per language over all training rows.  A document is a mixture: each of its words was
written in one of the languages, and expectation-maximisation finds the proportions.  Which languages belong to the
set is chosen by likelihood less a penalty for every further language (Bayesian information criterion).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import code_points, flat, lower_letter_table, slices

#: trigrams are hashed to so many buckets: the model has at most BUCKETS x MAX_LANGUAGES entries
BUCKETS = 1 << 18
MAX_LANGUAGES = 256
UNKNOWN = "und"


def _trigrams(texts: pa.Array):
    """Bucket of the trigram around every letter, first trigram of each word, first word of each row."""
    data, offsets = flat(texts)
    points, _, first = code_points(data, offsets)
    letters = np.zeros(len(points) + 2, np.uint32)
    letters[1:-1] = lower_letter_table()[np.minimum(points, 0x10FFFF)]
    inside = letters[1:-1] > 0
    at = np.flatnonzero(inside)
    left, right = letters[:-2].copy(), letters[2:].copy()
    row_start = first[:-1][first[:-1] < len(points)]
    left[row_start] = 0
    right[row_start[row_start > 0] - 1] = 0
    mid = letters[1:-1][at]
    h = left[at] * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + right[at] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)
    words = np.flatnonzero(left[at] == 0)
    return bucket, words, np.searchsorted(at[words], first)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log probabilities of the trigram buckets in each, from all rows with text and language.

    Tasks count into dense arrays and send sums; the model that reaches the driver has at most ``BUCKETS`` entries per
    language, however many rows there are.  Rows with null text or language teach nothing; without rows to learn from
    the list is empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in slices(batches, "_text"):
            bucket, words, first = _trigrams(piece.column("_text"))
            upto = np.append(words, len(bucket))[first]
            langs = piece.column("_lang").to_pylist()
            names = sorted(set(langs))
            code = np.repeat([names.index(x) for x in langs], np.diff(upto)).astype(np.int64)
            got = np.bincount(code * BUCKETS + bucket, minlength=BUCKETS * len(names)).reshape(len(names), BUCKETS)
            for name, row in zip(names, got, strict=True):
                sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text is not null and _lang is not null")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MAX_LANGUAGES}")
    table = np.zeros((len(langs), BUCKETS))
    table[np.searchsorted(langs, counts["lang"]) if len(langs) else [], counts["bucket"].to_numpy(dtype=np.int64)] = counts["n"]
    seen = max(1, int((table.sum(0) > 0).sum()))
    smooth = 0.1
    model = np.log((table + smooth) / (table.sum(1, keepdims=True) + smooth * seen)) if len(langs) else table
    return langs, model.astype(np.float32)


def _fit(likely: np.ndarray, worst: np.ndarray, row: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` of expectation-maximisation, and each document's log likelihood with them."""
    size = np.diff(np.append(first, len(row)))[:, None]
    for _ in range(rounds):
        part = likely * shares[row]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        shares = np.add.reduceat(part, first, axis=0) / size
    total = np.log(np.maximum((likely * shares[row]).sum(1), 1e-30)) + worst
    return shares, np.add.reduceat(total, first)


def infer(texts: pa.Array, model: np.ndarray, rounds: int, most: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the proportions of all languages in its chosen set (all 0 without a letter), and the size of the set."""
    bucket, words, first_word = _trigrams(texts)
    shares = np.zeros((len(texts), len(model)))
    sets = np.zeros(len(texts), np.int32)
    full = np.flatnonzero(np.diff(first_word) > 0)
    if len(full) == 0 or len(model) == 0:
        return shares, sets
    logs = np.stack([np.add.reduceat(m[bucket], words) for m in model], axis=1).astype(np.float64)
    worst = logs.max(1)
    likely = np.exp(logs - worst[:, None])
    first = first_word[full]
    row = np.repeat(np.arange(len(full)), np.diff(first_word)[full])
    n = np.diff(np.append(first, len(row)))
    start, fit = _fit(likely, worst, row, first, np.full((len(full), len(model)), 1 / len(model)), rounds)
    order = np.argsort(-start, axis=1, kind="stable")
    best_score, best, best_k = np.full(len(full), -np.inf), start, np.ones(len(full), np.int32)
    for k in range(1, min(most, len(model)) + 1):
        allowed = np.zeros_like(start)
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        own = (start + 1e-6) * allowed
        own, fit = _fit(likely, worst, row, first, own / own.sum(1, keepdims=True), rounds if k > 1 else 0)
        score = fit - penalty * (k - 1) * np.log(n + 1)
        better = score > best_score
        best_score = np.where(better, score, best_score)
        best, best_k = np.where(better[:, None], own, best), np.where(better, k, best_k)
    shares[full], sets[full] = best, best_k
    return shares, sets


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6, most: int = 3, penalty: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id), ``lang_pred``, ``score`` (its share), ``languages`` and ``shares`` (the chosen set, largest first).

    Text that is null or has no letter, or an empty model, gives ``und`` with score 0 and no languages.  Ties go to
    the language that sorts first.  Rows are judged one by one, so repeated rows get the same answer; columns of the
    input other than ``keep`` are left out.
    """
    kept = keep or [id_col]
    text_at = f"_k{kept.index(text_col)}" if text_col in kept else "_text"
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for piece in slices(batches, text_at):
            shares, sets = infer(piece.column(text_at), logs, rounds, most, penalty)
            order = np.argsort(-shares, axis=1, kind="stable")
            sets = sets.tolist()
            chosen = [[names[j] for j in o[:k]] for o, k in zip(order.tolist(), sets, strict=True)]
            parts = [s[o[:k]].tolist() for s, o, k in zip(shares, order, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([*[piece.column(f"_k{i}") for i in range(len(kept))], pa.array([c[0] if c else UNKNOWN for c in chosen], pa.string()), pa.array([min(1.0, p[0]) if p else 0.0 for p in parts], pa.float64()), pa.array(chosen, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], *([] if text_col in kept else [F.col(text_col).alias("_text")])).mapInArrow(run, schema)
