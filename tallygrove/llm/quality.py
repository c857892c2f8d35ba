"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The grams are four code points; only white space is made equal.  Counts, contexts and back-off weights are joined as
tables.  Tasks know the frequent contexts with all their grams, so that they can tell a gram never seen from one they do
not know; grams of the other contexts, if there are any, find their probability by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .text import SPACE, class_table, code_points, flat, slices

ORDER, BITS = 4, 21
_SYMBOL = (1 << BITS) - 1
#: an alphabet counts as at least so many symbols: what is left of it is for those never seen
ALPHABET = 64
#: grams of each order that every task knows; the others are joined
FREQUENT = 1 << 19


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Every code point is a symbol of its own; white space is 0, which also stands before a text."""
    table = np.arange(0x110000)
    table[class_table() == SPACE] = 0
    return table


def _context(x, n: int):
    """The last ``n`` symbols of a context (numbers or a column name)."""
    keep = (1 << BITS * n) - 1
    return F.expr(f"{x} & {keep}L") if isinstance(x, str) else x & keep


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of the texts (context, symbol), which one ends at each code point, and each row's first."""
    data, offsets = flat(texts)
    points, _, first = code_points(data, offsets)
    symbols = _symbol_table()[np.minimum(points, 0x10FFFF)]
    place = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    before = np.zeros(len(symbols), np.int64)
    for back in range(1, ORDER):
        earlier = np.concatenate([np.zeros(back, np.int64), symbols])[: len(symbols)]
        before |= np.where(place >= back, earlier, 0) << (BITS * (back - 1))
    which, contexts = pd.factorize(before)
    which, pairs = pd.factorize(which << BITS | symbols)
    return contexts[pairs >> BITS], pairs & _SYMBOL, which, first


def _count(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text", 1 << 21):
            x, s, which, _ = _grams(piece.column("_text"))
            n = np.bincount(which, minlength=len(x))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(s.astype(np.int32)), pa.array(n, pa.int64())], names=["x", "s", "c"])

    return docs.mapInArrow(run, "x long, s int, c long").groupBy("x", "s").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame, text_col: str = "text") -> dict[int, DataFrame]:
    """For each order its grams (context ``x``, symbol ``s``) with their probability ``p``, and the weight ``back`` and count ``t`` of their context.

    All of ``trusted`` counts; null texts count as empty.  Order 0 has one row: the probability of any symbol by itself.
    """
    counts = {ORDER: stored(_count(trusted.select(F.col(text_col).alias("_text"))), "grams")}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the different grams that continue
        counts[n] = stored(counts[n + 1].groupBy(_context("x", n - 1).alias("x"), "s").agg(F.count(F.lit(1)).alias("c")), "grams")
    model = {0: counts[1].agg((F.lit(1.0) / F.greatest(F.count(F.lit(1)) + 1, F.lit(ALPHABET))).alias("p"))}
    for n in range(1, ORDER + 1):
        c = counts[n]
        r = c.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
        y = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5
        d = [min(max(k - (k + 1) * y * r[f"n{k + 1}"] / r[f"n{k}"], 0.1), k - 0.05) if r[f"n{k}"] and r[f"n{k + 1}"] else 0.5 * min(k, 1.5) for k in (1, 2, 3)]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = c.groupBy("x").agg(F.sum("c").alias("t"), F.sum(off).alias("o")).select("x", "t", (F.col("o") / F.col("t")).alias("back"))
        seen = c.join(context, "x")
        if n == 1:
            below = model[0].scalar()
        else:
            low = model[n - 1].select(F.col("x").alias("_x"), F.col("s").alias("_s"), F.col("p").alias("_p"))
            seen = seen.join(low, (_context("x", n - 2) == F.col("_x")) & (F.col("s") == F.col("_s")))
            below = F.col("_p")
        model[n] = stored(seen.select("x", "s", ((F.col("c") - off) / F.col("t") + F.col("back") * below).alias("p"), "back", "t"), "grams")
    return model


def _known(grams: DataFrame) -> tuple[tuple, bool]:
    """The most frequent contexts with all their grams, at most ``FREQUENT`` grams, and whether these are all.

    Contexts go by steps of their count (eight for a doubling).  They come as sorted contexts and their weights, sorted
    (place of the context, symbol) and the grams' probabilities; weights and probabilities as log2.
    """
    step = F.floor(F.log2("t") * 8)
    steps = sorted(((r["s"], r["count"]) for r in grams.groupBy(step.alias("s")).count().collect()), reverse=True)  # a few hundred rows
    upto = np.cumsum([k for _, k in steps])
    kept = [s for (s, _), k in zip(steps, upto.tolist(), strict=True) if k <= FREQUENT]
    got = grams.where(step >= kept[-1] if kept else F.lit(False)).toPandas().sort_values(["x", "s"])
    x, at, place = np.unique(got["x"].to_numpy(np.int64), return_index=True, return_inverse=True)
    logs = lambda c: np.log2(got[c].to_numpy(np.float64))
    return (x, logs("back")[at], place << BITS | got["s"].to_numpy(np.int64), logs("p")), len(kept) == len(steps)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _logs(known: dict[int, tuple[tuple, bool]], single: float, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 probability of grams, and which are to be joined as their context is not known."""
    logs, more, rest = np.zeros(len(x)), np.zeros(len(x), bool), np.arange(len(x))
    for n in range(ORDER, 0, -1):
        (contexts, backs, keys, probs), whole = known[n]
        at, there = _find(contexts, _context(x[rest], n - 1))
        if not whole:
            more[rest[~there]] = True
        place, seen = _find(keys, at << BITS | s[rest])
        seen &= there
        logs[rest[seen]] += probs[place[seen]]
        logs[rest[there & ~seen]] += backs[at[there & ~seen]]
        rest = rest[~seen]
    logs[rest] += single
    return logs, more


def _joined(grams: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """``grams`` (``x``, ``s``) with their log2 probability ``log``, all from the tables."""
    out, log = grams, F.log2(model[0].scalar())
    for n in range(1, ORDER + 1):
        own = model[n].select(F.col("x").alias(f"_x{n}"), F.col("s").alias(f"_s{n}"), F.col("p").alias(f"_p{n}"))
        weights = model[n].groupBy(F.col("x").alias(f"_c{n}")).agg(F.max("back").alias(f"_b{n}"))
        x = _context("x", n - 1)
        out = out.join(own, (x == F.col(f"_x{n}")) & (F.col("s") == F.col(f"_s{n}")), "left").join(weights, x == F.col(f"_c{n}"), "left")
        log = F.coalesce(F.log2(f"_p{n}"), F.coalesce(F.log2(f"_b{n}"), F.lit(0.0)) + log)
    return out.select("x", "s", log.alias("log"))


def perplexity(docs: DataFrame, model: dict[int, DataFrame], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``bits`` per code point (null for null or empty text)."""
    known = {n: _known(model[n]) for n in range(1, ORDER + 1)}
    whole = all(w for _, w in known.values())
    shared = docs.sparkSession.sparkContext.broadcast((known, float(np.log2(model[0].first()["p"]))))
    kept = [f"_k{i}" for i in range(len(keep))]
    rare = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("s", T.IntegerType())]))
    schema = T.StructType([T.StructField("_row", T.LongType()), *[T.StructField(k, docs.schema[c].dataType) for k, c in zip(kept, keep, strict=True)],
                           T.StructField("_n", T.LongType()), T.StructField("_log", T.DoubleType()), T.StructField("_rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, single = shared.value
        for piece in slices(batches, "_text"):
            x, s, which, first = _grams(piece.column("_text"))
            logs, more = _logs(tables, single, x, s)
            logs[more] = 0.0
            upto = np.concatenate([[0.0], np.cumsum(logs[which])])
            apart = more[which]
            grams = pa.StructArray.from_arrays([pa.array(x[which[apart]], pa.int64()), pa.array(s[which[apart]].astype(np.int32))], ["x", "s"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(apart)])[first], pa.int32()), grams)
            yield pa.RecordBatch.from_arrays([piece.column("_row"), *[piece.column(k) for k in kept], pa.array(np.diff(first), pa.int64()), pa.array(upto[first[1:]] - upto[first[:-1]]), lists], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)], F.col(text_col).alias("_text"))
    scored = rows.mapInArrow(run, schema)
    log = F.col("_log")
    if not whole:
        scored = stored(scored, "logs")
        apart = scored.select("_row", F.inline("_rare")).groupBy("_row", "x", "s").agg(F.count(F.lit(1)).alias("k"))
        found = _joined(apart.select("x", "s").distinct(), model).select(F.col("x").alias("_x"), F.col("s").alias("_s"), "log")
        sums = apart.join(found, (F.col("x") == F.col("_x")) & (F.col("s") == F.col("_s"))).groupBy(F.col("_row").alias("_of")).agg(F.sum(F.col("k") * F.col("log")).alias("_more"))
        scored = scored.join(sums, F.col("_row") == F.col("_of"), "left")
        log = log + F.coalesce("_more", F.lit(0.0))
    return scored.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], F.when(F.col("_n") > 0, -log / F.col("_n")).alias("bits"))


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, lang, ``perplexity``, ``threshold`` (quantile of the trusted texts of its language) and ``keep``.

    ``trusted_ids`` has the ids (``_trusted``, once each) of the texts to learn from.  A language without trusted text
    has the quantile of all trusted text; without any, nothing is kept.  Null and empty texts have no perplexity and are
    not kept; a null language is one of its own.  Quantiles are exact on a grid of a thousandth of a bit.
    """
    trusted = docs.hint("merge").join(trusted_ids, docs[id_col] == trusted_ids["_trusted"]).select(F.col(text_col).alias("_text"))
    scored = stored(perplexity(docs, train(trusted, "_text"), [id_col, lang_col], text_col), "bits")
    known = scored.join(trusted_ids, scored[id_col] == trusted_ids["_trusted"]).where("bits is not null")
    bins = known.groupBy(F.coalesce(lang_col, F.lit("")).alias("_lang"), F.ceil(F.col("bits") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = stored(bins.union(bins.groupBy(F.lit(None).cast("string"), "bin").agg(F.sum("n"))), "bins")
    w = Window.partitionBy("_lang").orderBy("bin")  # at most a few thousand bins for a language
    limits = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("_lang"))).where(F.col("upto") >= F.col("all") * quantile).groupBy("_lang").agg((F.min("bin") / 1000).alias("limit"))
    whole = limits.where("_lang is null").select("limit")
    out = scored.join(limits.where("_lang is not null"), F.coalesce(lang_col, F.lit("")) == F.col("_lang"), "left")
    limit = F.coalesce("limit", whole.scalar())
    return out.select(id_col, lang_col, F.pow(2.0, "bits").alias("perplexity"), F.pow(2.0, limit).alias("threshold"), F.coalesce(F.col("bits") <= limit, F.lit(False)).alias("keep"))
