"""Pairs of sets that share a bucket: those that sizes and bitmaps leave open, and those that exact intersection confirms.

A bucket is cut into blocks by hash, so that a large one becomes many small tasks, one for each pair of blocks, and a
pair is only written after its bitmaps have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a bucket that are compared in one go; larger buckets are cut
BLOCK = 2048
#: rows of a bucket for each task that buckets with the same smallest entry may be dealt to
SHARE = 64
#: pairs that a task holds before it writes each of them once
HELD = 1 << 17
#: shares of a set's partners that are dealt to different tasks
SALTS = 16


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns (as arrays) of each run of rows that agree in the first ``keys`` columns; rows come sorted by them."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            new = [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = np.zeros(len(new[0]), bool)
        for c in new[:keys]:
            cut[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cut).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield [c[a:b] for c in new]
        held = [c[edges[-1] :] for c in new]
    if held:
        yield held


def open_pairs(rows: DataFrame, words: list[str], percent: int, tensor: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """Distinct pairs (``a`` < ``b``) of entries that share a bucket, differ in group, and that sizes and bitmaps leave open (see ``_met``)."""
    return _met(rows, words, percent, tensor).distinct()


def _met(rows: DataFrame, words: list[str], percent: int, tensor: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """The pairs of ``open_pairs`` as tasks write them; a pair may be written by several tasks.

    ``rows``: ``key`` (bucket), ``grp``, ``id``, ``lo`` and ``hi`` (sizes of the sets it stands for), ``slack`` and the
    bitmap's ``words``: every set it stands for differs from that bitmap in at most ``slack`` bits.  Two bitmaps that
    differ in x bits prove x elements that are in one set only: overlap <= (n_a + n_b - x) / 2, for x less both slacks.
    ``pos`` elements of the sets come before what the bucket stands for, and are not shared.  With ``tensor``, the
    columns of two collections whose combinations the buckets stand for (``slot``: which one), a pair is looked at in
    the first bucket that both share, and in no other.  Without, buckets with the same smallest entry go to one task one
    after the other, which writes a pair once and not for every bucket that it shares; large buckets are dealt by ``SHARE``.
    """
    marks = [*tensor[0], *tensor[1]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.xxhash64(F.min("id"), F.pmod(F.xxhash64("_key"), F.ceil(F.count(F.lit(1)) / SHARE))).alias("deal")
    by = ["key"] if marks else ["deal", "key"]
    sizes = rows.withColumnRenamed("key", "_key").groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"), *([] if marks else [deal]))
    cut = rows.join(sizes, rows["key"] == sizes["_key"]).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    dealt = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*by, F.least("_own", "_with").alias("p"), F.greatest("_own", "_with").alias("q"), F.col("_own").alias("own"), "grp", "id", *[F.col(c).cast("long").alias(c) for c in ("lo", "hi", "slack", "pos")], *words, *([F.col("slot").cast("long").alias("slot"), *marks] if marks else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def once() -> pa.RecordBatch:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

        for entries in runs(batches, len(by) + 2):
            p, q, own, grp, ident, lo, hi, slack, pos, *rest = entries[len(by) :]
            if len(ident) < 2 or (grp == grp[0]).all():
                continue
            bits = np.stack(rest[: len(words)], axis=1).view(np.uint64)
            sides = [np.stack(rest[len(words) + 1 :][a:b], axis=1) for a, b in ((0, len(tensor[0])), (len(tensor[0]), len(marks)))] if marks else None
            first = own == p[0]
            there = np.arange(len(ident)) if p[0] == q[0] else np.flatnonzero(~first)
            for i in np.flatnonzero(first):
                j = there[there > i] if p[0] == q[0] else there
                sizes = (hi[i] * 100 >= lo[j] * percent) & (hi[j] * 100 >= lo[i] * percent)
                j = j[(grp[j] != grp[i]) & sizes & (np.minimum(hi[i] - pos[i], hi[j] - pos[j]) * (100 + percent) >= (lo[i] + lo[j]) * percent)]
                if marks and len(j):
                    one, two = ((side[j] == side[i]).argmax(1) for side in sides)
                    j = j[one * len(tensor[1]) + two == rest[len(words)][0]]
                if len(j):
                    differ = np.maximum(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) - slack[i] - slack[j], 0)
                    both = hi[j] + hi[i]
                    j = j[(both - differ) * (100 + percent) >= both * (2 * percent)]
                    left.append(np.full(len(j), ident[i]))
                    right.append(ident[j])
                    held += len(j)
                    if held >= HELD:
                        yield once()
                        left, right, held = [], [], 0
        if held:
            yield once()

    return dealt.repartition(n, by[0], "p", "q").sortWithinPartitions(*by, "p", "q", "grp").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) with 100 * intersection >= percent * union; ``sets`` has ``cls`` and ``h``, its sorted 64-bit elements.

    A set with many partners is dealt in ``SALTS`` shares and travels once a share; a set may stand in ``sets`` more than once.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    own = dealt.select("a", "salt").distinct().join(sets, F.col("a") == sets["cls"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "h")
    partner = dealt.join(sets, F.col("b") == sets["cls"]).select("a", "salt", "b", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, h in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "h")], strict=True):
                h = np.frombuffer(h, np.uint64)
                if b is None:
                    held = h
                elif 100 * min(len(h), len(held)) >= percent * max(len(h), len(held)):
                    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    same = int((held[at] == h).sum())
                    if 100 * same >= percent * (len(h) + len(held) - same):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    both = own.unionByName(partner).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long").distinct()
