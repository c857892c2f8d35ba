"""Suffix-array dedup: every string of ``length`` bytes that starts in more than one place, by a depth-limited radix sort.

The suffixes are never ordered beyond ``length`` bytes, and most are put aside after the first digit.  The most
significant digit of a suffix is an anchor: the gram of 48 bytes with the smallest hash among its first ``length``
bytes.  Equal strings have equal anchors in equal places, and consecutive suffixes with one anchor (about 75) travel as
one row.  A pass orders those rows by anchor and, as second digit, by all the bytes their suffixes cover: rows equal in
both are repeated windows throughout, an anchor that occurs once ends there.  Only rows that share an anchor and differ
otherwise - the edges of passages - go on to the last digit, the single suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .text import flat, mix, powers, prefix_hash, slices, span_hash

GRAM = 48
#: bytes of one text hashed at a time; longer texts are worked on in overlapping stretches
STRETCH = 1 << 20
#: an anchor with more different rows than this has its last digit counted by Spark instead of within a task
ROOM = 20_000
_PLACE = np.uint64((1 << 22) - 1)
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """Arrays of bytes with row bounds, each a set of whole rows or a stretch of a long one: data, bounds, first row, byte of the row."""
    if len(data) <= 2 * STRETCH:
        yield data, offsets, 0, 0
        return
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, max(a + 1, b - length + 1), STRETCH):
            end = min(b, at + STRETCH + length - 1)
            yield data[at:end], np.array([0, end - at]), r, at - a


def anchors(texts: pa.Array, length: int):
    """Row, first suffix, number of suffixes, distance to the anchor, anchor hash and hash of all covered bytes."""
    found = []
    data, offsets = flat(texts)
    gram = min(GRAM, length)
    for part, bounds, row, shift in _stretches(data, offsets, length):
        n = len(part) - length + 1
        if n <= 0:
            continue
        sums = prefix_hash(part)
        _, down = powers(len(part))
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h ^= h >> np.uint64(29)
        h *= _C1
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, reach = 1, length - gram + 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        anchor = (low[:n] & _PLACE).astype(np.int64)
        valid = np.ones(n, bool)
        for end in bounds[1:].tolist():
            valid[max(0, end - length + 1) : end] = False
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        a = anchor[p]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        p0, a0 = p[begin], a[begin]
        m = np.diff(np.append(begin, len(p)))
        first = span_hash(sums, a0, a0 + gram)
        block = mix(span_hash(sums, p0, p0 + m + (length - 1)) + (a0 - p0).astype(np.uint64) * _C1 + m.astype(np.uint64) * _C2)
        own = np.searchsorted(bounds, p0, side="right") - 1
        found.append((own + row, p0 - bounds[own] + shift, m, a0 - p0, first.view(np.int64), block.view(np.int64)))
    if not found:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(x) for x in zip(*found, strict=True)]


_ROW = "rid long, p long, m int, d int, anchor long"
#: What a task knows of a row before it is dealt: nothing; others of the task are equal and this one speaks for them; it is spoken for.
_ALONE, _SPEAKS, _SPOKEN_FOR = 0, 1, 2


def _first_digits(docs: DataFrame, length: int) -> DataFrame:
    """Rows of suffixes with both digits, and ``known``: of equal rows of one task only the first has to meet its anchor's others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text", 1 << 22):
            row, p, m, d, anchor, block = anchors(piece.column("_text"), length)
            rid = piece.column("rid").to_numpy(zero_copy_only=False)[row] if len(row) else row
            known = np.full(len(row), _SPOKEN_FOR, np.int32)
            if len(row):
                mixed = mix(anchor.view(np.uint64) * _C1 + block.view(np.uint64))
                _, first, count = np.unique(mixed, return_index=True, return_counts=True)
                known[first] = np.where(count > 1, _SPEAKS, _ALONE)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(p), pa.array(m, pa.int32()), pa.array(d, pa.int32()), pa.array(anchor), pa.array(block), pa.array(known)], names=["rid", "p", "m", "d", "anchor", "block", "known"])

    return docs.select("rid", "_text").mapInArrow(run, _ROW + ", block long, known int")


def _second_digit(rows: DataFrame) -> DataFrame:
    """Rows equal in both digits (``kind`` 0, repeated), and of anchors with several blocks one row for each block (``kind`` 1, or 2 if it is not repeated as a whole).

    A stream over rows in order: only the row before and the first row of the anchor are held, however many rows an
    anchor has.  Rows that are spoken for are repeated without further ado and are dealt by text instead of by anchor,
    so a passage that a third of all texts share does not gather in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "p", "m", "d", "anchor", "block", "known"]
        last: list[np.ndarray] = []  # the row whose right neighbour is not known yet
        state = {"equal_before": False, "many": False, "held": None}

        def emit(cols, n, after):
            """The first ``n`` rows of cols; ``after``: the row behind them exists."""
            anchor, block = cols[4], cols[5]
            new_anchor = np.ones(n, bool)
            new_anchor[1:] = anchor[1:n] != anchor[: n - 1]
            new_block = np.ones(n, bool)
            new_block[1:] = new_anchor[1:] | (block[1:n] != block[: n - 1])
            if state["held"] is not None and state["held"][0][4] == anchor[0]:
                new_anchor[0] = False
                new_block[0] = state["held"][1] != block[0]
            next_same = np.zeros(n, bool)
            upto = n if after else n - 1
            next_same[:upto] = (anchor[1 : upto + 1] == anchor[:upto]) & (block[1 : upto + 1] == block[:upto])
            repeated = ~new_block | next_same | (cols[6][:n] == _SPEAKS)
            kinds, picked = [np.zeros(int(repeated.sum()), np.int32)], [np.flatnonzero(repeated)]
            # blocks by anchor: the second block of an anchor brings out its first
            heads = np.flatnonzero(new_block)
            group = np.cumsum(new_anchor)[heads]
            size = np.bincount(group, minlength=int(new_anchor.sum()) + 1)
            extra = []
            carried = state["held"] is not None and not new_anchor[0]
            known = np.zeros(len(size), np.int64)
            if carried:
                known[0] = state["held"][2]
                if known[0] == 1 and size[0]:
                    extra.append(state["held"][0])
            many = (size + known) > 1
            chosen = heads[many[group]]
            picked.append(chosen)
            kinds.append(np.where(repeated[chosen], 1, 2).astype(np.int32))
            # what the next call has to know about the last anchor
            g = int(new_anchor.sum())
            if g or not carried:
                at = int(np.flatnonzero(new_anchor)[-1])
                state["held"] = ([c[at] for c in cols[:6]] + [1 if repeated[at] else 2], block[n - 1], int(size[g]))
            else:
                state["held"] = (state["held"][0], block[n - 1], int(known[0] + size[0]))
            i = np.concatenate(picked)
            arrays = [c[i] for c in cols[:5]] + [np.concatenate(kinds)]
            if extra:
                arrays = [np.append(x, [e]) for x, e in zip(arrays, [*extra[0][:5], extra[0][6]], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if k in (2, 3, 5) else x) for k, x in enumerate(arrays)], names=[*names[:5], "kind"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if (settled := cols[6] == _SPOKEN_FOR).any():
                yield pa.RecordBatch.from_arrays([*[pa.array(c[settled]) for c in cols[:5]], pa.array(np.zeros(int(settled.sum()), np.int32))], names=[*names[:5], "kind"])
                cols = [c[~settled] for c in cols]
                if not len(cols[0]):
                    continue
            if last:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            n = len(cols[0]) - 1
            if n and (out := emit(cols, n, True)) is not None:
                yield out
            last = [c[n:] for c in cols]
        if last and (out := emit(last, 1, False)) is not None:
            yield out

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.when(F.col("known") == _SPOKEN_FOR, F.xxhash64("rid", "p")).otherwise(F.col("anchor")))
    return dealt.sortWithinPartitions("anchor", "block").mapInArrow(run, _ROW + ", kind int")


def _blocks(open_rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes that each open row's suffixes cover, cut from the texts."""
    lists = open_rows.groupBy("rid").agg(F.collect_list(F.struct("p", "m", "d", "anchor", "kind", "hot")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            data, offsets = flat(piece.column("_text"))
            lists = piece.column("rows")
            each = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = lists.flatten()
            p, m, d, anchor, kind, hot = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            row = np.repeat(np.arange(len(each)), each)
            raw = data.tobytes()
            at = offsets[row] + p
            made = [raw[a : a + w] for a, w in zip(at.tolist(), (m + (length - 1)).tolist(), strict=True)]
            rid = piece.column("rid").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(p), pa.array(m), pa.array(d), pa.array(anchor), pa.array(kind), pa.array(hot), pa.array(made, pa.binary())], names=["rid", "p", "m", "d", "anchor", "kind", "hot", "bytes"])

    # a row that the table holds twice gives equal blocks twice; one of them is enough
    return docs.join(lists, "rid").select("rid", "_text", "rows").mapInArrow(run, _ROW + ", kind int, hot boolean, bytes binary")


def _suffix_keys(piece: pa.RecordBatch, length: int):
    """For every suffix of the blocks of a batch: its block's index, its place in the block, its last digit."""
    data, offsets = flat(piece.column("bytes"))
    m = piece.column("m").to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(m)), m)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    at = offsets[owner] + j
    d = piece.column("d").to_numpy(zero_copy_only=False).astype(np.int64)
    anchor = piece.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
    key = mix(span_hash(prefix_hash(data), at, at + length) + anchor[owner] * _C1 + (d[owner] - j).astype(np.uint64) * _C2)
    return owner, j, key


def _runs(piece: pa.RecordBatch, owner: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Repeated suffixes as runs."""
    begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (j[1:] != j[:-1] + 1)])) if len(owner) else np.zeros(0, np.int64)
    k = owner[begin]
    rid, p = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "p"))
    return pa.RecordBatch.from_arrays([pa.array(rid[k], pa.int64()), pa.array(p[k] + j[begin], pa.int64()), pa.array(np.diff(np.append(begin, len(owner))), pa.int32())], names=["rid", "p", "m"])


def _last_digit(blocks: DataFrame, length: int) -> DataFrame:
    """Repeated suffixes of blocks of kind 2: rid, first suffix, number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table):
            piece = t.combine_chunks().to_batches()[0]
            owner, j, key = _suffix_keys(piece, length)
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            wanted = (count[inverse] > 1) & (piece.column("kind").to_numpy(zero_copy_only=False)[owner] == 2)
            return _runs(piece, owner[wanted], j[wanted])

        for batch in slices(batches, "bytes"):
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            anchor = t.column("anchor").to_numpy()
            last = int(np.flatnonzero(anchor == anchor[-1])[0])
            if last:
                yield out(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield out(held)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = blocks.where("not hot").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "rid long, p long, m int")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "bytes"):
            owner, j, key = _suffix_keys(piece, length)
            rid, p, kind = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "p", "kind"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid[owner]), pa.array(p[owner] + j), pa.array(kind[owner])], names=["key", "rid", "p", "kind"])

    each = blocks.where("hot").mapInArrow(spread, "key long, rid long, p long, kind int")
    twice = each.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    large = each.where("kind = 2").join(twice, F.col("key") == F.col("_key")).select("rid", "p", F.lit(1).alias("m"))
    return small.unionByName(large)


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid`` (hash of id and text) and ``spans``: sorted, disjoint byte ranges [start, end) covered by strings of ``length`` bytes that start anywhere else too.

    Only rows with such ranges appear.  Null text is empty; rows that are there twice are each other's repetition.
    """
    rows = _keyed(docs, id_col, text_col)
    marks = stored(_second_digit(_first_digits(rows, length)), "anchors")
    open_rows = marks.where("kind > 0")
    sizes = open_rows.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_blocks"))
    open_rows = open_rows.join(sizes, F.col("anchor") == F.col("_anchor")).withColumn("hot", F.col("_blocks") > ROOM).drop("_anchor", "_blocks")
    edges = _last_digit(stored(_blocks(open_rows, rows, length), "blocks"), length)
    found = marks.where("kind = 0").select("rid", "p", "m").unionByName(edges)
    lists = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("a"), (F.col("p") + F.col("m") + (length - 1)).alias("b")))).alias("all"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in batch.column("all").to_pylist():
                own: list[list[int]] = []
                for s in row:
                    if own and s["a"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], s["b"])
                    else:
                        own.append([s["a"], s["b"]])
                spans.append([{"a": a, "b": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["rid", "spans"])

    return lists.mapInArrow(merge, "rid long, spans array<struct<a: bigint, b: bigint>>")


def _keyed(docs: DataFrame, id_col: str, text_col: str, extra: list[str] = ()) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra) if c != text_col])


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id) and ``kept`` (remaining bytes, binary), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row.

    Ranges are judged on the input, not on what is left, and never cross rows.  Null text counts as empty.
    """
    names = keep or [id_col]
    spans = repeated_spans(docs, length, id_col, text_col)
    joined = _keyed(docs, id_col, text_col, names).join(spans, "rid", "left")
    place = ["_text" if c == text_col else f"_c{i}" for i, c in enumerate(names)]
    schema = T.StructType([*[T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(names)], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            data, offsets = flat(piece.column("_text"))
            raw = data.tobytes()
            kept, count = [], []
            for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), piece.column("spans").to_pylist(), strict=True):
                text, at, parts = raw[a:b], 0, []
                for s in own or []:
                    parts.append(text[at : s["a"]])
                    at = s["b"]
                kept.append(b"".join([*parts, text[at:]]))
                count.append(len(own or []))
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in place], pa.array(kept, pa.binary()), pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], np.int64)), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=schema.names)

    out = joined.select("spans", *dict.fromkeys(["_text", *place])).mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
