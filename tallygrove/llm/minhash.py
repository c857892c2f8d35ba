"""MinHash near-duplicates by tensored banding.

Two collections of ``side`` hashes are computed, each hash made of ``depth`` minimum hashes; a table's key is one hash
of the first collection together with one of the second, so side * side tables of 2 * depth minimum hashes cost only
2 * side * depth of them instead of 2 * side * side * depth.  Two sets meet in a table when some hash of either
collection agrees: at similarity s they are missed with a probability below 2 * (1 - s^depth)^side.

Equal sets are one class from the start.  In a table every class is compared with one centre, groups that linked are
contracted, and what still shares a table with another group is compared in blocks, bitmaps first.  Every link is
confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .jaccard import BITS, shingle_sets
from .pairs import confirm, open_pairs
from .store import stored
from .text import mix, slices

SIDE, DEPTH, WIDTH, PERCENT = 10, 3, 2, 80
#: rounds in which the classes of a table are compared with one centre, before whole blocks are
STARS = 3
_WORDS = [f"w{i}" for i in range(BITS // 64)]


def collections(h: np.ndarray, first: np.ndarray, side: int, depth: int, seed: int = 12) -> np.ndarray:
    """For each set (slice of ``h``) its 2 * ``side`` hashes, each of ``depth`` minimum hashes; 0 for an empty set."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 63, (2 * side, depth), dtype=np.uint64) | np.uint64(1)
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, 2 * side), np.uint64)
    for c in range(2 * side if len(full) else 0):
        key = np.full(len(full), np.uint64(c + 1))
        for k in range(depth):
            key = mix(key * odd[0, 0] + np.minimum.reduceat(mix(h * odd[c, k]), first[full]))
        out[full, c] = key
    return out


def _features(docs: DataFrame, id_col: str, text_col: str, width: int, side: int, depth: int) -> DataFrame:
    """Per row: id, hash of the text, class (hash of the whole set, null without words), size, both collections, bitmap."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("x", T.ArrayType(T.LongType())), T.StructField("y", T.ArrayType(T.LongType())), *[T.StructField(w, T.LongType()) for w in _WORDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            h, first = shingle_sets(piece.column("_text"), width)
            sizes = np.diff(first)
            classes = [int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            both = collections(h, first, side, depth).view(np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            parity = np.bincount(rows * BITS + (h & np.uint64(BITS - 1)).astype(np.int64), minlength=len(sizes) * BITS) & 1
            bitmap = np.packbits(parity.astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little").view(np.int64)
            cut = pa.array(np.arange(0, side * len(sizes) + 1, side, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.ascontiguousarray(m).ravel())) for m in (both[:, :side], both[:, side:])]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("th"), pa.array(classes, pa.int64()), pa.array(sizes.astype(np.int64)), *lists, *[pa.array(np.ascontiguousarray(bitmap[:, i])) for i in range(len(_WORDS))]], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("th")).mapInArrow(run, schema)


def _tables(members: DataFrame) -> DataFrame:
    """``key``, ``slot`` (which table) and ``cls`` of every key that more than one class has, with ``centre``, the smallest of them."""
    tensor = F.flatten(F.transform("x", lambda u, i: F.transform("y", lambda v, j: F.xxhash64(u, v, i, j))))
    keyed = members.select(F.posexplode(tensor).alias("slot", "key"), "cls")
    # the smallest class and the count are combined before they move, so that a key of many classes is a row per task
    crowded = keyed.groupBy(F.col("key").alias("_key")).agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return stored(keyed.join(crowded, keyed["key"] == crowded["_key"]).select("key", "slot", "cls", "centre"), "tables")


def _sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``cls`` and its sorted shingle hashes ``h``, made again from one text of each class in ``need`` (``cls``, ``rep``)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    texts = rows.join(need, (F.col("rep.th") == F.col("_th")) & F.col("rep.id").eqNullSafe(F.col("_id"))).select("cls", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            h, first = shingle_sets(piece.column("_text"), width)
            yield pa.RecordBatch.from_arrays([piece.column("cls"), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["cls", "h"])

    return stored(texts.mapInArrow(run, "cls long, h binary"), "sets")


def _may_link(percent: int) -> Column:
    """What sizes and bitmaps of ``a`` and ``b`` allow."""
    na, nb = F.col("a_n"), F.col("b_n")
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in _WORDS), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & ((na + nb - differ) * (100 + percent) >= (na + nb) * (2 * percent))


def _sieved(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    side = lambda c: members.select(F.col("cls").alias(f"{c}_cls"), *[F.col(k).alias(f"{c}_{k}") for k in ("n", *_WORDS)])
    met = pairs.join(side("a"), F.col("a") == F.col("a_cls")).join(side("b"), (F.col("b") == F.col("b_cls")) & _may_link(percent))
    return met.select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included), ``kept`` (the id is its component's).

    Two rows link when 100 * intersection >= percent * union of their sets of ``width``-word shingles (the whole
    sequence when there are fewer words); links are confirmed on the full sets.  Null, empty or blank text has an empty
    set and links with nothing.  Repeated rows are one class.  A null id never is a component's smallest unless all are
    null; then ``kept`` is true.  A text of any length is one set.  Other columns are left out, whatever their names;
    an empty table gives an empty result.
    """
    rows = stored(_features(docs, id_col, text_col, width, side, depth), "features")
    full = rows.where("cls is not null")
    members = stored(full.dropDuplicates(["cls"]).drop("id", "th"), "classes")
    tables = _tables(members)
    reps = full.select("cls", "th", "id").join(tables.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("th", "id")).alias("rep"))
    sets = _sets(docs, reps, id_col, text_col, width)
    tried = stored(_sieved(tables.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), members, percent), "pairs")
    links = stored(confirm(tried, sets, percent), "links")
    for turn in range(STARS):
        groups = components(links, "a", "b").withColumnRenamed("node", "cls")
        placed = tables.select("key", "slot", "cls").join(groups, "cls", "left").select("key", "slot", "cls", F.coalesce("root", "cls").alias("grp"))
        split = placed.groupBy(F.col("key").alias("_key")).agg(F.min("grp").alias("_least"), F.max("grp").alias("_most")).where("_least <> _most")
        mixed = stored(placed.join(split, placed["key"] == split["_key"]).select("key", "slot", "cls", "grp", "_most"), "mixed")
        if turn + 1 == STARS:
            break
        # another centre, from another group
        centres = mixed.where("grp = _most").groupBy(F.col("key").alias("_key")).agg(F.max("cls").alias("_centre"))
        met = mixed.where("grp <> _most").join(centres, F.col("key") == F.col("_key")).select(F.least("cls", "_centre").alias("a"), F.greatest("cls", "_centre").alias("b")).distinct()
        more = stored(_sieved(met.join(tried, ["a", "b"], "left_anti"), members, percent), "pairs")
        tried, links = tried.union(more), links.union(stored(confirm(more, sets, percent), "links"))
    marks = [[f"{c}{i}" for i in range(side)] for c in "xy"]
    none = F.lit(0)
    flat = members.select(F.col("cls").alias("id"), F.col("n").alias("lo"), F.col("n").alias("hi"), none.alias("slack"), none.alias("pos"), *_WORDS, *[F.col(c)[i].alias(f"{c}{i}") for c in "xy" for i in range(side)])
    rest = mixed.select("key", "slot", "cls", "grp").join(flat, F.col("cls") == F.col("id")).drop("cls")
    left = stored(open_pairs(rest, _WORDS, percent, tuple(marks)).join(tried, ["a", "b"], "left_anti"), "pairs")
    roots = components(links.union(confirm(left, sets, percent)), "a", "b")
    out = rows.select("id", "cls", "n").join(roots, rows["cls"] == roots["node"], "left").select("id", "n", F.coalesce("root", "cls").alias("root"))
    out = stored(out, "roots")
    smallest = out.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("_least"))
    linked = out.join(smallest, out["root"] == smallest["_root"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("_least")).alias("component_id"))
    return linked.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
