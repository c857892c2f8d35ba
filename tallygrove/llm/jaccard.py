"""N-gram Jaccard join: all links between documents whose word shingle sets reach a Jaccard similarity.

A document is the sorted array of its shingle hashes and a bitmap of 512 bits (parity of the hashes in each bit).  Two
bitmaps that differ in x bits prove that at least x shingles are in one set only, which bounds the overlap from above.
Pairs that pass are tried again with a bitmap of four bits for each shingle, as long as the size band asks for.
Documents meet in tiles: a tile holds the documents with one shingle in the part of their set that two similar
documents must share (the first fifth, rare shingles first).  Tiles are cut in blocks, and a pair of blocks writes only
the pairs that size, position and bitmap leave open; what is left is decided by intersecting the sorted arrays.

Groups of near copies never become all pairs: equal sets are one class from the start; each of four pairs of minimum
hashes links its classes to one of them (checked exactly); and tiles hold the linked groups instead of their members,
so that only different groups are compared.
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
from .pairs import open_pairs
from .store import stored
from .text import LOWER, flat, mix, prefix_hash, slices, span_hash, word_spans

BITS, KEYS = 512, 4
_WORDS = [f"b{i}" for i in range(BITS // 64)]
_ODD = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: one row in so many is looked at, and entries kept, to find out which shingles are common; this only orders shingles, it drops none
SAMPLE, COMMON = 32, 500_000


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and where each row begins.

    Words are lower-cased (A-Z); a row with fewer words than ``width`` has the whole sequence as its one shingle, a row
    without words has none.
    """
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hash(prefix_hash(data), starts, ends)
    count = np.diff(first)
    n = len(words)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h[: n - j] += words[j:] * _ODD[j]
    h = mix(h)
    rows = []
    for a, k in zip(first[:-1].tolist(), count.tolist(), strict=True):
        if k >= width:
            rows.append(np.unique(h[a : a + k - width + 1]))
        elif k:
            rows.append(mix(np.sum(words[a : a + k] * _ODD[:k], keepdims=True) + _ODD[width + k : width + k + 1]))
        else:
            rows.append(np.zeros(0, np.uint64))
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _common_shingles(docs: DataFrame, text_col: str, id_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles by a sample, at most ``COMMON`` of them, and how common: the logarithm of their count.

    A fixed share of the rows is looked at, so that what counts as rare is in as many rows at any size of the table.
    """
    part = docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(SAMPLE)) == 0).select(F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(piece.column("_text"), width)[0].view(np.int64))], names=["h"])

    counts = part.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    got = counts.orderBy(F.col("n").desc(), "h").limit(COMMON).select("h", F.floor(F.log2("n")).cast("byte").alias("level")).toPandas()
    h, level = got["h"].to_numpy(np.int64).view(np.uint64), got["level"].to_numpy(np.uint8)
    order = np.argsort(h)
    return h[order], level[order]


def _features(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: id, hash of the text, class (hash of the whole set, null without words), size, first part of the set, bitmap, minimum hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    longs = [*_WORDS, *[f"k{i}" for i in range(KEYS)]]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("head", T.BinaryType()), T.StructField("sig", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = np.append(shared.value[0], np.uint64((1 << 64) - 1)), np.append(shared.value[1], np.uint8(0))
        for piece in slices(batches, "_text"):
            h, first = shingle_sets(piece.column("_text"), width)
            sizes = np.diff(first)
            at = np.searchsorted(often[:-1], h)
            late = np.where(often[at] == h, level[at], 0)
            heads, classes, signatures = [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own, last, n = h[a:b], late[a:b], b - a
                need = n - -(-n * percent // 100) + 1 if n else 0
                front = own[np.argsort(last, kind="stable")[:need]] if last.any() else own[:need]  # rarer ones first
                heads.append(front.tobytes())
                signatures.append(_signature(own))
                classes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            parity = np.bincount(rows * BITS + (h & np.uint64(BITS - 1)).astype(np.int64), minlength=len(sizes) * BITS) & 1
            bitmap = np.packbits(parity.astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little").view(np.int64)
            full = np.flatnonzero(sizes)
            lows = np.zeros((2 * KEYS, len(sizes)), np.uint64)
            for j in range(2 * KEYS):
                if len(full):
                    lows[j, full] = np.minimum.reduceat(mix(h * _ODD[20 + j]), first[full])
            keys = [mix(lows[2 * i] * _ODD[40] + lows[2 * i + 1] * _ODD[41] + _ODD[42 + i]).view(np.int64) for i in range(KEYS)]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("th"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary()), pa.array(signatures, pa.binary()), *[pa.array(np.ascontiguousarray(bitmap[:, i])) for i in range(BITS // 64)], *[pa.array(k) for k in keys]], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("th")).mapInArrow(run, schema)


def _may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and bitmaps allow: overlap <= (n_a + n_b - differing bits) / 2, and it must reach percent / (100 + percent) of n_a + n_b."""
    na, nb = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
    differ = sum((F.bit_count(F.col(a + w).bitwiseXOR(F.col(b + w))) for w in _WORDS), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & ((na + nb - differ) * (100 + percent) >= (na + nb) * (2 * percent))


def _signature(h: np.ndarray) -> bytes:
    """Parity bitmap with at least four bits for each shingle: its length goes with the set's size band."""
    bits = 1 << max(8, (4 * len(h) - 1).bit_length())
    parity = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _sieved(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs that the long bitmaps leave open; a longer one is folded to the other's length first."""
    side = lambda c, n, sig: members.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("sig").alias(sig))
    both = pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) < len(y):
                    x, y = y, x
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append((na + nb - int(np.bitwise_count(x ^ y).sum())) * (100 + percent) >= (na + nb) * 2 * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs of classes (``a``, ``b``) that link, by exact intersection of their sorted arrays."""
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(reps, "cls")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    texts = need.join(rows, (F.col("rep.th") == F.col("_th")) & F.col("rep.id").eqNullSafe(F.col("_id"))).select("cls", "_text")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("_text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("_text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "ta"):
            x, xs = shingle_sets(piece.column("ta"), width)
            y, ys = shingle_sets(piece.column("tb"), width)
            keep = []
            for i in range(piece.num_rows):
                p, q = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                keep.append(same * 100 >= (len(p) + len(q) - same) * percent)
            yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _near_copies(members: DataFrame, percent: int) -> DataFrame:
    """Candidate links of classes with the smallest class that has the same pair of minimum hashes; the minimum is combined before it moves."""
    keyed = members.select("cls", "n", *_WORDS, F.posexplode(F.array(*[F.col(f"k{i}") for i in range(KEYS)])).alias("slot", "key"))
    centre = keyed.groupBy("slot", "key").agg(F.min(F.struct("cls", "n", *_WORDS)).alias("c"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    centre = centre.select(F.col("slot").alias("_slot"), F.col("key").alias("_key"), F.col("c.cls").alias("c_cls"), F.col("c.n").alias("c_n"), *[F.col(f"c.{w}").alias(f"c_{w}") for w in _WORDS])
    joined = keyed.join(centre, (F.col("slot") == F.col("_slot")) & (F.col("key") == F.col("_key")) & (F.col("cls") != F.col("c_cls")) & _may_link("", "c_", percent))
    return joined.select(F.col("c_cls").alias("a"), F.col("cls").alias("b")).distinct()


def _tile_rows(heads: DataFrame) -> DataFrame:
    """One row per shingle of the first parts and group: token, group, first position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "head", 1 << 22):
            data, offsets = flat(piece.column("head"))
            token = data.view(np.int64)
            each = np.diff(offsets) // 8
            group = np.repeat(piece.column("grp").to_numpy(zero_copy_only=False), each)
            place = (np.arange(len(token)) - np.repeat(offsets[:-1] // 8, each)).astype(np.int32)
            if len(token):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _each_once(token, group, place, np.lexsort((token, group)))], names=["token", "grp", "pos"])

    return heads.mapInArrow(run, "token long, grp long, pos int")


def _each_once(token: np.ndarray, group: np.ndarray, place: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each run of equal (token, group), with its smallest place."""
    if order is not None:
        token, group, place = token[order], group[order], place[order]
    begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])))
    return token[begin], group[begin], np.minimum.reduceat(place, begin)


def _shared_tokens(tiles: DataFrame) -> DataFrame:
    """The tile rows of tokens that more than one group has, once each; a task holds one row of a tile at a time, however large it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row, which may go on; whether its token was there before it
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
            token, group, place = _each_once(*columns)
            same = token[1:] == token[:-1]
            keep = np.append(same, False) | np.append(again, same)
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (token, group, place)], names=["token", "grp", "pos"])
            held, again = [x[-1:] for x in (token, group, place)], bool(keep[-1])
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["token", "grp", "pos"])

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "token").sortWithinPartitions("token", "grp").mapInArrow(run, "token long, grp long, pos int")


def _group_facts(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: smallest and largest size, its root's bitmap, and in how many bits members differ from that at most."""
    placed = members.select("cls", "n", *_WORDS).join(groups, "cls", "left").withColumn("grp", F.coalesce("root", "cls"))
    roots = placed.where("cls = grp").select(F.col("grp").alias("_grp"), *[F.col(w).alias(f"r_{w}") for w in _WORDS])
    far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"r_{w}"))) for w in _WORDS), F.lit(0))
    sums = placed.join(roots, F.col("grp") == F.col("_grp")).groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(far).alias("slack"))
    return sums.join(roots, F.col("grp") == F.col("_grp")).select("grp", "lo", "hi", "slack", *[F.col(f"r_{w}").alias(w) for w in _WORDS])


def _tile_pairs(tiles: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (``ga``, ``gb``) that meet in a tile and that sizes, positions and bitmaps leave open; large tiles are cut in blocks."""
    shared = stored(_shared_tokens(tiles), "shared")
    met = shared.join(facts.withColumnRenamed("grp", "id"), F.col("grp") == F.col("id")).withColumnRenamed("token", "key")
    return open_pairs(met, _WORDS, percent).toDF("ga", "gb")


def _smaller_first(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Each pair with its smaller group as ``ga``: the larger one is met in the join that sizes and bitmaps cut down."""
    sizes = groups.groupBy(F.col("root").alias("_root")).agg(F.count(F.lit(1)).alias("_k"))
    side = lambda c, k: sizes.select(F.col("_root").alias(f"_{c}"), F.col("_k").alias(k))
    d = pairs.join(side("ga", "ka"), F.col("ga") == F.col("_ga"), "left").join(side("gb", "kb"), F.col("gb") == F.col("_gb"), "left")
    swap = F.coalesce("ka", F.lit(1)) > F.coalesce("kb", F.lit(1))
    return d.select(F.when(swap, F.col("gb")).otherwise(F.col("ga")).alias("ga"), F.when(swap, F.col("ga")).otherwise(F.col("gb")).alias("gb"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``class_id`` (equal sets share it), ``component_id`` (smallest id reachable by links, its own included).

    Two rows link when 100 * intersection >= percent * union.  Null, empty or blank text has an empty set, a null class
    and links with nothing.  Repeated rows are one class.  A null id never is a component's smallest unless all are
    null.  Columns of the input other than id and text are left out; an empty table gives an empty result.
    """
    common = _common_shingles(docs, text_col, id_col, width)
    rows = stored(_features(docs, common, id_col, text_col, width, percent), "shingles")
    full = rows.where("n > 0")
    members = stored(full.select("cls", "n", "head", "sig", *_WORDS, *[f"k{i}" for i in range(KEYS)]).dropDuplicates(["cls"]), "classes")
    reps = full.groupBy("cls").agg(F.min(F.struct("th", "id")).alias("rep"))
    check = lambda pairs: stored(_verified(stored(_sieved(pairs, members, percent), "pairs"), docs, reps, id_col, text_col, width, percent), "links")
    first = check(_near_copies(members, percent))
    groups = components(first, "a", "b").withColumnRenamed("node", "cls")
    heads = members.select("cls", "head").join(groups, "cls", "left").select(F.coalesce("root", "cls").alias("grp"), "head")
    met = _smaller_first(stored(_tile_pairs(_tile_rows(heads), _group_facts(members, groups), percent), "tiles"), groups)
    slim = members.join(groups, "cls", "left").select(F.coalesce("root", "cls").alias("grp"), "cls", "n", *_WORDS)
    side = lambda p: slim.select([F.col(c).alias(p + c) for c in slim.columns])
    left = met.join(side("x_"), F.col("ga") == F.col("x_grp"))
    open_pairs = left.join(side("y_"), (F.col("gb") == F.col("y_grp")) & _may_link("x_", "y_", percent)).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"))
    second = check(open_pairs)
    roots = components(first.union(second), "a", "b")
    out = rows.select("id", "cls", "n").join(roots, rows["cls"] == roots["node"], "left").withColumn("root", F.coalesce("root", "cls"))
    out = stored(out.select("id", "cls", "n", "root"), "roots")
    smallest = out.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("_least"))
    return out.join(smallest, out["root"] == smallest["_root"], "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("cls").alias("class_id"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("_least")).alias("component_id"))
