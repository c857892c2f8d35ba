"""Vector search: a forest of random-projection trees (approximate), and pivot tables (exact).

Both compare blocks of queries with blocks of vectors, spread by hash over a grid, so that memory is bounded by two
blocks and equal vectors are one entry with their smallest ids (more than the result's length can never be needed).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

QUERY_BLOCK, BLOCK = 1024, 4096
#: vectors that trees and pivots are fitted on, at most (lowest hashes); every vector is indexed
FIT = 20_000
TREES, DEPTH, SHARE = 16, 8, 0.65
PIVOTS = 32


def _valid(vectors: DataFrame, id_col: str, vec_col: str, make: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """``id`` and ``v`` (bytes of the made vector) of the rows that take part; the first length met most often is the table's."""
    size = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    d = size["d"] if size else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, x in zip(batch.column("_id").to_pylist(), batch.column("_v").to_pylist(), strict=True):
                if i is None or x is None or len(x) != d or None in x:
                    continue
                x = np.array(x, np.float64)
                if np.isfinite(x).all() and (made := make(x)) is not None:
                    ids.append(i)
                    rows.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "v"])

    return stored(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).mapInArrow(run, "id long, v binary"), "vectors").distinct()


def _entries(valid: DataFrame, k: int) -> DataFrame:
    """Every distinct vector with its k + 1 smallest ids."""
    w = Window.partitionBy("v").orderBy("id")
    return valid.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _fit_sample(entries: DataFrame, limit: int, dtype) -> np.ndarray:
    part = max(1, entries.count() // (2 * limit))  # about twice the limit is ordered, so that no task sends more than its share
    some = entries.select("v").where(F.pmod(F.xxhash64(F.lit("fit"), "v"), F.lit(part)) == 0)
    got = some.orderBy(F.xxhash64("v"), "v").limit(limit).toPandas()["v"]
    return np.stack([np.frombuffer(v, dtype) for v in got]) if len(got) else np.zeros((0, 1), dtype)


def _best(query: int, scores: np.ndarray, at: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The k best (query, id, score) of some entries, without the query's own row."""
    if len(at) > k + 1:
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        at, scores = at[scores >= least], scores[scores >= least]
    rows = [(-s, i) for s, a in zip(scores.tolist(), at.tolist(), strict=True) for i in ids[a] if i != query]
    return [(query, i, -s) for s, i in heapq.nsmallest(k, rows)]


def _grid(queries: DataFrame, entries: DataFrame, kernel, k: int, kind: str) -> DataFrame:
    """Every block of queries with every block of entries; the k best of all blocks."""
    rows, columns = -(-max(1, queries.count()) // QUERY_BLOCK), -(-max(1, entries.count()) // BLOCK)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    x = entries.withColumn("db", F.pmod(F.xxhash64("v"), F.lit(columns)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = kernel(left, right) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64" if kind == "long" else "float64"})

    found = q.groupBy("qb", "db").cogroup(x.groupBy("qb", "db")).applyInPandas(run, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- forest ------------------------------------------------------------------------------------------------------

def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree a random direction and the sample's median along it at every inner node (children 2i+1, 2i+2)."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        nodes = (1 << depth) - 1
        way = rng.normal(size=(nodes, sample.shape[1]))
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        edge, place = np.zeros(nodes), np.zeros(len(sample), np.int64)
        for v in range(nodes):
            own = np.flatnonzero(place == v)
            p = sample[own] @ way[v]
            edge[v] = np.median(p) if len(p) else 0.0
            place[own] = np.where(p <= edge[v], 2 * v + 1, 2 * v + 2)
        forest.append((way, edge))
    return forest


def leaves(x: np.ndarray, forest) -> np.ndarray:
    """Leaf of every vector in every tree."""
    out = np.zeros((len(x), len(forest)), np.int64)
    for t, (way, edge) in enumerate(forest):
        place = np.zeros(len(x), np.int64)
        while len(x) and place[0] < len(edge):
            place = 2 * place + 1 + (np.einsum("ij,ij->i", x, way[place]) > edge[place])
        out[:, t] = place - len(edge)
    return out


def opened(q: np.ndarray, forest, members: np.ndarray, share: float) -> np.ndarray:
    """Leaves of all trees that one query opens: one queue for all trees, nearest cuts first, until they hold ``share`` of the sample."""
    margins = [way @ q - edge for way, edge in forest]
    inner = len(forest[0][1])
    out = np.zeros((len(forest), inner + 1), bool)
    queue, held = [(0.0, t, 0) for t in range(len(forest))], np.zeros(members.shape[-1], bool)
    while queue and held.sum() < share * len(held):
        far, t, v = heapq.heappop(queue)
        while v < inner:
            m = margins[t][v]
            near, other = (2 * v + 1, 2 * v + 2) if m <= 0 else (2 * v + 2, 2 * v + 1)
            heapq.heappush(queue, (far + m * m, t, other))
            v = near
        out[t, v - inner] = True
        held |= members[t, v - inner]
    if not len(held):
        out[:] = True
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for rows whose id is divisible by ``every`` the k largest inner products found.

    Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part; so do
    vectors of another length than most.  A row that repeats id and vector is one row.  Ties go to the smaller id.
    ``share`` is how much of the fitted sample the opened leaves hold: directions without any cluster need 0.55
    for a recall of 0.9 (0.65 for 0.96), clustered vectors far less.
    """
    valid = _valid(vectors, id_col, vec_col, lambda x: x if np.any(x != 0) else None)
    entries = stored(_entries(valid, k), "entries")
    sample = _fit_sample(entries, FIT, np.float64)
    depth = max(1, min(depth, int(np.log2(max(2, len(sample) / 8)))))
    forest = grow(sample, trees, depth)
    code = leaves(sample, forest)
    members = np.zeros((trees, 1 << depth, len(sample)), bool)
    for t in range(trees):
        members[t, code[:, t], np.arange(len(sample))] = True
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((forest, np.packbits(members, axis=-1), len(sample)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v, np.float64) for v in batch.column("v").to_pylist()])
                code = leaves(x, shared.value[0]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array([c.tobytes() for c in code], pa.binary())], names=["v", "ids", "leaf"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, packed, n = shared.value
        members = np.unpackbits(packed, axis=-1, count=n).astype(bool)
        for batch in batches:
            found = [np.packbits(opened(np.frombuffer(v, np.float64), forest, members, share)).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(found, pa.binary())], names=["id", "v", "open"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        q, x = (np.stack([np.frombuffer(v, np.float64) for v in side["v"]]) for side in (left, right))
        code = np.stack([np.frombuffer(c, np.uint8) for c in right["leaf"]])
        open_leaves = np.stack([np.unpackbits(np.frombuffer(o, np.uint8))[: trees << depth] for o in left["open"]]).reshape(len(q), trees, -1).astype(bool)
        candidate = np.zeros((len(q), len(x)), bool)
        for t in range(trees):
            candidate |= open_leaves[:, t][:, code[:, t]]
        product, ids, out = q @ x.T, right["ids"].tolist(), []
        for i, query in enumerate(left["id"].tolist()):
            at = np.flatnonzero(candidate[i])
            if len(at) > 2 * k + 2:  # products of a block differ from exact sums in the last bits: a little more is summed again
                near = product[i, at]
                least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                at = at[near >= least - 1e-9 * max(1.0, abs(least))]
            out += _best(query, (x[at] * q[i]).sum(1), at, ids, k)
        return out

    queries = valid.where(F.col("id") % every == 0)
    looked = stored(queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").mapInArrow(search, "id long, v binary, open binary"), "queries")
    return _grid(looked, stored(entries.mapInArrow(index, "v binary, ids array<long>, leaf binary"), "leaves"), kernel, k, "double")


# --- pivots ------------------------------------------------------------------------------------------------------

def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def exact_top(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest integer inner products of the vectors floor(scale * x).

    Distances of all vectors to the pivots are a table; the largest difference of two rows bounds a pair's distance from
    below, and with it the product from above.  Candidates are evaluated by falling bound until the next bound is below
    the k-th product found.  Vectors that are null or hold null or non-finite components, rows without an id, and
    vectors of another length than most take no part.  A row that repeats id and vector is one row; ties go to the
    smaller id.  Products must stay below 2^63.
    """
    valid = _valid(vectors, id_col, vec_col, lambda x: np.floor(scale * x).astype(np.int64))
    entries = stored(_entries(valid, k), "entries")
    pivots = vectors.sparkSession.sparkContext.broadcast(_fit_sample(entries, PIVOTS, np.int64).astype(np.float64))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v, np.int64) for v in batch.column("v").to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in _distances(x, pivots.value)], pa.binary())], names=[*batch.schema.names, "far"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        q, x = (np.stack([np.frombuffer(v, np.int64) for v in side["v"]]) for side in (left, right))
        fq, fx = (np.stack([np.frombuffer(v, np.float64) for v in side["far"]]) for side in (left, right))
        lower = np.zeros((len(q), len(x)))
        for p in range(fq.shape[1]):
            np.maximum(lower, np.abs(fq[:, p, None] - fx[None, :, p]), out=lower)
        nq, nx = (q.astype(np.float64) ** 2).sum(1), (x.astype(np.float64) ** 2).sum(1)
        size = nq[:, None] + nx[None, :]
        upper = (size - lower * lower) / 2 + 1e-9 * size + 1
        small = max(np.abs(q).max(), np.abs(x).max()) < 1 << 22  # such products are exact in doubles
        xs, ids, out = x.astype(np.float64) if small else x, right["ids"].tolist(), []
        for i, query in enumerate(left["id"].tolist()):
            order = np.argsort(-upper[i])
            own, at, scores = q[i].astype(xs.dtype), order[:0], np.zeros(0, np.int64)
            for begin in range(0, len(order), 512):
                part = order[begin : begin + 512]
                at, scores = np.append(at, part), np.append(scores, (xs[part] @ own).astype(np.int64))
                if len(scores) > k:
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    at, scores = at[scores >= least], scores[scores >= least]
                    if begin + 512 < len(order) and upper[i, order[begin + 512]] < least:
                        break
            out += _best(query, scores, at, ids, k)
        return out

    queries = stored(valid.where(F.col("id") % every == 0).mapInArrow(table, "id long, v binary, far binary"), "queries")
    return _grid(queries, stored(entries.mapInArrow(table, "v binary, ids array<long>, far binary"), "table"), kernel, k, "long")
