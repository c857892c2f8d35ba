"""Conversation prefix trie: a Z-fast trie over rebuilt conversations.

A conversation is a sequence of turns; its prefix of d turns is named by a 128-bit key, a hash of d running sums, so
that equal prefixes have equal keys wherever they stand.  A task inserts its conversations, batch by batch, into a
Z-fast trie: a compacted node spans the depths (low, ext] of one path and is found in a hash table by the key at its
handle, the 2-fattest depth of that span, so that the exit node of a conversation of n turns takes about log n lookups
(fat binary search).  At the end the edges are expanded into one row per prefix with its counts, which are added up
over tasks: the tries combine what many conversations share before it moves.

Sums over subtrees use that prefixes with the same smallest conversation lie on one path.  Such paths form a small
tree; totals go up it by pointer doubling, and along a path by running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranking import group_row_number
from ..session import cut_lineage
from .store import stored
from .text import mix

GROUP, FOLD = 100, 6
#: turns of a conversation in one row; a longer conversation is several rows, each a path below its first prefix
CHUNK = 1024
#: turns that a task's trie takes in before it is written out
ROOM = 400_000
_NODE = "conv long, k1 long, k2 long, p1 long, p2 long, depth long, n long, points long"


def fattest(low: int, high: int) -> int:
    """The 2-fattest number of (low, high]: that with the most trailing zeros."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: the prefixes of depths ``low`` + 1 to ``ext`` of a path; ``keys[d - base]`` is that of depth d."""

    __slots__ = ("low", "ext", "base", "keys", "points", "parent", "n", "least")

    def __init__(self, low, ext, base, keys, points, parent):
        self.low, self.ext, self.base, self.keys, self.points, self.parent = low, ext, base, keys, points, parent
        self.n, self.least = 0, None

    def handle(self):
        return self.keys[fattest(self.low, self.ext) - self.base]


class ZFastTrie:
    def __init__(self):
        self.roots, self.handles, self.branches, self.nodes, self.turns, self.probes = {}, {}, {}, [], 0, 0

    def exit_of(self, base: int, keys: list) -> tuple[Node, Node | None, int]:
        """Deepest node whose prefix the conversation has whole, the edge below it that it leaves on, and the depth it follows to."""
        end, node = base + len(keys) - 1, self.roots[keys[0]]
        low, high = base, end
        while low < high:
            f = fattest(low, high)
            found = self.handles.get(keys[f - base])
            self.probes += 1
            if found is not None and found.ext <= end and found.keys[found.ext - found.base] == keys[found.ext - base]:
                node, low = found, found.ext
            else:
                high = f - 1
        edge = self.branches.get(keys[node.ext + 1 - base]) if node.ext < end else None
        same, over = node.ext, min(edge.ext, end) + 1 if edge else node.ext + 1
        while over - same > 1:
            d = (same + over) // 2
            same, over = (d, over) if edge.keys[d - edge.base] == keys[d - base] else (same, d)
        return node, edge, same

    def _name(self, node: Node) -> None:
        self.handles[node.handle()] = node
        self.branches[node.keys[node.low + 1 - node.base]] = node

    def insert(self, conv: int, base: int, keys: list, points: list) -> None:
        """A conversation (or its part from depth ``base`` on): keys of depths ``base`` to its end, code points of each turn."""
        if keys[0] not in self.roots:
            self.roots[keys[0]] = Node(base - 1, base, base, keys, points, None)
            self.nodes.append(self.roots[keys[0]])
        node, edge, same = self.exit_of(base, keys)
        if same > node.ext:  # it leaves within the edge, which is cut there
            upper = Node(edge.low, same, edge.base, edge.keys, edge.points, edge.parent)
            del self.handles[edge.handle()]
            edge.low, edge.parent = same, upper
            self._name(upper)
            self._name(edge)
            self.nodes.append(upper)
            node = upper
        end = base + len(keys) - 1
        if node.ext < end:
            leaf = Node(node.ext, end, base, keys, points, node)
            self._name(leaf)
            self.nodes.append(leaf)
            node = leaf
        node.n += 1
        node.least = conv if node.least is None else min(conv, node.least)
        self.turns += len(keys)

    def expanded(self) -> pa.RecordBatch:
        """One row per prefix: smallest conversation, key, key of the parent, depth, conversations, code points of its last turn."""
        for node in sorted(self.nodes, key=lambda x: -x.ext):
            if node.parent is not None:
                up = node.parent
                up.n += node.n
                up.least = node.least if up.least is None else min(up.least, node.least)
        rows = []
        for x in self.nodes:
            if x.parent is None and x.base == 0:
                rows.append((x.least, *x.keys[0], 0, 0, 0, x.n, 0))
            for d in range(x.low + 1 if x.parent is not None else x.ext + 1, x.ext + 1):
                rows.append((x.least, *x.keys[d - x.base], *x.keys[d - 1 - x.base], d, x.n, x.points[d - 1 - x.base]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["conv", "k1", "k2", "p1", "p2", "depth", "n", "points"])


def _hashed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % FOLD).cast("int")


def rebuilt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``at`` (from 1; a row 0 for every conversation), ``length``, ``a``, ``b`` (hashes of the turn), ``points``: the first turns of the group's first conversation, then the own ones."""
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"), F.char_length(text).cast("long").alias("points"))
    slim = stored(slim.withColumns({"a": F.xxhash64("role", "digest"), "b": F.xxhash64(F.lit(3), "role", "digest")}), "turns")
    ranked = stored(group_row_number(slim, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "rank").select("conv", "rank", "a", "b", "points"), "ranks")
    heads = ranked.where((F.col("conv") % GROUP == 0) & (F.col("rank") < FOLD)).groupBy(F.col("conv").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "points"))).alias("_head"))
    convs = ranked.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumn("h", _hashed(F.col("conv")))
    convs = convs.join(heads, F.col("conv") - F.col("conv") % GROUP == F.col("_base"), "left")
    convs = convs.select("conv", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("_head", F.array()), 1, F.greatest("h", F.lit(1)))).otherwise(F.array()).alias("head"), "own")
    convs = stored(convs.withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "heads")
    start = F.struct(F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("points"))
    first = convs.select("conv", "length", F.explode(F.concat(F.array(start), "head")).alias("t")).select("conv", F.col("t.rank").alias("at"), "length", "t.a", "t.b", "t.points")
    sizes = convs.select(F.col("conv").alias("_conv"), "h", F.size("head").alias("given"), "length")
    own = ranked.join(sizes, ranked["conv"] == sizes["_conv"]).where("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("given")).alias("at"), "length", "a", "b", "points")
    return first.unionByName(own)


def _pieces(turns: DataFrame, chunk: int) -> DataFrame:
    """At most ``chunk`` turns a row, with the four sums of what goes before."""
    low = F.lit((1 << 32) - 1)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = turns.withColumn("piece", F.greatest(F.floor((F.col("at") - 1) / chunk), F.lit(0)))
    t = t.withColumns({"u": F.when(F.col("at") > 0, F.xxhash64("at", "a", "b")).otherwise(0), "v": F.when(F.col("at") > 0, F.xxhash64(F.lit(11), "at", "b", "a")).otherwise(0), "near": F.floor(F.col("conv") / GROUP)})
    # neighbours share first turns: they go to one task, piece by piece
    rows = t.repartition(n, "near", "piece").groupBy("near", "piece", "conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "u", "v", "points"))).alias("turns"), F.max("length").alias("length"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate([F.col("u").bitwiseAND(low), F.shiftrightunsigned("u", 32), F.col("v").bitwiseAND(low), F.shiftrightunsigned("v", 32)])])
    rows = stored(rows, "pieces")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.where(F.col("length") > chunk).select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), *[F.sum(f"s{i}").over(before).alias(f"f{i}") for i in range(4)])
    joined = rows.join(ahead, (F.col("conv") == F.col("_conv")) & (F.col("piece") == F.col("_piece")), "left")
    return joined.select("conv", "piece", "length", "turns", *[F.coalesce(f"f{i}", F.lit(0)).alias(f"f{i}") for i in range(4)])


def _keys(u: np.ndarray, v: np.ndarray, at: np.ndarray, cut: np.ndarray, before: np.ndarray, begin: np.ndarray) -> list[list[tuple]]:
    """Keys of each row's prefixes, from that which it starts at."""
    low = np.int64((1 << 32) - 1)
    parts = np.stack([u & low, u.view(np.uint64) >> np.uint64(32), v & low, v.view(np.uint64) >> np.uint64(32)], axis=1).astype(np.int64)
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(parts, axis=0)])
    out = []
    for i in range(len(cut) - 1):
        s = (sums[cut[i] : cut[i + 1] + 1] - sums[cut[i]] + before[i]).view(np.uint64)
        depth = np.arange(len(s), dtype=np.uint64) + np.uint64(begin[i])
        a, b = np.zeros(len(s), np.uint64), depth.copy()
        for c in range(4):
            a = mix(a * np.uint64(0x9E3779B97F4A7C15) + s[:, c] + depth)
            b = mix(b * np.uint64(0xD1342543DE82EF95) + s[:, 3 - c] + np.uint64(c))
        out.append(list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)))
    return out


def _partial(pieces: DataFrame, chunk: int, room: int) -> DataFrame:
    """Rows of the tasks' expanded tries, and for each conversation a row without ``n`` that has its last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("turns")
            flat = lists.flatten()
            at, u, v, points = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            whole = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            real = at > 0  # the row 0 of a conversation only says that it is there
            cut = np.concatenate([[0], np.cumsum(real)])[whole]
            at, u, v, points = at[real], u[real], v[real], points[real]
            before = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            convs, numbers, lengths = (batch.column(c).to_pylist() for c in ("conv", "piece", "length"))
            last = []
            for i, keys in enumerate(_keys(u, v, at, cut, before, np.array(numbers, np.int64) * chunk)):
                base = numbers[i] * chunk
                trie.insert(convs[i], base, keys, points[cut[i] : cut[i + 1]].tolist())
                if base + len(keys) - 1 == lengths[i]:
                    last.append((convs[i], *keys[-1]))
                if trie.turns >= room:
                    yield trie.expanded()
                    trie = ZFastTrie()
            ends = [pa.array(c, pa.int64()) for c in zip(*last, strict=True)] if last else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*ends, *[pa.nulls(len(ends[0]), pa.int64())] * 5], names=["conv", "k1", "k2", "p1", "p2", "depth", "n", "points"])
        yield trie.expanded()

    return stored(pieces.mapInArrow(run, _NODE), "tries")


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each prefix's sorted conversations, comma-joined; many of one prefix are hashed as a sorted stream."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = ends.groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2")).agg(F.count(F.lit(1)).alias("_n"), F.min("conv").alias("_one"))
    alone = counts.where("_n = 1").select("e1", "e2", F.sha2(F.col("_one").cast("string").cast("binary"), 256).alias("ends"))
    many = ends.join(counts.where("_n > 1"), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2"))).select("e1", "e2", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["e1", "e2", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            e1, e2, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = [0, *(np.flatnonzero((e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])) + 1).tolist(), len(conv)]
            done = []
            for a, b in zip(edges, edges[1:], strict=False):
                name, text = (int(e1[a]), int(e2[a])), ",".join(map(str, conv[a:b].tolist())).encode()
                if name == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = name, hashlib.sha256(text)
            if done:
                yield out(done)
        if now is not None:
            yield out([(*now, digest.hexdigest())])

    return alone.union(many.repartition(n, "e1", "e2").sortWithinPartitions("e1", "e2", "conv").mapInArrow(run, "e1 long, e2 long, ends string"))


def _totals(paths: DataFrame) -> DataFrame:
    """Per path: ``leaves`` and ``saved`` of everything below its first prefix; ``paths`` has ``conv``, ``up`` (path it hangs on, null: none) and its own sums.

    After k rounds a path has the sums of all paths less than 2^k steps below, and ``up`` is 2^k steps above.
    """
    state = cut_lineage(paths)
    while state.where("up is not null").limit(1).count():
        given = state.where("up is not null").groupBy(F.col("up").alias("_to")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        above = state.where("up is not null").select(F.col("conv").alias("_at"), F.col("up").alias("_up"))
        state = cut_lineage(state.join(given, F.col("conv") == F.col("_to"), "left").join(above, F.col("up") == F.col("_at"), "left").select(
            "conv", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))
    return state.select("conv", "leaves", "saved")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK, room: int = ROOM) -> DataFrame:
    """The trie of the rebuilt conversations, one row per prefix: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are ordered by turn, null first; equal turns by role, then by the MD5 of their text.  Null role and text are
    empty.  Conversation c is rebuilt from the first crc32(c) % 6 turns of conversation c - c % 100 and its own turns
    after as many.  A row without a conversation id takes no part; repeated rows are turns of their own; conversations
    left without turns are members of the root.  Texts of any length are hashed whole.  An empty table gives an empty
    result; other columns are left out, whatever their names.
    """
    partial = _partial(_pieces(rebuilt(turns, conv_col, turn_col, role_col, text_col), chunk), chunk, room)
    nodes = stored(partial.where("n is not null").groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "points")]), "prefixes")
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count(F.lit(1)).alias("children"))
    ends = _digests(partial.where("n is null").select("k1", "k2", "conv"))
    parents = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv").alias("up"))
    full = nodes.join(kids, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").join(ends, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    full = full.join(parents, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")) & (F.col("depth") > 0), "left").select(
        "conv", "depth", "up", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("points")).alias("saving"))
    full = stored(full, "nodes")
    tops = full.where("up is null or up <> conv").select("conv", "up", (F.col("depth") - 1).alias("on"))
    sums = full.groupBy(F.col("conv").alias("_conv")).agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    tops = stored(tops.join(sums, F.col("conv") == F.col("_conv")).drop("_conv"), "paths")
    totals = _totals(tops.select("conv", "up", "leaves", "saved")).select(F.col("conv").alias("_conv"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    hung = tops.where("up is not null").select("conv", "up", "on").join(totals, F.col("conv") == F.col("_conv")).groupBy(F.col("up").alias("_up"), F.col("on").alias("_on")).agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"))
    here = full.join(hung, (F.col("conv") == F.col("_up")) & (F.col("depth") == F.col("_on")), "left").withColumns({
        "leaf": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "saving": F.col("saving") + F.coalesce("_saved", F.lit(0)), "piece": F.floor(F.col("depth") / chunk)}).drop("_up", "_on", "_leaves", "_saved")
    # along a path from its end: inside pieces of bounded length, then what the later pieces hold
    inside = Window.partitionBy("conv", "piece").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = stored(here.withColumns({"leaves": F.sum("leaf").over(inside), "saved": F.sum("saving").over(inside)}), "sums")
    later = Window.partitionBy("_conv").orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = run.groupBy(F.col("conv").alias("_conv"), F.col("piece").alias("_piece")).agg(F.sum("leaf").alias("l"), F.sum("saving").alias("s"))
    whole = whole.withColumns({"_l": F.sum("l").over(later), "_s": F.sum("s").over(later)}).where("_l is not null").drop("l", "s")
    out = run.join(whole, (F.col("conv") == F.col("_conv")) & (F.col("piece") == F.col("_piece")), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
