"""Byte-level BPE encoding and decoding.

Texts are split without a regular expression.  Every code point gets a symbol from its class and its right neighbours;
the split is then a finite automaton with eight states.  The automaton's steps are functions on states, and composing
functions is associative, so all rows of a block of text are composed at once, a log-step scan joins the rows, and a
second sweep writes the boundaries.  Each distinct slice is merged once per worker and kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import LETTER, NUMBER, OTHER, SPACE, class_table, code_points, flat, prefix_hash, slices, span_hash

# symbols: 0-2 as the classes; an apostrophe that begins a contraction with one or two letters; a blank before
# something visible; other white space before something visible; white space before white space or the end
_TWO, _THREE, _BLANK, _LONE, _RUN, _PAD = 3, 4, 5, 6, 7, 8
_FIRST = 16  # added to the symbol of a row's first code point
_S_LETTER, _S_NUMBER, _S_OTHER, _S_BLANK, _S_RUN, _S_DONE, _S_ONE_MORE, _S_TWO_MORE = range(8)
_WIDTH = 64
#: longer slices are merged with a heap instead of whole-array passes
_LONG = 256
#: bytes of text encoded at once: more of it repeats than in smaller slices
_SLICE = 1 << 21


def _automaton() -> tuple[bytes, np.ndarray]:
    """Next state and "a slice begins here" by state | symbol << 3."""
    step, begins = bytearray(256), np.zeros(256, bool)
    for state in range(8):
        for symbol in range(32):
            at = state | symbol << 3
            if symbol == _PAD:
                step[at] = state
                continue
            s, kind = (_S_DONE, symbol - _FIRST) if symbol >= _FIRST else (state, symbol)
            if s in (_S_ONE_MORE, _S_TWO_MORE):
                step[at] = _S_ONE_MORE if s == _S_TWO_MORE else _S_DONE
                continue
            target = {LETTER: _S_LETTER, NUMBER: _S_NUMBER, OTHER: _S_OTHER, _TWO: _S_ONE_MORE, _THREE: _S_TWO_MORE, _BLANK: _S_BLANK, _LONE: _S_DONE, _RUN: _S_RUN}.get(kind, _S_DONE)
            if kind in (_TWO, _THREE) and s in (_S_OTHER, _S_BLANK):
                target = _S_OTHER
            step[at] = target
            joins = s == _S_BLANK or s == target and target in (_S_LETTER, _S_NUMBER, _S_OTHER, _S_RUN)
            begins[at] = not joins
    return bytes(step), begins


_STEP, _BEGINS = _automaton()


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(points)
    symbols = class_table()[np.minimum(points, 0x10FFFF)]
    last = np.zeros(n, bool)
    ends = first[1:]
    last[ends[ends > 0] - 1] = True
    space = symbols == SPACE
    blank_next = np.ones(n, bool)
    np.copyto(blank_next[:-1], space[1:])
    blank_next |= last
    symbols[space] = np.where(blank_next[space], _RUN, np.where(points[space] == 0x20, _BLANK, _LONE))
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        # no look past the row: code points there count as 0
        row_end = ends[np.searchsorted(ends, marks, side="right")]
        padded = np.append(points, [0, 0])
        one = np.where(marks + 1 < row_end, padded[marks + 1], 0)
        two = np.where(marks + 2 < row_end, padded[marks + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) << 21 | two
        long = np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        symbols[marks[short]], symbols[marks[long]] = _TWO, _THREE
    starts = first[:-1]
    starts = starts[starts < n]
    symbols[starts] |= _FIRST
    return symbols


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the code points at which a slice begins; ``first`` says where each row begins."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    rows = -(-n // _WIDTH)
    symbols = np.full(rows * _WIDTH, _PAD, np.uint8)
    symbols[:n] = _symbols(points, first)
    columns = np.ascontiguousarray(symbols.reshape(rows, _WIDTH).T) << 3
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for symbol in columns:
        maps = np.frombuffer((maps | symbol).tobytes().translate(_STEP), np.uint8).reshape(8, rows)
    scan, shift = np.ascontiguousarray(maps.T), 1
    while shift < rows:  # scan[i] = all rows up to i
        scan = np.concatenate([scan[:shift], np.take_along_axis(scan[shift:], scan[:-shift].astype(np.intp), axis=1)])
        shift *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = _S_DONE, scan[:-1, _S_DONE]
    begins = np.empty((_WIDTH, rows), bool)
    for j, symbol in enumerate(columns):
        at = state | symbol
        begins[j] = _BEGINS[at]
        state = np.frombuffer(at.tobytes().translate(_STEP), np.uint8)
    return np.flatnonzero(begins.T.reshape(-1)[:n])


def read_ranks(path: str) -> list[bytes]:
    """Token of every rank from a rank file (base64 token, rank)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merger:
    """Pair merging by rank with a bounded store of finished slices (sorted hashes, and a pool of their ids)."""

    def __init__(self, tokens: list[bytes], room: int = 2_000_000):
        self.tokens, self.room = tokens, room
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(i)
        order = np.argsort(keys)
        self.pair, self.made = np.append(np.array(keys, np.int64)[order], 1 << 62), np.append(np.array(made, np.int64)[order], 0)
        self.none = len(tokens)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.filled = 0

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.made[at], self.none)

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        text = [self.tokens[i] for i in ids]
        heap = [(r, i, text[i] + text[i + 1]) for i in range(len(ids) - 1) if (r := self.rank.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, joined = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= len(ids) or text[i] + text[j] != joined:
                continue
            text[i], text[j], ids[i] = joined, b"", r
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (q := self.rank.get(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (q, a, text[a] + text[b]))
        return [i for i, t in zip(ids, text, strict=True) if t]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn and their number for each: again and again the leftmost pair of lowest rank of every piece is joined, all pieces at once."""
        done_ids, done_owner, short = [], [], []
        for i, p in enumerate(pieces):
            if (whole := self.rank.get(p)) is not None:
                done_ids.append(np.array([whole]))
                done_owner.append(np.array([i]))
            elif len(p) > _LONG:
                done_ids.append(np.array(self._merge_long(p)))
                done_owner.append(np.full(len(done_ids[-1]), i))
            else:
                short.append(i)
        short.sort(key=lambda i: len(pieces[i]))
        for begin in range(0, len(short), 8192):
            part = np.array(short[begin : begin + 8192])
            ids = self.single[np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)]
            owner = np.repeat(part, [len(pieces[i]) for i in part.tolist()])
            rank = np.full(len(ids), self.none)
            same = np.flatnonzero(owner[:-1] == owner[1:])
            rank[same] = self._rank_of(ids[same], ids[same + 1])
            while len(ids):
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                best = np.minimum.reduceat(rank, starts)
                counts = np.diff(np.append(starts, len(ids)))
                low = np.repeat(best, counts)
                if (over := low == self.none).any():  # finished pieces leave
                    done_ids.append(ids[over])
                    done_owner.append(owner[over])
                    ids, owner, rank, low, best = ids[~over], owner[~over], rank[~over], low[~over], best[best != self.none]
                    if not len(ids):
                        break
                hit = np.flatnonzero(rank == low)
                hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
                ids[hit] = best
                stay = np.ones(len(ids), bool)
                stay[hit + 1] = False
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                hit -= np.arange(len(hit))
                for i in (hit, hit - 1):
                    i = i[i >= 0]
                    j = np.minimum(i + 1, len(ids) - 1)
                    joined = (owner[i] == owner[j]) & (i != j)
                    rank[i] = np.where(joined, self._rank_of(ids[i], ids[j]), self.none)
        owner = np.concatenate(done_owner)
        return np.concatenate(done_ids)[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def look_up(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct slices, by rising hash: where their ids begin in the pool, and how many they are."""
        if len(self.keys) + len(hashes) > self.room:
            self.forget()
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inner = place < len(self.keys)
        known[inner] = self.keys[place[inner]] == hashes[inner]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            ids, counts = self.merge([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            while self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.at = np.insert(self.at, place[new], self.filled + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, place[new], counts)
            self.keys = np.insert(self.keys, place[new], hashes[new])
            self.filled += len(ids)
            place = np.searchsorted(self.keys, hashes)
        return self.at[place], self.count[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and where each row's begin."""
        data, offsets = flat(texts)
        points, begins, first = code_points(data, offsets)
        cuts = boundaries(points, first)
        starts = begins[cuts]
        ends = np.append(starts[1:], len(data))
        hashes, sample, entry = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        at, count = self.look_up(hashes, data, starts[sample], ends[sample])
        ids, upto = gather(self.pool, at[entry], count[entry])
        return ids, upto[np.searchsorted(cuts, first)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in turn, and where each id's begin."""
        return gather(self.token_bytes, self.token_at[ids], self.token_size[ids])


def gather(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[at : at + count] one after the other, and where each begins (with the end)."""
    upto = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(upto[-1]) + np.repeat(at - upto[:-1], count)
    return pool[take], upto


def decimal(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal and a blank, and where each begins."""
    digits = np.empty((len(ids), 8), np.uint8)
    rest = ids.astype(np.uint32)
    for j in range(6, -1, -1):
        higher = rest // np.uint32(10)
        digits[:, j] = rest - higher * np.uint32(10) + 48
        rest = higher
    digits[:, 7] = 32
    width = np.searchsorted(10 ** np.arange(1, 7), ids, side="right") + 1
    return digits[np.arange(8) >= 7 - width[:, None]], np.concatenate([[0], np.cumsum(width + 1)])


_MERGERS: dict[str, Merger] = {}


def merger(tokens: list[bytes], name: str) -> Merger:
    """One merger per worker process and rank file, so that the store outlives a task."""
    if name not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[name] = Merger(tokens)
    return _MERGERS[name]


def _broadcast_tokens(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` and ``starts`` (byte of the text at which each id begins) of every row; null text is empty.

    The rank file is read once on the driver (a vocabulary, of fixed size) and broadcast.  Rows repeat as they come,
    other columns are left out, an empty table gives an empty result.
    """
    tokens = _broadcast_tokens(docs, path)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokens.value, path)
        for piece in slices(batches, "_text", _SLICE):
            ids, lists = m.encode(piece.column("_text"))
            _, offsets = flat(piece.column("_text"))
            sizes = m.token_size[ids]
            at = np.cumsum(sizes) - sizes - np.repeat(offsets[:-1], np.diff(lists))
            lists = pa.array(lists, pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.ListArray.from_arrays(lists, pa.array(ids)), pa.ListArray.from_arrays(lists, pa.array(at, pa.int32()))], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the bytes of its ids as ``out`` (binary); null or empty ids give empty bytes."""
    tokens = _broadcast_tokens(encoded, path)
    rest = [c for c in encoded.columns if c != out]
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b"".join([tokens.value[i] for i in ids]) if ids else b"" for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(made, pa.binary())], names=[*rest, out])

    return encoded.select(*rest).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a blank) and ``decoded_sha256`` of every row, by the same steps as ``encode`` and ``decode``."""
    tokens = _broadcast_tokens(docs, path)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokens.value, path)
        for piece in slices(batches, "_text", _SLICE):
            ids, lists = m.encode(piece.column("_text"))
            shown, shown_at = decimal(ids)
            raw, raw_at = m.decode(ids)
            hexed = [[hashlib.sha256(memoryview(pool)[a:b]).hexdigest() for a, b in zip(at[lists[:-1]].tolist(), np.maximum(at[lists[1:]] - less, at[lists[:-1]]).tolist(), strict=True)]
                     for pool, at, less in ((shown, shown_at, 1), (raw, raw_at, 0))]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(np.diff(lists), pa.int64()), *[pa.array(x, pa.string()) for x in hexed]], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInArrow(run, schema)
