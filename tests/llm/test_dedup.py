"""Jaccard join and repeated byte strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import graph, jaccard, suffixes, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    return sorted((i if i is not None else -1, len(s), min([x for x in least[find(k)] if x is not None], default=-1)) for k, (i, s) in enumerate(sets))


def corpus(seed=3, families=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(25))
    texts = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(6, 160))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: max(1, int(len(own) * rng.uniform(0.75, 1)))]
            texts.append(" ".join(own) + (" " + line if f % 3 == 0 else ""))
    texts += ["", None, "   \n", "one", "One", "one two three four", "ONE two\tthree\nfour", "a b c d e", "A b c d e", line, line, texts[0], "É a b c d é", "é a b c d é"]
    rng.shuffle(texts)
    return [(k * 3 % 1009, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(make, seed):
    rows = corpus(seed)
    rows += [rows[5], (None, rows[6][1]), (None, None)]
    docs = make([(i, t, "x", "y", 1) for i, t in rows]).withColumnRenamed("n_chars", "n").withColumnRenamed("lang", "cls")
    got = jaccard.jaccard_join(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute_components(rows)


def test_jaccard_empty(make):
    assert jaccard.jaccard_join(make([])).collect() == []


def test_shared_tokens_are_found_once(spark):
    tiles = spark.createDataFrame([(t, g, 0) for t in range(9) for g in range(t % 3 + 1)], "token long, grp long, pos int")
    facts = spark.range(3).select(F.col("id").alias("grp"), *[F.lit(9).alias(c) for c in ("lo", "hi")], F.lit(0).alias("slack"), *[F.lit(5).cast("long").alias(w) for w in jaccard._WORDS])
    found = jaccard._tile_pairs(tiles, facts, 80)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_slices_give_memory_back_at_their_end(monkeypatch):
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1), raising=False)
    pieces = text.slices([pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b"]})] * 2, limit=4)
    assert sum(p.num_rows for p in pieces) == 6 and calls == [1]


def test_shingles_ignore_batch_position():
    import pyarrow as pa

    texts = [t for _, t in corpus()]
    h, first = jaccard.shingle_sets(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        alone, _ = jaccard.shingle_sets(pa.array([t], pa.string()))
        assert np.array_equal(h[first[k] : first[k + 1]], alone) and len(alone) == len(shingles(t))


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def brute_repeats(rows, length):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for r, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((r, p))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for r, p in places:
                gone[r][p : p + length] = b"\1" * length
    out = []
    for (i, _), b, g in zip(rows, raw, gone, strict=True):
        spans = len(re.findall(b"\1+", bytes(g)))
        out.append((i if i is not None else -1, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    return sorted(out)


def byte_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = [(k, text(rng.randint(0, 400)) + rng.choice(shared) + text(rng.randint(0, 300)) + (rng.choice(shared) if rng.random() < 0.4 else "")) for k in range(60)]
    base = text(2500)
    for k in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = "z"
        rows.append((100 + k, "".join(own)))
    rows += [(200, ""), (201, None), (202, "a" * 1000), (203, "ab" * 400), (204, "a" * 199), (205, "a" * 200), (206, rows[3][1]), rows[3], (None, rows[4][1]), (207, "xyz" * 90 + text(50) + "xyz" * 90)]
    return rows


@pytest.mark.parametrize(("seed", "room", "batch"), [(1, 20_000, 10_000), (2, 2, 7), (3, 20_000, 3)])
def test_repeated_bytes(spark, make, monkeypatch, seed, room, batch):
    monkeypatch.setattr(suffixes, "ROOM", room)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = byte_corpus(seed)
        docs = make([(i, t, "x", "y", 1) for i, t in rows]).withColumnRenamed("lang", "rid").withColumnRenamed("source", "spans")
        got = suffixes.without_repeats(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows, 200)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_long_text_in_stretches(monkeypatch):
    """Each suffix has the same anchor and keys, whether its text is hashed whole or in stretches."""
    import pyarrow as pa

    long = "".join(t or "" for _, t in byte_corpus(5)[:40])

    def suffix_anchors(texts):
        row, p, m, d, anchor, _ = suffixes.anchors(pa.array(texts, pa.string()), 200)
        return {(r, q): (int(a), int(p0 + dd)) for r, p0, k, dd, a in zip(row.tolist(), p.tolist(), m.tolist(), d.tolist(), anchor.tolist(), strict=True) for q in range(p0, p0 + k)}

    whole = suffix_anchors(["x" * 300, long, None, "short"])
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    assert suffix_anchors(["x" * 300, long, None, "short"]) == whole
    assert len(whole) == 101 + len(long.encode()) - 199


def test_repeats_empty(make):
    assert suffixes.without_repeats(make([])).collect() == []
