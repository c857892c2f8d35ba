"""Tensored banding against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from test_dedup import corpus

from tallygrove.llm import jaccard, minhash, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if len(words) == 1 else [tuple(words[i : i + 2]) for i in range(len(words) - 1)])


def brute(rows):
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
    out = []
    for k, (i, s) in enumerate(sets):
        c = min([x for x in least[find(k)] if x is not None], default=None)
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_components_equal_brute_force(spark, make):
    rng = random.Random(6)
    rows = corpus(11, families=16)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows += [(5000, long), (5001, long + " tail"), (None, rows[0][1]), (None, "alone and without an id"), (5002, "twice  here"), (5002, "Twice\there"), (5002, "twice  here")]
    got = found(minhash.near_copies(make([(i, t, "en", "s", 1) for i, t in rows]).repartition(3)))
    want = brute(rows)
    assert got == want and sum(not k for *_, k in want) > 20


def test_a_family_around_the_threshold_and_a_hot_template(spark, make):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    family = [" ".join(w if rng.random() > 0.045 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(250)]
    shell = " ".join(f"t{i}" for i in range(40))
    template = [shell + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(8, 25))) for _ in range(150)]
    rows = list(enumerate(family + template))
    got = found(minhash.near_copies(make([(i, t, "en", "s", 1) for i, t in rows])))
    want = brute(rows)
    assert len({r[2] for r in want}) > 2 and sum(a != b for a, b in zip(got, want, strict=True)) == 0


def test_empty_table_and_clashing_names(spark, make):
    assert minhash.near_copies(make([])).collect() == []
    wide = spark.createDataFrame([(1, "a b c", 1, 2, "x", 3, "k", "r", 1), (2, "A b c", 1, 2, "x", 3, "k", "r", 1), (3, None, 1, 2, "x", 3, "k", "r", 1)],
                                 "doc_id long, text string, cls long, n long, key string, w0 long, centre string, rep string, id int")
    assert found(minhash.near_copies(wide)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_tables_need_far_fewer_minimum_hashes_than_keys():
    h, first = jaccard.shingle_sets(pa.array(["one two three four", "", "one two three four"]), 2)
    both = minhash.collections(h, first, 10, 3)
    assert both.shape == (3, 20) and (both[0] == both[2]).all() and not both[1].any() and len(np.unique(both[0])) == 20


def test_blocks_find_what_whole_buckets_find(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(g), i, 40, 40, 0, 0, *[int(x) * -3 for x in rng.integers(0, 4, 2)]) for i, (k, g) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), strict=True))]
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[0] == b[0] and a[1] != b[1] and (80 - sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[7:], b[7:], strict=True))) * 180 >= 80 * 160}
    df = spark.createDataFrame(rows, "key long, grp long, id long, lo long, hi long, slack long, pos long, w0 long, w1 long")
    for block in (pairs.BLOCK, 7):
        monkeypatch.setattr(pairs, "BLOCK", block)
        assert {tuple(r) for r in pairs.open_pairs(df, ["w0", "w1"], 80).collect()} == want


def test_a_pair_is_not_written_for_every_bucket_it_shares(spark):
    """Families of 6 sets that share 200 buckets, each bucket without one of them: 15 pairs a family, not 15 for each bucket."""
    rows = [(f * 1000 + k, f * 10 + i, f * 10 + i, 300, 300, 0, 0, 5) for f in range(20) for k in range(200) for i in range(6) if i != k % 6]
    df = spark.createDataFrame(rows, "key long, grp long, id long, lo long, hi long, slack long, pos long, w0 long")
    want = {(f * 10 + i, f * 10 + j) for f in range(20) for i in range(6) for j in range(i + 1, 6)}
    assert {tuple(r) for r in pairs.open_pairs(df, ["w0"], 80).collect()} == want
    assert pairs._met(df, ["w0"], 80).count() <= 3 * len(want)


def test_a_pair_is_looked_at_in_its_first_shared_bucket_alone(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 3, (2, 60, 3)).tolist()
    rows = [(hash((i, j, x[r][i], y[r][j])) % (1 << 62), i * 3 + j, r, r, 10, 10, 0, 0, 0, *x[r], *y[r]) for r in range(60) for i in range(3) for j in range(3)]
    names = ["x0", "x1", "x2", "y0", "y1", "y2"]
    df = spark.createDataFrame(rows, "key long, slot int, grp long, id long, lo long, hi long, slack long, pos long, w0 long" + "".join(f", {n} long" for n in names))
    got = [tuple(r) for r in pairs.open_pairs(df, ["w0"], 80, (names[:3], names[3:])).collect()]
    meet = lambda a, b: any(p == q for p, q in zip(a, b, strict=True))
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60) if meet(x[a], x[b]) and meet(y[a], y[b])}
