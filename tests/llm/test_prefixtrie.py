"""The prefix trie against brute force over all prefixes."""

import hashlib
import random
import zlib

import pytest

from tallygrove.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
        ends.setdefault(v, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def talks(seed=1, n=160):
    rng = random.Random(seed)
    starts = [[(rng.choice(["user", "system", None]), rng.choice(["hi", "", None, "é", "long " * rng.randint(1, 9)])) for _ in range(rng.randint(0, 9))] for _ in range(8)]
    rows = []
    for _ in range(n):
        c = rng.choice([0, 100, 200, -100, 700]) + rng.randint(0, 99)
        body = rng.choice(starts)[: rng.randint(0, 9)] + [("user", rng.choice("ab")) for _ in range(rng.randint(0, 3))]
        rows += [(c, k if rng.random() > 0.05 else None, r, x) for k, (r, x) in enumerate(body)]
    rows += [(c, k, "user", "t") for c in (0, 100, 203) for k in range(c % 7 + 2)]
    rows += [(900, k, "user", f"turn {k % 3}") for k in range(70)] + [(901, k, "user", f"turn {k % 3}") for k in range(55)] + [(902, k, "user", f"turn {k % 3}" if k < 40 else "else") for k in range(60)]
    rows += [(901, 3, "user", "turn 0"), (None, 0, "user", "hi"), (950, None, None, None), (33_333_301, 0, "user", "hi")]
    # equal conversations, and each a turn longer than the one before, with smaller ids further down
    rows += [(c, k, "user", "same") for c in range(2000, 2040) for k in range(6)] + [(3000 + 99 - i, k, "user", f"n{k}") for i in range(30) for k in range(i + 6)]
    return rows


@pytest.mark.parametrize("chunk, room", [(prefixtrie.CHUNK, prefixtrie.ROOM), (7, 90)])
def test_trie_equals_brute_force(spark, chunk, room):
    rows = talks()
    want = brute(rows)
    got = found(prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk, room=room))
    assert got == want and max(r[1] for r in want) > 60


def test_very_long_texts_empty_tables_and_clashing_names(spark):
    empty = prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [(1, 0, "user", "é" * 300_000), (2, 0, "user", "é" * 300_000), (2, 1, None, None), (5, 0, "user", "x")]
    names = ["conv", "rank", "a", "b", "points", "piece", "at", "length", "k1", "n", "leaf", "up", "depth", "h", "own"]
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} int" for n in names))
    assert found(prefixtrie.prefix_trie(wide)) == brute(rows)
    assert found(prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_fat_binary_search_needs_a_logarithm_of_lookups():
    trie = prefixtrie.ZFastTrie()
    rng = random.Random(5)
    for c in range(300):
        cut, n = rng.randint(0, 1000), 1024
        before = trie.probes
        trie.insert(c, 0, [(-1, d) if d <= cut else (c, d) for d in range(n + 1)], [1] * n)
        assert trie.probes - before <= 11
    rows = {(r["k1"], r["k2"]): (r["conv"], r["depth"], r["n"]) for r in trie.expanded().to_pylist()}
    assert rows[(-1, 0)] == (0, 0, 300) and len(trie.nodes) <= 600 < len(rows)


def test_the_fattest_number_of_an_interval():
    for low in range(0, 40):
        for high in range(low + 1, 60):
            assert prefixtrie.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
