"""Encoding, language, mixing, quality, toxicity, attention and vectors against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallygrove.llm import bpe, langid, lm, mixing, quality, queries, toxicity, vectors
from tallygrove.llm.text import fold

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = "'stmdrevl  \n\t abéß1２９!?.,漢字 　\u0085\x1c🙂''<|endoftext|>"
    return ["", None, "'s", " 's", "!'s x'll  y're\n\n'd", "a'sb don't  ", "  ", "\n x", "a" * 3000, "ab'" * 500, " " * 1000 + "x", *["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]]


def test_bpe_equals_reference_and_decodes(make, reference):
    texts = odd_texts(1, 600)
    docs = make([(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(None, "null id", None, None, None)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "starts")
    encoded = bpe.encode(docs, PATH)
    rows = bpe.decode(encoded, PATH, out="back").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text) and bytes(r["back"]) == text.encode()
        sizes = [len(reference.decode_single_token_bytes(i)) for i in r["ids"]]
        assert r["starts"] == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 100 else True
    for r in bpe.digests(docs, PATH).where("doc_id is not null").collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
    assert bpe.digests(make([]), PATH).collect() == []


def test_language_accuracy_and_mixtures(spark, sf, make):
    docs = queries.table(spark, sf, "documents")
    got = queries.op7_language_mixture(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    langs, model = langid.train(docs)
    one = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500").collect()}
    found = langid.identify(make([(1, one["fr"][:1000] + " " + one["de"][:1000], "fr", None, 1), (2, "123 !!", "en", None, 1), (3, None, None, None, 1), (None, one["es"], None, None, 1), (4, "", None, None, 1)]).withColumnRenamed("n_chars", "score"), langs, model)
    by = {r["doc_id"]: r for r in found.collect()}
    assert set(by[1]["languages"]) == {"de", "fr"} and 0.3 < by[1]["score"] < 0.7
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (2, 3, 4)) and by[None]["lang_pred"] == "es"
    langs, model = langid.train(make([]))
    assert langs == [] and langid.identify(docs.limit(3), langs, model).select("lang_pred").distinct().collect()[0][0] == "und"


def test_mixing_targets(make):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 8, 40]))), "x", rng.choice(["a", "b", "c", "d", None, "b", "b"]), 1) for i in range(400)] + [(900, None, "x", "a", 1), (None, "one two", "x", "a", 1), (901, "only", "x", "zz", 1), (901, "only", "x", "zz", 1)]
    docs = make(rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and got and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    share = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(x for x in size if x is not None) + [None])}
    target, open_ = {}, set(size)
    while True:  # reshare what capped sources leave
        left = sum(size.values()) - sum(target.values())
        level = left / sum(share[s] for s in open_)
        over = {s for s in open_ if level * share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * share[s] for s in open_}
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["size"] == 0 or r["copies"] >= math.floor(r["target"] / r["source_size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
    assert mixing.mixed_rows(docs.where("doc_id < 500")).count() == sum(r["copies"] for r in mixing.mix_sources(docs.where("doc_id < 500")).collect())
    assert mixing.mix_sources(make([])).collect() == []


def test_heavier_documents_come_first(make):
    rows = [(i, "a b c d", "x", "s" if i < 2000 else "t", 1) for i in range(2200)]
    docs = make(rows)
    heavy = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("_labelled"), F.lit(4.0).alias("_weight"))
    got = mixing.mix_sources(docs, weights=[1.0, 1.0], quality=heavy).where("source = 's' and copies > 0").agg(F.avg((F.col("doc_id") % 2 == 0).cast("double"))).first()[0]
    assert 0.5 < got < 1


def brute_kneser_ney(texts, order):
    table = quality._symbol_table()
    counts = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + [int(table[ord(c)]) for c in t]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    probs = {}
    for n in range(1, order + 1):
        r = Counter(counts[n].values())
        y = r[1] / (r[1] + 2 * r[2]) if r[1] and r[2] else 0.5
        d = [min(max(k - (k + 1) * y * r[k + 1] / r[k], 0.1), k - 0.05) if r[k] and r[k + 1] else 0.5 * min(k, 1.5) for k in (1, 2, 3)]
        total, off = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        probs[n] = (counts[n], total, off, d)

    def p(g):
        if not g:
            return 1 / 64
        c, total, off, d = probs[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return max(c[g] - (d[min(c[g], 3) - 1] if c[g] else 0), 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_kneser_ney_equals_brute_force(spark, make):
    trusted = ["the cat sat on the mat.", "a cat and a dog", "été dans la forêt", "the dog sat", "THE mat 12"]
    docs = make([(i, t, "en", "s", 1) for i, t in enumerate([*trusted, "zq!! xx", "", None])]).withColumnRenamed("n_chars", "bits")
    model = quality.train(docs.where("doc_id < 5"))
    p = brute_kneser_ney(trusted, quality.ORDER)
    table = quality._symbol_table()
    got = {r["doc_id"]: r["bits"] for r in quality.perplexity(docs, model, ["doc_id"]).collect()}
    for r in docs.collect():
        if not r["text"]:
            assert got[r["doc_id"]] is None
            continue
        s = [0] * (quality.ORDER - 1) + [int(table[ord(c)]) for c in r["text"]]
        want = -sum(math.log2(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(r["text"]))) / len(r["text"])
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-4)
    ids = spark.createDataFrame([(i,) for i in range(5)], "_trusted long")
    kept = {r["doc_id"]: r["keep"] for r in quality.classify(docs, ids).collect()}
    assert all(kept[i] for i in range(5)) and not kept[5] and not kept[6] and not kept[7]
    assert quality.classify(make([]), ids).collect() == []


@pytest.mark.parametrize("frequent", [0, 8, 1 << 19])
def test_every_code_point_is_a_symbol_and_unknown_contexts_are_joined(spark, make, monkeypatch, frequent):
    monkeypatch.setattr(quality, "FREQUENT", frequent)
    trusted = ["привет мир 12", "привет мир 13", "漢字漢字かな", "漢字 漢字", "🙂🙂 a\tb", "the the the tee"]
    docs = make([(i, t, "x", "s", 1) for i, t in enumerate([*trusted, "приват мар 77", "字漢漢字", "🙁 b a", "", None])])
    table, p = quality._symbol_table(), brute_kneser_ney(trusted, quality.ORDER)
    assert len({int(table[ord(c)]) for t in trusted for c in t if not c.isspace()}) == len({c for t in trusted for c in t if not c.isspace()})
    got = {r["doc_id"]: r["bits"] for r in quality.perplexity(docs, quality.train(docs.where("doc_id < 6")), ["doc_id"]).collect()}
    for r in docs.collect():
        s = [0] * (quality.ORDER - 1) + [int(table[ord(c)]) for c in r["text"] or ""]
        want = [-math.log2(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(r["text"] or ""))]
        assert got[r["doc_id"]] == (pytest.approx(sum(want) / len(want), abs=1e-9) if want else None)


def test_quality_keeps_good_text(spark, sf):
    labels = queries.table(spark, sf, "labels")
    got = queries.op3_kneser_ney_quality(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("k"))
    share = {r["quality"]: r["k"] for r in got.collect()}
    assert share[1] > 0.95 and share[0] < 0.4


def test_toxicity_learns_words(spark, make):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ba", "do", "ri", "mu", "ken", "sal"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    bad = ["scoundrel", "blockhead", "numskull", "rapscallion"]
    text = lambda toxic: " ".join([rng.choice(plain) for _ in range(80)] + ([rng.choice(bad) for _ in range(4)] if toxic else []))
    rows = [(i, text(i % 4 == 0), "x", "y", 1) for i in range(400)] + [(1000, None, "x", "y", 1), (1001, "", "x", "y", 1), (1002, None, None, None, None), (None, "ba do", None, None, None)]
    docs = make(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "predicted")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (1000, None), (1000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))
    got = toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {0}
    none = toxicity.train(make([]), labels)
    assert none.empty and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_on_a_wide_vocabulary(spark, make):
    """A thousand toxic words, most of them rare, that share beginnings; long ordinary texts round a few of them."""
    rng = random.Random(12)
    part = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    plain = [part() + part() for _ in range(3000)]
    stems = [rng.choice("xqz") + part() + "sch" for _ in range(50)]
    bad = [s + part() for s in stems for _ in range(20)]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.03 else rng.choice(plain) for _ in range(rng.randint(60, 500)))
    rows = [(i, text(i % 5 == 0), "x", "y", 1) for i in range(1500)] + [(9000, text(True) * 40, "x", "y", 1), (9001, text(False) * 40, "x", "y", 1)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))
    got = toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1500]
    caught, wrong = ([r["predicted"] for r in held if (r["doc_id"] % 5 == 0) == y] for y in (True, False))
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.05
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] >= 9000} == {9000: 1, 9001: 0}
    # the store of distances changes nothing: every word is compared anew
    m = model.ready()
    cell, first = m.cells(pa.array([rows[0][1], None, "", rows[1][1]]))
    sizes = [[len(c(b" " + w.encode() + m.tail)) for c in m.compress] for w in f"{rows[0][1]} {rows[1][1]}".split()]
    assert cell.tolist() == [(min(max(o - t, -3), 9) + 3) * 17 + min(len(w), 16) for (t, o), w in zip(sizes, f"{rows[0][1]} {rows[1][1]}".split(), strict=True)]
    assert np.diff(first).tolist() == [len(rows[0][1].split()), 0, 0, len(rows[1][1].split())]


def test_attention_gradient_and_distribution():
    rng = np.random.default_rng(0)
    ids, first = rng.integers(0, lm.IDS - 1, 75).astype(np.int32), np.array([0, 40, 40, 75])
    x, y, row = lm.windows(ids, first)
    assert sorted(np.concatenate([y[row == r][y[row == r] >= 0] for r in range(3)]).tolist()) == sorted([*ids.tolist(), lm.END, lm.END, lm.END])
    weights = lm.initial().astype(np.float64)
    loss = lambda w: -lm.log_probs(lm.unpack(w), x, y).sum() / (y >= 0).sum()
    grad = lm.gradient(lm.unpack(weights.astype(np.float32)), x, y)
    for at in rng.choice(lm.SIZE, 60, replace=False).tolist() + np.argsort(-np.abs(grad))[:40].tolist():
        step = np.zeros(lm.SIZE)
        step[at] = 1e-4
        assert (loss(weights + step) - loss(weights - step)) / 2e-4 == pytest.approx(grad[at], abs=2e-4)
    w = lm.unpack(lm.initial())
    total = sum(np.exp(lm.log_probs(w, x[:1], np.where(np.arange(lm.STRIDE) == 5, t, -1)[None, :])[0, 5]) for t in range(lm.IDS))
    assert total == pytest.approx(1, abs=1e-3)


def test_causal_windows_do_not_see_ahead():
    w = lm.unpack(lm.initial())
    ids = np.arange(60, dtype=np.int32)
    other = ids.copy()
    other[41:] = 7
    a, b = (lm.log_probs(w, *lm.windows(s, np.array([0, 60]))[:2]).ravel()[:60] for s in (ids, other))
    assert np.allclose(a[:41], b[:41]) and not np.allclose(a[41:], b[41:])


def test_text_scores_equal_a_plain_forward_pass_in_little_memory():
    rng = np.random.default_rng(4)
    first = np.concatenate([[0], np.cumsum([40, 0, 1, 16, 15, 17, 300, *[900] * 90])])
    x, y, row = lm.windows(rng.integers(0, lm.IDS - 1, first[-1]).astype(np.int32), first)
    weights = lm.fit(lm.initial(), x[:640], y[:640], rate=0.02)
    w, wide = lm.unpack(weights), lm.unpack(weights.astype(np.float64))
    tracemalloc.start()
    got = lm.text_scores(w, x, y, row, len(first) - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) > 5000 and peak < 8e6  # all windows are scored, a few of them at once
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for r in range(7):
        want = 0.0
        for ids, targets in zip(x[row == r], y[row == r], strict=True):
            h = [wide["emb"][i] + wide["pos"][p] for p, i in enumerate(ids)]
            for j, t in enumerate(targets):
                if t >= 0:
                    own = h[lm.STRIDE + j]
                    seen = [p for p in range(lm.STRIDE + j + 1) if ids[p] >= 0]
                    a = softmax(np.array([(own @ wide["wq"]) @ (h[p] @ wide["wk"]) / lm.WIDTH**0.5 for p in seen]))
                    out = own + sum(c * (h[p] @ wide["wv"]) for c, p in zip(a, seen, strict=True))
                    c, i = divmod(t, lm.IDS // lm.GROUPS)
                    want += np.log(softmax(out @ wide["wg"] + wide["bg"])[c]) + np.log(softmax(out @ wide["wi"][c] + wide["bi"][c])[i])
        assert got[r] == pytest.approx(want, rel=1e-5)
    assert lm.text_scores(w, x[:0], y[:0], row[:0], 2).tolist() == [0, 0]


def test_attention_steps_equal_plain_adam():
    rng = np.random.default_rng(5)
    x, y, _ = lm.windows(rng.integers(0, lm.IDS - 1, 3000).astype(np.int32), np.array([0, 1000, 3000]))
    want, m, v, total = lm.initial(), 0.0, 0.0, -(-len(x) // 64)
    order = np.random.default_rng(len(x)).permutation(len(x))
    for step in range(1, total + 1):
        own = order[64 * (step - 1) : 64 * step]
        grad = lm.gradient(lm.unpack(want), x[own], y[own])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        want = want - 0.02 * (1 - 0.9 * step / total) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    assert np.allclose(lm.fit(lm.initial(), x, y, rate=0.02), want, rtol=0, atol=1e-5)


def test_word_base_equals_brute_force(make, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)  # most words take the joined path
    rng = random.Random(6)
    words = ["a", "B", "cé", "dd", "e1", "f", "g", "h", "i", "j"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words[: 3 + i % 8]) for _ in range(rng.randint(0, 30))), "x", "y", 1) for i in range(120)] + [(500, "never seen", "x", "y", 1), (500, "never seen", "x", "y", 1), (None, "a", "x", "y", 1)]
    docs = make(rows).withColumnRenamed("n_chars", "row").withColumnRenamed("lang", "score")
    training = docs.where(fold("doc_id", 10) != 0)
    tokens = lambda t: [*(t or "").lower().split(), "\0end"]
    count = Counter(t for r in training.collect() for t in tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    got = lm.score(docs, training, PATH).collect()
    assert len(got) == len(rows)
    want = Counter((i, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score(make([]), make([]), PATH).collect() == []


def test_attention_learns_from_every_training_text(spark):
    tokens = spark.sparkContext.broadcast(lm.read_ranks(PATH)[: lm.IDS - 1])
    texts = spark.range(40).select(F.concat(F.lit("one text with many copies "), "id").alias("_text"), F.pmod(F.xxhash64("_text"), F.lit(2)).alias("half"))
    for half in (0, 1):  # however many texts there are, none is left out by its hash
        text = texts.where(F.col("half") == half).first()["_text"]
        docs = spark.range(0, 4000, 1, 2).select(F.lit(text).alias("_text"))
        assert not np.array_equal(lm._train(docs, tokens, PATH), lm.initial())


def embeddings(spark, n=700, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:420] = x[300]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * d, 1), (1040, [float("nan")] + [1.0] * (d - 1), 1), (1060, [None] + [1.0] * (d - 1), 1), (None, rows[3][1], 1), rows[5], (1100, [1.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_forest_recall_and_scores(spark):
    rows, df = embeddings(spark)
    x = {i: np.array(v, np.float64) for i, v, _ in rows[:700]}
    got = vectors.nearest(df, k=20).collect()
    recall = []
    for q in range(0, 700, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(s == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        best = sorted((-round(float(x[q] @ v), 9), i) for i, v in x.items() if i != q)[:20]
        recall.append(len({i for _, i in best} & {i for _, i, _ in own}) / 20)
    assert {r["query_id"] for r in got} == set(range(0, 700, 20)) and np.mean(recall) >= 0.9
    assert vectors.nearest(df.where("false")).collect() == []


def test_pivot_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 150)
    rows, df = embeddings(spark)
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in [*rows[:700], (1020, [0.0] * 12, 1)]}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.exact_top(df).collect())
    want = []
    for q in [i for i in x if i % 50 == 0]:
        best = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert vectors.exact_top(df.where("false")).collect() == []
