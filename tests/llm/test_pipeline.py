"""The pipeline against brute force on a small table, stage by stage."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import tiktoken
from test_dedup import brute_components, byte_corpus, corpus

import corpus_pipeline
from tallygrove.llm import bpe, mixing


def test_pipeline_equals_brute_force(spark, make, tmp_path):
    rng = random.Random(9)
    texts = [t for _, t in corpus(7, families=5)] + [t for _, t in byte_corpus(2)[:40]] + ["12 34", "!!", None, ""]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    root = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in left])}
    left = [r for r in left if root[r[0]] == r[0]]
    starts = Counter()
    raw = {r[0]: r[1].encode() for r in left}
    for b in raw.values():
        starts.update(b[p : p + 200] for p in range(len(b) - 199))
    kept = []
    for r in left:
        b, gone = raw[r[0]], bytearray(len(raw[r[0]]))
        for p in range(len(b) - 199):
            if starts[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if text.strip(" "):
            kept.append((r[0], text, *r[2:]))
    assert any(len(k[1]) < len(r[1]) for k in kept for r in left if r[0] == k[0])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(make(kept)).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    want = Counter()
    for r in kept:
        ids = enc.encode_ordinary(r[1])
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] += copies[r[0]]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and max(got.values()) > 1


def test_stages_return_the_columns_of_documents(spark, make):
    docs = make([(1, "a few words of text", "en", "s", 19), (2, None, None, None, None), (None, "other words stand here", "en", "s", 1)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.where("false"), "").collect() == []


def test_one_row_of_each_group_stays_whatever_its_id(spark, make):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    null_ids, null_and_id, equal, shared, clean, differ = (text() for _ in range(6))
    rows = [(None, null_ids, "en", "s", 1), (None, null_ids + " end", "en", "s", 1), (None, null_ids, "en", "s", 1), (7, null_and_id, "en", "s", 1), (None, null_and_id, "en", "s", 1),
            (3, equal, "en", "s", 1), (3, equal, "en", "s", 1), (4, shared, "en", "s", 1), (5, shared, "en", "s", 1), (5, clean, "en", "s", 1), (6, differ, "en", None, 1), (6, differ, None, "en", 1),
            (8, None, "en", "s", 1), (8, None, "en", "s", 1), (None, None, "en", "s", 1)]
    got = corpus_pipeline.drop_near_copies(spark, make(rows), "").select("doc_id", "text").collect()
    first = next(t for i, t in got if i is None and t and t.startswith(null_ids))
    want = [(None, first), (7, null_and_id), (3, equal), (4, shared), (5, clean), (6, differ), (8, None), (8, None), (None, None)]
    assert Counter(map(tuple, got)) == Counter(want)
    left = corpus_pipeline.cut_repeats(spark, make([(i, t, "en", "s", 1) for i, t in got]), "").select("doc_id", "text").collect()
    assert Counter(map(tuple, left)) == Counter(w for w in want if w[1])


def test_mix_stage_weighs_by_quality(spark, make, tmp_path):
    rng = random.Random(8)
    docs = make([(i if i % 9 else None, "word " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", None]), i) for i in range(600)] + [(11, "word " * 30, "en", "b", 600)])
    labels = spark.createDataFrame([(i, rng.choice([0, 1, None]), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r["doc_id"], r["source"], len(r["text"].split()))
    got = Counter(map(key, corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()))
    takes = lambda **q: sum((Counter({(r["doc_id"], r["source"], r["size"]): r["copies"]}) for r in mixing.mix_sources(docs, **q).collect()), Counter())
    weighed, alike = takes(quality=mixing.quality_weights(labels)), takes()
    assert got == weighed != alike
    assert Counter(map(key, corpus_pipeline.mix(spark, docs, f"{tmp_path}/none").collect())) == alike


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    names = ["score", "lang_pred", "_first", "_of", "_key", "n_bytes", "kept", "_words", "_copies", "_rank", "_drawn", "_copy", "_text", "spans", "rid", "other_columns", "odd name.x"]
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    twin = text()
    rows = [(i, t, "en", rng.choice("ab"), i, *[f"{n}{i}" for n in names]) for i, t in enumerate([twin, twin, *[text() for _ in range(6)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.count() and all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names)
    assert 1 not in [r["doc_id"] for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.tokenise(spark, docs, "").collect()} == {r["doc_id"] for r in docs.collect()}
