"""One query per operator over its whole table, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, jaccard, langid, lm, minhash, mixing, prefixtrie, quality, suffixes, toxicity, vectors
from .text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources", r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
        -ln((('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE)
          / CASE WHEN q = 1 THEN 2.0::DOUBLE WHEN q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
      FROM documents d LEFT JOIN best USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS n, (ARRAY[1.0::DOUBLE, 2.0, 3.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * n / w AS ratio FROM s),
l AS (SELECT *, ((sum(n) OVER ())::BIGINT - 3.0::DOUBLE * coalesce((sum(n) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
v AS (SELECT *, (SELECT arg_min(lv, ratio) FROM l WHERE lv < ratio) AS level FROM l),
t AS (SELECT source, n, CASE WHEN level <= ratio THEN level * w ELSE 3.0::DOUBLE * n END AS target FROM v),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT d.*, n, target, epochs, (sum(size) OVER (PARTITION BY d.source ORDER BY k, coalesce(d.doc_id::VARCHAR, ''), size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size::BIGINT AS size, n AS source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND ahead + size / 2 <= target - epochs * n THEN 1 ELSE 0 END))::BIGINT AS taken,
       (CASE WHEN size > 0 THEN epochs + CASE WHEN ahead + size / 2 <= target - epochs * n THEN 1 ELSE 0 END ELSE 0 END)::INTEGER AS copies
FROM o
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=mixing.quality_weights(table(spark, sf_dir, "labels")))


@query("op2_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.near = l.a)
SELECT doc_id, n AS n_shingles, min(near) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL
""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_kneser_ney_quality")
def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return quality.classify(table(spark, sf_dir, "documents"), good)


@query("op4_projection_forest")
def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)


@query("op6_suffix_repeats")
def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_language_mixture")
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.train(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, langs, model).withColumn("held_out", fold("doc_id", 4) == 2)


@query("op8_pivot_top_k", """
WITH v AS (SELECT vec_id, [floor(256.0::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top(table(spark, sf_dir, "embeddings"))


@query("op9_attention_scores")
def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm.score(docs, docs.where(fold("doc_id", 10) != 0), public_tokenizers.path(RANKS))
    return scores.withColumn("held_out", fold("doc_id", 10) == 0)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))

@query("op13_grid_codes", f"""
WITH k AS (SELECT vec_id, label, [floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT FOR x IN embedding] AS e, row_number() OVER () AS id FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT id, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM k, range(4) t(part)),
f AS (SELECT vec_id, min(e) AS e FROM k GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 256),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST) - 1 AS entry, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS c FROM f, range(4) t(part)),
{"".join(f'''
a{r} AS MATERIALIZED (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
        (SELECT id, part, entry, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d FROM p JOIN b{r} USING (part)) GROUP BY id, part),
''' + (f'''
s{r} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN p USING (id, part), range(1, len(x) + 1) t(i) GROUP BY ALL),
m{r} AS (SELECT part, entry, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry)),
''' if r < 4 else '') for r in range(5))}
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b4),
o AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT digest FROM h) AS codebooks_sha256 FROM o JOIN k USING (id)
""")
def op13_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_tensored_minhash", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 2 THEN ws
        ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS near FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.near = l.a)
SELECT doc_id, n AS n_shingles, min(near) AS component_id, doc_id = min(near) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
""")
def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY r) AS own FROM o GROUP BY conv_id),
h AS (SELECT *, (xor(list_reduce(list_prepend(4294967295, [ascii(ch)::BIGINT FOR ch IN string_split(conv_id::VARCHAR, '')]),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT FOR i IN range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6) AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(g.own, [])[1:h], h.own[h + 1:]) AS turns FROM h LEFT JOIN c g ON g.conv_id = h.conv_id - h.conv_id % 100),
p AS MATERIALIZED (SELECT conv_id, d, len(turns) AS n, turns[1:d] AS path FROM b, range(len(turns) + 1) t(d)),
k AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].text) END)::BIGINT AS saving,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY path, d),
f AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM k WHERE d > 0 GROUP BY 1),
l AS MATERIALIZED (SELECT k.*, coalesce(f.n, 0) AS n_children FROM k LEFT JOIN f USING (path)),
u AS (SELECT path[1:e] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM l, range(d + 1) t(e) GROUP BY 1)
SELECT l.conv_id, l.d AS depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends AS ends_sha256
FROM l JOIN u USING (path) LEFT JOIN k q ON l.d > 0 AND q.d = l.d - 1 AND q.path = l.path[1:l.d - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))
