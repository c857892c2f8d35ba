"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, encoding; each stage written as Parquet.

Columns of ``documents`` pass through; ``n_chars`` stays as it was read, and columns that are not part of the table
travel as one struct, so that their names meet no other.  Rows are judged one by one, those with a null or a repeated
id like any others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import bpe, jaccard, langid, mixing, suffixes
from tallygrove.llm.queries import RANKS
from tallygrove.llm.store import stored
from tallygrove.session import scratch_path


#: columns that the stages know
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying_others(stage: Stage) -> Stage:
    """A stage that returns its input's columns, whatever further columns there are and however they are named."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in DOCUMENT]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("other_columns")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in DOCUMENT], packed), sf_dir)
        return out.select(*[F.col(c) if c in DOCUMENT else F.col("other_columns")[f"c{others.index(c)}"].alias(c) for c in docs.columns])

    return run


@carrying_others
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null text, or no letter.  The model learns from all labelled rows."""
    langs, model = langid.train(docs)
    found = langid.identify(docs, langs, model, keep=docs.columns)
    return found.where(found["lang_pred"] != langid.UNKNOWN).select(*docs.columns)


def _key(docs: DataFrame) -> Column:
    """What tells rows apart and ranks them: smallest id first, null ids last, then hashes of the text and of all columns; only equal rows share it."""
    whole = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"), whole.alias("row"))


@carrying_others
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays, that with the smallest id (null ids last; then by hashes of text and row); rows that link with nothing stay.

    Rows are judged by themselves, not by their ids: a row stays although its id is that of a row that goes.
    """
    keyed = docs.withColumn("_key", _key(docs))
    found = jaccard.jaccard_join(keyed.select("_key", "text"), id_col="_key")
    kinds = stored(found.where("n_shingles > 0").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least")).where("n > 1 or _key <> least")
                   .select(F.col("_key").alias("_of"), (F.col("_key") == F.col("least")).alias("_first")), "copies")
    marked = keyed.join(kinds, keyed["_key"] == kinds["_of"], "left").where("_first is null or _first").drop("_of")
    # of equal rows that are the first of their group one stays
    once = marked.where("_first").dropDuplicates(["_key"])
    return marked.where("_first is null").unionByName(once).select(*docs.columns)


@carrying_others
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that stand elsewhere too are cut out; a document of which nothing visible is left goes.

    A character cut in two at the edge of a passage goes as a whole.
    """
    cut = suffixes.without_repeats(docs, keep=docs.columns).drop("n_bytes", "n_spans", "kept_sha256")
    left = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, F.col("text")).when(F.is_valid_utf8(left), left).otherwise(F.replace(F.make_valid_utf8(left), F.lit("\uFFFD"), F.lit("")))
    kept = cut.withColumn("text", text)
    return kept.where(F.length(F.trim("text")) > 0).select(*docs.columns)


@carrying_others
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, each as often as it is taken; documents weigh by their labels, or alike where there is no such table."""
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return mixing.mixed_rows(docs)
    return mixing.mixed_rows(docs, quality=mixing.quality_weights(labels))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to, as digests."""
    return bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [("language_id", identify_language), ("ngram_jaccard", drop_near_copies), ("suffix_repeats", cut_repeats), ("mix_sources", mix), ("byte_bpe", tokenise)]
#: SQL has no form for the language model, the pair merges and the byte spans: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
