"""Save modes: keyed upsert, replaced slices, saved tables in parts, compaction.

Plain Parquet has no in-place MERGE, so every mode is a DataFrame of the new content of the
parts it touches, written to a new folder; a small committed list says which folders count.
Nothing that is being read is ever overwritten.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import join_on
from ..session import cut_lineage
from .shape import keep_one


def with_columns_for(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Key columns the table does not have yet are added as empty text."""
    for k in names:
        if k not in df.columns:
            df = df.withColumn(k, F.lit(None).cast("string"))
    return df


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``source`` replace rows with the same key (NULL equals NULL); other rows stay; new columns are added.

    ``source`` is reduced to one row per key first, by ``order`` or else by the largest values of its columns.  The anti join needs only the source keys.
    """
    target = with_columns_for(target, keys)
    one = keep_one(source, keys, list(order) if order else [F.col(c).desc_nulls_last() for c in source.columns if c not in keys] or [F.lit(1)])
    kept = join_on(target, one.select(*keys), keys, "left_anti")
    return kept.unionByName(one, allowMissingColumns=True)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True)


def replace_where(target: DataFrame, source: DataFrame, cond: Column | str) -> DataFrame:
    """The slice that matches ``cond`` is replaced by ``source``; rows for which it is false or unknown stay."""
    cond = F.expr(cond) if isinstance(cond, str) else cond
    return target.where(~F.coalesce(cond, F.lit(False))).unionByName(source, allowMissingColumns=True)


def tenant_slices(source: DataFrame, previous: DataFrame | None, tenant: str = "tenant", business: str = "business") -> DataFrame:
    """(tenant, business) pairs a refresh replaces: those in the new data and those written last time."""
    now = source.select(tenant, business).distinct()
    return now.unionByName(previous.select(tenant, business)).distinct() if previous is not None else now


def replace_slices(target: DataFrame, source: DataFrame, slices: DataFrame) -> DataFrame:
    """Like ``replace_where`` with the slices as a table, null-safe, so any number of businesses works."""
    return join_on(target, slices, slices.columns, "left_anti").unionByName(source, allowMissingColumns=True)


def update_where(df: DataFrame, cond: str, changes: dict[str, str]) -> DataFrame:
    hit = F.coalesce(F.expr(cond), F.lit(False))
    return df.withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)) for c, e in changes.items()})


def compare_versions(now: DataFrame, then: DataFrame) -> DataFrame:
    """Rows now, rows then, rows added and removed, counting duplicates.

    Both versions are counted by content once and joined by content, so the tables are
    read once each and equal rows collapse before the shuffle.
    """
    cols = now.columns
    both = now.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        then.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*cols).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return per.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_now"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_then"),
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("removed"),
    )


def high_watermark(df: DataFrame, cursor: str, name: str = "watermark") -> DataFrame:
    return df.agg(F.max(cursor).alias(name))


# ---------------------------------------------------------------- saved tables


def _fs(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a saved table, oldest first: those whose list of parts was committed."""
    fs, root = _fs(spark, f"{path}/current")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/current/{n}/_SUCCESS")[1]))


def _listed(spark: SparkSession, path: str, version: int | None) -> tuple[DataFrame, dict]:
    """Parts of a version (``store_write``, ``store_part``), and what it notes: number, schema, partitioning, notes of the writer."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path} {'' if version is None else version}")
    number = found[-1] if version is None else version
    parts = spark.read.schema("store_write int, store_part string, about string").parquet(f"{path}/current/v={number}")
    return parts.where("about is null").select("store_write", "store_part"), json.loads(parts.where("about is not null").first()["about"]) | {"number": number}


def _rows(spark: SparkSession, path: str, listed: DataFrame, about: dict, only: DataFrame | None = None) -> DataFrame:
    """Rows of the listed parts with their ``store_part``; the join on partition columns prunes folders (dynamic partition pruning)."""
    schema = T.StructType.fromJson(about["schema"])
    full = T.StructType([*schema.fields, T.StructField("store_write", T.IntegerType()), T.StructField("store_part", T.StringType())])
    rows = spark.read.schema(full).parquet(f"{path}/rows").where(F.col("store_write") <= about["number"])  # folders of later or broken saves are not opened
    wanted = listed if only is None else listed.join(only, "store_part", "left_semi")
    return rows.join(wanted.where("store_write >= 0"), ["store_write", "store_part"], "left_semi").select(*schema.names, "store_part")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A saved table as of a version, by default the latest."""
    return _rows(spark, path, *_listed(spark, path, version)).drop("store_part")


def read_parts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The parts of a saved table that rows ``like`` belong to; ``like`` needs the columns the table is parted by."""
    listed, about = _listed(spark, path, None)
    return _rows(spark, path, listed, about, like.select(part_of(about["by"], about["parts"]).alias("store_part")).distinct()).drop("store_part")


def note(spark: SparkSession, path: str) -> dict:
    """What the last writer noted with its save; empty for a table that is not there."""
    return _listed(spark, path, None)[1]["note"] if versions(spark, path) else {}


def part_of(by: Sequence[str], parts: int | None) -> Column:
    """The part a row belongs to: a hash of its columns, or (``parts`` None) their values."""
    if not by:
        return F.lit("all")
    if parts is None:
        return F.concat_ws("|", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||")), F.lit("\\N")) for c in by])
    return F.pmod(F.xxhash64(*by), F.lit(parts)).cast("string")


def save(df: DataFrame, path: str, mode: str = "overwrite", keys: Sequence[str] = (), where: str | None = None, by: Sequence[str] = (),
         parts: int | None = 64, notes: dict | None = None, slices: DataFrame | None = None) -> int:
    """Save rows as the next version; returns its number. Modes: create, overwrite, append, merge (needs keys), replace (needs where), slices (needs slices: rows with these values give way).

    The table lies in parts: hashes of the columns ``by`` in ``parts`` values, or their values where ``parts`` is None
    (both are fixed by the first save; without ``by`` the table is one part).  A save writes a new folder that holds
    only the parts it touches - appended rows alone, the parts of merged keys or slices (``by`` must be among their
    columns, else all are read), the parts that lose rows to ``where`` - and then a small list that says which folder each part is in.  That
    list is the commit: readers see the old or the new version, and files of untouched parts stay where they are.
    One writer at a time; ``notes`` (JSON values) are kept with the version.
    """
    spark = df.sparkSession
    found = versions(spark, path)
    if mode == "create" and found:
        raise FileExistsError(path)
    nxt = found[-1] + 1 if found else 0
    listed, about = _listed(spark, path, None) if found else (spark.createDataFrame([], "store_write int, store_part string"), None)
    if about is None or mode == "overwrite":
        about = {"schema": None, "by": list(by), "parts": parts, "note": {}}
        kept = listed.where("false")
        rows = df
    else:
        by, parts = about["by"], about["parts"]
        if mode == "append":
            kept, rows = listed, df
        elif mode in ("merge", "slices"):
            df = with_columns_for(df, keys)
            meant = df if mode == "merge" else slices
            known = set(by) <= set(keys if mode == "merge" else slices.columns)
            touched = (meant.select(part_of(by, parts).alias("store_part")) if known else listed.select("store_part")).distinct()
            old = _rows(spark, path, listed, about, touched).drop("store_part")
            rows = upsert(old, df, keys) if mode == "merge" else replace_slices(old, df, slices.distinct())
            kept = listed.join(touched, "store_part", "left_anti")
        elif mode == "replace":
            gone = F.coalesce(F.expr(where), F.lit(False))
            touched = cut_lineage(_rows(spark, path, listed, about).where(gone).select("store_part").distinct())
            rows = _rows(spark, path, listed, about, touched).where(~gone).drop("store_part").unionByName(df, allowMissingColumns=True)
            kept = listed.join(touched, "store_part", "left_anti")
        else:
            raise ValueError(mode)
    before = T.StructType.fromJson(about["schema"]).fields if about["schema"] else []
    own = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*[own.get(f.name, f) for f in before], *[f for f in rows.schema.fields if f.name not in {b.name for b in before}]])
    about = about | {"schema": T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).jsonValue(), "note": notes if notes is not None else about["note"]}
    placed = rows.withColumn("store_part", part_of(by, parts)).hint("rebalance", "store_part")  # a hot part is split over tasks
    folder = f"{path}/rows/store_write={nxt}"
    placed.write.mode("overwrite").partitionBy("store_part").parquet(folder)  # leftovers of a save that was not committed go
    now = spark.read.schema("store_part string").parquet(folder).select(F.lit(nxt).alias("store_write"), "store_part").distinct()
    entries = kept.unionByName(now).withColumn("about", F.lit(None).cast("string"))
    head = spark.createDataFrame([(None, None, json.dumps(about))], entries.schema)
    entries.unionByName(head).coalesce(1).write.mode("overwrite").parquet(f"{path}/current/v={nxt}")
    return nxt


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the folders of saves that none of the last ``keep`` versions uses, and the older lists; returns how many saves went."""
    found = versions(spark, path)
    used = {w for v in found[-keep:] for w in _listed(spark, path, v)[0].agg(F.collect_set("store_write").alias("w")).first()["w"]}
    fs, _ = _fs(spark, path)
    for v in found[:-keep]:
        fs.delete(_fs(spark, f"{path}/current/v={v}")[1], True)
    old = [v for v in range(found[-1] + 1 if found else 0) if v not in used and fs.exists(_fs(spark, f"{path}/rows/store_write={v}")[1])]
    for v in old:
        fs.delete(_fs(spark, f"{path}/rows/store_write={v}")[1], True)
    return len(old)


# ---------------------------------------------------------------- file layout


#: rows that one task sorts for one file
ROWS_PER_FILE = 1_000_000


def compact(df: DataFrame, cluster_by: Sequence[str], files: int) -> DataFrame:
    """Fewer, clustered files: range partitions on up to four columns, sorted inside.

    ``files`` is the least number: it rises with the rows, so that what a task sorts does not.
    """
    cols = list(cluster_by)
    if len(cols) > 4:
        raise ValueError("at most four columns to cluster by")
    return df.repartitionByRange(max(files, -(-df.count() // ROWS_PER_FILE)), *cols).sortWithinPartitions(*cols)


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below a folder, without their content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(path).select(F.col("_metadata.file_path").alias("path"), "length", "modificationTime"))


def layout_advice(files: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Many small files: at least 50 files that average under 32 MB."""
    g = files.groupBy(*group) if group else files.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.avg("length").alias("average"))
    return out.withColumn("compact", (F.col("files") >= 50) & (F.col("average") < 32 * 1024 * 1024))


def fingerprint(listing: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """A digest of a set of files that changes when any file changes.

    Per-file digests are added up as numbers, so the result needs no ordered list in one task.
    """
    line = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    part = lambda i: F.sum(F.conv(F.substring(F.md5(line), i, 8), 16, 10).cast("decimal(20,0)"))
    g = listing.groupBy(*group) if group else listing.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("files"), part(1).alias("_a"), part(9).alias("_b"))
    return out.select(*group, "files", F.md5(F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string"))).alias("version"))
