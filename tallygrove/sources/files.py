"""File sources and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shape import clean_columns, drop_empty_rows, flatten
from ..operators.write import file_listing


def read_files(spark: SparkSession, path: str, fmt: str, header: bool = True, infer: bool = True, **options) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header).option("inferSchema", infer)
    elif fmt == "json":
        r = r.option("multiLine", options.pop("multiLine", False))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def read_parquet_union(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder with Hive partition columns and files whose columns differ."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_staged(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "json":
        return clean_columns(spark.read.option("mode", "PERMISSIVE").json(path))
    return read_parquet_union(spark, path)


DELIMITERS = [",", ";", "\t", "|"]


def delimiters(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its ``delimiter``, ``fields``, ``lines`` and ``steady``, the share of lines with that many fields.

    All lines of all files count, in one aggregate by number of fields: the delimiter is the one that splits most lines
    into equally many fields (more fields, then the fixed order, on ties).  Quoted text is passed over; a file whose
    lines no delimiter splits has none.
    """
    plain = F.regexp_replace("value", '"[^"]*"', "")
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), (F.length("plain") - F.length(F.replace("plain", F.lit(d), F.lit("")))).alias("cuts")) for i, d in enumerate(DELIMITERS)])).alias("m")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), plain.alias("plain")).where(F.trim("plain") != "")
    by_width = lines.select("file", marks).groupBy("file", "m.i", "m.d", "m.cuts").agg(F.count(F.lit(1)).alias("n"))
    per = by_width.groupBy("file", "i", "d").agg(F.max(F.struct("n", "cuts")).alias("most"), F.sum("n").alias("lines"))
    best = F.max_by(F.struct("d", "most", "lines"), F.struct(F.when(F.col("most.cuts") > 0, F.col("most.n")).otherwise(0), F.col("most.cuts"), -F.col("i")))
    return per.groupBy("file").agg(best.alias("b")).select(
        "file", F.when(F.col("b.most.cuts") > 0, F.col("b.d")).alias("delimiter"), (F.col("b.most.cuts") + 1).alias("fields"), "b.lines", (F.col("b.most.n") / F.col("b.lines")).alias("steady"))


def layout(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, encoding) of all files; an error if files differ in their delimiter."""
    found = delimiters(spark, path).where("delimiter is not null").groupBy("delimiter").agg(F.count(F.lit(1)).alias("n"))
    kinds = found.agg(F.array_sort(F.collect_list(F.struct("delimiter", "n"))).alias("k")).first()["k"]  # at most one entry per delimiter
    if len(kinds) > 1:
        raise ValueError(f"{path} mixes delimiters: " + ", ".join(f"{k['delimiter']!r} in {k['n']} files" for k in kinds))
    utf8 = spark.read.text(path).agg(F.min(F.is_valid_utf8("value"))).first()[0]
    return kinds[0]["delimiter"] if kinds else DELIMITERS[0], "ISO-8859-1" if utf8 is False else "UTF-8"


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool = True,
                   skip_rows: int = 0, bad_lines: str | None = None) -> DataFrame:
    """Delimited text, all columns as text: only empty fields are NULL, bad lines are tolerated, empty rows dropped.

    ``bad_lines`` names a column that keeps the raw text of lines that did not fit.
    """
    if delimiter is None or encoding is None:
        d, e = layout(spark, path)
        delimiter, encoding = delimiter or d, encoding or e
    r = (spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header).option("nullValue", "")
         .option("mode", "PERMISSIVE").option("escape", '"').option("enforceSchema", True))
    if skip_rows:
        lines = number_lines(spark.read.option("encoding", encoding).text(path)).where(F.col("_line") > skip_rows)
        options = {"sep": delimiter, "mode": "PERMISSIVE", "nullValue": "", "escape": '"'}
        first = lines.where(F.col("_line") == skip_rows + 1).select("value").first()  # one line: the names or the width
        names = _fields(spark, first["value"], options)
        names = names if header else [f"col_{i + 1}" for i in range(len(names))]
        schema = T.StructType([T.StructField(n or f"col_{i + 1}", T.StringType()) for i, n in enumerate(names)])
        body = lines.where(F.col("_line") > skip_rows + 1) if header else lines
        # DDL text cannot hold every header, so fields are parsed by position and renamed afterwards
        ddl = ", ".join(f"c{i} string" for i in range(len(names)))
        df = body.select(F.from_csv("value", ddl, options).alias("r")).select("r.*").toDF(*schema.names)
    elif bad_lines:
        names = r.csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad_lines]])
        df = r.option("columnNameOfCorruptRecord", bad_lines).schema(schema).csv(path)
    else:
        df = r.csv(path)
    return drop_empty_rows(clean_columns(df))


def _fields(spark: SparkSession, line: str, options: dict) -> list[str]:
    """The fields of one delimited line, split by Spark's own CSV rules."""
    width = line.count(options["sep"]) + 1
    row = spark.range(1).select(F.from_csv(F.lit(line), ", ".join(f"c{i} string" for i in range(width)), options).alias("r")).first()["r"]
    last = max((i for i, v in enumerate(row) if v is not None), default=-1)
    return list(row)[: last + 1]


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines of text files with their 1-based number inside the file (``_file``, ``_line``).

    A file is read in blocks by different tasks. Lines are counted per block; the start number of a
    block is the sum of the earlier blocks of its file, a list as long as the number of blocks.
    """
    d = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))
    sizes = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (d.join(starts, ["_file", "_block"])
            .withColumn("_line", F.col("_before") + F.col("_mid") - F.col("_first") + 1).drop("_mid", "_first", "_before"))


def _documents_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of all JSON documents below ``path``, one document a file.

    Spark's own inference deals files to tasks by their bytes alone, so that thousands of small files land in one task.
    The scan of whole files counts what opening a file costs, too.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    texts = files.rdd.map(lambda r: bytes(r.content).decode(json.detect_encoding(r.content), "replace"))
    return spark.read.json(texts).schema


def read_json_any(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON document, JSON Lines, or an envelope with exactly one array of objects, as flat columns.

    Nested objects become ``parent_child`` columns; lists stay as JSON text.
    """
    df = spark.read.json(path) if lines else spark.read.schema(_documents_schema(spark, path)).option("multiLine", True).json(path)
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not lines and len(arrays) == 1:
        df = df.select(F.explode(F.col(arrays[0])).alias("r")).select("r.*")
    df = flatten(df)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])


def new_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or whose size or modification time changed since they were seen; ``path`` names one file, an unknown size or time equals itself."""
    s = seen.select(F.col("path").alias("_p"), F.col("length").alias("_l"), F.col("modificationTime").alias("_m"))
    same = (F.col("path") == F.col("_p")) & F.col("length").eqNullSafe(F.col("_l")) & F.col("modificationTime").eqNullSafe(F.col("_m"))
    return listing.join(s, same, "left_anti")


def read_new(spark: SparkSession, path: str, fmt: str, pattern: str, seen: DataFrame, **options) -> DataFrame:
    """Rows of the changed files only, with the file they came from (``_source_file``).

    The list of changed files stays a table.  The driver learns one time, the earliest change among them, which keeps
    older files from being opened; the join on the file's path drops what did not change since.
    """
    changed = new_files(file_listing(spark, path, pattern), seen)
    since = changed.agg(F.min("modificationTime").alias("t")).first()["t"]
    r = spark.read.format(fmt).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    for k, v in options.items():
        r = r.option(k, v)
    df = r.load(path)
    rows = df.select(*df.columns, F.col("_metadata.file_name").alias("_source_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_time"))
    rows = rows.where(F.col("_time") >= F.lit(since)) if since else rows.where("false")
    return rows.join(changed.select(F.col("path").alias("_path")), "_path", "left_semi").drop("_path", "_time")


def export(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("error")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))


# Fixed log level words.
ERROR_WORDS = ["ERROR", "FATAL", "CRITICAL", "SEVERE", "Exception", "Traceback"]
OTHER_LEVELS = ["WARNING", "WARN", "INFO", "DEBUG"]


def log_lines(texts: DataFrame, c: str, keys: Sequence[str] = (), level: str | None = None, contains: str | None = None) -> DataFrame:
    """One row per text line with its level; ``level`` keeps errors, or warnings and errors; ``contains`` ignores case."""
    line = texts.select(*keys, F.posexplode(F.split(c, "\n")).alias("line_no", "line"))
    word = F.regexp_extract("line", rf"\b({'|'.join(ERROR_WORDS + OTHER_LEVELS)})\b", 1)
    named = F.when(word.isin(ERROR_WORDS), "error").when(F.startswith(word, F.lit("WARN")), "warn").otherwise(F.lower(word))
    out = line.withColumn("level", named)
    if level == "error":
        out = out.where("level = 'error'")
    elif level == "warn":
        out = out.where("level in ('error', 'warn')")
    return out.where(F.contains(F.lower("line"), F.lit(contains.lower()))) if contains else out
