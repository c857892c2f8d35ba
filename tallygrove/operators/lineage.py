"""Table lineage: references in SQL text, edges from events, neighbourhood, impact, column mentions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_NAME = r"(?:`[^`]+`|[A-Za-z_]\w*)(?:\s*\.\s*(?:`[^`]+`|[A-Za-z_]\w*)){0,2}"
READ = rf"(?i)\b(?:from|join)\s+({_NAME})(\s*\()?"
# Fixed list of statements that write or change a table.
WRITE = (
    r"(?i)^\s*(?:insert\s+(?:into|overwrite)(?:\s+table)?|merge\s+into|update|delete\s+from|truncate\s+table|drop\s+(?:table|view)(?:\s+if\s+exists)?|alter\s+table|"
    r"create\s+(?:or\s+replace\s+)?(?:temporary\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?|replace\s+table|optimize|vacuum|restore\s+table)\s+"
    rf"({_NAME})"
)
# names that follow FROM without being tables
NOT_TABLES = ["values", "range", "unnest", "lateral", "select"]


def blank_literals(sql: Column) -> Column:
    """Comments and the content of quoted text removed, so that names inside them do not count.

    One scan finds whichever begins first: a quote inside a comment opens no text, a comment mark inside a text no comment.
    """
    text = lambda q: rf"({q})(?:[^{q}\\]++|\\.)*+{q}"
    return F.regexp_replace(sql, rf"(?s)--[^\n]*|/\*.*?\*/|{text(chr(39))}|{text(chr(34))}", " $1$1$2$2 ")


def table_name(raw: Column) -> Column:
    """schema.table in lower case; a catalog prefix is dropped, a bare name belongs to ``default``."""
    parts = F.transform(F.split(raw, r"\."), lambda p: F.lower(F.regexp_replace(F.trim(p), "`", "")))
    two = F.when(F.size(parts) == 3, F.slice(parts, 2, 2)).otherwise(parts)
    return F.when(F.size(two) == 1, F.concat(F.lit("default."), two[0])).otherwise(F.concat_ws(".", two))


def sql_refs(queries: DataFrame, sql: str) -> DataFrame:
    """``reads`` and ``writes`` (arrays of tables) of the statement in each row; names of CTEs are not tables."""
    q = queries.withColumn("_b", blank_literals(F.col(sql)))
    ctes = F.transform(F.regexp_extract_all("_b", F.lit(r"(?i)(?:\bwith|,)\s*([A-Za-z_]\w*)\s+as\s*\("), 1), lambda x: F.lower(x))
    names = F.regexp_extract_all("_b", F.lit(READ), 1)
    calls = F.regexp_extract_all("_b", F.lit(READ), 2)  # "(" after the name: a table function
    bare = lambda n: ~F.contains(n, F.lit("."))
    skip = lambda n: bare(n) & (F.array_contains(F.col("_ctes"), F.lower(F.regexp_replace(n, "`", ""))) | F.lower(n).isin(NOT_TABLES))
    q = q.withColumns({"_ctes": ctes, "_refs": F.arrays_zip(names.alias("n"), calls.alias("c"))})
    kept = F.filter("_refs", lambda r: (r["c"] == "") & ~skip(r["n"]))
    target = F.regexp_extract("_b", WRITE, 1)
    return q.withColumns({
        "reads": F.array_distinct(F.transform(kept, lambda r: table_name(r["n"]))),
        "writes": F.when(target != "", F.array(table_name(target))).otherwise(F.array().cast("array<string>")),
    }).drop("_b", "_ctes", "_refs")


def event_edges(events: DataFrame) -> DataFrame:
    """Edges of each event: the process writes tables, sources flow into them; without a write, tables are read.

    ``events``: job, notebook, kernel, op, user, ts, reads, writes.
    """
    via = (F.when(F.col("job").isNotNull(), F.concat(F.lit("job:"), "job")).when(F.col("notebook").isNotNull(), F.concat(F.lit("notebook:"), "notebook"))
           .otherwise(F.concat(F.lit("query:"), F.coalesce("kernel", F.lit("SQL")))))
    kind = F.when(F.col("job").isNotNull(), "job").when(F.col("notebook").isNotNull(), "notebook").otherwise("query")
    node = lambda t: F.when(F.startswith(t, F.lit("path:")), t).otherwise(F.concat(F.lit("table:"), t))
    e = events.withColumns({"via": via, "via_kind": kind, "_w": F.filter("writes", lambda t: ~F.startswith(t, F.lit("path:")))})
    edge = lambda s, d, k: F.struct(s.alias("src"), d.alias("dst"), F.lit(k).alias("kind"))
    writes = F.transform("_w", lambda w: edge(F.col("via"), F.concat(F.lit("table:"), w), "writes"))
    flows = F.flatten(F.transform("_w", lambda w: F.transform("reads", lambda r: edge(node(r), F.concat(F.lit("table:"), w), "flows"))))
    reads = F.transform(F.filter("reads", lambda r: ~F.startswith(r, F.lit("path:"))), lambda r: edge(node(r), F.col("via"), "reads"))
    all_edges = F.when(F.size("_w") > 0, F.concat(writes, flows)).otherwise(reads)
    return e.select(F.explode(all_edges).alias("e"), "via", "via_kind", "op", "user", "ts").select("e.*", "via", "via_kind", "op", "user", "ts")


def edge_table(edges: DataFrame) -> DataFrame:
    """One row per edge: how often it was seen, first and last time, last operation and user."""
    return edges.groupBy("src", "dst", "kind", "via").agg(
        F.max("via_kind").alias("via_kind"), F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max(F.struct("ts", "op", "user")).alias("_l")).select("src", "dst", "kind", "via", "via_kind", "count", "first_seen", "last_seen", F.col("_l.op").alias("op"), F.col("_l.user").alias("user"))


def with_consumers(edges: DataFrame, consumers: DataFrame) -> DataFrame:
    """Recorded edges plus the reads of consumers (dashboards, alerts ...): consumer, kind, table."""
    c = consumers.select(F.concat(F.lit("table:"), "table").alias("src"), F.col("consumer").alias("dst"), F.lit("reads").alias("kind"), F.col("consumer").alias("via"),
                         F.col("consumer_kind").alias("via_kind"), F.lit(0).cast("bigint").alias("count"))
    return edges.select("src", "dst", "kind", "via", "via_kind", "count").unionByName(c)


def neighbourhood(edges: DataFrame, start: str, depth: int | None = 3) -> DataFrame:
    """(node, level) around a table: positive levels downstream, negative upstream, the nearer side wins.

    Without ``depth`` the walk ends when a hop finds nothing new.  One join per hop on the distinct (src, dst) pairs; only tables and paths are expanded.  The hop
    frontier is stored so that the plan does not grow with the depth.
    """
    pairs = cut_lineage(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    found = None
    for sign, a, b in ((1, "src", "dst"), (-1, "dst", "src")):
        seen = spark.createDataFrame([(start, 0)], "node string, level int")
        frontier = seen
        for d in itertools.count(1) if depth is None else range(1, depth + 1):
            step = frontier.where(F.col("node").rlike("^(table|path):")).join(pairs.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").select(F.col("to").alias("node")).distinct()
            new = cut_lineage(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(d * sign)))
            if new.isEmpty():
                break
            seen, frontier = seen.unionByName(new), new
        found = seen if found is None else found.unionByName(seen)
    return found.groupBy("node").agg(F.min_by("level", F.struct(F.abs("level"), -F.col("level"))).alias("level"))


def impact(edges: DataFrame, start: str, depth: int | None = None) -> DataFrame:
    """Everything downstream of a table (or within ``depth`` hops), counted by kind of node."""
    down = neighbourhood(edges, start, depth).where("level > 0")
    return down.withColumn("kind", F.split("node", ":")[0]).groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


def column_mentions(texts: DataFrame, key: str, text: str, column: str, lines: int | None = None) -> DataFrame:
    """The lines of each text (the first ``lines`` if given) that mention a column as a whole word, not as part of a dotted or longer name; ``n`` counts all."""
    word = rf"(?i)(^|[^\w.]){column}([^\w]|$)"
    hit = F.filter(F.split(text, "\n"), lambda ln: ln.rlike(word))
    shown = hit if lines is None else F.slice(hit, 1, lines)
    return texts.select(key, F.transform(shown, lambda ln: F.trim(ln)).alias("mentions"), F.size(hit).alias("n")).where("n > 0")
