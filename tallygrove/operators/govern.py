"""Column masks, row filters, access decisions, audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import join_on
from ..session import cut_lineage
from .joins import asof


def mask(c: str, kind: str, salt: str = "", custom: str | None = None) -> Column:
    """hash (md5 of salt and text), partial (last four), email (domain only), redact, null, or an own SQL expression with {col}."""
    text = F.col(c).cast("string")
    if kind == "custom":
        return F.expr(custom.replace("{col}", f"`{c}`"))
    return {
        "hash": lambda: F.md5(F.concat(F.lit(salt), text)),
        "partial": lambda: F.concat(F.lit("****"), F.substring(text, -4, 4)),
        "email": lambda: F.regexp_replace(text, "^[^@]+", "***"),
        "redact": lambda: F.lit("****"),
        "null": lambda: F.lit(None).cast("string"),
    }[kind]()


def apply_masks(df: DataFrame, masks: Sequence[Mapping], user: Mapping, salt: str = "") -> DataFrame:
    """``masks``: column, kind, exempt (users, roles or companies that see the value)."""
    who = {user.get("username"), user.get("role"), user.get("company")} - {None}
    active = {m["column"]: m for m in masks if not who & set(m.get("exempt", ()))}
    return df.select(*[mask(c, active[c]["kind"], salt, active[c].get("expr")).alias(c) if c in active else F.col(c) for c in df.columns])


def apply_row_filters(df: DataFrame, filters: Sequence[str], user: Mapping) -> DataFrame:
    """All filters must hold; {username}, {email}, {company} and {role} are bound as values."""
    names = ("username", "email", "company", "role")
    for f in filters:
        args = {n: user.get(n) for n in names if "{" + n + "}" in f}
        for n in args:
            f = f.replace("{" + n + "}", f":{n}")
        df = df.sparkSession.sql(f"SELECT * FROM {{df}} WHERE {f}", args=args, df=df)
    return df


def grants_for(users: DataFrame, objects: DataFrame, grants: DataFrame, privilege: str = "SELECT") -> DataFrame:
    """(username, object) pairs a grant allows.

    ``users``: username, role, company; ``objects``: object (schema.table); ``grants``: principal_type
    (everyone, user, role, company), principal, object (*, schema.* or schema.table), privilege (or ALL).
    A grant is matched to its users by principal and to its objects by name: equality joins only, and the
    result is no larger than the access it describes.
    """
    g = grants.where(F.col("privilege").isin(privilege, "ALL")).select("principal_type", F.coalesce("principal", F.lit("")).alias("principal"), F.col("object").alias("pattern")).distinct()
    p = lambda t, c: F.struct(F.lit(t).alias("principal_type"), F.coalesce(c, F.lit("\0")).alias("principal"))
    who = users.select("username", F.explode(F.array(p("everyone", F.lit("")), p("user", F.col("username")), p("role", F.col("role")), p("company", F.col("company")))).alias("p")).select("username", "p.*")
    allowed = who.join(g, ["principal_type", "principal"]).select("username", "pattern").distinct()
    what = objects.select("object", F.explode(F.array(F.lit("*"), F.concat(F.split("object", r"\.")[0], F.lit(".*")), F.col("object"))).alias("pattern"))
    return allowed.join(what, "pattern").select("username", "object").distinct()


def throttled_audit(reads: DataFrame, keys: Sequence[str], time: str, seconds: int = 60) -> DataFrame:
    """The reads that are written to the audit: the first of each key, then the first one at least ``seconds`` later, and so on.

    Every kept read decides about the next, so the kept reads are a chain.  Each read gets a pointer to the first
    read at least ``seconds`` later; following the chain from the first read by doubling the pointers takes
    log2(kept reads) joins, however many reads one key has.
    """
    keys = list(keys)
    nodes = cut_lineage(reads.select(*keys, F.col(time).alias("_t")).distinct())
    due = nodes.withColumn("_due", F.col("_t") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    nxt = asof(due, nodes, keys, "_due", "_t", [], "forward", chunk="hour").where("matched_at is not null")
    jump = cut_lineage(nxt.select(*keys, "_t", F.col("matched_at").alias("_n")))
    kept = nodes.groupBy(*keys).agg(F.min("_t").alias("_t"))
    while True:
        step = join_on(kept, jump, [*keys, "_t"]).select(*keys, F.col("_n").alias("_t"))
        new = cut_lineage(join_on(step.distinct(), kept, [*keys, "_t"], "left_anti"))
        if new.isEmpty():
            return kept.withColumnRenamed("_t", time)
        kept = cut_lineage(kept.unionByName(new))
        far = jump.select(*keys, F.col("_t").alias("_n"), F.col("_n").alias("_far"))
        jump = cut_lineage(join_on(jump, far, [*keys, "_n"]).select(*keys, "_t", F.col("_far").alias("_n")))


def search_audit(audit: DataFrame, text: str = "", user: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit rows of a user that contain a text in any column, newest first. ``audit`` has ts and username."""
    d = audit.where(F.col("username") == user) if user else audit
    if text:
        d = d.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in d.columns])), F.lit(text.lower())))
    found = d.orderBy(F.col("ts").desc(), *[c for c in d.columns if c != "ts"])
    return found.limit(limit) if limit else found
