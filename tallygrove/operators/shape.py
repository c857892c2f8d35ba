"""Row and column shaping on the way in: names, types, nesting, de-duplication, stamps."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import is_blank

# ---------------------------------------------------------------- names


def clean_name(name: str, index: int = 0) -> str:
    """Lower-case identifier: other characters become ``_``, a leading digit gets ``c_``, blanks become ``col_n``."""
    n = re.sub(r"[^0-9A-Za-z_]+", "_", str(name)).strip("_").lower()
    if not n or re.fullmatch(r"unnamed(_\d+)?", n):
        return f"col_{index + 1}"
    return f"c_{n}" if n[0].isdigit() else n


def clean_names(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for i, raw in enumerate(names):
        n = clean_name(raw, i)
        while n in out:
            n += "_2"
        out.append(n)
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


# ---------------------------------------------------------------- nested data


def flatten(df: DataFrame, depth: int | str = "all") -> DataFrame:
    """Struct fields become ``parent_child`` columns, down to ``depth`` levels or all of them, in one projection."""
    def leaves(path: str, name: str, kind: T.DataType, left: float) -> list[Column]:
        if not isinstance(kind, T.StructType) or left < 1:
            return [F.col(path).alias(name)]
        return [x for f in kind for x in leaves(f"{path}.`{f.name}`", clean_name(f"{name}_{f.name}"), f.dataType, left - 1)]

    return df.select(*[x for f in df.schema for x in leaves(f"`{f.name}`", f.name, f.dataType, float("inf") if depth == "all" else int(depth))])


def explode_keep(df: DataFrame, c: str) -> DataFrame:
    """One row per array element; rows with an empty array stay, with NULL."""
    return df.withColumn(c, F.explode_outer(c)) if isinstance(df.schema[c].dataType, T.ArrayType) else df


def dig(c: str, path: str) -> Column:
    """A value inside JSON text by a dotted records path such as ``data.items.0.id``."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.get_json_object(c, "$" + steps)


# ---------------------------------------------------------------- mapping


def _text(df: DataFrame, c: str) -> Column:
    nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
    return F.to_json(F.col(f"`{c}`")) if nested else F.col(f"`{c}`").cast("string")


def map_columns(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Keep, rename and convert columns. Types: ``json``, ``string`` or a SQL type (bad values become NULL)."""
    by = {r["name"]: r for r in rules}
    out = []
    for c in df.columns:
        r = by.get(c, {})
        if r.get("keep") is False:
            continue
        t = r.get("type")
        if t == "json":
            e = F.col(c) if isinstance(df.schema[c].dataType, T.StringType) else F.to_json(F.col(c))
        elif t == "string":
            e = _text(df, c)
        elif t and t != "auto":
            e = F.col(f"`{c}`").try_cast(t)
        else:
            e = F.col(f"`{c}`")
        out.append(e.alias(r.get("as") or c))
    return df.select(*out)


def derive(df: DataFrame, derived: Sequence[tuple[str, str]], where: str | None = None) -> DataFrame:
    """SQL expression columns in order (later ones may use earlier ones), then an optional SQL condition."""
    for name, expr in derived:
        df = df.withColumn(name, F.expr(expr))
    return df.where(F.expr(where)) if where else df


# ---------------------------------------------------------------- type inference


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in ("source_file", "_source_file")]


# Number text; special values are listed, because a failing number cast costs an exception per value.
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
INTEGER = r"^\s*[-+]?\d+\s*$"
NUMBER_WORDS = ["nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def _type_tests(q: Column) -> dict[str, Column]:
    """Name of the count -> column that is not NULL for values that fit. Cheap tests run before casts and patterns."""
    first, second = F.substring(q, 1, 1), F.substring(q, 2, 1)
    digit = lambda c: (c >= "0") & (c <= "9")
    number_like = digit(first) | first.isin("+", "-", ".", " ")
    one = F.lit(1)
    return {
        "present": q,
        "as_bigint": F.when(number_like & q.rlike(INTEGER), q.try_cast("bigint")),
        "as_double": F.when(number_like & q.rlike(NUMBER), q.try_cast("double")).otherwise(F.when(~digit(first) & F.lower(F.trim(q)).isin(NUMBER_WORDS), 0.0)),
        "as_boolean": F.when(F.lower(q).isin("true", "false"), one),
        "as_date": q.try_cast("date"),
        "as_timestamp": q.try_cast("timestamp"),
        "zero_led": F.when((first == "0") & digit(second), one),
        "with_colon": F.when(F.contains(q, F.lit(":")), one),
    }


def type_counts(df: DataFrame) -> DataFrame:
    """One row per text column: how many values fit each type. A single scan, however many columns."""
    cols = _strings(df)
    parts = [
        F.struct(F.lit(c).alias("column"), *[F.count(t).alias(n) for n, t in _type_tests(F.col(f"`{c}`")).items()])
        for c in cols
    ]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def decided_types(counts: DataFrame) -> DataFrame:
    n = F.col("present")
    t = (
        F.when((n == 0) | (F.col("zero_led") > 0), "string")
        .when(F.col("as_bigint") == n, "bigint")
        .when(F.col("as_double") == n, "double")
        .when(F.col("as_boolean") == n, "boolean")
        .when((F.col("as_date") == n) & (F.col("as_timestamp") == n) & (F.col("with_colon") == 0), "date")
        .when(F.col("as_timestamp") == n, "timestamp")
        .otherwise("string")
    )
    return counts.withColumn("type", t)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value fits a type get that type; the decision is one row per column."""
    if not _strings(df):
        return df
    chosen = {r["column"]: r["type"] for r in decided_types(type_counts(df)).select("column", "type").collect()}
    return df.select(*[
        F.col(f"`{c}`").try_cast(chosen[c]).alias(c) if chosen.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns
    ])


# Fixed vocabularies of uploaded files.
TRUE_WORDS = ["true", "yes", "y", "t", "1"]
FALSE_WORDS = ["false", "no", "n", "f", "0"]
def parse_when(text: Column) -> Column:
    """Timestamp without zone from ISO text, or from day-first text (31/12/2024, 31-Dec-2024), NULL if neither fits.

    The shape is recognised by a pattern first, so that values of another shape cost no failed parse.
    """
    numeric = F.regexp_replace(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", r"$3-$2-$1")
    return (
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}"), F.replace(text, F.lit("/"), F.lit("-")).try_cast("timestamp_ntz"))
        .when(text.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"), numeric.try_cast("timestamp_ntz"))
        .when(text.rlike(r"^\d{1,2}[- ][A-Za-z]{3}[- ]\d{4}$"),
              F.try_to_timestamp(F.initcap(F.replace(text, F.lit(" "), F.lit("-"))), F.lit("d-MMM-yyyy")).cast("timestamp_ntz"))
    )


# Fixed currency signs that may lead an amount.
CURRENCY = ["₹", "$", "€", "£"]


def plain_number_text(text: Column) -> Column:
    """Without thousands commas and one leading currency sign."""
    t = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(F.substring(t, 1, 1).isin(CURRENCY), F.ltrim(F.substring(t, 2, 2**31 - 1))).otherwise(t)


def clean_number(plain: Column) -> Column:
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def tolerant_type_ratios(df: DataFrame) -> DataFrame:
    """Per text column the facts that decide its type when a few values may be off."""
    parts = []
    for c in _strings(df):
        t = F.when(~is_blank(f"`{c}`"), F.trim(F.col(f"`{c}`")))
        low, bare = F.lower(t), F.replace(t, F.lit(","), F.lit(""))
        plain = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
        when = parse_when(t)
        n = F.count(t)
        parts.append(F.struct(
            F.lit(c).alias("column"), n.alias("present"),
            F.count_if(low.isin(TRUE_WORDS + FALSE_WORDS)).alias("boolean_words"),
            F.count_if(low.isin([w for w in TRUE_WORDS + FALSE_WORDS if w not in ("0", "1")])).alias("plain_words"),
            F.count_if(t.rlike(r"^0\d+$")).alias("zero_led"),
            F.count(plain).alias("numbers"), F.count_if(plain % 1 != 0).alias("fractions"), F.max(F.abs(plain)).alias("largest"),
            F.count_if(t.rlike(r"\d") & F.length(t).between(6, 32)).alias("date_like"),
            F.count(when).alias("dates"), F.count_if(t.rlike(r"\d:\d")).alias("with_time"),
        ))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def tolerant_types(ratios: DataFrame) -> DataFrame:
    n = F.col("present")
    t = (
        F.when(n == 0, "string")
        .when((F.col("boolean_words") == n) & (F.col("plain_words") > 0), "boolean")
        .when(F.col("zero_led") > 0, "string")
        .when((F.col("numbers") / n >= 0.98) & (F.col("fractions") == 0) & (F.col("largest") < 2.0**62), "bigint")
        .when(F.col("numbers") / n >= 0.98, "double")
        .when((F.col("date_like") == n) & (F.col("dates") / n >= 0.95), F.when(F.col("with_time") == 0, "date").otherwise("timestamp"))
        .otherwise("string")
    )
    return ratios.withColumn("type", t)


def _prepare(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Helper columns for the conversion, one projection per step so that no expensive text work is repeated:
    ``_t_`` trimmed text or NULL when blank, ``_n_`` its number.
    """
    d = df.withColumns({f"_t_{c}": F.when(~is_blank(f"`{c}`"), F.trim(F.col(f"`{c}`"))) for c in types})
    numeric = [c for c, t in types.items() if t in ("bigint", "double") or t.startswith("decimal")]
    if numeric:
        d = d.withColumns({f"_p_{c}": plain_number_text(F.col(f"_t_{c}")) for c in numeric})
        d = d.withColumns({f"_n_{c}": clean_number(F.col(f"_p_{c}")) for c in numeric})
    return d


def _converted(c: str, t: str) -> Column:
    text, number = F.col(f"_t_{c}"), F.col(f"_n_{c}")
    if t == "string":
        return F.when(text.isNotNull(), F.col(f"`{c}`"))
    if t == "bigint":  # digits are read as they are: a double holds 53 bits only
        plain = F.col(f"_p_{c}")
        digits = plain.rlike(r"^[+-]?\d+(\.0*)?$")
        return F.when(digits, F.regexp_replace(plain, r"\.0*$", "").try_cast("bigint")).when(number % 1 == 0, number.try_cast("bigint"))
    if t == "double" or t.startswith("decimal"):
        return number.try_cast(t)
    if t == "boolean":
        low = F.lower(text)
        return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)
    return parse_when(text).cast("date") if t == "date" else parse_when(text)


def convert(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns as typed columns; values that do not fit become NULL."""
    return _prepare(df, types).select(*[_converted(c, types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def reject_counts(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per column how many non-blank values the conversion would lose."""
    d = _prepare(df, types)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"),
                      F.count_if(F.col(f"_t_{c}").isNotNull() & _converted(c, t).isNull()).alias("rejected")) for c, t in types.items()]
    return d.agg(F.array(*parts).alias("r")).select(F.inline("r"))


# ---------------------------------------------------------------- rows


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without rows whose every column is blank."""
    some = F.lit(False)
    for c in df.columns:
        some = some | ~is_blank(f"`{c}`")
    return df.where(some)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, first in ``order``.

    Spark limits each task to one row per key before the shuffle (WindowGroupLimit),
    so a key that owns a third of all rows costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str] = (), newest: bool = True) -> DataFrame:
    first = F.col(by).desc_nulls_last() if newest else F.col(by).asc_nulls_last()
    return keep_one(df, keys, [first, *[F.col(t).desc() for t in ties]])


def preview_stats(df: DataFrame) -> DataFrame:
    """Per column: blanks, distinct values and a cleaned name; distinct counts come from one long table.

    Distinct values are counted as a plain two-step groupBy over (column, value), which spreads
    by value instead of multiplying every row once per column inside one aggregate.
    """
    names = dict(zip(df.columns, clean_names(df.columns), strict=True))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(names[c]).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns
    ])).alias("x")).select("x.*")
    per_value = long.groupBy("column", "name", "v").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column", "name").agg(
        F.sum(F.when(is_blank("v"), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("distinct"))


# ---------------------------------------------------------------- tenant stamps


def stamp(df: DataFrame, tenant: str, tenant_col: str = "tenant", business_col: str = "business", business: str | None = None,
          source: str | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Tenant and business columns in front. The business is a constant, or the source id looked up in
    ``mapping`` (source_id, business) and kept as it is when unmapped, or NULL.
    """
    rest = [c for c in df.columns if c not in (tenant_col, business_col)]
    if business is not None:
        out = df.withColumn("_b", F.lit(business))
    elif source and mapping is not None:
        ids = mapping.select(F.col("source_id").cast("string").alias("_sid"), F.col("business").alias("_mapped")).dropDuplicates(["_sid"])
        out = df.withColumn("_src", F.col(source).cast("string")).join(ids, F.col("_src") == F.col("_sid"), "left")
        out = out.withColumn("_b", F.coalesce("_mapped", "_src"))
    elif source:
        out = df.withColumn("_b", F.col(source).cast("string"))
    else:
        out = df.withColumn("_b", F.lit(None).cast("string"))
    return out.select(F.lit(tenant).alias(tenant_col), F.col("_b").alias(business_col), *rest)


def audit_stamp(df: DataFrame, name: str = "_ingested_at", as_of=None) -> DataFrame:
    return df.withColumn(name, F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp"))
