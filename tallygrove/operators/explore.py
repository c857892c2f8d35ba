"""Table exploration: histograms, counts, box plots, profiles, correlation, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ranking import quantiles, running_in_groups
from ..semantics import MISSING, join_on, label
from ..session import cut_lineage

#: more than the rank error of a quantile sketch of the default size
SKETCH_ERROR = 0.03


def histogram(df: DataFrame, c: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins: ``bins`` or ceil(log2 n + 1) of them; the last bin is closed. Empty bins are listed."""
    v = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
    s = v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    k = F.lit(bins) if bins else F.ceil(F.log2(F.col("n").cast("double")) + 1)
    s = s.withColumn("bins", F.greatest(F.lit(1), k).cast("int"))
    s = s.withColumn("w", F.coalesce(F.nullif((F.col("hi") - F.col("lo")) / F.col("bins"), F.lit(0.0)), F.lit(1.0)))
    facts = s.select(F.struct("lo", "w", "bins").alias("f")).scalar()  # one row, read as a scalar subquery
    i = F.least(facts["bins"] - 1, F.floor((F.col("v") - facts["lo"]) / facts["w"]).cast("int"))
    counts = v.groupBy(i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = s.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "w")
    out = axis.join(counts, "bin", "left")
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("from"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("to"),
                      F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, c: str, top: int = 30) -> DataFrame:
    """The most frequent values, then (other) and (missing)."""
    counts = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    present = counts.where("v is not null and v <> ''")
    best = present.orderBy(F.col("n").desc(), "v").limit(top)
    facts = counts.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("v").isNull() | (F.col("v") == ""), F.col("n"))), F.lit(0)).alias("missing"))
    shown = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).scalar()
    tail = facts.select(F.explode(F.array(
        F.struct(F.lit("(other)").alias("value"), (F.col("all") - F.col("missing") - shown).alias("n")),
        F.struct(F.lit(MISSING).alias("value"), F.col("missing").alias("n")))).alias("x")).select("x.*").where("n > 0")
    return best.select(F.col("v").alias("value"), "n").unionByName(tail)


def box_plot(df: DataFrame, c: str, by: str | None = None, groups: int | None = None) -> DataFrame:
    """Quartiles with linear interpolation, whiskers at the last values within 1.5 IQR and outlier count of all groups, or of the ``groups`` largest."""
    key = label(by, MISSING) if by else F.lit(c)
    d = df.select(key.alias("g"), F.col(c).cast("double").alias("v")).where("v is not null")
    per = cut_lineage(d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n")))  # counted once, for quartiles and whiskers
    q = quantiles(per, ["g"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("rows", "total")
    if groups:
        q = q.orderBy(F.col("total").desc(), "g").limit(groups)
    j = per.join(q, "g")
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(lo, hi)
    return j.groupBy("g", "total", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"))


def box_outliers(df: DataFrame, c: str, limit: int | None = None) -> DataFrame:
    """The outlier values of a box plot in order, or the first ``limit`` of them."""
    d = df.select(F.col(c).cast("double").alias("v"))
    q = quantiles(d.groupBy("v").agg(F.count(F.lit(1)).alias("_n")), [], "v", {"q1": 0.25, "q3": 0.75})
    q1, q3 = q.select("q1").scalar(), q.select("q3").scalar()
    out = d.where((F.col("v") < q1 - 1.5 * (q3 - q1)) | (F.col("v") > q3 + 1.5 * (q3 - q1))).orderBy("v")
    return out.limit(limit) if limit else out


def co_occurrence(df: DataFrame, x: str, y: str, top: int | None = None) -> DataFrame:
    """Counts of the pairs of values of two columns, or of those among the ``top`` most frequent values of each."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))

    if top is None:
        return cells

    def best(c, raw):
        g = df.where(F.col(raw).isNotNull()).groupBy(F.col(raw).cast("string").alias(c)).agg(F.count(F.lit(1)).alias("k"))
        return g.orderBy(F.col("k").desc(), c).limit(top).select(c)

    return cells.join(best("x", x), "x", "left_semi").join(best("y", y), "y", "left_semi")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def long_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value text, number, rows): the table melted and counted by value.

    Everything a profile needs - distinct values, modes, quartiles - follows from these counts, and
    counting by (column, value) spreads any column over the cluster and collapses repeats early.
    """
    cols = columns or df.columns
    nums = set(numeric_columns(df))
    entry = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                      (F.col(f"`{c}`").cast("double") if c in nums else F.lit(None).cast("double")).alias("number")) for c in cols]
    long = df.select(F.explode(F.array(*entry)).alias("e")).select("e.*")
    return long.groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """``column``, ``q1``, ``median``, ``q3``, exact with linear interpolation.

    ``facts`` has each column's count ``m`` and a sketch of its numbers; the sketch says between which values a quartile
    lies, and only the counted values between them are put in order.  Where the sketch was wrong, all values are.
    """
    bound = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(q, 0.0), 1.0)))
    points = F.explode(F.array(*[
        F.struct(F.lit(n).alias("point"), ((F.col("m") - 1) * F.lit(q)).alias("at"), bound(q - SKETCH_ERROR).alias("low"), bound(q + SKETCH_ERROR).alias("high"))
        for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])).alias("p")
    wanted = facts.where("m > 0").select("column", points).select("column", "p.*")
    numbers = counts.where("number is not null").groupBy("column", "number").agg(F.sum("n").alias("n"))

    def found(wanted: DataFrame) -> DataFrame:
        w = wanted.select(F.col("column").alias("_c"), "point", "at", "low", "high")
        near = numbers.join(w, F.col("column") == F.col("_c")).where("number <= high")
        below = near.groupBy("column", "point").agg(F.coalesce(F.sum(F.when(F.col("number") < F.col("low"), F.col("n"))), F.lit(0)).alias("below"))
        run = running_in_groups(near.where("number >= low").select("column", "point", "at", "number", "n"), ["column", "point"], "number", ["n"])
        run = join_on(run, below, ["column", "point"]).withColumn("first", F.col("below") + F.col("n_below"))
        value = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("first") + F.col("n")), F.col("number")))
        at = run.groupBy("column", "point", "at").agg(value(F.floor("at")).alias("lo"), value(F.ceil("at")).alias("hi"))
        return cut_lineage(at.select("column", "point", "lo", "hi", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value")))

    first = found(wanted)
    missed = join_on(wanted, first.where("lo is not null and hi is not null"), ["column", "point"], "left_anti")
    if missed.limit(1).count():
        first = first.where("lo is not null and hi is not null").unionByName(found(missed.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})))
    return first.groupBy("column").agg(*[F.max(F.when(F.col("point") == n, F.col("value"))).alias(n) for n in ("q1", "median", "q3")])


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 8) -> DataFrame:
    """One row per column: missing, distinct, the ``top`` most frequent values, and for numbers min .. max, mean, sample
    sd, quartiles, zeros, sum, 1.5 IQR outliers and skew = mean of cubed z-scores with the sample sd.

    Counts, extremes, sums (as decimals, so that they do not depend on the order) and a quantile sketch come from one
    plain aggregate; distinct and frequent values from counts by value that are stored once; the rest from one pass
    over those counts.
    """
    cols = list(columns or df.columns)
    nums = set(numeric_columns(df))
    entries = []
    for c in cols:
        value, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        blank = text.isNull() | (text == "")
        number = value.cast("double") if c in nums else F.lit(None).cast("double")
        exact = number.try_cast("decimal(38,10)")
        summed = F.when(F.count(exact) == F.count(number), F.try_sum(exact).cast("double"))
        entries.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("missing"), F.count(number).alias("m"), F.min(number).alias("min"), F.max(number).alias("max"),
            F.coalesce(summed, F.sum(number)).alias("sum"), F.when(F.lit(c in nums), F.count_if(number == 0)).alias("zeros"),
            (F.kll_sketch_agg_double(number) if c in nums else F.lit(None).cast("binary")).alias("sketch"),
            *[(F.lit(None).cast("string") if c in nums else f(F.when(~blank, text))).alias(n) for n, f in (("min_text", F.min), ("max_text", F.max))]))
    facts = cut_lineage(df.agg(F.array(*entries).alias("r")).select(F.inline("r")).withColumn("mean", F.col("sum") / F.nullif("m", F.lit(0))))  # one row per column
    counts = cut_lineage(long_counts(df, cols))
    present = counts.where("value is not null and value <> ''")
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    frequent = present.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    distinct = present.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    known = join_on(facts.drop("sketch"), _quartiles(counts, facts), ["column"], "left")
    c = counts.where("number is not null").join(known.select(F.col("column").alias("_c"), "mean", "q1", "q3", "m"), F.col("column") == F.col("_c"))
    z, iqr, n = F.col("number") - F.col("mean"), F.col("q3") - F.col("q1"), F.col("n")
    out = (F.col("number") < F.col("q1") - 1.5 * iqr) | (F.col("number") > F.col("q3") + 1.5 * iqr)
    second = c.groupBy("column", "m").agg(F.sum(z * z * n).alias("s2"), F.sum(z * z * z * n).alias("s3"), F.coalesce(F.sum(F.when(out, n)), F.lit(0)).alias("outliers"))
    sd = F.sqrt(F.col("s2") / F.greatest(F.lit(1), F.col("m") - 1))
    second = second.select("column", sd.alias("sd"), "outliers", F.when(sd != 0, F.col("s3") / F.pow(sd, 3) / F.col("m")).otherwise(0.0).alias("skew"))
    whole = join_on(join_on(join_on(known, second, ["column"], "left"), distinct, ["column"], "left"), frequent, ["column"], "left")
    return whole.select(
        "column", "rows", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"), F.col("top_values")[0]["value"].alias("top_value"), F.col("top_values")[0]["n"].alias("top_count"), "top_values",
        "min", "max", "mean", "sd", "median", "q1", "q3", "zeros", "sum", "outliers", "skew", "min_text", "max_text")


def table_profile(df: DataFrame, exact: bool = False, examples: int = 3, order: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct values, min, max and examples per column in one scan; approximate distinct counts (about 1 %) unless ``exact``.

    Examples are the values that are set in the first ``examples`` rows by ``order`` (all columns unless given).
    """
    if exact:
        whole, real = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)
        slot = lambda f, types, to: F.col(f"`{f.name}`").cast(to) if isinstance(f.dataType, types) else F.lit(None).cast(to)
        text = lambda f: F.lit(None).cast("string") if isinstance(f.dataType, whole + real) else F.col(f"`{f.name}`").cast("string")
        # numbers stay numbers: a text for each would cost more than the rest
        cells = F.array(*[F.struct(F.lit(i).alias("no"), slot(f, whole, "long").alias("w"), slot(f, real, "double").alias("r"), text(f).alias("t")) for i, f in enumerate(df.schema)])
        values = df.select(F.explode(cells).alias("e")).select("e.*").groupBy("no", "w", "r", "t").agg(F.count(F.lit(1)).alias("n"))
        names = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("no") + 1)
        distinct = values.groupBy("no").agg(F.count(F.when(F.col("w").isNotNull() | F.col("r").isNotNull() | F.col("t").isNotNull(), 1)).alias("distinct")).select(names.alias("column"), "distinct")
    spread = lambda t: isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    none = F.lit(None).cast("string")
    entries = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"),
                        *([] if exact else [F.approx_count_distinct(f"`{f.name}`", 0.01).alias("distinct")]),
                        (F.min(f"`{f.name}`").cast("string") if spread(f.dataType) else none).alias("min"),
                        (F.max(f"`{f.name}`").cast("string") if spread(f.dataType) else none).alias("max")) for f in df.schema]
    out = df.agg(F.array(*entries).alias("r")).select(F.inline("r"))
    if not examples:
        return out.join(distinct, "column") if exact else out
    shown = [f.name for f in df.schema if order or not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = df.orderBy(*[F.col(f"`{c}`") for c in order or shown]).limit(examples).withColumn("_no", F.monotonically_increasing_id())
    cells = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_no").alias("no"), F.col(f"`{c}`").cast("string").alias("v")) for c in shown])).alias("e")).select("e.*")
    some = cells.where("v is not null").groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "v"))), lambda x: x["v"]).alias("examples"))
    out = join_on(out, some, ["column"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return out.join(distinct, "column") if exact else out


def small_category_values(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The values of categories and their counts; with ``limit`` only those of categories with at most so many values."""
    counts = long_counts(df, columns).where("value is not null")
    if limit is None:
        return counts.select("column", "value", "n")
    size = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= limit)
    return counts.join(size, "column").select("column", "value", "n")  # at most ``limit`` per column


def rank_table(df: DataFrame, columns: Sequence[str], key: Sequence[str] | None = None) -> DataFrame:
    """Per row and column an array with, for each other column, the mean rank of the value among rows where that column is set too.

    Each column is counted by value once, with one count for every other column that is present beside it; running
    sums of these counts are the ranks for all missing patterns.
    """
    cols = list(columns)
    own = df.select(*(key or []), *cols)
    present = F.array(*[F.col(c).isNotNull() for c in cols])
    long = own.select(present.alias("_with"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("e")).select("_with", "e.c", "e.v").where("v is not null")
    amounts = [f"_n{i}" for i in range(len(cols))]
    counts = long.groupBy("c", "v").agg(*[F.count_if(F.col("_with")[i]).alias(a) for i, a in enumerate(amounts)])
    run = running_in_groups(counts, ["c"], "v", amounts)
    ranks = run.select("c", "v", F.array(*[F.when(F.col(a) > 0, F.col(f"{a}_below") + (F.col(a) + 1) / 2) for a in amounts]).alias("r"))
    # rows find the ranks column by column and stay rows: few values are sent to all tasks, many are spread; rows without a value are dealt out
    out = own
    for i, c in enumerate(cols):
        of = ranks.where(F.col("c") == c).select(F.col("v").alias(f"_v{i}"), F.lit(0).alias(f"_z{i}"), F.col("r").alias(f"_r{i}"))
        deal = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(*cols), F.lit(1024)).cast("int")).otherwise(0)
        out = out.join(of, (F.col(c) == F.col(f"_v{i}")) & (deal == F.col(f"_z{i}")), "left")
    # null where the row misses the other column
    return out.select(*(key or []), *[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson", key: Sequence[str] | None = None, min_rows: int = 3) -> DataFrame:
    """(a, b, r) for every pair of columns over rows where both are set.

    Pearson is one aggregate over all pairs.  Spearman ranks each column once (ties share their mean
    rank), for every pattern of missing values at the same time: a pair counts its own complete rows.
    """
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if method == "spearman":
        r = rank_table(df.select(*(key or []), *[F.col(c).cast("double").alias(c) for c in cols]), cols, key)
        at = lambda a, b: F.col(a)[cols.index(b)]
        entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.count(at(a, b) + at(b, a)) >= min_rows, F.nanvl(F.corr(at(a, b), at(b, a)), F.lit(None).cast("double"))).alias("r")) for a, b in pairs]
        return r.agg(F.array(*entries).alias("r")).select(F.inline("r"))
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1)))
    # NULL instead of NaN when a column is constant
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(both(a, b) >= min_rows, F.nanvl(F.corr(a, b), F.lit(None).cast("double"))).alias("r")) for a, b in pairs]
    return df.agg(F.array(*entries).alias("r")).select(F.inline("r"))


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares line; R2 is 0 when either side is constant."""
    g = df.groupBy(*by) if by else df.groupBy()
    r = g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
              F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.avg(y).alias("_my"))
    return r.select(*by, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "_my").alias("intercept"),
                    F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0), F.col("_sxy") * F.col("_sxy") / (F.col("_sxx") * F.col("_syy"))).otherwise(0.0).alias("r2"))


def duplicates_and_missing(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and the share of empty cells."""
    empty = sum((F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 1).otherwise(0) for c in df.columns), F.lit(0))
    per = df.withColumn("_empty", empty).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"), F.sum("_empty").alias("_e"))
    return per.agg(F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
                   (100 * F.sum("_e") / (F.sum("_n") * len(df.columns))).alias("missing_pct"))


def viewer_roles(df: DataFrame, profile: DataFrame) -> DataFrame:
    """measure / dimension / date / id / text for each profiled column, by name, type and distinct values."""
    kinds = {f.name: ("num" if isinstance(f.dataType, T.NumericType) else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                      else "bool" if isinstance(f.dataType, T.BooleanType) else "text") for f in df.schema}
    whole = {f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))}
    lengths = df.agg(*[F.avg(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    lengths = lengths.unpivot([], df.columns, "column", "avg_len")
    in_set = lambda names: F.col("column").isin(list(names)) if names else F.lit(False)
    p = profile.join(lengths, "column").withColumn("kind", F.coalesce(*[F.when(F.col("column") == c, F.lit(k)) for c, k in kinds.items()]))
    # fixed name patterns
    id_name = F.col("column").rlike("(?i)(^|_)(id|key|code|no|number|pk)$")
    metric = F.col("column").rlike("(?i)amount|price|qty|quantity|total|value|sales|cost|discount|fee|tax|profit|revenue|score|balance|rate|pct|percent|margin|spend|weight|count")
    n = F.col("rows") - F.col("missing")
    unique = (F.col("distinct") == n) & (n > 20)
    num_role = F.when(id_name | (~metric & unique & in_set(whole)), "id").when((F.col("distinct") <= 12) & in_set(whole) & (n > F.col("distinct") * 3), "dimension").otherwise("measure")
    text_role = F.when(unique & (F.col("avg_len") > 6), "id").when((F.col("distinct") <= F.greatest(F.lit(50.0), F.col("rows") * 0.5)) & (F.col("avg_len") <= 60), "dimension").otherwise("text")
    role = F.when(F.col("kind") == "date", "date").when(F.col("kind") == "num", num_role).when(F.col("kind") == "bool", "dimension").otherwise(text_role)
    return p.withColumn("role", role)


def explore_alerts(df: DataFrame) -> DataFrame:
    """(level, column, alert, number): duplicates, missing values, constants, outliers, skew, imbalance, many categories."""
    p = viewer_roles(df, column_profile(df))
    n = F.col("rows") - F.col("missing")
    miss = F.col("missing") / F.col("rows")
    measure, dim = F.col("role") == "measure", F.col("role") == "dimension"
    entry = lambda cond, level, name, value: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(name).alias("alert"), value.cast("double").alias("number")))
    found = F.array_compact(F.array(
        entry(miss >= 0.2, "warn", "missing", miss), entry((miss > 0) & (miss < 0.2), "info", "missing", miss),
        entry((F.col("distinct") == 1) & (F.col("rows") > 1), "warn", "constant", F.col("distinct")),
        entry(measure & (F.col("outliers") / F.greatest(F.lit(1), n) >= 0.05), "info", "outliers", F.col("outliers")),
        entry(measure & (F.abs("skew") > 1), "info", "skewed", F.col("skew")),
        entry(dim & (F.col("distinct") > 1) & (F.col("top_count") / F.greatest(F.lit(1), n) >= 0.8), "info", "imbalanced", F.col("top_count") / n),
        entry(dim & (F.col("distinct") > 50), "info", "many_categories", F.col("distinct"))))
    per_column = p.select("column", F.explode(found).alias("a")).select("a.level", "column", "a.alert", "a.number")
    dup = duplicates_and_missing(df).where("duplicates > 0").select(
        F.lit("warn").alias("level"), F.lit("(table)").alias("column"), F.lit("duplicates").alias("alert"), F.col("duplicates").cast("double").alias("number"))
    return per_column.unionByName(dup)
