"""Parameters, predicates, period windows, time buckets and result pages."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.feed import FEED_FUNCTIONS
from ..semantics import EMPTY, col

# ---------------------------------------------------------------- SQL parameters


def run_with_params(spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """``{{name}}`` placeholders bound as typed values; unknown or empty ones are NULL, lists become value lists.

    Values are bound by Spark's named parameters, never pasted into the text.
    """
    given, args = dict(params or {}), {}

    def mark(m: re.Match) -> str:
        name = m.group(1)
        v = given.get(name)
        if v is None or v == "" or v == []:
            return "NULL"
        if isinstance(v, (list, tuple)):
            args.update({f"{name}_{i}": x for i, x in enumerate(v)})
            return "(" + ", ".join(f":{name}_{i}" for i in range(len(v))) + ")"
        if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
            v = dt.date.fromisoformat(v)
        args[name] = v
        return f":{name}"

    text = re.sub(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", mark, sql)
    return spark.sql(text, args=args, **views)


def linked_filter(c, value) -> Column:
    """An optional filter: no value keeps every row; otherwise text equality."""
    if value is None or value == "":
        return F.lit(True)
    return col(c).cast("string") == F.lit(str(value))


# ---------------------------------------------------------------- predicates from specs


def dashboard_filter(df: DataFrame, filters: Sequence[Mapping], own: str | None = None) -> DataFrame:
    """Filters of a page: ``equals``, ``list``, ``text`` (contains, any case) and ``date_range``.

    A filter on the ``own`` column is skipped: the chart that sets a choice keeps all its values.
    """
    for f in filters:
        c, v = f["column"], f.get("value")
        if c not in df.columns or v in (None, "", [], {}) or c == own:
            continue
        kind = f.get("type", "equals")
        if kind == "date_range":
            day = col(c).cast("date")
            if v.get("from"):
                df = df.where(day >= F.lit(v["from"]).cast("date"))
            if v.get("to"):
                df = df.where(day <= F.lit(v["to"]).cast("date"))
        elif isinstance(v, (list, tuple)):
            df = df.where(col(c).cast("string").isin([str(x) for x in v]))
        elif kind == "text":
            df = df.where(F.contains(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit(str(v).lower())))
        else:
            df = df.where(col(c).cast("string") == F.lit(str(v)))
    return df


def _as_number(c: Column, kind: T.DataType) -> Column:
    return c.cast("double") if isinstance(kind, T.NumericType) else c.try_cast("double")


def condition(df: DataFrame, name: str, op: str, value) -> Column:
    """Widget condition; ordering compares as numbers when both sides are numeric, else as text."""
    c, kind = F.col(name), df.schema[name].dataType
    text = c.cast("string")
    if op == "in":
        values = value if isinstance(value, (list, tuple)) else str(value).split(",")
        return text.isin([str(v).strip() for v in values])
    if op == "contains":
        return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(str(value).lower()))
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    is_num = isinstance(kind, T.NumericType)
    if op in ("eq", "neq"):
        same = c.cast("double") == F.lit(number) if is_num and number is not None else text == F.lit(str(value))
        return F.coalesce(same, F.lit(False)) if op == "eq" else ~F.coalesce(same, F.lit(False))
    compare = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}[op]
    as_text = getattr(text, compare)(F.lit(str(value)))
    if number is None:
        return F.lit(False) if is_num else F.coalesce(as_text, F.lit(False))
    n = _as_number(c, kind)
    as_number = getattr(n, compare)(F.lit(number))
    return F.coalesce(as_number if is_num else F.when(n.isNotNull(), as_number).otherwise(as_text), F.lit(False))


def quick_filter(df: DataFrame, name: str, text: str) -> Column:
    """The one-box shorthand: ``a..b``, ``> >= < <= = !=``, ``null``, a comma list, or contains."""
    c, numeric = F.col(name), isinstance(df.schema[name].dataType, T.NumericType)
    s, e = c.cast("string"), text.strip()
    side = c.cast("double") if numeric else s
    lit = (lambda x: F.lit(float(x))) if numeric else (lambda x: F.lit(x.strip()))
    if not e:
        return F.lit(True)
    if ".." in e.strip("."):
        a, b = e.split("..", 1)
        return F.coalesce(side.between(lit(a), lit(b)), F.lit(False))
    m = re.match(r"(>=|<=|!=|=|>|<)\s*(.*)$", e)
    if m:
        op, raw = m.groups()
        if raw.strip().lower() == "null":
            return c.isNotNull() if op == "!=" else c.isNull()
        v = lit(raw)
        if op == "!=":
            return c.isNull() | (side != v)
        test = {">": side > v, "<": side < v, ">=": side >= v, "<=": side <= v, "=": side == v}[op]
        return F.coalesce(test, F.lit(False))
    if e.lower() == "null":
        return c.isNull()
    if "," in e:
        return F.coalesce(F.lower(s).isin([x.strip().lower() for x in e.split(",")]), F.lit(False))
    return F.coalesce(F.contains(F.lower(s), F.lit(e.lower())), F.lit(False))


def column_condition(df: DataFrame, name: str, op: str, a=None, b=None, values: Sequence[str] | None = None) -> Column:
    """Column menu filter. A blank string counts as empty; dates compare on their day."""
    c, kind = F.col(name), df.schema[name].dataType
    text = c.cast("string")
    if values is not None:
        return F.coalesce(text, F.lit(EMPTY)).isin(list(values))
    has = F.coalesce(text != "", F.lit(False))
    if isinstance(kind, T.NumericType):
        v, lo, hi = c.cast("double"), *(None if x is None else F.lit(float(x)) for x in (a, b))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        v, lo, hi = c.cast("date").cast("string"), *(None if x is None else F.lit(str(x)) for x in (a, b))
    else:
        v, lo, hi = F.lower(text), *(None if x is None else F.lit(str(x).lower()) for x in (a, b))
    tests = {
        "null": lambda: ~has,
        "notnull": lambda: has,
        "eq": lambda: has & (v == lo),
        "neq": lambda: ~has | (v != lo),
        "gt": lambda: has & (v > lo),
        "gte": lambda: has & (v >= lo),
        "lt": lambda: has & (v < lo),
        "lte": lambda: has & (v <= lo),
        "between": lambda: has & (v >= lo) & (v <= hi),
        "contains": lambda: has & F.contains(v, lo),
        "notcontains": lambda: ~has | ~F.contains(v, lo),
        "starts": lambda: has & F.startswith(v, lo),
        "ends": lambda: has & F.endswith(v, lo),
    }
    return F.coalesce(tests[op](), F.lit(False))


def feed_predicate(spec) -> Column:
    """A nested tuple such as ``("and", ("gt", "price", 5), ("contains", "name", "'ring"))`` as a column.

    Strings name columns; a leading ``'`` marks a text value.
    """
    if isinstance(spec, str):
        return F.lit(spec[1:]) if spec.startswith("'") else F.col(spec)
    if not isinstance(spec, tuple):
        return F.lit(spec)
    op, *args = spec
    if op in ("and", "or"):
        parts = [feed_predicate(a) for a in args]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if op == "and" else (out | p)
        return out
    if op == "not":
        return ~feed_predicate(args[0])
    if op in ("eq", "ne") and args[1] is None:
        left = feed_predicate(args[0])
        return left.isNull() if op == "eq" else left.isNotNull()
    values = [feed_predicate(a) for a in args]
    compare = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}
    if op in compare:
        return getattr(values[0], compare[op])(values[1])
    return FEED_FUNCTIONS[op](*values)


# ---------------------------------------------------------------- periods


@dataclass(frozen=True)
class Days:
    """An inclusive range of days."""

    start: dt.date
    end: dt.date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def holds(self, c) -> Column:
        return col(c).between(F.lit(self.start), F.lit(self.end))


def _month_shift(d: dt.date, n: int) -> dt.date:
    m = d.year * 12 + d.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def _month_end(d: dt.date) -> dt.date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def period_windows(preset: str, anchor: dt.date, start: dt.date | None = None, end: dt.date | None = None):
    """(current, previous) day ranges of a dashboard period; ``(None, None)`` means all data."""
    one = dt.timedelta(days=1)
    first = anchor.replace(day=1)
    if preset == "last_12_months":
        cur = Days(_month_shift(first, -11), anchor)
        return cur, Days(_month_shift(cur.start, -12), cur.start - one)
    if preset == "this_month":
        before = _month_shift(first, -1)
        return Days(first, anchor), Days(before, min(before + (anchor - first), first - one))
    if preset == "last_month":
        before = _month_shift(first, -1)
        return Days(before, first - one), Days(_month_shift(before, -1), before - one)
    if preset == "last_week":
        monday = anchor - dt.timedelta(days=anchor.weekday())
        cur = Days(monday - dt.timedelta(days=7), monday - one)
    elif preset == "custom" and start and end:
        cur = Days(start, end)
    elif m := re.fullmatch(r"last_(7|14|30|90)_days", preset):
        cur = Days(anchor - dt.timedelta(days=int(m.group(1)) - 1), anchor)
    else:
        return None, None
    return cur, Days(cur.start - dt.timedelta(days=cur.days), cur.start - one)


#: Days before today at which an overview range begins; the calendar ones begin with their month, quarter or year.
_BACK = {"today": 0, "7d": 6, "28d": 27, "30d": 29, "90d": 89, "12m": 364}
_CALENDAR = {"mtd": lambda d: d.month, "qtd": lambda d: (d.month - 1) // 3 * 3 + 1, "ytd": lambda d: 1}


def overview_range(preset: str, today: dt.date, first_day: dt.date, start: dt.date | None = None, end: dt.date | None = None):
    """(current, previous or None, partial): ranges of the overview page, held inside the days that have data."""
    if preset == "custom" and start and end:
        asked = Days(*sorted((start, end)))
    elif preset in _CALENDAR:
        asked = Days(dt.date(today.year, _CALENDAR[preset](today), 1), today)
    else:
        asked = Days(today - dt.timedelta(days=_BACK.get(preset, _BACK["28d"])), today)
    held = lambda d, last: max(first_day, min(d, last)) if first_day <= last else last
    stop = held(asked.end, today)
    current = Days(held(asked.start, stop), stop)
    before = Days(current.start - dt.timedelta(days=current.days), current.start - dt.timedelta(days=1))
    inside = Days(max(before.start, first_day), before.end)
    return current, (inside if inside.days > 0 else None), before.start < first_day


def date_bounds(df: DataFrame, c: str) -> tuple[dt.date, dt.date]:
    """First and last day of a column: one row that chooses the windows."""
    row = df.agg(F.min(F.col(c).cast("date")).alias("lo"), F.max(F.col(c).cast("date")).alias("hi")).first()
    return row["lo"], row["hi"]


def split_periods(df: DataFrame, day: str, windows: Mapping[str, Days]) -> DataFrame:
    """One row per (input row, window that holds it), column ``period``; the scan keeps only those days."""
    lo, hi = min(w.start for w in windows.values()), max(w.end for w in windows.values())
    hits = F.array_compact(F.array(*[F.when(w.holds(day), F.lit(n)) for n, w in windows.items()]))
    return df.where(F.col(day).between(F.lit(lo), F.lit(hi))).withColumn("period", F.explode(hits))


# ---------------------------------------------------------------- time values


def parse_time(c) -> Column:
    """ISO text (zone optional), ``YYYY-MM``, epoch seconds (> 1e9) or milliseconds (> 1e12) as timestamp."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), text)
    # milliseconds; floor keeps the same second for fractional seconds
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("bigint"))).when(
        number > 1e9, F.timestamp_millis((number * 1000).cast("bigint"))
    )
    return F.coalesce(epoch, F.coalesce(iso, month).try_cast("timestamp"))


def parse_cursor(c) -> Column:
    """A saved cursor as time: epoch seconds in 9e8..5e9 (milliseconds above 1e11), else ISO text."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    ok = F.when(seconds.between(9e8, 5e9), F.timestamp_millis((seconds * 1000).cast("bigint")))
    return F.when(number.isNotNull(), ok).otherwise(parse_time(text))


GRAINS = ("hour", "day", "week", "month", "quarter", "year")


def bucket(c, grain: str) -> Column:
    """Bucket label: hour, day, week (its Monday), ``YYYY-MM``, ``YYYY-Qn`` or year."""
    c = col(c)
    if grain == "hour":
        return F.date_format(c, "yyyy-MM-dd'T'HH:00")
    day = c.cast("date")
    return {
        "day": lambda: F.date_format(day, "yyyy-MM-dd"),
        "week": lambda: F.date_format(F.date_sub(day, F.weekday(day)), "yyyy-MM-dd"),
        "month": lambda: F.date_format(day, "yyyy-MM"),
        "quarter": lambda: F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")),
        "year": lambda: F.year(day).cast("string"),
    }[grain]()


def auto_grain(days: float) -> str:
    """Chart grain for a span of days."""
    for limit, grain in ((2, "hour"), (120, "day"), (540, "week"), (3650, "month")):
        if days <= limit:
            return grain
    return "year"


def overview_grain(days: int) -> str:
    return "day" if days <= 45 else "week" if days <= 200 else "month"


# ---------------------------------------------------------------- pages


def orderable(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def feed_page(df: DataFrame, order: Sequence[str | Column] | None = None, skip: int = 0, size: int = 5000) -> DataFrame:
    """One page in a total order: the rows, ``_row`` number, ``_more`` flag and ``_total`` rows.

    The order given is extended by every other orderable column so that pages never overlap.
    Spark keeps only the first skip + size rows per task; for deep pages use ``feed_page_after``.
    """
    order = list(order or [])
    named = [o for o in order if isinstance(o, str)]
    keys = order + [c for c in orderable(df) if c not in named]
    page = df.orderBy(*keys).offset(skip).limit(size + 1)
    # at most size + 1 rows reach this window
    w = Window.orderBy(*keys)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        page.withColumn("_row", F.row_number().over(w) + F.lit(skip))
        .withColumn("_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
        .where(F.col("_row") <= skip + size)
        .withColumn("_total", total)
    )


def feed_page_after(df: DataFrame, keys: Sequence[str], last: Sequence, size: int = 5000) -> DataFrame:
    """The next page after the row with key values ``last`` (ascending): a filter, so depth costs nothing."""
    after = F.lit(False)
    for i, k in enumerate(keys):
        same = F.lit(True)
        for j in range(i):
            same = same & F.col(keys[j]).eqNullSafe(F.lit(last[j]))
        after = after | (same & (F.col(k) > F.lit(last[i])))
    return df.where(after).orderBy(*keys).limit(size)


def with_truncated_flag(df: DataFrame, limit: int, order: Sequence[str | Column] | None = None) -> DataFrame:
    """At most ``limit`` rows plus ``truncated``: limit + 1 rows are read to know whether more exist."""
    head = (df.orderBy(*order) if order else df).limit(limit + 1)
    keys = list(order or [F.lit(1)])
    numbered = head.withColumn("_rn", F.row_number().over(Window.orderBy(*keys)))
    return (
        numbered.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
        .where(F.col("_rn") <= limit)
        .drop("_rn")
    )
