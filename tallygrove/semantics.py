"""Null, blank, ratio and median rules that many operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed display labels.
BLANK = "(blank)"
MISSING = "(missing)"
EMPTY = "(empty)"
OTHER = "Other"

# Fixed name pattern: measures that are averaged, never added up.
RATE_LIKE = (
    r"score|rating|csat|nps|satisf|minute|duration|time|days?$|age|rate|ratio|pct|percent|price|temp|avg|mean|speed|"
    r"latency|sla|ticket|occupancy"
)

AGGS = ("sum", "avg", "count", "countd", "min", "max", "none")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c, null: str = BLANK) -> Column:
    """A grouping key as text; NULL becomes a visible label."""
    return F.coalesce(col(c).cast("string"), F.lit(null))


def is_blank(c) -> Column:
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def total(c) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def change(cur, prev) -> Column:
    """(cur - prev) / |prev|, NULL when there is no usable previous value."""
    cur, prev = col(cur), col(prev)
    return F.when(prev != 0, (cur - prev) / F.abs(prev))


def growth(cur, prev) -> Column:
    """cur / prev - 1, only for a positive previous value."""
    cur, prev = col(cur), col(prev)
    return F.when(prev > 0, cur / prev - 1)


def share(part, whole) -> Column:
    part, whole = col(part), col(whole)
    return F.when(whole != 0, part / whole)


def aggregate(kind: str, c=None) -> Column:
    """One of the chart aggregations. ``none`` is pinned to the smallest value so that it is repeatable."""
    if kind == "count":
        return F.count(col(c)) if c is not None else F.count(F.lit(1))
    c = col(c)
    return {
        "sum": lambda: total(c),
        "avg": lambda: F.avg(c),
        "countd": lambda: F.count_distinct(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "none": lambda: F.min(c),
    }[kind]()


def upper_median(values: Column) -> Column:
    """The value at index floor(n/2) of the sorted array (used by the insight rules)."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def middle_median(values: Column) -> Column:
    """The usual median: mean of both middle values when the count is even."""
    s = F.array_sort(values)
    n = F.size(s)
    hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (hi + lo) / 2)


def literal_for(df: DataFrame, name: str, value) -> Column:
    """A literal of the column's own type; text keeps a zone-less time free of the session's time zone."""
    return F.lit(value if isinstance(value, (int, float)) else str(value)).cast(df.schema[name].dataType)


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on same-named columns where NULL matches NULL; the key columns come from the left side.

    The right keys get their own names first, so both sides may stem from the same DataFrame.
    """
    names = {k: f"_r_{i}_{k}" for i, k in enumerate(on)}
    r = right.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(names[k]))
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


# Fixed calendar orders, Monday and January first.
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def natural_key(c) -> list[Column]:
    """Sort keys for axis labels: weekdays and month names in calendar order, numbers by value, then text."""
    text = col(c).cast("string")
    name = F.lower(F.substring(text, 1, 3))
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), name)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    plain_name = text.rlike("^(?i)(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?$")
    plain_month = text.rlike(
        "^(?i)(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
    )
    number = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    position = F.when(plain_name, weekday.cast("double")).when(plain_month, month.cast("double")).otherwise(number)
    return [position.asc_nulls_last(), text.asc()]
