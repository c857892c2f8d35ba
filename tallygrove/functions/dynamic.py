"""Dynamic-content functions as columns: dates, text, logic, numbers, arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern letters: the text formats of the source on the left, Spark's on the right.
FORMAT_LETTERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d",
                  "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "fff": "SSS", "tt": "a", "T": "'T'", "Z": "'Z'"}


def format_pattern(pattern: str) -> str:
    """A .NET style date pattern as a Spark pattern."""
    return re.sub("|".join(sorted(map(re.escape, FORMAT_LETTERS), key=len, reverse=True)), lambda m: FORMAT_LETTERS[m.group(0)], pattern)


ISO = "yyyy-MM-ddTHH:mm:ssZ"


def format_date_time(c: Column, pattern: str = ISO) -> Column:
    return F.date_format(c, format_pattern(pattern))


def add_time(c: Column, n: Column, unit: str) -> Column:
    """addDays, addHours, addMinutes, addSeconds on a zone-less timestamp."""
    parts = {"days": F.lit(0), "hours": F.lit(0), "mins": F.lit(0), "secs": F.lit(0)}
    parts[unit] = n
    return c + F.make_dt_interval(*parts.values())


def start_of_day(c: Column) -> Column:
    return F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd"))


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(F.lower(a), F.lower(b))


def ends_with(a: Column, b: Column) -> Column:
    return F.endswith(F.lower(a), F.lower(b))


def index_of(a: Column, b: Column) -> Column:
    """Zero-based position ignoring case, -1 when absent."""
    return F.position(F.lower(b), F.lower(a)) - 1


def substring_from(a: Column, start: int, length: int | None = None) -> Column:
    return F.substring(a, start + 1, 2**31 - 1 if length is None else length)


def int_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, as for negative numbers -7 / 2 = -4."""
    return F.floor(a / b)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(a / b)


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1", "yes")


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def skip(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def number_range(start: Column, count: Column) -> Column:
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<bigint>"))


def first_or_null(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last_or_null(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.element_at(a, -1))


def display_number(c: Column, kind: str = "compact", currency: str = "₹") -> Column:
    """Number text: currency, percent, compact (K, L = 1e5, Cr = 1e7) or integer."""
    a = F.abs(c)
    if kind == "percent":
        return F.concat(F.format_number(c * 100, 1), F.lit("%"))
    if kind == "integer":
        return F.format_number(c, 0)
    if kind == "currency":
        return F.concat(F.lit(currency), F.when(a < 100, F.format_number(c, 2)).otherwise(F.format_number(c, 0)))
    small = F.when(a >= 100, F.format_number(c, 0)).when(a >= 10, F.format_number(c, 1)).otherwise(F.format_number(c, 2))
    return (F.when(a >= 1e7, F.concat(F.format_string("%.2f", c / 1e7), F.lit(" Cr"))).when(a >= 1e5, F.concat(F.format_string("%.2f", c / 1e5), F.lit(" L")))
            .when(a >= 1e3, F.concat(F.format_string("%.1f", c / 1e3), F.lit("K"))).otherwise(small))
