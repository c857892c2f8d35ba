"""Scalar functions offered to feed filters, by their feed names."""

from __future__ import annotations

from pyspark.sql import functions as F

FEED_FUNCTIONS = {
    "tolower": F.lower,
    "toupper": F.upper,
    "trim": F.trim,
    "length": F.length,
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "date": lambda c: c.cast("date"),
    "round": F.round,
    "floor": F.floor,
    "ceiling": F.ceil,
    "contains": F.contains,
    "startswith": F.startswith,
    "endswith": F.endswith,
    "indexof": lambda c, sub: F.position(sub, c) - 1,
    "concat": F.concat,
}
