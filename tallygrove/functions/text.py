"""Name normalisation and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pairs of accented and plain letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiilnnoorsstuuuzzz"


def norm_name(c) -> Column:
    """Lower case, accents off, everything but letters and digits as single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.translate(F.lower(c.cast("string")), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def slug(c, size: int | None = None) -> Column:
    """Lower case with hyphens; cut only where a ``size`` is given, since two long names could then share one."""
    s = F.regexp_replace(norm_name(c), "[^a-z0-9]+", "-")
    s = F.substring(s, 1, size) if size else s
    return F.when(s == "", "x").otherwise(s)
