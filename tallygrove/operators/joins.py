"""Join shapes: star lookups, orphans, as-of, windows of days, shifted periods, places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name


def star_join(fact: DataFrame, lookups: Sequence[tuple[DataFrame, str, str, str, Sequence[str]]]) -> DataFrame:
    """LEFT JOIN up to three lookup tables.

    Each lookup is (table, fact key, table key, singular name, wanted columns); a column name the
    fact already has is prefixed by the singular name.  Lookups are not hinted: Spark broadcasts
    them when their measured size allows it.
    """
    used = {c.lower() for c in fact.columns}
    out = fact
    for dim, fk, pk, singular, wanted in lookups:
        names = []
        for c in wanted:
            n = c if c.lower() not in used else f"{singular}_{c}"
            used.add(n.lower())
            names.append(F.col(c).alias(n))
        small = dim.select(F.col(pk).alias("_pk"), *names)
        out = out.join(small, out[fk] == F.col("_pk"), "left").drop("_pk")
    return out


def orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Fact rows whose key is set but missing in the lookup table."""
    keys = dim.select(F.col(pk).alias("_pk"))
    return fact.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def with_attributes(df: DataFrame, attrs: DataFrame, key: str, flag: str) -> DataFrame:
    """Descriptive columns plus a flag that says whether the key was found."""
    marked = attrs.withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
         direction: str = "backward", max_days: int | None = None, chunk: str = "month") -> DataFrame:
    """The last observation on or before (backward) or first on or after (forward) each left time.

    Both sides are stacked and swept in time order inside (key, time chunk), so a hot key is spread
    over its chunks.  What a chunk inherits from its neighbours is found on one row per (key, chunk),
    a calendar-sized list.  Of observations with equal times the largest value wins.
    """
    backward = direction == "backward"
    cols = list(left.columns)
    part = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(p) for k, p in zip(keys, part, strict=True)]
    obs = F.struct(F.col(right_time).alias("matched_at"), *values)
    r_rows = right.select(*named, F.col(right_time).alias("_t"), F.lit(0 if backward else 1).alias("_side"),
                          F.lit(None).cast(left.select(F.struct(*cols).alias("r")).schema["r"].dataType).alias("_row"), obs.alias("_obs"))
    l_rows = left.select(*named, F.col(left_time).alias("_t"), F.lit(1 if backward else 0).alias("_side"),
                         F.struct(*cols).alias("_row"), F.lit(None).cast(r_rows.schema["_obs"].dataType).alias("_obs"))
    both = l_rows.unionByName(r_rows).withColumn("_chunk", F.date_trunc(chunk, "_t"))
    w = Window.partitionBy(*part, "_chunk").orderBy("_t", "_side", F.col("_obs").asc_nulls_last())
    across = Window.partitionBy(*part).orderBy("_chunk")
    if backward:
        hit = F.last("_obs", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        edge, carry = F.max("_obs"), F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    else:
        # newest first, so that the frame only grows
        back = Window.partitionBy(*part, "_chunk").orderBy(F.col("_t").desc(), F.col("_side").desc(), F.col("_obs").asc_nulls_first())
        hit = F.last("_obs", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.max_by("_obs", F.when(F.col("_obs").isNotNull(), F.struct(-F.unix_micros(F.col("_t").cast("timestamp")), F.col("_obs"))))
        ahead = Window.partitionBy(*part).orderBy(F.col("_chunk").desc())
        carry = F.last("_edge", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    edges = both.groupBy(*part, "_chunk").agg(edge.alias("_edge")).select(*part, "_chunk", carry.alias("_carry"))
    out = both.withColumn("_in", hit).where(F.col("_row").isNotNull()).join(edges, [*part, "_chunk"], "left")
    out = out.withColumn("_hit", F.coalesce("_in", "_carry"))
    if max_days is not None:
        gap = F.abs(F.datediff(F.col("_t"), F.col("_hit.matched_at")))
        out = out.withColumn("_hit", F.when(gap <= max_days, F.col("_hit")))
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in cols], "_hit.matched_at", *[F.col(f"_hit.{v}").alias(v) for v in values])


def with_previous(df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, chunk: str = "day") -> DataFrame:
    """The value of the row before (by time) of the same key.

    Rows are ordered inside (key, time chunk); the first row of a chunk takes the last value of the
    nearest earlier chunk, found on one row per chunk.  A hot key is spread over its chunks.
    """
    d = df.withColumn("_chunk", F.date_trunc(chunk, time))
    w = Window.partitionBy(*keys, "_chunk").orderBy(time, value)
    edges = d.groupBy(*keys, "_chunk").agg(F.max(F.struct(time, value)).alias("_e"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carry = edges.select(*keys, "_chunk", F.lag(f"_e.{value}").over(across).alias("_carry"))
    d = d.withColumns({"_in": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    out = d.join(carry, [*keys, "_chunk"])
    return out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))).drop("_chunk", "_in", "_first", "_carry")


def shifted_self_join(df: DataFrame, day: str, n: int, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row with the values of the same key ``n`` days earlier."""
    back = df.select(*keys, F.date_add(F.col(day), n).alias(day), *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.join(back, [*keys, day], "left")


def days_in_windows(fact: DataFrame, day: str, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Fact rows with every window (inclusive day range) that holds their day.

    Windows are opened into their days, a calendar-sized list, and joined by equality.
    """
    opened = windows.withColumn("_day", F.explode(F.sequence(F.col(start), F.col(end))))
    return fact.join(opened, fact[day] == F.col("_day")).drop("_day")


def in_top(df: DataFrame, c: str, top: DataFrame, other: str = "Other") -> DataFrame:
    """Values outside the kept list become one label. A list that comes from a LIMIT is broadcast by its statistics."""
    keep = top.select(F.col(top.columns[0]).alias("_keep"))
    return df.join(keep, F.col(c) == F.col("_keep"), "left").withColumn(c, F.coalesce("_keep", F.lit(other))).drop("_keep")


# Fixed suffix words that are ignored when a place name has no direct match.
PLACE_SUFFIXES = ["city", "nagar", "district", "town"]


def geocode(df: DataFrame, name: str, places: DataFrame, countries: DataFrame | None = None, aliases: DataFrame | None = None,
            state: str | None = None, country: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Coordinates by place name: normalised name (or its alias), then the name without a suffix word;
    a state or country hint narrows the matches, the largest population wins; a country alone falls back
    to its own centre.  ``places`` has name, state, country, population, lat, lon.

    Distinct names are resolved once and joined back, so a name that owns many rows is matched once.
    """
    hints = [c for c in (state, country) if c]
    names = df.select(F.col(name).alias("_name"), *[F.col(h).alias(f"_h_{h}") for h in hints]).distinct()
    n = names.withColumn("_norm", norm_name("_name"))
    if aliases is not None:
        al = aliases.select(norm_name("alias").alias("_norm"), norm_name("name").alias("_to")).dropDuplicates(["_norm"])
        n = n.join(al, "_norm", "left").withColumn("_norm", F.coalesce("_to", "_norm")).drop("_to")
    short = F.regexp_replace("_norm", rf"\s+({'|'.join(PLACE_SUFFIXES)})$", "")
    tries = n.withColumn("_try", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("o"), F.col("_norm").alias("n")),
                                                                     F.struct(F.lit(1).alias("o"), short.alias("n"))))))
    p = places.select(norm_name("name").alias("_pn"), norm_name("state").alias("_ps"), F.col("country").alias("_pc"), "population", "lat", "lon")
    hit = tries.join(p, F.col("_try.n") == F.col("_pn"))
    miss = lambda ok: F.when(ok, 0).otherwise(1)
    order: list[Column] = [F.col("_try.o")]
    if state:
        order.append(miss(norm_name(f"_h_{state}") == F.col("_ps")))
    if country:
        order.append(miss(F.col(f"_h_{country}") == F.col("_pc")))
    order += [-F.col("population"), F.col("_pc"), F.col("_ps")]
    best = hit.groupBy("_name", *[f"_h_{h}" for h in hints]).agg(
        F.min_by(F.struct("lat", "lon", F.col("_pc").alias("found_country")), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_b"))
    cond = df[name].eqNullSafe(best["_name"])
    for h in hints:
        cond = cond & df[h].eqNullSafe(best[f"_h_{h}"])
    out = df.join(best, cond, "left").select(df["*"], "_b.lat", "_b.lon", "_b.found_country")
    if countries is not None and country:
        c = countries.select(F.col("country").alias("_cc"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
        out = out.join(c, out[country] == F.col("_cc"), "left")
        out = out.withColumns({"lat": F.coalesce("lat", "_clat"), "lon": F.coalesce("lon", "_clon"),
                               "found_country": F.coalesce("found_country", "_cc")}).drop("_cc", "_clat", "_clon")
    return out
