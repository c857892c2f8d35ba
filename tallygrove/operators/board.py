"""Live board: the daily cube by location and everything computed from it.

The fact is scanned once per cube (``board_cube``, ``board_split``); cards, shares, roll-ups and reports
are aggregates of the cube, whose size is days x kept locations.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..ranking import global_row_number
from ..semantics import OTHER, change, growth, join_on, label
from ..session import cut_lineage
from .filters import Days
from .sets import distinct_sets, merge_sets, numbered, set_sizes

@dataclass(frozen=True)
class Roles:
    """Which column plays which part. Modes: ``sum`` or ``countd``; no measure means counting rows."""

    day: str
    site: str
    measure: str | None = None
    orders: str | None = None
    orders_mode: str = "countd"
    customers: str | None = None
    customers_mode: str = "countd"
    rate: str | None = None
    rate_scale: float = 1.0
    category: str | None = None
    segment: str | None = None
    city: str | None = None
    state: str | None = None
    country: str | None = None
    lat: str | None = None
    lon: str | None = None


def _primary(r: Roles) -> Column:
    return F.sum(F.col(r.measure).cast("double")) if r.measure else F.count(F.lit(1)).cast("double")


def board_entities(fact: DataFrame, r: Roles, limit: int | None = None) -> DataFrame:
    """The largest locations with their place attributes; the rest become one "Other" row."""
    text = lambda c: F.max(F.col(c).cast("string")) if c else F.lit(None).cast("string")
    mean = lambda c: F.avg(F.col(c).cast("double")) if c else F.lit(None).cast("double")
    g = fact.where(F.col(r.day).isNotNull()).groupBy(label(r.site).alias("entity")).agg(
        _primary(r).alias("value"), text(r.city).alias("city"), text(r.state).alias("state"), text(r.country).alias("country"),
        mean(r.lat).alias("lat"), mean(r.lon).alias("lon"))
    top = g.orderBy(F.col("value").desc_nulls_last(), "entity").withColumn("is_other", F.lit(False))
    if limit is None:
        return top
    top = top.limit(limit)
    whole, n = g.agg(F.sum("value")).scalar(), g.agg(F.count(F.lit(1))).scalar()
    rest = top.agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("k")).where(n > F.col("k")).select(
        F.lit(OTHER).alias("entity"), (whole - F.col("v")).alias("value"), *[F.lit(None).cast("string").alias(c) for c in ("city", "state", "country")],
        *[F.lit(None).cast("double").alias(c) for c in ("lat", "lon")], F.lit(True).alias("is_other"))
    return top.unionByName(rest)


def top_items(fact: DataFrame, r: Roles, column: str, measure: Column | None = None, n: int = 7) -> DataFrame:
    """The n largest categories or segments."""
    g = fact.where(F.col(r.day).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("item")).agg((measure if measure is not None else _primary(r)).alias("value"))
    return g.orderBy(F.col("value").desc_nulls_last(), "item").limit(n)


def history_days(span: int, entities: int, items: Sequence[int] = (), max_days: int | None = None, max_cells: int | None = None, least: int = 92) -> int:
    """Days of history to keep: all of the span, or what fits into the asked limits of days and of cells (locations, and locations x items), but not under ``least``."""
    days = [span] if max_days is None else [span, max_days]
    if max_cells is not None:
        days += [max_cells // max(1, entities * k) for k in (1, *items)]
    return max(min(span, least), min(days))


def _kept(fact: DataFrame, c: Column, keep: DataFrame, name: str) -> DataFrame:
    """The column mapped to the kept list or "Other". Lists that come from a LIMIT are broadcast by their statistics."""
    k = keep.select(F.col(keep.columns[0]).alias("_k"))
    return fact.withColumn("_v", c).join(k, F.col("_v") == F.col("_k"), "left").withColumn(name, F.coalesce("_k", F.lit(OTHER))).drop("_v", "_k")


def _counted(r: Roles) -> dict[str, str]:
    """Cube column -> id column, for the parts that count distinct ids."""
    return {c: column for c, column, mode in (("s", r.orders, r.orders_mode), ("q", r.customers, r.customers_mode)) if column and mode == "countd"}


def board_sets(fact: DataFrame, r: Roles, days: Days, keep: DataFrame) -> DataFrame:
    """(day, entity, set, bucket, bits): the ids behind ``s`` and ``q`` of the cube, exact and mergeable over days and locations."""
    f = _kept(fact.where(days.holds(r.day)), label(r.site), keep, "entity")
    counted = _counted(r)
    for c, column in counted.items():
        f = numbered(f, column, f"_id_{c}")
    return distinct_sets(f.withColumn("day", F.col(r.day)), ["day", "entity"], {c: f"_id_{c}" for c in counted})


def board_cube(fact: DataFrame, r: Roles, days: Days, keep: DataFrame) -> DataFrame:
    """(day, entity, p, s, q, r): primary, orders, customers and mean rate per day and kept location.

    Distinct orders and customers are sizes of bitmap sets, so that no row is multiplied by the aggregate.
    """
    f = _kept(fact.where(days.holds(r.day)), label(r.site), keep, "entity")
    rate = F.avg(F.col(r.rate).cast("double")) * r.rate_scale if r.rate else F.lit(None).cast("double")
    counted = _counted(r)
    plain = {c: F.sum(F.col(column).cast("double")) if column else F.lit(None).cast("double") for c, column in (("s", r.orders), ("q", r.customers)) if c not in counted}
    cube = f.groupBy(F.col(r.day).alias("day"), "entity").agg(_primary(r).alias("p"), rate.alias("r"), *[x.alias(c) for c, x in plain.items()])
    if counted:
        sizes = set_sizes(board_sets(fact, r, days, keep), ["day", "entity"], list(counted))
        cube = join_on(cube, sizes, ["day", "entity"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in counted})
    return cube.select("day", "entity", "p", "s", "q", "r")


def range_distinct(sets: DataFrame, days: Days, by: Sequence[str] = (), names: Sequence[str] = ("s", "q")) -> DataFrame:
    """Distinct orders and customers of a range of days, by location or in all, from the daily sets."""
    return set_sizes(merge_sets(sets.where(days.holds("day")), by), by, names)


def board_split(fact: DataFrame, r: Roles, days: Days, keep: DataFrame, column: str, items: DataFrame) -> DataFrame:
    """(day, entity, item, v): the primary measure split by a category or segment."""
    f = _kept(fact.where(days.holds(r.day) & F.col(column).isNotNull()), label(r.site), keep, "entity")
    f = _kept(f, F.col(column).cast("string"), items, "item")
    return f.groupBy(F.col(r.day).alias("day"), "entity", "item").agg(_primary(r).alias("v"))


# ---------------------------------------------------------------- cards from the cube


def _sum_in(c: str, w: Days | None) -> Column:
    return F.coalesce(F.sum(F.when(w.holds("day"), F.col(c))), F.lit(0.0)) if w else F.lit(0.0)


def kpi_set(cube: DataFrame, entities: DataFrame, cur: Days, prev: Days | None) -> DataFrame:
    """Totals with previous values and growth, mean rate, locations active on the last day, countries and cities."""
    span = Days(prev.start if prev else cur.start, cur.end)
    a = cube.where(span.holds("day")).agg(
        *[_sum_in(c, cur).alias(n) for c, n in (("p", "primary"), ("s", "secondary"), ("q", "people"))],
        *[_sum_in(c, prev).alias(f"prev_{n}") for c, n in (("p", "primary"), ("s", "secondary"), ("q", "people"))],
        F.avg(F.when(cur.holds("day"), F.col("r"))).alias("rate"), (F.avg(F.when(prev.holds("day"), F.col("r"))) if prev else F.lit(None).cast("double")).alias("prev_rate"),
        F.count_distinct(F.when((F.col("day") == F.lit(cur.end)) & (F.col("p") != 0), F.col("entity"))).alias("active"))
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("country").alias("countries"), F.count_distinct("city").alias("cities"))
    a = a.withColumns({k: e.select(k).scalar() for k in ("entities", "countries", "cities")})
    return a.withColumns({f"{n}_growth": growth(n, f"prev_{n}") for n in ("primary", "secondary", "people")}).withColumn("rate_change", F.col("rate") - F.col("prev_rate"))


def spark_buckets(cube: DataFrame, cur: Days, n: int = 8, c: str = "p") -> DataFrame:
    """Sums over n equal slices of the range (days when the range is shorter)."""
    length = cur.days
    k = min(n, length)
    i = F.datediff("day", F.lit(cur.start))
    # slice s starts at floor(s * length / k), so day i lies in slice ceil((i + 1) * k / length) - 1
    s = F.ceil((i + 1) * k / F.lit(float(length))) - 1
    got = cube.where(cur.holds("day")).groupBy(s.cast("int").alias("slice")).agg(F.sum(c).alias("value"))
    axis = cube.sparkSession.range(k).select(F.col("id").cast("int").alias("slice"))
    return axis.join(got, "slice", "left").select("slice", F.coalesce("value", F.lit(0.0)).alias("value"))


def spark_days(cube: DataFrame, c: str = "p", n: int = 14) -> DataFrame:
    """The last n days that have rows, negatives shown as 0."""
    g = cube.groupBy("day").agg(F.sum(c).alias("v")).orderBy(F.col("day").desc()).limit(n)
    return g.select("day", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)).alias("value"))


def entity_values(cube: DataFrame, cur: Days, prev: Days | None) -> DataFrame:
    span = Days(prev.start if prev else cur.start, cur.end)
    g = cube.where(span.holds("day")).groupBy("entity").agg(
        _sum_in("p", cur).alias("value"), _sum_in("p", prev).alias("prev"), _sum_in("s", cur).alias("secondary"), _sum_in("q", cur).alias("people"),
        F.max(F.when((F.col("day") == F.lit(cur.end)) & (F.col("p") != 0), True).otherwise(False)).alias("active"))
    return g.withColumn("growth", growth("value", "prev"))


def ranked_entities(values: DataFrame) -> DataFrame:
    """Rank and share of every location, however many there are."""
    total = values.agg(F.coalesce(F.nullif(F.sum("value"), F.lit(0.0)), F.lit(1.0))).scalar()
    return global_row_number(values.where(F.col("entity") != OTHER), [F.col("value").desc(), F.col("entity").asc()], "rank").withColumn("share", F.col("value") / total)


def roll_up(values: DataFrame, attributes: DataFrame, level: str) -> DataFrame:
    """Regions, hubs or cities: locations, active ones, value, previous and growth."""
    j = values.join(attributes.select("entity", F.col(level).alias("place")), "entity")
    g = j.groupBy("place").agg(F.count(F.lit(1)).alias("entities"), F.count_if("active").alias("active"), F.sum("value").alias("value"), F.sum("prev").alias("prev"))
    return g.withColumn("growth", growth("value", "prev"))


def roll_up_levels(values: DataFrame, attributes: DataFrame, levels: Sequence[str]) -> DataFrame:
    """All levels at once through grouping sets: one pass, each row tagged with its level."""
    j = values.join(attributes.select("entity", *levels), "entity")
    g = j.groupingSets([[F.col(lv)] for lv in levels], *[F.col(lv) for lv in levels]).agg(
        *[F.grouping(lv).alias(f"_g_{lv}") for lv in levels], F.count(F.lit(1)).alias("entities"), F.sum("value").alias("value"), F.sum("prev").alias("prev"))
    level, place = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lv in levels:
        level, place = F.when(F.col(f"_g_{lv}") == 0, lv).otherwise(level), F.when(F.col(f"_g_{lv}") == 0, F.col(lv)).otherwise(place)
    return g.select(level.alias("level"), place.alias("place"), "entities", "value", "prev", growth("value", "prev").alias("growth"))


def zones(entities: DataFrame) -> DataFrame:
    """The region of every location: continents when the business spans countries (home share below 75 %);
    else its states (or cities) plus one zone per other country; the largest 6, or 5 and "other".

    ``entities``: entity, value, city, state, country, country_name, continent, is_other.
    """
    entities = cut_lineage(entities)  # at most 301 rows, read several times
    real = entities.where(~F.col("is_other"))
    by_country = real.where(F.coalesce("country", F.lit("")) != "").groupBy("country").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))
    c = by_country.agg(F.struct(
        F.max_by("country", F.struct("v", "country")).alias("home"), F.count(F.lit(1)).alias("n"),
        (F.max("v") / F.coalesce(F.nullif(F.sum("v"), F.lit(0.0)), F.lit(1.0))).alias("home_share"))).scalar()
    home, n_country, home_share = c["home"], c["n"], c["home_share"]
    own = home.isNull() | F.col("country").isNull() | (F.col("country") == "") | (F.col("country") == home)
    local = real.where(own).agg(F.struct(
        F.count_distinct(F.nullif("state", F.lit(""))).alias("states"), F.count_distinct(F.nullif("city", F.lit(""))).alias("cities"))).scalar()
    states, cities = local["states"], local["cities"]
    text = lambda *cols: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in cols])
    local_key = F.when(states >= 2, F.coalesce(text("state"), F.lit(OTHER))).when(cities >= 2, F.coalesce(text("city"), F.lit(OTHER)))
    mode = (F.when((n_country >= 2) & (home_share < 0.75), "continent").when((n_country >= 2) & local_key.isNotNull(), "mixed")
            .when(states >= 2, "state").when(cities >= 2, "city").otherwise("none"))
    key = (F.when(F.col("mode") == "continent", F.coalesce(text("continent", "country_name"), F.lit(OTHER)))
           .when(F.col("mode") == "mixed", F.when(own, local_key).otherwise(text("country_name", "country")))
           .when(F.col("mode").isin("state", "city"), local_key).otherwise(F.coalesce(text("country_name", "city"), F.lit("All"))))
    keyed = entities.withColumn("mode", mode).withColumn("_key", key)
    totals = keyed.where(~F.col("is_other")).groupBy("_key").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))
    n = totals.agg(F.count(F.lit(1))).scalar()
    top = totals.orderBy(F.col("v").desc(), "_key").limit(6)
    w = Window.orderBy(F.col("v").desc(), "_key")  # six rows
    top = top.withColumn("_rn", F.row_number().over(w)).where((n <= 6) | (F.col("_rn") <= 5)).select(F.col("_key").alias("_kept"))
    j = keyed.join(F.broadcast(top), (F.col("_key") == F.col("_kept")) & ~F.col("is_other"), "left")
    return j.select("entity", "mode", F.coalesce(slug("_kept"), F.lit("other")).alias("zone"), F.coalesce("_kept", F.lit(OTHER)).alias("zone_label"))


def shares(split: DataFrame, cur: Days, prev: Days) -> DataFrame:
    """Share of each item now and before, and the relative change of the share."""
    span = Days(prev.start, cur.end)
    g = split.where(span.holds("day")).groupBy("item").agg(
        F.coalesce(F.sum(F.when(cur.holds("day"), F.col("v"))), F.lit(0.0)).alias("value"), F.coalesce(F.sum(F.when(prev.holds("day"), F.col("v"))), F.lit(0.0)).alias("prev"))
    whole = lambda c: g.agg(F.coalesce(F.nullif(F.sum(c), F.lit(0.0)), F.lit(1.0))).scalar()
    out = g.withColumns({"share": F.col("value") / whole("value"), "prev_share": F.col("prev") / whole("prev")})
    return out.withColumn("growth", F.when(F.col("prev") > 0, F.col("share") / F.col("prev_share") - 1))


def breakdown(values: DataFrame, attributes: DataFrame, level: str) -> DataFrame:
    """Value, share and change by region, category, segment or city."""
    g = roll_up(values, attributes, level)
    total = g.agg(F.coalesce(F.nullif(F.sum("value"), F.lit(0.0)), F.lit(1.0))).scalar()
    return g.select("place", "value", (F.col("value") / total).alias("share"), F.col("growth").alias("change"))


def trend_card(cube: DataFrame, cur: Days) -> DataFrame:
    """Total, mean of active days, best and worst active day."""
    d = cube.where(cur.holds("day")).groupBy("day").agg(F.sum("p").alias("v"))
    active = d.where("v > 0")
    return active.agg(
        F.sum("v").alias("total"), F.avg("v").alias("per_active_day"), F.count(F.lit(1)).alias("active_days"),
        F.max_by("day", F.struct(F.col("v"), -F.datediff("day", F.lit(dt.date(1970, 1, 1))))).alias("best_day"), F.max("v").alias("best"),
        F.min_by("day", F.struct("v", "day")).alias("worst_day"), F.min("v").alias("worst"))


def performance_buckets(cube: DataFrame, cur: Days, prev: Days | None, grain: str) -> DataFrame:
    """Week or month sums with the period before; a first or last bucket with under half of its days is dropped."""
    start = F.trunc("day", grain)
    shift = (cur.start - prev.start).days if prev else 0
    d = cube.where(Days(prev.start if prev else cur.start, cur.end).holds("day")).groupBy("day").agg(F.sum("p").alias("v"))
    # the previous period is laid over the current one day by day
    aligned = d.select(F.when(cur.holds("day"), F.col("day")).otherwise(F.date_add("day", shift)).alias("day"),
                       F.when(cur.holds("day"), F.col("v")).alias("now"), F.when(~cur.holds("day"), F.col("v")).alias("before")).where(cur.holds("day"))
    g = aligned.groupBy(start.alias("bucket")).agg(F.coalesce(F.sum("now"), F.lit(0.0)).alias("value"), F.sum("before").alias("prev"))
    length = F.lit(7) if grain == "week" else F.dayofmonth(F.last_day("bucket"))
    inside = F.datediff(F.least(F.date_add("bucket", length - 1), F.lit(cur.end)), F.greatest("bucket", F.lit(cur.start))) + 1
    return g.where(inside >= length / 2)


def daily_with_previous(cube: DataFrame, cur: Days, prev: Days) -> DataFrame:
    """Each day with the day one period earlier, for the three series."""
    shift = (cur.start - prev.start).days
    d = cube.where(Days(prev.start, cur.end).holds("day")).groupBy("day").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    back = d.select(F.date_add("day", shift).alias("day"), F.col("p").alias("prev_p"), F.col("s").alias("prev_s"), F.col("q").alias("prev_q"))
    return d.where(cur.holds("day")).join(back, "day", "left")


def recent_days(cube: DataFrame, n: int = 8) -> DataFrame:
    """The last active days with the change from the active day before."""
    d = cube.groupBy("day").agg(F.sum("p").alias("value")).where("value > 0").orderBy(F.col("day").desc()).limit(n + 1)
    w = Window.orderBy("day")  # at most n + 1 rows
    out = d.withColumns({"before": F.lag("value").over(w), "_rn": F.row_number().over(Window.orderBy(F.col("day").desc()))})
    return out.where(F.col("_rn") <= n).select("day", "value", change("value", "before").alias("change"))


def leader_best_day(cube: DataFrame, cur: Days) -> DataFrame:
    """The largest location of the range and its best day."""
    c = cube.where(cur.holds("day"))
    leader = c.where(F.col("entity") != OTHER).groupBy("entity").agg(F.sum("p").alias("v")).orderBy(F.col("v").desc(), "entity").limit(1)
    return c.join(F.broadcast(leader), "entity").groupBy("entity").agg(
        F.max("v").alias("total"), F.max_by("day", F.struct("p", F.col("day"))).alias("day"), F.max("p").alias("value"))


def globe_card(fact: DataFrame, r: Roles, zone: str) -> DataFrame:
    """Per zone: locations and value; and for all: countries, cities and months of data."""
    per_zone = fact.groupBy(label(zone).alias("zone")).agg(F.count_distinct(label(r.site)).alias("locations"), _primary(r).alias("value"))
    f = fact.agg(F.count_distinct(r.country).alias("countries") if r.country else F.lit(None).cast("bigint").alias("countries"),
                 F.count_distinct(r.city).alias("cities") if r.city else F.lit(None).cast("bigint").alias("cities"),
                 ((F.year(F.max(r.day)) - F.year(F.min(r.day))) * 12 + F.month(F.max(r.day)) - F.month(F.min(r.day)) + 1).alias("months"))
    return per_zone.withColumns({k: f.select(k).scalar() for k in ("countries", "cities", "months")})


def entity_detail(cube: DataFrame, split: DataFrame, entity: str, cur: Days, prev: Days) -> DataFrame:
    """(part, label, value): totals, daily series and category values of one location."""
    c, s = cube.where(F.col("entity") == entity), split.where(F.col("entity") == entity)
    totals = c.agg(_sum_in("p", cur).alias("value"), _sum_in("p", prev).alias("previous"), _sum_in("s", cur).alias("secondary"), _sum_in("q", cur).alias("people"))
    totals = totals.unpivot([], ["value", "previous", "secondary", "people"], "label", "value").withColumn("part", F.lit("total"))
    daily = c.where(cur.holds("day")).select(F.lit("day").alias("part"), F.col("day").cast("string").alias("label"), F.col("p").alias("value"))
    cats = s.where(cur.holds("day")).groupBy(F.col("item").alias("label")).agg(F.sum("v").alias("value")).withColumn("part", F.lit("category"))
    return totals.select("part", "label", "value").unionByName(daily).unionByName(cats.select("part", "label", "value"))


def segment_by_region(split: DataFrame, attributes: DataFrame, cur: Days, level: str) -> DataFrame:
    return split.where(cur.holds("day")).join(attributes.select("entity", F.col(level).alias("place")), "entity").groupBy("place", "item").agg(F.sum("v").alias("value"))
