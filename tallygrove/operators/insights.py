"""Insight rows: (tag, score, good, subject, number, base) facts with scores, instead of screen text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ranking import global_row_number
from ..semantics import change, upper_median
from .chart import period_movers
from .filters import Days
from .timeseries import falling_streak, weekday_norm

COLUMNS = ["tag", "score", "good", "subject", "number", "base"]


def _rows(df: DataFrame, entries: Sequence[tuple[Column, str, Column, Column, Column, Column, Column]], key: Sequence[str] = ()) -> DataFrame:
    """Each entry (condition, tag, score, good, subject, number, base) of each input row becomes an insight row."""
    made = [F.when(cond, F.struct(F.lit(tag).alias("tag"), score.cast("double").alias("score"), good.cast("boolean").alias("good"), subject.cast("string").alias("subject"),
                                  number.cast("double").alias("number"), base.cast("double").alias("base"))) for cond, tag, score, good, subject, number, base in entries]
    return df.select(*key, F.explode(F.array_compact(F.array(*made))).alias("_i")).select(*key, "_i.*")


def time_chart_insights(points: DataFrame, key: Sequence[str], time: str, value: str, lower_is_better: bool = False) -> DataFrame:
    """Trend (R2 >= 0.35 and >= 5 % over the range) and volatility (variation above 60 % of the mean)."""
    d = points.withColumns({"_y": F.coalesce(F.col(value), F.lit(0.0)), "_x": F.row_number().over(Window.partitionBy(*key).orderBy(time)).cast("double") - 1})
    g = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.avg("_y").alias("mean0"), F.stddev_pop("_y").alias("sd"),
                            F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"))
    mean = F.coalesce(F.nullif(F.col("mean0"), F.lit(0.0)), F.lit(1.0))
    g = g.where("n >= 5").withColumns({"move": F.col("slope") * (F.col("n") - 1) / F.abs(mean), "r2": F.when(F.col("syy") > 0, F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))).otherwise(0.0),
                                       "cv": F.col("sd") / F.abs(mean)})
    good = (F.col("move") < 0) if lower_is_better else (F.col("move") > 0)
    return _rows(g, [
        ((F.col("r2") >= 0.35) & (F.abs("move") >= 0.05), "Trend", F.least(F.lit(1.0), F.abs("move")) * (0.6 + F.col("r2") * 0.4), good, F.lit("trend"), F.col("move"), F.col("r2")),
        ((F.col("cv") > 0.6) & (F.col("n") >= 8), "Volatility", F.lit(0.3), F.lit(False), F.lit("variation"), F.col("cv"), F.col("mean0")),
    ], key)


def category_chart_insights(groups: DataFrame, name: str, value: str) -> DataFrame:
    """Share (leader >= 35 % of three or more) and gap (leader >= 3 x the last of four or more)."""
    g = groups.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0)))
    s = g.agg(F.sum(F.greatest("_v", F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"),
              F.min(F.struct((-F.col("_v")).alias("k"), F.col(name).alias("name"))).alias("a"), F.max(F.struct((-F.col("_v")).alias("k"), F.col(name).alias("name"))).alias("z"))
    s = s.select("total", "n", (-F.col("a.k")).alias("top"), F.col("a.name").alias("top_name"), (-F.col("z.k")).alias("low"), F.col("z.name").alias("low_name")).where("total > 0 and n >= 2")
    share = F.col("top") / F.col("total")
    return _rows(s, [
        ((share >= 0.35) & (F.col("n") >= 3), "Share", F.least(F.lit(0.8), share), F.lit(True), F.col("top_name"), share, F.col("total")),
        ((F.col("n") >= 4) & (F.col("low") > 0) & (F.col("top") >= 3 * F.col("low")), "Gap", F.lit(0.35), F.lit(False), F.col("low_name"), F.try_divide(F.col("top"), F.col("low")), F.col("low")),
    ])


def correlation_insights(points: DataFrame, a: str, b: str) -> DataFrame:
    s = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r")).where("n >= 5")
    return _rows(s, [((F.col("r") >= 0.7) | (F.col("r") <= -0.6), "Correlation", F.abs("r") * 0.7, F.lit(True), F.lit(f"{a} & {b}"), F.col("r"), F.col("n"))])


def forecast_insights(forecast_rows: DataFrame, points: DataFrame, key: Sequence[str], time: str, value: str, h: int, lower_is_better: bool = False) -> DataFrame:
    """Next h steps against the last h (3 % or more). ``forecast_rows`` comes from ``timeseries.forecast``."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc()))
    last = points.withColumn("_rn", rn).where(F.col("_rn") <= h).groupBy(*key).agg(F.sum(value).alias("last"))
    nxt = forecast_rows.groupBy(*key).agg(F.sum("forecast").alias("next"))
    d = nxt.join(last, list(key)).withColumn("ch", change("next", "last"))
    good = (F.col("ch") < 0) if lower_is_better else (F.col("ch") > 0)
    return _rows(d, [(F.abs("ch") >= 0.03, "Forecast", F.least(F.lit(0.9), F.abs("ch") * 1.5), good, F.lit("forecast"), F.col("ch"), F.col("next"))], key)


def anomaly_insights(found: DataFrame, key: Sequence[str], time: str, lower_is_better: bool = False, per_series: int | None = None) -> DataFrame:
    """Outliers of each series, or the ``per_series`` strongest. ``found`` comes from ``timeseries.anomalies``."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs("z").desc(), time))
    d = found if per_series is None else found.withColumn("_rn", rn).where(F.col("_rn") <= per_series)
    good = (F.col("z") < 0) if lower_is_better else (F.col("z") > 0)
    return _rows(d, [(F.lit(True), "Anomaly", F.least(F.lit(0.95), 0.45 + F.abs("z") / 20), good, F.col(time), F.col("value"), F.col("expected"))], key)


def day_insights(daily: DataFrame, day: str, value: str, cur: Days, lower_is_better: bool = False) -> DataFrame:
    """Worst and best day of the window against the norm of its weekday, and a falling run at the end.

    ``daily`` has one row per calendar day of the whole history.
    """
    inside = cur.holds(day)
    norm = weekday_norm(daily, day, value, inside)
    d = daily.where(inside).withColumn("weekday", F.dayofweek(day) - 1).join(norm, "weekday").where("norm <> 0")
    d = d.withColumn("dev", (F.col(value) - F.col("norm")) / F.abs("norm"))
    e = d.agg(F.min(F.struct("dev", F.col(day).alias("d"), F.col(value).alias("v"), "norm")).alias("lo"),
              F.min(F.struct((-F.col("dev")).alias("k"), F.col(day).alias("d"), "dev", F.col(value).alias("v"), "norm")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    bad, best = ("hi", "lo") if lower_is_better else ("lo", "hi")
    dev = lambda s: F.col(f"{s}.dev")
    rows = _rows(e, [
        (F.abs(dev(bad)) >= 0.2, "Bad day", F.least(F.lit(1.0), 0.55 + F.abs(dev(bad))), F.lit(False), F.col(f"{bad}.d"), F.col(f"{bad}.v"), F.col(f"{bad}.norm")),
        (F.abs(dev(best)) >= 0.25, "Best day", F.least(F.lit(0.9), 0.4 + F.abs(dev(best)) / 2), F.lit(True), F.col(f"{best}.d"), F.col(f"{best}.v"), F.col(f"{best}.norm")),
    ])
    return rows if lower_is_better else rows.unionByName(_streak(daily.where(inside), day, value, "days"))


def _streak(points: DataFrame, time: str, value: str, unit: str) -> DataFrame:
    s = falling_streak(points.withColumn("_k", F.lit(0)), ["_k"], time, value)
    drop = (F.col("first") - F.col("last")) / F.abs("first")
    return _rows(s, [((F.col("streak") >= 3) & (F.col("first") != 0) & (drop >= 0.05), "Streak", 0.6 + F.col("streak") * 0.05, F.lit(False), F.concat(F.col("streak"), F.lit(f" {unit}")), F.col("last"), F.col("first"))])


def period_insights(points: DataFrame, day: str, value: str, cur: Days, unit: str, lower_is_better: bool = False) -> DataFrame:
    """Worst and best week or month of the window against the typical one (20 %), for data with one row per week or month."""
    norm = points.agg(upper_median(F.collect_list(value))).scalar()  # one value per week or month
    d = points.where(cur.holds(day)).withColumn("norm", norm).withColumn("dev", F.when(F.col("norm") != 0, (F.col(value) - F.col("norm")) / F.abs("norm")).otherwise(0.0))
    e = d.agg(F.min(F.struct("dev", F.col(day).alias("d"), F.col(value).alias("v"), "norm")).alias("lo"),
              F.min(F.struct((-F.col("dev")).alias("k"), F.col(day).alias("d"), "dev", F.col(value).alias("v"), "norm")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    bad, best = ("hi", "lo") if lower_is_better else ("lo", "hi")
    rows = _rows(e, [(F.abs(F.col(f"{s}.dev")) >= 0.2, tag, F.least(F.lit(top), base + F.abs(F.col(f"{s}.dev")) * k), F.lit(ok), F.col(f"{s}.d"), F.col(f"{s}.v"), F.col(f"{s}.norm"))
                     for s, tag, top, base, k, ok in ((bad, f"Bad {unit}", 1.0, 0.55, 1.0, False), (best, f"Best {unit}", 0.9, 0.4, 0.5, True))])
    return rows if lower_is_better else rows.unionByName(_streak(points.where(cur.holds(day)), day, value, f"{unit}s"))


def driver_insights(df: DataFrame, day: str, x: str, y: str, cur: Days, prev: Days, lower_is_better: bool = False) -> DataFrame:
    """The category that fell most and the one that grew most, with its share of the total change."""
    m = period_movers(df, day, x, y, cur, prev)
    total = m.agg(F.sum("delta")).scalar()
    e = m.agg(F.min(F.struct("delta", "label", "prev")).alias("down"), F.min(F.struct((-F.col("delta")).alias("k"), "label", "delta", "prev")).alias("up")).withColumn("total", total)

    def entry(s, tag, cond):
        d, base = F.col(f"{s}.delta"), F.col(f"{s}.prev")
        rel = F.when(base != 0, F.abs(d / base)).otherwise(1.0)
        part = F.when(F.col("total") != 0, F.abs(d / F.col("total"))).otherwise(0.0)
        useful = (rel >= 0.05) | ((part >= 0.3) & (F.signum("total") == F.signum(d)))
        score = 0.5 + F.least(F.lit(0.45), F.abs(d) / F.coalesce(F.nullif(F.abs("total") + F.abs(d), F.lit(0.0)), F.lit(1.0)))
        return (cond & useful, tag, score, (d > 0) != F.lit(lower_is_better), F.col(f"{s}.label"), d, base)

    return _rows(e, [entry("down", "Decline", F.col("down.delta") < 0), entry("up", "Growth", (F.col("up.delta") > 0) & (F.col("up.label") != F.col("down.label")))])


def kpi_insights(kpis: DataFrame) -> DataFrame:
    """KPI moves of 5 % or more. ``kpis``: title, change, prev, cur, lower_is_better, against."""
    up = F.col("change") > 0
    good = up != F.col("lower_is_better")
    tag = F.when(F.col("against") == "target", "Target").otherwise("Change")
    d = kpis.where(F.abs("change") >= 0.05)
    return d.select(tag.alias("tag"), F.least(F.lit(1.0), F.abs("change") * 3).alias("score"), good.alias("good"), F.col("title").alias("subject"), F.col("change").alias("number"), F.col("prev").alias("base"))


def rank_insights(found: DataFrame, per_tag: int | None = None) -> DataFrame:
    """Problems first (+0.12), weak ones out, one per subject; at most ``per_tag`` of a tag if given."""
    d = found.where(~((F.col("tag") == "Volatility") | ((F.col("tag") == "Correlation") & (F.col("score") < 0.6))))
    d = d.withColumn("score", F.col("score") + F.when(F.col("good"), 0.0).otherwise(0.12))
    order = [F.col("score").desc(), F.col("tag"), F.col("subject")]
    one = d.withColumn("_rn", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where("_rn = 1").drop("_rn")
    return one if per_tag is None else one.withColumn("_rn", F.row_number().over(Window.partitionBy("tag").orderBy(*order))).where(F.col("_rn") <= per_tag).drop("_rn")


def board_insights(regions: DataFrame, entities: DataFrame, segments: DataFrame, categories: DataFrame, totals: DataFrame) -> DataFrame:
    """Overview insights: fastest region, orders per person, segment shift, fastest and slowest category, leader and laggard.

    regions(place, value, growth); entities(entity, value, growth, share, rank, active); segments and
    categories(item, share, prev_share, growth); totals(secondary, people, prev_secondary, prev_people), one row.
    """
    none = F.lit(None).cast("double")

    def pick(df, order, tag, subject, number, base, good=None, keep=None):
        e = df.agg(F.min(F.struct(order.alias("k"), F.col(subject).alias("s"), number.cast("double").alias("n"), base.cast("double").alias("b"))).alias("e")).where("e is not null")
        cond = F.lit(True) if keep is None else keep
        return _rows(e, [(cond, tag, F.abs("e.n"), F.col("e.n") >= 0 if good is None else F.lit(good), F.col("e.s"), F.col("e.n"), F.col("e.b"))])

    grown = regions.where("growth is not null and value > 0")
    now, before = F.col("secondary") / F.nullif("people", F.lit(0.0)), F.col("prev_secondary") / F.nullif("prev_people", F.lit(0.0))
    freq = totals.select(now.alias("now"), (now / F.nullif(before, F.lit(0.0)) - 1).alias("ch")).where("ch is not null and now <> 0")
    shift = segments.where("prev_share > 0").withColumn("shift", F.col("share") - F.col("prev_share"))
    cats = categories.where("growth is not null")
    many = cats.agg(F.count(F.lit(1))).scalar() > 1
    n = entities.agg(F.count(F.lit(1))).scalar()
    middle = entities.where(F.col("rank") == F.floor(n / 2) + 1).agg(F.max("value")).scalar()
    risky = entities.where((F.col("value") >= F.coalesce(middle, F.lit(0.0))) & F.col("growth").isNotNull() & F.col("active"))
    parts = [
        pick(grown, -F.col("growth"), "Growth", "place", F.col("growth"), F.col("value")),
        _rows(freq, [(F.lit(True), "Frequency", F.abs("ch"), F.col("ch") >= 0, F.lit("orders per person"), F.col("ch"), F.col("now"))]),
        pick(shift, -F.abs("shift"), "Segment shift", "item", F.col("shift"), F.col("share")),
        pick(cats.where(many), -F.col("growth"), "Fastest", "item", F.col("growth"), F.col("share")),
        pick(cats.where(many), F.col("growth"), "Slowest", "item", F.col("growth"), F.col("share")),
        pick(entities, F.col("rank"), "Leader", "entity", F.col("value"), F.col("share"), True),
        pick(risky, F.col("growth"), "Risk", "entity", F.col("growth"), none, False, F.col("e.n") < -0.03),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def story_facts(kpis: DataFrame, insights: DataFrame, closing: int | None = None) -> DataFrame:
    """Facts for a narration: the lead KPI, the biggest move, the main thing to watch and the closing list (of ``closing`` if given)."""
    lead = kpis.agg(F.min(F.struct("position", "title", F.col("cur").alias("number"))).alias("e")).select(F.lit("lead").alias("part"), F.lit(1).alias("position"), "e.title", "e.number")
    move = kpis.where("change is not null").agg(F.min(F.struct((-F.abs("change")).alias("k"), "title", F.col("change").alias("number"))).alias("e")).where("e is not null").select(
        F.lit("biggest move").alias("part"), F.lit(1).alias("position"), "e.title", "e.number")
    watch = insights.where("not good").agg(F.min(F.struct((-F.col("score")).alias("k"), F.col("subject").alias("title"), "number")).alias("e")).where("e is not null").select(
        F.lit("watch").alias("part"), F.lit(1).alias("position"), "e.title", "e.number")
    order = [F.col("score").desc(), F.col("subject")]
    close = global_row_number(insights if closing is None else insights.orderBy(*order).limit(closing), order, "position")
    close = close.select(F.lit("closing").alias("part"), F.col("position").cast("int").alias("position"), F.col("subject").alias("title"), "number")
    return reduce(lambda a, b: a.unionByName(b), [lead, move, watch, close])
