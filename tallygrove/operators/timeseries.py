"""Forecasts, anomalies, moving statistics, streaks and weekday norms.

Input series are already bucketed (one row per key and time step), so one series is as long as its
calendar.  Everything that Spark windows can express runs there; only the iterative fits (Holt-Winters,
repeated outlier removal) run as grouped pandas, one series per call.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import growth, middle_median, upper_median

# ---------------------------------------------------------------- windows


def moving_average(df: DataFrame, key: Sequence[str], time: str, value: str, n: int, name: str = "ma") -> DataFrame:
    by = Window.partitionBy(*key).orderBy(time)
    return df.withColumn(name, F.when(F.row_number().over(by) >= n, F.avg(value).over(by.rowsBetween(-(n - 1), 0))))


def centred_median(df: DataFrame, key: Sequence[str], time: str, value: str, w: int, name: str = "median") -> DataFrame:
    by = Window.partitionBy(*key).orderBy(time).rowsBetween(-w, w)
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(by))


def weekday_baseline(df: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Expected value of open days: median of the same weekday over four weeks, scaled by the recent trend (0.7 .. 1.4).

    Days are calendar days (range frames), so missing days do not shift the weekday.
    """
    d = df.where(F.col(value) != 0).withColumn("_d", F.datediff(day, F.lit(dt.date(1970, 1, 1))))
    by = Window.partitionBy(*key).orderBy("_d")
    month = by.rangeBetween(-28, -1)
    same = F.filter(F.collect_list(F.struct("_d", F.col(value).alias("v"))).over(month), lambda x: (F.col("_d") - x["_d"]) % 7 == 0)  # at most 28 values
    week, four = F.avg(value).over(by.rangeBetween(-7, -1)), F.avg(value).over(month)
    trend = F.when(week.isNotNull() & (four != 0), F.least(F.lit(1.4), F.greatest(F.lit(0.7), week / four))).otherwise(1.0)
    return d.withColumn("_base", middle_median(F.transform(same, lambda x: x["v"]))).withColumn("expected", F.col("_base") * trend).drop("_d", "_base")


def falling_streak(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """How many points in a row fall at the end of each series, with the first and last value of the run."""
    by = Window.partitionBy(*key).orderBy(time)
    d = df.withColumn("_turn", F.when(F.col(value) < F.lag(value).over(by), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("streak"), F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"))
    return runs.groupBy(*key).agg(F.max_by(F.struct("streak", "first", "last"), "_run").alias("r")).select(*key, "r.*")


def weekday_norm(df: DataFrame, day: str, value: str, inside: Column) -> DataFrame:
    """Typical value per weekday: the upper median outside the window, or of all days when there is none (or it is 0)."""
    wd = F.dayofweek(day) - 1
    values = df.groupBy(wd.alias("weekday")).agg(  # one value per calendar day
        F.collect_list(F.when(~inside, F.col(value))).alias("_out"), F.collect_list(value).alias("_all"))
    return values.select("weekday", F.coalesce(F.nullif(upper_median(F.col("_out")), F.lit(0.0)), upper_median(F.col("_all"))).alias("norm"))


def data_grain(days: DataFrame, day: str) -> DataFrame:
    """Rows per day, week or month, from the gaps between distinct days and the days they fall on."""
    d = days.select(F.col(day).alias("d")).where("d is not null").distinct().withColumn("y", F.year("d"))
    # gaps inside a year need no global window; the gap into a year comes from the last day of the year before
    w = Window.partitionBy("y").orderBy("d")
    ends = d.groupBy("y").agg(F.max("d").alias("_last")).withColumn("_prev_end", F.lag("_last").over(Window.orderBy("y")))  # one row per year
    g = d.withColumn("p", F.lag("d").over(w)).join(ends.select("y", "_prev_end"), "y").withColumn("gap", F.datediff("d", F.coalesce("p", "_prev_end")))
    s = g.agg(F.collect_list("gap").alias("gaps"), F.count(F.lit(1)).alias("n"), F.min(F.dayofmonth("d") == 1).alias("firsts"), F.count_distinct(F.dayofweek("d")).alias("weekdays"))
    gap = upper_median(F.col("gaps"))
    grain = F.when((F.col("n") >= 3) & F.col("firsts"), "month").when((F.col("n") >= 3) & (F.col("weekdays") == 1), "week").otherwise("day")
    return s.select("n", gap.alias("median_gap"), F.when(gap >= 25, "month").when(gap >= 5, "week").otherwise("day").alias("by_gap"), grain.alias("by_day"))


# ---------------------------------------------------------------- Holt as SQL folds

# Fixed smoothing grids.
ALPHAS, BETAS = [0.1, 0.3, 0.5, 0.7, 0.9], [0.05, 0.15, 0.3]
HW_ALPHAS, HW_BETAS, HW_GAMMAS = [0.2, 0.4, 0.6], [0.05, 0.15], [0.1, 0.3, 0.5]


def holt(series: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """Best Holt linear fit per series: level, slope, squared error, alpha, beta.

    The series is folded once per grid point inside the JVM (``aggregate`` over the sorted array).
    """
    s = series.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(time, F.coalesce(value, F.lit(0.0)).alias("y")))).alias("_s"))
    s = s.select(*key, F.transform("_s", lambda p: p["y"]).alias("_y")).where(F.size("_y") >= 2)
    y0, y1 = F.col("_y")[0], F.col("_y")[1]

    def fit(alpha: float, beta: float) -> Column:
        start = F.struct(y0.alias("l"), (y1 - y0).alias("b"), F.lit(0.0).alias("sse"))

        def step(a, y):
            guess = a["l"] + a["b"]
            level = alpha * y + (1 - alpha) * guess
            return F.struct(level.alias("l"), (beta * (level - a["l"]) + (1 - beta) * a["b"]).alias("b"), (a["sse"] + (y - guess) * (y - guess)).alias("sse"))

        f = F.aggregate(F.slice("_y", 2, F.size("_y") - 1), start, step)
        return F.struct(f["sse"].alias("sse"), F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), f["l"].alias("level"), f["b"].alias("slope"))

    best = F.array_min(F.array(*[fit(a, b) for a in ALPHAS for b in BETAS]))
    return s.select(*key, F.size("_y").alias("n"), best.alias("f")).select(*key, "n", "f.*")


# ---------------------------------------------------------------- iterative fits (one series per call)


def season_length(grain: str, n: int) -> int:
    """Seasonal period of a grain, when there is enough history."""
    period, need = {"day": (7, 16), "hour": (24, 50), "month": (12, 26), "quarter": (4, 10)}.get(grain, (0, 0))
    return period if period and n >= need else 0


def _expected(y: np.ndarray, reach: int, season: int) -> np.ndarray:
    """Centred running median plus, with a season, the median residual of each phase; edges use what there is."""
    around = np.lib.stride_tricks.sliding_window_view(np.pad(y, reach, constant_values=np.nan), 2 * reach + 1)
    base = np.nanmedian(around, axis=1)
    if season < 2 or len(y) < 2 * season:
        return base
    cycles = np.full(-(-len(y) // season) * season, np.nan)
    cycles[: len(y)] = y - base
    return base + np.resize(np.nanmedian(cycles.reshape(-1, season), axis=0), len(y))


def outliers(ys: np.ndarray, season: int = 0, limit: float = 3.5, most: int | None = None) -> list[tuple[int, float, float]]:
    """(position, z, expected) of robust outliers, most extreme first, all of them unless ``most`` is given.

    Residuals are scored by median and MAD; the strongest one that is also large against its level is taken out (its
    value becomes the expectation) before the series is judged again.  A series is one row per calendar step, so the work
    of a call (series length times outliers) is bounded by the calendar, not by the table: some thousand days, or a few
    ten thousand hours.
    """
    y = np.array(ys, dtype=float)
    if len(y) < 7:
        return []
    size, reach = float(np.median(np.abs(y))) or 1.0, int(np.clip(len(y) // 4, 3, 7))
    open_, found = np.ones(len(y), bool), []
    while most is None or len(found) < most:
        guess = _expected(y, reach, season)
        off = y - guess
        from_middle = off - np.median(off)
        z = np.where(open_, 0.6745 * from_middle / max(float(np.median(np.abs(from_middle))), 0.03 * size), 0.0)
        at = int(np.abs(z).argmax())
        if abs(z[at]) < limit or abs(off[at]) < 0.12 * max(abs(guess[at]), 0.5 * size):
            break
        found.append((at, float(z[at]), float(guess[at])))
        y[at], open_[at] = guess[at], False
    return found


def _smooth(y: np.ndarray, grid: np.ndarray, level: float, slope: float, cycle: np.ndarray, begin: int, judged: int):
    """Error-correcting smoothing for all rows (alpha, beta, gamma) of a grid at once: squared errors, levels, slopes and cycles at the end.

    One state array per quantity, an entry for each grid point.  A cycle of one zero with gamma 0 is Holt's method.
    """
    alpha, beta, gamma = grid.T
    state = np.tile(np.array([[level], [slope]]), len(grid))
    cycles, sse = np.tile(cycle, (len(grid), 1)), np.zeros(len(grid))
    for t in range(begin, len(y)):
        phase = cycles[:, t % len(cycle)]
        miss = y[t] - state.sum(0) - phase
        sse += miss * miss * (t >= judged)
        moved = state.sum(0) + alpha * miss
        state = np.stack([moved, state[1] + beta * (moved - state.sum(0))])
        cycles[:, t % len(cycle)] = phase + gamma * (y[t] - moved - phase)
    return sse, state[0], state[1], cycles


def forecast_values(ys: Sequence[float], h: int, season: int = 0):
    """(method, values, half-widths) for h steps, or None for fewer than four points."""
    y = np.nan_to_num(np.asarray(ys, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    n = len(y)
    if n < 4 or h < 1:
        return None
    for at, _, _ in outliers(y, season, most=6):  # a forecast forgives the six strongest, more would smooth the series away
        near = np.sort(np.concatenate([y[max(0, at - 3) : at], y[at + 1 : at + 4]]))
        y[at] = near[len(near) // 2]
    fits = [_smooth(y, np.array(list(itertools.product(ALPHAS, BETAS, [0.0]))), y[0], y[1] - y[0], np.zeros(1), 1, 1)]
    best, kind, loss, points = int(fits[0][0].argmin()), 0, fits[0][0].min(), n - 1
    if season > 1 and n >= 2 * season + 2:
        first, second = y[: 2 * season].reshape(2, season).mean(1)
        fits.append(_smooth(y, np.array(list(itertools.product(HW_ALPHAS, HW_BETAS, HW_GAMMAS))), first, (second - first) / season, y[:season] - first, 0, season))
        for i, scaled in enumerate(fits[1][0] / max(1, n - season) * (n - 1)):  # a season has to be clearly better
            if scaled < 0.9 * loss:
                best, kind, loss, points = i, 1, scaled, n - season
    _, level, slope, cycles = fits[kind]
    k = np.arange(1, h + 1)
    cycle = cycles[best]
    return ("seasonal" if kind else "linear"), level[best] + k * slope[best] + cycle[(n - 1 + k) % len(cycle)], 1.28 * np.sqrt(loss / max(1, points)) * np.sqrt(k)


def forecast(df: DataFrame, key: Sequence[str], time: str, value: str, h: int, grain: str) -> DataFrame:
    """h steps per series with an 80 % band; seasonal when a Holt-Winters fit is clearly better."""
    key = list(key)
    schema = T.StructType([df.schema[k] for k in key] + [T.StructField("step", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("forecast", "lower", "upper")] + [T.StructField("method", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ys = pdf.sort_values(time)[value].to_numpy(dtype=float)
        got = forecast_values(ys, h, season_length(grain, len(ys)))
        if got is None:
            return pd.DataFrame(columns=schema.names)
        method, v, band = got
        out = pd.DataFrame({"step": np.arange(1, h + 1, dtype="int32"), "forecast": v, "lower": v - band, "upper": v + band, "method": method})
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]

    return df.select(*key, time, F.col(value).cast("double").alias(value)).groupBy(*key).applyInPandas(run, schema)


def next_labels(last: Column, grain: str, n: int) -> Column:
    """The next n bucket starts after a date, as an array to explode."""
    step = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}[grain]
    start = F.trunc(last, grain) if grain in ("month", "quarter", "year") else last
    return F.slice(F.sequence(start, F.add_months(start, 12 * n + 12) if grain in ("quarter", "year", "month") else F.date_add(start, 7 * n + 7), F.expr(f"INTERVAL {step}")), 2, n)


def anomalies(df: DataFrame, key: Sequence[str], time: str, value: str, grain: str = "day") -> DataFrame:
    """Robust outliers per series with their rank, score and expected value."""
    key = list(key)
    schema = T.StructType([df.schema[k] for k in key] + [df.schema[time], T.StructField("rank", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("value", "z", "expected")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(time).reset_index(drop=True)
        ys = s[value].to_numpy(dtype=float)
        hit = outliers(np.nan_to_num(ys), season_length(grain, len(ys)))
        pos = [i for i, _, _ in hit]
        out = s.loc[pos, [*key, time]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(pos) + 1, dtype="int32")
        out["value"], out["z"], out["expected"] = ys[pos], [z for _, z, _ in hit], [e for _, _, e in hit]
        return out[schema.names]

    return df.groupBy(*key).applyInPandas(run, schema)


def first_pass_scores(df: DataFrame, key: Sequence[str], time: str, value: str, w: int = 7, season: int = 0) -> DataFrame:
    """The first scoring pass of ``anomalies`` for every point, with windows only (series of at least 4 w points)."""
    whole = Window.partitionBy(*key)
    med = lambda c, over=whole: F.percentile(c, F.lit(0.5)).over(over)
    d = centred_median(df, key, time, value, w, "_base").withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(time)) - 1)
    d = d.withColumn("_res", F.col(value) - F.col("_base"))
    if season > 1:
        d = d.withColumn("_phase", F.col("_i") % season)
        d = d.withColumn("_off", med("_res", Window.partitionBy(*key, "_phase")))
    else:
        d = d.withColumn("_off", F.lit(0.0))
    d = d.withColumns({"_r": F.col("_res") - F.col("_off"), "_level": F.coalesce(F.nullif(med(F.abs(value)), F.lit(0.0)), F.lit(1.0))}).withColumn("_centre", med("_r"))
    d = d.withColumn("_mad", F.greatest(med(F.abs(F.col("_r") - F.col("_centre"))), 0.03 * F.col("_level")))
    expected = F.col("_base") + F.col("_off")
    d = d.withColumns({"z": 0.6745 * (F.col("_r") - F.col("_centre")) / F.col("_mad"), "expected": expected})
    big = F.abs(F.col(value) - F.col("expected")) >= 0.12 * F.greatest(F.abs("expected"), 0.5 * F.col("_level"))
    return d.withColumn("unusual", (F.abs("z") >= 3.5) & big).select(*df.columns, "expected", "z", "unusual")


# ---------------------------------------------------------------- board forecast and anomalies


def weekday_forecast(daily: DataFrame, day: str, value: str, end: dt.date, first: dt.date) -> DataFrame:
    """The next 7 days: weekday factors of the last 56 days times a line through the last 28 deseasonalised days, at least 0.

    Missing days count as 0, so days are laid on the calendar first (at most 56 rows).
    """
    spark = daily.sparkSession
    look = min(56, (end - first).days + 1)
    axis = spark.range(look).select(F.date_sub(F.lit(end), (F.lit(look - 1) - F.col("id")).cast("int")).alias("day"), F.col("id").alias("i"))
    per_day = daily.groupBy(F.col(day).alias("day")).agg(F.sum(value).alias("v"))
    d = axis.join(per_day, "day", "left").select("day", "i", F.coalesce("v", F.lit(0.0)).alias("v"), F.weekday("day").alias("wd"))
    mean = d.agg(F.coalesce(F.nullif(F.avg("v"), F.lit(0.0)), F.lit(1.0))).scalar()
    wk = d.groupBy("wd").agg(F.coalesce(F.nullif(F.avg("v") / mean, F.lit(0.0)), F.lit(1.0)).alias("factor"))
    n = min(28, look)
    tail = d.where(F.col("i") >= look - n).join(wk, "wd").withColumn("x", (F.col("i") - (look - n)).cast("double"))
    y = F.col("v") / F.col("factor")
    line = tail.agg(F.struct(F.coalesce(F.regr_slope(y, F.col("x")), F.lit(0.0)).alias("slope"), F.avg(y).alias("ym"))).scalar()
    ahead = spark.range(1, 8).select(F.col("id").cast("int").alias("k"), F.date_add(F.lit(end), F.col("id").cast("int")).alias("day")).withColumn("wd", F.weekday("day"))
    all_wd = ahead.join(wk, "wd", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return all_wd.select("day", F.greatest(F.lit(0.0), (line["ym"] + line["slope"] * (n - 1 - (n - 1) / 2 + F.col("k"))) * F.col("factor")).alias("value"))


def forecast_change(forecast_rows: DataFrame, daily: DataFrame, day: str, value: str, end: dt.date) -> DataFrame:
    """Total of the next 7 days against the last 7."""
    last = daily.where(F.col(day).between(F.lit(end - dt.timedelta(days=6)), F.lit(end))).agg(F.coalesce(F.sum(value), F.lit(0.0))).scalar()
    return forecast_rows.agg(F.sum("value").alias("total")).withColumn("last_total", last).withColumn("change", growth("total", "last_total"))


def city_anomalies(cube: DataFrame, places: DataFrame, start: dt.date, end: dt.date, top: int | None = None) -> DataFrame:
    """Days on which whole cities left their weekday baseline: cities expected above 4 % of the daily mean that moved by 30 % or more.

    ``cube``: day, entity, p; ``places``: entity, city.
    """
    days = (end - start).days + 1
    inside = F.col("day").between(F.lit(start), F.lit(end))
    mean = cube.where(inside).agg(F.sum("p") / days).scalar()
    scored = weekday_baseline(cube.where(F.col("day") >= F.lit(start - dt.timedelta(days=28))), ["entity"], "day", "p").where(inside & F.col("expected").isNotNull())
    city = scored.join(places.select("entity", "city"), "entity").groupBy("day", "city").agg(F.sum("p").alias("v"), F.sum("expected").alias("x"), F.count(F.lit(1)).alias("n"))
    hit = city.where((F.col("x") > mean * 0.04) & (F.abs(F.col("v") / F.col("x") - 1) >= 0.3))
    per_day = hit.groupBy("day").agg(F.sum("v").alias("value"), F.sum("x").alias("expected"), F.sum("n").alias("entities"), F.sort_array(F.collect_set("city")).alias("cities"))
    per_day = per_day.withColumns({"change": F.col("value") / F.col("expected") - 1, "impact": F.abs(F.col("value") - F.col("expected"))})
    per_day = per_day.orderBy(F.col("impact").desc(), "day")
    return per_day.limit(top) if top else per_day
