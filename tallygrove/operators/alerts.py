"""Alert evaluation and the state machine over checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import with_previous


def evaluate(results: DataFrame) -> DataFrame:
    """State and value of each check.

    ``results``: alert, kind (value, rows, changed), op, threshold, rows, value (text of the first cell),
    last_value, last_state.  Numbers compare as numbers; text knows only == and !=.
    """
    number, limit = F.col("value").try_cast("double"), F.col("threshold").try_cast("double")
    text = F.coalesce("value", F.lit(""))
    both = number.isNotNull() & limit.isNotNull()
    ops = {">": number > limit, ">=": number >= limit, "<": number < limit, "<=": number <= limit, "==": number == limit, "!=": number != limit}
    numeric = F.coalesce(*[F.when(F.col("op") == o, e) for o, e in ops.items()])
    textual = F.when(F.col("op") == "==", text == F.col("threshold")).when(F.col("op") == "!=", text != F.col("threshold"))
    none = F.col("rows") == 0
    hit = (
        F.when(F.col("kind") == "rows", F.when(F.col("op") == "==", none).otherwise(~none))
        .when(none & (F.col("kind") == "value"), False)
        .when(none, F.col("last_value").isNotNull() & ~F.col("last_value").isin("", "(no rows)"))
        .when(F.col("kind") == "changed", F.col("last_value").isNotNull() & (F.col("last_state") != "UNKNOWN") & (text != F.col("last_value")))
        .when(both, numeric).otherwise(textual)
    )
    shown = F.when(F.col("kind") == "rows", F.concat(F.col("rows"), F.when(F.col("rows") == 1, " row").otherwise(" rows"))).when(none, "(no rows)").otherwise(text)
    state = F.when(hit.isNull(), "ERROR").when(hit, "TRIGGERED").otherwise("OK")
    return results.withColumns({"state": state, "shown": shown})


def _notification(prev: Column) -> Column:
    state = F.col("state")
    return (
        F.when((state == "TRIGGERED") & ((prev != "TRIGGERED") | (F.col("notify_when") == "each")), "triggered")
        .when((state == "OK") & (prev == "TRIGGERED") & F.col("notify_ok"), "back to normal")
        .when((state == "ERROR") & (prev != "ERROR"), "failed")
    )


def transitions(checks: DataFrame, start: str = "UNKNOWN") -> DataFrame:
    """The message each check sends: first trigger (or each), recovery, first error.

    ``checks``: alert, time, state, notify_when, notify_ok. Only the check before matters.
    """
    d = with_previous(checks, ["alert"], "time", "state", "previous").withColumn("previous", F.coalesce("previous", F.lit(start)))
    return d.withColumn("message", _notification(F.col("previous")))


def changed_values(checks: DataFrame) -> DataFrame:
    """Whether the value differs from the check before."""
    d = with_previous(checks, ["alert"], "time", "value", "_before")
    return d.withColumn("changed", F.coalesce(F.col("_before") != F.col("value"), F.lit(False))).drop("_before")
