"""Calendar features: distance to scheduled events by type, and encodings of the date itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causeway.functions.columns import cyclic, third_friday
from causeway.operators.asof import nearest


def proximity(days: DataFrame, calendar: DataFrame, types: list[str], day: str = "day", tau: float = 5.0) -> DataFrame:
    """For each type, exp(-|days| / tau) to its nearest event, times its magnitude, and the signed distance's tanh."""
    kinds = F.explode(F.array(*map(F.lit, types))).alias("event_type")
    left = days.select(day, kinds)
    right = calendar.select(F.col("event_day").alias(day), "event_type", "magnitude")
    near = nearest(left, right, ["magnitude"], ["event_type"], day)
    close = F.exp(-F.abs("signed_days") / tau)
    return near.groupBy(day).pivot("event_type", types).agg(
        F.first(F.coalesce(close, F.lit(0.0))).alias("near"), F.first(F.coalesce(close * F.col("near.magnitude"), F.lit(0.0))).alias("weight"),
        F.first(F.tanh(F.col("signed_days") / 10.0)).alias("phase"),
    )


def date_features(days: DataFrame, day: str = "day") -> DataFrame:
    dow_sin, dow_cos = cyclic(F.weekday(day), 5.0)
    month_sin, month_cos = cyclic(F.month(day) - 1, 12.0)
    to_expiry = F.datediff(third_friday(F.col(day)), day)
    return days.select(
        day, dow_sin.alias("dow_sin"), dow_cos.alias("dow_cos"), month_sin.alias("month_sin"), month_cos.alias("month_cos"),
        F.exp(-F.abs(to_expiry) / 3.0).alias("near_expiry"), (F.weekday(day) == 0).cast("double").alias("monday"), (F.weekday(day) == 4).cast("double").alias("friday"),
        (F.dayofmonth(day) <= 3).cast("double").alias("month_start"), (F.col(day) == F.trunc(day, "quarter")).cast("double").alias("quarter_start"),
    )


def date_encoding(days: DataFrame, day: str = "day") -> DataFrame:
    """Eleven smooth encodings of a date."""
    dow, dom = F.weekday(day), F.dayofmonth(day)
    cycles = {"dow": (dow, 5.0), "dom": (dom, 30.5), "moy": (F.month(day), 12.0)}
    waves = [c.alias(f"{n}_{f}") for n, (x, p) in cycles.items() for f, c in zip(("sin", "cos"), cyclic(x, p))]
    to_expiry = F.datediff(third_friday(F.col(day)), day)
    return days.select(
        day, *waves, F.least(F.greatest((dom - 1) / 29.0, F.lit(0.0)), F.lit(1.0)).alias("month_position"),
        F.least(F.datediff(day, F.trunc(day, "quarter")) / 91.0, F.lit(1.0)).alias("quarter_position"), F.exp(-F.abs(to_expiry) / 3.0).alias("near_expiry"),
        F.exp(-dow / 2.0).alias("near_monday"), F.exp(-(4 - dow) / 2.0).alias("near_friday"),
    )
