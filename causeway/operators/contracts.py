"""Checks that a table keeps what an operator relies on; each gives a row of counts, and ``enforce`` turns them into errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.columns import ordered


def sorted_by(df: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """Rows whose time is before that of the row before them."""
    return df.withColumn("_was", F.lag(time).over(ordered(keys, [seq]))).agg(F.count_if(F.col("_was") > F.col(time)).alias("unsorted"))


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side without a partner: a feature table is never trimmed to fit another."""
    left = a.select(*keys, F.lit(1).alias("_a"))
    right = b.select(*keys, F.lit(1).alias("_b"))
    return left.join(right, keys, "full").agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def reaches(daily: DataFrame, bars: DataFrame, day: str, most_days: int = 5) -> DataFrame:
    """Whether a daily grid ends at most ``most_days`` before the last bar."""
    ends = daily.agg(F.max(day).alias("daily_end")).crossJoin(F.broadcast(bars.agg(F.max(day).alias("bar_end"))))  # a row each
    return ends.select("*", (F.datediff("bar_end", "daily_end") <= most_days).alias("reaches"))


def degenerate(df: DataFrame, target: str, keys: list[str], subset: Column | None = None, least_sd: float = 1e-10, most_zeros: float = 0.9) -> DataFrame:
    """By key n, sd and zeros (share) of a target over the rows of ``subset``, and the reason why it cannot be learnt, null if it can.

    Nulls are no values. A key without values is ``empty``; ``enforce`` on rows with a reason makes an error of them.
    """
    y = F.col(target) if subset is None else F.when(subset, F.col(target))
    found = df.groupBy(*keys).agg(F.count(y).alias("n"), F.stddev_pop(y).alias("sd"), F.avg(F.when(y.isNotNull(), (F.abs(y) < 1e-12).cast("double"))).alias("zeros"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("sd") < least_sd, "constant").when(F.col("zeros") > most_zeros, "zeros")
    return found.withColumn("reason", reason)


def enforce(report: DataFrame, bad: Column, message: str) -> None:
    row = report.where(bad).head()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")
