"""Joins in time: backward and forward as-of, several streams at once, nearest, and calendar joins.

All are one union and one window pass by key: rows of the right side are put before equal times of the left. An
unpartitioned as-of (an empty key list) runs in one task and is meant for daily series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _stack(left: DataFrame, rights: dict[str, tuple[DataFrame, list[str]]], keys: list[str], time: str, seq: str | None) -> DataFrame:
    """Rows of all sides: keys, t, side (0 for left), and one struct column a side."""
    kinds = {name: ", ".join(f"{c}: {dict(r.dtypes)[c]}" for c in cols) for name, (r, cols) in rights.items()}
    wide = [F.lit(None).cast(f"struct<as_of: {dict(rights[n][0].dtypes)[time]}, {kinds[n]}>").alias(n) for n in rights]
    out = left.select(*keys, F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("tie"), F.struct(*left.columns).alias("own"), *wide)
    for name, (right, cols) in rights.items():
        pack = F.struct(F.col(time).alias("as_of"), *cols)
        tie = F.col(seq).cast("long") if seq and seq in right.columns else F.lit(0).cast("long")
        out = out.unionByName(
            right.select(*keys, F.col(time).alias("t"), F.lit(0).alias("side"), tie.alias("tie"), pack.alias(name)), allowMissingColumns=True
        )
    return out


def finite(*cols: str) -> Column:
    """A row with a value that is missing or not finite is no observation."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return ok


def as_of(left: DataFrame, rights: dict[str, tuple[DataFrame, list[str]]], keys: list[str], time: str, seq: str | None = "seq", forward: bool = False) -> DataFrame:
    """``left`` with a struct column for each right side: the last row at or before its time (forward: first at or after).

    Ties go to the last of the right rows by ``seq``. Without a match the struct is null. All sides share one shuffle.
    """
    stacked = _stack(left, rights, keys, time, seq)
    if forward:
        # backwards in time, so that the frame only grows
        w = Window.partitionBy(*keys).orderBy(F.desc("t"), F.asc("side"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy(F.asc("t"), F.asc("side"), F.asc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda n: F.last(n, ignorenulls=True).over(w)
    return stacked.select("own", *(pick(n).alias(n) for n in rights)).where("own is not null").select("own.*", *rights)


def nearest(left: DataFrame, right: DataFrame, cols: list[str], keys: list[str], day: str) -> DataFrame:
    """``left`` with the right row of the least distance in days, and ``signed_days`` (positive: the event lies ahead).

    At equal distance the earlier row is taken.
    """
    both = as_of(left, {"back": (right, cols)}, keys, day)
    both = as_of(both, {"ahead": (right, cols)}, keys, day, forward=True)
    back, ahead = F.datediff("back.as_of", day), F.datediff("ahead.as_of", day)
    use_back = F.col("back").isNotNull() & (F.col("ahead").isNull() | (-back <= ahead))
    pick = F.when(use_back, F.col("back")).otherwise(F.col("ahead"))
    return both.withColumn("near", pick).withColumn("signed_days", F.datediff("near.as_of", day)).drop("back", "ahead")


def reindex(daily: DataFrame, days: DataFrame, cols: list[str], keys: list[str], day: str, back_fill: bool = False) -> DataFrame:
    """Values of ``cols`` carried forward onto other days; ``back_fill`` also fills the head, which looks ahead."""
    out = as_of(days, {"hit": (daily, cols)}, keys, day)
    out = out.select(*days.columns, *(F.col(f"hit.{c}").alias(c) for c in cols))
    if back_fill:
        after = Window.partitionBy(*keys).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.coalesce(c, F.last(c, True).over(after)) for c in cols})
    return out


def strictly_before(left: DataFrame, daily: DataFrame, cols: list[str], keys: list[str], day: str) -> DataFrame:
    """The last daily row of an earlier day: a day's own close is not known during that day."""
    prior = left.withColumn("_day", F.col(day)).withColumn(day, F.date_sub(day, 1))
    out = as_of(prior, {"hit": (daily, cols)}, keys, day)
    return out.withColumn(day, F.col("_day")).drop("_day")


def ahead_return(prices: DataFrame, keys: list[str], day: str, price: str, days: int) -> DataFrame:
    """log price at the first row at least ``days`` days later (the last row where there is none) less the own log price."""
    order = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    later = F.first(price).over(order.rangeBetween(days, Window.unboundedFollowing))
    last = F.last(price).over(order.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return prices.withColumn("ahead", F.log(F.coalesce(later, last)) - F.log(F.col(price)))


def regime_of(trades: DataFrame, regimes: DataFrame, least_match: float = 0.5) -> DataFrame:
    """vol_regime of each trade by signal; where at most ``least_match`` of all have one, by the nearest day."""
    named = trades.join(regimes.groupBy("signal_id").agg(F.max_by("vol_regime", "as_of_day").alias("vol_regime")), "signal_id", "left")
    share = named.agg(F.avg(F.col("vol_regime").isNotNull().cast("double"))).first()[0] or 0.0
    if share > least_match:
        return named.withColumn("vol_regime", F.coalesce("vol_regime", F.lit("unknown")))
    by_day = regimes.groupBy(F.col("as_of_day").alias("entry_day")).agg(F.max_by("vol_regime", "signal_id").alias("vol_regime"))
    near = nearest(trades, by_day, ["vol_regime"], [], "entry_day")
    return near.withColumn("vol_regime", F.coalesce("near.vol_regime", F.lit("unknown"))).drop("near", "signed_days")


def contains_match(names: DataFrame, config: DataFrame) -> DataFrame:
    """Each name with the first config key equal to it, else the first that holds it or that it holds.

    ``config`` (key, rank) is a settings table: small by nature, and broadcast as such.
    """
    on = (F.col("name") == F.col("key")) | F.contains("name", F.col("key")) | F.contains("key", F.col("name"))
    order = F.struct((F.col("name") != F.col("key")).alias("fuzzy"), "rank", "key")
    return names.join(F.broadcast(config), on, "left").groupBy("name").agg(F.min_by("key", order).alias("key"))
