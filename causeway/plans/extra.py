"""Registered queries of model choice, tests and the remaining alignments."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, ordered, snap
from causeway.operators import asof, bars, learning, portfolio, resampling, rolling, signals, stacking
from causeway.plans.learning import FEATURES, features
from causeway.plans.market import BAR_C, DAY, EXT, RETURNS, U, returns, rows, snapped, with_index
from causeway.plans.portfolio import FLOW, indexed_daily, net_flow
from causeway.plans.registry import register
from causeway.sources import calendar, views
from causeway.sources.views import KEYS, sql_snap as s, with_views


def folded(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Features with ``fold``: stretches of a symbol's time."""
    nth, n = F.row_number().over(ordered(KEYS, DAY)) - 1, F.count("*").over(frame(KEYS, DAY, None, None))
    return features(spark, sf).withColumn("fold", F.floor(nth * k / n).cast("long"))


@register("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(stacking.grid_search(folded(spark, sf), FEATURES, "y", "fold", nus=(0.5, 1.5), lengths=(0.5, 2.0)))


@register("stacked_weights")
def stacked_weights(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(stacking.stack(folded(spark, sf), FEATURES, "y", "fold"))


@register("kernel_weights")
def kernel_weights(spark: SparkSession, sf: str) -> DataFrame:
    a, b = learning.FourierMap(2, 16), learning.FourierMap(1, 16, seed=1)
    import numpy as np

    sums = learning.grams(folded(spark, sf), FEATURES, "y", lambda x: np.column_stack([a(x[:, :2]), b(x[:, 2:])]), "fold")
    w = stacking.kernel_weights(stacking.unpack(sums, 32), [slice(0, 16), slice(16, 32)])
    return spark.createDataFrame([("fast", float(w[0])), ("slow", float(w[1]))], "kernel string, weight double")


@register("layer_redundancy")
def layer_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    got = stacking.redundancy(features(spark, sf), {"trend": ["z", "mom5"], "risk": ["vol"], "momentum": ["mom5"]})
    return spark.createDataFrame(got, "layer_a string, layer_b string, cka double, verdict string")


@register("unit_root", with_views("daily") + f""", l as (select symbol, day, ln(close) as x from daily), d as (select *, x - lag(x) over (partition by symbol order by day) as dx, lag(x) over (partition by symbol order by day) as x1 from l),
e as (select *, lag(dx) over (partition by symbol order by day) as x2 from d), m as (select symbol, count(*) as n, var_pop(dx) as syy, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, dx) as s1y, covar_pop(x2, dx) as s2y from e where dx is not null and x2 is not null group by 1),
b as (select *, s11 * s22 - s12 * s12 as det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from m),
t as (select symbol, n, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) as t from b where det > 1e-18)
select symbol, n, {s('t', 4)} as t, t < -2.86 as stationary_5, t < -3.43 as stationary_1 from t""")
def unit_root(spark: SparkSession, sf: str) -> DataFrame:
    got = stacking.dickey_fuller(views.daily(spark, sf).withColumn("x", F.log("close")), "x", KEYS, DAY)
    return got.select("symbol", "n", snap(F.col("t"), 4).alias("t"), "stationary_5", "stationary_1")


@register("anderson_darling", with_views("trades") + f""", u as (select strategy, pnl_pct as v, case when signal_id % 2 = 0 then 1 else 0 end as own from trades),
r as (select *, count(*) over (partition by strategy order by v range unbounded preceding) as i, sum(own) over (partition by strategy order by v range unbounded preceding) as m, count(*) over (partition by strategy) as n, sum(own) over (partition by strategy) as n1 from u)
select strategy, n, cast(n1 as bigint) as n1, {s('sum(pow(cast(m * n - i * n1 as double), 2) / cast(i * (n - i) as double)) / cast(n1 * (n - n1) * n as double)', 4)} as a2 from r where i < n group by strategy, n, n1""")
def anderson_darling(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trades(spark, sf)
    got = stacking.anderson_darling(t.where("signal_id % 2 = 0"), t.where("signal_id % 2 <> 0"), "pnl_pct", ["strategy"])
    return got.select("strategy", "n", "n1", snap(F.col("a2"), 4).alias("a2"))


@register("baseline_distance")
def baseline_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Each strategy's trades since 1996 against a synthetic sample by the win rate and averages of its trades before."""
    t = views.trades(spark, sf)
    early = F.col("exit_day") < "1996-01-01"
    rates = t.where(early).groupBy("strategy").agg(
        F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"), F.avg(F.when(F.col("pnl_pct") > 0, F.col("pnl_pct"))).alias("avg_win"),
        F.avg(F.when(F.col("pnl_pct") <= 0, -F.col("pnl_pct"))).alias("avg_loss"),
    )
    return stacking.against_baseline(t.where(~early), rates, "pnl_pct", ["strategy"])


@register("momentum_gate", with_views("daily") + f""", a as (select symbol, day, coalesce(ln(close / lag(close, 60) over (partition by symbol order by day)), 0.0::double) as x, avg(close) over {rows(-19, 0)} / avg(close) over {rows(-59, 0)} - 1 as y, row_number() over (partition by symbol order by day) as n from daily),
z as (select symbol, day, case when n <= 20 then 0.0::double else (x - avg(x) over {U}) / (stddev_pop(x) over {U} + 1e-8) end as z1, case when n <= 20 then 0.0::double else (y - avg(y) over {U}) / (stddev_pop(y) over {U} + 1e-8) end as z2 from a)
select symbol, day, {s('1 / (1 + exp(-(z1 + z2) / 2))')} as gate from z""")
def momentum_gate(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(stacking.momentum_gate(views.daily(spark, sf), "close", KEYS, DAY), "symbol", "day", gate="gate")


@register("bar_day_map", with_views("tape", "ext_daily") + f""",
c as (select *, sum(notional_c) over (partition by symbol order by ts, seq) as cum, sum(notional_c) over (partition by symbol) as total from tape),
b as (select symbol, day, unnest(range(cast((cum - notional_c) // {BAR_C} + 1 as bigint), cast(least(cum // {BAR_C}, (total - 1) // {BAR_C}) + 1 as bigint))) as bar_id from c),
j as (select b.symbol, b.bar_id, e.day as known_day, e.vix from b asof left join ext_daily e on b.day >= e.day)
select symbol, bar_id, coalesce(known_day, (select min(day) from ext_daily)) as known_day, {s('coalesce(vix, (select min_by(vix, day) from ext_daily))', 4)} as vix from j""")
def bar_day_map(spark: SparkSession, sf: str) -> DataFrame:
    """The last daily row at or before each bar, bars before the first clipped to it, and its value gathered."""
    b = bars.master_bars(views.tape(spark, sf), BAR_C).select("symbol", "bar_id", F.to_date("close_ts").alias("day"))
    d = indexed_daily(spark, sf)
    hit = asof.as_of(b, {"hit": (d, ["vix"])}, KEYS, "day")
    head = d.groupBy("symbol").agg(F.min("day").alias("d0"), F.min_by("vix", "day").alias("v0"))
    j = hit.join(head, "symbol")
    return j.select("symbol", "bar_id", F.coalesce("hit.as_of", "d0").alias("known_day"), snap(F.coalesce("hit.vix", "v0"), 4).alias("vix"))


@register("greeks_on_bars", FLOW + f""", t as ({views.SQL['tape']}), k as (select *, sum(notional_c) over (partition by symbol order by ts, seq) as cum, sum(notional_c) over (partition by symbol) as total from t),
b as (select symbol, day, unnest(range(cast((cum - notional_c) // {BAR_C} + 1 as bigint), cast(least(cum // {BAR_C}, (total - 1) // {BAR_C}) + 1 as bigint))) as bar_id from k)
select b.symbol, b.bar_id, {s('coalesce(f.net_vanna, 0.0::double)', 4)} as net_vanna from b asof left join f on b.symbol = f.symbol and b.day >= f.day""")
def greeks_on_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.master_bars(views.tape(spark, sf), BAR_C).select("symbol", "bar_id", F.to_date("close_ts").alias("day"))
    hit = asof.as_of(b, {"hit": (net_flow(spark, sf), ["net_vanna"])}, KEYS, "day")
    return hit.select("symbol", "bar_id", snap(F.coalesce("hit.net_vanna", F.lit(0.0)), 4).alias("net_vanna"))


@register("weekly_alignment", with_views("trades", "ext_daily") + f""", a as (select cast(date_trunc('week', exit_day) as date) + 6 as week, sum(pnl_pct) as pnl from trades group by 1),
b as (select cast(date_trunc('week', day) as date) + 6 as week, max_by(index_close, day) as close from ext_daily group by 1), lim as (select min(week) as lo, max(week) as hi from a)
select coalesce(a.week, b.week) as week, {s('coalesce(pnl, 0.0::double)')} as pnl, {s('close', 3)} as close from a full join b on a.week = b.week cross join lim where coalesce(a.week, b.week) between lo and hi""")
def weekly_alignment(spark: SparkSession, sf: str) -> DataFrame:
    week = lambda d: F.date_add(F.trunc(d, "week"), 6).alias("week")
    a = views.trades(spark, sf).groupBy(week("exit_day")).agg(F.sum("pnl_pct").alias("pnl"))
    b = views.ext_daily(spark, sf).groupBy(week("day")).agg(F.max_by("index_close", "day").alias("close"))
    span = a.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    j = a.join(b, "week", "full").crossJoin(F.broadcast(span)).where(F.col("week").between(F.col("lo"), F.col("hi")))  # one row
    return j.select("week", snap(F.coalesce("pnl", F.lit(0.0))).alias("pnl"), snap(F.col("close"), 3).alias("close"))


@register("variance_premium_target", EXT + f""", r as (select *, ln(close / lag(close) over (partition by symbol order by day)) as ret, lead(ln(close)) over (partition by symbol order by day) - ln(close) as target from j),
v as (select symbol, day, target, vix, ln(close / lag(close, 21) over (partition by symbol order by day)) as mom21, case when count(ret) over {rows(-29, 0)} = 30 then stddev_samp(ret) over {rows(-29, 0)} * sqrt(252.0::double) end as rv30 from r)
select symbol, day, {s('rv30')} as rv30, {s('vix / 100 - rv30')} as premium, {s('mom21')} as mom21, {s('target')} as target from v where rv30 is not null and vix is not null and mom21 is not null and target is not null""")
def variance_premium_target(spark: SparkSession, sf: str) -> DataFrame:
    """The inclusive, sample-deviation form with the next day's log return as target; incomplete rows are dropped."""
    f = frame(KEYS, DAY, -29, 0)
    w = ordered(KEYS, DAY)
    r = with_index(spark, sf).withColumn("ret", rolling.log_return("close", KEYS, DAY)).withColumn("target", F.lead(F.log("close")).over(w) - F.log("close"))
    r = r.withColumn("rv30", F.when(F.count("ret").over(f) == 30, F.stddev_samp("ret").over(f) * F.sqrt(F.lit(252.0)))).withColumn("mom21", F.log(F.col("close") / F.lag("close", 21).over(w)))
    r = r.withColumn("premium", F.col("vix") / 100 - F.col("rv30")).dropna(subset=["rv30", "vix", "mom21", "target"])
    return snapped(r, "symbol", "day", rv30="rv30", premium="premium", mom21="mom21", target="target")


@register("kalman_noise", RETURNS + f" select symbol, {s('0.1 * var_pop(ret)', 8)} as q_auto, {s('quantile_cont(abs(ret), 0.5)')} as spread from r where ret is not null group by symbol")
def kalman_noise(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).where("ret is not null")
    return r.groupBy("symbol").agg(snap(0.1 * F.var_pop("ret"), 8).alias("q_auto"), snap(F.percentile(F.abs("ret"), 0.5)).alias("spread"))


@register("bootstrap_intervals")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Eight figures of each strategy: observed, and the mean, median and tails of 10,000 resampled paths."""
    sims = resampling.bootstrap(views.trades(spark, sf), ["strategy"], ["exit_day", "signal_id"], "pnl_pct", 10_000)
    return resampling.intervals(sims, ["strategy"])


@register("sharpe_bootstrap")
def sharpe_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The yearly Sharpe ratio of all strategies' profit by day, over 1,000 draws of active days one by one."""
    days = views.trades(spark, sf).groupBy("exit_day").agg(F.sum("pnl_pct").alias("pnl")).withColumn("book", F.lit("all"))
    return resampling.sharpe_interval(days, ["book"], ["exit_day"], "pnl", 1000)


#: What luck gives the best of ten trials, in spreads: (1 - g) z(1 - 1 / 10) + g z(1 - 1 / 10e), g being Euler's constant.
TRIALS = 10
_ND = NormalDist()
LUCK = (1 - 0.5772156649) * _ND.inv_cdf(1 - 1 / TRIALS) + 0.5772156649 * _ND.inv_cdf(1 - 1 / (TRIALS * math.e))
NORMAL = "case when z >= 0 then 1 - tail else tail end"


@register("deflated_sharpe", with_views("trades") + f""", m as (select strategy, count(*) as n, avg(pnl_pct) as mu, stddev_pop(pnl_pct) as sd from trades where pnl_pct is not null group by 1),
k as (select t.strategy, any_value(n) as n, any_value(mu / sd) as sharpe, avg(pow((pnl_pct - mu) / sd, 3)) as skew, avg(pow((pnl_pct - mu) / sd, 4)) - 3 as excess from trades t join m on t.strategy = m.strategy group by 1),
v as (select *, (1 - skew * sharpe + (excess - 1) / 4 * sharpe * sharpe) / n as var from k), s as (select *, sqrt(case when var > 0 then var else 1.0::double / n end) as spread from v),
z as (select *, (sharpe - spread * {LUCK!r}::double) / spread as z from s), t as (select *, 1 / (1 + 0.2316419 * abs(z)) as t from z),
p as (select *, 0.3989422804014327::double * exp(-0.5 * z * z) * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) as tail from t)
select strategy, n, {s('sharpe')} as sharpe, {s(NORMAL)} as dsr from p""")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """By strategy: Sharpe a trade, and the chance that it is more than the best of as many trials by luck."""
    t = views.trades(spark, sf).where("pnl_pct is not null").groupBy("strategy").agg(
        F.count("*").alias("n"), (F.avg("pnl_pct") / F.stddev_pop("pnl_pct")).alias("sharpe"), F.skewness("pnl_pct").alias("skew"), F.kurtosis("pnl_pct").alias("excess")
    )
    dsr = portfolio.deflated_sharpe(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("excess"), TRIALS)
    return t.select("strategy", "n", snap(F.col("sharpe")).alias("sharpe"), snap(dsr).alias("dsr"))
