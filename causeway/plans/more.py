"""Registered queries of the rest: joins by rank, rolling risk, gates, kernels on pairs of days, and chart data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, ordered, snap, wide_snap
from causeway.operators import asof, learning, rolling, signals
from causeway.plans.market import DAY, EXT, MACRO, RETURNS, U, returns, rows, snapped, with_index
from causeway.plans.portfolio import FLOW, named_trades, net_flow
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, sql_snap as s, with_views


@register("execution_risk", with_views("trades") + f""", x as (select signal_id, min_by(risk, exit_day) as used from trades where exit_reason <> 'time_stop' group by 1)
select t.signal_id, {s('coalesce(x.used, 0.01::double)')} as used, coalesce(x.used, 0.01::double) > 0.02 as over_cap from trades t left join x on t.signal_id = x.signal_id""")
def execution_risk(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trades(spark, sf)
    used = t.where("exit_reason <> 'time_stop'").groupBy("signal_id").agg(F.min_by("risk", "exit_day").alias("used"))
    j = t.select("signal_id").join(used, "signal_id", "left").withColumn("used", F.coalesce("used", F.lit(0.01)))
    return j.select("signal_id", snap(F.col("used")).alias("used"), (F.col("used") > 0.02).alias("over_cap"))


CONFIG = [("URGENT", 1), ("HIGH", 2), ("4-NOT SPECIFIED", 3), ("5", 4)]


@register("config_match", with_views("trades") + """, c as (select * from (values ('URGENT', 1), ('HIGH', 2), ('4-NOT SPECIFIED', 3), ('5', 4)) v(key, rank)),
n as (select strategy as name, count(*) as n from trades group by 1)
select name, any_value(n) as n, arg_min(key, (name <> key, rank, key)) as key from n left join c on name = key or contains(name, key) or contains(key, name) group by name""")
def config_match(spark: SparkSession, sf: str) -> DataFrame:
    n = views.trades(spark, sf).groupBy(F.col("strategy").alias("name")).agg(F.count("*").alias("n"))
    return asof.contains_match(n.select("name"), spark.createDataFrame(CONFIG, "key string, rank int")).join(n, "name")


@register("regime_calibration", with_views("regimes", "ext_daily") + f""", x as (select day, ln(index_close / lag(index_close) over (order by day)) as r from ext_daily),
v as (select day, stddev_samp(r) over (order by day rows between 19 preceding and current row) as rv20 from x),
t as (select vol_regime, rv20 from regimes join v on as_of_day = day where rv20 is not null),
g as (select avg(rv20) as m, case when stddev_samp(rv20) > 0 then stddev_samp(rv20) else 1.0::double end as sd from t),
b as (select vol_regime, count(*) as n, avg(rv20) as own, any_value(m) as m, any_value(sd) as sd from t cross join g group by 1)
select vol_regime, n, {s('own', 8)} as mean_rv20, {s("case when vol_regime = 'low' and own < m or vol_regime = 'high' and own > m then 1.0::double else greatest(0.0::double, 1 - abs(own - m) / sd) end")} as score from b""")
def regime_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Whether realised volatility was lower in days labelled low, and higher in those labelled high: 1 is as labelled."""
    e = views.ext_daily(spark, sf)  # one row a day: a short series
    x = e.withColumn("r", F.log(F.col("index_close") / F.lag("index_close").over(ordered([], DAY))))
    v = x.select("day", F.stddev_samp("r").over(frame([], DAY, -19, 0)).alias("rv20"))
    t = views.regimes(spark, sf).join(v.where("rv20 is not null"), F.col("as_of_day") == F.col("day"))
    sd = F.stddev_samp("rv20")
    g = t.agg(F.avg("rv20").alias("m"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    by = t.groupBy("vol_regime").agg(F.count("*").alias("n"), F.avg("rv20").alias("own")).crossJoin(F.broadcast(g))  # one row
    as_named = ((F.col("vol_regime") == "low") & (F.col("own") < F.col("m"))) | ((F.col("vol_regime") == "high") & (F.col("own") > F.col("m")))
    score = F.when(as_named, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("own") - F.col("m")) / F.col("sd")))
    return by.select("vol_regime", "n", snap(F.col("own"), 8).alias("mean_rv20"), snap(score).alias("score"))


@register("correlation_matrix", RETURNS + f" select a.symbol as a, b.symbol as b, count(*) as n, {s('corr(a.ret, b.ret)')} as corr, abs(corr(a.ret, b.ret)) > 0.95 as redundant from r a join r b on a.day = b.day and a.symbol < b.symbol where a.ret is not null and b.ret is not null group by 1, 2")
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).where("ret is not null").select("symbol", "day", "ret")
    pair = r.toDF("a", "day", "x").join(r.toDF("b", "day", "y"), "day").where("a < b")  # symbols are few a day
    c = pair.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("c"))
    return c.select("a", "b", "n", snap(F.col("c")).alias("corr"), (F.abs("c") > 0.95).alias("redundant"))


@register("portfolio_variance", RETURNS + f""", p as (select a.symbol as a, b.symbol as b, covar_samp(a.ret, b.ret) as c from r a join r b on a.day = b.day where a.ret is not null and b.ret is not null group by 1, 2),
w as (select count(distinct symbol) as k from r) select {s('sqrt(sum(c / (k * k)) * 252)')} as vol, {s('least(2.0::double, 0.15 / sqrt(sum(c / (k * k)) * 252))')} as scale from p cross join w""")
def portfolio_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility a year of equal weights by the covariance matrix, and the scale that brings it to 15 %."""
    r = returns(spark, sf)
    k = r.agg(F.countDistinct("symbol").alias("k"))
    own = r.where("ret is not null").select("symbol", "day", "ret")
    p = own.toDF("a", "day", "x").join(own.toDF("b", "day", "y"), "day").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    var = p.crossJoin(F.broadcast(k)).agg((F.sum(F.col("c") / (F.col("k") * F.col("k"))) * 252).alias("v"))
    return var.select(snap(F.sqrt("v")).alias("vol"), snap(F.least(F.lit(2.0), 0.15 / F.sqrt("v"))).alias("scale"))


W60 = rolling.fractional_weights(0.5)
X60 = " + ".join(f"({w!r})::double * lag(ln(close), {k}) over (partition by symbol order by day)" for k, w in enumerate(W60))


@register("momentum_features", RETURNS + f""", x as (select symbol, day, close, ret, case when count(ret) over {rows(-4, 0)} = 5 then sum(ret) over {rows(-4, 0)} end as m5, row_number() over (partition by symbol order by day) as n from r),
y as (select symbol, day, case when count(m5) over {rows(-251, 0)} = 252 then (m5 - avg(m5) over {rows(-251, 0)}) / (stddev_samp(m5) over {rows(-251, 0)} + 1e-10) end as z5,
  case when count(ret) over {rows(-19, 0)} = 20 then (close - avg(close) over {rows(-19, 0)}) / (stddev_samp(ret) over {rows(-19, 0)} * close + 1e-10) end as x20, case when n >= {len(W60)} then {X60} end as x60 from x)
select symbol, day, {s('z5')} as z5, {s('x20')} as x20, {s('x60')} as x60 from y""")
def momentum_features(spark: SparkSession, sf: str) -> DataFrame:
    """A year's z-score of the 5-day log return, distance from the 20-day mean by volatility, and the fractional difference."""
    f5, f20, f252 = (frame(KEYS, DAY, -n, 0) for n in (4, 19, 251))
    x = returns(spark, sf).withColumn("p", F.log("close")).withColumn("m5", F.when(F.count("ret").over(f5) == 5, F.sum("ret").over(f5)))
    z5 = F.when(F.count("m5").over(f252) == 252, (F.col("m5") - F.avg("m5").over(f252)) / (F.stddev_samp("m5").over(f252) + 1e-10))
    x20 = (F.col("close") - F.avg("close").over(f20)) / (F.stddev_samp("ret").over(f20) * F.col("close") + 1e-10)
    return snapped(x, "symbol", "day", z5=z5, x20=F.when(F.count("ret").over(f20) == 20, x20), x60=rolling.fractional_difference("p", KEYS, DAY, 0.5))


@register("residual_variance", MACRO + f""", q as (select symbol, day, r as y, s as x1, lag(s, 1, 0.0::double) over (partition by symbol order by day) as x2 from r),
m as (select *, count(*) over {rows(-59, 0)} as n, var_pop(y) over {rows(-59, 0)} as syy, var_pop(x1) over {rows(-59, 0)} as s11, var_pop(x2) over {rows(-59, 0)} as s22, covar_pop(x1, x2) over {rows(-59, 0)} as s12,
  covar_pop(x1, y) over {rows(-59, 0)} as s1y, covar_pop(x2, y) over {rows(-59, 0)} as s2y from q), d as (select *, s11 * s22 - s12 * s12 as det from m)
select symbol, day, {s('case when n = 60 and det > 1e-18 then greatest(0.0::double, syy - (s1y * s22 - s2y * s12) / det * s1y - (s2y * s11 - s1y * s12) / det * s2y) * n / (n - 3) end')} as resid_var from d""")
def residual_variance(spark: SparkSession, sf: str) -> DataFrame:
    j = with_index(spark, sf)
    q = j.select("symbol", "day", F.coalesce(rolling.log_return("close", KEYS, DAY), F.lit(0.0)).alias("y"), F.coalesce(rolling.log_return("index_close", KEYS, DAY), F.lit(0.0)).alias("x1"))
    q = q.withColumn("x2", F.coalesce(F.lag("x1").over(ordered(KEYS, DAY)), F.lit(0.0)))
    # a determinant of 0 makes the quotient null before the guard, not an error
    return snapped(rolling.residual_variance(q, KEYS), "symbol", "day", resid_var="resid_var")


@register("lagged_features", RETURNS + f" select symbol, day, {s(f'lag(avg(close) over {rows(-4, 0)}) over (partition by symbol order by day)')} as mean5_known from r".replace(
    f"lag(avg(close) over {rows(-4, 0)}) over (partition by symbol order by day)", f"avg(close) over {rows(-5, -1)}"))
def lagged_features(spark: SparkSession, sf: str) -> DataFrame:
    """Daily features shifted by a day: what is known before the day begins."""
    d = views.daily(spark, sf).withColumn("m", F.avg("close").over(frame(KEYS, DAY, -4, 0)))
    return snapped(d, "symbol", "day", mean5_known=F.lag("m").over(ordered(KEYS, DAY)))


@register("event_gate", RETURNS + f""", g as (select symbol, day, abs(coalesce(ret, 0.0::double)) as x from r)
select symbol, day, {s(f'0.5 + 0.5 * (x - min(x) over {U}) / (max(x) over {U} - min(x) over {U} + 1e-12)')} as gate from g""")
def event_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A value put between one half and one by the range so far; the range of the whole sample would look ahead."""
    f = frame(KEYS, DAY, None, 0)
    g = returns(spark, sf).withColumn("x", F.abs(F.coalesce("ret", F.lit(0.0))))
    gate = 0.5 + 0.5 * (F.col("x") - F.min("x").over(f)) / (F.max("x").over(f) - F.min("x").over(f) + 1e-12)
    return snapped(g, "symbol", "day", gate=gate)


@register("macro_regime", MACRO + f""", z as (select symbol, day, r, sum(r) over {rows(-20, -1)} as mom from r), m as (select *, quantile_cont(mom, 0.5) over {rows(-251, 0)} as mid from z where mom is not null),
k as (select symbol, day, (1 + sqrt(3.0::double) * abs(mom - mid) / 0.1) * exp(-sqrt(3.0::double) * abs(mom - mid) / 0.1) as k from m)
select symbol, day, {s('k')} as activation, case when k > 0.66 then 'macro_driven' when k < 0.33 then 'idiosyncratic' else 'transitional' end as label from k""")
def macro_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Matern kernel of a day's momentum against the median of a year up to it, and the label by thirds."""
    r = with_index(spark, sf).withColumn("r", F.coalesce(rolling.log_return("close", KEYS, DAY), F.lit(0.0)))
    z = r.select("symbol", "day", F.sum("r").over(frame(KEYS, DAY, -20, -1)).alias("mom"))
    m = z.where("mom is not null").withColumn("mid", F.percentile("mom", 0.5).over(frame(KEYS, DAY, -251, 0)))
    k = m.withColumn("k", learning.matern(F.abs(F.col("mom") - F.col("mid")), 1.5, 0.1))
    return k.select("symbol", "day", snap(F.col("k")).alias("activation"), F.when(F.col("k") > 0.66, "macro_driven").when(F.col("k") < 0.33, "idiosyncratic").otherwise("transitional").alias("label"))


WEEK = RETURNS + """, w as (select symbol, cast(date_trunc('week', day) as date) + 6 as week, sum(ret) as x from r where ret is not null group by 1, 2)"""


@register("rolling_risk", WEEK + f""", f as (select *, count(*) over (partition by symbol order by week rows between 12 preceding and current row) as n, avg(x) over (partition by symbol order by week rows between 12 preceding and current row) as m,
  stddev_samp(x) over (partition by symbol order by week rows between 12 preceding and current row) as sd, sqrt(avg(pow(least(x, 0.0), 2)) over (partition by symbol order by week rows between 12 preceding and current row)) as down from w)
select symbol, week, {s('m / nullif(sd, 0) * sqrt(52.0::double)', 4)} as sharpe, {s('m / nullif(down, 0) * sqrt(52.0::double)', 4)} as sortino from f where n = 13""")
def rolling_risk(spark: SparkSession, sf: str) -> DataFrame:
    w = returns(spark, sf).where("ret is not null").groupBy("symbol", F.date_add(F.trunc("day", "week"), 6).alias("week")).agg(F.sum("ret").alias("x"))
    f = frame(KEYS, ["week"], -12, 0)
    w = w.withColumns({"n": F.count("*").over(f), "m": F.avg("x").over(f), "sd": F.stddev_samp("x").over(f), "down": F.sqrt(F.avg(F.pow(F.least("x", F.lit(0.0)), 2)).over(f))}).where("n = 13")
    year = F.sqrt(F.lit(52.0))
    ratio = lambda d: snap(F.try_divide("m", F.nullif(d, F.lit(0.0))) * year, 4)
    return w.select("symbol", "week", ratio("sd").alias("sharpe"), ratio("down").alias("sortino"))


@register("cumulative_curves", RETURNS + f", c as (select symbol, day, exp(sum(coalesce(ret, 0.0::double)) over {U}) - 1 as c from r) select symbol, day, {s('c')} as curve from c")
def cumulative_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The compounded return since the first day; log returns add up to it."""
    r = returns(spark, sf).withColumn("g", F.coalesce("ret", F.lit(0.0)))
    return snapped(r, "symbol", "day", curve=F.exp(F.sum("g").over(frame(KEYS, DAY, None, 0))) - 1)


@register("equity_curve", with_views("trades") + f", e as (select strategy, signal_id, exp(sum(ln(1 + 0.01 * pnl_pct)) over (partition by strategy order by exit_day, signal_id rows unbounded preceding)) as eq from trades) select strategy, signal_id, {s('eq')} as equity from e")
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Compounded profit: of many trades, a sum that rounds little, and levels beyond 2^63 on the grid.

    The exponential is numpy's, as Java's is off by a last digit in a tenth of cases.
    """
    t = views.trades(spark, sf).select("strategy", "signal_id", "exit_day", F.log(1 + 0.01 * F.col("pnl_pct")).alias("g"))
    e = rolling.running_sum(t, ["strategy"], ["exit_day", "signal_id"], "g", "equity", np.exp)
    return e.select("strategy", "signal_id", wide_snap("equity").alias("equity"))


@register("trade_metrics", with_views("trades") + f""" select exit_reason, count(*) as n, {s('avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end)')} as win_rate, {s('sum(greatest(pnl_pct, 0.0)) / greatest(-sum(least(pnl_pct, 0.0)), 1e-9)', 4)} as profit_factor,
  {s('avg(pnl_pct)')} as expectancy, {s('avg(pnl_pct) / (stddev_pop(pnl_pct) + 1e-9)', 5)} as sharpe from trades group by 1""")
def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pnl_pct")
    return views.trades(spark, sf).groupBy("exit_reason").agg(
        F.count("*").alias("n"), snap(F.avg((p > 0).cast("double"))).alias("win_rate"),
        snap(F.sum(F.greatest(p, F.lit(0.0))) / F.greatest(-F.sum(F.least(p, F.lit(0.0))), F.lit(1e-9)), 4).alias("profit_factor"),
        snap(F.avg(p)).alias("expectancy"), snap(F.avg(p) / (F.stddev_pop(p) + 1e-9), 5).alias("sharpe"),
    )


@register("edge_decomposition", RETURNS + f""", l as (select symbol, ret, sign(lag(ret) over (partition by symbol order by day)) as pos from r)
select symbol, count(*) filter (where pos > 0) as longs, count(*) filter (where pos < 0) as shorts, {s('avg(ret) filter (where pos > 0)')} as long_mean, {s('avg(ret) filter (where pos < 0)')} as short_mean,
  {s('avg(pos * ret) - avg(ret)')} as timing_edge from l where pos is not null and ret is not null group by symbol""")
def edge_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    l = returns(spark, sf).withColumn("pos", F.signum(F.lag("ret").over(ordered(KEYS, DAY)))).where("pos is not null and ret is not null")  # noqa: E741
    pos, ret = F.col("pos"), F.col("ret")
    return l.groupBy("symbol").agg(
        F.count_if(pos > 0).alias("longs"), F.count_if(pos < 0).alias("shorts"), snap(F.avg(F.when(pos > 0, ret))).alias("long_mean"),
        snap(F.avg(F.when(pos < 0, ret))).alias("short_mean"), snap(F.avg(pos * ret) - F.avg(ret)).alias("timing_edge"),
    )


@register("layer_snr", RETURNS + f""", l as (select symbol, ret, lag(ret) over (partition by symbol order by day) as p from r), f as (select * from l where p is not null and ret is not null)
select symbol, {s('var_pop(p) / (var_pop(ret - p) + 1e-12)', 4)} as snr, {s('corr(ret, p)')} as autocorr, {s('sqrt(avg(pow(ret - p, 2)))')} as distance from f group by symbol""")
def layer_snr(spark: SparkSession, sf: str) -> DataFrame:
    f = returns(spark, sf).withColumn("p", F.lag("ret").over(ordered(KEYS, DAY))).where("p is not null and ret is not null")
    gap = F.col("ret") - F.col("p")
    return f.groupBy("symbol").agg(snap(F.var_pop("p") / (F.var_pop(gap) + 1e-12), 4).alias("snr"), snap(F.corr("ret", "p")).alias("autocorr"), snap(F.sqrt(F.avg(gap * gap))).alias("distance"))


@register("status_blocks", RETURNS + """, st as (select symbol, day, case when coalesce(ret, 0) < -0.2 then 'CRITICAL' when coalesce(ret, 0) < 0 then 'WARNING' else 'HEALTHY' end as status from r),
c as (select *, coalesce(lag(status) over (partition by symbol order by day) <> status, true) as changed from st) select symbol, day, status, lead(day) over (partition by symbol order by day) as until from c where changed""")
def status_blocks(spark: SparkSession, sf: str) -> DataFrame:
    x = F.coalesce("ret", F.lit(0.0))
    w = ordered(KEYS, DAY)
    st = returns(spark, sf).withColumn("status", F.when(x < -0.2, "CRITICAL").when(x < 0, "WARNING").otherwise("HEALTHY"))
    st = st.withColumn("changed", F.coalesce(F.lag("status").over(w) != F.col("status"), F.lit(True))).where("changed")
    return st.select("symbol", "day", "status", F.lead("day").over(w).alias("until"))


@register("pnl_histogram", with_views("trades") + ", b as (select strategy, cast(floor(pnl_pct * 100) as bigint) as bin from trades) select strategy, bin, count(*) as n from b group by 1, 2")
def pnl_histogram(spark: SparkSession, sf: str) -> DataFrame:
    b = views.trades(spark, sf).select("strategy", F.floor(F.col("pnl_pct") * 100).cast("long").alias("bin"))
    return b.groupBy("strategy", "bin").agg(F.count("*").alias("n"))


@register("signal_funnel", with_views("trades") + """ select strategy, count(*) as entered, count(*) filter (where exit_reason <> 'time_stop') as decided, count(*) filter (where exit_reason = 'tp') as took_profit,
  count(*) filter (where pnl_pct > 0) as won from trades group by 1""")
def signal_funnel(spark: SparkSession, sf: str) -> DataFrame:
    t, why = views.trades(spark, sf), F.col("exit_reason")
    return t.groupBy("strategy").agg(F.count("*").alias("entered"), F.count_if(why != "time_stop").alias("decided"), F.count_if(why == "tp").alias("took_profit"), F.count_if(F.col("pnl_pct") > 0).alias("won"))


@register("warm_up_trim", FLOW + ", v as (select symbol, day, row_number() over (partition by symbol order by day) > 20 as valid from f), b as (select symbol, min(day) filter (where valid) as first_valid from v group by 1) select v.symbol, count(*) filter (where v.day >= first_valid) as kept, count(*) filter (where v.day > first_valid and not valid) as holes, any_value(first_valid) as first_valid from v join b on v.symbol = b.symbol group by 1")
def warm_up_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Rows from the first valid one on, and holes after it, of which there must be none."""
    v = net_flow(spark, sf).select("symbol", "day", (F.row_number().over(ordered(KEYS, DAY)) > 20).alias("valid"))
    v = v.withColumn("first_valid", F.min(F.when(F.col("valid"), F.col("day"))).over(frame(KEYS, DAY, None, None)))
    return v.groupBy("symbol", "first_valid").agg(F.count_if(F.col("day") >= F.col("first_valid")).alias("kept"), F.count_if((F.col("day") > F.col("first_valid")) & ~F.col("valid")).alias("holes"))


@register("trailing_embedding", f"""with p as (select label, vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings)
select label, vec_id, cast(i as integer) as dim, {s('avg(cast(v as double)) over (partition by label, i order by vec_id rows between 4 preceding and current row)')} as mean from p""")
def trailing_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing means of an embedding over 5 vectors, dimension by dimension."""
    e = views.load(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "v"))
    e = e.withColumn("dim", F.col("at") + 1)
    return e.select("label", "vec_id", "dim", snap(F.avg("v").over(frame(["label", "dim"], ["vec_id"], -4, 0))).alias("mean"))


WINDOWS = (1, 5, 20)
MEANS = ", ".join(s(f"avg(cast(v as double)) over (partition by label, i order by vec_id rows between {n - 1} preceding and current row)") + f" as mean_{n}" for n in WINDOWS)


@register("trailing_embedding_windows", f"""with p as (select label, vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings)
select label, vec_id, cast(i as integer) as dim, {MEANS} from p""")
def trailing_embedding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing means of all dimensions of an embedding over 1, 5 and 20 vectors."""
    e = views.load(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "v"))
    e = e.withColumn("dim", F.col("at") + 1)
    over = {f"mean_{n}": F.avg("v").over(frame(["label", "dim"], ["vec_id"], 1 - n, 0)) for n in WINDOWS}
    return snapped(e.select("label", "vec_id", "dim", *(m.alias(k) for k, m in over.items())), "label", "vec_id", "dim", **{k: k for k in over})
