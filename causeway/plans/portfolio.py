"""Registered queries over option chains, calendars, books, joins in time and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, ordered, snap
from causeway.operators import asof, bars, book, events, portfolio, resampling, rolling, signals
from causeway.plans.market import BAR_C, DAY, EXT, RESET_BARS, RETURNS, returns, rows, snapped, with_index
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, sql_snap as s, with_views

EV = with_views("tape_ev")


@register("asof_backward", EV + f""", l as (select symbol, ts, seq from tape_ev where side = 'N'), r as (select symbol, ts, price from tape_ev where side = 'A')
select l.symbol, l.seq, {s('r.price')} as price, cast((epoch_us(l.ts) - epoch_us(r.ts)) as bigint) as stale_us from l asof left join r on l.symbol = r.symbol and l.ts >= r.ts""")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape_ev(spark, sf)
    got = asof.as_of(t.where("side = 'N'").select("symbol", "ts", "seq", "us"), {"hit": (t.where("side = 'A'"), ["price", "us"])}, KEYS, "ts")
    return got.select("symbol", "seq", snap(F.col("hit.price")).alias("price"), (F.col("us") - F.col("hit.us")).alias("stale_us"))


@register("asof_multi", EV + f""", l as (select * from tape_ev where side = 'N'),
a as (select l.symbol, l.ts, l.seq, r.price as buy from l asof left join (select * from tape_ev where side = 'A') r on l.symbol = r.symbol and l.ts >= r.ts),
b as (select a.*, r.price as sell from a asof left join (select * from tape_ev where side = 'B') r on a.symbol = r.symbol and a.ts >= r.ts)
select symbol, seq, {s('buy')} as buy, {s('sell')} as sell, buy is not null and sell is not null as valid from b""")
def asof_multi(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape_ev(spark, sf)
    sides = {n: (t.where(F.col("side") == k).where(asof.finite("price")), ["price"]) for n, k in (("buy", "A"), ("sell", "B"))}
    got = asof.as_of(t.where("side = 'N'").select("symbol", "ts", "seq"), sides, KEYS, "ts")
    return got.select("symbol", "seq", snap(F.col("buy.price")).alias("buy"), snap(F.col("sell.price")).alias("sell"), (F.col("buy").isNotNull() & F.col("sell").isNotNull()).alias("valid"))


@register("asof_forward", EV + f""", l as (select symbol, ts, seq from tape_ev where side = 'N'), r as (select symbol, ts, price from tape_ev where side = 'B')
select l.symbol, l.seq, {s('r.price')} as price from l asof left join r on l.symbol = r.symbol and l.ts <= r.ts""")
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape_ev(spark, sf)
    got = asof.as_of(t.where("side = 'N'").select("symbol", "ts", "seq"), {"hit": (t.where("side = 'B'"), ["price"])}, KEYS, "ts", forward=True)
    return got.select("symbol", "seq", snap(F.col("hit.price")).alias("price"))


def indexed_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The index on the symbols' keys, so that daily joins run by symbol."""
    return views.tape(spark, sf).select("symbol").distinct().crossJoin(F.broadcast(views.ext_daily(spark, sf)))


@register("asof_strict_prior", with_views("daily", "ext_daily") + f"""
select d.symbol, d.day, {s('e.vix', 4)} as vix from (select *, day - 1 as before from daily) d asof left join ext_daily e on d.before >= e.day""")
def asof_strict_prior(spark: SparkSession, sf: str) -> DataFrame:
    got = asof.strictly_before(views.daily(spark, sf), indexed_daily(spark, sf), ["vix"], KEYS, "day")
    return got.select("symbol", "day", snap(F.col("hit.vix"), 4).alias("vix"))


@register("reindex_daily", with_views("daily", "ext_daily") + f""", j as (select d.symbol, d.day, e.vix from daily d asof left join ext_daily e on d.day >= e.day)
select symbol, day, {s('coalesce(vix, first_value(vix ignore nulls) over (partition by symbol order by day rows between current row and unbounded following))', 4)} as vix from j""")
def reindex_daily(spark: SparkSession, sf: str) -> DataFrame:
    got = asof.reindex(indexed_daily(spark, sf), views.daily(spark, sf).select("symbol", "day"), ["vix"], KEYS, "day", back_fill=True)
    return got.select("symbol", "day", snap(F.col("vix"), 4).alias("vix"))


@register("ahead_return", with_views("daily") + f"""
select symbol, day, {s("ln(coalesce(first_value(close) over (partition by symbol order by day range between interval 5 day following and unbounded following), last_value(close) over (partition by symbol order by day rows between unbounded preceding and unbounded following))) - ln(close)")} as ahead from daily""")
def ahead_return(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(asof.ahead_return(views.daily(spark, sf), KEYS, "day", "close", 5), "symbol", "day", ahead="ahead")


NEAR = with_views("daily", "calendar") + """, days as (select distinct day from daily), k as (select unnest(['FOMC', 'CPI', 'NFP', 'OpEx']) as event_type),
d as (select day, k.event_type, arg_min({'d': event_day - day, 'm': magnitude}, (abs(event_day - day), event_day)) as e
  from days cross join k join calendar c on c.event_type = k.event_type group by day, k.event_type)"""


@register("nearest_event", NEAR + " select day, event_type, cast(e.d as integer) as signed_days from d")
def nearest_event(spark: SparkSession, sf: str) -> DataFrame:
    days = views.daily(spark, sf).select("day").distinct().select("day", F.explode(F.array(*map(F.lit, ("FOMC", "CPI", "NFP", "OpEx")))).alias("event_type"))
    right = views.calendar(spark, sf).select(F.col("event_day").alias("day"), "event_type", "magnitude")
    return asof.nearest(days, right, ["magnitude"], ["event_type"], "day").where("signed_days is not null").select("day", "event_type", "signed_days")


@register("event_proximity", NEAR + ", p as (select day, " + ", ".join(
    f"coalesce(max(exp(-abs(e.d) / 5.0::double)) filter (where event_type = '{k}'), 0.0::double) as {k.lower()}_near, coalesce(max(exp(-abs(e.d) / 5.0::double) * e.m) filter (where event_type = '{k}'), 0.0::double) as {k.lower()}_weight" for k in ("FOMC", "CPI", "NFP", "OpEx"))
    + " from d group by day) select day, " + ", ".join(f"{s(f'{k}_{x}')} as {k}_{x}" for k in ("fomc", "cpi", "nfp", "opex") for x in ("near", "weight")) + " from p")
def event_proximity(spark: SparkSession, sf: str) -> DataFrame:
    types = ["FOMC", "CPI", "NFP", "OpEx"]
    got = events.proximity(views.daily(spark, sf).select("day").distinct(), views.calendar(spark, sf), types)
    return got.select("day", *(snap(F.col(f"{k}_{x}")).alias(f"{k.lower()}_{x}") for k in types for x in ("near", "weight")))


@register("calendar_features", with_views("daily") + f""", days as (select distinct day, cast(date_trunc('month', day) as date) as m from daily),
f as (select *, m + cast((12 - isodow(m)) % 7 as integer) + 14 as friday3 from days)
select day, {s('sin((isodow(day) - 1) * (2 * pi() / 5))')} as dow_sin, {s('cos((month(day) - 1) * (2 * pi() / 12))')} as month_cos, {s('exp(-abs(friday3 - day) / 3.0::double)')} as near_expiry,
  case when isodow(day) = 1 then 1.0::double else 0.0::double end as monday, case when isodow(day) = 5 then 1.0::double else 0.0::double end as friday,
  case when day = cast(date_trunc('quarter', day) as date) then 1.0::double else 0.0::double end as quarter_start from f""")
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    got = events.date_features(views.daily(spark, sf).select("day").distinct())
    return got.select("day", *(snap(F.col(c)).alias(c) for c in ("dow_sin", "month_cos", "near_expiry")), "monday", "friday", "quarter_start")


CHAIN = with_views("chain") + ", c as (select *, lower(trim(type)) as kind from chain)"


def chain(spark: SparkSession, sf: str) -> DataFrame:
    return views.chain(spark, sf).withColumn("kind", F.lower(F.trim("type")))


@register("gamma_exposure", CHAIN + f""", g as (select symbol, day, sum(gamma * open_interest * case kind when 'call' then 1.0 else -1.0 end) as gex,
  sum(case kind when 'call' then open_interest else 0.0 end) as call_oi, sum(case kind when 'put' then open_interest else 0.0 end) as put_oi from c group by 1, 2)
select symbol, day, {s('gex', 4)} as gex, {s('call_oi')} as call_oi, {s('put_oi')} as put_oi, {s('put_oi / greatest(call_oi, 1e-8)', 2)} as pc_ratio from g""")
def gamma_exposure(spark: SparkSession, sf: str) -> DataFrame:
    c, call = chain(spark, sf), F.col("kind") == "call"
    g = c.groupBy("symbol", "day").agg(
        F.sum(F.col("gamma") * F.col("open_interest") * F.when(call, 1.0).otherwise(-1.0)).alias("gex"),
        F.sum(F.when(call, F.col("open_interest")).otherwise(0.0)).alias("call_oi"), F.sum(F.when(call, 0.0).otherwise(F.col("open_interest"))).alias("put_oi"),
    )
    return g.select("symbol", "day", snap(F.col("gex"), 4).alias("gex"), snap(F.col("call_oi")).alias("call_oi"), snap(F.col("put_oi")).alias("put_oi"), snap(F.col("put_oi") / F.greatest("call_oi", F.lit(1e-8)), 2).alias("pc_ratio"))


FLOW = CHAIN + """, f as (select symbol, day, sum(vanna * open_interest * case kind when 'call' then 1.0 else -1.0 end) as net_vanna,
  sum(charm * open_interest * case kind when 'call' then 1.0 else -1.0 end) as net_charm from c group by 1, 2)"""


def net_flow(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("kind") == "call", 1.0).otherwise(-1.0)
    return chain(spark, sf).groupBy("symbol", "day").agg(
        F.sum(F.col("vanna") * F.col("open_interest") * sign).alias("net_vanna"), F.sum(F.col("charm") * F.col("open_interest") * sign).alias("net_charm")
    )


@register("net_vanna_charm", FLOW + f" select symbol, day, {s('net_vanna', 4)} as net_vanna, {s('net_charm', 4)} as net_charm from f")
def net_vanna_charm(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(net_flow(spark, sf), "symbol", "day", digits=4, net_vanna="net_vanna", net_charm="net_charm")


@register("flow_features", FLOW + f""", d as (select *, coalesce(net_vanna - lag(net_vanna) over (partition by symbol order by day), 0.0::double) as dv from f),
x as (select *, floor(net_vanna * 1e4 + 0.5) / 1e4 as v4 from d)
select symbol, day, {s('dv', 4)} as d_vanna, {s(f'(net_vanna - avg(net_vanna) over {rows(-49, 0)}) / (stddev_pop(net_vanna) over {rows(-49, 0)} + 1e-8)', 4)} as z_vanna from x""")
def flow_features(spark: SparkSession, sf: str) -> DataFrame:
    f = net_flow(spark, sf).withColumn("dv", rolling.diff("net_vanna", KEYS, DAY)).withColumn("z", rolling.rolling_z("net_vanna", KEYS, DAY, 50))
    return snapped(f, "symbol", "day", digits=4, d_vanna="dv", z_vanna="z")


@register("put_call_pivot", CHAIN + f""", p as (select day, count(*) filter (where kind = 'call') as calls, count(*) filter (where kind = 'put') as puts from c group by day)
select day, calls, puts, {s('puts / nullif(calls, 0)')} as ratio from p""")
def put_call_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = chain(spark, sf).groupBy("day").pivot("kind", ["call", "put"]).count().select("day", *(F.coalesce(k, F.lit(0)).alias(f"{k}s") for k in ("call", "put")))
    return p.select("day", "calls", "puts", snap(F.try_divide(F.col("puts").cast("double"), F.nullif("calls", F.lit(0)))).alias("ratio"))


@register("open_interest_change", with_views("chain") + f""", o as (select symbol, day, sum(open_interest) as oi from chain where stat_type = 6 group by 1, 2),
d as (select *, lag(oi) over (partition by symbol order by day) as was from o) select symbol, day, {s('oi')} as oi, {s('(oi - was) / (was + 1e-8)')} as change from d""")
def open_interest_change(spark: SparkSession, sf: str) -> DataFrame:
    o = views.chain(spark, sf).where("stat_type = 6").groupBy("symbol", "day").agg(F.sum("open_interest").alias("oi"))
    was = F.lag("oi").over(ordered(KEYS, DAY))
    return snapped(o.withColumn("change", (F.col("oi") - was) / (was + 1e-8)), "symbol", "day", oi="oi", change="change")


TOT = "list_sum({})"


@register("book_features", with_views("book") + f""", f as (select *, (bid_prices[1] + ask_prices[1]) / 2 as mid, list_sum(bid_sizes) as b, list_sum(ask_sizes) as a from book)
select symbol, seq, {s('mid')} as mid, {s('ask_prices[1] - bid_prices[1]')} as spread, {s('(b - a) / (b + a)')} as imbalance, {s('bid_sizes[1] / (b + a)')} as top_share,
  {s('(ask_prices[5] - mid) / mid * 1e4', 3)} as deep_bps, {s('(bid_sizes[3] - ask_sizes[3]) / (bid_sizes[3] + ask_sizes[3])')} as depth3 from f""")
def book_features(spark: SparkSession, sf: str) -> DataFrame:
    f = book.book_features(views.book(spark, sf))
    return f.select(
        "symbol", "seq", snap(F.col("mid")).alias("mid"), snap(F.col("spread")).alias("spread"), snap(F.col("imbalance")).alias("imbalance"),
        snap(F.element_at("profile", 1)).alias("top_share"), snap(F.element_at("shape", 10), 3).alias("deep_bps"), snap(F.element_at("depth", 3)).alias("depth3"),
    )


@register("mean_embedding", f"""with p as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings)
select label, cast(i as integer) as dim, {s('avg(cast(v as double))')} as mean, count(*) as n from p group by label, i""")
def mean_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = views.load(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "v"))
    return e.groupBy("label", (F.col("at") + 1).alias("dim")).agg(snap(F.avg("v")).alias("mean"), F.count("*").alias("n"))


TR = with_views("trades", "regimes")
NAMED = TR + ", t as (select trades.*, coalesce(r.vol_regime, 'unknown') as vol_regime from trades left join regimes r on trades.signal_id = r.signal_id)"


def named_trades(spark: SparkSession, sf: str) -> DataFrame:
    return asof.regime_of(views.trades(spark, sf), views.regimes(spark, sf))


@register("pnl_by_regime", NAMED + f""" select vol_regime, strategy, cast(grouping_id(vol_regime, strategy) as integer) as gid, count(*) as n, {s('sum(pnl_pct)')} as total, {s('avg(pnl_pct)')} as mean,
  {s('avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end)')} as win_rate, {s('avg(risk)')} as mean_risk, {s('min(pnl_pct)')} as worst, {s('max(pnl_pct)')} as best from t group by rollup(vol_regime, strategy)""")
def pnl_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    a = portfolio.attribution(named_trades(spark, sf))
    return a.select("vol_regime", "strategy", "gid", "n", snap(F.col("total")).alias("total"), *(snap(F.col(c)).alias(c) for c in ("mean", "win_rate", "mean_risk", "worst", "best")))


@register("regime_join_fallback", NAMED + " select vol_regime, exit_reason, count(*) as n from t group by 1, 2")
def regime_join_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return named_trades(spark, sf).groupBy("vol_regime", "exit_reason").agg(F.count("*").alias("n"))


@register("regime_methods", with_views("regimes") + f", c as (select regime_method, count(*) as n from regimes group by 1) select regime_method, n, {s('n / sum(n) over ()')} as share from c")
def regime_methods(spark: SparkSession, sf: str) -> DataFrame:
    c = views.regimes(spark, sf).groupBy("regime_method").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select("regime_method", "n", snap(F.col("n") / F.col("all")).alias("share"))


@register("exit_quartiles", with_views("trades") + f" select exit_reason, {s('quantile_cont(pnl_pct, 0.25)')} as q1, {s('quantile_cont(pnl_pct, 0.5)')} as q2, {s('quantile_cont(pnl_pct, 0.75)')} as q3 from trades group by 1")
def exit_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    q = views.trades(spark, sf).groupBy("exit_reason").agg(F.percentile("pnl_pct", [0.25, 0.5, 0.75]).alias("q"))
    return q.select("exit_reason", *(snap(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)))


@register("loss_streak", with_views("trades") + """, n as (select strategy, pnl_pct, row_number() over (partition by strategy order by exit_day desc, signal_id desc) as nth from trades)
select strategy, cast(coalesce(min(nth) filter (where pnl_pct > 0), count(*) + 1) - 1 as bigint) as streak from n group by 1""")
def loss_streak(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.loss_streak(views.trades(spark, sf), ["strategy"], ["exit_day", "signal_id"], "pnl_pct")


@register("scorecard", with_views("trades") + f""", w as (select *, avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end) over (partition by strategy order by exit_day, signal_id rows between 19 preceding and current row) as wr from trades),
n as (select *, row_number() over (partition by strategy order by exit_day desc, signal_id desc) as nth from w),
sp as (select strategy, count(*) as n_trades, case when max(exit_day) > min(exit_day) then count(*) / ((max(exit_day) - min(exit_day)) / 365.25::double) else 48.0::double end as per_year,
  coalesce(min(nth) filter (where pnl_pct > 0), count(*) + 1) - 1 as streak from n group by 1),
l as (select strategy, avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end) as win_rate, sum(greatest(pnl_pct, 0.0)) / nullif(-sum(least(pnl_pct, 0.0)), 0) as profit_factor,
  avg(pnl_pct) as mean, stddev_samp(pnl_pct) as sd, sqrt(avg(pow(least(pnl_pct, 0.0), 2))) as down, case when count(*) filter (where nth <= 4) = 4 then max(wr) filter (where nth <= 4) end as last4,
  -regr_slope(case when pnl_pct > 0 then 1.0::double else 0.0::double end, nth) as trend from n where nth <= 20 group by 1),
o as (select *, mean / nullif(sd, 0) * sqrt(per_year) as sharpe, mean / nullif(down, 0) * sqrt(per_year) as sortino from sp join l using (strategy))
select strategy, n_trades, cast(streak as bigint) as streak, {s('win_rate')} as win_rate, {s('profit_factor')} as profit_factor, {s('sharpe', 4)} as sharpe, {s('sortino', 4)} as sortino, {s('trend')} as trend,
  case when streak >= 5 or last4 < 0.5 then 'CRITICAL' when sharpe < 0.5 or trend < 0 then 'WARNING' else 'HEALTHY' end as status from o""")
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    c = portfolio.scorecard(views.trades(spark, sf))
    return c.select("strategy", "n_trades", "streak", snap(F.col("win_rate")).alias("win_rate"), snap(F.col("profit_factor")).alias("profit_factor"), snap(F.col("sharpe"), 4).alias("sharpe"), snap(F.col("sortino"), 4).alias("sortino"), snap(F.col("trend")).alias("trend"), "status")


@register("rolling_win_rate", with_views("trades") + f" select strategy, signal_id, {s('avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end) over (partition by strategy order by exit_day, signal_id rows between 19 preceding and current row)')} as win_rate from trades")
def rolling_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trades(spark, sf).withColumn("won", (F.col("pnl_pct") > 0).cast("double"))
    return t.select("strategy", "signal_id", snap(F.avg("won").over(frame(["strategy"], ["exit_day", "signal_id"], -19, 0))).alias("win_rate"))


@register("inverse_vol_weights", RETURNS + f", v as (select symbol, 1.0 / stddev_samp(ret) as inv from r group by 1) select symbol, {s('inv / sum(inv) over ()')} as weight from v")
def inverse_vol_weights(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(portfolio.inverse_vol_weights(returns(spark, sf).where("ret is not null"), "symbol", "ret"), "symbol", weight="weight")


@register("kelly_sizes", NAMED + f""", g as (select vol_regime, avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end) as w, avg(pnl_pct) filter (where pnl_pct > 0) / -avg(pnl_pct) filter (where pnl_pct < 0) as b from t group by 1)
select vol_regime, {s('greatest(0.0::double, 0.5 * (b * w - (1 - w)) / b)')} as kelly, case vol_regime when 'low' then 1.0::double when 'normal' then 0.75::double when 'high' then 0.5::double else 0.75::double end as scale from g""")
def kelly_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pnl_pct")
    g = named_trades(spark, sf).groupBy("vol_regime").agg(F.avg((p > 0).cast("double")).alias("w"), (F.avg(F.when(p > 0, p)) / -F.avg(F.when(p < 0, p))).alias("b"))
    return g.select("vol_regime", snap(portfolio.kelly(F.col("w"), F.col("b"))).alias("kelly"), portfolio.regime_scale(F.col("vol_regime")).alias("scale"))


def stress_sql(scenarios) -> str:
    """The same draws and equities as ``portfolio.stress``."""
    values = ", ".join(f"('{n}', {v}::double, {c}::double, {k}::double, {m}, '{r}')" for n, v, c, k, m, r in scenarios)
    u = lambda what: f"cast(('0x' || substr(md5(concat_ws(':', '{what}', scenario, coalesce(strategy, ''), step)), 1, 8))::bigint as double) / 4294967296"
    return with_views("trades") + f""", z as (select * from (values {values}) v(scenario, vol, cut, shock, n_trades, regime)),
r as (select strategy, avg(case when pnl_pct > 0 then 1.0::double else 0.0::double end) as rate, count(*) filter (where pnl_pct > 0) as wins, count(*) filter (where pnl_pct <= 0) as losses from trades group by 1),
d as (select *, unnest(range(1, n_trades + 1)) as step from r cross join z),
w as (select *, {u('side')} < greatest(0.05::double, rate - cut) and wins > 0 as won from d),
p as (select *, cast(floor({u('trade')} * case when won then wins else losses end) as bigint) + 1 as place from w),
o as (select strategy, pnl_pct > 0 as won, row_number() over (partition by strategy, pnl_pct > 0 order by exit_day, signal_id) as place, pnl_pct from trades where pnl_pct is not null),
g as (select scenario, p.strategy, step, n_trades, shock, case regime when 'high' then 0.5::double when 'normal' then 0.75::double when 'low' then 1.0::double else 0.75::double end * 0.01 as stake,
  greatest(-1.0::double, least(5.0::double, case when p.won then pnl_pct / vol else coalesce(pnl_pct, -0.3::double) * vol end)) as pnl
  from p left join o on p.strategy is not distinct from o.strategy and p.won = o.won and p.place = o.place),
e as (select scenario, strategy, step, n_trades, pnl, {s('(1 + shock) * exp(sum(ln(1 + stake * pnl)) over (partition by scenario, strategy order by step))', 9)} as equity from g
  union all select scenario, strategy, 0, n_trades, null, {s('1 + shock', 9)} from r cross join z),
h as (select *, {s('equity / greatest(1.0::double, max(equity) over (partition by scenario, strategy order by step)) - 1', 9)} as depth from e),
l as (select *, arg_min(step, (depth, step)) over (partition by scenario, strategy) as low, equity / coalesce(lag(equity) over (partition by scenario, strategy order by step), 1.0::double) - 1 as ret from h)
select scenario, strategy, max(n_trades) as n_trades, {s('max_by(equity, step) - 1')} as total, {s('min(depth)')} as max_drawdown, min(depth) > -0.5 as survived, {s('min(pnl)')} as worst,
  cast(coalesce(min(step - low) filter (where step >= low and equity >= 1), -1) as integer) as recovery,
  {s('min(ret)')} as worst_day, {s('case when stddev_pop(ret) > 1e-12 then avg(ret) / stddev_pop(ret) * sqrt(252.0::double) else 0.0::double end', 4)} as sharpe from l group by 1, 2"""


@register("stress", stress_sql(portfolio.SCENARIOS))
def stress(spark: SparkSession, sf: str) -> DataFrame:
    x = portfolio.stress(views.trades(spark, sf)).withColumn("sharpe", snap(F.col("sharpe"), 4))
    return snapped(x, "scenario", "strategy", "n_trades", "survived", "recovery", "sharpe", total="total", max_drawdown="max_drawdown", worst="worst", worst_day="worst_day")


@register("stress_before_release", stress_sql(portfolio.RELEASE_SCENARIOS))
def stress_before_release(spark: SparkSession, sf: str) -> DataFrame:
    x = portfolio.stress(views.trades(spark, sf), portfolio.RELEASE_SCENARIOS).withColumn("sharpe", snap(F.col("sharpe"), 4))
    return snapped(x, "scenario", "strategy", "n_trades", "survived", "recovery", "sharpe", total="total", max_drawdown="max_drawdown", worst="worst", worst_day="worst_day")


@register("alpha_beta", EXT + f""", g as (select symbol, cast(date_trunc('week', day) as date) as week, max_by(close, day) as c, max_by(index_close, day) filter (where index_close is not null) as i from j group by 1, 2),
r as (select symbol, c / lag(c) over (partition by symbol order by week) - 1 as x, i / lag(i) over (partition by symbol order by week) - 1 as y from g),
f as (select symbol, count(*) as weeks, regr_slope(x, y) as beta, avg(x) as ms, avg(y) as mb, avg(x - y) as active, stddev_samp(x - y) as track from r where x is not null and y is not null group by 1 having count(*) >= 13)
select symbol, weeks, {s('beta')} as beta, {s('(ms - beta * mb) * 52')} as alpha, {s('active / track * sqrt(52.0::double)')} as info_ratio from f""")
def alpha_beta(spark: SparkSession, sf: str) -> DataFrame:
    j = with_index(spark, sf)
    g = j.groupBy("symbol", F.trunc("day", "week").alias("week")).agg(F.max_by("close", "day").alias("c"), F.max_by("index_close", F.when(F.col("index_close").isNotNull(), F.col("day"))).alias("i"))
    w = ordered(KEYS, ["week"])
    r = g.select("symbol", (F.col("c") / F.lag("c").over(w) - 1).alias("x"), (F.col("i") / F.lag("i").over(w) - 1).alias("y"))
    return snapped(portfolio.alpha_stats(r, KEYS, "x", "y"), "symbol", "weeks", beta="beta", alpha="alpha", info_ratio="info_ratio")


@register("quintiles", RETURNS + f""", l as (select symbol, day, ret, lag(ret) over (partition by symbol order by day) as score from r),
n as (select *, row_number() over (partition by symbol order by score, day) - 1 as k, count(*) over (partition by symbol) // 5 as size from l where score is not null and ret is not null)
select symbol, cast(k // size as integer) as quintile, count(*) as n, {s('avg(score)')} as mean_score, {s('avg(ret)')} as mean_ret, {s('avg(case when ret > 0 then 1.0::double else 0.0::double end)')} as hit_rate from n where k // size < 5 group by 1, 2""")
def quintiles(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).withColumn("score", F.lag("ret").over(ordered(KEYS, DAY))).where("score is not null and ret is not null")
    n = r.withColumn("k", F.row_number().over(ordered(KEYS, ["score", "day"])) - 1).withColumn("size", F.floor(F.count("*").over(frame(KEYS, DAY, None, None)) / 5))
    q = n.withColumn("quintile", F.floor(F.col("k") / F.col("size")).cast("int")).where("quintile < 5")
    return q.groupBy("symbol", "quintile").agg(F.count("*").alias("n"), snap(F.avg("score")).alias("mean_score"), snap(F.avg("ret")).alias("mean_ret"), snap(F.avg((F.col("ret") > 0).cast("double"))).alias("hit_rate"))


@register("daily_pnl", RETURNS + f""", p as (select symbol, day, close, coalesce(sign(lag(ret) over (partition by symbol order by day)), 0.0::double) as pos, coalesce(sign(ret), 0) as nxt from r),
g as (select *, pos * ln(lead(close) over (partition by symbol order by day) / close) as gross, abs(lead(pos) over (partition by symbol order by day) - pos) as change from p)
select symbol, day, {s('gross')} as gross, {s('gross - 0.00015 * change')} as net from g where gross is not null""")
def daily_pnl(spark: SparkSession, sf: str) -> DataFrame:
    p = returns(spark, sf).withColumn("pos", F.coalesce(F.signum(F.lag("ret").over(ordered(KEYS, DAY))), F.lit(0.0)))
    return snapped(signals.daily_pnl(p, KEYS, "day", "pos", "close"), "symbol", "day", gross="gross", net="net")


@register("headline_metrics", RETURNS + f""", p as (select symbol, day, close, coalesce(sign(lag(ret) over (partition by symbol order by day)), 0.0::double) as pos from r),
g as (select *, pos * ln(lead(close) over (partition by symbol order by day) / close) as gross, abs(lead(pos) over (partition by symbol order by day) - pos) as change from p),
n as (select *, gross - 0.00015 * change as net, lag(pos) over (partition by symbol order by day) as was from g where gross is not null),
c as (select *, sum(net) over {rows(-1, 0).replace('rows between 1 preceding and current row', 'rows unbounded preceding')} as cum from n),
d as (select *, cum - greatest(0.0::double, max(cum) over (partition by symbol order by day rows unbounded preceding)) as dd from c)
select symbol, {s('avg(net) / (stddev_pop(net) + 1e-8) * sqrt(252.0::double)', 4)} as sharpe, {s('avg(net) / sqrt(avg(pow(least(net, 0.0), 2))) * sqrt(252.0::double)', 4)} as sortino,
  {s('avg(case when net > 0 then 1.0::double else 0.0::double end) filter (where pos <> 0)')} as hit_rate, {s('min(dd)')} as max_drawdown,
  count(*) filter (where pos <> 0 and coalesce(was, 0) = 0) as n_trades, count(*) filter (where pos <> 0) as active_days from d group by symbol""")
def headline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = returns(spark, sf).withColumn("pos", F.coalesce(F.signum(F.lag("ret").over(ordered(KEYS, DAY))), F.lit(0.0)))
    h = signals.headline(signals.daily_pnl(p, KEYS, "day", "pos", "close"), KEYS, "net", "pos", "day")
    return h.select("symbol", snap(F.col("sharpe"), 4).alias("sharpe"), snap(F.col("sortino"), 4).alias("sortino"), snap(F.col("hit_rate")).alias("hit_rate"), snap(F.col("max_drawdown")).alias("max_drawdown"), "n_trades", "active_days")


@register("exit_simulator", with_views("trades", "daily") + f""", t as (select signal_id, 'S' || cast(signal_id % 8 as varchar) as symbol, entry_day from trades),
p as (select symbol, day, close, row_number() over (partition by symbol order by day) as rn from daily),
e as (select t.signal_id, t.symbol, p.rn, p.close as entry from t asof join p on t.symbol = p.symbol and t.entry_day <= p.day),
m as (select e.signal_id, p.day, p.rn - e.rn as step, p.close / e.entry - 1 as move from e join p on p.symbol = e.symbol and p.rn between e.rn and e.rn + 14),
w as (select *, case when step = 0 then null when move >= 0.1 then 'tp' when move <= -0.05 then 'sl' when step = 14 then 'time_stop' end as why from m),
g as (select signal_id, arg_min({{'day': day, 'move': move, 'why': why}}, step) filter (where why is not null) as hit, arg_max({{'day': day, 'move': move}}, step) as last from w group by 1)
select t.signal_id, coalesce(hit.day, last.day) as exit_day, {s('coalesce(hit.move, last.move)')} as move, case when last is null then 'no_data' else coalesce(hit.why, 'end_of_data') end as why from t left join g on t.signal_id = g.signal_id""")
def exit_simulator(spark: SparkSession, sf: str) -> DataFrame:
    t = views.trades(spark, sf).withColumn("symbol", F.concat(F.lit("S"), (F.col("signal_id") % 8).cast("string")))
    return snapped(portfolio.exits(t, views.daily(spark, sf).select("symbol", "day", "close"), 0.1, 0.05, 14), "signal_id", "exit_day", "why", move="move")


@register("bootstrap")
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of each of 1,000 resampled paths of a strategy, and (sim 0) of the one observed."""
    return resampling.bootstrap(views.trades(spark, sf), ["strategy"], ["exit_day", "signal_id"], "pnl_pct", 1000)


def kalman_sql(source: str, x: str) -> str:
    """q, k and z: the adaptive filter f of ``x`` over ``source`` (symbol, day), and its score against the 100 rows before."""
    return f"""
q as materialized (select symbol, day, {x} as x, row_number() over (partition by symbol order by day) as n,
  greatest(0.1 * var_pop({x}) over (partition by symbol order by day rows unbounded preceding), 1e-12) as q from {source}),
k as (select symbol, n, x as f, cast((1.0 - (1.0 + q) / (1.0 + q + 1e-12)) * (1.0 + q) as double) as p, [0.0::double] as seen from q where n = 1 union all
  select symbol, n, f + gain * (x - f), (1 - gain) * p, seen from (
    select symbol, n, x, f, p, seen, p / (p + list_aggregate(seen, 'var_pop') + 1e-12) as gain from (
      select q.symbol, q.n, q.x, k.f, k.p + q.q as p, list_append(case when len(k.seen) = 50 then k.seen[2:] else k.seen end, q.x - k.f) as seen from k join q on q.symbol = k.symbol and q.n = k.n + 1))),
z as materialized (select k.symbol, q.day, k.n, x, k.f, {s(f"case when count(k.f) over w = 100 then case when stddev_pop(k.f) over w > 1e-12 then (k.f - avg(k.f) over w) / stddev_pop(k.f) over w else 0.0::double end end")} as score
  from k join q on k.symbol = q.symbol and k.n = q.n window w as (partition by k.symbol order by k.n rows between 100 preceding and 1 preceding))"""


KALMAN = RETURNS.replace("with ", "with recursive ", 1) + "," + kalman_sql("r", "coalesce(ret, 0.0::double)")
HELD = "case when score is null then was when was <> 0 and abs(score) < 0.5 then 0.0::double when was = 0 or {w} * was < 0 then {w} else was end".format(
    w="(case when abs(score) > 2 then -sign(score) * least(abs(score) / 2, 1.0::double) else 0.0::double end)"
)


@register("kalman_positions", KALMAN + f""",
p as (select symbol, n, cast({HELD} as double) as pos from (select *, 0.0::double as was from z where n = 1) union all
  select symbol, n, cast({HELD} as double) from (select z.*, p.pos as was from p join z on z.symbol = p.symbol and z.n = p.n + 1))
select z.symbol, day, {s('f', 7)} as filtered, score, pos as position from z join p on z.symbol = p.symbol and z.n = p.n""")
def kalman_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered returns, their score, and positions with hysteresis: an ordered fold by symbol, a window, and a scan."""
    r = returns(spark, sf).withColumn("x", F.coalesce("ret", F.lit(0.0))).select("symbol", "day", "close", "x")
    f = signals.kalman(r, "x", KEYS, DAY).withColumn("score", snap(signals.score_of("filtered", KEYS, DAY, 100)))
    got = signals.positions(f, "score", KEYS, DAY, block=F.year("day"))
    return got.select("symbol", "day", snap(F.col("filtered"), 7).alias("filtered"), "score", "position")
