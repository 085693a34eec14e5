"""Registered queries over tapes, bars and daily series, with DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import epoch_seconds, frame, month_number, ordered, signed, snap, third_friday
from causeway.operators import asof, bars, rolling
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, ORDER, sql_snap as s, with_views

BAR_C = 100_000_000  # a bar is worth $1M
DAY = ["day"]


def snapped(df: DataFrame, *keep: str, digits: int = 6, **values) -> DataFrame:
    """Columns to keep, and values put on the decimal grid."""
    return df.select(*keep, *(snap(v if not isinstance(v, str) else F.col(v), digits).alias(k) for k, v in values.items()))


@register("bars_master", with_views("tape") + f""",
c as (select *, sum(notional_c) over (partition by symbol order by ts, seq) as cum, sum(notional_c) over (partition by symbol) as total from tape),
b as (select symbol, seq, ts, price, unnest(range(cast((cum - notional_c) // {BAR_C} + 1 as bigint), cast(least(cum // {BAR_C}, (total - 1) // {BAR_C}) + 1 as bigint))) as bar_id from c)
select symbol, bar_id, seq as close_seq, cast(ts as date) as close_day, {s('price')} as close from b""")
def bars_master(spark: SparkSession, sf: str) -> DataFrame:
    got = bars.master_bars(views.tape(spark, sf), BAR_C)
    return snapped(got.withColumn("close_day", F.to_date("close_ts")), "symbol", "bar_id", "close_seq", "close_day", close="close")


RESET = f"""recursive tape as ({views.SQL['tape']}),
c as materialized (select symbol, seq, sum(notional_c) over (partition by symbol order by ts, seq) as cum from tape),
jump as (
  select symbol, cast(0 as bigint) as bar_id, min(seq) as seq, cast(min(cum) as hugeint) as cum from c where cum >= {BAR_C} group by symbol
  union all
  select j.symbol, j.bar_id + 1, c.seq, c.cum from jump j join c on c.symbol = j.symbol and c.cum >= j.cum + {BAR_C} and c.cum < j.cum + {BAR_C} + 
    (select max(notional_c) from tape)
  qualify row_number() over (partition by j.symbol, j.bar_id order by c.seq) = 1)"""
#: Reset bars in SQL: closes by recursion, then each print's bar.
RESET_BARS = RESET + """,
ends as (select symbol, bar_id, seq as close_seq, coalesce(lag(seq) over (partition by symbol order by bar_id), 0) + 1 as open_seq from jump),
p as (select t.*, bar_id, price >= lag(price) over (partition by t.symbol, bar_id order by seq) as up, price / lag(price) over (partition by t.symbol, bar_id order by seq) as ratio
  from tape t join ends e on t.symbol = e.symbol and t.seq between e.open_seq and e.close_seq),
bar as (select symbol, bar_id, min(seq) as open_seq, max(seq) as close_seq, min_by(price, seq) as open, max(price) as high, min(price) as low,
  max_by(price, seq) as close, sum(size) as volume, count(*) as n_trades, cast(sum(notional_c) as bigint) as value_c, sum(price * size) / sum(size) as vwap,
  coalesce(stddev_pop(ln(ratio)), 0.0::double) as intra_vol, sum(case when coalesce(up, true) then size else 0.0 end) as buy_volume,
  sum(case when coalesce(up, true) then 0.0 else size end) as sell_volume, ln(max_by(price, seq) / min_by(price, seq)) as bar_return from p group by symbol, bar_id)"""


@register("bars_reset", "with " + RESET_BARS + f"""
select symbol, bar_id, open_seq, close_seq, n_trades, value_c, {s('open')} as open, {s('high')} as high, {s('low')} as low, {s('close')} as close,
  {s('volume')} as volume, {s('vwap')} as vwap, {s('intra_vol')} as intra_vol, {s('buy_volume')} as buy_volume, {s('sell_volume')} as sell_volume,
  {s('bar_return')} as bar_return from bar""")
def bars_reset(spark: SparkSession, sf: str) -> DataFrame:
    names = "open high low close volume vwap intra_vol buy_volume sell_volume bar_return".split()
    return snapped(bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")), "symbol", "bar_id", "open_seq", "close_seq", "n_trades", "value_c", **{n: n for n in names})


DEDUPLICATED = RESET_BARS.replace(views.SQL["tape"], f"select * from ({views.SQL['tape']}) qualify row_number() over (partition by symbol, ts order by seq) = 1")


@register("bars_deduplicated", "with " + DEDUPLICATED + f""" select symbol, bar_id, open_seq, close_seq, n_trades, value_c, {s('close')} as close from bar""")
def bars_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Reset bars over the first print of each time."""
    t = bars.one_print_per_time(views.tape(spark, sf))
    return snapped(bars.reset_bars(t, BAR_C, month_number("ts")), "symbol", "bar_id", "open_seq", "close_seq", "n_trades", "value_c", close="close")


@register("bars_count", with_views("tape") + f""",
n as (select *, (row_number() over (partition by symbol order by ts, seq) - 1) // 100 as bar_id from tape)
select symbol, bar_id, {s('max_by(price, seq) - min_by(price, seq)')} as dp, {s("sum(size * case side when 'A' then 1.0 when 'B' then -1.0 else 0.0 end)")} as flow,
  max(seq) as close_seq from n group by symbol, bar_id having count(*) = 100""")
def bars_count(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(bars.count_bars(views.tape(spark, sf), 100), "symbol", "bar_id", "close_seq", dp="dp", flow="flow")


CLOCK = with_views("tape_ev") + """,
a as (select symbol, us, seq, min(us) over (partition by symbol) as t0, max(us) over (partition by symbol) as t1,
  (us - lag(us) over (partition by symbol order by us, seq)) / 1e6 as wait from tape_ev),
b as (select *, greatest(1, cast(ceil((t1 - t0) / 3600000000.0) as bigint)) as n from a),
w as (select symbol, least((us - t0) // 3600000000, n - 1) as win, wait from b),
g as (select symbol, win, count(*) as n_events, sum(wait) as waits, count(wait) as n_waits from w group by symbol, win),
sp as (select symbol, unnest(range(0, max(n))) as win from b group by symbol),
clock as (select sp.symbol, sp.win, coalesce(n_events, 0) as n_events, coalesce(n_waits, 0) as n_waits, coalesce(waits, 0.0::double) as waits
  from sp left join g on sp.symbol = g.symbol and sp.win = g.win)"""


@register("bars_clock", CLOCK + f" select symbol, win, n_events, n_waits, {s('waits', 3)} as waits from clock")
def bars_clock(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(bars.clock_bars(views.tape_ev(spark, sf), 3600), "symbol", "win", "n_events", "n_waits", digits=3, waits="waits")


@register("arrival_rate", CLOCK + f""", m as (select *, case when n_waits > 0 then waits / n_waits else 0.0::double end as mean_wait from clock)
select symbol, win, {s('mean_wait', 3)} as mean_wait, {s('case when n_events > 1 then n_events / (mean_wait + 1e-8) else 0.0::double end')} as intensity from m""")
def arrival_rate(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.arrival_rate(bars.clock_bars(views.tape_ev(spark, sf), 3600))
    return got.select("symbol", "win", snap(F.col("mean_wait"), 3).alias("mean_wait"), snap(F.col("intensity")).alias("intensity"))


@register("daily_ohlcv", with_views("daily") + f"select symbol, day, {s('open')} as open, {s('high')} as high, {s('low')} as low, {s('close')} as close, {s('volume')} as volume from daily")
def daily_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(views.daily(spark, sf), "symbol", "day", open="open", high="high", low="low", close="close", volume="volume")


@register("weekly_resample", with_views("daily") + f""",
g as (select symbol, cast(date_trunc('week', day) as date) + 6 as week, sum(volume) as volume, max_by(close, day) as close from daily group by 1, 2),
sp as (select symbol, cast(unnest(generate_series(cast(min(week) as timestamp), cast(max(week) as timestamp), interval 7 day)) as date) as week from g group by symbol),
f as (select sp.symbol, sp.week, coalesce(volume, 0.0::double) as volume, last_value(close ignore nulls) over (partition by sp.symbol order by sp.week) as close
  from sp left join g on sp.symbol = g.symbol and sp.week = g.week)
select symbol, week, {s('volume')} as volume, {s('close')} as close, {s('close / lag(close) over (partition by symbol order by week) - 1.0::double')} as change from f""")
def weekly_resample(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(bars.weekly(views.daily(spark, sf)), "symbol", "week", volume="volume", close="close", change="change")


@register("monthly_pivot", with_views("daily") + "select symbol, cast(year(day) as integer) as year, " + ", ".join(
    f'{s(f"sum(volume) filter (where month(day) = {m})")} as m{m}' for m in range(1, 13)) + " from daily group by 1, 2")
def monthly_pivot(spark: SparkSession, sf: str) -> DataFrame:
    got = bars.monthly_pivot(views.daily(spark, sf))
    return got.select("symbol", "year", *(snap(F.col(str(m))).alias(f"m{m}") for m in range(1, 13)))


@register("scan_range", "select l_orderkey, l_extendedprice from lineitem where l_shipdate between timestamp '1995-01-01' and timestamp '1995-12-31'")
def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    line = views.load(spark, sf, "lineitem")
    return line.where(F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz"))).select("l_orderkey", "l_extendedprice")


@register("signed_flow", with_views("tape") + """
select symbol, seq, size * case side when 'A' then 1.0::double when 'B' then -1.0::double else 0.0::double end as flow,
  size * coalesce(sign(price - lag(price) over (partition by symbol order by ts, seq)), 0) as tick_flow from tape""")
def signed_flow(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape(spark, sf)
    tick = F.col("size") * F.coalesce(F.signum(F.col("price") - F.lag("price").over(ordered(KEYS, ORDER))), F.lit(0.0))
    # adding 0 makes a negative zero a plain one
    return t.select("symbol", "seq", (signed(F.col("side"), F.col("size")) + 0.0).alias("flow"), (tick + 0.0).alias("tick_flow"))


@register("epoch_seconds", "select event_id, epoch_us(ts) / 1e6 as sec from events")
def epoch(spark: SparkSession, sf: str) -> DataFrame:
    return views.load(spark, sf, "events").select("event_id", epoch_seconds(F.col("ts")).alias("sec"))


@register("option_symbols", with_views("chain") + """
select option, contains(option, ' P') as is_put, try_cast(substr(list_extract(string_split(option, ' '), -1), 2) as double) as strike,
  regexp_extract(option, ' ([PC])[0-9]+$', 1) as kind, count(*) as n from chain where stat_type = 6 group by all""")
def option_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c = views.chain(spark, sf).where("stat_type = 6")
    last = F.element_at(F.split("option", " "), -1)
    return c.groupBy("option").agg(F.count("*").alias("n")).select(
        "option", F.contains("option", F.lit(" P")).alias("is_put"), F.expr("try_cast(substr(element_at(split(option, ' '), -1), 2) as double)").alias("strike"),
        F.regexp_extract("option", " ([PC])[0-9]+$", 1).alias("kind"), "n",
    )


@register("tape_guards", with_views("tape") + """,
g as (select *, lag(ts) over (partition by symbol order by seq) as before from tape)
select symbol, count(*) filter (where before > ts) as unsorted, count(*) filter (where size < 0) as negative,
  count(*) filter (where side not in ('A', 'B', 'N')) as odd_side, sum(notional_c) >= 100000000 as enough from g group by symbol""")
def tape_guards(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape(spark, sf).withColumn("before", F.lag("ts").over(ordered(KEYS, ["seq"])))
    return t.groupBy("symbol").agg(
        F.count_if(F.col("before") > F.col("ts")).alias("unsorted"), F.count_if(F.col("size") < 0).alias("negative"),
        F.count_if(~F.col("side").isin("A", "B", "N")).alias("odd_side"), (F.sum("notional_c") >= BAR_C).alias("enough"),
    )


RETURNS = with_views("daily") + ", r as (select *, ln(close / lag(close) over (partition by symbol order by day)) as ret from daily)"


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily(spark, sf).withColumn("ret", rolling.log_return("close", KEYS, DAY))


@register("degenerate_guard", RETURNS + f"""
select symbol, count(ret) as n, {s('stddev_pop(ret)')} as sd, {s('avg(case when abs(ret) < 1e-12 then 1.0::double else 0.0::double end) filter (where ret is not null)')} as zeros,
  coalesce(count(ret) = 0 or stddev_pop(ret) < 1e-10, true) as degenerate from r group by symbol""")
def degenerate_guard(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).where("ret is not null")
    return r.groupBy("symbol").agg(
        F.count("ret").alias("n"), snap(F.stddev_pop("ret")).alias("sd"), snap(F.avg((F.abs("ret") < 1e-12).cast("double"))).alias("zeros"),
        ((F.count("ret") == 0) | (F.stddev_pop("ret") < 1e-10)).alias("degenerate"),
    )


@register("expanding_mean", with_views("daily") + f"select symbol, day, {s('avg(close) over (partition by symbol order by day rows unbounded preceding)')} as mean_close from daily")
def expanding_mean(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(views.daily(spark, sf), "symbol", "day", mean_close=rolling.expanding_mean("close", KEYS, DAY))


U = "(partition by symbol order by day rows unbounded preceding)"


@register("causal_zscore", RETURNS + f""", q as (select *, coalesce(ret, 0.0::double) as x from r)
select symbol, day, {s(f'case when row_number() over (partition by symbol order by day) <= 20 then 0.0::double else (x - avg(x) over {U}) / (stddev_pop(x) over {U} + 1e-8) end')} as z from q""")
def causal_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(returns(spark, sf).withColumn("x", F.coalesce("ret", F.lit(0.0))), "symbol", "day", z=rolling.causal_z("x", KEYS, DAY))


def rows(a: int, b: int) -> str:
    side = lambda k: "current row" if k == 0 else f"{abs(k)} {'preceding' if k < 0 else 'following'}"
    return f"(partition by symbol order by day rows between {side(a)} and {side(b)})"


@register("prior_zscore", with_views("daily") + f"""
select symbol, day, {s(f'case when count(close) over {rows(-63, -1)} < 2 or stddev_pop(close) over {rows(-63, -1)} <= 1e-12 then 0.0::double else (close - avg(close) over {rows(-63, -1)}) / stddev_pop(close) over {rows(-63, -1)} end')} as z from daily""")
def prior_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(views.daily(spark, sf), "symbol", "day", z=rolling.prior_z("close", KEYS, DAY, 63))


@register("rolling_zscore", with_views("daily") + f"select symbol, day, {s(f'(close - avg(close) over {rows(-49, 0)}) / (stddev_pop(close) over {rows(-49, 0)} + 1e-8)')} as z from daily")
def rolling_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(views.daily(spark, sf), "symbol", "day", z=rolling.rolling_z("close", KEYS, DAY, 50))


def bar_rows(a: int, b: int) -> str:
    return rows(a, b).replace("order by day", "order by bar_id")


@register("vpin", "with " + RESET_BARS + f""",
v as (select *, case when row_number() over (partition by symbol order by bar_id) > 50 then sum(abs(buy_volume - sell_volume)) over {bar_rows(-50, -1)} / sum(volume) over {bar_rows(-50, -1)} else 0.0::double end as vpin from bar)
select symbol, bar_id, {s('vpin')} as vpin, {s('coalesce(vpin - lag(vpin) over (partition by symbol order by bar_id), 0.0::double)')} as d_vpin,
  {s('volume / (avg(volume) over (partition by symbol order by bar_id rows unbounded preceding) + 1e-8)')} as rel_volume from v""")
def vpin(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.vpin(bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")), KEYS, ["bar_id"])
    return snapped(got, "symbol", "bar_id", vpin="vpin", d_vpin="d_vpin", rel_volume="rel_volume")


def cdf_sql(z: str) -> str:
    t = f"(1.0::double / (1.0::double + 0.2316419::double * abs({z})))"
    poly = f"{t} * (0.319381530::double + {t} * (-0.356563782::double + {t} * (1.781477937::double + {t} * (-1.821255978::double + {t} * 1.330274429::double))))"
    tail = f"0.3989422804014327::double * exp(-0.5::double * {z} * {z}) * {poly}"
    return f"case when {z} >= 0 then 1.0::double - {tail} else {tail} end"


BVC = "with " + RESET_BARS + f""",
z as (select *, bar_return / coalesce(nullif(stddev_samp(bar_return) over {bar_rows(-49, 0)}, 0), 1e-8) as z from bar),
bvc as (select *, {cdf_sql('z')} as p_buy, abs(2 * ({cdf_sql('z')}) - 1) * volume as imbalance from z)"""


@register("bulk_volume", BVC + f" select symbol, bar_id, {s('p_buy')} as p_buy, {s('imbalance', 4)} as imbalance from bvc")
def bulk_volume(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.bulk_volume(bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")), KEYS, ["bar_id"])
    return got.select("symbol", "bar_id", snap(F.col("p_buy")).alias("p_buy"), snap(F.col("imbalance"), 4).alias("imbalance"))


@register("vpin_full", BVC + f""" select symbol, bar_id, {s(f"case when count(*) over {bar_rows(-49, 0)} = 50 then greatest(0.0::double, least(1.0::double, sum(imbalance) over {bar_rows(-49, 0)} / (50 * avg(volume) over {bar_rows(-49, 0)}))) end")} as vpin from bvc""")
def vpin_full(spark: SparkSession, sf: str) -> DataFrame:
    bvc = rolling.bulk_volume(bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")), KEYS, ["bar_id"])
    return snapped(rolling.full_vpin(bvc, KEYS, ["bar_id"]), "symbol", "bar_id", vpin="vpin")


COUNT = with_views("tape") + """,
n as (select *, (row_number() over (partition by symbol order by ts, seq) - 1) // 100 as bar_id from tape),
cb as (select symbol, bar_id, max_by(price, seq) - min_by(price, seq) as dp, sum(size * case side when 'A' then 1.0::double when 'B' then -1.0::double else 0.0::double end) as flow
  from n group by symbol, bar_id having count(*) = 100)"""


def lam(w: int) -> str:
    f = bar_rows(-w, -1)
    return f"case when var_pop(flow) over {f} > 1e-12 then covar_samp(dp, flow) over {f} / var_pop(flow) over {f} else 0.0::double end"


@register("price_impact", COUNT + f", k as (select *, {lam(5)} as l5, {lam(20)} as l20 from cb) select symbol, bar_id, {s('l5')} as lambda_5, {s('l20')} as lambda_20, {s('dp - l5 * flow', 4)} as residual from k")
def price_impact(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.price_impact(bars.count_bars(views.tape(spark, sf), 100), KEYS, ["bar_id"])
    return got.select("symbol", "bar_id", snap(F.col("lambda_5")).alias("lambda_5"), snap(F.col("lambda_20")).alias("lambda_20"), snap(F.col("residual"), 4).alias("residual"))


@register("impact_slope", COUNT + f""", k as (select *, case when count(*) over {bar_rows(-19, 0)} = 20 and var_pop(flow) over {bar_rows(-19, 0)} > 1e-12 then covar_pop(dp, flow) over {bar_rows(-19, 0)} / var_pop(flow) over {bar_rows(-19, 0)} end as slope from cb)
select symbol, bar_id, {s('slope')} as slope, {s('dp - lag(slope) over (partition by symbol order by bar_id) * flow', 4)} as residual from k""")
def impact_slope(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.rolling_slope(bars.count_bars(views.tape(spark, sf), 100), KEYS, ["bar_id"], 20)
    return got.select("symbol", "bar_id", snap(F.col("slope")).alias("slope"), snap(F.col("residual"), 4).alias("residual"))


EXT = with_views("daily", "ext_daily") + ", j as (select d.*, e.index_close, e.vix from daily d left join ext_daily e on d.day = e.day)"


def with_index(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily(spark, sf).join(views.ext_daily(spark, sf), "day", "left")


@register("daily_left_join", EXT + f" select symbol, day, {s('close')} as close, {s('index_close', 4)} as index_close, {s('vix', 4)} as vix from j")
def daily_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return with_index(spark, sf).select("symbol", "day", snap(F.col("close")).alias("close"), snap(F.col("index_close"), 4).alias("index_close"), snap(F.col("vix"), 4).alias("vix"))


@register("variance_premium", EXT + f""", r as (select *, ln(close / lag(close) over (partition by symbol order by day)) as ret from j),
v as (select *, stddev_pop(ret) over {rows(-30, -1)} * sqrt(252.0::double) as rv30, row_number() over (partition by symbol order by day) as n,
  close / lag(close, 5) over (partition by symbol order by day) - 1 as mom5, close / lag(close, 21) over (partition by symbol order by day) - 1 as mom21 from r)
select symbol, day, {s('coalesce(vix, rv30 * 100) / 100 - rv30')} as premium, {s('rv30')} as rv30, {s('sin(dayofyear(day) * (2 * pi() / 252))')} as doy_sin,
  {s('cos((isodow(day) - 1) * (2 * pi() / 5))')} as dow_cos, {s('mom5')} as mom5, {s('mom21')} as mom21, {s('ln(coalesce(vix, rv30 * 100))')} as ln_iv, {s('ln(0.8::double)')} as ln_pcr from v where n > 30""")
def variance_premium(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.variance_premium(with_index(spark, sf).withColumn("pcr", F.lit(None).cast("double")), KEYS)
    return snapped(got, "symbol", "day", **{n: n for n in "premium rv30 doy_sin dow_cos mom5 mom21 ln_iv ln_pcr".split()})


MACRO = EXT + """, r as (select *, coalesce(ln(close / lag(close) over (partition by symbol order by day)), 0.0::double) as r,
  coalesce(ln(index_close / lag(index_close) over (partition by symbol order by day)), 0.0::double) as s from j)"""


@register("macro_features", MACRO + f""", m as (select *, row_number() over (partition by symbol order by day) as n, corr(r, s) over {rows(-60, -1)} as c,
  case when var_pop(s) over {rows(-60, -1)} > 1e-12 then covar_samp(r, s) over {rows(-60, -1)} / var_pop(s) over {rows(-60, -1)} else 0.0::double end as beta,
  var_pop(r) over {rows(-60, -1)} as vr, var_pop(s) over {rows(-60, -1)} as vs, covar_pop(r, s) over {rows(-60, -1)} as crs,
  sum(r) over {rows(-5, -1)} as mom5, sum(r) over {rows(-20, -1)} as mom20, sum(r) over {rows(-60, -1)} as mom60 from r)
select symbol, day, {s('mom5')} as mom5, {s('mom20')} as mom20, {s('mom60')} as mom60, {s('coalesce(case when isnan(c) then 0.0::double else c end, 0.0::double)')} as corr, {s('beta')} as beta,
  {s('sqrt(greatest(0.0::double, vr - 2 * beta * crs + beta * beta * vs))')} as resid_sd from m where n > 60""")
def macro_features(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(rolling.macro_features(with_index(spark, sf), KEYS), "symbol", "day", **{n: n for n in "mom5 mom20 mom60 corr beta resid_sd".split()})


W = rolling.fractional_weights(0.5)


@register("fractional_difference", with_views("daily") + f""", f as (select symbol, day, count(*) over {rows(-(len(W) - 1), 0)} as n, """ + " + ".join(
    f"({w!r})::double * lag(ln(close), {k}) over (partition by symbol order by day)" for k, w in enumerate(W)) + f""" as x from daily)
select symbol, day, {s(f'case when n = {len(W)} then x end')} as x from f""")
def fractional_difference(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.daily(spark, sf).withColumn("p", F.log("close"))
    return snapped(logs, "symbol", "day", x=rolling.fractional_difference("p", KEYS, DAY, 0.5))


@register("forward_return", with_views("daily") + f"select symbol, day, {s('coalesce(ln(lead(close) over (partition by symbol order by day) + 1e-8) - ln(close + 1e-8), 0.0::double)')} as fwd from daily")
def forward_return(spark: SparkSession, sf: str) -> DataFrame:
    ahead = F.log(F.lead("close").over(ordered(KEYS, DAY)) + 1e-8) - F.log(F.col("close") + 1e-8)
    return snapped(views.daily(spark, sf), "symbol", "day", fwd=F.coalesce(ahead, F.lit(0.0)))


@register("forward_volatility", RETURNS + f""", l as (select symbol, day, ln(lead(close) over (partition by symbol order by day) / close) as f from daily)
select symbol, day, {s(f'case when count(f) over {rows(0, 19)} >= 5 and stddev_pop(f) over {rows(0, 19)} > 0 then ln(stddev_pop(f) over {rows(0, 19)} * sqrt(252.0::double)) end')} as ln_vol from l""")
def forward_volatility(spark: SparkSession, sf: str) -> DataFrame:
    f = views.daily(spark, sf).withColumn("f", F.log(F.lead("close").over(ordered(KEYS, DAY)) / F.col("close")))
    ahead = frame(KEYS, DAY, 0, 19)
    sd = F.stddev_pop("f").over(ahead)
    return snapped(f, "symbol", "day", ln_vol=F.when((F.count("f").over(ahead) >= 5) & (sd > 0), F.log(sd * F.sqrt(F.lit(252.0)))))


@register("trailing_volatility_scale", RETURNS + f"""
select symbol, day, {s(f'case when stddev_pop(ret) over {rows(-19, 0)} * sqrt(252.0::double) < 0.01 or count(ret) over {rows(-19, 0)} < 2 then 1.0::double else least(3.0::double, greatest(0.25::double, 0.15 / (stddev_pop(ret) over {rows(-19, 0)} * sqrt(252.0::double)))) end')} as scale from r""")
def trailing_volatility_scale(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(KEYS, DAY, -19, 0)
    vol = F.stddev_pop("ret").over(f) * F.sqrt(F.lit(252.0))
    scale = F.when((vol < 0.01) | (F.count("ret").over(f) < 2), 1.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.25), 0.15 / vol)))
    return snapped(returns(spark, sf), "symbol", "day", scale=scale)


def mh(h: int) -> str:
    return f"case when count(x) over {rows(-h, -1)} = {h} then avg(x) over {rows(-h, -1)} end as m{h}"


def mz(h: int) -> str:
    return f"case when count(m{h}) over {rows(-100, -1)} = 100 then (m{h} - avg(m{h}) over {rows(-100, -1)}) / (stddev_pop(m{h}) over {rows(-100, -1)} + 1e-8) end"


@register("multi_horizon_score", RETURNS + f""", q as (select *, coalesce(ret, 0.0::double) as x from r), m as (select *, {mh(10)}, {mh(30)}, {mh(60)} from q)
select symbol, day, {s(f'0.2 * coalesce({mz(10)}, 0.0::double) + 0.5 * coalesce({mz(30)}, 0.0::double) + 0.3 * coalesce({mz(60)}, 0.0::double)', 5)} as score from m""")
def multi_horizon_score(spark: SparkSession, sf: str) -> DataFrame:
    got = rolling.multi_horizon_score(returns(spark, sf).withColumn("x", F.coalesce("ret", F.lit(0.0))), "x", KEYS, DAY)
    return snapped(got, "symbol", "day", digits=5, score="score")


@register("ou_params", with_views("daily") + f""", x as (select symbol, ln(close) as x, lead(ln(close)) over (partition by symbol order by day) - ln(close) as dx from daily),
f as (select symbol, covar_pop(dx, x) / var_pop(x) as b, avg(dx) - covar_pop(dx, x) / var_pop(x) * avg(x) as a, var_pop(dx) - pow(covar_pop(dx, x), 2) / var_pop(x) as v from x where dx is not null group by symbol)
select symbol, {s('-b')} as kappa, {s('-a / b')} as mu, {s('sqrt(greatest(v, 0.0::double))')} as sigma, {s('ln(2.0::double) / -b')} as half_life from f where -b >= 1e-10""")
def ou_params(spark: SparkSession, sf: str) -> DataFrame:
    x = views.daily(spark, sf).withColumn("x", F.log("close")).withColumn("dx", F.lead("x").over(ordered(KEYS, DAY)) - F.col("x")).where("dx is not null")
    slope = F.covar_pop("dx", "x") / F.var_pop("x")
    fit = x.groupBy("symbol").agg(
        slope.alias("b"), (F.avg("dx") - slope * F.avg("x")).alias("a"), (F.var_pop("dx") - F.covar_pop("dx", "x") * F.covar_pop("dx", "x") / F.var_pop("x")).alias("v")
    ).where("-b >= 1e-10")
    return snapped(fit, "symbol", kappa=-F.col("b"), mu=-F.col("a") / F.col("b"), sigma=F.sqrt(F.greatest(F.col("v"), F.lit(0.0))), half_life=F.log(F.lit(2.0)) / -F.col("b"))


@register("drawdown", with_views("daily") + f""", p as (select *, max(close) over {U} as peak from daily)
select symbol, day, {s('peak')} as peak, {s('close - peak')} as drawdown, {s('(close - peak) / peak')} as drawdown_pct from p""")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(rolling.drawdown(views.daily(spark, sf), "close", KEYS, DAY), "symbol", "day", peak="peak", drawdown="drawdown", drawdown_pct="drawdown_pct")


LAGS, AHEAD = range(51), (1, 5, 10, 20, 60)


@register("lagged_correlation", RETURNS + f""", l as (select *, {", ".join(f"lag(ret, {k}) over (partition by symbol order by day) as r{k}" for k in LAGS)} from r)
{" union all ".join(f"select symbol, {k} as lag, {s(f'corr(ret, r{k})')} as corr from l group by symbol" for k in LAGS)}""")
def lagged_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of a day's return with that of each of 50 days before it, and its own: one window, one aggregate."""
    r = returns(spark, sf).select("*", *(F.lag("ret", k).over(ordered(KEYS, DAY)).alias(f"r{k}") for k in LAGS))
    c = r.groupBy("symbol").agg(*(F.corr("ret", f"r{k}").alias(f"c{k}") for k in LAGS))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("c")) for k in LAGS)))
    return c.select("symbol", each.alias("x")).select("symbol", "x.lag", snap(F.col("x.c")).alias("corr"))


@register("forward_sum_correlation", RETURNS + f""", l as (select *, lag(ret) over (partition by symbol order by day) as pred, {", ".join(f"case when count(ret) over {rows(0, k - 1)} = {k} then sum(ret) over {rows(0, k - 1)} end as f{k}" for k in AHEAD)} from r)
select symbol, {", ".join(f"{s(f'corr(pred, f{k})')} as ahead{k}" for k in AHEAD)} from l group by symbol""")
def forward_sum_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of what is known before a day, the return of the one before, with the sum over whole horizons from it on."""
    sums = {f"f{k}": F.when(F.count("ret").over(frame(KEYS, DAY, 0, k - 1)) == k, F.sum("ret").over(frame(KEYS, DAY, 0, k - 1))) for k in AHEAD}
    l = returns(spark, sf).select("*", F.lag("ret").over(ordered(KEYS, DAY)).alias("pred"), *(v.alias(k) for k, v in sums.items()))
    return l.groupBy("symbol").agg(*(snap(F.corr("pred", f"f{k}")).alias(f"ahead{k}") for k in AHEAD))


@register("rolling_ic", RETURNS + f""", l as (select *, lag(ret) over (partition by symbol order by day) as pred from r)
select symbol, day, {s(f'corr(pred, ret) over {rows(-100, -1)}')} as ic from l qualify count(pred) over {rows(-100, -1)} = 100""")
def rolling_ic(spark: SparkSession, sf: str) -> DataFrame:
    f = frame(KEYS, DAY, -100, -1)
    r = returns(spark, sf).withColumn("pred", F.lag("ret").over(ordered(KEYS, DAY)))
    r = r.withColumn("ic", F.corr("pred", "ret").over(f)).withColumn("n", F.count("pred").over(f)).where("n = 100")
    return snapped(r, "symbol", "day", ic="ic")
