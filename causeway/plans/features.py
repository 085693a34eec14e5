"""Registered queries of whole feature vectors: the book, the calendar, bars with their times, and toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, month_number, ordered, snap
from causeway.operators import bars, book, contracts, events, rolling
from causeway.plans.market import BAR_C, BVC, DAY, RESET_BARS, RETURNS, bar_rows, returns, rows, with_index
from causeway.plans.registry import register
from causeway.sources import store, views
from causeway.sources.views import KEYS, sql_snap as s, with_views

BAR = ["bar_id"]


@register("book_vector", with_views("book") + f""", f as (select *, (bid_prices[1] + ask_prices[1]) / 2 as mid, list_sum(bid_sizes) + list_sum(ask_sizes) as size from book),
v as (select symbol, seq, list_concat(list_transform(list_concat(bid_sizes, ask_sizes), lambda x: x / size), list_transform(list_concat(bid_prices, ask_prices), lambda x: (x - mid) / mid * 1e4),
  [(ask_prices[1] - bid_prices[1]) / mid * 1e4], list_transform(range(1, 6), lambda i: (bid_sizes[i] - ask_sizes[i]) / (bid_sizes[i] + ask_sizes[i]))) as v from f),
u as (select symbol, seq, generate_subscripts(v, 1) as i, unnest(v) as value from v)
select symbol, seq, cast(i as integer) as i, {s('value', 4)} as value from u""")
def book_vector(spark: SparkSession, sf: str) -> DataFrame:
    """All 5 L + 1 features of each snapshot: shares of size, distances from mid and spread in basis points, imbalance by level."""
    f = book.book_features(views.book(spark, sf))
    v = F.concat("profile", "shape", F.array(F.col("spread") / F.col("mid") * 1e4), "depth")
    return f.select("symbol", "seq", F.posexplode(v).alias("at", "v")).select("symbol", "seq", (F.col("at") + 1).alias("i"), snap(F.col("v"), 4).alias("value"))


CYCLES = {"dow": ("isodow(day) - 1", 5.0), "dom": ("day(day)", 30.5), "moy": ("month(day)", 12.0)}


@register("calendar_encoding", with_views("daily") + f""", d as (select distinct day, cast(date_trunc('month', day) as date) as m, cast(date_trunc('quarter', day) as date) as q from daily),
f as (select *, m + cast((12 - isodow(m)) % 7 as integer) + 14 as friday3 from d)
select day, {', '.join(f"{s(f'{fn}(({x}) * (2 * pi() / {p}::double))')} as {n}_{fn}" for n, (x, p) in CYCLES.items() for fn in ('sin', 'cos'))},
  {s('least(greatest((day(day) - 1) / 29.0::double, 0.0::double), 1.0::double)')} as month_position, {s('least((day - q) / 91.0::double, 1.0::double)')} as quarter_position,
  {s('exp(-abs(friday3 - day) / 3.0::double)')} as near_expiry, {s('exp(-(isodow(day) - 1) / 2.0::double)')} as near_monday, {s('exp(-(5 - isodow(day)) / 2.0::double)')} as near_friday from f""")
def calendar_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """The eleven encodings of a date: three cycles, places in the month and quarter, closeness to expiry, Monday and Friday."""
    got = events.date_encoding(views.daily(spark, sf).select("day").distinct())
    return got.select("day", *(snap(F.col(c)).alias(c) for c in got.columns if c != "day"))


@register("bar_times", "with " + RESET_BARS + f""", w as (select p.symbol, bar_id, min(p.ts) as first_ts, max(p.ts) as last_ts, stddev_pop(price) / (avg(price) + 1e-8) as spread, sum(p.notional_c) as value_c from p group by 1, 2)
select symbol, bar_id, cast(coalesce(lag(last_ts) over (partition by symbol order by bar_id), first_ts) as date) as open_day, cast(last_ts as date) as close_day, {s('spread')} as spread, cast(value_c as bigint) as value_c from w""")
def bar_times(spark: SparkSession, sf: str) -> DataFrame:
    """Reset bars with their times, a bar opening when the one before closed, and the spread of prices within."""
    ids = bars.reset_bar_ids(views.tape(spark, sf), BAR_C, month_number("ts")).where("bar_id is not null")
    w = ids.groupBy("symbol", "bar_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.stddev_pop("price") / (F.avg("price") + 1e-8)).alias("spread"), F.sum("notional_c").alias("value_c")
    )
    opened = F.coalesce(F.lag("last_ts").over(ordered(KEYS, BAR)), F.col("first_ts"))
    return w.select("symbol", "bar_id", F.to_date(opened).alias("open_day"), F.to_date("last_ts").alias("close_day"), snap(F.col("spread")).alias("spread"), "value_c")


WHOLE = "(partition by symbol order by bar_id rows unbounded preceding)"
ZED = lambda x: s(f"case when row_number() over {WHOLE} <= 20 then 0.0::double else ({x} - avg({x}) over {WHOLE}) / (stddev_pop({x}) over {WHOLE} + 1e-8) end", 4)


@register("vpin_vector", "with " + RESET_BARS + f""", w as (select symbol, bar_id, stddev_pop(price) / (avg(price) + 1e-8) as bar_vol from p group by 1, 2),
v as (select bar.symbol, bar.bar_id, bar_vol, volume / (avg(volume) over {WHOLE.replace('symbol', 'bar.symbol').replace('bar_id', 'bar.bar_id')} + 1e-8) as rel_volume,
  case when row_number() over (partition by bar.symbol order by bar.bar_id) > 50 then sum(abs(buy_volume - sell_volume)) over (partition by bar.symbol order by bar.bar_id rows between 50 preceding and 1 preceding)
    / sum(volume) over (partition by bar.symbol order by bar.bar_id rows between 50 preceding and 1 preceding) else 0.0::double end as vpin from bar join w on bar.symbol = w.symbol and bar.bar_id = w.bar_id),
d as (select *, coalesce(vpin - lag(vpin) over (partition by symbol order by bar_id), 0.0::double) as d_vpin from v), t as (select * from d where bar_id >= 50)
select symbol, bar_id, {', '.join(f'{ZED(c)} as {c}' for c in ('vpin', 'd_vpin', 'bar_vol', 'rel_volume'))} from t""")
def vpin_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The four features of a bar's toxicity against their own past, from the 51st bar on."""
    tape = views.tape(spark, sf)
    ids = bars.reset_bar_ids(tape, BAR_C, month_number("ts")).where("bar_id is not null")
    spread = ids.groupBy("symbol", "bar_id").agg((F.stddev_pop("price") / (F.avg("price") + 1e-8)).alias("bar_vol"))
    got = rolling.vpin(bars.reset_bars(tape, BAR_C, month_number("ts")), KEYS, BAR).join(spread, ["symbol", "bar_id"]).where("bar_id >= 50")
    return got.select("symbol", "bar_id", *(snap(rolling.causal_z(c, KEYS, BAR), 4).alias(c) for c in ("vpin", "d_vpin", "bar_vol", "rel_volume")))


@register("toxicity_vector", BVC + f""", v as (select *, case when count(*) over {bar_rows(-49, 0)} = 50 then greatest(0.0::double, least(1.0::double, sum(imbalance) over {bar_rows(-49, 0)} / (50 * avg(volume) over {bar_rows(-49, 0)}))) end as vpin from bvc),
d as (select *, vpin - lag(vpin) over (partition by symbol order by bar_id) as d_vpin, volume / nullif(avg(volume) over {bar_rows(-19, 0)}, 0) as relative_volume from v)
select symbol, bar_id, {s('vpin')} as vpin, {s('d_vpin')} as d_vpin, {s('intra_vol')} as bar_volatility, {s('relative_volume')} as relative_volume from d
where vpin is not null and d_vpin is not null and relative_volume is not null""")
def toxicity_vector(spark: SparkSession, sf: str) -> DataFrame:
    """VPIN by bulk volume, its change, volatility within the bar, and volume over the mean of 20 bars; incomplete rows go."""
    got = rolling.full_vpin(rolling.bulk_volume(bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")), KEYS, BAR), KEYS, BAR)
    mean = F.avg("volume").over(frame(KEYS, BAR, -19, 0))
    got = got.withColumn("d_vpin", F.col("vpin") - F.lag("vpin").over(ordered(KEYS, BAR))).withColumn("relative_volume", F.col("volume") / F.nullif(mean, F.lit(0.0)))
    got = got.dropna(subset=["vpin", "d_vpin", "relative_volume"])
    return got.select("symbol", "bar_id", *(snap(F.col(c)).alias(n) for c, n in (("vpin", "vpin"), ("d_vpin", "d_vpin"), ("intra_vol", "bar_volatility"), ("relative_volume", "relative_volume"))))


@register("degenerate_folds", RETURNS + f""", y as (select symbol, cast(year(day) as integer) as fold, case when abs(ret) > 0.01 then ret else ret * 0 end as y from r where month(day) > 1)
select symbol, fold, count(y) as n, {s('stddev_pop(y)')} as sd, {s('avg(case when abs(y) < 1e-12 then 1.0::double when y is not null then 0.0::double end)')} as zeros,
  case when count(y) = 0 then 'empty' when stddev_pop(y) < 1e-10 then 'constant' when avg(case when abs(y) < 1e-12 then 1.0::double when y is not null then 0.0::double end) > 0.9 then 'zeros' end as reason from y group by 1, 2""")
def degenerate_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether large moves, all others counting as 0, can be learnt in each year of each symbol, its first month left out."""
    r = returns(spark, sf).where(F.month("day") > 1).withColumn("fold", F.year("day")).withColumn("y", F.when(F.abs("ret") > 0.01, F.col("ret")).otherwise(F.col("ret") * 0))
    got = contracts.degenerate(r, "y", ["symbol", "fold"])
    return got.select("symbol", "fold", "n", snap(F.col("sd")).alias("sd"), snap(F.col("zeros")).alias("zeros"), "reason")


PREMIUM = "premium term doy_sin doy_cos dow_sin dow_cos mom5 mom21 ln_iv ln_pcr".split()
PAST = "(partition by symbol order by day rows unbounded preceding)"
DAY_Z = lambda x: s(f"case when row_number() over {PAST} <= 20 then 0.0::double else ({x} - avg({x}) over {PAST}) / (stddev_pop({x}) over {PAST} + 1e-8) end", 4)


@register("premium_vector", with_views("daily", "ext_daily", "chain") + f""", oi as (select symbol, day, sum(case lower(trim(type)) when 'call' then 0.0::double else open_interest end) / (sum(case lower(trim(type)) when 'call' then open_interest else 0.0::double end) + 1e-8) as pcr from chain group by 1, 2),
j as (select d.*, e.vix, case when pcr > 0 then pcr end as pcr from daily d left join ext_daily e on d.day = e.day left join oi on d.symbol = oi.symbol and d.day = oi.day),
r as (select *, ln(close / lag(close) over (partition by symbol order by day)) as ret from j),
v as (select *, stddev_pop(ret) over {rows(-30, -1)} * sqrt(252.0::double) as rv30, row_number() over (partition by symbol order by day) as n,
  close / lag(close, 5) over (partition by symbol order by day) - 1 as mom5, close / lag(close, 21) over (partition by symbol order by day) - 1 as mom21 from r),
f as (select symbol, day, coalesce(vix, rv30 * 100) / 100 - rv30 as premium, 0.0::double as term, sin(dayofyear(day) * (2 * pi() / 252)) as doy_sin, cos(dayofyear(day) * (2 * pi() / 252)) as doy_cos,
  sin((isodow(day) - 1) * (2 * pi() / 5)) as dow_sin, cos((isodow(day) - 1) * (2 * pi() / 5)) as dow_cos, mom5, mom21, ln(coalesce(vix, rv30 * 100)) as ln_iv, ln(coalesce(pcr, 0.8::double)) as ln_pcr from v where n > 30)
select symbol, day, {', '.join(f'{DAY_Z(c)} as {c}' for c in PREMIUM)} from f""")
def premium_vector(spark: SparkSession, sf: str) -> DataFrame:
    """All ten features of the variance premium against their own past; puts to calls of the chain, 0.8 on days without."""
    call = F.lower(F.trim("type")) == "call"
    oi = views.chain(spark, sf).groupBy("symbol", "day").agg((F.sum(F.when(call, 0.0).otherwise(F.col("open_interest"))) / (F.sum(F.when(call, F.col("open_interest")).otherwise(0.0)) + 1e-8)).alias("pcr"))
    daily = with_index(spark, sf).join(oi, ["symbol", "day"], "left").withColumn("pcr", F.when(F.col("pcr") > 0, F.col("pcr")))
    got = rolling.variance_premium(daily, KEYS).withColumn("term", F.lit(0.0))
    return got.select("symbol", "day", *(snap(rolling.causal_z(c, KEYS, DAY), 4).alias(c) for c in PREMIUM))


SOURCES = "customer supplier part orders lineitem events documents embeddings pages conversations quotes".split()


@register("source_inventory", " union all ".join(f"select '{n}' as source, true as present, count(*) as n_rows from {n}" for n in SOURCES[:-1]) + " union all select 'quotes', false, 0")
def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Which sources are there, and their rows; quotes are none of the given tables."""
    return store.inventory(spark, sf, SOURCES).select("source", "present", "n_rows")
