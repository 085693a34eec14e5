"""Registered queries of contracts, set operations, small Gram matrices and chart panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, month_number, ordered, snap
from causeway.operators import asof, bars, contracts, learning, portfolio, resampling
from causeway.plans.market import BAR_C, DAY, RESET_BARS, RETURNS, returns, rows, snapped
from causeway.plans.registry import register
from causeway.sources import calendar, views
from causeway.sources.views import KEYS, sql_snap as s, with_views


@register("trading_days", with_views("daily") + "select symbol, min(day) as first_day, max(day) as last_day, count(distinct day) as n_days from daily group by symbol")
def trading_days(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily(spark, sf).groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("n_days"))


@register("row_contract", with_views("daily", "ext_daily") + "select count(*) filter (where e.day is null) as only_left, count(*) filter (where d.day is null) as only_right from (select distinct day from daily) d full join ext_daily e on d.day = e.day")
def row_contract(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.same_rows(views.daily(spark, sf).select("day").distinct(), views.ext_daily(spark, sf), ["day"])


@register("grid_reach", with_views("daily", "ext_daily") + "select max(e.day) as daily_end, (select max(day) from daily) as bar_end, (select max(day) from daily) - max(e.day) <= 5 as reaches from ext_daily e")
def grid_reach(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.reaches(views.ext_daily(spark, sf), views.daily(spark, sf), "day")


@register("calendar_rules", """with lim as (select cast(min(l_shipdate) as date) as lo, cast(max(l_shipdate) as date) as hi from lineitem),
d as (select cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as date) as day from lim),
f as (select day, cast(date_trunc('month', day) as date) as m from d), g as (select day, m + cast((12 - isodow(m)) % 7 as integer) as friday, m + cast((10 - isodow(m)) % 7 as integer) + 7 as wednesday from f)
select day as event_day, 'NFP' as event_type, 0.7::double as magnitude from g where day = friday union all select day, 'OpEx', 0.6::double from g where day = friday + 14
union all select day, 'CPI', 0.8::double from g where day = wednesday union all select day, 'EIA_Crude', 0.5::double from g where isodow(day) = 3""")
def calendar_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduled events over the days of the tape; its years hold none of the stated rate days."""
    lo, hi = views.load(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return calendar.build(spark, str(lo), str(hi)).where("event_type <> 'FOMC'")


@register("top_of_book", with_views("book") + f", t as (select symbol, seq, bid_sizes[1:2] as b, ask_sizes[1:2] as a from book) select symbol, seq, {s('b[1] + b[2]')} as bid2, {s('a[1] + a[2]')} as ask2 from t")
def top_of_book(spark: SparkSession, sf: str) -> DataFrame:
    """The two best levels, under either name of the columns."""
    raw = views.book(spark, sf).withColumn("bids", F.lit(None).cast("array<double>"))
    b = F.slice(F.coalesce("bids", "bid_sizes"), 1, 2)
    a = F.slice("ask_sizes", 1, 2)
    return raw.select("symbol", "seq", snap(b[0] + b[1]).alias("bid2"), snap(a[0] + a[1]).alias("ask2"))


@register("book_timescales", with_views("book") + f""", f as (select symbol, seq, (list_sum(bid_sizes) - list_sum(ask_sizes)) / (list_sum(bid_sizes) + list_sum(ask_sizes)) as x from book)
select symbol, seq, {s('avg(x) over (partition by symbol order by seq rows between 4 preceding and current row)')} as mean5, {s('avg(x) over (partition by symbol order by seq rows between 19 preceding and current row)')} as mean20 from f""")
def book_timescales(spark: SparkSession, sf: str) -> DataFrame:
    from causeway.operators.book import book_features

    f = book_features(views.book(spark, sf))
    o = ["seq"]
    return snapped(f, "symbol", "seq", mean5=F.avg("imbalance").over(frame(KEYS, o, -4, 0)), mean20=F.avg("imbalance").over(frame(KEYS, o, -19, 0)))


@register("legacy_same_day", with_views("tape", "ext_daily") + f""", d as (select distinct symbol, day from tape), j as (select d.symbol, d.day, e.vix from d asof left join ext_daily e on d.day <= e.day)
select symbol, day, {s('coalesce(vix, (select max_by(vix, day) from ext_daily))', 4)} as vix from j""")
def legacy_same_day(spark: SparkSession, sf: str) -> DataFrame:
    """The first daily row at or after a day, clipped to the last: it looks ahead within the day, and is kept only to compare."""
    days = views.tape(spark, sf).select("symbol", "day").distinct()
    ext = views.ext_daily(spark, sf)
    keyed = days.select("symbol").distinct().crossJoin(F.broadcast(ext))
    hit = asof.as_of(days, {"hit": (keyed, ["vix"])}, KEYS, "day", forward=True)
    last = ext.agg(F.max_by("vix", "day").alias("last"))
    return hit.crossJoin(F.broadcast(last)).select("symbol", "day", snap(F.coalesce("hit.vix", "last"), 4).alias("vix"))  # one row


@register("nearest_regime", with_views("trades", "regimes") + """, g as (select as_of_day, max_by(vol_regime, signal_id) as vol_regime from regimes group by 1), d as (select distinct entry_day from trades),
n as (select d.entry_day, arg_min(vol_regime, (abs(as_of_day - entry_day), as_of_day)) as vol_regime from d cross join g group by 1)
select t.strategy, n.vol_regime, count(*) as n from trades t join n on t.entry_day = n.entry_day group by 1, 2""")
def nearest_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Regimes by the nearest day, as for trades whose signal is not known."""
    by_day = views.regimes(spark, sf).groupBy(F.col("as_of_day").alias("entry_day")).agg(F.max_by("vol_regime", "signal_id").alias("vol_regime"))
    t = views.trades(spark, sf)
    near = asof.nearest(t.select("entry_day").distinct(), by_day, ["vol_regime"], [], "entry_day").select("entry_day", F.col("near.vol_regime").alias("vol_regime"))
    return t.join(near, "entry_day").groupBy("strategy", "vol_regime").agg(F.count("*").alias("n"))


@register("day_sets", with_views("daily", "ext_daily") + ", a as (select distinct day from daily), b as (select day from ext_daily), c as (select 'both' as part, day from (select day from a intersect select day from b) union all select 'tape_only', day from (select day from a except select day from b) union all select 'index_only', day from (select day from b except select day from a)) select part, count(*) as n, min(day) as first_day from c group by part")
def day_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = views.daily(spark, sf).select("day").distinct(), views.ext_daily(spark, sf).select("day")
    part = lambda n, df: df.select(F.lit(n).alias("part"), "day")
    c = part("both", a.intersect(b)).unionByName(part("tape_only", a.subtract(b))).unionByName(part("index_only", b.subtract(a)))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


POINTS = RETURNS + """, p as (select symbol || '-' || cast(isodow(day) as varchar) as id, avg(ret) * 100 as x, stddev_pop(ret) * 10 as y from r where ret is not null group by 1),
d as (select a.id as i, b.id as j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from p a cross join p b), m as (select quantile_cont(d, 0.5) as mid from d where i < j)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread of returns of each symbol and weekday: a few dozen points, however long the series."""
    day = F.concat("symbol", F.lit("-"), (F.weekday("day") + 1).cast("string"))
    return returns(spark, sf).where("ret is not null").groupBy(day.alias("id")).agg((F.avg("ret") * 100).alias("x"), (F.stddev_pop("ret") * 10).alias("y"))


def distances(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return p.toDF("i", "xi", "yi").crossJoin(F.broadcast(p.toDF("j", "xj", "yj"))).select("i", "j", F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)).alias("d"))


@register("gram_rbf", POINTS + f", k as (select i, j, exp(-d * d / (2 * pow(mid / sqrt(2 * ln(2.0::double)), 2) + 1e-12)) as k from d cross join m) select i, j, {s('k', 5)} as k, {s('k - avg(k) over (partition by i) - avg(k) over (partition by j) + avg(k) over ()', 5)} as centred from k")
def gram_rbf(spark: SparkSession, sf: str) -> DataFrame:
    """The Gram matrix of a Gaussian kernel with the median heuristic, and its centred form."""
    d = distances(spark, sf)
    mid = d.where("i < j").agg(F.percentile("d", 0.5).alias("mid"))
    k = d.crossJoin(F.broadcast(mid)).withColumn("k", F.exp(-F.col("d") * F.col("d") / (2 * F.pow(F.col("mid") / F.sqrt(2 * F.log(F.lit(2.0))), 2) + 1e-12)))
    by_i, by_j = k.groupBy("i").agg(F.avg("k").alias("ki")), k.groupBy("j").agg(F.avg("k").alias("kj"))
    c = k.join(F.broadcast(by_i), "i").join(F.broadcast(by_j), "j").crossJoin(F.broadcast(k.agg(F.avg("k").alias("ka"))))  # a row a point
    return c.select("i", "j", snap(F.col("k"), 5).alias("k"), snap(F.col("k") - F.col("ki") - F.col("kj") + F.col("ka"), 5).alias("centred"))


@register("gram_matern", POINTS + f", k as (select i, j, (1 + sqrt(3.0::double) * d) * exp(-sqrt(3.0::double) * d) as m3, (1 + sqrt(5.0::double) * d + 5 * d * d / 3) * exp(-sqrt(5.0::double) * d) as m5, pow(1 + d * d / 2, -1) as rq from d) select i, j, {s('m3', 5)} as m3, {s('m5', 5)} as m5, {s('rq', 5)} as rq, {s('0.5 * m3 + 0.5 * rq', 5)} as combined, {s('m3 * rq', 5)} as product from k")
def gram_matern(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("d")
    k = distances(spark, sf).select("i", "j", learning.matern(d, 1.5, 1.0).alias("m3"), learning.matern(d, 2.5, 1.0).alias("m5"), F.pow(1 + d * d / 2, -1).alias("rq"))
    return snapped(k, "i", "j", digits=5, m3="m3", m5="m5", rq="rq", combined=0.5 * F.col("m3") + 0.5 * F.col("rq"), product=F.col("m3") * F.col("rq"))


@register("portfolio_rollup", with_views("trades") + """, n as (select strategy, pnl_pct, row_number() over (partition by strategy order by exit_day desc, signal_id desc) as nth from trades),
w as (select strategy, avg(case when pnl_pct > 0 then 1.0 else 0.0 end) as wr from n where nth <= 20 group by 1), cfg as (select distinct o_orderpriority as strategy from orders union select 'unused'),
st as (select cfg.strategy, case when wr is null then 'NO_TRADES' when wr < 0.4 then 'CRITICAL' when wr < 0.5 then 'WARNING' else 'HEALTHY' end as status from cfg left join w on cfg.strategy = w.strategy)
select status, count(*) as n, min(strategy) as first_strategy from st group by 1""")
def portfolio_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies of the configuration, those without trades too, by status."""
    t = views.trades(spark, sf).withColumn("nth", F.row_number().over(ordered(["strategy"], [F.desc("exit_day"), F.desc("signal_id")]))).where("nth <= 20")
    w = t.groupBy("strategy").agg(F.avg((F.col("pnl_pct") > 0).cast("double")).alias("wr"))
    cfg = views.load(spark, sf, "orders").select(F.col("o_orderpriority").alias("strategy")).distinct().union(spark.createDataFrame([("unused",)], "strategy string"))
    status = F.when(F.col("wr").isNull(), "NO_TRADES").when(F.col("wr") < 0.4, "CRITICAL").when(F.col("wr") < 0.5, "WARNING").otherwise("HEALTHY")
    return cfg.join(w, "strategy", "left").withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"), F.min("strategy").alias("first_strategy"))


@register("size_gate", "with " + RESET_BARS + f""", v as (select symbol, bar_id, abs(buy_volume - sell_volume) / volume as x from bar)
select symbol, bar_id, {s('1 - 0.5 * (x - min(x) over w) / (max(x) over w - min(x) over w + 1e-12)')} as gate from v window w as (partition by symbol order by bar_id rows unbounded preceding)""")
def size_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Smaller positions as order flow gets one-sided, by the range so far."""
    b = bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts")).withColumn("x", F.abs(F.col("buy_volume") - F.col("sell_volume")) / F.col("volume"))
    f = frame(KEYS, ["bar_id"], None, 0)
    return snapped(b, "symbol", "bar_id", gate=1 - 0.5 * (F.col("x") - F.min("x").over(f)) / (F.max("x").over(f) - F.min("x").over(f) + 1e-12))


@register("downside_ratio", RETURNS + f" select symbol, {s('avg(ret) / stddev_pop(ret) filter (where ret < 0) * sqrt(252.0::double)', 4)} as sortino_negative, {s('avg(ret) / sqrt(avg(pow(least(ret, 0.0), 2))) * sqrt(252.0::double)', 4)} as sortino_all from r where ret is not null group by symbol")
def downside_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Both forms of the downside ratio in use: by the spread of losses alone, and by the semideviation of all rows."""
    r, x = returns(spark, sf).where("ret is not null"), F.col("ret")
    year = F.sqrt(F.lit(252.0))
    return r.groupBy("symbol").agg(
        snap(F.avg(x) / F.stddev_pop(F.when(x < 0, x)) * year, 4).alias("sortino_negative"), snap(F.avg(x) / F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))) * year, 4).alias("sortino_all")
    )


@register("dominant_horizon", RETURNS + f""", h as (select symbol, day, abs(sum(ret) over {rows(-5, -1)}) / sqrt(5.0::double) as h5, abs(sum(ret) over {rows(-20, -1)}) / sqrt(20.0::double) as h20, abs(sum(ret) over {rows(-60, -1)}) / sqrt(60.0::double) as h60 from r)
select symbol, day, case when h5 >= h20 and h5 >= h60 then '5d' when h20 >= h60 then '20d' else '60d' end as horizon, {s('greatest(h5, h20, h60)')} as strength from h where h5 is not null""")
def dominant_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Which span of past returns moved most for its length."""
    r = returns(spark, sf)
    h = r.select("symbol", "day", *((F.abs(F.sum("ret").over(frame(KEYS, DAY, -k, -1))) / F.sqrt(F.lit(float(k)))).alias(f"h{k}") for k in (5, 20, 60))).where("h5 is not null")
    pick = F.when((F.col("h5") >= F.col("h20")) & (F.col("h5") >= F.col("h60")), "5d").when(F.col("h20") >= F.col("h60"), "20d").otherwise("60d")
    return h.select("symbol", "day", pick.alias("horizon"), snap(F.greatest("h5", "h20", "h60")).alias("strength"))


@register("path_fan")
def path_fan(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles at every step over 1,000 paths of blocks of 20 trades, by strategy."""
    return resampling.fan(views.trades(spark, sf), ["strategy"], ["exit_day", "signal_id"], "pnl_pct", 1000, 20)
