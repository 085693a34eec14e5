"""Registered queries of recursions that run as scans by composition, and of fractional orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, month_number, snap
from causeway.operators import rolling, signals, stacking
from causeway.plans.market import DAY, rows
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, sql_snap as s, with_views

NTH = with_views("daily").replace("with ", "with recursive ", 1) + """,
d as materialized (select *, row_number() over (partition by symbol order by day) as n from daily)"""


@register("exponential_mean", NTH + f""",
e as (select symbol, n, close as fast, close as slow from d where n = 1 union all
  select d.symbol, d.n, e.fast + 2.0::double / 21 * (d.close - e.fast), e.slow + 2.0::double / 61 * (d.close - e.slow) from e join d on d.symbol = e.symbol and d.n = e.n + 1)
select d.symbol, day, {s('fast', 4)} as fast, {s('slow', 4)} as slow, {s('fast / (slow + 1e-8) - 1')} as ratio from e join d on d.symbol = e.symbol and d.n = e.n""")
def exponential_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Means of spans of 20 and 60 days of the close, and their ratio; a symbol is a task a year."""
    got = views.daily(spark, sf)
    for name, span in (("fast", 20), ("slow", 60)):
        got = rolling.ema(got, "close", KEYS, DAY, span, name, F.year("day"))
    ratio = F.col("fast") / (F.col("slow") + 1e-8) - 1
    return got.select("symbol", "day", snap(F.col("fast"), 4).alias("fast"), snap(F.col("slow"), 4).alias("slow"), snap(ratio).alias("ratio"))


@register("known_noise_filter", NTH + f""",
q as materialized (select symbol, day, n, close as x, coalesce(var_pop(close) over {rows(-20, -1)}, 1.0::double) + 1.0 as r from d),
k as (select symbol, n, x, cast((1 + 0.5) * r / (1 + 0.5 + r) as double) as p, cast((1 + 0.5) / (1 + 0.5 + r) as double) as gain from q where n = 1 union all
  select q.symbol, q.n, k.x + (k.p + 0.5) / (k.p + 0.5 + q.r) * (q.x - k.x), (k.p + 0.5) * q.r / (k.p + 0.5 + q.r), (k.p + 0.5) / (k.p + 0.5 + q.r) from k join q on q.symbol = k.symbol and q.n = k.n + 1)
select k.symbol, day, {s('k.x', 4)} as filtered, {s('gain')} as gain from k join q on q.symbol = k.symbol and q.n = k.n""")
def known_noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A random-walk filter of the close whose noise is the variance of the 20 days before; a symbol is a task a month."""
    r = F.coalesce(F.var_pop("close").over(frame(KEYS, DAY, -20, -1)), F.lit(1.0)) + 1.0
    d = views.daily(spark, sf).select("symbol", "day", "close", r.alias("r"), F.lit(0.5).alias("q"))
    got = signals.kalman_known(d, "close", "q", "r", KEYS, DAY, month_number("day"))
    return got.select("symbol", "day", snap(F.col("filtered"), 4).alias("filtered"), snap(F.col("gain")).alias("gain"))


WEIGHTS = ", ".join(
    f"({d}::double, [{', '.join(f'{w!r}::double' for w in reversed((rolling.fractional_weights(d) + [0.0] * 63)[:63]))}])" for d in stacking.ORDERS
)
SWEEP = with_views("daily") + f""", w(d, weights) as (values {WEIGHTS}),
x as (select symbol, day, list(ln(close)) over (partition by symbol order by day rows 62 preceding) as xs from daily),
v as (select symbol, day, d, list_inner_product(xs, weights) as v from x cross join w where len(xs) = 63),
a as (select symbol, d, day, v - lag(v) over o as dx, lag(v) over o as x1 from v window o as (partition by symbol, d order by day)),
b as (select *, lag(dx) over (partition by symbol, d order by day) as x2 from a),
m as (select symbol, d, count(*) as n, var_pop(dx) as syy, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, dx) as s1y, covar_pop(x2, dx) as s2y from b where dx is not null and x2 is not null group by 1, 2),
c as (select *, s11 * s22 - s12 * s12 as det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from m),
t as (select symbol, d, n + 2 as n, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) as t from c where det > 1e-18 and n >= 28),
p as (select *, case when t <= -3.43 then 0.005::double when t <= -2.86 then 0.01 + (t + 3.43) / 0.57 * 0.04 when t <= -2.57 then 0.05 + (t + 2.86) / 0.29 * 0.05 else least(0.1 + abs(t + 2.57) * (0.9::double / 1.57), 1.0::double) end as p from t)"""


@register("fractional_order_sweep", SWEEP + f" select symbol, d, n, {s('t', 4)} as t, {s('p', 4)} as p from p")
def fractional_order_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The unit-root test of log closes differenced by each of 19 orders."""
    x = views.daily(spark, sf).withColumn("x", F.log("close"))
    return stacking.order_sweep(x, "x", KEYS, DAY).select("symbol", "d", "n", snap(F.col("t"), 4).alias("t"), snap(F.col("p"), 4).alias("p"))


@register("least_fractional_order", SWEEP + """ select s.symbol, coalesce(min(p.d) filter (where p.p < 0.05), 0.5::double) as d from (select distinct symbol from daily) s left join p on s.symbol = p.symbol group by 1""")
def least_fractional_order(spark: SparkSession, sf: str) -> DataFrame:
    """The least order by symbol whose differences have no unit root."""
    return stacking.least_order(views.daily(spark, sf).withColumn("x", F.log("close")), "x", KEYS, DAY)
