"""Registered queries of state machines over scores, further bars and windows, and slices of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, month_number, ordered, signed, snap
from causeway.operators import bars, rolling, signals
from causeway.plans.market import BAR_C, DAY, RESET, RESET_BARS, RETURNS, returns, rows, snapped
from causeway.plans.portfolio import kalman_sql
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, sql_snap as s, with_views

WARM_UP = 120  # days

SCORED = RETURNS.replace("with ", "with recursive ", 1) + f""",
z as materialized (select symbol, day, row_number() over (partition by symbol order by day) as n,
  {s(f"case when count(ret) over {rows(-20, -1)} = 20 then case when stddev_pop(ret) over {rows(-20, -1)} > 1e-12 then (ret - avg(ret) over {rows(-20, -1)}) / stddev_pop(ret) over {rows(-20, -1)} else 0.0::double end end")} as score,
  {s(f"1 / (1 + exp(-5 * coalesce(sum(ret) over {rows(-19, 0)}, 0.0::double)))")} as gate from r),
b as materialized (select *, 2.0 * (1 - w) + 0.75 * w as far, 0.75 * (1 - w) + 0.25 * w as near from (select *, least(greatest((gate - 0.5) / (0.5 + 1e-8), 0.0::double), 1.0::double) as w from z))"""
WANTED = "case when abs(score) > far then -sign(score) * least(abs(score) / far, 1.0::double) else 0.0::double end"
STEP = f"case when score is null then was when was <> 0 and abs(score) < near then 0.0::double when was = 0 or {WANTED} * was < 0 then {WANTED} else was end"


@register("hysteresis_positions", SCORED + f""",
p as (select symbol, n, cast({STEP} as double) as pos from (select *, 0.0::double as was from b where n = 1)
  union all select symbol, n, cast({STEP} as double) from (select b.*, p.pos as was from p join b on b.symbol = p.symbol and b.n = p.n + 1))
select b.symbol, day, score, {s('pos')} as position, case when day < min(day) over (partition by b.symbol) + {WARM_UP} then 0.0::double else {s('pos')} end as traded from b join p on b.symbol = p.symbol and b.n = p.n""")
def hysteresis_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reversion against a score of returns, with thresholds by a trend gate, flat in the first days."""
    r = returns(spark, sf)
    trend = F.coalesce(F.sum("ret").over(frame(KEYS, DAY, -19, 0)), F.lit(0.0))
    z = r.select("symbol", "day", snap(signals.score_of("ret", KEYS, DAY, 20)).alias("score"), snap(1 / (1 + F.exp(-5 * trend))).alias("gate"))
    p = signals.positions(z, "score", KEYS, DAY, gate="gate", block=F.year("day")).withColumn("position", snap(F.col("position")))
    return p.select("symbol", "day", "score", "position", signals.flat_at_first("position", KEYS, "day", WARM_UP).alias("traded"))


CALM = RETURNS.replace("with ", "with recursive ", 1) + f""",
v as (select symbol, day, ret, row_number() over (partition by symbol order by day) as n, case when count(ret) over {rows(-19, 0)} = 20 then stddev_pop(ret) over {rows(-19, 0)} end as vol, coalesce(sign(sum(ret) over {rows(-19, 0)}), 0) as dir from r),
z as materialized (select *, cast(coalesce({s(f"case when count(vol) over {rows(-100, -1)} = 100 then case when stddev_pop(vol) over {rows(-100, -1)} > 1e-12 then (vol - avg(vol) over {rows(-100, -1)}) / stddev_pop(vol) over {rows(-100, -1)} else 0.0::double end end")}, 0.0::double) as double) as score,
  case when vol is null then 1.0::double else least(2.0::double, greatest(0.25::double, quantile_cont(vol, 0.5) over {rows(-251, 0)} / (vol + 1e-8))) end as scale from v)"""
CALM_STEP = "case when held then case when score > 0.5 then 0.0::double when dir <> 0 then dir else was end else case when score < -0.5 then dir else 0.0::double end end"


@register("regime_positions", CALM + f""",
p as (select symbol, n, cast({CALM_STEP} as double) as pos, cast({CALM_STEP} as double) <> 0 as held from (select *, 0.0::double as was, false as held from z where n = 1)
  union all select symbol, n, cast({CALM_STEP} as double), cast({CALM_STEP} as double) <> 0 from (select z.*, p.pos as was, p.held as held from p join z on z.symbol = p.symbol and z.n = p.n + 1))
select z.symbol, day, score, pos as position, case when day < min(day) over (partition by z.symbol) + {WARM_UP} then 0.0::double else {s('pos * scale')} end as sized from z join p on z.symbol = p.symbol and z.n = p.n""")
def regime_positions(spark: SparkSession, sf: str) -> DataFrame:
    """In the direction of momentum while volatility is low, sized by the inverse of volatility, flat in the first days."""
    f = frame(KEYS, DAY, -19, 0)
    v = returns(spark, sf).select(
        "symbol", "day", F.when(F.count("ret").over(f) == 20, F.stddev_pop("ret").over(f)).alias("vol"), F.coalesce(F.signum(F.sum("ret").over(f)), F.lit(0.0)).alias("dir")
    )
    mid = F.percentile("vol", 0.5).over(frame(KEYS, DAY, -251, 0))
    scale = F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.25), mid / (F.col("vol") + 1e-8))), F.lit(1.0))
    v = v.withColumn("score", F.coalesce(snap(signals.score_of("vol", KEYS, DAY, 100)), F.lit(0.0)))
    v = v.withColumn("scale", F.when(F.col("vol").isNull(), 1.0).otherwise(scale))
    p = signals.regime_positions(v, "score", "dir", KEYS, DAY, block=F.year("day")).withColumn("at_size", snap(F.col("position") * F.col("scale")))
    return p.select("symbol", "day", "score", "position", signals.flat_at_first("at_size", KEYS, "day", WARM_UP).alias("sized"))


VOLATILITY = RETURNS.replace("with ", "with recursive ", 1) + f""",
v as (select symbol, day, case when count(ret) over {rows(-19, 0)} = 20 then ln(stddev_pop(ret) over {rows(-19, 0)} + 1e-8) end as x from r), w as (select * from v where x is not null),""" + kalman_sql("w", "x") + f""",
d as materialized (select *, coalesce(f - lag(f) over (partition by symbol order by n), 0.0::double) as step from z),
e as (select symbol, n, step as slope from d where n = 1 union all select d.symbol, d.n, e.slope + 2.0::double / 11 * (d.step - e.slope) from e join d on d.symbol = e.symbol and d.n = e.n + 1),
y as materialized (select d.symbol, day, d.n, coalesce(score, 0.0::double) as score, cast(-sign({s('slope', 10)}) as double) as dir,
  least(2.0::double, greatest(0.25::double, quantile_cont(exp(f), 0.5) over (partition by d.symbol order by d.n rows between 251 preceding and current row) / (exp(f) + 1e-8))) as scale from d join e on d.symbol = e.symbol and d.n = e.n),
p as (select symbol, n, cast({CALM_STEP} as double) as pos, cast({CALM_STEP} as double) <> 0 as held from (select *, 0.0::double as was, false as held from y where n = 1)
  union all select symbol, n, cast({CALM_STEP} as double), cast({CALM_STEP} as double) <> 0 from (select y.*, p.pos as was, p.held as held from p join y on y.symbol = p.symbol and y.n = p.n + 1))"""


@register("volatility_positions", VOLATILITY + f""" select y.symbol, day, score, dir, pos as position, {s('pos * scale')} as sized from y join p on y.symbol = p.symbol and y.n = p.n""")
def volatility_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Long while filtered volatility falls and short while it rises, as long as it is low; sized by its median over it.

    The volatility of 20 days is filtered in logs; its steps are smoothed over ten rows. The median is that of the last year.
    """
    f = frame(KEYS, DAY, -19, 0)
    v = returns(spark, sf).withColumn("x", F.when(F.count("ret").over(f) == 20, F.log(F.stddev_pop("ret").over(f) + 1e-8)))
    k = signals.kalman(v.where("x is not null").select("symbol", "day", "x"), "x", KEYS, DAY)
    k = k.withColumn("score", F.coalesce(snap(signals.score_of("filtered", KEYS, DAY, 100)), F.lit(0.0))).withColumn("step", rolling.diff("filtered", KEYS, DAY))
    level = F.exp("filtered")
    scale = F.least(F.lit(2.0), F.greatest(F.lit(0.25), F.percentile(level, 0.5).over(frame(KEYS, DAY, -251, 0)) / (level + 1e-8)))
    k = rolling.ema(k.withColumn("scale", scale), "step", KEYS, DAY, 10, "slope", F.year("day")).withColumn("dir", F.lit(0.0) - F.signum(snap(F.col("slope"), 10)))
    p = signals.regime_positions(k, "score", "dir", KEYS, DAY, block=F.year("day"))
    return p.select("symbol", "day", "score", "dir", "position", snap(F.col("position") * F.col("scale")).alias("sized"))


@register("end_of_day_positions", "with " + RESET_BARS + f""", b as (select symbol, bar_id, close_seq, cast(sign(bar_return) as double) as pos from bar),
d as (select b.symbol, t.day, max_by(pos, bar_id) as position, count(*) as n_bars from b join tape t on t.symbol = b.symbol and t.seq = b.close_seq group by 1, 2)
select symbol, day, position, n_bars from d""")
def end_of_day_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The position of each day's last bar."""
    t = views.tape(spark, sf)
    b = bars.reset_bars(t, BAR_C, month_number("ts")).select("symbol", "bar_id", F.col("close_seq").alias("seq"), F.signum("bar_return").alias("pos"))
    j = b.join(t.select("symbol", "seq", "day"), ["symbol", "seq"])
    return j.groupBy("symbol", "day").agg(F.max_by("pos", "bar_id").alias("position"), F.count("*").alias("n_bars"))


BAR_ROWS = "(partition by symbol order by bar_id rows between 19 preceding and current row)"


@register("relative_volume", "with " + RESET_BARS + f""" select symbol, bar_id, {s(f'volume / (avg(volume) over {BAR_ROWS} + 1e-8)')} as relative_volume,
  {s('coalesce(close - lag(close) over (partition by symbol order by bar_id), 0.0::double)')} as d_close from bar""")
def relative_volume(spark: SparkSession, sf: str) -> DataFrame:
    """A bar's volume over the mean of the last 20 bars, and the change of its close."""
    b = bars.reset_bars(views.tape(spark, sf), BAR_C, month_number("ts"))
    mean = F.avg("volume").over(frame(KEYS, ["bar_id"], -19, 0))
    change = F.coalesce(F.col("close") - F.lag("close").over(ordered(KEYS, ["bar_id"])), F.lit(0.0))
    return snapped(b, "symbol", "bar_id", relative_volume=F.col("volume") / (mean + 1e-8), d_close=change)


@register("bars_by_absolute_size", "with " + RESET + f""",
ends as (select symbol, bar_id, seq as close_seq, coalesce(lag(seq) over (partition by symbol order by bar_id), 0) + 1 as open_seq from jump)
select t.symbol, bar_id, count(*) as n_trades, cast(sum(notional_c) as bigint) as value_c, sum(case side when 'A' then size when 'B' then -size else 0.0 end) as flow
from tape t join ends e on t.symbol = e.symbol and t.seq between e.open_seq and e.close_seq group by 1, 2""")
def bars_by_absolute_size(spark: SparkSession, sf: str) -> DataFrame:
    """Reset bars of a tape whose sizes carry the side as their sign: value counts by absolute size, and the flow is summed."""
    t = views.tape(spark, sf).withColumn("size", signed(F.col("side"), F.col("size")))
    b = bars.reset_bar_ids(t.withColumn("notional_c", F.abs("notional_c")), BAR_C, month_number("ts")).where("bar_id is not null")
    return b.groupBy("symbol", "bar_id").agg(F.count("*").alias("n_trades"), F.sum("notional_c").alias("value_c"), F.sum("size").alias("flow"))


@register("arrivals_in_window", with_views("tape_ev") + f""", e as (select symbol, us // 300000000 as w, us from tape_ev),
g as (select *, us - lag(us) over (partition by symbol, w order by us) as gap from e),
a as (select symbol, w, count(*) as n, coalesce(avg(gap / 1e6), 0.0::double) as mean_gap from g group by 1, 2)
select symbol, cast(w as bigint) as win, n, {s('mean_gap')} as mean_gap, {s('case when n > 1 then n / (mean_gap + 1e-8) else 0.0::double end', 4)} as burst from a""")
def arrivals_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean gap and burst ratio of each window of 300 seconds, from gaps between its own events only."""
    e = views.tape_ev(spark, sf).select("symbol", F.expr("us div 300000000").alias("win"), "us")
    g = e.withColumn("gap", F.col("us") - F.lag("us").over(ordered(["symbol", "win"], ["us"])))
    a = g.groupBy("symbol", "win").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("gap") / 1e6), F.lit(0.0)).alias("mean_gap"))
    burst = F.when(F.col("n") > 1, F.col("n") / (F.col("mean_gap") + 1e-8)).otherwise(0.0)
    return a.select("symbol", "win", "n", snap(F.col("mean_gap")).alias("mean_gap"), snap(burst, 4).alias("burst"))


#: A vector's parts (first, last), as tone, topic and uncertainty.
PARTS = {"tone": (1, 21), "topic": (22, 42), "uncertainty": (43, 64)}


@register("embedding_slices", "with p as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings) select vec_id, "
    + "case " + " ".join(f"when i <= {hi} then '{n}'" for n, (_, hi) in PARTS.items()) + f" end as part, count(*) as dims, {s('sqrt(sum(cast(v as double) * v))')} as norm, {s('avg(cast(v as double))')} as mean from p where i <= 64 group by 1, 2")
def embedding_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The three slices of each vector, with their length and mean."""
    v = F.col("embedding").cast("array<double>")
    e = views.load(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.slice(v, lo, hi - lo + 1).alias("x")) for n, (lo, hi) in PARTS.items()))).alias("s"))
    total = lambda f: F.aggregate("s.x", F.lit(0.0), lambda a, b: a + f(b))
    return e.select(
        "vec_id", F.col("s.part").alias("part"), F.size("s.x").cast("long").alias("dims"), snap(F.sqrt(total(lambda b: b * b))).alias("norm"), snap(total(lambda b: b) / F.size("s.x")).alias("mean")
    ).where("dims > 0")


BY_LABEL = "(partition by label order by vec_id rows between {} preceding and current row)"


@register("embedding_score", f"""with p as (select label, vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as v from embeddings),
m as (select *, avg(v) over (partition by label, i order by vec_id rows between 99 preceding and current row) as mean from p),
d as (select label, vec_id, {s('sqrt(sum((v - mean) * (v - mean)))')} as distance from m group by 1, 2),
z as (select *, row_number() over (partition by label order by vec_id) as n, avg(distance) over {BY_LABEL.format(500)} as mu, stddev_pop(distance) over {BY_LABEL.format(500)} as sd from d),
f as (select *, case when n > 100 then case when sd > 1e-12 then (distance - mu) / sd else 0.0::double end end as score, 1.959963984540054::double / sqrt(least(n, 500)) as half from z)
select label, vec_id, distance, {s('score')} as score, {s('score - half')} as low, {s('score + half')} as high from f""")
def embedding_score(spark: SparkSession, sf: str) -> DataFrame:
    """Distance from the mean embedding of the last 100 vectors, its score against the last 501 rows, and a band of 95 %."""
    e = views.load(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    m = e.withColumn("gap", F.col("v") - F.avg("v").over(frame(["label", "i"], ["vec_id"], -99, 0)))
    d = m.groupBy("label", "vec_id").agg(snap(F.sqrt(F.sum(F.col("gap") * F.col("gap")))).alias("distance"))
    f, n = frame(["label"], ["vec_id"], -500, 0), rolling.nth(["label"], ["vec_id"])
    sd = F.stddev_pop("distance").over(f)
    score = F.when(sd > 1e-12, (F.col("distance") - F.avg("distance").over(f)) / sd).otherwise(0.0)
    z = d.withColumn("n", n).withColumn("score", F.when(F.col("n") > 100, score)).withColumn("half", F.lit(1.959963984540054) / F.sqrt(F.least("n", F.lit(500))))
    return z.select("label", "vec_id", "distance", snap(F.col("score")).alias("score"), snap(F.col("score") - F.col("half")).alias("low"), snap(F.col("score") + F.col("half")).alias("high"))
