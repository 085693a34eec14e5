"""Registered queries of the learning, validation and streaming parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import frame, ordered, snap
from causeway.functions.tables import shared_folder, written
from causeway.operators import bars, learning, nested, rolling, signals, stacking, staged, validation
from causeway.plans.market import BAR_C, DAY, RETURNS, U, returns, rows, snapped
from causeway.plans.registry import register
from causeway.sources import views
from causeway.sources.views import KEYS, sql_snap as s, with_views
from causeway.streaming import folds

FEATURES = ["z", "mom5", "vol"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Causal features of a day and the next day's return, by symbol."""
    r = returns(spark, sf).withColumn("x", F.coalesce("ret", F.lit(0.0)))
    w = ordered(KEYS, DAY)
    return r.select(
        "symbol", "day", rolling.causal_z("x", KEYS, DAY).alias("z"), F.coalesce(F.sum("x").over(frame(KEYS, DAY, -5, -1)), F.lit(0.0)).alias("mom5"),
        F.coalesce(F.stddev_pop("x").over(frame(KEYS, DAY, -20, -1)), F.lit(0.0)).alias("vol"), F.coalesce(F.lead("ret").over(w), F.lit(0.0)).alias("y"),
    )


@register("decay_weights", with_views("daily") + f""", n as (select symbol, day, row_number() over (partition by symbol order by day) - 1 as nth, count(*) over (partition by symbol) as n from daily)
select symbol, day, {s('exp(-ln(2.0::double) / 250 * (n - 1 - nth))')} as weight from n""")
def decay_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = views.daily(spark, sf).withColumn("nth", F.row_number().over(ordered(KEYS, DAY)) - 1).withColumn("n", F.count("*").over(frame(KEYS, DAY, None, None)))
    return snapped(d, "symbol", "day", weight=learning.decay_weight(F.col("nth"), F.col("n"), 250.0))


SPLITS = with_views("daily") + """, n as (select symbol, day, row_number() over (partition by symbol order by day) - 1 as nth, count(*) over (partition by symbol) as n from daily)"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily(spark, sf).select(
        "symbol", "day", (F.row_number().over(ordered(KEYS, DAY)) - 1).cast("long").alias("nth"), F.count("*").over(frame(KEYS, DAY, None, None)).alias("n")
    )


@register("walk_forward_splits", SPLITS + """, b as (select symbol, n, unnest(range(0, 5)) as k, (n - 65) // 5 as size from (select distinct symbol, n from n) where n > 70)
select b.symbol, cast(k as integer) as split, 65 + k * size as test_start, 65 + (k + 1) * size as test_end, count(*) filter (where nth < 65 + k * size - 5) as n_train,
  count(*) filter (where nth >= 65 + k * size and nth < 65 + (k + 1) * size) as n_test from b join n on b.symbol = n.symbol group by b.symbol, k, size""")
def walk_forward_splits(spark: SparkSession, sf: str) -> DataFrame:
    n = numbered(spark, sf)
    size = F.floor((F.col("n") - 65) / 5).cast("long")
    b = n.select("symbol", "n").distinct().where("n > 70").select("symbol", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split"))
    b = b.withColumn("test_start", 65 + F.col("split") * F.col("size")).withColumn("test_end", F.col("test_start") + F.col("size"))
    j = n.select("symbol", "nth").join(F.broadcast(b), "symbol")  # five rows a symbol
    return j.groupBy("symbol", "split", "test_start", "test_end").agg(
        F.count_if(F.col("nth") < F.col("test_start") - 5).alias("n_train"), F.count_if((F.col("nth") >= F.col("test_start")) & (F.col("nth") < F.col("test_end"))).alias("n_test")
    )


@register("purged_folds", SPLITS + """, f as (select *, least(nth // (n // 5), 5) as fold from n where n >= 50)
select f.symbol, cast(k as integer) as fold, count(*) filter (where fold = k) as n_test, count(*) filter (where nth < k * (n // 5) - 5 or nth >= (k + 1) * (n // 5) + 5) as n_train
from f cross join (select unnest(range(0, 5)) as k) group by f.symbol, k""")
def purged_folds(spark: SparkSession, sf: str) -> DataFrame:
    n = numbered(spark, sf).where("n >= 50").withColumn("size", F.floor(F.col("n") / 5)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    lo, hi = F.col("fold") * F.col("size"), (F.col("fold") + 1) * F.col("size")
    return n.groupBy("symbol", "fold").agg(
        F.count_if((F.col("nth") >= lo) & (F.col("nth") < hi)).alias("n_test"), F.count_if((F.col("nth") < lo - 5) | (F.col("nth") >= hi + 5)).alias("n_train")
    )


@register("overfit_probability", RETURNS + f""", g as (select symbol, day, ret, (row_number() over (partition by symbol order by day) - 1) * 6 // count(*) over (partition by symbol) as grp from r where ret is not null),
m as (select symbol, cast(grp as integer) as grp, avg(ret) as score from g group by 1, 2),
c as (select a.g as g1, b.g as g2 from (select unnest(range(0, 6)) as g) a join (select unnest(range(0, 6)) as g) b on a.g < b.g),
x as (select g1, g2, symbol, avg(score) filter (where grp not in (g1, g2)) as ins, avg(score) filter (where grp in (g1, g2)) as oos from m cross join c group by 1, 2, 3),
b as (select g1, g2, arg_max(symbol, (ins, symbol)) as best, arg_max(oos, (ins, symbol)) as oos, quantile_cont(oos, 0.5) as mid from x group by 1, 2)
select cast(g1 as integer) as g1, cast(g2 as integer) as g2, best, {s('oos')} as oos, oos <= mid as overfit from b""")
def overfit_probability(spark: SparkSession, sf: str) -> DataFrame:
    """For each choice of two test groups of six: the best symbol in sample, and whether it is at most the median out of it."""
    r = returns(spark, sf).where("ret is not null")
    grp = F.floor((F.row_number().over(ordered(KEYS, DAY)) - 1) * 6 / F.count("*").over(frame(KEYS, DAY, None, None))).cast("int")
    m = r.withColumn("grp", grp).groupBy("symbol", "grp").agg(F.avg("ret").alias("score"))
    pairs = F.array(*(F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in learning.combinatorial_folds(6, 2)))
    x = m.select("symbol", "grp", "score", F.explode(pairs).alias("p")).select("symbol", "grp", "score", "p.*")
    test = (F.col("grp") == F.col("g1")) | (F.col("grp") == F.col("g2"))
    x = x.groupBy("g1", "g2", "symbol").agg(F.avg(F.when(~test, F.col("score"))).alias("ins"), F.avg(F.when(test, F.col("score"))).alias("oos"))
    b = x.groupBy("g1", "g2").agg(F.max_by(F.struct("symbol", "oos"), F.struct("ins", "symbol")).alias("best"), F.percentile("oos", 0.5).alias("mid"))
    return b.select("g1", "g2", F.col("best.symbol").alias("best"), snap(F.col("best.oos")).alias("oos"), (F.col("best.oos") <= F.col("mid")).alias("overfit"))


@register("prediction_metrics", RETURNS + f""", l as (select symbol, ret as y, lag(ret) over (partition by symbol order by day) * 0.1 as p from r),
f as (select symbol, y, p from l where y is not null and p is not null), m as (select symbol, avg(y) as my from f group by 1)
select f.symbol, {s('avg(pow(y - p, 2))')} as mse, {s('1 - sum(pow(y - p, 2)) / sum(pow(y - my, 2))', 4)} as r2, {s('0.5 * ln(2 * pi() * greatest(avg(pow(y - p, 2)), 1e-10)) + 0.5', 4)} as nll, {s('corr(p, y)')} as corr, {s('corr(p, abs(y))')} as corr_abs
from f join m on f.symbol = m.symbol group by f.symbol""")
def prediction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    f = returns(spark, sf).select("symbol", F.col("ret").alias("y"), (F.lag("ret").over(ordered(KEYS, DAY)) * 0.1).alias("p")).where("y is not null and p is not null")
    gap = F.pow(F.col("y") - F.col("p"), 2)
    return f.groupBy("symbol").agg(
        snap(F.avg(gap)).alias("mse"), snap(1 - F.sum(gap) / (F.var_pop("y") * F.count("*")), 4).alias("r2"),
        snap(0.5 * F.log(2 * F.pi() * F.greatest(F.avg(gap), F.lit(1e-10))) + 0.5, 4).alias("nll"), snap(F.corr("p", "y")).alias("corr"), snap(F.corr("p", F.abs("y"))).alias("corr_abs"),
    )


@register("fourier_features")
def fourier_features(spark: SparkSession, sf: str) -> DataFrame:
    return learning.mapped(features(spark, sf), FEATURES, learning.FourierMap(len(FEATURES), 32)).select("symbol", "day", "phi")


@register("tensor_sketch")
def tensor_sketch(spark: SparkSession, sf: str) -> DataFrame:
    fast, slow, sketch = learning.FourierMap(2, 32), learning.FourierMap(1, 16, seed=1), learning.TensorSketch(32, 16, 64)
    return learning.mapped(features(spark, sf), FEATURES, lambda x: sketch(fast(x[:, :2]), slow(x[:, 2:]))).select("symbol", "day", "phi")


@register("walk_forward_ridge")
def walk_forward_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge on Fourier features, of weights that halve every 500 days and have a mean of 1, by symbol in five splits."""
    return staged.walk_forward_ridge(features(spark, sf), FEATURES, "y", KEYS, DAY, half_life=500.0).select("symbol", "day", "split", "y", "pred")


#: The kernels of the first stage, each of its own columns.
KERNELS = [
    staged.Kernel.fourier("trend", ("z", "mom5"), 32), staged.Kernel.fourier("risk", ("vol",), 16, nu=0.5, seed=1),
    staged.Kernel.fourier("all", tuple(FEATURES), 48, nu=2.5, seed=2),
]
PREDICTED = [f"pred_{k.name}" for k in KERNELS]


def first_stage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return staged.stage_one(features(spark, sf), KERNELS, "y", KEYS, DAY, penalty=1e-3, half_life=500.0)


@register("stage_one")
def stage_one(spark: SparkSession, sf: str) -> DataFrame:
    """Every kernel's out-of-sample prediction of each test day, each fitted by itself."""
    return first_stage(spark, sf)[0].select("symbol", "day", "split", "nth", "y", *PREDICTED)


@register("stage_one_folds")
def stage_one_folds(spark: SparkSession, sf: str) -> DataFrame:
    """By symbol, split and kernel: training rows, length of the weights, training loss, and correlation on the test."""
    pred, folds_ = first_stage(spark, sf)
    each = F.explode(F.array(*(F.struct(F.lit(k.name).alias("kernel"), F.col(c).alias("pred")) for k, c in zip(KERNELS, PREDICTED)))).alias("e")
    corr = pred.select("symbol", "split", "y", each).groupBy("symbol", "split", "e.kernel").agg(F.corr("e.pred", "y").alias("test_corr"), F.count("*").alias("n_test"))
    return folds_.join(corr, ["symbol", "split", "kernel"])


@register("stage_two")
def stage_two(spark: SparkSession, sf: str) -> DataFrame:
    """Three combiners over the kernels' predictions, in five expanding parts of the test days, beside fixed weights."""
    first = written(first_stage(spark, sf)[0].select("symbol", "day", "nth", "y", *PREDICTED), "first-stage")
    out = staged.fixed_weights(first, PREDICTED, [0.5, 0.25, 0.25]).withColumnRenamed("combined", "fixed")
    for how in ("elastic", "ridge", "huber"):
        got = staged.combined(first, PREDICTED, "y", KEYS, how)[0].select("symbol", "day", "part", F.col("combined").alias(how))
        out = out.join(got.drop("part") if how != "elastic" else got, ["symbol", "day"])
    return out.select("symbol", "day", "part", "y", "fixed", "elastic", "ridge", "huber")


@register("combiner_weights")
def combiner_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weights that each combiner has given the kernels in each part, and the settings that its inner folds chose."""
    first = written(first_stage(spark, sf)[0].select("symbol", "day", "nth", "y", *PREDICTED), "first-stage")
    out = None
    for how in ("elastic", "ridge", "huber"):
        w = staged.combined(first, PREDICTED, "y", KEYS, how)[1]
        w = w.select("symbol", F.lit(how).alias("combiner"), F.col("s2_part").alias("part"), "intercept", *(F.col("coef")[i].alias(k.name) for i, k in enumerate(KERNELS)), "alpha", "l1")
        out = w if out is None else out.union(w)
    return out


#: The kernel of two levels: two fast columns, a slow one, its gate and the row's.
LEVELS = learning.TwoLevel(2, learning.FourierMap(2, 24), learning.FourierMap(1, 12, nu=0.5, seed=1, sampler="independent"), learning.TensorSketch(24, 12, 48), 0.5)
TWO_LEVEL = staged.Kernel("levels", ("z", "mom5", "vol", "gate", "open"), LEVELS)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Features with the gate of momentum, and rows within a day of the first and the fifteenth of a month shut."""
    gate = 1 / (1 + F.exp(-rolling.causal_z("mom5", KEYS, DAY)))
    shut = (F.dayofmonth("day") <= 2) | F.dayofmonth("day").between(14, 16)
    return features(spark, sf).withColumn("gate", gate).withColumn("open", F.when(shut, 0.0).otherwise(1.0))


@register("two_level_walk_forward")
def two_level_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-sample predictions of one kernel over fast features and their gated product with slow ones, by symbol."""
    pred, _ = staged.stage_one(gated(spark, sf), [TWO_LEVEL], "y", KEYS, DAY, penalty=0.1, half_life=500.0, mean_one=True)
    return pred.select("symbol", "day", "split", "y", "open", F.col("pred_levels").alias("pred"))


@register("nested_validation")
def nested_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-sample predictions whose length scale and penalty inner folds chose in each split, and these choices."""
    pred, chosen = nested.nested_cv(features(spark, sf), FEATURES, "y", KEYS, DAY, half_life=500.0)
    return pred.join(chosen, ["symbol", "split"]).select("symbol", "day", "split", "y", "pred", "length", "penalty", "score", "n_train")


MOMENTUM = with_views("daily").replace("with ", "with recursive ", 1) + """,
r as materialized (select symbol, day, ln(close / lag(close) over (partition by symbol order by day)) as ret, row_number() over (partition by symbol order by day) as n from daily),
e as (select symbol, n, ret as fast, ret as slow from r where n = 2 union all
  select r.symbol, r.n, e.fast + 2.0::double / 21 * (r.ret - e.fast), e.slow + 2.0::double / 61 * (r.ret - e.slow) from e join r on r.symbol = e.symbol and r.n = e.n + 1),
m as (select r.symbol, day, r.n, case when count(ret) over (partition by r.symbol order by day rows between 60 preceding and 1 preceding) = 60 then sum(ret) over (partition by r.symbol order by day rows between 60 preceding and 1 preceding) end as tsmom,
  stddev_pop(ret) over (partition by r.symbol order by day rows between 20 preceding and 1 preceding) as sd, fast, slow from r left join e on r.symbol = e.symbol and r.n = e.n)"""


@register("momentum_columns", MOMENTUM + f""" select symbol, day, {s('tsmom')} as tsmom, {s('tsmom / (sd + 1e-8)', 3)} as scaled, {s('fast', 8)} as ema_fast, {s('slow', 8)} as ema_slow from m where tsmom is not null""")
def momentum_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum of 60 days, over its deviation of 20, and the two exponential means of returns."""
    m = stacking.momentum_columns(views.daily(spark, sf), "close", KEYS, DAY, F.year("day")).where("tsmom is not null")
    return m.select("symbol", "day", snap(F.col("tsmom")).alias("tsmom"), snap(F.col("scaled"), 3).alias("scaled"), snap(F.col("ema_fast"), 8).alias("ema_fast"), snap(F.col("ema_slow"), 8).alias("ema_slow"))


@register("fitted_momentum_gate")
def fitted_momentum_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate as a fitted model of momentum, by symbol in five splits."""
    got = stacking.fitted_gate(views.daily(spark, sf), "close", KEYS, DAY, F.year("day"), staged.Splits())
    return got.select("symbol", "day", "split", "target", "gate")


@register("expanding_pca")
def expanding_pca(spark: SparkSession, sf: str) -> DataFrame:
    return learning.expanding_pca(features(spark, sf), FEATURES, KEYS, DAY, 2, 60)


@register("hawkes_fit")
def hawkes_fit(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tape_ev(spark, sf).select("symbol", F.to_date("ts").alias("day"), (F.col("us") / 1e6).alias("sec"))
    return learning.hawkes_fit(t, ["symbol", "day"], "sec")


@register("shuffled_control")
def shuffled_control(spark: SparkSession, sf: str) -> DataFrame:
    return validation.shuffled(features(spark, sf), FEATURES, KEYS, DAY, seed=1)


@register("noise_control")
def noise_control(spark: SparkSession, sf: str) -> DataFrame:
    return validation.noise(features(spark, sf), FEATURES, ["symbol", "day"], seed=1)


RUNS = RETURNS + """, w as (select *, lag(ret) over (partition by symbol order by day) as p from r),
runs as (select symbol, case when symbol in ('S0', 'S1', 'S2') then 'none' when symbol in ('S3', 'S4') then 'noise' else 'shuffle_target' end as null_mode,
  avg(ret) / stddev_pop(ret) * sqrt(252.0::double) as sharpe, corr(p, ret) as oos_corr from w where ret is not null group by symbol)"""


@register("falsification_summary", RUNS + f""", a as (select null_mode, count(*) as n, avg(sharpe) as mean, stddev_pop(sharpe) as sd, max(abs(oos_corr)) as worst_corr from runs group by 1),
b as (select a.*, (select mean from a where null_mode = 'none') as rm, (select sd from a where null_mode = 'none') as rs, (select n from a where null_mode = 'none') as rn from a)
select null_mode, n, {s('mean', 4)} as mean, {s('sd', 4)} as sd, {s('worst_corr')} as worst_corr, abs(mean - rm) > 2 * sqrt(sd * sd / n + rs * rs / rn) as separable, null_mode = 'shuffle_target' and worst_corr > 0.05 as leaks from b""")
def falsification_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = returns(spark, sf).withColumn("p", F.lag("ret").over(ordered(KEYS, DAY))).where("ret is not null")
    mode = F.when(F.col("symbol").isin("S0", "S1", "S2"), "none").when(F.col("symbol").isin("S3", "S4"), "noise").otherwise("shuffle_target")
    runs = r.groupBy("symbol", mode.alias("null_mode")).agg((F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.corr("p", "ret").alias("oos_corr"))
    got = validation.summary(runs)
    return got.select("null_mode", "n", snap(F.col("mean"), 4).alias("mean"), snap(F.col("sd"), 4).alias("sd"), snap(F.col("worst_corr")).alias("worst_corr"), "separable", "leaks")


def shared(spark: SparkSession) -> str:
    """A folder of a stream's own in the one that all nodes share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All of a finite stream's output, as a table in the shared folder."""
    root = shared(stream.sparkSession)
    save = lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.load(spark, sf, "events").schema
    kind = F.col("event_type")
    side = F.when(kind.isin("purchase", "signup"), "A").when(kind.isin("click", "error"), "B").otherwise("N")
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(
        F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        (100.0 + F.col("value")).alias("price"), (1 + F.col("event_id") % 20).cast("double").alias("size"), side.alias("side"),
    )


@register("stream_windowed_flow", with_views("tape_ev") + f""" select symbol, epoch(date_trunc('hour', ts))::bigint as start_sec, count(*) as n,
  {s("sum(size * case side when 'A' then 1.0 when 'B' then -1.0 else 0.0 end)")} as flow from tape_ev group by 1, 2""")
def stream_windowed_flow(spark: SparkSession, sf: str) -> DataFrame:
    got = drained(folds.windowed_flow(event_stream(spark, sf)), "complete")
    return got.select("symbol", F.unix_seconds("start").alias("start_sec"), "n", snap(F.col("flow")).alias("flow"))


@register("stream_reset_bars", "with recursive t as (" + views.SQL["tape_ev"] + """),
c as materialized (select symbol, seq, cast(round(price * size * 100) as bigint) as v, sum(cast(round(price * size * 100) as bigint)) over (partition by symbol order by seq) as cum from t),
jump as (
  select symbol, cast(0 as bigint) as bar_id, min(seq) as seq, cast(min(cum) as hugeint) as cum from c where cum >= 10000000 group by symbol
  union all
  select j.symbol, j.bar_id + 1, c.seq, c.cum from jump j join c on c.symbol = j.symbol and c.cum >= j.cum + 10000000 and c.cum < j.cum + 10000000 + (select max(v) from c)
  qualify row_number() over (partition by j.symbol, j.bar_id order by c.seq) = 1)
select symbol, bar_id, seq as close_seq, cast(cum - coalesce(lag(cum) over (partition by symbol order by bar_id), 0) as bigint) as value_c from jump""")
def stream_reset_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf).withColumn("notional_c", F.round(F.col("price") * F.col("size") * 100).cast("long"))
    return drained(folds.reset_bars(e, 10_000_000), "append").select("symbol", "bar_id", "close_seq", "value_c")


@register("stream_positions")
def stream_positions(spark: SparkSession, sf: str) -> DataFrame:
    return drained(folds.filtered_positions(event_stream(spark, sf).withColumn("x", F.col("price") - 100), "x", "seq", 0.01, 20, 1.0, 0.25, 2.0), "append")
