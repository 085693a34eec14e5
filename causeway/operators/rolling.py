"""Causal rolling and expanding statistics, and the feature sets built from them.

Frames that end at -1 leave out the current row. Population and sample deviations are not interchangeable here: each
feature names its own. First rows follow the convention of a difference of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.functions.columns import cyclic, frame, normal_cdf, ordered
from causeway.operators.scans import Exponential, carried, scan


def nth(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(ordered(keys, order))


def diff(x: str, keys: list[str], order: list[str]) -> Column:
    return F.coalesce(F.col(x) - F.lag(x).over(ordered(keys, order)), F.lit(0.0))


def expanding_mean(x: str, keys: list[str], order: list[str]) -> Column:
    return F.avg(x).over(frame(keys, order, None, 0))


def causal_z(x: str, keys: list[str], order: list[str], warm: int = 20, eps: float = 1e-8) -> Column:
    """(x - mean) / (deviation + eps) over the rows so far; 0 for the first ``warm`` rows."""
    f = frame(keys, order, None, 0)
    z = (F.col(x) - F.avg(x).over(f)) / (F.stddev_pop(x).over(f) + eps)
    return F.when(nth(keys, order) <= warm, 0.0).otherwise(F.coalesce(z, F.lit(0.0)))


def prior_z(x: str, keys: list[str], order: list[str], window: int) -> Column:
    """z against the ``window`` rows before, 0 with fewer than two of them or without spread."""
    f = frame(keys, order, -window, -1)
    sd = F.stddev_pop(x).over(f)
    return F.when((F.count(x).over(f) < 2) | (sd <= 1e-12), 0.0).otherwise((F.col(x) - F.avg(x).over(f)) / sd)


def rolling_z(x: str, keys: list[str], order: list[str], window: int, eps: float = 1e-8) -> Column:
    f = frame(keys, order, -(window - 1), 0)
    return (F.col(x) - F.avg(x).over(f)) / (F.stddev_pop(x).over(f) + eps)


def vpin(bars: DataFrame, keys: list[str], order: list[str], window: int = 50) -> DataFrame:
    """Imbalance of the ``window`` bars before over their volume, 0 until there are as many; its change, and relative volume."""
    f = frame(keys, order, -window, -1)
    raw = F.sum(F.abs(F.col("buy_volume") - F.col("sell_volume"))).over(f) / F.sum("volume").over(f)
    out = bars.withColumn("vpin", F.when(nth(keys, order) > window, raw).otherwise(0.0))
    return out.withColumn("d_vpin", diff("vpin", keys, order)).withColumn("rel_volume", F.col("volume") / (expanding_mean("volume", keys, order) + 1e-8))


def bulk_volume(bars: DataFrame, keys: list[str], order: list[str], window: int = 50) -> DataFrame:
    """Buy share of a bar's volume as the normal distribution of its return over the rolling sample deviation."""
    sd = F.stddev_samp("bar_return").over(frame(keys, order, -(window - 1), 0))
    z = F.col("bar_return") / F.coalesce(F.when(sd > 0, sd), F.lit(1e-8))
    return bars.withColumn("p_buy", normal_cdf(z)).withColumn("imbalance", F.abs(2 * F.col("p_buy") - 1) * F.col("volume"))


def full_vpin(bars: DataFrame, keys: list[str], order: list[str], window: int = 50) -> DataFrame:
    """Sum of imbalance over ``window`` times mean volume, within [0, 1]; null until the window is full."""
    f = frame(keys, order, -(window - 1), 0)
    value = F.sum("imbalance").over(f) / (window * F.avg("volume").over(f))
    return bars.withColumn("vpin", F.when(F.count("*").over(f) == window, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def price_impact(bars: DataFrame, keys: list[str], order: list[str], windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """lambda_w = sample covariance of price change and flow over the population variance of flow, of the w bars before.

    Also the residual of the first window's lambda, dp - lambda * flow.
    """
    out = bars
    for w in windows:
        f = frame(keys, order, -w, -1)
        var = F.var_pop("flow").over(f)
        out = out.withColumn(f"lambda_{w}", F.when(var > 1e-12, F.covar_samp("dp", "flow").over(f) / var).otherwise(0.0))
    return out.withColumn("residual", F.col("dp") - F.col(f"lambda_{windows[0]}") * F.col("flow"))


def rolling_slope(bars: DataFrame, keys: list[str], order: list[str], window: int) -> DataFrame:
    """Least-squares impact over the last ``window`` bars, and the residual by the slope of the bar before."""
    f = frame(keys, order, -(window - 1), 0)
    var = F.var_pop("flow").over(f)
    slope = F.when((F.count("*").over(f) == window) & (var > 1e-12), F.covar_pop("dp", "flow").over(f) / var)
    out = bars.withColumn("slope", slope)
    return out.withColumn("residual", F.col("dp") - F.lag("slope").over(ordered(keys, order)) * F.col("flow"))


def arrival_rate(windows: DataFrame) -> DataFrame:
    """Mean wait of a clock window and its intensity count / mean wait, where there are two events or more."""
    mean = F.coalesce(F.try_divide("waits", "n_waits"), F.lit(0.0))
    return windows.withColumn("mean_wait", mean).withColumn(
        "intensity", F.when(F.col("n_events") > 1, F.col("n_events") / (F.col("mean_wait") + 1e-8)).otherwise(0.0)
    )


def log_return(price: str, keys: list[str], order: list[str]) -> Column:
    return F.log(F.col(price) / F.lag(price).over(ordered(keys, order)))


def variance_premium(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Implied less realised volatility, momentum and calendar terms; ``daily`` has close, vix and pcr (both may be null)."""
    o = ["day"]
    r = daily.withColumn("ret", log_return("close", keys, o))
    r = r.withColumn("rv30", F.stddev_pop("ret").over(frame(keys, o, -30, -1)) * F.sqrt(F.lit(252.0)))
    iv = F.coalesce(F.col("vix"), F.col("rv30") * 100.0) / 100.0
    doy_sin, doy_cos = cyclic(F.dayofyear("day"), 252.0)
    dow_sin, dow_cos = cyclic(F.weekday("day"), 5.0)
    w = ordered(keys, o)
    return r.withColumn("n", nth(keys, o)).where("n > 30").select(
        *keys, "day", (iv - F.col("rv30")).alias("premium"), "rv30", doy_sin.alias("doy_sin"), doy_cos.alias("doy_cos"),
        dow_sin.alias("dow_sin"), dow_cos.alias("dow_cos"), "mom5", "mom21",
        F.log(F.coalesce("vix", F.col("rv30") * 100.0)).alias("ln_iv"), F.log(F.coalesce("pcr", F.lit(0.8))).alias("ln_pcr"),
    ) if "mom5" in r.columns else variance_premium(
        daily.withColumn("mom5", F.col("close") / F.lag("close", 5).over(w) - 1).withColumn("mom21", F.col("close") / F.lag("close", 21).over(w) - 1), keys
    )


def macro_features(daily: DataFrame, keys: list[str], window: int = 60) -> DataFrame:
    """Summed log returns of 5, 20 and 60 days before, and correlation, beta and residual spread against ``index_close``."""
    o = ["day"]
    r = daily.withColumn("r", F.coalesce(log_return("close", keys, o), F.lit(0.0))).withColumn("s", F.coalesce(log_return("index_close", keys, o), F.lit(0.0)))
    f = frame(keys, o, -window, -1)
    var = F.var_pop("s").over(f)
    corr = F.try_divide(F.covar_pop("r", "s").over(f), F.stddev_pop("r").over(f) * F.stddev_pop("s").over(f))
    beta = F.when(var > 1e-12, F.covar_samp("r", "s").over(f) / var).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.var_pop("r").over(f) - 2 * F.col("beta") * F.covar_pop("r", "s").over(f) + F.col("beta") * F.col("beta") * var))
    sums = {f"mom{k}": F.sum("r").over(frame(keys, o, -k, -1)) for k in (5, 20, 60)}
    out = r.withColumn("n", nth(keys, o)).withColumns(sums).withColumn("beta", beta)
    return out.withColumn("corr", F.coalesce(corr, F.lit(0.0))).withColumn("resid_sd", spread).where(f"n > {window}")


def fractional_weights(d: float, least: float = 1e-5, width: int = 63) -> list[float]:
    """Weights of (1 - L)^d until they fall below ``least``, ``width`` at most."""
    out = [1.0]
    while len(out) < width and abs(w := -out[-1] * (d - len(out) + 1) / len(out)) >= least:
        out.append(w)
    return out


def fractional_difference(x: str, keys: list[str], order: list[str], d: float, least: float = 1e-5, width: int = 63) -> Column:
    """sum of w_k x[t - k]; null before the weights' width is reached."""
    w = fractional_weights(d, least, width)
    rows = F.collect_list(x).over(frame(keys, order, -(len(w) - 1), 0))
    weights = F.array(*map(F.lit, reversed(w)))
    total = F.aggregate(F.zip_with(rows, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(rows) == len(w), total)


def ema(df: DataFrame, x: str, keys: list[str], order: list[str], span: int, out: str = "ema", block: Column | None = None) -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1), from the first value on; rows without a value keep it.

    With ``block``, which never falls along the order, a key is many tasks; without, it is folded batch by batch.
    """
    fold = Exponential(x, 2.0 / (span + 1), out)
    if block is not None:
        return scan(df, fold, keys, order, block)

    def step(own: dict[str, np.ndarray], state: tuple | None) -> tuple[np.ndarray, tuple]:
        y = fold.rows(state or fold.start(), {x: own[x].astype(float)}, None)[0].to_numpy(zero_copy_only=False)
        return y, (None if np.isnan(y[-1]) else float(y[-1]),)

    return carried(df, keys, order, [x], out, step)


def residual_variance(daily: DataFrame, keys: list[str], window: int = 60) -> DataFrame:
    """Variance of y left by two regressors x1 and x2 over the last ``window`` rows, by closed forms of the moments."""
    f = frame(keys, ["day"], -(window - 1), 0)
    c = lambda a, b: F.covar_pop(a, b).over(f)
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    out = daily.withColumns({
        "n": F.count("*").over(f), "syy": F.var_pop("y").over(f), "s11": F.var_pop("x1").over(f), "s22": F.var_pop("x2").over(f),
        "s12": c("x1", "x2"), "s1y": c("x1", "y"), "s2y": c("x2", "y"),
    })
    b1 = (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det
    b2 = (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det
    rss = F.greatest(F.lit(0.0), F.col("syy") - b1 * F.col("s1y") - b2 * F.col("s2y"))
    return out.withColumn("resid_var", F.when((F.col("n") == window) & (det > 1e-18), rss * F.col("n") / (F.col("n") - 3)))


def drawdown(curve: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Running peak of ``value``, and how far below it each row lies, absolute and relative."""
    peak = F.max(value).over(frame(keys, order, None, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", F.col(value) - F.col("peak")).withColumn(
        "drawdown_pct", F.when(F.col("peak") != 0, (F.col(value) - F.col("peak")) / F.col("peak")).otherwise(0.0)
    )


def loss_streak(trades: DataFrame, keys: list[str], order: list[str], pnl: str) -> DataFrame:
    """Trades since the last win of each key, counted from the newest; a gain of 0 is a loss."""
    newest = F.row_number().over(ordered(keys, [F.desc(o) for o in order]))
    wins = trades.withColumn("nth", newest).groupBy(*keys).agg(F.min(F.when(F.col(pnl) > 0, F.col("nth"))).alias("win"), F.count("*").alias("n"))
    return wins.select(*keys, (F.coalesce("win", F.col("n") + 1) - 1).cast("long").alias("streak"))


def multi_horizon_score(df: DataFrame, x: str, keys: list[str], order: list[str], horizons=(10, 30, 60), weights=(0.2, 0.5, 0.3), window: int = 100) -> DataFrame:
    """Weighted z-scores of trailing means: the mean of the h rows before, against the ``window`` means before it."""
    out = df
    total = F.lit(0.0)
    for h, w in zip(horizons, weights):
        f, g = frame(keys, order, -h, -1), frame(keys, order, -window, -1)
        out = out.withColumn(f"mean_{h}", F.when(F.count(x).over(f) == h, F.avg(x).over(f)))
        z = (F.col(f"mean_{h}") - F.avg(f"mean_{h}").over(g)) / (F.stddev_pop(f"mean_{h}").over(g) + 1e-8)
        out = out.withColumn(f"score_{h}", F.when(F.count(f"mean_{h}").over(g) == window, z))
        total = total + w * F.coalesce(f"score_{h}", F.lit(0.0))
    return out.withColumn("score", total)


class RunningSum:
    """Sums of all values so far, of doubles in groups of 16: those of 16 groups are a group above, and a sum begins at the top.

    Its error grows with the logarithm of the number of values; that of adding one by one grows with the number itself.
    """

    def __init__(self) -> None:
        self.open, self.base, self.above = np.empty(0), 0.0, None

    def add(self, x: np.ndarray) -> np.ndarray:
        """The sum up to each of these further values."""
        held, x = len(self.open), np.concatenate([self.open, x])
        full = len(x) // 16
        groups = np.zeros((full + 1, 16))
        groups.reshape(-1)[: len(x)] = x
        ends = np.empty(0)
        if full:
            self.above = self.above or RunningSum()
            whole = groups[:full, 0].copy()
            for i in range(1, 16):
                whole += groups[:full, i]
            ends = self.above.add(whole)
        base = np.append(self.base, ends)
        self.open, self.base = x[full * 16 :], base[-1]
        for i in range(16):
            base += groups[:, i]
            groups[:, i] = base
        groups[:full, 15] = ends
        return groups.reshape(-1)[held : len(x)]


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, of: Callable[[np.ndarray], np.ndarray] = np.positive) -> DataFrame:
    """``df`` with ``of`` the sum of ``value`` up to each row of its key as ``name``: a fold by key that holds a batch, nulls left out."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.unique(np.concatenate([[0], *(pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys)]))
            out = []
            x = batch.column(value)
            for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist()):
                now = tuple(batch.column(k)[lo].as_py() for k in keys)
                if total is None or now != key:
                    key, total, known = now, RunningSum(), 0
                part = x.slice(lo, hi - lo)
                seen = known + part.is_valid().to_numpy(zero_copy_only=False).cumsum()
                known = int(seen[-1])
                out.append(pa.array(of(total.add(part.fill_null(0.0).to_numpy())), mask=seen == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(out)], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
