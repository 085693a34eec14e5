"""Model choice and combination from sums: grid search, weights of kernels, stacking, redundancy, and unit-root tests.

Everything is decided on small D x D sums that ``learning.grams`` reduced; no step scans the rows once for each setting.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from causeway.operators import learning, staged


def unpack(sums: pd.DataFrame, size: int) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(n, gram, moment, yy) by fold."""
    return [(int(r.n), np.frombuffer(r.gram).reshape(size, size), np.frombuffer(r.moment), float(r.yy)) for r in sums.itertuples()]


def loss(weights: np.ndarray, n: int, gram: np.ndarray, moment: np.ndarray, yy: float) -> float:
    """Mean squared error of a weight vector on a fold, from its sums."""
    return max(0.0, yy - 2 * weights @ moment + weights @ gram @ weights) / max(n, 1)


def grid_search(df: DataFrame, columns: list[str], target: str, fold: str, nus=(0.5, 1.5, 2.5), lengths=(0.5, 1.0, 2.0), penalties=(0.1, 1.0, 10.0), features: int = 32) -> pd.DataFrame:
    """Cross-validated error of each (nu, length, penalty); one pass for each map, all penalties share its sums.

    Folds are contiguous stretches of time; each is tested by the model of the stretches before it, so nothing looks ahead.
    """
    rows = []
    for nu in nus:
        for length in lengths:
            parts = unpack(learning.grams(df, columns, target, learning.FourierMap(len(columns), features, nu, length), fold), features)
            for penalty in penalties:
                errors = []
                for k in range(1, len(parts)):
                    gram, moment = sum(p[1] for p in parts[:k]), sum(p[2] for p in parts[:k])
                    errors.append(loss(learning.ridge(gram, moment, penalty), *parts[k]))
                rows.append((nu, length, penalty, float(np.mean(errors)) if errors else math.nan))
    return pd.DataFrame(rows, columns=["nu", "length", "penalty", "error"])


def kernel_weights(sums: list[tuple[int, np.ndarray, np.ndarray, float]], blocks: list[slice], penalty: float = 1.0, rounds: int = 50, rate: float = 0.2) -> np.ndarray:
    """Non-negative weights of kernels, alternating a ridge solve with a projected step on the training sums' loss."""
    n, gram, moment, yy = (sum(p[i] for p in sums) for i in range(4))
    a = np.full(len(blocks), 1 / len(blocks))

    def fitted(a: np.ndarray) -> float:
        scale = np.empty(len(moment))
        for w, b in zip(a, blocks):
            scale[b] = math.sqrt(max(w, 0))
        g, m = gram * np.outer(scale, scale), moment * scale
        w = learning.ridge(g, m, penalty)
        return loss(w, n, g, m, yy) + penalty * (w @ w) / n

    for _ in range(rounds):
        base = fitted(a)
        slope = np.array([(fitted(a + 1e-4 * e) - base) / 1e-4 for e in np.eye(len(a))])
        new = np.clip(a - rate * slope / (np.abs(slope).max() + 1e-12), 0, None)
        new = new / new.sum() if new.sum() else a
        if fitted(new) >= base:
            rate /= 2
        else:
            a = new
    return a


def stack(df: DataFrame, predictions: list[str], target: str, fold: str, alpha: float = 1e-6, l1: float = 0.5) -> pd.DataFrame:
    """Non-negative elastic-net weights of predictions for each fold, from the folds before it."""
    sums = learning.grams(df, predictions, target, lambda x: x, fold)
    parts = unpack(sums, len(predictions))
    rows = []
    for k in range(1, len(parts)):
        n, gram, moment = (sum(p[i] for p in parts[:k]) for i in range(3))
        rows.append((int(sums["fold"].iat[k]), *learning.elastic_net(gram, moment, n, alpha, l1)))
    return pd.DataFrame(rows, columns=["fold", *predictions])


def redundancy(df: DataFrame, layers: dict[str, list[str]], high: float = 0.75, low: float = 0.5) -> list[tuple[str, str, float, str]]:
    """Centred kernel alignment of each two layers, and whether the later one is redundant, independent or between."""
    names = list(layers)
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            v = learning.alignment(df, layers[a], layers[b])
            out.append((a, b, v, "redundant" if v >= high else "independent" if v <= low else "ambiguous"))
    return out


def dickey_fuller(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """t statistic of the augmented test with a constant and one lag, by key: three regressors, from moments alone."""
    from causeway.functions.columns import ordered

    w = ordered(keys, order)
    d = df.withColumn("dx", F.col(x) - F.lag(x).over(w)).withColumn("x1", F.lag(x).over(w)).withColumn("x2", F.lag("dx").over(w)).where("dx is not null and x2 is not null")
    m = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.var_pop("dx").alias("syy"), F.var_pop("x1").alias("s11"), F.var_pop("x2").alias("s22"),
        F.covar_pop("x1", "x2").alias("s12"), F.covar_pop("x1", "dx").alias("s1y"), F.covar_pop("x2", "dx").alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det
    b2 = (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det
    rss = F.col("syy") - b1 * F.col("s1y") - b2 * F.col("s2y")
    t = b1 / F.sqrt(rss / (F.col("n") - 3) * F.col("s22") / det)
    # 5 % and 1 % points of the test with a constant
    return m.where(det > 1e-18).select(*keys, "n", t.alias("t"), (t < -2.86).alias("stationary_5"), (t < -3.43).alias("stationary_1"))


#: Points of the unit-root test with a constant, and the shares below them.
ROOT_POINTS = (-3.430, -2.860, -2.570)
ROOT_SHARES = (0.01, 0.05, 0.10)


def unit_root_p(t: Column) -> Column:
    """Approximate p of a unit-root statistic: a line between the points, and one towards 1 above them."""
    a, b, c = ROOT_POINTS
    pa_, pb, pc = ROOT_SHARES
    above = F.least(pc + F.abs(t - c) * (0.90 / abs(-1.0 - c)), F.lit(1.0))
    return F.when(t <= a, 0.005).when(t <= b, pa_ + (t - a) / (b - a) * (pb - pa_)).when(t <= c, pb + (t - b) / (c - b) * (pc - pb)).otherwise(above)


ORDERS = [round(0.1 + 0.05 * i, 2) for i in range(19)]


def differenced(df: DataFrame, x: str, keys: list[str], order: list[str], orders: list[float] = ORDERS, width: int = 63, least: float = 1e-5) -> DataFrame:
    """keys, order, d and v: ``x`` differenced by each fractional order, from the row on that has ``width`` values.

    One window gathers a row's last ``width`` values; all orders' weights meet them in one product of matrices.
    """
    from causeway.functions.columns import frame
    from causeway.operators.rolling import fractional_weights

    weights = np.zeros((width, len(orders)))
    for i, d in enumerate(orders):
        w = fractional_weights(d, least, width)
        weights[width - len(w) :, i] = w[::-1]  # the newest value comes last
    known = df.where(F.col(x).isNotNull()).select(*keys, *order, F.collect_list(x).over(frame(keys, order, -(width - 1), 0)).alias("xs"))
    names = [*keys, *order, "vs"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("xs")
            flat = xs.flatten().to_numpy().reshape(-1, width)
            vs = pa.FixedSizeListArray.from_arrays(pa.array((flat @ weights).ravel()), len(orders)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vs], names=names)

    full = known.where(F.size("xs") == width)
    schema = T.StructType([*full.schema.fields[:-1], T.StructField("vs", T.ArrayType(T.DoubleType()))])
    each = full.mapInArrow(apply, schema).select(*keys, *order, F.posexplode("vs").alias("i", "v"))
    return each.select(*keys, *order, F.element_at(F.array(*map(F.lit, orders)), F.col("i") + 1).alias("d"), "v")


def order_sweep(df: DataFrame, x: str, keys: list[str], order: list[str], **how) -> DataFrame:
    """keys, d, n, t and p: the unit-root test of each fractional order with 30 values or more."""
    tested = dickey_fuller(differenced(df, x, keys, order, **how), "v", [*keys, "d"], order).where("n >= 28")
    return tested.select(*keys, "d", (F.col("n") + 2).alias("n"), "t", unit_root_p(F.col("t")).alias("p"))


def least_order(df: DataFrame, x: str, keys: list[str], order: list[str], level: float = 0.05, **how) -> DataFrame:
    """keys and d: the least order whose differences have no unit root at ``level``; 0.5 where none is."""
    swept = order_sweep(df, x, keys, order, **how).groupBy(*keys).agg(F.min(F.when(F.col("p") < level, F.col("d"))).alias("found"))
    every = df.select(*(F.col(k).alias(f"fo_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"fo_{k}"))
    return every.join(swept, on, "left").select(*(F.col(f"fo_{k}").alias(k) for k in keys), F.coalesce("found", F.lit(0.5)).alias("d"))


def anderson_darling(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Two-sample statistic by key: one rank window over both samples."""
    both = a.select(*keys, F.col(value).alias("v"), F.lit(1).alias("own")).unionByName(b.select(*keys, F.col(value).alias("v"), F.lit(0).alias("own")))
    w = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    # ties enter together: ranks and counts include all equal values
    r = both.withColumn("i", F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("m", F.sum("own").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("n", F.count("*").over(whole)).withColumn("n1", F.sum("own").over(whole)).where("i < n and n1 > 0 and n1 < n")
    term = F.pow(F.col("m") * F.col("n") - F.col("i") * F.col("n1"), 2) / (F.col("i") * (F.col("n") - F.col("i")))
    return r.groupBy(*keys, "n", "n1").agg((F.sum(term) / (F.col("n1") * (F.col("n") - F.col("n1")) * F.col("n"))).alias("a2")).select(*keys, "n", "n1", "a2")


def baseline(rates: DataFrame, keys: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    """keys and v: a synthetic sample of profits for each row of ``rates`` (win_rate, avg_win, avg_loss).

    floor(samples x win_rate) winners are uniform up to twice the average win, the others down to twice the average loss.
    """
    from causeway.operators.resampling import uniform

    each = rates.where("win_rate is not null and avg_win is not null and avg_loss is not null").withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = uniform(F.lit(seed), *(F.col(k) for k in keys), F.col("nth"))
    won = F.col("nth") < F.floor(samples * F.col("win_rate"))
    return each.select(*keys, F.when(won, 2 * F.col("avg_win") * u).otherwise(-2 * F.col("avg_loss") * u).alias("v"))


#: Significance levels of the k-sample test, and the published coefficients of their points.
LEVELS = (0.25, 0.10, 0.05, 0.025, 0.01, 0.005, 0.001)
POINTS = (
    (0.675, 1.281, 1.645, 1.960, 2.326, 2.573, 3.085),
    (-0.245, 0.250, 0.678, 1.149, 1.822, 2.364, 3.615),
    (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154),
)


def two_sample_p(a2: float, n1: int, n2: int) -> tuple[float, float]:
    """(standardised statistic, p within [0.001, 0.25]) of the two-sample Anderson-Darling statistic (Scholz and Stephens, 1987)."""
    n, k = n1 + n2, 2
    i = np.arange(1, n, dtype=float)
    h, inverse = (1 / i).sum(), 1 / i
    # g: sum over i < j of 1 / ((n - i) j), by sums of the tail
    tail = np.append(np.cumsum(inverse[::-1])[::-1], 0.0)
    g = (tail[1:-1] / (n - i[:-1])).sum()
    big = 1 / n1 + 1 / n2
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * big - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    spread = math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1.0) * (n - 2.0) * (n - 3.0)))
    t = (a2 - (k - 1)) / spread
    points = sum(np.array(p) / (k - 1) ** (j / 2) for j, p in enumerate(POINTS))
    if t < points.min() or t > points.max():
        return t, LEVELS[0] if t < points.min() else LEVELS[-1]
    return t, float(np.exp(np.polyval(np.polyfit(points, np.log(LEVELS), 2), t)))


def against_baseline(trades: DataFrame, rates: DataFrame, value: str, keys: list[str], samples: int = 1000, seed: int = 42, least: int = 5) -> DataFrame:
    """keys, n, a2, statistic and p of trades against their baseline, for keys of ``least`` trades or more.

    Equal values enter together at their middle rank. Values are counted first, so what is ordered by key are distinct
    values and their counts.
    """
    own = trades.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).alias("own"))
    both = own.unionByName(baseline(rates, keys, samples, seed).select(*keys, "v", F.lit(0).alias("own")))
    counted = both.groupBy(*keys, "v").agg(F.count("*").alias("l"), F.sum("own").alias("f"))
    before, whole = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    ranked = counted.select(
        *keys, "l", "f", (F.coalesce(F.sum("l").over(before), F.lit(0)) + F.col("l") / 2).alias("b"), (F.coalesce(F.sum("f").over(before), F.lit(0)) + F.col("f") / 2).alias("m"),
        F.sum("l").over(whole).alias("n"), F.sum("f").over(whole).alias("n1"),
    ).where(F.col("n1") >= least).where("n1 < n")
    below = F.col("b") * (F.col("n") - F.col("b")) - F.col("n") * F.col("l") / 4
    # the other sample's deviation is the same, with the other sign
    term = F.col("l") / F.col("n") * F.pow(F.col("n") * F.col("m") - F.col("n1") * F.col("b"), 2) / below
    n2 = F.col("n") - F.col("n1")
    got = ranked.groupBy(*keys, "n", "n1").agg(F.sum(F.when(below > 0, term)).alias("s"))
    got = got.select(*keys, "n", "n1", ((F.col("n") - 1) / F.col("n") * F.col("s") * (1 / F.col("n1") + 1 / n2)).alias("a2"))
    schema = T.StructType([*(trades.schema[k] for k in keys), *T.StructType.fromDDL("n long, a2 double, statistic double, p double").fields])

    def levels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*(r[k] for k in keys), int(r["n1"]), r["a2"], *two_sample_p(r["a2"], int(r["n1"]), int(r["n"] - r["n1"]))) for r in part.to_dict("records")]
            yield pd.DataFrame(rows, columns=schema.names)

    return got.mapInPandas(levels, schema)


def momentum_columns(df: DataFrame, price: str, keys: list[str], order: list[str], block: Column, slow: int = 60, fast: int = 20) -> DataFrame:
    """Adds ret, tsmom (the ``slow`` returns before), scaled (over their deviation of ``fast``) and ema_fast, ema_slow, cross of returns.

    Rows that have not yet ``slow`` returns before them have no tsmom.
    """
    from causeway.functions.columns import frame, ordered
    from causeway.operators.rolling import ema

    out = df.withColumn("ret", F.log(F.col(price) / F.lag(price).over(ordered(keys, order))))
    before = frame(keys, order, -slow, -1)
    out = out.withColumn("tsmom", F.when(F.count("ret").over(before) == slow, F.sum("ret").over(before)))
    out = out.withColumn("scaled", F.col("tsmom") / (F.stddev_pop("ret").over(frame(keys, order, -fast, -1)) + 1e-8))
    out = ema(ema(out, "ret", keys, order, fast, "ema_fast", block), "ret", keys, order, slow, "ema_slow", block)
    return out.withColumn("cross", F.col("ema_fast") / (F.col("ema_slow") + 1e-8) - 1)


def fitted_gate(df: DataFrame, price: str, keys: list[str], order: list[str], block: Column, splits: staged.Splits, features: int = 256, penalty: float = 1e-3) -> DataFrame:
    """Gate in (0, 1): a logistic of ridge on Fourier features of three momentum columns, fitted on earlier rows alone.

    The target is the next return. Columns are taken against their own past, so that the past alone sets their scale.
    """
    from causeway.functions.columns import ordered
    from causeway.operators.rolling import causal_z

    m = momentum_columns(df, price, keys, order, block).where("tsmom is not null")
    m = m.withColumn("target", F.lead("ret").over(ordered(keys, order)))
    names = ("tsmom", "scaled", "cross")
    m = m.withColumns({f"z_{c}": causal_z(c, keys, order) for c in names})
    kernel = staged.Kernel.fourier("gate", tuple(f"z_{c}" for c in names), features, seed=42)
    pred, _ = staged.stage_one(m, [kernel], "target", keys, order, splits, penalty)
    return pred.withColumn("gate", 1 / (1 + F.exp(-F.col("pred_gate"))))


def momentum_gate(df: DataFrame, price: str, keys: list[str], order: list[str], slow: int = 60, fast: int = 20) -> DataFrame:
    """Gate in (0, 1): a logistic of the causal z of momentum; the past alone sets its scale."""
    from causeway.functions.columns import frame, ordered
    from causeway.operators.rolling import causal_z

    w = ordered(keys, order)
    out = df.withColumn("tsmom", F.coalesce(F.log(F.col(price) / F.lag(price, slow).over(w)), F.lit(0.0)))
    out = out.withColumn("ratio", F.avg(price).over(frame(keys, order, -(fast - 1), 0)) / F.avg(price).over(frame(keys, order, -(slow - 1), 0)) - 1)
    out = out.withColumn("z1", causal_z("tsmom", keys, order)).withColumn("z2", causal_z("ratio", keys, order))
    return out.withColumn("gate", 1 / (1 + F.exp(-(F.col("z1") + F.col("z2")) / 2)))
