"""Out-of-sample predictions in two stages, by key: kernels fitted one by one, then combined; and nested validation.

A key's rows are numbered in order, and splits expand: split k is tested on its window and trained on all rows up to
``embargo`` rows before. Rows fall into chunks, the stretches between one split's train end and the next one's; a chunk is summed
once, and the sums of a split are those of its chunks. Weights that halve every ``half_life`` rows before a train's end are taken
from each chunk's own end; to carry them to a later end is to multiply the chunk's sums by one factor. So one pass over the
rows gives every kernel's model of every split.

Sums are D x D at most, D being a kernel's number of features; tasks add up first, and what a key's models need is a few rows.
A row without a target, or with a missing feature, is no observation in training; it gets no prediction without its features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from causeway.functions.tables import written
from causeway.operators.learning import FourierMap, ridge
from causeway.operators.scans import stretches


@dataclass(frozen=True)
class Kernel:
    """A named feature map of some columns."""

    name: str
    columns: tuple[str, ...]
    map: Callable[[np.ndarray], np.ndarray]

    @staticmethod
    def fourier(name: str, columns: tuple[str, ...], features: int = 64, nu: float = 1.5, length: float = 1.0, seed: int = 0) -> Kernel:
        return Kernel(name, columns, FourierMap(len(columns), features, nu, length, seed))


@dataclass(frozen=True)
class Splits:
    """Expanding splits: the first test starts after ``min_train`` + ``embargo`` rows, the rest is cut into ``n`` equal windows."""

    n: int = 5
    min_train: int = 200
    embargo: int = 5

    def starts(self, rows: int) -> list[tuple[int, int, int]]:
        """(train end, test start, test end) of each split of a series."""
        first = self.min_train + self.embargo
        size = max((rows - first) // self.n, 1)
        at = [first + k * size for k in range(self.n)]
        return [(s - self.embargo, s, min(s + size, rows)) for s in at if s < rows]

    def mark(self, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        """``df`` with st_nth from 0, st_rows, st_split (whose test a row is, or null) and st_chunk (the first split that trains on it)."""
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        rows = df.withColumn("st_nth", nth.cast("long")).withColumn("st_rows", F.count("*").over(Window.partitionBy(*keys)))
        first = self.min_train + self.embargo
        size = F.greatest(F.floor((F.col("st_rows") - first) / self.n), F.lit(1)).cast("long")
        k = F.floor((F.col("st_nth") - first) / size).cast("int")
        chunk = F.greatest(F.floor((F.col("st_nth") - self.min_train) / size) + 1, F.lit(0)).cast("int")
        return rows.withColumn("st_split", F.when((k >= 0) & (k < self.n), k)).withColumn("st_chunk", chunk)

    def end(self, chunk: Column) -> Column:
        """The number of rows that the split of this number trains on."""
        first = self.min_train + self.embargo
        size = F.greatest(F.floor((F.col("st_rows") - first) / self.n), F.lit(1)).cast("long")
        return self.min_train + chunk * size


def decay(rows_back: Column, half_life: float) -> Column:
    return F.lit(1.0) if math.isinf(half_life) or half_life <= 0 else F.exp(F.lit(-math.log(2) / half_life) * rows_back)


def matrix(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


SUMS = "st_n long, st_w double, st_gram binary, st_moment binary, st_yy double"


def sums(df: DataFrame, by: list[str], kernels: list[Kernel], target: str, weight: str) -> DataFrame:
    """For each ``by`` and kernel (st_kernel): rows, weights, and weighted sums of phi phi', phi y and y y."""
    fields = [df.schema[c] for c in by]
    head = T.StructType([*fields, T.StructField("st_kernel", T.IntegerType()), *T.StructType.fromDDL(SUMS).fields])
    names = head.names

    def send(held: dict, like: pa.Schema) -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[i] for k in keys], like.field(c).type) for i, c in enumerate(by)] + [pa.array([k[-1] for k in keys], pa.int32())]
        columns += [pa.array([int(v[0]) for v in values], pa.int64()), pa.array([float(v[1]) for v in values])]
        columns += [pa.array([v[i].tobytes() for v in values], pa.binary()) for i in (2, 3)] + [pa.array([float(v[4]) for v in values])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for key, part in stretches(batches, by):
            y, w = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (target, weight))
            for k, kernel in enumerate(kernels):
                x = matrix(part, kernel.columns)
                seen = np.isfinite(x).all(1) & np.isfinite(y)
                if not seen.any():
                    continue
                phi, own, v = kernel.map(x[seen]), y[seen], w[seen]
                scaled = phi * v[:, None]
                new = [len(own), v.sum(), scaled.T @ phi, scaled.T @ own, (v * own * own).sum()]
                old = held.get((*key, k))
                held[*key, k] = new if old is None else [a + b for a, b in zip(old, new)]
            if len(held) > 500:
                yield send(held, part.schema)
                held.clear()
        if held:
            yield send(held, part.schema)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n, w, yy = (batch.column(c).to_numpy() for c in ("st_n", "st_w", "st_yy"))
            gram, moment = (sum(np.frombuffer(b.as_buffer()) for b in batch.column(c)) for c in ("st_gram", "st_moment"))
            new = [n.sum(), w.sum(), gram, moment, yy.sum()]
            total = new if total is None else [a + b for a, b in zip(total, new)]
        held = {tuple(k.as_py() for k in key): total}
        yield send(held, batch.schema)

    return df.mapInArrow(run, head).groupBy(*by, "st_kernel").applyInArrow(merge, head)


class Prefix:
    """Sums of one kernel over the chunks of a key, carried to the end of any split."""

    def __init__(self, rows: pd.DataFrame, ends: list[int], half_life: float):
        self.rows, self.ends, self.half_life = rows, ends, half_life

    def to(self, split: int) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        """(rows, weights, gram, moment, yy) of the split's train."""
        total = [0, 0.0, 0.0, 0.0, 0.0]
        for r in self.rows[self.rows["st_chunk"] <= split].itertuples():
            back = self.ends[split] - self.ends[r.st_chunk]
            f = 1.0 if math.isinf(self.half_life) or self.half_life <= 0 else 2.0 ** (-back / self.half_life)
            moment = np.frombuffer(r.st_moment)
            gram = np.frombuffer(r.st_gram).reshape(len(moment), -1)
            total = [total[0] + r.st_n, *(a + f * b for a, b in zip(total[1:], (r.st_w, gram, moment, r.st_yy)))]
        return tuple(total)


MODELS = "st_split int, st_kernel int, coef array<double>, n_train long, norm double, train_loss double"


def fitted(df: DataFrame, kernels: list[Kernel], target: str, keys: list[str], order: list[str], splits: Splits, penalty: float, half_life: float, mean_one: bool) -> tuple[DataFrame, DataFrame]:
    """(rows marked with their splits, a model for each key, split and kernel). ``mean_one``: a train's weights have a mean of 1."""
    rows = splits.mark(df, keys, order)
    back = splits.end(F.col("st_chunk")) - 1 - F.col("st_nth")
    train = rows.where(F.col("st_chunk") < splits.n).withColumn("st_weight", decay(back, half_life))
    got = sums(train, [*keys, "st_chunk", "st_rows"], kernels, target, "st_weight")

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ends, out = [end for end, _, _ in splits.starts(int(part["st_rows"].iat[0]))], []
        for kernel, own in part.groupby("st_kernel"):
            prefix = Prefix(own, ends, half_life)
            for k in range(len(ends)):
                n, w, gram, moment, yy = prefix.to(k)
                if not n:
                    continue
                scale = n / w if mean_one else 1.0
                coef = ridge(gram * scale, moment * scale, penalty)
                loss = (yy - 2 * coef @ moment + coef @ gram @ coef) / n
                out.append((*key, k, int(kernel), coef.tolist(), int(n), float(np.linalg.norm(coef)), float(max(loss, 0.0))))
        return pd.DataFrame(out, columns=names)

    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(MODELS).fields])
    names = schema.names
    return rows, got.groupBy(*keys).applyInPandas(solve, schema)


def applied(rows: DataFrame, models: DataFrame, by: list[str], kernels: list[Kernel], outs: list[str]) -> DataFrame:
    """``rows`` with a column of predictions for each kernel. ``models`` has ``by``, st_kernel and coef.

    A group's models go through the same shuffle as its rows, before them, so that nothing is broadcast.
    """
    kept = rows.columns
    head = models.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("st_kernel", "coef"))).alias("st_coefs"))
    void = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in by]
    heads = head.select(*by, *void, "st_coefs", F.lit(0).alias("st_row"))
    both = rows.withColumn("st_coefs", F.lit(None).cast("map<int,array<double>>")).withColumn("st_row", F.lit(1)).unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, coefs = object(), {}
        for own, part in stretches(batches, by):
            if own != key:
                key, coefs = own, {}
                if part.column("st_row")[0].as_py() == 0:
                    coefs = {k: np.array(v) for k, v in part.column("st_coefs")[0].as_py()}
                    part = part.slice(1)
            if not len(part):
                continue
            got = []
            for k, kernel in enumerate(kernels):
                x = matrix(part, kernel.columns)
                y, seen = np.full(len(x), np.nan), np.isfinite(x).all(1)
                if k in coefs and seen.any():
                    y[seen] = kernel.map(x[seen]) @ coefs[k]
                got.append(pa.array(y, mask=np.isnan(y)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *got], names=[*kept, *outs])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in outs)])
    return both.repartition(*by).sortWithinPartitions(*by, "st_row").mapInArrow(run, schema)


def stage_one(
    df: DataFrame, kernels: list[Kernel], target: str, keys: list[str], order: list[str], splits: Splits = Splits(), penalty: float = 1e-3,
    half_life: float = math.inf, mean_one: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(test rows of ``df`` with split, nth and pred_<kernel>; a row for each key, split and kernel with its figures)."""
    rows, models = fitted(df, kernels, target, keys, order, splits, penalty, half_life, mean_one)
    test = rows.where("st_split is not null").drop("st_chunk", "st_rows")
    outs = [f"pred_{k.name}" for k in kernels]
    pred = applied(test, models, [*keys, "st_split"], kernels, outs).withColumnsRenamed({"st_split": "split", "st_nth": "nth"})
    called = F.element_at(F.array(*(F.lit(k.name) for k in kernels)), F.col("st_kernel") + 1)
    return pred, models.select(*keys, F.col("st_split").alias("split"), called.alias("kernel"), "n_train", "norm", "train_loss")


def walk_forward_ridge(
    df: DataFrame, columns: list[str], target: str, keys: list[str], order: list[str], penalty: float = 1.0, splits: Splits = Splits(), features: int = 64,
    half_life: float = math.inf,
) -> DataFrame:
    """Out-of-sample predictions (``split``, ``pred``) of weighted ridge on Fourier features, by key; weights have a mean of 1."""
    kernel = Kernel.fourier("all", tuple(columns), features)
    pred, _ = stage_one(df, [kernel], target, keys, order, splits, penalty, half_life, mean_one=True)
    return pred.withColumnRenamed("pred_all", "pred").drop("nth")


# --- second stage: kernels' predictions combined -------------------------------------------------------------------------

#: Fixed values of the combiners: expanding parts, inner folds, the ridge's grid, the elastic net's shares, Huber's bounds.
PARTS, INNER = 5, 3
RIDGE_ALPHAS = np.logspace(-6, -1, 50)
L1_RATIOS = (0.1, 0.5, 0.7, 0.9, 0.95)
HUBER_BOUND, HUBER_PENALTY = 1.35, 0.001


def with_parts(pred: DataFrame, keys: list[str]) -> DataFrame:
    """``pred`` with s2_nth (from 0 among a key's test rows) and s2_size: parts are ``s2_size`` rows, one more of them than PARTS."""
    w = Window.partitionBy(*keys).orderBy("nth")
    size = F.floor(F.count("*").over(Window.partitionBy(*keys)) / (PARTS + 1)).cast("long")
    return pred.withColumn("s2_nth", (F.row_number().over(w) - 1).cast("long")).withColumn("s2_size", size)


def inner_bounds(end: int) -> list[int]:
    """Bounds of the contiguous inner folds of a train of ``end`` rows; the first ones are longer by one where it doesn't divide."""
    size, more = divmod(end, INNER)
    return np.cumsum([0] + [size + (i < more) for i in range(INNER)]).tolist()


def segment_of(size: Column, nth: Column) -> Column:
    """A number that rises along ``nth`` wherever a train or an inner fold of any part ends."""
    total = F.lit(0)
    for part in range(1, PARTS + 1):
        end = size * part
        third, more = F.floor(end / INNER), end % INNER
        bound = F.lit(0)
        for i in range(INNER):
            bound = bound + third + (more > i).cast("long")
            total = total + (nth >= bound).cast("int")
    return total


def moments(rows: DataFrame, by: list[str], names: list[str], weight: Column | None = None) -> DataFrame:
    """By ``by``: sums of products of 1 and ``names``, as one array in the order of pairs i <= j; weighted."""
    w = F.lit(1.0) if weight is None else weight
    one = [F.lit(1.0), *(F.col(c) for c in names)]
    pairs = [F.sum(w * one[i] * one[j]) for i in range(len(one)) for j in range(i, len(one))]
    return rows.groupBy(*by).agg(F.array(*pairs).alias("sums"), F.min("s2_nth").alias("lo"), F.count("*").alias("n"))


def square(sums_: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = sums_
    return out + np.triu(out, 1).T


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """(rows, means of x then y, centred gram, centred moment, centred yy) from sums of products of 1, x and y."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    return n, mean, c[:-1, :-1], c[:-1, -1], max(c[-1, -1], 0.0)


def squared_error(m: np.ndarray, intercept: float, coef: np.ndarray) -> float:
    """Sum of (y - intercept - x coef)^2 from sums of products of 1, x and y."""
    v = np.concatenate([[-intercept], -coef, [1.0]])
    return float(max(v @ m @ v, 0.0))


def chosen_ridge(whole: np.ndarray, folds: list[np.ndarray]) -> tuple[float, np.ndarray, float, float]:
    """(intercept, coef, alpha, l1 share) of the alpha with the best mean R2 over the inner folds; the first of equals."""

    def fit(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        _, mean, gram, moment, _ = centred(m)
        coef = ridge(gram, moment, alpha)
        return mean[-1] - mean[:-1] @ coef, coef

    scores = []
    for alpha in RIDGE_ALPHAS:
        r2 = []
        for test in folds:
            total = centred(test)[-1]
            r2.append(1 - squared_error(test, *fit(whole - test, alpha)) / total if total > 0 else 0.0)
        scores.append(np.mean(r2))
    alpha = float(RIDGE_ALPHAS[int(np.argmax(scores))])
    return *fit(whole, alpha), alpha, 0.0


def elastic_nets(gram: np.ndarray, moment: np.ndarray, n: np.ndarray, alpha: np.ndarray, l1: np.ndarray, positive: bool, rounds: int = 2000) -> np.ndarray:
    """Weights of many elastic nets at once, a row of each array a problem: coordinate descent side by side."""
    w = np.zeros_like(moment)
    for _ in range(rounds):
        old = w.copy()
        for j in range(moment.shape[1]):
            slope = gram[:, j, j]
            rho = (moment[:, j] - np.einsum("pk,pk->p", gram[:, j], w) + slope * w[:, j]) / n
            v = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1, 0) / (slope / n + alpha * (1 - l1) + 1e-12)
            w[:, j] = np.maximum(v, 0) if positive else v
        if (np.abs(w - old).max(1) <= 1e-10 * np.maximum(np.abs(w).max(1), 1e-300)).all():
            break
    return w


def chosen_elastic(whole: np.ndarray, folds: list[np.ndarray], positive: bool = True, n_alphas: int = 50) -> tuple[float, np.ndarray, float, float]:
    """(intercept, coef, alpha, l1 share) of the least mean error over the inner folds, along a path of alphas for each share."""
    n, mean, gram, moment, _ = centred(whole)
    grid = []
    for l1 in L1_RATIOS:
        most = max(np.abs(moment).max() / (n * l1), 1e-300)
        grid += [(a, l1) for a in np.geomspace(most, most * 1e-3, n_alphas)]
    alpha, share = np.array(grid).T
    errors = np.zeros(len(grid))
    for test in folds:
        m, centre, g, v, _ = centred(whole - test)
        same = lambda x: np.broadcast_to(x, (len(grid), *np.shape(x)))
        coefs = elastic_nets(same(g), same(v), same(m), alpha, share, positive)
        errors += [squared_error(test, centre[-1] - centre[:-1] @ c, c) / test[0, 0] / len(folds) for c in coefs]
    best = int(np.argmin(errors))
    coef = elastic_nets(gram[None], moment[None], np.array([n]), alpha[[best]], share[[best]], positive)[0]
    return mean[-1] - mean[:-1] @ coef, coef, float(alpha[best]), float(share[best])


COMBINED = "s2_part int, intercept double, coef array<double>, alpha double, l1 double"


def combined(pred: DataFrame, columns: list[str], target: str, keys: list[str], how: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``pred`` in the parts after the first, with ``combined``; the weights of each key and part).

    Part s + 1 is predicted by the combiner fitted on parts 0 .. s. ``how``: elastic, ridge or huber. The first two are chosen
    by inner folds, from sums of products that one pass gives for all parts and folds at once.
    """
    rows = with_parts(pred, keys)
    seen = rows.where(F.col(target).isNotNull())
    for c in columns:
        seen = seen.where(F.col(c).isNotNull())
    if how == "huber":
        weights = huber(seen, columns, target, keys)
    else:
        choose = {"ridge": chosen_ridge, "elastic": chosen_elastic}[how]
        by = [*keys, "s2_size", "s2_segment"]
        got = moments(seen.where("s2_size > 0").withColumn("s2_segment", segment_of(F.col("s2_size"), F.col("s2_nth"))), by, [*columns, target])
        size = len(columns) + 2

        def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            segments = [(int(r.lo), square(np.array(r.sums), size)) for r in part.itertuples()]
            width, out = int(part["s2_size"].iat[0]), []
            for k in range(1, PARTS + 1):
                bounds = inner_bounds(k * width)
                within = lambda lo, hi: sum((m for at, m in segments if lo <= at < hi), np.zeros((size, size)))
                folds = [within(a, b) for a, b in zip(bounds, bounds[1:])]
                if all(f[0, 0] > 1 for f in folds):
                    intercept, coef, alpha, l1 = choose(sum(folds), folds)
                    out.append((*key, k, float(intercept), coef.tolist(), float(alpha), float(l1)))
            return pd.DataFrame(out, columns=[*keys, "s2_part", "intercept", "coef", "alpha", "l1"])

        weights = got.groupBy(*keys).applyInPandas(solve, T.StructType([*(pred.schema[k] for k in keys), *T.StructType.fromDDL(COMBINED).fields]))
    return weighted(rows, columns, keys, weights), weights


def weighted(rows: DataFrame, columns: list[str], keys: list[str], weights: DataFrame) -> DataFrame:
    part = F.least(F.floor(F.col("s2_nth") / F.col("s2_size")), F.lit(PARTS + 1)).cast("int")
    out = rows.where("s2_size > 0").withColumn("part", part).where(F.col("part").between(1, PARTS))
    own = weights.select(*(F.col(k).alias(f"s2_{k}") for k in keys), "s2_part", "intercept", "coef")
    on = F.col("part") == F.col("s2_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s2_{k}"))
    value = F.col("intercept")
    for i, c in enumerate(columns):
        value = value + F.col("coef")[i] * F.col(c)
    return out.join(own, on).withColumn("combined", value).drop("s2_nth", "s2_size", "s2_part", "intercept", "coef", *(f"s2_{k}" for k in keys))


def fixed_weights(pred: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    """``combined`` as the sum of the predictions by weights that are given."""
    if len(weights) != len(columns):
        raise ValueError(f"{len(weights)} weights for {len(columns)} predictions")
    return pred.withColumn("combined", sum((w * F.col(c) for w, c in zip(weights, columns)), F.lit(0.0)))


def huber(seen: DataFrame, columns: list[str], target: str, keys: list[str], rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weights that minimise n s + sum of s H((y - c - z w) / s) + penalty |w|^2, z being standardised by the train.

    H is a square up to HUBER_BOUND and a line beyond; w, c and the scale s are found together. Each round sums the rows of all
    keys and parts once, those within the bound and those beyond it apart. If the same rows stayed within, their sums give the
    least value at once; that step is taken while such steps shrink, else rows beyond the bound are weighted down (which always
    lowers the value). It ends once no key's figures move by more than ``tolerance`` of its scale.
    """
    size = len(columns)
    first = F.greatest(F.floor(F.col("s2_nth") / F.col("s2_size")) + 1, F.lit(1)).cast("int")
    # a row trains all parts after its own
    each = seen.where("s2_size > 0").where(F.col("s2_nth") < F.col("s2_size") * PARTS).withColumn("s2_part", F.explode(F.sequence(first, F.lit(PARTS))))
    at = [*keys, "s2_part"]
    begun = [F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*(F.stddev_pop(c) for c in columns)).alias("sd"), F.avg(target).alias("c"), F.stddev_pop(target).alias("s")]
    state = each.groupBy(*at).agg(*begun).withColumn("sd", F.transform("sd", lambda x: F.when(x > 0, x).otherwise(1.0)))
    state = state.withColumn("w", F.array_repeat(F.lit(0.0), size)).withColumn("moved", F.lit(1e9)).withColumn("s", F.greatest("s", F.lit(1e-12)))
    state = written(state, "huber")
    kept = [state.schema[k] for k in at]
    fields = T.StructType([*kept, *T.StructType.fromDDL("mean array<double>, sd array<double>, c double, s double, w array<double>, moved double").fields])

    bend = np.diag([0.0] + [HUBER_PENALTY] * size)

    def scale_of(inner: float, n: int, n_out: int) -> float:
        return max(math.sqrt(max(inner, 0.0) / max(n - n_out * HUBER_BOUND**2, 1e-9)), 1e-12)

    def weighed_down(near: np.ndarray, far: np.ndarray, r: dict) -> tuple[np.ndarray, float]:
        m = near + far
        return np.linalg.lstsq(m[:-1, :-1] + r["s"] * bend, m[:-1, -1], rcond=None)[0], scale_of(r["inner"], r["n"], r["n_out"])

    def at_once(near: np.ndarray, signs: np.ndarray, r: dict) -> tuple[np.ndarray, float]:
        """The least value if the rows within the bound stay the same."""
        v, s = np.array([r["c"], *r["w"]]), r["s"]
        for _ in range(200):
            new = np.linalg.lstsq(near[:-1, :-1] + s * bend, near[:-1, -1] + HUBER_BOUND * s * signs, rcond=None)[0]
            gap = np.append(-new, 1.0)
            t = scale_of(gap @ near @ gap, r["n"], r["n_out"])
            done = max(np.abs(new - v).max(), abs(t - s)) < 1e-13 * s
            v, s = new, t
            if done:
                break
        return v, s

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                near, far = (square(np.array(r[c]), size + 2) for c in ("near", "far"))
                before = np.array([r["c"], *r["w"]])
                move = lambda v, s: float(max(np.abs(v - before).max(), abs(s - r["s"])) / s)
                v, s = at_once(near, np.array(r["signs"]), r)
                if not move(v, s) < 0.5 * r["moved"]:
                    v, s = weighed_down(near, far, r)
                out.append(tuple(r[k] for k in at) + (list(r["mean"]), list(r["sd"]), float(v[0]), float(s), [float(x) for x in v[1:]], move(v, s)))
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    for _ in range(rounds):
        own = state.select(*(F.col(k).alias(f"hu_{k}") for k in at), "mean", "sd", "c", "s", "w", "moved")
        on = F.lit(True)
        for k in at:
            on = on & F.col(k).eqNullSafe(F.col(f"hu_{k}"))
        z = [(F.col(x) - F.col("mean")[i]) / F.col("sd")[i] for i, x in enumerate(columns)]
        gap = F.col(target) - F.col("c") - sum((F.col("w")[i] * z[i] for i in range(size)), F.lit(0.0))
        kept_state = ("mean", "sd", "c", "s", "w", "moved")
        rows = each.join(own, on).select(*at, *(v.alias(f"z{i}") for i, v in enumerate(z)), F.col(target).alias("hy"), gap.alias("gap"), *kept_state)
        bound = HUBER_BOUND * F.col("s")
        far = F.abs("gap") > bound
        one = [F.lit(1.0), *(F.col(f"z{i}") for i in range(size)), F.col("hy")]
        pairs = [one[i] * one[j] for i in range(len(one)) for j in range(i, len(one))]
        got = rows.groupBy(*at).agg(
            F.array(*(F.sum(F.when(far, 0.0).otherwise(p)) for p in pairs)).alias("near"), F.array(*(F.sum(F.when(far, bound / F.abs("gap") * p).otherwise(0.0)) for p in pairs)).alias("far"),
            F.array(*(F.sum(F.when(far, F.signum("gap") * x).otherwise(0.0)) for x in one[:-1])).alias("signs"), F.count("*").alias("n"), F.count_if(far).alias("n_out"),
            F.sum(F.when(far, 0.0).otherwise(F.col("gap") * F.col("gap"))).alias("inner"), *(F.first(c).alias(c) for c in kept_state),
        )
        state = written(got.mapInPandas(solve, fields), "huber")
        moved = state.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    # back to the predictions' own scale
    coef = F.zip_with("w", "sd", lambda w, d: w / d)
    shift = F.aggregate(F.zip_with(coef, "mean", lambda w, m: w * m), F.lit(0.0), lambda a, x: a + x)
    return state.select(*keys, "s2_part", (F.col("c") - shift).alias("intercept"), coef.alias("coef"), F.lit(HUBER_PENALTY).alias("alpha"), F.lit(0.0).alias("l1"))
