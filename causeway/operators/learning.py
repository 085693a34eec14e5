"""Kernel features, ridge by Gram sums, causal validation splits, and comparisons of feature spaces.

Rows stay distributed: a task turns its Arrow batches into feature matrices and returns sums of outer products by fold;
these D x D sums, D being a parameter, are all that is combined. Nothing of length n leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


class FourierMap:
    """Random Fourier features of a Matern kernel: sqrt(2 / D) cos(x W + b).

    ``sampler`` says how frequencies are drawn: "multivariate" t with 2 nu degrees (that of the kernel), "independent" t in each
    dimension, or "unscaled", a normal over the root of a gamma draw, without the factor sqrt(2 nu).
    """

    def __init__(self, dim: int, features: int = 128, nu: float = 1.5, length: float = 1.0, seed: int = 0, sampler: str = "multivariate"):
        rng = np.random.default_rng(seed)
        z = rng.standard_normal((dim, features))
        shape = {"multivariate": features, "independent": (dim, features), "unscaled": features}[sampler]
        spread = np.sqrt(rng.chisquare(2 * nu, shape) / (1.0 if sampler == "unscaled" else 2 * nu))
        self.w = z / spread / length
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / self.w.shape[1]) * np.cos(x @ self.w + self.b)


class TensorSketch:
    """Features of the product of two kernels: count sketches of both, multiplied in the frequency domain."""

    def __init__(self, left: int, right: int, features: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n = features
        self.place = [rng.integers(0, features, d) for d in (left, right)]
        self.sign = [rng.choice([-1.0, 1.0], d) for d in (left, right)]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = []
        for x, place, sign in zip((a, b), self.place, self.sign):
            sketch = np.zeros((len(x), self.n))
            np.add.at(sketch.T, place, (x * sign).T)
            out.append(np.fft.rfft(sketch, axis=1))
        return np.fft.irfft(out[0] * out[1], self.n, axis=1)


class TwoLevel:
    """Fast features beside their product with slow ones: [fast, sqrt(beta) sketch(fast, sqrt(gate) slow)], times an event gate.

    Its input holds ``n_fast`` fast columns, then the slow ones, the gate of the slow level and the gate of the row. A fast map of
    D features and a sketch of M give D + M.
    """

    def __init__(self, n_fast: int, fast: Callable, slow: Callable, sketch: TensorSketch, beta: float = 1.0):
        self.n_fast, self.fast, self.slow, self.sketch, self.beta = n_fast, fast, slow, sketch, beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        fast = self.fast(x[:, : self.n_fast])
        slow = self.slow(x[:, self.n_fast : -2]) * np.sqrt(x[:, [-2]])
        return np.column_stack([fast, math.sqrt(max(self.beta, 0.0)) * self.sketch(fast, slow)]) * x[:, [-1]]


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def mapped(df: DataFrame, columns: list[str], transform: Callable[[np.ndarray], np.ndarray], out: str = "phi") -> DataFrame:
    """Adds an array column of features of each row."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = transform(matrix(batch, columns))
            values = pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), phi.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, {out} array<double>")


def grams(df: DataFrame, columns: list[str], target: str, transform: Callable, group: str = "fold", weight: str | None = None) -> pd.DataFrame:
    """For each group: n, sum of w phi phi' and sum of w phi y. One pass, one small row for each task and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            phi, y = transform(matrix(batch, columns)), batch.column(target).to_numpy(zero_copy_only=False).astype(float)
            w = batch.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(len(y))
            g = batch.column(group).to_numpy(zero_copy_only=False)
            for k in np.unique(g):
                own = g == k
                p = phi[own] * w[own, None]
                new = [int(own.sum()), p.T @ phi[own], p.T @ y[own], float((w[own] * y[own] ** 2).sum())]
                held[int(k)] = [a + b for a, b in zip(held[int(k)], new)] if int(k) in held else new
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()),
                    pa.array([v[1].tobytes() for v in held.values()], pa.binary()), pa.array([v[2].tobytes() for v in held.values()], pa.binary()),
                    pa.array([v[3] for v in held.values()], pa.float64()),
                ],
                names=["fold", "n", "gram", "moment", "yy"],
            )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum(np.frombuffer(b) for b in rows[c]).tobytes()
        return pd.DataFrame({"fold": [rows["fold"].iat[0]], "n": [rows["n"].sum()], "gram": [total("gram")], "moment": [total("moment")], "yy": [rows["yy"].sum()]})

    schema = "fold long, n long, gram binary, moment binary, yy double"
    return df.mapInArrow(run, schema).groupBy("fold").applyInPandas(merge, schema).toPandas().sort_values("fold", ignore_index=True)


def ridge(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(gram + penalty * np.eye(len(moment)), moment)


def elastic_net(gram: np.ndarray, moment: np.ndarray, n: int, alpha: float, l1: float, positive: bool = True, rounds: int = 500, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on |y - Xw|^2 / 2n + alpha (l1 |w| + (1 - l1) |w|^2 / 2), from sums alone."""
    w = np.zeros(len(moment)) if start is None else start.copy()
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            rho = (moment[j] - gram[j] @ w + gram[j, j] * w[j]) / n
            v = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (gram[j, j] / n + alpha * (1 - l1) + 1e-12)
            w[j] = max(v, 0) if positive else v
        if np.abs(w - old).max() <= 1e-10 * max(np.abs(w).max(), 1e-300):
            break
    return w


def decay_weight(nth: Column, n: Column, half_life: float) -> Column:
    """The newest row weighs 1, one half-life before half."""
    if math.isinf(half_life) or half_life <= 0:
        return F.lit(1.0)
    return F.exp(F.lit(-math.log(2) / half_life) * (n - 1 - nth))


def walk_forward(n: int, splits: int, min_train: int, embargo: int) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) of expanding splits; the train ends ``embargo`` rows before its test."""
    start = min_train + embargo
    size = (n - start) // splits
    return [(start + k * size - embargo, start + k * size, start + (k + 1) * size) for k in range(splits)] if size > 0 else []


def purged_folds(n: int, k: int, embargo: int) -> list[tuple[int, int, int, int]]:
    """(test start, test end, purge start, purge end) of contiguous folds; rows of the remainder are never tested."""
    size = n // k
    return [(i * size, (i + 1) * size, max(0, i * size - embargo), min(n, (i + 1) * size + embargo)) for i in range(k)]


def combinatorial_folds(groups: int, test: int) -> list[tuple[int, ...]]:
    return list(combinations(range(groups), test))


def cka(cross: np.ndarray, left: np.ndarray, right: np.ndarray) -> float:
    """Centred kernel alignment of two feature maps from their centred D x D products; no n x n matrix."""
    return float((cross**2).sum() / (np.linalg.norm(left) * np.linalg.norm(right) + 1e-12))


def alignment(df: DataFrame, left: list[str], right: list[str]) -> float:
    """CKA of two column sets, with linear kernels, from one pass of sums."""
    both = [*left, *right]
    sums = grams(df.withColumn("fold", F.lit(0)), both, both[0], lambda x: np.column_stack([np.ones(len(x)), x]))
    g = np.frombuffer(sums["gram"].iat[0]).reshape(len(both) + 1, -1)
    centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    k = len(left)
    return cka(centred[:k, k:], centred[:k, :k], centred[k:, k:])


def effective_dimension(gram: np.ndarray) -> float:
    """exp of the entropy of the spectrum; phi' phi has the non-zero spectrum of phi phi'."""
    e = np.clip(np.linalg.eigvalsh(gram), 0, None)
    p = e[e > 1e-12 * e.max(initial=0)] / e.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def expanding_pca(df: DataFrame, columns: list[str], keys: list[str], order: list[str], k: int, warm: int) -> DataFrame:
    """First k components of each row by the axes of the rows before it; the raw first k columns until ``warm`` rows.

    Axes are signed so that their largest entry is positive. A fold by key over running first and second moments.
    """
    fields = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in (*keys, *order))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable", ignore_index=True)
        x = part[columns].to_numpy(float)
        s, m, out = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), np.empty((len(x), k))
        for i, row in enumerate(x):
            if i < warm:
                out[i] = row[:k]
            else:
                mean = s / i
                _, v = np.linalg.eigh(m / i - np.outer(mean, mean))
                v = v[:, ::-1][:, :k]
                v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
                out[i] = (row - mean) @ v
            s += row
            m += np.outer(row, row)
        return part[[*keys, *order]].assign(**{f"pc{j + 1}": out[:, j] for j in range(k)})

    return df.groupBy(*keys).applyInPandas(fold, fields + "".join(f", pc{j + 1} double" for j in range(k)))


def matern(d: Column, nu: float, length: float) -> Column:
    """The closed forms of the Matern kernel at distance d for nu = 1/2, 3/2, 5/2."""
    a = F.sqrt(F.lit(2 * nu)) * d / length
    forms = {0.5: F.exp(-a), 1.5: (1 + a) * F.exp(-a), 2.5: (1 + a + a * a / 3) * F.exp(-a)}
    return forms[nu]


def hawkes_likelihood(times: np.ndarray, mu: float, alpha: float, beta: float) -> float:
    """Log-likelihood of a self-exciting process with exponential decay, by recursion."""
    t = times - times[0]
    total, a = math.log(mu), 0.0
    for gap in np.diff(t):
        a = math.exp(-beta * gap) * (1 + a)
        total += math.log(mu + alpha * a)
    return total - mu * t[-1] - alpha / beta * (1 - np.exp(-beta * (t[-1] - t))).sum()


def hawkes_fit(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """mu, alpha, beta of each key's event times by a search over decay and branching ratio that narrows thrice."""
    fields = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keys)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(part[seconds].to_numpy(float))
        rate = (len(t) - 1) / max(t[-1] - t[0], 1e-9)
        best, centre, width = (-math.inf, rate, 0.0, 1.0), (math.log(rate), 0.3), (3.0, 0.29)
        for _ in range(3):
            for lb in np.linspace(centre[0] - width[0], centre[0] + width[0], 7):
                for branch in np.clip(np.linspace(centre[1] - width[1], centre[1] + width[1], 7), 0.001, 0.98):
                    beta = math.exp(lb)
                    got = hawkes_likelihood(t, rate * (1 - branch), branch * beta, beta)
                    if got > best[0]:
                        best, centre_new = (got, rate * (1 - branch), branch * beta, beta), (lb, branch)
            centre, width = centre_new, (width[0] / 3, width[1] / 3)
        return pd.DataFrame([(*key, best[1], best[2], best[3], best[0])])

    return df.groupBy(*keys).applyInPandas(fit, f"{fields}, mu double, alpha double, beta double, log_likelihood double")
