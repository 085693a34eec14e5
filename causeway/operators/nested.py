"""Nested validation: within each expanding split, a scaler of its train alone and a grid search over purged inner folds.

No model is refitted from rows. A chunk of rows gives count, mean and variance once, and the scaler of a split joins those of
its chunks. A split's train is cut wherever an inner fold or its purged margin begins or ends; each of these segments is summed once
for each length scale of the grid, and an inner train is the whole less the segments that its fold purges. All penalties share
these sums, and so does the last fit on the whole train.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.functions.tables import written
from causeway.operators.learning import ridge
from causeway.operators.staged import Kernel, Splits, applied, decay, sums

CHOSEN = "ne_outer int, st_kernel int, length double, penalty double, score double, coef array<double>, n_train long, train_loss double"


def scalers(rows: DataFrame, columns: list[str], keys: list[str], splits: Splits) -> DataFrame:
    """keys, ne_outer, mean and sd (arrays): of the rows that each split trains on; a spread below 1e-10 counts as 1."""
    per = [F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")) for c in columns]
    chunks = rows.where(F.col("st_chunk") < splits.n).groupBy(*keys, "st_chunk", "st_rows").agg(F.array(*per).alias("parts"))

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ends, out = splits.starts(int(part["st_rows"].iat[0])), []
        for k in range(len(ends)):
            own = [[(p["n"], p["mean"], p["var"]) for p in r] for c, r in zip(part["st_chunk"], part["parts"]) if c <= k]
            mean, sd = [], []
            for column in zip(*own):
                n, m, v = (np.array([x[i] if x[i] is not None else 0.0 for x in column], float) for i in range(3))
                whole = (n @ m) / n.sum() if n.sum() else 0.0
                spread = math.sqrt((n @ (v + (m - whole) ** 2)) / n.sum()) if n.sum() else 0.0
                mean.append(float(whole))
                sd.append(spread if spread >= 1e-10 else 1.0)
            if own:
                out.append((*key, k, mean, sd))
        return pd.DataFrame(out, columns=[*keys, "ne_outer", "mean", "sd"])

    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL("ne_outer int, mean array<double>, sd array<double>").fields])
    return chunks.groupBy(*keys).applyInPandas(join, schema)


def inner_folds(end: int, folds: int, embargo: int) -> list[tuple[int, int, int, int]]:
    """(test start, test end, purge start, purge end) of contiguous folds of a train of ``end`` rows."""
    size = end // folds
    return [(i * size, (i + 1) * size, max(0, i * size - embargo), min(end, (i + 1) * size + embargo)) for i in range(folds)]


def segment_start(end: Column, nth: Column, folds: int, embargo: int) -> Column:
    """The last place up to ``nth`` where an inner fold or its margin begins or ends."""
    size = F.floor(end / folds)
    cuts = [F.lit(0)]
    for i in range(folds):
        cuts += [size * i - embargo, size * i, size * (i + 1), size * (i + 1) + embargo]
    return F.greatest(*(F.when(c.cast("long") <= nth, c.cast("long")).otherwise(F.lit(0)) for c in cuts))


def nested_cv(
    df: DataFrame, columns: list[str], target: str, keys: list[str], order: list[str], lengths: tuple[float, ...] = (0.5, 1.0, 2.0),
    penalties: tuple[float, ...] = (1e-3, 1e-1, 10.0), nu: float = 1.5, features: int = 32, seed: int = 0, splits: Splits = Splits(),
    folds: int = 3, embargo: int = 5, half_life: float = math.inf,
) -> tuple[DataFrame, DataFrame]:
    """(test rows of ``df`` with split, nth and pred; what each key and split chose: length, penalty, score, n_train, train_loss).

    The score is the mean of the inner folds' negative squared errors; of equals the first length, then penalty, wins. Weights
    have a mean of 1 in each train. The spectral draw of a length is that of ``seed``, scaled.
    """
    kernels = [Kernel.fourier(f"l{i}", tuple(f"ne_z{j}" for j in range(len(columns))), features, nu, length, seed) for i, length in enumerate(lengths)]
    rows = splits.mark(df, keys, order)
    complete = F.lit(True)
    for c in (*columns, target):
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # written, so that a key with very many rows can be split
    scale = written(scalers(rows.where(complete), columns, keys, splits), "scalers")
    own = scale.select(*(F.col(k).alias(f"ne_{k}") for k in keys), "ne_outer", "mean", "sd")

    def scaled(some: DataFrame) -> DataFrame:
        on = F.col("outer") == F.col("ne_outer")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"ne_{k}"))
        z = {f"ne_z{j}": (F.col(c) - F.col("mean")[j]) / F.col("sd")[j] for j, c in enumerate(columns)}
        return some.join(own, on).withColumns(z).drop("mean", "sd", "outer", *(f"ne_{k}" for k in keys))

    train = rows.where(complete & (F.col("st_chunk") < splits.n)).select(*dict.fromkeys([*keys, *columns, target]), "st_nth", "st_rows", "st_chunk")
    train = train.withColumn("outer", F.explode(F.sequence("st_chunk", F.lit(splits.n - 1))))
    train = scaled(train)
    end = splits.end(F.col("ne_outer"))
    train = train.withColumn("ne_lo", segment_start(end, F.col("st_nth"), folds, embargo))
    train = train.withColumn("st_weight", decay(end - 1 - F.col("st_nth"), half_life)).withColumn("st_one", F.lit(1.0))
    by = [*keys, "ne_outer", "st_rows", "ne_lo"]
    got = sums(train, by, kernels, target, "st_weight").withColumn("ne_kind", F.lit(0))
    if not math.isinf(half_life):
        got = got.unionByName(sums(train, by, kernels, target, "st_one").withColumn("ne_kind", F.lit(1)))  # tests are not weighted

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        end_ = splits.starts(int(part["st_rows"].iat[0]))
        if key[-1] >= len(end_):
            return pd.DataFrame([], columns=names)
        end_ = end_[key[-1]][0]
        table: dict[tuple, list] = {}
        for r in part.itertuples():
            moment = np.frombuffer(r.st_moment)
            table.setdefault((r.st_kernel, r.ne_kind), []).append((r.ne_lo, r.st_n, r.st_w, np.frombuffer(r.st_gram).reshape(len(moment), -1), moment, r.st_yy))
        within = lambda parts, lo, hi: [sum((p[i] for p in parts if lo <= p[0] < hi), 0.0) for i in range(1, 6)]
        best = None
        for k, length in enumerate(lengths):
            weighted = table[k, 0]
            plain = table.get((k, 1), weighted)
            whole = within(weighted, 0, end_)
            inner = [(within(plain, a, b), [x - y for x, y in zip(whole, within(weighted, c, d))]) for a, b, c, d in inner_folds(end_, folds, embargo)]
            for penalty in penalties:
                scores = []
                for (n, _, gram, moment, yy), (m, w, g, v, _) in inner:
                    if n and m:
                        coef = ridge(g * (m / w), v * (m / w), penalty)
                        scores.append(-max(yy - 2 * coef @ moment + coef @ gram @ coef, 0.0) / n)
                score = float(np.mean(scores)) if scores else -math.inf
                if best is None or score > best[0]:
                    best = score, k, length, penalty, whole
        score, k, length, penalty, (n, w, gram, moment, yy) = best
        coef = ridge(gram * (n / w), moment * (n / w), penalty)
        loss = max(yy - 2 * coef @ moment + coef @ gram @ coef, 0.0) / n
        return pd.DataFrame([(*key, k, float(length), float(penalty), score, coef.tolist(), int(n), float(loss))], columns=names)

    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(CHOSEN).fields])
    names = schema.names
    chosen = written(got.groupBy(*keys, "ne_outer").applyInPandas(choose, schema), "chosen")
    test = scaled(rows.where("st_split is not null").withColumn("outer", F.col("st_split")).drop("st_rows", "st_chunk"))
    outs = [f"ne_pred{k}" for k in range(len(kernels))]
    pred = applied(test, chosen.select(*keys, "ne_outer", "st_kernel", "coef"), [*keys, "ne_outer"], kernels, outs)
    # one length was chosen, so one of them is there
    pred = pred.withColumn("pred", F.coalesce(*outs)).drop(*outs, "ne_outer", *kernels[0].columns).withColumnsRenamed({"st_split": "split", "st_nth": "nth"})
    return pred, chosen.withColumnRenamed("ne_outer", "split").drop("st_kernel", "coef")
