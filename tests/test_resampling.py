"""Resampled paths against numpy, from the same drawn blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import resampling

KEYS = ["strategy"]


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(i), None if i == 3 else float(x)) for k, n in (("a", 700), ("b", 31), (None, 1)) for i, x in enumerate(rng.normal(0.05, 1, n))]
    return spark.createDataFrame(rows, "strategy string, day long, pnl double").repartition(4)


@pytest.fixture(scope="module")
def values(trades):
    out = {}
    for r in trades.where("pnl is not null").orderBy("day").collect():
        out.setdefault(r.strategy, []).append(r.pnl)
    return {k: np.array(v) for k, v in out.items()}


def paths(blocks, values):
    """{(key, sim): profits} by the blocks that were drawn, each checked to follow the one before."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (str(r.strategy), r.sim, r.at)):
        x, path = values[r.strategy], out.setdefault((r.strategy, r.sim), [])
        assert r.at == len(path) and 0 <= r.start < len(x) and r.size > 0
        path += [x[(r.start + i) % len(x)] for i in range(r.size)]
    return {k: np.array(v) for k, v in out.items()}


def figures(x, risk=0.01, ruin=-0.5):
    equity = np.cumprod(np.append(1.0, 1 + risk * x))
    peak = np.maximum.accumulate(equity)
    depth = ((equity - peak) / peak).min()
    lost = -x[x < 0].sum()
    return {
        "total": equity[-1] - 1, "max_drawdown": depth, "win_rate": (x > 0).mean(), "profit_factor": x[x > 0].sum() / (lost if lost > 0 else 1e-9),
        "expectancy": x.mean(), "sharpe": x.mean() / x.std() if x.std() > 1e-9 else 0.0, "ruin": float(depth <= ruin), "n_trades": len(x),
    }


@pytest.mark.parametrize("mean_block, risk", [(10, 0.01), (1, 0.2), (1000, 0.05)])
def test_figures_of_each_path(trades, values, mean_block, risk):
    series = resampling.numbered(trades, KEYS, ["day"], "pnl")
    drawn = paths(resampling.stationary_blocks(resampling.simulations(series, KEYS, 40), KEYS, mean_block, 7), values)
    got = {(r.strategy, r.sim): r for r in resampling.bootstrap(trades, KEYS, ["day"], "pnl", 40, mean_block, 7, risk).collect()}
    drawn |= {(k, 0): x for k, x in values.items()}
    assert got.keys() == drawn.keys() and len(got) == 41 * 3
    for key, x in drawn.items():
        assert len(x) == len(values[key[0]])
        want = figures(x, risk)
        assert {c: got[key][c] for c in resampling.FIGURES} == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_blocks_are_geometric_and_start_anywhere(trades):
    series = resampling.numbered(trades.where("strategy = 'a'"), KEYS, ["day"], "pnl")
    rows = resampling.stationary_blocks(resampling.simulations(series, KEYS, 400), KEYS, 10, 7).collect()
    assert sum(r.size for r in rows) == 400 * 699
    assert len(rows) == pytest.approx(400 * 699 / 10, rel=0.03)
    starts = np.bincount([r.start * 10 // 699 for r in rows], minlength=10) / len(rows)
    assert np.all(np.abs(starts - 0.1) < 0.01)
    assert rows and len({(r.sim, r.at) for r in rows}) == len(rows)


def test_intervals(trades):
    sims = resampling.bootstrap(trades, KEYS, ["day"], "pnl", 200).cache()
    got = {(r.strategy, r.figure): r for r in resampling.intervals(sims, KEYS).collect()}
    rows = sims.collect()
    for k in ("a", "b"):
        for c in resampling.FIGURES:
            v = np.array([r[c] for r in rows if r.strategy == k and r.sim > 0], float)
            r = got[k, c]
            want = (v.mean(), np.median(v), *np.percentile(v, [5, 95]), (v < 0).mean())
            assert (r["mean"], r.median, r.ci_5, r.ci_95, r.p_negative) == pytest.approx(want)
            assert r.observed == pytest.approx(next(x[c] for x in rows if x.strategy == k and x.sim == 0))


def test_fan_by_step(trades, values):
    series = resampling.numbered(trades, KEYS, ["day"], "pnl")
    blocks = resampling.fixed_blocks(resampling.simulations(series, KEYS, 60), KEYS, 20, 7)
    assert all(r.size <= 20 and r.start + r.size <= r.n for r in blocks.collect())
    drawn = paths(blocks, values)
    got = {(r.strategy, r.step): r for r in resampling.fan(trades, KEYS, ["day"], "pnl", 60).collect()}
    assert len(got) == sum(map(len, values.values()))
    for k, x in values.items():
        sums = np.cumsum([p for (key, _), p in drawn.items() if key == k], axis=1)
        for step in (1, 2, 20, 21, len(x)):
            if step <= len(x):
                assert [got[k, step][f"p{p}"] for p in resampling.PERCENTS] == pytest.approx(np.percentile(sums[:, step - 1], resampling.PERCENTS).tolist())


def test_sharpe_interval(trades, values):
    days = trades.withColumn("pnl", F.when(F.col("day") % 3 == 0, 0.0).otherwise(F.col("pnl")))
    got = {r.strategy: r for r in resampling.sharpe_interval(days, KEYS, ["day"], "pnl", 300).collect()}
    assert set(got) == {"a", "b"}
    x = np.array([r.pnl for r in days.where("strategy = 'a' and pnl <> 0").collect()])
    assert got["a"].n_days == len(x) and got["a"].observed == pytest.approx(x.mean() / x.std() * math.sqrt(252))
    assert got["a"].ci_5 < got["a"].median < got["a"].ci_95 and got["a"].ci_95 - got["a"].ci_5 == pytest.approx(2 * 1.645 * math.sqrt(252 / len(x)), rel=0.25)


def test_no_task_holds_a_series(trades):
    """A simulation's rows are its pieces, a series' its chunks."""
    series = resampling.numbered(trades, KEYS, ["day"], "pnl")
    path = resampling.pieces(resampling.stationary_blocks(resampling.simulations(series, KEYS, 20), KEYS, 10, 7), series, KEYS)
    assert path.agg(F.max(F.size("xs"))).first()[0] <= resampling.CHUNK
    assert path.count() < 20 * 800 / 10 * 1.5


def rows_of(df, by):
    return {tuple(r[c] for c in by): [v for c, v in r.asDict().items() if c not in by] for r in df.collect()}


@pytest.mark.parametrize("mean_block", [1, 10, 1000])
def test_arrays_and_rows_give_the_same_paths(trades, monkeypatch, mean_block):
    """Keys of up to HELD profits as arrays, in parts of a path, and all others by joins."""
    monkeypatch.setattr(resampling, "PLACES", 64)
    run = lambda: rows_of(resampling.bootstrap(trades, KEYS, ["day"], "pnl", 30, mean_block, 7, 0.05), ["strategy", "sim"])
    held = run()
    monkeypatch.setattr(resampling, "HELD", 100)  # "a" is longer, the others are not
    mixed = run()
    assert held.keys() == mixed.keys() and len(held) == 31 * 3
    for k, v in held.items():
        assert mixed[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_arrays_and_rows_give_the_same_fan(trades, monkeypatch):
    run = lambda: rows_of(resampling.fan(trades, KEYS, ["day"], "pnl", 50), ["strategy", "step"])
    monkeypatch.setattr(resampling, "LEVELS", 500)  # ten steps at a time
    monkeypatch.setattr(resampling, "DRAWN", 7)
    held = run()
    monkeypatch.setattr(resampling, "HELD", 100)
    mixed = run()
    assert held.keys() == mixed.keys() and len(held) == 699 + 30 + 1
    for k, v in held.items():
        assert mixed[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_paths_are_not_shuffled(trades):
    """What a path is made of stays in its task: the plan of a key that fits one has no join, and no window but that which numbers trades."""
    for df in (resampling.bootstrap(trades, KEYS, ["day"], "pnl", 40), resampling.fan(trades, KEYS, ["day"], "pnl", 40)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Window" not in plan


def test_what_is_not_finite_is_no_profit(spark, trades):
    odd = spark.createDataFrame([("b", 5, float("nan")), ("b", 7, float("inf")), ("a", 9, float("-inf"))], "strategy string, day long, pnl double")
    run = lambda df: rows_of(resampling.bootstrap(df, KEYS, ["day"], "pnl", 5), ["strategy", "sim"])
    assert run(trades.unionByName(odd)) == run(trades)
