"""Queries that SQL cannot express, each against a brute-force version over the whole table."""

import math
from itertools import product

import numpy as np
import pytest

from causeway.operators import learning, rolling, signals, stacking
from causeway.plans import extra, learning as plans, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def days(spark):
    """Features, target and fold of each symbol's days, in order."""
    out = {}
    for r in extra.folded(spark, SF).orderBy("symbol", "day").collect():
        out.setdefault(r.symbol, []).append(r)
    return out


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def columns(rows, names):
    return np.array([[r[c] for c in names] for r in rows], float)


def test_fourier_features(spark, days):
    phi = learning.FourierMap(3, 32)
    want = {(k, r.day): v for k, rows in days.items() for r, v in zip(rows, phi(columns(rows, plans.FEATURES)))}
    got = {(r.symbol, r.day): r.phi for r in run(spark, "fourier_features")}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_fourier_features_stand_for_the_kernel():
    """Products of features come near the kernel that they are drawn for."""
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 200, 3))
    phi = learning.FourierMap(3, 40_000, 1.5, 1.3)
    d = np.linalg.norm(a - b, axis=1) * math.sqrt(3) / 1.3
    assert np.abs((phi(a) * phi(b)).sum(1) - (1 + d) * np.exp(-d)).max() < 0.05


def test_tensor_sketch(spark, days):
    """Each pair of features is hashed to its place: the sketch spelled out."""
    fast, slow, sketch = learning.FourierMap(2, 32), learning.FourierMap(1, 16, seed=1), learning.TensorSketch(32, 16, 64)
    got = {(r.symbol, r.day): r.phi for r in run(spark, "tensor_sketch")}
    assert len(got) == sum(map(len, days.values()))
    for k, rows in days.items():
        for r, a, b in list(zip(rows, fast(columns(rows, ["z", "mom5"])), slow(columns(rows, ["vol"]))))[::50]:
            want = np.zeros(64)
            for i, j in product(range(32), range(16)):
                want[(sketch.place[0][i] + sketch.place[1][j]) % 64] += sketch.sign[0][i] * sketch.sign[1][j] * a[i] * b[j]
            assert np.allclose(got[k, r.day], want)


def test_expanding_pca(spark, days):
    got = {(r.symbol, r.day): (r.pc1, r.pc2) for r in run(spark, "expanding_pca")}
    assert len(got) == sum(map(len, days.values()))
    for k, rows in days.items():
        x = columns(rows, plans.FEATURES)
        assert all(got[k, r.day] == pytest.approx(tuple(v[:2])) for r, v in zip(rows[:60], x))
        for i in range(60, len(rows), 37):
            past = x[:i] - x[:i].mean(0)
            _, _, axes = np.linalg.svd(past, full_matrices=False)
            axes = axes[:2] * np.sign(axes[np.arange(2), np.abs(axes[:2]).argmax(1)])[:, None]
            assert got[k, rows[i].day] == pytest.approx(tuple(axes @ (x[i] - x[:i].mean(0))), abs=1e-7)


def test_hawkes_fit(spark):
    """The likelihood by its double sum, and none better nearby."""
    from causeway.sources import views

    times = {}
    for r in views.tape_ev(spark, SF).selectExpr("symbol", "to_date(ts) as day", "us / 1e6 as sec").collect():
        times.setdefault((r.symbol, r.day), []).append(r.sec)

    def likelihood(t, mu, alpha, beta):
        t = np.sort(t) - min(t)
        rate = [mu + alpha * np.exp(-beta * (x - t[:i])).sum() for i, x in enumerate(t)]
        return np.log(rate).sum() - mu * t[-1] - alpha / beta * (1 - np.exp(-beta * (t[-1] - t))).sum()

    got = run(spark, "hawkes_fit")
    assert {(r.symbol, r.day) for r in got} == set(times)
    for r in got[::3]:
        t = times[r.symbol, r.day]
        assert r.log_likelihood == pytest.approx(likelihood(t, r.mu, r.alpha, r.beta), rel=1e-6)
        poisson = likelihood(t, (len(t) - 1) / (max(t) - min(t)), 0.0, 1.0) if len(t) > 1 else -math.inf
        assert r.log_likelihood >= poisson - 0.05 * abs(poisson) and 0 <= r.alpha / r.beta < 1


def test_controls(spark, days):
    shuffled, noise = ({(r.symbol, r.day): r for r in run(spark, n)} for n in ("shuffled_control", "noise_control"))
    moved = 0
    for k, rows in days.items():
        # a control deals whole rows of features out anew, so that what belongs together stays together
        before, after = columns(rows, plans.FEATURES), columns([shuffled[k, r.day] for r in rows], plans.FEATURES)
        assert sorted(map(tuple, before.round(9))) == sorted(map(tuple, after.round(9)))
        assert [shuffled[k, r.day].y for r in rows] == [r.y for r in rows]
        moved += (before != after).any(1).sum()
    assert moved > 0.9 * sum(map(len, days.values()))
    x = columns(noise.values(), plans.FEATURES)
    assert np.abs(x.mean(0)).max() < 0.06 and np.abs(x.std(0) - 1).max() < 0.05 and np.abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.06
    assert all(noise[k, r.day].y == r.y for k, rows in days.items() for r in rows)


def by_fold(days):
    rows = [r for own in days.values() for r in own]
    return [[r for r in rows if r.fold == f] for f in range(5)]


def test_grid_search(spark, days):
    parts = by_fold(days)
    got = {(r.nu, r.length, r.penalty): r.error for r in run(spark, "grid_search")}
    assert len(got) == 2 * 2 * 3
    for (nu, length, penalty), error in got.items():
        phi, errors = learning.FourierMap(3, 32, nu, length), []
        for k in range(1, 5):
            train = [r for part in parts[:k] for r in part]
            x, y = phi(columns(train, plans.FEATURES)), columns(train, ["y"])[:, 0]
            w = np.linalg.solve(x.T @ x + penalty * np.eye(32), x.T @ y)
            errors.append(np.mean((columns(parts[k], ["y"])[:, 0] - phi(columns(parts[k], plans.FEATURES)) @ w) ** 2))
        assert error == pytest.approx(np.mean(errors), rel=1e-6)


def test_stacked_weights(spark, days):
    """The conditions of the least value of the non-negative elastic net, fold by fold."""
    parts = by_fold(days)
    for r in run(spark, "stacked_weights"):
        train = [x for part in parts[: r.fold] for x in part]
        x, y, w = columns(train, plans.FEATURES), columns(train, ["y"])[:, 0], np.array([r[c] for c in plans.FEATURES])
        slope = x.T @ (x @ w - y) / len(y) + 1e-6 * 0.5 * (1 + w)
        assert (w >= 0).all() and np.abs(slope[w > 0]).max(initial=0) < 1e-7 and (slope[w == 0] > -1e-7).all()


def test_kernel_weights(spark, days):
    """No weights on a grid have a loss that is clearly lower."""
    rows = [r for own in days.values() for r in own]
    a, b = learning.FourierMap(2, 16), learning.FourierMap(1, 16, seed=1)
    x, y = columns(rows, plans.FEATURES), columns(rows, ["y"])[:, 0]
    left, right = a(x[:, :2]), b(x[:, 2:])

    def loss(v):
        phi = np.column_stack([math.sqrt(v) * left, math.sqrt(1 - v) * right])
        w = np.linalg.solve(phi.T @ phi + np.eye(32), phi.T @ y)
        return ((y - phi @ w) ** 2).mean() + w @ w / len(y)

    got = {r.kernel: r.weight for r in run(spark, "kernel_weights")}
    assert got["fast"] + got["slow"] == pytest.approx(1) and min(got.values()) >= 0
    grid = [loss(v) for v in np.linspace(0, 1, 41)]
    assert loss(got["fast"]) <= min(grid) + 0.02 * (max(grid) - min(grid))


def test_layer_redundancy(spark, days):
    """Alignment of the centred n x n kernels, written out."""
    rows = [r for own in days.values() for r in own]
    layers = {"trend": ["z", "mom5"], "risk": ["vol"], "momentum": ["mom5"]}

    def kernel(names):
        x = columns(rows, names)
        x = x - x.mean(0)
        return x @ x.T

    k = {n: kernel(c) for n, c in layers.items()}
    for r in run(spark, "layer_redundancy"):
        want = (k[r.layer_a] * k[r.layer_b]).sum() / (np.linalg.norm(k[r.layer_a]) * np.linalg.norm(k[r.layer_b]))
        assert r.cka == pytest.approx(want, abs=1e-6)
        assert r.verdict == ("redundant" if want >= 0.75 else "independent" if want <= 0.5 else "ambiguous")


def test_stream_positions(spark):
    """The stream's rows are those of the filter and the state machine over each symbol's whole series."""
    e = plans.event_stream(spark, SF)
    table = spark.read.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parquet")
    assert e.isStreaming
    series = {}
    for r in table.selectExpr("concat('E', user_id % 4) as symbol", "event_id as seq", "value").orderBy("event_id").collect():
        series.setdefault(r.symbol, []).append((r.seq, r.value))
    got = {(r.symbol, r.seq): r for r in run(spark, "stream_positions")}
    assert len(got) == sum(map(len, series.values()))
    for k, rows in series.items():
        x, _ = signals.kalman_steps(np.array([(100.0 + v) - 100 for _, v in rows]), 0.01, 20)
        p, _ = signals.hysteresis_steps(x, 1.0, 0.25, 2.0)
        for (seq, _), f, q in zip(rows, x, p):
            assert got[k, seq].filtered == pytest.approx(f) and got[k, seq].position == pytest.approx(q)


def test_least_fractional_order(spark):
    """A random walk needs differences, noise none; each test against a regression by least squares."""
    rng = np.random.default_rng(4)
    series = {"walk": 7 + rng.normal(0, 0.02, 600).cumsum(), "noise": rng.normal(0, 1, 300), "short": rng.normal(0, 1, 80)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "symbol string, day long, x double").repartition(4)
    got = {(r.symbol, r.d): r for r in stacking.order_sweep(df, "x", ["symbol"], ["day"]).collect()}
    assert {k for k, _ in got} == {"walk", "noise"} and len(got) == 2 * 19
    want = {"short": 0.5}
    for k in ("walk", "noise"):
        for d in stacking.ORDERS:
            w = np.zeros(63)
            own = rolling.fractional_weights(d)
            w[: len(own)] = own
            v = np.array([w @ series[k][t - 62 : t + 1][::-1] for t in range(62, len(series[k]))])
            dy = np.diff(v)
            x, y = np.column_stack([np.ones(len(dy) - 1), v[1:-1], dy[:-1]]), dy[1:]
            coef = np.linalg.lstsq(x, y, rcond=None)[0]
            spread = ((y - x @ coef) ** 2).sum() / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1]
            t = coef[1] / math.sqrt(spread)
            p = 0.005 if t <= -3.43 else np.interp(t, [-3.43, -2.86, -2.57], [0.01, 0.05, 0.1]) if t <= -2.57 else min(0.1 + (t + 2.57) * 0.9 / 1.57, 1)
            r = got[k, d]
            assert (r.n, r.t, r.p) == (len(v), pytest.approx(t, rel=1e-6), pytest.approx(p, rel=1e-5))
            if p < 0.05:
                want.setdefault(k, d)
    least = {r.symbol: r.d for r in stacking.least_order(df, "x", ["symbol"], ["day"]).collect()}
    assert least == want and least["noise"] == 0.1 < least["walk"]


def two_sample(x, y):
    """The statistic by midranks, straight from its definition."""
    z, n = np.sort(np.concatenate([x, y])), len(x) + len(y)
    total = 0.0
    for own in (x, y):
        part = 0.0
        for v in np.unique(z):
            l, f = (z == v).sum(), (own == v).sum()
            b, m = (z < v).sum() + l / 2, (own < v).sum() + f / 2
            part += l / n * (n * m - len(own) * b) ** 2 / (b * (n - b) - n * l / 4)
        total += part / len(own)
    return total * (n - 1) / n


def test_trades_against_their_baseline(spark):
    rng = np.random.default_rng(5)
    like = np.where(rng.random(200) < 0.6, rng.uniform(0, 2, 200), rng.uniform(-1, 0, 200)).round(2)
    rows = [("like", float(v)) for v in like] + [("worse", float(v)) for v in like - 0.4] + [("few", 1.0)] * 4 + [("tied", 0.5)] * 6
    trades = spark.createDataFrame(rows, "strategy string, pnl double").repartition(3)
    rates = spark.createDataFrame([(k, 0.6, 1.0, 0.5) for k in ("like", "worse", "few", "tied")] + [("none", None, 1.0, 1.0)], "strategy string, win_rate double, avg_win double, avg_loss double")
    base = {}
    for r in stacking.baseline(rates, ["strategy"]).collect():
        base.setdefault(r.strategy, []).append(r.v)
    assert set(base) == {"like", "worse", "few", "tied"} and all(sum(v > 0 for v in x) == 600 and len(x) == 1000 for x in base.values())
    assert all(-1 <= min(x) < -0.9 and 1.9 < max(x) <= 2 for x in base.values())
    got = {r.strategy: r for r in stacking.against_baseline(trades, rates, "pnl", ["strategy"]).collect()}
    assert set(got) == {"like", "worse", "tied"}
    for k, r in got.items():
        own = np.array([v for s, v in rows if s == k])
        assert (r.n, r.a2) == (len(own), pytest.approx(two_sample(own, np.array(base[k])), rel=1e-9))
    assert got["like"].p == 0.25 and got["worse"].p == 0.001 and 0.01 < got["tied"].p < 0.25


def test_levels_of_the_two_sample_test():
    """Under the null, statistics beyond a level's point come about as often as the level says."""
    rng = np.random.default_rng(6)
    p = np.array([stacking.two_sample_p(two_sample(rng.normal(size=25), rng.normal(size=40)), 25, 40)[1] for _ in range(400)])
    assert abs((p < 0.25).mean() - 0.25) < 0.06 and abs((p <= 0.05).mean() - 0.05) < 0.03


def test_baseline_query(spark):
    got = run(spark, "baseline_distance")
    assert len(got) == 5 and all(0.001 <= r.p <= 0.25 and r.n > 5 for r in got)
