"""Two-stage predictions against numpy over one key's rows at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import nested, stacking, staged
from causeway.operators.learning import elastic_net
from causeway.plans import learning as plans, registry
from causeway.sources import views

KEYS, ORDER = ["symbol"], ["t"]
KERNELS = [staged.Kernel.fourier("one", ("a", "b"), 16), staged.Kernel.fourier("two", ("c",), 8, nu=0.5, seed=1)]
SPLITS = staged.Splits(4, 100, 5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    out = {}
    for k, n in (("A", 523), ("B", 311), (None, 260), ("short", 90)):
        x = rng.normal(size=(n, 3))
        y = np.sin(x[:, 0]) + 0.3 * x[:, 2] + 0.2 * rng.standard_t(3, n)
        out[k] = x, y
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(k, t, *map(float, x[t]), float(y[t]), f"n{t}") for k, (x, y) in data.items() for t in range(len(y))]
    rows[7] = (*rows[7][:5], None, "no target")
    rows[450] = (*rows[450][:2], None, *rows[450][3:])
    rows[460] = (*rows[460][:2], float("nan"), *rows[460][3:])
    return spark.createDataFrame(rows, "symbol string, t long, a double, b double, c double, y double, note string").repartition(7)


def brute(x, y, kernel, columns, penalty, half_life, mean_one):
    """(predictions by row, weights' norms by split) of one key, each split refitted from its rows."""
    out, norms, losses = {}, [], []
    phi = kernel.map(x[:, columns])
    seen = np.isfinite(x[:, columns]).all(1)
    for end, lo, hi in SPLITS.starts(len(y)):
        w = np.ones(end) if math.isinf(half_life) else 0.5 ** ((end - 1 - np.arange(end)) / half_life)
        ok = seen[:end] & np.isfinite(y[:end])
        p, v = phi[:end][ok], w[ok]
        u = v / v.sum() * len(v) if mean_one else v
        coef = np.linalg.solve(p.T @ (p * u[:, None]) + penalty * np.eye(p.shape[1]), p.T @ (u * y[:end][ok]))
        norms.append(np.linalg.norm(coef))
        losses.append(np.mean(v * (y[:end][ok] - p @ coef) ** 2))
        out |= {t: phi[t] @ coef if seen[t] else None for t in range(lo, hi)}
    return out, norms, losses


@pytest.mark.parametrize("half_life, mean_one", [(math.inf, False), (80.0, False), (80.0, True)])
def test_stage_one(df, data, half_life, mean_one):
    pred, stats = staged.stage_one(df, KERNELS, "y", KEYS, ORDER, SPLITS, 0.01, half_life, mean_one)
    got = {(r.symbol, r.t): r for r in pred.collect()}
    figures = {(r.symbol, r.kernel, r.split): r for r in stats.collect()}
    count = 0
    for k, (x, y) in data.items():
        x, y = x.copy(), y.copy()
        if k == "A":
            x[450, 0], x[460, 0], y[7] = np.nan, np.nan, np.nan
        for kernel, columns in zip(KERNELS, ([0, 1], [2])):
            want, norms, losses = brute(x, y, kernel, columns, 0.01, half_life, mean_one)
            for t, p in want.items():
                own = got[k, t][f"pred_{kernel.name}"]
                assert own is None if p is None else own == pytest.approx(p, abs=1e-7)
            for s, (norm, loss) in enumerate(zip(norms, losses)):
                r = figures[k, kernel.name, s]
                assert (r.norm, r.train_loss) == pytest.approx((norm, loss), rel=1e-6)
        count += len(want)
    assert count == len(got) and ("short", 50) not in got and got["A", 300].note == "n300"


@pytest.fixture(scope="module")
def predictions(spark):
    """Test rows of two keys, with heavy-tailed targets."""
    rng = np.random.default_rng(1)
    out = {}
    for k, n in (("A", 400), ("B", 187)):
        p = rng.normal(size=(n, 3)) * [1.0, 0.1, 3.0] + [0.0, 2.0, -1.0]
        y = 0.02 * p[:, 0] - 0.4 * p[:, 1] + 0.01 * rng.standard_t(2, n) + 0.5
        out[k] = p, y
    rows = [(k, t + 205, *map(float, p[t]), float(y[t])) for k, (p, y) in out.items() for t in range(len(y))]
    return out, spark.createDataFrame(rows, "symbol string, nth long, p0 double, p1 double, p2 double, y double").repartition(5)


COLUMNS = ["p0", "p1", "p2"]


def compare(predictions, how, fit, tolerance):
    data, df = predictions
    pred, weights = staged.combined(df, COLUMNS, "y", KEYS, how)
    got = {(r.symbol, r.nth): r for r in pred.collect()}
    chosen = {(r.symbol, r.s2_part): r for r in weights.collect()}
    count = 0
    for k, (p, y) in data.items():
        size = len(y) // 6
        for part in range(1, 6):
            intercept, coef, alpha, l1 = fit(p[: part * size], y[: part * size])
            r = chosen[k, part]
            assert (r.intercept, *r.coef) == pytest.approx((intercept, *coef), abs=tolerance)
            assert (r.alpha, r.l1) == pytest.approx((alpha, l1))
            for t in range(part * size, (part + 1) * size):
                assert got[k, t + 205].combined == pytest.approx(intercept + p[t] @ coef, abs=10 * tolerance) and got[k, t + 205].part == part
                count += 1
    assert count == len(got)


def folds(n):
    sizes = [n // 3 + (i < n % 3) for i in range(3)]
    ends = np.cumsum([0, *sizes])
    return [np.arange(a, b) for a, b in zip(ends, ends[1:])]


def test_ridge_combiner(predictions):
    def solve(x, y, alpha):
        c = x - x.mean(0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (y - y.mean()))
        return y.mean() - x.mean(0) @ w, w

    def fit(x, y):
        best = None
        for alpha in np.logspace(-6, -1, 50):
            scores = []
            for test in folds(len(y)):
                train = np.setdiff1d(np.arange(len(y)), test)
                b, w = solve(x[train], y[train], alpha)
                scores.append(1 - ((y[test] - b - x[test] @ w) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
            if best is None or np.mean(scores) > best[0] + 1e-12:
                best = np.mean(scores), alpha
        return *solve(x, y, best[1]), best[1], 0.0

    compare(predictions, "ridge", fit, 1e-6)


def test_elastic_combiner(predictions):
    def solve(x, y, alpha, l1, start):
        c, d = x - x.mean(0), y - y.mean()
        w = elastic_net(c.T @ c, c.T @ d, len(y), alpha, l1, True, start=start)
        # the conditions of the least value, written out
        slope = -c.T @ (d - c @ w) / len(y) + alpha * (1 - l1) * w + alpha * l1
        assert np.all(np.where(w > 0, np.abs(slope) < 1e-6, slope > -1e-6))
        return y.mean() - x.mean(0) @ w, w

    def fit(x, y):
        best = None
        for l1 in staged.L1_RATIOS:
            most = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (len(y) * l1)
            alphas = np.geomspace(most, most * 1e-3, 50)
            errors = np.zeros(50)
            for test in folds(len(y)):
                train = np.setdiff1d(np.arange(len(y)), test)
                w = np.zeros(3)
                for i, alpha in enumerate(alphas):
                    b, w = solve(x[train], y[train], alpha, l1, w)
                    errors[i] += ((y[test] - b - x[test] @ w) ** 2).mean() / 3
            if best is None or errors.min() < best[0] - 1e-15:
                best = errors.min(), l1, alphas[errors.argmin()]
        return *solve(x, y, best[2], best[1], np.zeros(3)), best[2], best[1]

    compare(predictions, "elastic", fit, 1e-5)


def test_huber_combiner(predictions):
    def loss(x, y, c, w, s):
        r = np.abs(y - c - x @ w)
        return len(y) * s + np.where(r <= 1.35 * s, r**2 / s, 2 * 1.35 * r - s * 1.35**2).sum() + 0.001 * (w @ w)

    def fit(x, y):
        mean, sd = x.mean(0), x.std(0)
        z = (x - mean) / sd
        c, w, s = y.mean(), np.zeros(3), y.std()
        for _ in range(400):
            r = y - c - z @ w
            o = np.where(np.abs(r) <= 1.35 * s, 1.0, 1.35 * s / np.maximum(np.abs(r), 1e-300))
            a = np.column_stack([np.ones(len(y)), z])
            c, *w = np.linalg.solve(a.T @ (a * o[:, None]) + np.diag([0, *[0.001 * s] * 3]), a.T @ (o * y))
            w = np.array(w)
            # the old residuals, as the rounds of the cluster have them
            near = np.abs(r) <= 1.35 * s
            s = math.sqrt((r[near] ** 2).sum() / (len(y) - (~near).sum() * 1.35**2))
        best, rng = loss(z, y, c, w, s), np.random.default_rng(2)
        for _ in range(300):  # convex: no step lowers it
            d = rng.normal(size=5) * 10.0 ** rng.uniform(-6, -2)
            assert loss(z, y, c + d[0] * s, w + d[1:4] * s, s * math.exp(d[4])) >= best - 1e-9
        return c - (mean / sd) @ w, w / sd, 0.001, 0.0

    compare(predictions, "huber", fit, 1e-6)


def test_fixed_weights(predictions):
    data, df = predictions
    got = staged.fixed_weights(df, COLUMNS, [1.0, 0.0, -2.0]).where("symbol = 'A'").orderBy("nth").collect()
    assert [r.combined for r in got] == pytest.approx((data["A"][0] @ [1.0, 0.0, -2.0]).tolist())
    with pytest.raises(ValueError):
        staged.fixed_weights(df, COLUMNS, [1.0])


def test_parts_do_not_look_ahead(predictions):
    """Cut off after a part, what was predicted stays."""
    _, df = predictions
    whole = {r.nth: r.combined for r in staged.combined(df.where("symbol = 'A'"), COLUMNS, "y", KEYS, "ridge")[0].collect()}
    changed = df.where("symbol = 'A'").withColumn("y", F.when(F.col("nth") >= 205 + 264, 99.0).otherwise(F.col("y")))
    got = {r.nth: r.combined for r in staged.combined(changed, COLUMNS, "y", KEYS, "ridge")[0].collect()}
    assert all(got[t] == pytest.approx(whole[t]) for t in range(205 + 66, 205 + 330))
    assert any(abs(got[t] - whole[t]) > 1 for t in range(205 + 330, 205 + 396))


@pytest.mark.parametrize("half_life", [math.inf, 60.0])
def test_nested_validation(df, data, half_life):
    """Scaler, inner folds, choice and prediction of each split, refitted from rows."""
    lengths, penalties = (0.5, 2.0), (1e-2, 1.0)
    pred, chosen = nested.nested_cv(df, ["a", "b", "c"], "y", KEYS, ORDER, lengths, penalties, features=12, splits=SPLITS, embargo=7, half_life=half_life)
    got = {(r.symbol, r.t): r.pred for r in pred.collect()}
    best = {(r.symbol, r.split): r for r in chosen.collect()}
    count = 0
    for k, (x, y) in data.items():
        x, y = x.copy(), y.copy()
        if k == "A":
            x[450, 0], x[460, 0], y[7] = np.nan, np.nan, np.nan
        ok = np.isfinite(x).all(1) & np.isfinite(y)
        for split, (end, lo, hi) in enumerate(SPLITS.starts(len(y))):
            at = np.flatnonzero(ok[:end])
            mean, sd = x[at].mean(0), x[at].std(0)
            z = (x - mean) / sd
            w = np.ones(end) if math.isinf(half_life) else 0.5 ** ((end - 1 - np.arange(end)) / half_life)

            def fit(rows, phi, penalty):
                v = w[rows] / w[rows].sum() * len(rows)
                p = phi[rows]
                return np.linalg.solve(p.T @ (p * v[:, None]) + penalty * np.eye(12), p.T @ (v * y[rows]))

            top = None
            for length in lengths:
                phi = staged.FourierMap(3, 12, 1.5, length)(z)
                for penalty in penalties:
                    scores = []
                    for a, b, c, d in nested.inner_folds(end, 3, 7):
                        coef = fit(at[(at < c) | (at >= d)], phi, penalty)
                        test = at[(at >= a) & (at < b)]
                        scores.append(-np.mean((y[test] - phi[test] @ coef) ** 2))
                    if top is None or np.mean(scores) > top[0]:
                        top = np.mean(scores), length, penalty, fit(at, phi, penalty), phi
            r = best[k, split]
            assert (r.length, r.penalty, r.n_train) == (*top[1:3], len(at)) and r.score == pytest.approx(top[0], rel=1e-6)
            for t in range(lo, hi):
                want = top[4][t] @ top[3] if np.isfinite(x[t]).all() else None
                assert got[k, t] == (None if want is None else pytest.approx(want, abs=1e-7))
                count += 1
    assert count == len(got)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def days(spark):
    """The features of the learning queries, by symbol in order."""
    out = {}
    for r in plans.features(spark, SF).orderBy("symbol", "day").collect():
        out.setdefault(r.symbol, []).append(r)
    return out


def refitted(rows, kernel, penalty, half_life, mean_one, splits=staged.Splits()):
    x, y = (np.array([[r[c] for c in names] for r in rows], float) for names in (kernel.columns, ("y",)))
    phi, y, out = kernel.map(x), y[:, 0], {}
    for end, lo, hi in splits.starts(len(y)):
        w = 0.5 ** ((end - 1 - np.arange(end)) / half_life)
        w = w / w.mean() if mean_one else w
        coef = np.linalg.solve(phi[:end].T @ (phi[:end] * w[:, None]) + penalty * np.eye(phi.shape[1]), phi[:end].T @ (w * y[:end]))
        out |= {rows[t].day: phi[t] @ coef for t in range(lo, hi)}
    return out


def test_walk_forward_query(spark, days):
    got = {(r.symbol, r.day): r.pred for r in registry.queries()["walk_forward_ridge"](spark, SF).collect()}
    want = {(k, d): p for k, rows in days.items() for d, p in refitted(rows, staged.Kernel.fourier("all", tuple(plans.FEATURES), 64), 1.0, 500.0, True).items()}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got)


def test_stage_queries(spark, days):
    got = {(r.symbol, r.day): r for r in registry.queries()["stage_one"](spark, SF).collect()}
    for kernel in plans.KERNELS:
        want = {(k, d): p for k, rows in days.items() for d, p in refitted(rows, kernel, 1e-3, 500.0, False).items()}
        assert got.keys() == want.keys()
        assert all(got[k][f"pred_{kernel.name}"] == pytest.approx(want[k], abs=1e-6) for k in got)
    folds_ = registry.queries()["stage_one_folds"](spark, SF).collect()
    assert len(folds_) == len(days) * 5 * 3
    for r in folds_[:20]:
        test = [x for x in got.values() if (x.symbol, x.split) == (r.symbol, r.split)]
        assert r.test_corr == pytest.approx(np.corrcoef([x[f"pred_{r.kernel}"] for x in test], [x.y for x in test])[0, 1]) and r.n_test == len(test)


def test_second_stage_queries(spark):
    first = {(r.symbol, r.day): r for r in registry.queries()["stage_one"](spark, SF).collect()}
    weights = {(r.symbol, r.combiner, r.part): r for r in registry.queries()["combiner_weights"](spark, SF).collect()}
    got = registry.queries()["stage_two"](spark, SF).collect()
    assert len({(r.symbol, r.day) for r in got}) == len(got) > 700
    for r in got:
        p = first[r.symbol, r.day]
        assert r.fixed == pytest.approx(0.5 * p.pred_trend + 0.25 * p.pred_risk + 0.25 * p.pred_all)
        for how in ("elastic", "ridge", "huber"):
            w = weights[r.symbol, how, r.part]
            assert r[how] == pytest.approx(w.intercept + w.trend * p.pred_trend + w.risk * p.pred_risk + w["all"] * p.pred_all, abs=1e-6)
    assert all(min(w.trend, w.risk, w["all"]) >= 0 for w in weights.values() if w.combiner == "elastic")


def test_nested_query(spark, days):
    got = registry.queries()["nested_validation"](spark, SF).collect()
    want = sum(hi - lo for rows in days.values() for _, lo, hi in staged.Splits().starts(len(rows)))
    assert len(got) == want and all(r.length in (0.5, 1.0, 2.0) and r.penalty in (1e-3, 1e-1, 10.0) and r.pred is not None for r in got)


def test_gate_is_that_of_the_past(spark):
    """The gate of a day is a logistic of ridge on the rows before, from momentum alone."""
    daily = views.daily(spark, SF).where("symbol = 'S3'")
    got = {r.day: r.gate for r in stacking.fitted_gate(daily, "close", KEYS, ["day"], F.year("day"), staged.Splits(), features=32).collect()}
    m = stacking.momentum_columns(daily, "close", KEYS, ["day"], F.year("day")).where("tsmom is not null").orderBy("day").collect()
    x = np.array([[r.tsmom, r.scaled, r.cross] for r in m])
    z = np.array([(x[i] - x[: i + 1].mean(0)) / (x[: i + 1].std(0) + 1e-8) if i >= 20 else np.zeros(3) for i in range(len(x))])
    phi = staged.FourierMap(3, 32, 1.5, 1.0, 42)(z)
    y = np.array([r.ret for r in m[1:]])
    count = 0
    for end, lo, hi in staged.Splits().starts(len(m)):
        coef = np.linalg.solve(phi[:end].T @ phi[:end] + 1e-3 * np.eye(32), phi[:end].T @ y[:end])
        for t in range(lo, hi):
            assert got[m[t].day] == pytest.approx(1 / (1 + math.exp(-phi[t] @ coef)), abs=1e-6)
            count += 1
    assert count == len(got)


def test_two_levels(spark):
    """The features spelled out, and the query's predictions from rows refitted by split."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(40, 3)), rng.random(40), rng.integers(0, 2, 40)])
    fast, slow, sketch = plans.LEVELS.fast(x[:, :2]), plans.LEVELS.slow(x[:, 2:3]), plans.LEVELS.sketch
    product = np.zeros((40, 48))
    for i in range(24):
        for j in range(12):
            product[:, (sketch.place[0][i] + sketch.place[1][j]) % 48] += sketch.sign[0][i] * sketch.sign[1][j] * fast[:, i] * slow[:, j]
    want = np.column_stack([fast, math.sqrt(0.5) * np.sqrt(x[:, [3]]) * product]) * x[:, [4]]
    assert np.allclose(plans.LEVELS(x), want)
    rows = {}
    for r in plans.gated(spark, SF).orderBy("symbol", "day").collect():
        rows.setdefault(r.symbol, []).append(r)
    got = {(r.symbol, r.day): r.pred for r in registry.queries()["two_level_walk_forward"](spark, SF).collect()}
    want = {(k, d): p for k, own in rows.items() for d, p in refitted(own, plans.TWO_LEVEL, 0.1, 500.0, True).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in got)
    assert any(r.open == 0 for r in rows["S1"]) and all(got[k, r.day] == 0 for k, own in rows.items() for r in own if r.open == 0 and (k, r.day) in got)


def test_samplers():
    """Frequencies of each kind have the spread that they should."""
    n, nu = 200_000, 4.0
    multivariate, independent, unscaled = (staged.FourierMap(2, n, nu, 2.0, 0, s).w for s in ("multivariate", "independent", "unscaled"))
    t = 2 * nu / (2 * nu - 2)  # the variance of t with 2 nu degrees
    assert multivariate.var(1) == pytest.approx([t / 4] * 2, rel=0.03) and independent.var(1) == pytest.approx([t / 4] * 2, rel=0.03)
    assert unscaled.var(1) == pytest.approx([t / 4 / (2 * nu)] * 2, rel=0.03)
    # one draw of the spread for all dimensions ties their sizes; independent ones are not tied
    tied = lambda w: np.corrcoef(w[0] ** 2, w[1] ** 2)[0, 1]
    assert tied(multivariate) > 0.1 and abs(tied(independent)) < 0.05
    with pytest.raises(KeyError):
        staged.FourierMap(2, 4, sampler="other")
