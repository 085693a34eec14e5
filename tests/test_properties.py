"""What must hold whatever the data: no look-ahead, no dependence on row order, and parity of streams with batches."""

import hashlib
import math
import os
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.columns import epoch_seconds, normal_cdf
from causeway.operators import asof, bars, learning, portfolio, rolling, signals, validation
from causeway.plans import registry
from causeway.sources import calendar, store

KEYS, ORDER = ["symbol"], ["t"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = [("A", i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(5, 2, 400).cumsum(), rng.normal(0, 1, 400)))]
    return spark.createDataFrame(rows, "symbol string, t long, x double, y double")


CAUSAL = {
    "expanding_mean": lambda d: d.withColumn("v", rolling.expanding_mean("x", KEYS, ORDER)),
    "causal_z": lambda d: d.withColumn("v", rolling.causal_z("x", KEYS, ORDER)),
    "prior_z": lambda d: d.withColumn("v", rolling.prior_z("x", KEYS, ORDER, 30)),
    "rolling_z": lambda d: d.withColumn("v", rolling.rolling_z("x", KEYS, ORDER, 30)),
    "fractional": lambda d: d.withColumn("v", rolling.fractional_difference("x", KEYS, ORDER, 0.4, 1e-2)),
    "ema": lambda d: rolling.ema(d, "x", KEYS, ORDER, 10, "v"),
    "kalman": lambda d: signals.kalman(d, "x", KEYS, ORDER, 0.1).withColumnRenamed("filtered", "v"),
    "multi_horizon": lambda d: rolling.multi_horizon_score(d, "x", KEYS, ORDER, window=40).withColumnRenamed("score", "v"),
    "pca": lambda d: learning.expanding_pca(d, ["x", "y"], KEYS, ORDER, 1, 30).withColumnRenamed("pc1", "v"),
    "drawdown": lambda d: rolling.drawdown(d, "x", KEYS, ORDER).withColumnRenamed("drawdown", "v"),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_the_past_does_not_change_when_the_future_is_cut(series, name):
    value = lambda d: {r.t: r.v for r in CAUSAL[name](d).collect()}
    whole, shuffled = value(series), value(series.repartition(7).orderBy(F.rand(3)))
    assert whole == pytest.approx(shuffled, nan_ok=True)
    for cut in (50, 200):
        part = value(series.where(F.col("t") < cut))
        assert all(part[t] == pytest.approx(whole[t], abs=1e-9) if whole[t] is not None else part[t] is None for t in part)


def test_full_sample_scaling_fails_the_property(series):
    """The guard would notice look-ahead."""
    whole = {r.t: r.v for r in series.withColumn("v", (F.col("x") - F.avg("x").over(rolling.frame(KEYS, ORDER, None, None)))).collect()}
    part = {r.t: r.v for r in series.where("t < 50").withColumn("v", (F.col("x") - F.avg("x").over(rolling.frame(KEYS, ORDER, None, None)))).collect()}
    assert any(abs(part[t] - whole[t]) > 1e-6 for t in part)


def test_asof_hand_cases(spark):
    left = spark.createDataFrame([("A", t) for t in (-1, 0, 5, 10, 25)], "symbol string, t long")
    right = spark.createDataFrame([("A", 20, 3.0, 3), ("A", 0, 1.0, 1), ("A", 10, 2.0, 2), ("A", 10, 9.0, 3)], "symbol string, t long, v double, seq long")
    got = {r.t: (r.hit.v, r.t - r.hit.as_of) if r.hit else None for r in asof.as_of(left, {"hit": (right, ["v"])}, KEYS, "t").collect()}
    assert got == {-1: None, 0: (1.0, 0), 5: (1.0, 5), 10: (9.0, 0), 25: (3.0, 5)}
    odd = spark.createDataFrame([("A", 0, 1.0), ("A", 10, float("nan")), ("A", 20, 3.0), ("A", 30, float("inf"))], "symbol string, t long, v double")
    hits = asof.as_of(left.where("t > 0"), {"hit": (odd.where(asof.finite("v")), ["v"])}, KEYS, "t").collect()
    assert {r.t: r.hit.v for r in hits} == {5: 1.0, 10: 1.0, 25: 3.0}


def test_causal_z_against_a_loop(series):
    got = {r.t: r.z for r in series.withColumn("z", rolling.causal_z("x", KEYS, ORDER, warm=1)).collect()}
    x = np.array([r.x for r in series.orderBy("t").collect()])
    for i in range(1, len(x)):
        past = x[: i + 1]
        assert got[i] == pytest.approx((x[i] - past.mean()) / (past.std() + 1e-8), abs=1e-6)


def test_epoch_guard(spark):
    df = spark.sql("select timestamp'2023-07-02 00:00:00' as good, timestamp'1970-01-20 00:00:00' as bad")
    assert df.select(epoch_seconds(F.col("good"))).first()[0] == 1688256000.0
    with pytest.raises(Exception, match="outside"):
        df.select(epoch_seconds(F.col("bad"))).collect()


def test_normal_cdf(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-40, 41)], "z double")
    assert all(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-7 for r in df.withColumn("p", normal_cdf(F.col("z"))).collect())


def test_reset_bars_against_a_loop(spark):
    rng = np.random.default_rng(1)
    cents = rng.integers(1, 500, 300)
    tape = spark.createDataFrame([("A", i, i, 1.0, 1.0, int(c)) for i, c in enumerate(cents)], "symbol string, ts long, seq long, price double, size double, notional_c long")
    got = {r.seq: r.bar_id for r in bars.reset_bar_ids(tape, 1000).collect()}
    bar, total, want = 0, 0, {}
    open_ = []
    for i, c in enumerate(cents):
        total += c
        open_.append(i)
        if total >= 1000:
            want |= {j: bar for j in open_}
            bar, total, open_ = bar + 1, 0, []
    assert got == want | {j: None for j in open_}


def test_reset_bars_in_small_batches(spark):
    """Bars that reach over Arrow batches, several keys in a partition, a null key, prints without a value."""
    rng = np.random.default_rng(2)
    rows = [(k, i, i, 1.0, 1.0, None if i % 17 == 0 else int(rng.integers(1, 400)), None) for k in ("A", "B", None, "C") for i in range(150 if k != "C" else 1)]
    tape = spark.createDataFrame(rows, "symbol string, ts long, seq long, price double, size double, notional_c long, note string").repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = {(r.symbol, r.seq): r.bar_id for r in bars.reset_bar_ids(tape, 1000).collect()}
        assert bars.reset_bar_ids(tape.limit(0), 1000).collect() == []
    finally:
        spark.conf.set(key, was)
    want = {}
    for k in ("A", "B", None, "C"):
        bar, total, waiting = 0, 0, []
        for r in (r for r in rows if r[0] == k):
            total += r[5] or 0
            waiting.append((k, r[2]))
            if total >= 1000:
                want |= dict.fromkeys(waiting, bar)
                bar, total, waiting = bar + 1, 0, []
        want |= dict.fromkeys(waiting, None)
    assert got == want


def test_stress_against_a_loop(spark):
    """Without losers or winners, and the equity of each scenario step by step."""
    rows = [("a", i, i, 0.4 - 0.2 * (i % 5)) for i in range(40)] + [("w", i, i, 0.5) for i in range(4)] + [("l", i, i, -0.3) for i in range(4)]
    trades = spark.createDataFrame(rows, "strategy string, exit_day int, signal_id int, pnl_pct double")
    got = {(r.scenario, r.strategy): r for r in portfolio.stress(trades).collect()}
    draw = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16) / 2**32
    for name, vol, cut, shock, n, regime in portfolio.SCENARIOS:
        for s in "awl":
            pnl = [r[3] for r in rows if r[0] == s]
            wins, losses = [x for x in pnl if x > 0], [x for x in pnl if x <= 0]
            equity, worst = [1.0, 1 + shock], []
            for i in range(1, n + 1):
                won = draw("side", name, s, i) < max(0.05, len(wins) / len(pnl) - cut) and wins
                u = draw("trade", name, s, i)
                x = wins[int(u * len(wins))] / vol if won else (losses[int(u * len(losses))] if losses else -0.3) * vol
                worst.append(min(5.0, max(-1.0, x)))
                equity.append(equity[-1] * (1 + worst[-1] * 0.01 * {"high": 0.5, "normal": 0.75}[regime]))
            depth = np.array(equity) / np.maximum.accumulate(equity) - 1
            r = got[name, s]
            assert (r.n_trades, r.survived) == (n, True) and r.worst == pytest.approx(min(worst))
            assert r.total == pytest.approx(equity[-1] - 1, abs=1e-7) and r.max_drawdown == pytest.approx(depth.min(), abs=1e-7)
            assert r.recovery == next((j for j in range(n + 2 - int(depth.argmin())) if equity[int(depth.argmin()) + j] >= 1), -1)


def test_dated_calendar(spark):
    rows = calendar.dated(spark).collect()
    assert len(rows) == 72 and [r.event_day for r in rows] == sorted(r.event_day for r in rows)
    assert sum(r.magnitude for r in rows) == pytest.approx(12 * 1.0 + 18 * 0.8 + 18 * 0.7 + 6 * 0.6 + 18 * 0.5)


def test_ridge_sums_equal_one_matrix(series):
    phi = learning.FourierMap(2, 16)
    sums = learning.grams(series.repartition(5).withColumn("fold", F.lit(0)), ["x", "y"], "y", phi)
    rows = series.toPandas()
    p = phi(rows[["x", "y"]].to_numpy())
    assert np.allclose(np.frombuffer(sums["gram"][0]).reshape(16, 16), p.T @ p) and np.allclose(np.frombuffer(sums["moment"][0]), p.T @ rows["y"])
    w = learning.elastic_net(p.T @ p, p.T @ rows["y"].to_numpy(), len(p), 0.01, 0.5)
    assert (w >= 0).all()
    assert learning.alignment(series, ["x"], ["x"]) == pytest.approx(1.0)
    assert 1 <= learning.effective_dimension(p.T @ p) <= 16


def test_fourier_map_approximates_its_kernel():
    x = np.array([[0.0], [0.5], [1.0]])
    p = learning.FourierMap(1, 40_000, nu=0.5)(x)
    assert np.allclose(p @ p.T, np.exp(-np.abs(x - x.T)), atol=0.03)


def test_tensor_sketch_approximates_the_product():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 8)), rng.normal(size=(5, 6))
    p = learning.TensorSketch(8, 6, 60_000)(a, b)
    want = (a @ a.T) * (b @ b.T)
    assert np.abs(p @ p.T - want).max() < 0.05 * np.abs(want).max()


def test_splits_leave_the_embargo():
    for train, lo, hi in learning.walk_forward(500, 5, 100, 10):
        assert train + 10 == lo < hi <= 500
    assert len(learning.combinatorial_folds(6, 2)) == 15
    assert all(p <= a and b <= q for a, b, p, q in learning.purged_folds(103, 5, 3))


def test_shuffle_keeps_marginals(series):
    got = validation.shuffled(series, ["x"], KEYS, ORDER, 1)
    assert sorted(r.x for r in got.collect()) == sorted(r.x for r in series.collect())
    assert abs(got.join(series.withColumnRenamed("x", "was"), ["symbol", "t"]).agg(F.corr("x", "was")).first()[0]) < 0.2


def test_run_store(spark, tmp_path):
    from datetime import datetime

    root = f"file://{tmp_path}"
    t = spark.range(3)
    for i, (run, mode, tables) in enumerate([("old", "none", {"pred": t, "pnl": t}), ("real", "none", {"pred": t, "pnl": t}), ("stub", "none", {"pred": t}), ("control", "noise", {"pred": t, "pnl": t})]):
        store.save_run(spark, root, run, tables, mode, when=datetime(2024, 1, 1 + i))
    assert store.select_run(spark, root, ["pred", "pnl"]) == "real"
    assert store.select_run(spark, root) == "stub"
    assert store.select_run(spark, root, explicit="control") == "control"
    with pytest.raises(FileNotFoundError):
        store.select_run(spark, root, ["absent"])


def test_array_bundles_and_csv(spark, tmp_path):
    np.savez(tmp_path / "20230703.npz", book=np.arange(6.0).reshape(2, 3))
    rows = store.array_bundles(spark, f"file://{tmp_path}", "book").orderBy("row").collect()
    assert [r["values"] for r in rows] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    (tmp_path / "a.csv").write_text("signal_id,pnl_pct\n1,0.5\n2,x\n")
    (tmp_path / "b.csv").write_text("signal_id,status,mtm_pnl_pct\n3,closed,0.25\n4,OPEN,1\n")
    got = store.closed_trades(store.read_csv(spark, f"file://{tmp_path}/a.csv"), store.read_csv(spark, f"file://{tmp_path}/b.csv"))
    assert {r.signal_id: r.pnl_pct for r in got.collect()} == {"1": 0.5, "2": 0.0, "3": 0.25}
    with pytest.raises(ValueError, match="missing"):
        store.require(got, ["price"])


def test_hysteresis_and_kalman_carry_state():
    x = np.random.default_rng(2).normal(size=200)
    whole, _ = signals.kalman_steps(x, 0.1, 20)
    a, state = signals.kalman_steps(x[:77], 0.1, 20)
    b, _ = signals.kalman_steps(x[77:], 0.1, 20, state)
    assert np.allclose(whole, np.concatenate([a, b]))
    p, _ = signals.hysteresis_steps(np.array([0.5, 1.5, 1.9, 0.5, float("nan"), 0.1, -3.0, -0.5, 0.3, 1.2, -0.1]), 1.0, 0.25, 2.0)
    assert list(p) == [0.0, -1.5, -1.5, -1.5, -1.5, 0.0, 2.0, 2.0, 2.0, -1.2, 0.0]
    p, _ = signals.hysteresis_steps(np.array([1.0, 1.0, 0.5]), 9.0, 9.0, 1.0, gate=np.array([0.2, 1.0, 0.3]))
    assert list(p) == [0.0, -1.0, 0.0]


def test_regime_positions_enter_low_and_leave_high():
    p, last, held = signals.regime_steps(np.array([0.0, -1.0, -1.0, 0.4, 0.4, 0.6, 0.4, -0.6]), np.array([1.0, 0.0, 1.0, -1.0, 0.0, 1.0, 1.0, -1.0]), -0.5, 0.5)
    assert list(p) == [0.0, 0.0, 1.0, -1.0, -1.0, 0.0, 0.0, -1.0] and held and last == -1.0


def test_kalman_noise_looks_back_only(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(np.random.default_rng(3).normal(size=60))]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    whole = {r.i: r.filtered for r in signals.kalman(df, "x", ["k"], ["i"]).collect()}
    head = {r.i: r.filtered for r in signals.kalman(df.where("i < 25"), "x", ["k"], ["i"]).collect()}
    assert all(whole[i] == head[i] for i in head)


def test_deflated_sharpe(spark):
    """Against the figures of its formula; it falls with trials, and without two returns it is 0."""
    one = lambda n, k, *x: spark.range(1).select(portfolio.deflated_sharpe(*(F.lit(float(v)) for v in (x[0], n, *x[1:])), k)).first()[0]
    nd, euler = NormalDist(), 0.5772156649
    for sr, n, skew, excess, k in ((0.1, 500, 0.0, 0.0, 10), (1.4, 44, -0.5, 3.0, 30), (0.3, 20, 0.2, 1.0, 1)):
        spread = math.sqrt((1 - skew * sr + (excess - 1) / 4 * sr * sr) / n)
        luck = spread * ((1 - euler) * (nd.inv_cdf(1 - 1 / k) if k > 1 else 0.0) + euler * nd.inv_cdf(1 - 1 / (k * math.e)))
        assert one(n, k, sr, skew, excess) == pytest.approx(nd.cdf((sr - luck) / spread), abs=1e-7)
    got = [one(500, k, 0.1, 0.0, 0.0) for k in (2, 10, 100)]
    assert got == sorted(got, reverse=True) and one(1, 2, 0.1, 0.0, 0.0) == 0.0
    # a variance that is not above 0 falls back to that of plain returns
    assert one(9, 1, 1.0, 9.0, 0.0) == pytest.approx(nd.cdf(3.0 - euler * nd.inv_cdf(1 - 1 / math.e)), abs=1e-7)


def test_trailing_embedding_windows_average_every_dimension(spark, tmp_path):
    vectors = np.random.default_rng(0).normal(size=(30, 64))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["trailing_embedding_windows"](spark, str(tmp_path)).collect()
    assert len(got) == 30 * 64
    for r in got:
        for n in (1, 5, 20):
            want = vectors[max(0, r.vec_id + 1 - n) : r.vec_id + 1, r.dim - 1].mean()
            assert abs(r[f"mean_{n}"] - want) < 2e-6


def test_exits_of_all_kinds_whatever_the_days_between_prices(spark):
    from datetime import date, timedelta

    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    weekly = lambda symbol, prices: [(symbol, day(7 * i), float(p)) for i, p in enumerate(prices)]
    rows = weekly("up", [100, 101, 111]) + weekly("down", [100, 99, 94, 120]) + weekly("calm", [100.0] * 30) + weekly("short", [100, 101])
    path = spark.createDataFrame(rows, "symbol string, day date, close double")
    trades = [(1, "up", day(0)), (2, "down", day(-3)), (3, "calm", day(1)), (4, "short", day(0)), (5, "none", day(0)), (6, "up", day(500))]
    got = portfolio.exits(spark.createDataFrame(trades, "signal_id long, symbol string, entry_day date"), path, 0.1, 0.05, 14)
    assert {r.signal_id: (r.why, r.exit_day) for r in got.collect()} == {
        1: ("tp", day(14)), 2: ("sl", day(14)), 3: ("time_stop", day(7 * 15)), 4: ("end_of_data", day(7)), 5: ("no_data", None), 6: ("no_data", None)}


def test_inventory(spark):
    got = {r.source: r for r in store.inventory(spark, "/root/testdata/sf0.001", ["orders", "nation", "quotes"]).collect()}
    for name in ("orders", "nation"):
        path = f"/root/testdata/sf0.001/{name}.parquet"
        assert (got[name].present, got[name].n_files, got[name].n_bytes, got[name].n_rows) == (True, 1, os.path.getsize(path), spark.read.parquet(path).count())
    assert tuple(got["quotes"])[1:] == (False, 0, 0, 0)


def test_targets_that_cannot_be_learnt(spark):
    from causeway.operators import contracts

    rows = [("a", i, float(i)) for i in range(5)] + [("b", i, 2.0) for i in range(5)] + [("c", i, 1.0 if i == 0 else 0.0) for i in range(20)]
    rows += [("d", 0, None), ("e", 0, 1.0), ("e", 9, 3.0)]
    df = spark.createDataFrame(rows, "k string, i int, y double")
    got = {r.k: (r.n, r.reason) for r in contracts.degenerate(df, "y", ["k"]).collect()}
    assert got == {"a": (5, None), "b": (5, "constant"), "c": (20, "zeros"), "d": (0, "empty"), "e": (2, None)}
    part = {r.k: (r.n, r.reason) for r in contracts.degenerate(df, "y", ["k"], F.col("i") > 0).collect()}
    assert part == {"a": (4, None), "b": (4, "constant"), "c": (19, "constant"), "d": (0, "empty"), "e": (1, "constant")}
    with pytest.raises(ValueError, match="zeros"):
        contracts.enforce(contracts.degenerate(df.where("k = 'c'"), "y", ["k"]), F.col("reason").isNotNull(), "target")
    contracts.enforce(contracts.degenerate(df.where("k = 'a'"), "y", ["k"]), F.col("reason").isNotNull(), "target")


def test_running_sum_by_groups_of_sixteen(spark):
    """Whatever the batches: as from a tree whose nodes hold sixteen, and close to the exact sum."""
    rng = np.random.default_rng(1)
    x = rng.normal(1e-4, 3e-4, 70_000)
    whole, parts = rolling.RunningSum().add(x), rolling.RunningSum()
    cuts = [0, 1, 2, 17, 300, 301, 5000, 69_999, 70_000]
    assert np.array_equal(np.concatenate([parts.add(x[a:b]) for a, b in zip(cuts, cuts[1:])]), whole)
    exact = np.cumsum(x.astype(np.longdouble))
    assert np.abs(whole - exact).max() < 0.2 * np.abs(np.cumsum(x) - exact).max()
    rows = [("b", 1, None), ("b", 2, 2.0), ("b", 3, None), ("b", 4, 0.5), (None, 1, 1.0), ("a", 2, 5.0), ("a", 1, None)]
    got = rolling.running_sum(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], ["i"], "x", "s")
    assert {(r.k, r.i): r.s for r in got.collect()} == {("b", 1): None, ("b", 2): 2.0, ("b", 3): 2.0, ("b", 4): 2.5, (None, 1): 1.0, ("a", 1): None, ("a", 2): 5.0}


def test_equity_beyond_whole_numbers_is_as_in_sql(spark, tmp_path):
    """Trades enough for levels beyond 2^63 on the grid, where a cast to bigint stops."""
    con = duckdb.connect()
    con.execute("create table orders as select i as o_orderkey, '1' as o_orderpriority, timestamp '2020-01-01' + to_days(cast(i // 10 as integer)) as o_orderdate, 'F' as o_orderstatus, 1.0::double as o_totalprice from range(8000) t(i)")
    con.execute("create table lineitem as select i as l_orderkey, (60 + i % 40)::double as l_discount, 0.0::double as l_tax from range(8000) t(i)")
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = dict(con.execute(f"select signal_id, equity from ({registry.oracle_sql()['equity_curve']})").fetchall())
    got = {r.signal_id: r.equity for r in registry.queries()["equity_curve"](spark, str(tmp_path)).collect()}
    assert len(got) == 8000 and max(want.values()) > 1e30
    assert got == want
