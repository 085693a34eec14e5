"""Scans by composition against one fold over the whole series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import bars, scans, signals

KEYS = ["symbol"]


@pytest.fixture(scope="module")
def series(spark):
    """One hot symbol of 64 blocks and 6,400 rows, a small one, and one without a name."""
    rng = np.random.default_rng(3)
    rows = [("hot", t, float(rng.normal()), float(abs(rng.normal()) + 0.1), int(rng.integers(0, 90))) for t in range(6400)]
    rows += [("one", t, float(rng.normal()), 0.5, int(rng.integers(0, 90))) for t in range(70)] + [(None, 0, 1.0, 1.0, 5), (None, 150, 2.0, 1.0, 5)]
    rows = [(k, t, None if t % 41 == 7 else x, r, None if t % 17 == 3 else v) for k, t, x, r, v in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, t long, x double, r double, v long").repartition(5).cache()


def by_key(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        out.setdefault(r.symbol, []).append(r)
    return out


def block(width=100):
    return F.floor(F.col("t") / width)


def test_exponential(series):
    got = by_key(scans.scan(series, scans.Exponential("x", 0.1, "y"), KEYS, ["t"], block()))
    assert {k: len(v) for k, v in got.items()} == {"hot": 6400, "one": 70, None: 2}
    for rows in got.values():
        y = None
        for r in rows:
            if r.x is not None:
                y = r.x if y is None else y + 0.1 * (r.x - y)
            assert r.y == (None if y is None else pytest.approx(y, rel=1e-9))


def test_filter_with_known_noise(series):
    d = series.withColumn("q", F.lit(0.01))
    got = by_key(signals.kalman_known(d, "x", "q", "r", KEYS, ["t"], block()))
    for rows in got.values():
        x, p = None, 1.0
        for r in rows:
            if r.x is not None:
                x = r.x if x is None else x
                p += 0.01
                gain = p / (p + r.r)
                x, p = x + gain * (r.x - x), (1 - gain) * p
            assert r.filtered == (None if x is None else pytest.approx(x, rel=1e-9))


@pytest.mark.parametrize("threshold", [1, 50, 700, 20_000, 10**9])
def test_reset_sum(series, threshold):
    """Bars within a block, over a few blocks, over very many, and none."""
    got = by_key(scans.scan(series, scans.ResetSum("v", threshold), KEYS, ["t"], block()))
    for rows in got.values():
        bar, total, want = 0, 0, []
        for r in rows:
            want.append(bar)
            total += r.v or 0
            if total >= threshold:
                bar, total = bar + 1, 0
        assert [r.bar_id for r in rows] == [b if b < bar else None for b in want]


def test_same_as_the_fold_on_one_symbol_in_64_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("A", i // 3, i, 1.0, 1.0, int(c)) for i, c in enumerate(rng.integers(0, 400, 9600))]
    tape = spark.createDataFrame(rows, "symbol string, ts long, seq long, price double, size double, notional_c long").repartition(4)
    month = F.floor(F.col("ts") / 50)
    assert tape.select(month).distinct().count() == 64
    whole = {r.seq: r.bar_id for r in bars.reset_bar_ids(tape, 5000).collect()}
    assert {r.seq: r.bar_id for r in bars.reset_bar_ids(tape, 5000, month).collect()} == whole


def test_tables_stay_small():
    """As paths meet, a table has at most as many entries as the first bar has prints."""
    rng = np.random.default_rng(6)
    x = {"v": rng.integers(1, 100, 100_000)}
    table = scans.ResetSum("v", 5000).block(x)
    assert len(table["reach"]) <= 110
    for run in (0, 1, 777, 4999):
        cum, bars_, left = run, 0, None
        for v in x["v"].tolist():
            cum += v
            if cum >= 5000:
                cum, bars_ = 0, bars_ + 1
        assert scans.ResetSum("v", 5000).carry((run, 7), table) == (cum, 7 + bars_)


def test_one_symbol_is_many_tasks(series, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = scans.scan(series.where("symbol = 'hot'"), scans.Exponential("x", 0.1, "y"), KEYS, ["t"], block())
        parts = hot.groupBy(F.spark_partition_id().alias("part")).count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_by_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [("A", t, None if t % 13 == 5 else float(rng.normal() * (2 if t < 3000 else 0.4)), float(rng.random())) for t in range(6400)]
    df = spark.createDataFrame(rows, "symbol string, t long, s double, g double").repartition(3)
    for gate in (None, "g"):
        want, _ = signals.hysteresis_steps(*(np.array([math.nan if r[2] is None else r[2] for r in rows]),), 1.0, 0.2, 2.0, gate=np.array([r[3] for r in rows]) if gate else None)
        got = signals.positions(df, "s", KEYS, ["t"], 1.0, 0.2, 2.0, gate=gate, block=block())
        assert [r.position for r in sorted(got.collect(), key=lambda r: r.t)] == want.tolist()
        whole = signals.positions(df, "s", KEYS, ["t"], 1.0, 0.2, 2.0, gate=gate)
        assert [r.position for r in sorted(whole.collect(), key=lambda r: r.t)] == want.tolist()


def test_regimes_by_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [("A", t, None if t % 13 == 5 else float(rng.normal()), float(rng.choice([-1, 0, 0, 0, 1]))) for t in range(3200)]
    df = spark.createDataFrame(rows, "symbol string, t long, s double, d double").repartition(3)
    want, *_ = signals.regime_steps(np.array([r[2] or 0.0 for r in rows]), np.array([r[3] for r in rows]), -0.8, 1.8)
    for by in (block(), block(3), None):
        got = signals.regime_positions(df, "s", "d", KEYS, ["t"], -0.8, 1.8, block=by)
        assert [r.position for r in sorted(got.collect(), key=lambda r: r.t)] == want.tolist()


def test_kalman_in_small_batches(spark):
    """The adaptive filter, which does not compose, carries its state from batch to batch."""
    rng = np.random.default_rng(9)
    rows = [(k, t, float(rng.normal())) for k in ("A", "B") for t in range(300)]
    df = spark.createDataFrame(rows, "symbol string, t long, x double").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        got = by_key(signals.kalman(df, "x", KEYS, ["t"], window=20))
    finally:
        spark.conf.set(key, was)
    for k in ("A", "B"):
        x = np.array([r[2] for r in rows if r[0] == k])
        noise = np.maximum(0.1 * np.array([x[: i + 1].var() for i in range(300)]), 1e-12)
        assert [r.filtered for r in got[k]] == pytest.approx(signals.kalman_steps(x, noise, 20)[0].tolist())
