"""Bars: event time cut by traded value, trade count, or the clock.

All functions take a tape with keys (``symbol``), an order (``ts``, ``seq``), ``price``, ``size`` and ``notional_c`` (value
in whole cents, so that thresholds are exact). Keys are the unit of parallel work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.functions.columns import frame, ordered
from causeway.operators.scans import ResetSum, scan

KEYS, ORDER = ["symbol"], ["ts", "seq"]


def master_bars(tape: DataFrame, threshold_c: int) -> DataFrame:
    """Bar k closes at the first print whose running value reaches k thresholds; the last threshold lies below the total.

    A print that crosses several thresholds closes several bars. Running sums never reset, so this is one window pass.
    """
    run = frame(KEYS, ORDER, None, 0)
    whole = F.sum("notional_c").over(frame(KEYS, ORDER, None, None))
    cum = tape.select("*", F.sum("notional_c").over(run).alias("cum"), whole.alias("total"))
    first = F.floor((F.col("cum") - F.col("notional_c")) / threshold_c).cast("long") + 1
    last = F.least(F.floor(F.col("cum") / threshold_c), F.floor((F.col("total") - 1) / threshold_c)).cast("long")
    return (
        cum.withColumn("lo", first).withColumn("hi", last).where("hi >= lo")
        .select("symbol", F.explode(F.sequence("lo", "hi")).alias("bar_id"), F.col("seq").alias("close_seq"), F.col("ts").alias("close_ts"), F.col("price").alias("close"))
    )


def reset_bar_ids(tape: DataFrame, threshold_c: int, block: Column | None = None) -> DataFrame:
    """Adds bar_id from 0: the running value starts again at 0 after each close. The last, partial bar has none (null).

    Where a bar ends depends on where the one before did. With ``block``, which never falls along the order (say, the month),
    a key's prints are many tasks, one for each block, by jump tables. Without, a key's prints are folded in order. They are sorted within
    partitions and go through the fold batch by batch: a task holds a batch and the prints of the bar that is still open,
    not a key's whole tape. A print without a value counts 0.
    """
    if block is not None:
        return scan(tape, ResetSum("notional_c", threshold_c), KEYS, ORDER, block)
    names = tape.columns
    symbol, value = (names.index(c) for c in ("symbol", "notional_c"))

    def numbered(rows: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*names, "bar_id"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, bar, open_rows = object(), 0, 0, []

        def shut(bar_id: int | None) -> Iterator[pa.RecordBatch]:
            for rows in open_rows:
                yield numbered(rows, pa.array([bar_id] * len(rows), pa.int64()))
            open_rows.clear()

        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(symbol).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for lo, hi in zip(edges, edges[1:]):
                rows, own = batch.slice(lo, hi - lo), batch.column(symbol)[lo].as_py()
                if own != key:
                    yield from shut(None)
                    key, run, bar = own, 0, 0
                cum = run + np.cumsum(rows.column(value).fill_null(0).to_numpy(zero_copy_only=False))
                base, ends = 0, []
                while (at := int(np.searchsorted(cum, base + threshold_c))) < len(cum):
                    ends.append(at)
                    base = int(cum[at])
                run = int(cum[-1]) - base
                if ends:
                    yield from shut(bar)
                    done = rows.slice(0, ends[-1] + 1)
                    yield numbered(done, pa.array(bar + np.searchsorted(ends, np.arange(len(done))), pa.int64()))
                    bar, rows = bar + len(ends), rows.slice(ends[-1] + 1)
                if len(rows):
                    open_rows.append(rows)
        yield from shut(None)

    schema = T.StructType([*tape.schema.fields, T.StructField("bar_id", T.LongType())])
    return tape.repartition(*KEYS).sortWithinPartitions(*KEYS, *ORDER).mapInArrow(fold, schema)


def reset_bars(tape: DataFrame, threshold_c: int, block: Column | None = None) -> DataFrame:
    """One row a reset bar: prices, volume, vwap, log return, volatility within, and tick-rule buy and sell volume."""
    own = ordered(["symbol", "bar_id"], ORDER)
    ticked = reset_bar_ids(tape, threshold_c, block).where("bar_id is not null").withColumn("before", F.lag("price").over(own))
    up = F.coalesce(F.col("price") >= F.col("before"), F.lit(True))
    bars = ticked.groupBy("symbol", "bar_id").agg(
        F.min("seq").alias("open_seq"), F.max("seq").alias("close_seq"),
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n_trades"), F.sum("notional_c").alias("value_c"),
        (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
        F.coalesce(F.stddev_pop(F.log(F.col("price") / F.col("before"))), F.lit(0.0)).alias("intra_vol"),
        F.sum(F.when(up, F.col("size")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(up, 0.0).otherwise(F.col("size"))).alias("sell_volume"),
    )
    return bars.withColumn("bar_return", F.log(F.col("close") / F.col("open")))


def one_print_per_time(tape: DataFrame) -> DataFrame:
    """The first print of each time of a key, as for bars over times without repeats."""
    return tape.withColumn("nth", F.row_number().over(ordered(["symbol", "ts"], ["seq"]))).where("nth = 1").drop("nth")


def count_bars(tape: DataFrame, per_bar: int) -> DataFrame:
    """Bars of ``per_bar`` prints; a shorter tail is dropped. Price change is last less first; flow is signed size."""
    nth = F.row_number().over(ordered(KEYS, ORDER)) - 1
    flow = F.col("size") * F.when(F.col("side") == "A", 1.0).when(F.col("side") == "B", -1.0).otherwise(0.0)
    return (
        tape.withColumn("bar_id", F.floor(nth / per_bar).cast("long")).groupBy("symbol", "bar_id")
        .agg(
            (F.max_by("price", "seq") - F.min_by("price", "seq")).alias("dp"), F.sum(flow).alias("flow"),
            F.count("*").alias("n_trades"), F.max("seq").alias("close_seq"),
        )
        .where(F.col("n_trades") == per_bar)
    )


def clock_bars(tape: DataFrame, seconds: int) -> DataFrame:
    """Windows of the clock from a key's first print on, empty ones too; the last edge belongs to the last window.

    ``tape`` has us, microseconds since 1970. Gives counts and the sum of the waits that end in each window.
    """
    first = F.min("us").over(frame(KEYS, ["us", "seq"], None, None))
    last = F.max("us").over(frame(KEYS, ["us", "seq"], None, None))
    wait = (F.col("us") - F.lag("us").over(ordered(KEYS, ["us", "seq"]))) / 1e6
    width = seconds * 1_000_000
    at = tape.select("symbol", "seq", "us", first.alias("t0"), last.alias("t1"), wait.alias("wait"))
    n = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / width)).cast("long")
    at = at.withColumn("n", n).withColumn("win", F.least(F.floor((F.col("us") - F.col("t0")) / width).cast("long"), F.col("n") - 1))
    counted = at.groupBy("symbol", "win").agg(F.count("*").alias("n_events"), F.sum("wait").alias("waits"), F.count("wait").alias("n_waits"))
    spine = at.groupBy("symbol").agg(F.max("n").alias("n")).select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("win"))
    return spine.join(counted, ["symbol", "win"], "left").select(
        "symbol", "win", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_waits")), F.coalesce("waits", F.lit(0.0)).alias("waits")
    )


def weekly(daily: DataFrame) -> DataFrame:
    """Weeks that end on Sunday, without gaps: summed volume, last close and its change."""
    week = F.date_add(F.trunc("day", "week"), 6)
    got = daily.groupBy("symbol", week.alias("week")).agg(F.sum("volume").alias("volume"), F.max_by("close", "day").alias("close"))
    span = got.groupBy("symbol").agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    spine = span.select("symbol", F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    full = spine.join(got, ["symbol", "week"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    held = full.withColumn("close", F.last("close", True).over(frame(KEYS, ["week"], None, 0)))
    return held.withColumn("change", F.col("close") / F.lag("close").over(ordered(KEYS, ["week"])) - 1.0)


def monthly_pivot(daily: DataFrame, value: str = "volume") -> DataFrame:
    """Years by months, summed."""
    return daily.groupBy("symbol", F.year("day").alias("year")).pivot("month", list(range(1, 13))).agg(F.sum(value)) if "month" in daily.columns else monthly_pivot(
        daily.withColumn("month", F.month("day")), value
    )
