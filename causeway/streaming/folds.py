"""Streaming twins: reset bars, the Kalman filter and hysteresis positions with state by key, and windowed counts.

A key's state is a few numbers. Rows of a micro-batch are put in order before they are folded; rows older than the
watermark are Spark's to drop, so a twin equals its batch form when rows arrive in order between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causeway.operators.signals import hysteresis_steps, kalman_steps


def reset_bars(tape: DataFrame, threshold_c: int, order: str = "seq") -> DataFrame:
    """Closed bars (symbol, bar_id, open_seq, close_seq, value_c) from a stream with symbol, seq and notional_c."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, value, first = state.get if state.exists else (0, 0, -1)
        out = []
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for seq, cents in zip(rows[order].tolist(), rows["notional_c"].tolist()):
            first = seq if first < 0 else first
            value += cents
            if value >= threshold_c:
                out.append((key[0], bar, first, seq, value))
                bar, value, first = bar + 1, 0, -1
        state.update((bar, value, first))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "open_seq", "close_seq", "value_c"])

    return tape.groupBy("symbol").applyInPandasWithState(
        fold, "symbol string, bar_id long, open_seq long, close_seq long, value_c long", "bar long, value long, first long", "append", GroupStateTimeout.NoTimeout
    )


def filtered_positions(stream: DataFrame, value: str, order: str, q: float, window: int, enter: float, leave: float, most: float) -> DataFrame:
    """Kalman-filtered values and positions that act on them directly, by symbol."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order, kind="stable", ignore_index=True)
        kalman = (held[0], held[1], list(held[2])) if held else None
        x, after = kalman_steps(rows[value].to_numpy(float), q, window, kalman)
        position, last = hysteresis_steps(x, enter, leave, most, held[3] if held else 0.0)
        state.update((float(after[0]), float(after[1]), [float(v) for v in after[2]], float(last)))
        yield pd.DataFrame({"symbol": key[0], "seq": rows[order], "filtered": x, "position": position})

    return stream.groupBy("symbol").applyInPandasWithState(
        fold, "symbol string, seq long, filtered double, position double", "x double, p double, seen array<double>, position double", "append", GroupStateTimeout.NoTimeout
    )


def windowed_flow(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and signed flow of tumbling or sliding windows behind a watermark; ``stream`` has ts, symbol, side, size."""
    flow = F.col("size") * F.when(F.col("side") == "A", 1.0).when(F.col("side") == "B", -1.0).otherwise(0.0)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        stream.withWatermark("ts", late).groupBy("symbol", span.alias("w")).agg(F.count("*").alias("n"), F.sum(flow).alias("flow"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "flow")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of activity of each symbol, parted by quiet gaps."""
    return (
        stream.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
