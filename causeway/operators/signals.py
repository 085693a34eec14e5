"""From predictions to positions and daily profit: ordered folds by key, and their window-only neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.columns import frame, ordered
from causeway.operators.scans import Arrays, Fold, Gained, Spread, carried, scan


def kalman_steps(values: np.ndarray, q: float | np.ndarray, window: int, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Random-walk filter with noise from the last ``window`` innovations; the state carries on to later values."""
    x, p, seen = state if state else (None, 1.0, [])
    seen, out = list(seen), np.empty(len(values))
    for i, (v, noise) in enumerate(zip(values, np.broadcast_to(q, len(values)))):
        if x is None:
            x = v
        p += noise
        gap = v - x
        seen = (seen + [gap])[-window:]
        gain = p / (p + np.var(seen) + 1e-12)
        x, p = x + gain * gap, (1 - gain) * p
        out[i] = x
    return out, (x, p, seen)


def kalman(df: DataFrame, value: str, keys: list[str], order: list[str], q: float | None = None, window: int = 50, look_ahead: bool = False) -> DataFrame:
    """Adds ``filtered``. q None: a tenth of the population variance so far; ``look_ahead`` takes that of the whole series.

    The noise comes from the last innovations, which are no map that composes: a key is one task, batch by batch.
    """
    if q is not None:
        noise = F.lit(float(q))
    else:
        noise = F.greatest(0.1 * F.var_pop(value).over(frame(keys, order, None, None if look_ahead else 0)), F.lit(1e-12))
    got = carried(
        df.withColumn("ka_noise", noise), keys, order, [value, "ka_noise"], "filtered",
        lambda x, state: kalman_steps(x[value].astype(float), x["ka_noise"], window, state),
    )
    return got.drop("ka_noise")


def kalman_known(df: DataFrame, value: str, q: str, r: str, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Adds ``filtered`` and ``gain`` of a random-walk filter whose step and noise variances are columns; many tasks a key.

    Its variance composes as fractional linear maps and, the gains being known, its value as affine ones. Rows without a
    value are no observation: they keep what was filtered.
    """
    seen = df.withColumn("ka_q", F.when(F.col(value).isNotNull(), F.col(q).cast("double")))
    gained = scan(seen, Spread("ka_q", r), keys, order, block)
    return scan(gained, Gained(value, "gain", "filtered"), keys, order, block).drop("ka_q")


#: (enter, leave) where the gate says calm and where it says trend; between, they are mixed by the gate. Fixed values.
CHOPPY, TRENDING = (2.0, 0.75), (0.75, 0.25)


def hysteresis_steps(
    score: np.ndarray, enter: float, leave: float, most: float, position: float = 0.0, gate: np.ndarray | None = None, middle: float = 0.5
) -> tuple[np.ndarray, float]:
    """Mean reversion: short above ``enter``, long below its negative, by size of the score up to ``most``.

    A position keeps its size until the score is within ``leave`` of 0, and flips only beyond ``enter`` on the other side. A
    missing score holds. With a ``gate`` of 0 to 1 the two bounds move from those of calm to those of trend above ``middle``.
    """
    out = np.empty(len(score))
    for i, s in enumerate(score):
        if not np.isnan(s):
            near, far = leave, enter
            if gate is not None and not np.isnan(gate[i]):
                w = min(max((gate[i] - middle) / (1.0 - middle + 1e-8), 0.0), 1.0)
                far, near = (c * (1 - w) + t * w for c, t in zip(CHOPPY, TRENDING))
            wanted = -np.sign(s) * min(abs(s) / far, most) if abs(s) > far else 0.0
            if position and abs(s) < near:
                position = 0.0
            elif wanted * position < 0 or not position:
                position = float(wanted)
        out[i] = position
    return out, position


class Hysteresis(Fold):
    """hysteresis_steps as a scan: from flat, long or short a block ends at a size of its own, or still holds what it began with."""

    gives, state, table = "position double", "position double", "flat double, long double, short double, long_holds boolean, short_holds boolean"

    def __init__(self, score: str, enter: float, leave: float, most: float, gate: str | None):
        self.score, self.bounds, self.gate = score, (enter, leave, most), gate
        self.takes = [score, gate] if gate else [score]

    def steps(self, x: Arrays, position: float) -> tuple[np.ndarray, float]:
        return hysteresis_steps(x[self.score].astype(float), *self.bounds, position, x[self.gate].astype(float) if self.gate else None)

    def start(self) -> tuple:
        return (0.0,)

    def block(self, x: Arrays) -> Arrays:
        # a size that no score gives shows whether it was held throughout
        odd = 2 * self.bounds[2] + 1
        ends = [self.steps(x, p)[1] for p in (0.0, odd, -odd)]
        got = dict(zip(("flat", "long", "short"), ends, strict=True)) | {"long_holds": ends[1] == odd, "short_holds": ends[2] == -odd}
        return {c: np.array([v]) for c, v in got.items()}

    def carry(self, state: tuple, table: Arrays) -> tuple:
        way = "flat" if not state[0] else "long" if state[0] > 0 else "short"
        return state if way != "flat" and table[f"{way}_holds"][0] else (float(table[way][0]),)

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        return [pa.array(self.steps(x, state[0])[0])]


def positions(
    df: DataFrame, score: str, keys: list[str], order: list[str], enter: float = 2.0, leave: float = 0.5, most: float = 1.0, gate: str | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Adds ``position`` by hysteresis_steps. With ``block``, which never falls along the order, a key is many tasks."""
    fold = Hysteresis(score, enter, leave, most, gate)
    if block is not None:
        return scan(df, fold, keys, order, block)
    return carried(df, keys, order, fold.takes, "position", lambda x, state: fold.steps(x, state or 0.0))


def regime_steps(score: np.ndarray, direction: np.ndarray, enter: float, leave: float, last: float = 0.0, held: bool = False) -> tuple[np.ndarray, float, bool]:
    """In while volatility is low: enters below ``enter`` in the direction given, follows it, and leaves above ``leave``."""
    out = np.empty(len(score))
    for i, (s, d) in enumerate(zip(score, direction)):
        if held:
            held = not s > leave
            last = (d if d else last) if held else 0.0
        else:
            last = d if s < enter else 0.0
            held = bool(last)
        out[i] = last
    return out, last, held


class Regime(Fold):
    """regime_steps as a scan: from outside or inside, a block ends in a state of its own, or keeps the direction it began with."""

    gives, state, table = "position double", "last double, held boolean", "out double, out_held boolean, inside double, inside_held boolean, keeps boolean"

    def __init__(self, score: str, direction: str, enter: float, leave: float):
        self.takes, self.bounds = [score, direction], (enter, leave)

    def steps(self, x: Arrays, last: float, held: bool) -> tuple[np.ndarray, float, bool]:
        return regime_steps(*(np.nan_to_num(x[c].astype(float)) for c in self.takes), *self.bounds, last, held)

    def start(self) -> tuple:
        return (0.0, False)

    def block(self, x: Arrays) -> Arrays:
        (_, out, out_held), (_, inside, inside_held) = self.steps(x, 0.0, False), self.steps(x, np.inf, True)
        keeps = bool(inside_held) and np.isinf(inside)
        got = {"out": out, "out_held": out_held, "inside": 0.0 if keeps else inside, "inside_held": inside_held, "keeps": keeps}
        return {c: np.array([v]) for c, v in got.items()}

    def carry(self, state: tuple, table: Arrays) -> tuple:
        if state[1] and table["keeps"][0]:
            return state
        way = "inside" if state[1] else "out"
        return float(table[way][0]), bool(table[f"{way}_held"][0])

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        return [pa.array(self.steps(x, *state)[0])]


def regime_positions(
    df: DataFrame, score: str, direction: str, keys: list[str], order: list[str], enter: float = -0.5, leave: float = 0.5, block: Column | None = None
) -> DataFrame:
    """Adds ``position`` by regime_steps; a missing score counts as 0. With ``block`` a key is many tasks."""
    fold = Regime(score, direction, enter, leave)
    if block is not None:
        return scan(df, fold, keys, order, block)

    def step(x: Arrays, state: tuple | None) -> tuple[np.ndarray, tuple]:
        out, *after = fold.steps(x, *(state or fold.start()))
        return out, tuple(after)

    return carried(df, keys, order, fold.takes, "position", step)


def flat_at_first(position: str, keys: list[str], day: str, days: int) -> Column:
    """The position, 0 within the first ``days`` days of its key."""
    first = F.min(day).over(frame(keys, [day], None, 0))
    return F.when(F.col(day) < F.date_add(first, days), 0.0).otherwise(F.col(position))


def score_of(x: str, keys: list[str], order: list[str], window: int) -> Column:
    """x against the ``window`` rows before: null until there are as many, 0 without spread."""
    f = frame(keys, order, -window, -1)
    sd = F.stddev_pop(x).over(f)
    return F.when(F.count(x).over(f) == window, F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(f)) / sd).otherwise(0.0))


def daily_pnl(days: DataFrame, keys: list[str], day: str, position: str, price: str, cost: float = 0.00015) -> DataFrame:
    """End-of-day position times the next log return, less the cost of the change to the next position."""
    w = ordered(keys, [day])
    ret = F.log(F.lead(price).over(w) / F.col(price))
    change = F.abs(F.lead(position).over(w) - F.col(position))
    return days.withColumn("gross", F.col(position) * ret).withColumn("net", F.col("gross") - cost * change).where("gross is not null")


def headline(pnl: DataFrame, keys: list[str], net: str, position: str, day: str) -> DataFrame:
    """Sharpe and Sortino a year, hit rate of active days, worst drawdown, and trades (changes from flat)."""
    w = ordered(keys, [day])
    cum = F.sum(net).over(frame(keys, [day], None, 0))
    out = pnl.withColumn("cum", cum).withColumn("was", F.lag(position).over(w))
    out = out.withColumn("dd", F.col("cum") - F.greatest(F.lit(0.0), F.max("cum").over(frame(keys, [day], None, 0))))
    active = F.col(position) != 0
    return out.groupBy(*keys).agg(
        (F.avg(net) / (F.stddev_pop(net) + 1e-8) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        (F.try_divide(F.avg(net), F.sqrt(F.avg(F.pow(F.least(F.col(net), F.lit(0.0)), 2)))) * F.sqrt(F.lit(252.0))).alias("sortino"),
        F.avg(F.when(active, (F.col(net) > 0).cast("double"))).alias("hit_rate"), F.min("dd").alias("max_drawdown"),
        F.count_if(active & (F.coalesce("was", F.lit(0.0)) == 0)).alias("n_trades"), F.count_if(active).alias("active_days"),
    )
