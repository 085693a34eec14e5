"""Resampled paths of a key's profits, as Spark jobs: arrays of bounded size, or blocks as rows that meet pieces of the series by join.

A key of up to HELD profits is sent, in chunks, to SLOTS tasks. Each holds it as arrays and goes through its share of the paths,
some PLACES places at a time, or, for percentiles by step, through its share of the steps with all paths side by side. What is
shuffled is the series, SLOTS times; paths are never written.

A longer key's profits are cut into chunks of CHUNK. A simulation is a row of blocks (start, length); a block meets
the chunks that it covers, one piece each, so that rows grow with the number of blocks and not with that of profits. What a piece
does to a path is four numbers: its sum, its highest and lowest level, and its deepest drop. Pieces of a simulation are put
together in order by windows. There no task holds a whole series, and a series of any length is dealt by chunk and by simulation.

Draws are those of a generator seeded by (seed, key, simulation), the same in both forms, so that a task that is run again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from causeway.functions.tables import written

CHUNK = 256
#: Profits of a row of the written series, of a key that one task holds at most, and tasks over which a key's paths or steps go.
LONG, HELD, SLOTS = 256, 1 << 22, 24
#: Places of a path in numpy at a time, blocks drawn at a time, and levels that a task sorts at a time.
PLACES, DRAWN, LEVELS = 1 << 15, 4096, 1 << 22


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 53 bits from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def numbered(trades: DataFrame, keys: list[str], order: list[str], pnl: str) -> DataFrame:
    """keys, place from 0, n and x: the profits that are there and finite, in order."""
    known = trades.where(F.abs(F.col(pnl).cast("double")) < float("inf"))  # a NaN is above it
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return known.select(*keys, place.cast("long").alias("place"), F.count("*").over(Window.partitionBy(*keys)).alias("n"), F.col(pnl).cast("double").alias("x"))


def written_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, chunk and xs, the profits of a chunk in order, as a table in the shared folder."""
    chunk = F.floor(F.col("place") / LONG).cast("long").alias("chunk")
    xs = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r.x).alias("xs")
    return written(series.groupBy(*keys, chunk).agg(F.first("n").alias("n"), xs).select(*keys, "n", "chunk", "xs"), "series")


def by_slot(table: DataFrame, keys: list[str], seed: int, run: Callable[[int, int, np.ndarray], Iterator[dict]], columns: str) -> DataFrame:
    """keys and what ``run`` (path hash, slot, series) yields, in each of SLOTS tasks, one key's series at a time."""
    schema = T.StructType([*(table.schema[c] for c in keys), *T.StructType.fromDDL(columns).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, xs, head = None, [], None

        def found() -> Iterator[pa.RecordBatch]:
            slot, path = (head.column(c)[0].as_py() for c in ("rs_slot", "rs_path"))
            for got in run(path, slot, np.concatenate(xs)):
                own = pa.array(np.zeros(len(next(iter(got.values()))), np.int64))
                arrays = [*(head.column(c).take(own) for c in keys), *(pa.array(got[c]) for c in schema.names[len(keys) :])]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            column = batch.column("xs")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rs_slot", *keys)))):
                if now != key:
                    if xs:
                        yield from found()
                    key, xs, head = now, [], batch.slice(i, 1)
                xs.append(values[offsets[i] : offsets[i + 1]])
        if xs:
            yield from found()

    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("rs_slot")
    dealt = table.select(*keys, path_hash(keys, seed), "chunk", "xs", slots).repartitionById(SLOTS, "rs_slot")
    return dealt.sortWithinPartitions("rs_slot", *keys, "chunk").mapInArrow(each, schema)


def simulations(series: DataFrame, keys: list[str], n_sims: int) -> DataFrame:
    """keys, n and sim: every simulation of every key, dealt to tasks."""
    sizes = series.groupBy(*keys).agg(F.first("n").alias("n"))
    return sizes.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_sims)))).repartition(*keys, "sim")


def drawn(path: int, sim: int) -> np.random.Generator:
    """The draws of one path; ``path`` is the hash of seed and keys."""
    return np.random.Generator(np.random.SFC64([path % (1 << 64), sim]))


def stationary_draws(path: int, sim: int, n: int, mean_block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where blocks begin in the path and in the series, and their sizes, some PLACES places at a time."""
    draw, at, many = drawn(path, sim), 0, max(16, PLACES // mean_block)
    mean = -1 / math.log1p(-1 / mean_block) if mean_block > 1 else 0.0
    while at < n:
        size = np.minimum(draw.standard_exponential(many) * mean, n - 1).astype(np.int64) + 1
        start = (draw.random(many) * n).astype(np.int64)
        end = at + size.cumsum()
        k = int(np.searchsorted(end, n)) + 1
        size, start, end = size[:k], start[:k], end[:k]
        if end[-1] > n:
            size[-1] -= end[-1] - n
            end[-1] = n
        yield end - size, start, size
        at = int(end[-1])


def fixed_draws(path: int, sim: int, n: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``stationary_draws``, for blocks of ``block`` that end with the series."""
    draw, at = drawn(path, sim), 0
    while at < n:
        start = (draw.random(DRAWN) * n).astype(np.int64)
        size = np.minimum(block, n - start)
        end = at + size.cumsum()
        k = int(np.searchsorted(end, n)) + 1
        size, start, end = size[:k], start[:k], end[:k]
        if end[-1] > n:
            size[-1] -= end[-1] - n
            end[-1] = n
        yield end - size, start, size
        at = int(end[-1])


def path_hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys).alias("rs_path")


def blocks_of(sims: DataFrame, keys: list[str], seed: int, draws: Callable[[int, int, int], Iterator]) -> DataFrame:
    """keys, n, sim, at, start, size: the blocks of each path."""
    schema = T.StructType([*(sims.schema[c] for c in (*keys, "n", "sim")), *T.StructType.fromDDL("at long, start long, size long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, n, sim) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rs_path", "n", "sim")))):
                for found in draws(path, sim, n):
                    own = pa.array(np.full(len(found[0]), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in (*keys, "n", "sim")), *map(pa.array, found)], schema.names)

    return sims.select(*keys, "n", "sim", path_hash(keys, seed)).mapInArrow(run, schema)


def stationary_blocks(sims: DataFrame, keys: list[str], mean_block: int, seed: int) -> DataFrame:
    """keys, n, sim, at, start, size: at each place of a path a new block begins with chance 1 / mean_block, anywhere; blocks wrap."""
    return blocks_of(sims, keys, seed, lambda path, sim, n: stationary_draws(path, sim, n, mean_block))


def fixed_blocks(sims: DataFrame, keys: list[str], block: int, seed: int) -> DataFrame:
    """As ``stationary_blocks``, but blocks of ``block`` that end with the series, one after the other until the path is full."""
    return blocks_of(sims, keys, seed, lambda path, sim, n: fixed_draws(path, sim, n, block))


def pieces(blocks: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sim, at and xs: the profits of each piece of a path, in order, from place ``at`` on."""
    end = F.col("start") + F.col("size")
    part = lambda lo, hi, at: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at.cast("long").alias("at"))
    parts = F.array(part(F.col("start"), F.least(end, F.col("n")), F.col("at")), part(F.lit(0), end - F.col("n"), F.col("at") + F.col("n") - F.col("start")))
    cut = blocks.select(*keys, "n", "sim", F.explode(F.filter(parts, lambda p: p.hi > p.lo)).alias("p"))
    cut = cut.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("p.lo") / CHUNK), F.floor((F.col("p.hi") - 1) / CHUNK))))
    lo, hi = F.greatest(F.col("p.lo"), F.col("chunk") * CHUNK), F.least(F.col("p.hi"), F.col("chunk") * CHUNK + CHUNK)
    cut = cut.select(*keys, "n", "sim", "chunk", (F.col("p.at") + lo - F.col("p.lo")).alias("at"), (lo - F.col("chunk") * CHUNK).alias("from"), (hi - lo).alias("many"))
    held = series.groupBy(*(F.col(k).alias(f"rs_{k}") for k in keys), F.floor(F.col("place") / CHUNK).alias("rs_chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r.x).alias("values")
    )
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"rs_{k}")) for k in keys), F.col("chunk") == F.col("rs_chunk"))
    return cut.join(held, on).select(*keys, "n", "sim", "at", F.slice("values", F.col("from").cast("int") + 1, F.col("many").cast("int")).alias("xs"))


PIECE = "at long, n_x long, s double, high double, low double, drop double, won double, lost double, wins long, x double, xx double"


def piece_figures(x: np.ndarray, offsets: np.ndarray, risk: float) -> dict[str, np.ndarray]:
    """What each piece x[offsets[i]:offsets[i + 1]], none empty, does to log equity, and its sums for other figures."""
    n = np.diff(offsets)
    step = np.log(np.maximum(1 + risk * x, 1e-12))
    total = lambda v: np.add.reduceat(v, offsets[:-1]) if len(n) else np.empty(0, v.dtype)
    out = {
        "n_x": n, "s": total(step), "won": total(np.maximum(x, 0)), "lost": -total(np.minimum(x, 0)), "wins": total((x > 0).astype(np.int64)), "x": total(x), "xx": total(x * x),
        **{c: np.zeros(len(n)) for c in ("high", "low", "drop")},
    }
    width = 1
    while width < 2 * n.max(initial=0):
        # pieces of like lengths side by side; what is beyond a piece's end repeats its last level
        rows = np.flatnonzero((n <= width) & (n > width // 2))
        if len(rows):
            at = np.minimum(np.arange(width), n[rows, None] - 1) + offsets[rows, None]
            own = np.where(np.arange(width) < n[rows, None], step[at], 0.0).cumsum(1)
            high = np.maximum.accumulate(np.maximum(own, 0.0), axis=1)
            out["high"][rows], out["low"][rows], out["drop"][rows] = high[:, -1], np.minimum(own.min(1), 0.0), np.minimum((own - high).min(1), 0.0)
        width *= 2
    return out


def folded(path: DataFrame, keys: list[str], risk: float) -> DataFrame:
    """keys, sim, at and the figures of each piece of ``path``."""
    heads = [*keys, "sim", "at"]
    schema = T.StructType([*(path.schema[c] for c in (*keys, "sim")), *T.StructType.fromDDL(PIECE).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("xs")
            offsets = xs.offsets.to_numpy().astype(np.int64)
            x = xs.values.to_numpy()[offsets[0] : offsets[-1]] if len(offsets) else np.empty(0)
            got = piece_figures(x, offsets - offsets[0], risk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in heads), *(pa.array(got[c]) for c in names[len(heads) :])], names=names)

    return path.select(*heads, "xs").mapInArrow(run, schema)


def path_figures(path: DataFrame, keys: list[str], risk: float, ruin: float) -> DataFrame:
    """keys, sim and eight figures of each path: total, drawdown (not above 0), win rate, profit factor, mean, Sharpe, ruin, trades."""
    by = [*keys, "sim"]
    before = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    got = folded(path, keys, risk).withColumn("level", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    got = got.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("level") + F.col("high")).over(before), F.lit(0.0))))
    drop = F.least(F.col("level") + F.col("low") - F.col("peak"), F.col("drop"))
    sums = got.groupBy(*by).agg(F.min(drop).alias("drop"), *(F.sum(c).alias(c) for c in SUMS))
    return figures(sums, by, ruin)


SUMS = ("n_x", "s", "won", "lost", "wins", "x", "xx")


def figures(sums: DataFrame, by: list[str], ruin: float) -> DataFrame:
    """``by`` and the eight figures of a path, from its sums and deepest fall of log equity."""
    n, mean = F.col("n_x"), F.col("x") / F.col("n_x")
    var = F.col("xx") / n - mean * mean
    depth = F.least(F.exp("drop") - 1, F.lit(0.0))
    return sums.select(
        *by, (F.exp("s") - 1).alias("total"), depth.alias("max_drawdown"), (F.col("wins") / n).alias("win_rate"),
        (F.col("won") / F.when(F.col("lost") > 0, F.col("lost")).otherwise(1e-9)).alias("profit_factor"), mean.alias("expectancy"),
        F.when(var > 1e-18, mean / F.sqrt(F.greatest(var, F.lit(1e-18)))).otherwise(0.0).alias("sharpe"), n.alias("n_trades"),
        (depth <= ruin).cast("double").alias("ruin"),
    )


def held_paths(table: DataFrame, keys: list[str], n_sims: int, mean_block: int, seed: int, risk: float) -> DataFrame:
    """keys, sim, drop and the sums of each path: a task holds a key's series and its running sums, and goes through some of its paths."""

    def run(path: int, slot: int, x: np.ndarray) -> Iterator[dict]:
        n = len(x)
        step = np.log(np.maximum(1 + risk * x, 1e-12))
        before = np.zeros((n + 1, 5))
        for i, each in enumerate((np.maximum, np.minimum, np.greater, np.add, np.multiply)):
            np.cumsum(each(x, x if each is np.multiply else 0), out=before[1:, i])
        before[:, 1] *= -1
        own = np.arange(slot, n_sims + 1, SLOTS)
        out = {c: np.zeros(len(own)) for c in ("drop", "s", "won", "lost", "wins", "x", "xx")}
        for i, sim in enumerate(own.tolist()):
            level = peak = drop = 0.0
            sums = np.zeros(5)
            cuts = np.arange(0, n, PLACES)
            seen = ((cuts[k : k + 1], cuts[k : k + 1], np.minimum(PLACES, n - cuts[k : k + 1])) for k in range(len(cuts)))
            for at, start, size in stationary_draws(path, sim, n, mean_block) if sim else seen:
                rows = np.repeat(start - (at - at[0]), size)
                rows += np.arange(len(rows))
                walk = step.take(rows, mode="wrap").cumsum()
                walk += level
                level = walk[-1]
                top = np.maximum.accumulate(walk, out=rows.view(np.float64))
                np.maximum(top, peak, out=top)
                peak = top[-1]
                drop = min(drop, np.subtract(walk, top, out=walk).min())
                end = start + size
                over = end > n
                gain = before.take(np.where(over, end - n, end), axis=0, mode="clip")
                gain -= before.take(start, axis=0, mode="clip")
                gain[over] += before[n]  # one by one, so that what never falls adds exactly 0
                sums += gain.sum(0)
            out["drop"][i], out["s"][i] = drop, level
            for c, v in zip(("won", "lost", "wins", "x", "xx"), sums):
                out[c][i] = v
        yield out | {"sim": own.astype(np.int32), "n_x": np.full(len(own), n), "wins": np.rint(out["wins"]).astype(np.int64)}

    return by_slot(table, keys, seed, run, "sim int, n_x long, s double, drop double, won double, lost double, wins long, x double, xx double")


FIGURES = ["total", "max_drawdown", "win_rate", "profit_factor", "expectancy", "sharpe", "ruin", "n_trades"]


def bootstrap(
    trades: DataFrame, keys: list[str], order: list[str], pnl: str, n_sims: int = 10_000, mean_block: int = 10, seed: int = 7, risk: float = 0.01, ruin: float = -0.5
) -> DataFrame:
    """The figures of each simulated path of each key by stationary blocks (``mean_block`` 1: one by one); sim 0 is what was observed.

    Keys of up to HELD profits are gone through as arrays, longer ones as rows of pieces, from the same draws.
    """
    series = numbered(trades, keys, order, pnl)
    table = written_series(series, keys)
    got = figures(held_paths(table.where(F.col("n") <= HELD), keys, n_sims, mean_block, seed, risk), [*keys, "sim"], ruin)
    if (table.agg(F.max("n")).first()[0] or 0) <= HELD:
        return got
    series = series.where(F.col("n") > HELD)
    blocks = stationary_blocks(simulations(series, keys, n_sims), keys, mean_block, seed)
    zero = F.lit(0).cast("long")
    seen = series.groupBy(*keys).agg(F.first("n").alias("n")).select(*keys, "n", F.lit(0).alias("sim"), zero.alias("at"), zero.alias("start"), F.col("n").alias("size"))
    return got.unionByName(path_figures(pieces(blocks.unionByName(seen), series, keys), keys, risk, ruin))


def intervals(sims: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key and figure: observed, mean, median, 5 % and 95 % points, and the share below 0."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("v")) for c in FIGURES))).alias("e")
    drawn = F.when(F.col("sim") > 0, F.col("v"))
    return sims.select(*keys, "sim", each).select(*keys, "sim", "e.*").groupBy(*keys, "figure").agg(
        F.max(F.when(F.col("sim") == 0, F.col("v"))).alias("observed"), F.avg(drawn).alias("mean"), F.percentile(drawn, 0.5).alias("median"),
        F.percentile(drawn, 0.05).alias("ci_5"), F.percentile(drawn, 0.95).alias("ci_95"), F.avg((drawn < 0).cast("double")).alias("p_negative"),
    )


PERCENTS = (5, 10, 25, 50, 75, 90, 95)


def held_fan(table: DataFrame, keys: list[str], n_sims: int, block: int, seed: int) -> DataFrame:
    """keys, step and percentiles: a task holds a key's series and goes with all its paths through some of the steps."""

    def run(path: int, slot: int, x: np.ndarray) -> Iterator[dict]:
        n = len(x)
        lo, hi = n * slot // SLOTS, n * (slot + 1) // SLOTS
        if lo == hi:
            return
        wide = max(1, min(LEVELS // n_sims, hi - lo))
        whole = np.convolve(x, np.ones(block))[block - 1 :]  # what a block from each place on adds
        walks = [steps_from(drawn(path, sim), x, whole, block, lo, wide) for sim in range(1, n_sims + 1)]
        at = [(n_sims - 1) * p / 100 for p in PERCENTS]
        for first in range(lo, hi, wide):
            many = min(wide, hi - first)
            levels = np.empty((n_sims, many))
            for i, walk in enumerate(walks):
                levels[i] = next(walk)[:many]
            levels = np.ascontiguousarray(levels.T)
            levels.sort(axis=1)
            out = {"step": np.arange(first + 1, first + many + 1)}
            for p, place in zip(PERCENTS, at):
                below, above = levels[:, math.floor(place)], levels[:, math.ceil(place)]
                out[f"p{p}"] = np.where(below == above, below, (math.ceil(place) - place) * below + (place - math.floor(place)) * above)
            yield out

    return by_slot(table, keys, seed, run, "step long, " + ", ".join(f"p{p} double" for p in PERCENTS))


def steps_from(draw: np.random.Generator, x: np.ndarray, whole: np.ndarray, block: int, lo: int, wide: int) -> Iterator[np.ndarray]:
    """The levels of a path at the places from ``lo`` on, ``wide`` at a time; ``whole`` is what a block from each place on adds."""
    n, level, skip = len(x), 0.0, lo
    many = max(16, min(DRAWN, wide))  # what each of the paths side by side keeps
    while True:
        start = (draw.random(many) * n).astype(np.int64)
        end = np.minimum(block, n - start).cumsum()
        k = int(np.searchsorted(end, skip, side="right"))  # blocks that end before
        level += whole[start[:k]].sum()
        skip -= int(end[k - 1]) if k else 0
        if k < many:
            break
    start = start[k:]
    level += x[start[0] : start[0] + skip].sum()
    while True:
        size = np.minimum(block, n - start)
        while size.sum() < skip + wide:
            start = np.append(start, (draw.random(max(16, -(-2 * wide // block))) * n).astype(np.int64))
            size = np.minimum(block, n - start)
        end = size.cumsum()
        k = int(np.searchsorted(end, skip + wide)) + 1
        rows = np.repeat(start[:k] - (end - size)[:k], size[:k])[skip : skip + wide]
        rows += np.arange(skip, skip + wide)
        out = x[rows].cumsum()
        out += level
        level = out[-1]
        skip = skip + wide - int(end[k - 1] - size[k - 1])
        start = start[k - 1 :].copy()
        del rows, size, end  # many paths wait here
        yield out


def fan(trades: DataFrame, keys: list[str], order: list[str], pnl: str, n_sims: int = 1000, block: int = 20, seed: int = 7) -> DataFrame:
    """keys, step (from 1) and p5 .. p95: percentiles over the simulated running sums at every step of the path.

    Keys of up to HELD profits are gone through as arrays, longer ones as rows of pieces, from the same draws.
    """
    series = numbered(trades, keys, order, pnl)
    table = written_series(series, keys)
    held = held_fan(table.where(F.col("n") <= HELD), keys, n_sims, block, seed)
    if (table.agg(F.max("n")).first()[0] or 0) <= HELD:
        return held
    series = series.where(F.col("n") > HELD)
    path = pieces(fixed_blocks(simulations(series, keys, n_sims), keys, block, seed), series, keys)
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
    before = Window.partitionBy(*keys, "sim").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    path = path.withColumn("level", F.coalesce(F.sum(total).over(before), F.lit(0.0)))
    run = F.aggregate("xs", F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
    steps = path.select(*keys, "at", "level", F.posexplode(run).alias("i", "v"))
    steps = steps.select(*keys, (F.col("at") + F.col("i") + 1).alias("step"), (F.col("level") + F.col("v")).alias("v"))
    got = steps.groupBy(*keys, "step").agg(F.percentile("v", [p / 100 for p in PERCENTS]).alias("q"))
    return held.unionByName(got.select(*keys, "step", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTS))))


def sharpe_interval(days: DataFrame, keys: list[str], order: list[str], ret: str, n_sims: int = 10_000, seed: int = 7) -> DataFrame:
    """Yearly Sharpe ratio of the days with a return, observed and drawn one by one: mean, median, 5 % and 95 %, share below 0.

    Keys of fewer than ten such days have none.
    """
    active = days.where((F.col(ret) != 0) & F.col(ret).isNotNull())
    sims = bootstrap(active, keys, order, ret, n_sims, 1, seed).where("n_trades >= 10")
    v = F.col("sharpe") * F.sqrt(F.lit(252.0))
    drawn = F.when(F.col("sim") > 0, v)
    return sims.groupBy(*keys).agg(
        F.max("n_trades").alias("n_days"), F.max(F.when(F.col("sim") == 0, v)).alias("observed"), F.avg(drawn).alias("mean"), F.percentile(drawn, 0.5).alias("median"),
        F.percentile(drawn, 0.05).alias("ci_5"), F.percentile(drawn, 0.95).alias("ci_95"), F.avg((drawn < 0).cast("double")).alias("p_negative"),
    )
