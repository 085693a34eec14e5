"""Recursions by composition: an ordered fold over a key's rows in two levels, so that one key's series is many tasks.

What a row does to the state of a recursion is a map, and maps of consecutive rows compose. A series is cut into blocks of
time. Every block is turned, by itself, into a table of what it does to any state that may come in; the tables, which are small,
are folded in order and give each block the state that it begins with; then every block is gone through with that state. The
result is that of one fold over the whole series. ``Fold`` says what a recursion has to tell:

* an exponential mean or fixed-gain filter is an affine map: what is kept of the value, and what is added;
* the variance of a filter with known noise is a fractional linear map: two by two numbers, up to their scale;
* a position that holds until its score says otherwise forgets where it came from, or keeps it: three cases;
* a bar that begins anew when it is full is a jump table: the first print that closes a bar decides all later ones, and as
  paths of close starts meet, few entries are left.

A block is any number that never falls along the order, such as the month. Each task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

Arrays = dict[str, np.ndarray]


class Fold:
    """A recursion over ordered rows. Schemas are DDL; a null number comes in as not a number."""

    #: Columns it reads, those it adds, those of a state, and those of a block's table.
    takes: list[str]
    gives: str
    state: str
    table: str
    #: The place in a state of a count whose last value over the series ``rows`` is given as well.
    counted: int | None = None

    def start(self) -> tuple:
        """The state before the first row."""
        raise NotImplementedError

    def block(self, x: Arrays) -> Arrays:
        """The table of a block: what it does to any state."""
        raise NotImplementedError

    def carry(self, state: tuple, table: Arrays) -> tuple:
        """The state after a block, by its table."""
        raise NotImplementedError

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        """What a block gives row by row, from the state it begins with."""
        raise NotImplementedError


#: Types of states and tables.
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).names


def stretches(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of equal ``by`` that stand together in a batch; nulls are equal."""
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, bool)
        for c in by:
            change |= np.diff(batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)) != 0
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:]):
            yield tuple(batch.column(c)[lo].as_py() for c in by), batch.slice(lo, hi - lo)


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal ``by``, which stand together, as one table each; nulls are equal."""
    key, held = None, []
    for own, part in stretches(batches, by):
        if held and own != key:
            yield key, pa.Table.from_batches(held)
            held = []
        key = own
        held.append(part)
    if held:
        yield key, pa.Table.from_batches(held)


def arrays(rows: pa.Table, columns: list[str]) -> Arrays:
    return {c: rows.column(c).to_numpy() for c in columns}


def scan(df: DataFrame, fold: Fold, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """``df`` with what ``fold`` gives. ``block`` never falls along ``order`` within a key; names with sc_ are taken.

    Null keys are one key. The rows are shuffled twice, by key and block; tables and states once.
    """
    at = [*keys, "sc_block"]
    rows = df.withColumn("sc_block", block.cast("long"))
    of = {f.name: f for f in rows.schema.fields}
    slim = rows.select(*dict.fromkeys([*at, *order, *fold.takes]))
    head = [of[k] for k in at]
    state = [T.StructField(f"sc_{f.name}", f.dataType) for f in T.StructType.fromDDL(fold.state).fields]
    total = [T.StructField("sc_after", T.LongType())]
    kinds = [T.StructField("sc_n", T.LongType()), *T.StructType.fromDDL(fold.table).fields]
    given = T.StructType.fromDDL(fold.gives).fields
    table_names, state_names, takes = names(fold.table), [f.name for f in state], fold.takes

    kind_of = {f.name: ARROW[f.dataType.simpleString()] for f in (*kinds, *state, *total)}

    def made(key: list[tuple], like: pa.Table, columns: dict) -> pa.RecordBatch:
        """Rows of the keys, of the types that ``like`` has, and other columns."""
        heads = [pa.array(k, like.schema.field(c).type) for c, k in zip(at, zip(*key, strict=True), strict=True)]
        body = [pa.array(v, kind_of[c]) for c, v in columns.items()]
        return pa.RecordBatch.from_arrays([*heads, *body], names=[*at, *columns])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groups(batches, at):
            got = fold.block(arrays(own, takes))
            n = len(got[table_names[0]])
            yield made([key] * n, own, {"sc_n": np.arange(n), **{c: got[c] for c in table_names}})

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, keyed, out = None, fold.start(), [], []
        for key, own in groups(batches, at):
            if last != key[:-1]:
                last, now = key[:-1], fold.start()
            after = fold.carry(now, arrays(own, table_names))
            keyed.append(key)
            out.append((*now, after[fold.counted] if fold.counted is not None else None))
            now = after
            if len(out) > 10_000:
                yield made(keyed, own, dict(zip([*state_names, "sc_after"], zip(*out, strict=True), strict=True)))
                keyed, out = [], []
        if out:
            yield made(keyed, own, dict(zip([*state_names, "sc_after"], zip(*out, strict=True), strict=True)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groups(batches, at):
            # the first row is the state that the block begins with
            begins = tuple(own.column(c)[0].as_py() for c in state_names)
            total = own.column("sc_after")[0].as_py()
            own = own.slice(1)
            extra = fold.rows(begins, arrays(own, takes), total)
            kept = [own.column(c).combine_chunks() for c in df_names]
            yield from pa.Table.from_arrays([*kept, *extra], names=[*df_names, *given_names]).to_batches(max_chunksize=10_000)

    df_names, given_names = df.columns, [f.name for f in given]
    cut = slim.repartition(*at).sortWithinPartitions(*at, *order).mapInArrow(tables, T.StructType([*head, *kinds]))
    known = cut.repartition(*keys).sortWithinPartitions(*at, "sc_n").mapInArrow(states, T.StructType([*head, *state, *total]))
    known = known.withColumn("sc_after", F.max("sc_after").over(Window.partitionBy(*keys)))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in (*state, *total)]
    void = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in keys]
    both = rows.select("*", *none, F.lit(1).alias("sc_row")).unionByName(known.select("*", *void, F.lit(0).alias("sc_row")))
    both = both.repartition(*at).sortWithinPartitions(*at, "sc_row", *order)
    return both.mapInArrow(apply, T.StructType([*df.schema.fields, *given]))


def carried(df: DataFrame, keys: list[str], order: list[str], takes: list[str], out: str, step: Callable) -> DataFrame:
    """``df`` with a double column from an ordered fold by key: ``step(arrays, state)`` gives values and the state after them.

    Rows are sorted within partitions and go through batch by batch: a task holds one batch and a state, not a key's series.
    """
    names = df.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for own, part in stretches(batches, keys):
            state = state if own == key else None
            key = own
            values, state = step({c: part.column(c).to_numpy(zero_copy_only=False) for c in takes}, state)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*names, out])

    ranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ranged.mapInArrow(fold, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


class Exponential(Fold):
    """y += gain (x - y), from the first x on: an exponential mean, or a filter of fixed gain. Rows without x keep y."""

    state, table = "y double", "keep double, add double, seeded double"

    def __init__(self, x: str, gain: float, out: str):
        self.x, self.gain, self.takes, self.gives = x, gain, [x], f"`{out}` double"

    def start(self) -> tuple:
        return (None,)

    def means(self, first: float | None, x: np.ndarray) -> np.ndarray:
        series = x if first is None else np.append(first, x)
        got = pd.Series(series).ewm(alpha=self.gain, adjust=False).mean().to_numpy()
        return got if first is None else got[1:]

    def block(self, x: Arrays) -> Arrays:
        seen = x[self.x][~np.isnan(x[self.x])]
        add, seeded = (self.means(s, seen)[-1] if len(seen) else s for s in (0.0, None))
        return {"keep": np.array([(1 - self.gain) ** len(seen)]), "add": np.array([add]), "seeded": np.array([np.nan if seeded is None else seeded])}

    def carry(self, state: tuple, table: Arrays) -> tuple:
        keep, add, seeded = (float(table[c][0]) for c in ("keep", "add", "seeded"))
        if state[0] is None:
            return (None if np.isnan(seeded) else seeded,)
        return (keep * state[0] + add,)

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        seen = ~np.isnan(x[self.x])
        got = np.append(np.nan if state[0] is None else state[0], self.means(state[0], x[self.x][seen]))
        y = got[np.cumsum(seen)]
        return [pa.array(y, mask=np.isnan(y))]


class Spread(Fold):
    """Gain of a filter whose step variance ``q`` and noise variance ``r`` are columns: p += q, gain = p / (p + r), p *= 1 - gain.

    The variance p before a block goes to (a p + b) / (c p + d) after it. Rows without q or r leave p and have no gain.
    """

    state, table = "p double", "a double, b double, c double, d double"

    def __init__(self, q: str, r: str, out: str = "gain", first: float = 1.0):
        self.q, self.r, self.first, self.takes, self.gives = q, r, first, [q, r], f"`{out}` double"

    def start(self) -> tuple:
        return (self.first,)

    def block(self, x: Arrays) -> Arrays:
        known = ~(np.isnan(x[self.q]) | np.isnan(x[self.r]))
        q, r = x[self.q][known], x[self.r][known]
        maps = np.empty((len(q), 2, 2))
        maps[:, 0, 0], maps[:, 0, 1], maps[:, 1, 0], maps[:, 1, 1] = r, q * r, 1.0, q + r
        while len(maps) > 1:
            # neighbours compose, the later one from the left; only their ratios count
            rest = maps[len(maps) // 2 * 2 :]
            maps = maps[1::2] @ maps[: len(maps) // 2 * 2 : 2]
            maps = np.concatenate([maps / np.abs(maps).max(axis=(1, 2), keepdims=True), rest])
        m = maps[0] if len(maps) else np.eye(2)
        return {c: np.array([v]) for c, v in zip("abcd", m.ravel(), strict=True)}

    def carry(self, state: tuple, table: Arrays) -> tuple:
        a, b, c, d = (float(table[k][0]) for k in "abcd")
        return ((a * state[0] + b) / (c * state[0] + d),)

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        p, gain = state[0], np.full(len(x[self.q]), np.nan)
        for i, (q, r) in enumerate(zip(x[self.q].tolist(), x[self.r].tolist(), strict=True)):
            if q == q and r == r:
                gain[i] = (p + q) / (p + q + r)
                p = (1 - gain[i]) * (p + q)
        return [pa.array(gain, mask=np.isnan(gain))]


class Gained(Fold):
    """y += gain (x - y) with a gain of each row, from the first x on; rows without x or gain keep y."""

    state, table = "y double", "keep double, add double, seeded double"

    def __init__(self, x: str, gain: str, out: str):
        self.x, self.gain, self.takes, self.gives = x, gain, [x, gain], f"`{out}` double"

    def start(self) -> tuple:
        return (None,)

    def steps(self, y: float | None, x: Arrays) -> np.ndarray:
        out = np.empty(len(x[self.x]))
        y = np.nan if y is None else y
        for i, (v, g) in enumerate(zip(x[self.x].tolist(), x[self.gain].tolist(), strict=True)):
            if v == v and g == g:
                y = y + g * (v - y) if y == y else v
            out[i] = y
        return out

    def block(self, x: Arrays) -> Arrays:
        known = ~(np.isnan(x[self.x]) | np.isnan(x[self.gain]))
        add, seeded = (self.steps(s, x)[-1] for s in (0.0, None))
        return {"keep": np.array([np.prod(1 - x[self.gain][known])]), "add": np.array([add]), "seeded": np.array([seeded])}

    carry = Exponential.carry

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        y = self.steps(state[0], x)
        return [pa.array(y, mask=np.isnan(y))]


class ResetSum(Fold):
    """Number of the bar of each row, from 0: the running value starts again at 0 once it has reached ``threshold``.

    Rows after the last close have none. Values are whole numbers, none below 0; a missing one counts 0.
    """

    state, table = "run long, bar long", "reach long, run long, bars long, total long"
    counted = 1

    def __init__(self, value: str, threshold: int, out: str = "bar_id"):
        self.value, self.threshold, self.takes, self.gives = value, threshold, [value], f"`{out}` long"

    def start(self) -> tuple:
        return (0, 0)

    def values(self, x: Arrays) -> np.ndarray:
        v = x[self.value]
        return np.where(np.isnan(v), 0, v).astype(np.int64) if v.dtype.kind == "f" else v.astype(np.int64)

    def block(self, x: Arrays) -> Arrays:
        cum = np.cumsum(self.values(x))
        n = len(cum)
        close = np.searchsorted(cum, cum + self.threshold)  # after a close here, the next one
        bars, last = (close < n).astype(np.int64), np.where(close < n, close, np.arange(n))
        while True:
            # twice as many closes on
            further = last[last]
            if np.array_equal(further, last):
                break
            bars, last = bars + bars[last], further
        # the first close of the block: at the first place whose sum reaches what the bar that comes in lacks
        m = min(int(np.searchsorted(cum, self.threshold)) + 1, n)
        end = np.append(np.flatnonzero((np.diff(last[:m]) != 0) | (np.diff(bars[:m]) != 0)), m - 1)
        return {"reach": cum[end], "run": cum[-1] - cum[last[end]], "bars": bars[end] + 1, "total": np.full(len(end), cum[-1])}

    def carry(self, state: tuple, table: Arrays) -> tuple:
        run, bar = state
        i = int(np.searchsorted(table["reach"], self.threshold - run))
        if i == len(table["reach"]):
            return run + int(table["total"][0]), bar
        return int(table["run"][i]), bar + int(table["bars"][i])

    def rows(self, state: tuple, x: Arrays, total: int | None) -> list[pa.Array]:
        run, bar = state
        cum = run + np.cumsum(self.values(x))
        base, ends = 0, []
        while (at := int(np.searchsorted(cum, base + self.threshold))) < len(cum):
            ends.append(at)
            base = int(cum[at])
        ids = bar + np.searchsorted(ends, np.arange(len(cum)))
        return [pa.array(ids, pa.int64(), mask=ids >= total)]
