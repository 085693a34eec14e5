"""Substring dedup: drop words covered by a window of k words whose sequence starts earlier elsewhere.

A window is k consecutive words of one text. Its anchor is the least hash among its runs of ``gram`` words; equal
windows have equal anchors at equal places. The work goes in two passes over the texts.

1. Each task counts anchors in a count-min sketch of two rows, with cells of two bits (none, once, more). The tasks'
   sketches are merged block by block. An anchor's estimate is never below its count, and its count is never below
   that of a window which has it, so estimates of windows are never too low.
2. Windows whose anchor is estimated repeated get an exact key of 96 hash bits. Within a task equal keys are settled at
   once: all but the earliest are repeats. One row for each key and task goes on; the earliest of a key over all tasks
   stays, the others are repeats. No window that repeats is missed, as the sketch only overestimates.

The sketch has some 8 cells for each anchor. Up to ``most_cells`` it is broadcast: at most ``most_cells`` / 8 bytes.
Beyond that it is dealt to shards by key, so that it grows with the text: tasks send each anchor once to the shard of its
key, which counts it in a sketch of its own, and the places of those estimated repeated are joined to their texts for
pass 2. Either way pass 2 gets a share of the unique anchors that does not depend on the size of the text. A key in very
many texts sends at most one row from each chunk of a task.

"Earlier" means smaller id, or the same id and an earlier start. Repeated rows, of one id and text, do not remove each
other's words, since neither starts earlier; an id is taken to name one text, and what is found at a place of it is
dropped from each of its rows. Cases: null texts stay null and have no words; a document without an id comes neither before
nor after another: it loses no words and takes none; texts of fewer than k words lose none; a very long text is hashed whole; an empty table stays empty; other columns are kept, but for n_words and n_removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from causeway.llm.common import U, WordHasher, lean_batches, mix, sketch_tasks, slices, string_buffers, text_bytes, word_bounds

#: Cells of one merged block: a task of the merge holds a few blocks at a time.
BLOCK_CELLS = 1 << 22
MOST_CELLS = 1 << 29
#: Cells of one shard's sketch, for 2 to 4 million anchors of 24 bytes, which its task holds.
SHARD_CELLS = 1 << 25
#: Anchors that a task gathers before it sends them on.
CHUNK = 1_000_000


def anchors(hasher: WordHasher, words: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash of each window, place of its run) of one text's words; ties go to the later place."""
    runs = hasher.windows(words, gram)
    width = k - gram + 1
    if len(runs) < width:
        return np.empty(0, U), np.empty(0, np.int64)
    # sliding minimum by doubling: spans of 1, 2, 4 ... runs, then two overlapping spans
    value, span = runs, 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    n = len(runs) - width + 1
    least = np.minimum(value[:n], value[width - span : width - span + n])
    view = np.lib.stride_tricks.sliding_window_view(runs, width)
    place = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 14):
        part = view[lo : lo + (1 << 14)]
        place[lo : lo + len(part)] = width - 1 - (part[:, ::-1] == least[lo : lo + len(part), None]).argmax(1)
    return least, place + np.arange(n)


def spread(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cells as (bytes, bits to set in each)."""
    byte = cells >> 3
    head = np.ones(len(byte), bool)
    head[1:] = byte[1:] != byte[:-1]
    bits = np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8))
    return byte[head], np.bitwise_or.reduceat(bits, np.flatnonzero(head)) if len(cells) else bits


class Sketch:
    """Count-min over 64-bit keys: two rows of cells that count none, one, or more, held as two planes of bits."""

    def __init__(self, cells: int, once: np.ndarray | None = None, more: np.ndarray | None = None):
        self.bits = int(cells).bit_length() - 1
        self.once = np.zeros(cells // 8, np.uint8) if once is None else once
        self.more = np.zeros(cells // 8, np.uint8) if more is None else more

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both cells of each key: the first row is the lower half, the second the upper."""
        down = U(64 - self.bits + 1)
        half = np.int64(1 << (self.bits - 1))
        return (keys >> down).astype(np.int64), (mix(keys ^ U(0x5851F42D4C957F2D)) >> down).astype(np.int64) + half

    def add(self, keys: np.ndarray) -> None:
        for at in self.cells(keys):
            at, n = np.unique(at, return_counts=True)
            byte, bits = spread(at)
            self.more[byte] |= self.once[byte] & bits
            self.once[byte] |= bits
            byte, bits = spread(at[n > 1])
            self.more[byte] |= bits

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.cells(keys):
            out &= (self.more[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0
        return out


def sketch_cells(n_bytes: int) -> int:
    """A power of two of some 8 cells for each anchor, at 6 bytes a word and 6 words an anchor."""
    return max(1 << 16, 1 << int(n_bytes * 8 / 36).bit_length())


def count_anchors(docs: DataFrame, k: int, gram: int, cells: int, tasks: int) -> DataFrame:
    """The merged sketch in blocks: block int, cells binary (the compressed plane of cells that count more than one)."""
    block = min(BLOCK_CELLS, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hasher = Sketch(cells), WordHasher()
        any_row = False
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                part = offsets[lo : hi + 1]
                words, _, _, at = hasher(raw[part[0] : part[-1]], part - part[0])
                keys = []
                for i in range(hi - lo):
                    least, place = anchors(hasher, words[at[i] : at[i + 1]], k, gram)
                    if len(least):
                        new = np.ones(len(place), bool)
                        new[1:] = place[1:] != place[:-1]
                        keys.append(least[new])
                if keys:
                    any_row = True
                    sketch.add(np.concatenate(keys))
        if any_row:
            for b in range(cells // block):
                once, more = (x[b * block // 8 : (b + 1) * block // 8] for x in (sketch.once, sketch.more))
                if once.any():
                    planes = zlib.compress(once.tobytes() + more.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([planes], pa.binary())], names=["block", "cells"])

    def merge(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(block // 8, np.uint8), np.zeros(block // 8, np.uint8)
        for batch in rows:
            for data in batch.column("cells"):
                new_once, new_more = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8).reshape(2, -1)
                more |= new_more | once & new_once
                once |= new_once
        planes = zlib.compress(more.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([planes], pa.binary())], names=["block", "cells"])

    schema = "block int, cells binary"
    return docs.select("doc_id", "text").coalesce(tasks).mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema)


def broadcast_sketch(docs: DataFrame, k: int, gram: int, cells: int, n_bytes: int):
    """The merged sketch's plane of cells that count more than one, broadcast: ``cells`` / 8 bytes."""
    tasks = sketch_tasks(docs.sparkSession, n_bytes)
    block = min(BLOCK_CELLS, cells) // 8
    more = np.zeros(cells // 8, np.uint8)
    for row in count_anchors(docs, k, gram, cells, tasks).toLocalIterator():
        more[row.block * block : (row.block + 1) * block] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(more)


#: An anchor's key, and where it stands: the document, the first window that has it and how many in a row do.
PLACE = np.dtype([("key", U), ("doc", np.int64), ("start", np.int32), ("n", np.int32)])


def packed(rows: np.ndarray, with_keys: bool) -> bytes:
    """Places by document, as columns of differences, compressed: some 11 bytes a place instead of 24."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    steps = [np.diff(rows[c], prepend=rows.dtype[c].type(0)).tobytes() for c in ("doc", "start")]
    rest = zlib.compress(b"".join([*steps, rows["n"].tobytes()]), 1)
    return np.int64(len(rows)).tobytes() + (rows["key"].tobytes() if with_keys else b"") + rest


def unpacked(data: pa.Buffer, with_keys: bool) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    rows = np.zeros(n, PLACE)
    at = 8
    if with_keys:
        rows["key"], at = np.frombuffer(data, U, n, 8), 8 + 8 * n
    rest = zlib.decompress(memoryview(data)[at:])
    rows["doc"] = np.cumsum(np.frombuffer(rest, np.int64, n))
    rows["start"] = np.cumsum(np.frombuffer(rest, np.int32, n, 8 * n), dtype=np.int32)
    rows["n"] = np.frombuffer(rest, np.int32, n, 12 * n)
    return rows


def suspects(docs: DataFrame, k: int, gram: int, cells: int, most_cells: int) -> DataFrame:
    """doc_id, start, n: runs of windows whose anchor is estimated repeated, by sketches dealt to shards.

    Each chunk of a task sends a key once to its shard. The other places of a key that a chunk holds more than once are
    known to repeat: they skip the count and pass through groups of their own, which have negative numbers.
    """
    own_cells = min(SHARD_CELLS, most_cells)
    shards = cells // own_cells

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held, waiting = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if not held:
                return
            rows = np.concatenate(held)
            held.clear()
            waiting = 0
            rows = rows[np.argsort(rows["key"], kind="stable")]
            head = np.ones(len(rows), bool)
            head[1:] = rows["key"][1:] != rows["key"][:-1]
            alone = head.copy()
            alone[:-1] &= head[1:]
            first, known = rows[head], rows[~alone]
            to = (mix(first["key"] ^ U(0xD6E8FEB86659FD93)) % U(shards)).astype(np.int64)
            by_doc = -1 - (mix(known["doc"].astype(U)) % U(shards)).astype(np.int64)
            rows, to = np.concatenate([first, known]), np.concatenate([to, by_doc])
            order = np.argsort(to, kind="stable")
            rows, to = rows[order], to[order]
            edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            stop = np.append(edge[1:], len(rows))
            for lo in range(0, len(edge), 4096):
                some = range(lo, min(lo + 4096, len(edge)))
                data = pa.array([packed(rows[edge[i] : stop[i]], to[edge[i]] >= 0) for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(to[edge[lo : lo + 4096]]), data], names=["shard", "places"])

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            known = np.asarray(batch.column(0).is_valid())
            doc = batch.column(0).fill_null(0).to_numpy()
            for lo, hi in slices(offsets, 1 << 20):
                part = offsets[lo : hi + 1]
                words, _, _, at = hasher(raw[part[0] : part[-1]], part - part[0])
                for i in np.flatnonzero(known[lo:hi]):
                    least, place = anchors(hasher, words[at[i] : at[i + 1]], k, gram)
                    if not len(least):
                        continue
                    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                    rows = np.empty(len(start), PLACE)
                    rows["key"], rows["doc"], rows["start"] = least[start], doc[lo + i], start
                    rows["n"] = np.diff(np.append(start, len(least)))
                    held.append(rows)
                    waiting += len(rows)
                if waiting > CHUNK:
                    yield from send()
        yield from send()

    def places(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(rows[c])) for c in ("doc", "start", "n")], names=["doc_id", "start", "n"]
        )

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = key[0].as_py() >= 0
        chunks = (unpacked(x.as_buffer(), counted) for batch in batches for x in batch.column("places"))
        if not counted:
            yield from map(places, chunks)
            return
        sketch, held = Sketch(own_cells), []
        for rows in chunks:
            sketch.add(rows["key"])
            held.append(rows)
        for rows in held:
            hit = rows[sketch.repeated(rows["key"])]
            if len(hit):
                yield places(hit)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "shard long, places binary")
    return dealt.groupBy("shard").applyInArrow(count, "doc_id long, start int, n int")


def spelled_out(runs: pa.StructArray, windows: int) -> np.ndarray:
    """The starts within ``windows`` that runs (start, n) cover, ascending."""
    start, n = (runs.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
    inside = start < windows
    cover = np.zeros(max(windows, 0) + 1, np.int64)
    np.add.at(cover, start[inside], 1)
    np.add.at(cover, np.minimum(start + n, windows)[inside], -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def repeats(docs: DataFrame, k: int = 20, gram: int = 8, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, start, n: runs of windows (n consecutive starts) whose word sequence also starts earlier."""
    n_bytes = text_bytes(docs)
    cells = sketch_cells(n_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = None
    if cells <= most_cells:
        held = broadcast_sketch(docs, k, gram, cells, n_bytes)
    else:
        # an id names one text, so equal places of its rows are one place
        runs = suspects(docs, k, gram, cells, most_cells).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
        # an outer join, as that of ``substring_dedup``: both shuffle the same texts, which Spark then does once
        texts = texts.join(runs.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "runs")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(cells, held.value, held.value) if held else None
        hasher, second = WordHasher(), WordHasher(seed=2)
        h1, h2, ids, starts, waiting = [], [], [], [], 0
        names = ["doc_id", "start", "n", "known", "h1", "h2"]

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if not h1:
                return
            a, b, d, s = (np.concatenate(x) for x in (h1, h2, ids, starts))
            order = np.lexsort((s, d, b, a))
            a, b, d, s = a[order], b[order], d[order], s[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            # a second row that starts at the very same place is no repeat: it goes on beside the first
            same = np.zeros(len(a), bool)
            group = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            same = (d == d[group]) & (s == s[group])
            rest = ~same
            order = np.lexsort((s[rest], d[rest]))
            rd, rs = d[rest][order], s[rest][order]
            if len(rd):
                cut = np.ones(len(rd), bool)
                cut[1:] = (rd[1:] != rd[:-1]) | (rs[1:] > rs[:-1] + 1)
                at = np.flatnonzero(cut)
                last = np.append(at[1:], len(rd)) - 1
                n = rs[last] - rs[at] + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rd[at]), pa.array(rs[at].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.ones(len(at), bool)),
                        pa.array(mix(rd[at].astype(U) * U(0x9E3779B97F4A7C15) + rs[at].astype(U)).view(np.int64)), pa.array(np.zeros(len(at), np.int32)),
                    ],
                    names=names,
                )
            for lo in range(0, int(head.sum()), 20_000):
                pick = np.flatnonzero(head)[lo : lo + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[pick]), pa.array(s[pick].astype(np.int32)), pa.array(np.ones(len(pick), np.int32)), pa.array(np.zeros(len(pick), bool)),
                        pa.array(a[pick].view(np.int64)), pa.array(b[pick].view(np.int32)),
                    ],
                    names=names,
                )
            for x in (h1, h2, ids, starts):
                x.clear()
            waiting = 0

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            known = np.asarray(batch.column(0).is_valid())
            doc = batch.column(0).fill_null(0).to_numpy()
            for lo, hi in slices(offsets, 1 << 20):
                part = offsets[lo : hi + 1]
                words, first, end, at = hasher(raw[part[0] : part[-1]], part - part[0])
                other = None
                for i in range(hi - lo):
                    if not known[lo + i]:
                        continue
                    own = words[at[i] : at[i + 1]]
                    if sketch:
                        least, _ = anchors(hasher, own, k, gram)
                        hit = np.flatnonzero(sketch.repeated(least)) if len(least) else ()
                    elif not batch.column(2)[lo + i].is_valid:
                        continue
                    else:
                        hit = spelled_out(batch.column(2)[lo + i].values, len(own) - k + 1)
                    if not len(hit):
                        continue
                    if other is None:
                        other = second(raw[part[0] : part[-1]], part - part[0])[0]
                    h1.append(hasher.windows(own, k)[hit])
                    h2.append((second.windows(other[at[i] : at[i + 1]], k)[hit] >> U(32)).astype(np.uint32))
                    ids.append(np.full(len(hit), doc[lo + i], np.int64))
                    starts.append(hit)
                    waiting += len(hit)
                if waiting > 1_000_000:
                    yield from settle()
        yield from settle()

    found = texts.mapInArrow(find, "doc_id long, start int, n int, known boolean, h1 long, h2 int")
    # runs settled in their task have a key of their own; of the rest, all but the earliest of a key are repeats
    place = Window.partitionBy("known", "h1", "h2").orderBy("doc_id", "start")
    return found.withColumn("place", F.rank().over(place)).where("known or place > 1").select("doc_id", "start", "n")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    held = {c.lower() for c in taken}
    while name in held:
        name += "_"
    return name


def substring_dedup(
    docs: DataFrame, k: int = 20, gram: int = 8, most_cells: int = MOST_CELLS
) -> DataFrame:
    """``docs`` without repeated passages: ``text`` less the words dropped; adds n_words and n_removed.

    Other columns are kept, whatever their names; columns named n_words or n_removed are replaced.
    """
    lean_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    id_name, runs_name = free_name("sd_id", rest), free_name("sd_runs", rest)
    runs = repeats(docs, k, gram, most_cells).groupBy(F.col("doc_id").alias(id_name)).agg(
        F.collect_list(F.struct("start", "n")).alias(runs_name)
    )
    kept = docs.select(*("`" + c.replace("`", "``") + "`" for c in rest))
    joined = kept.join(runs, F.col("doc_id").cast("long") == F.col(id_name), "left").drop(id_name)
    text_at, runs_at = rest.index("text"), len(rest)
    schema = joined.drop(runs_name).schema.add("n_words", "long").add("n_removed", "long")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            raw, offsets = string_buffers(column)
            runs = batch.column(runs_at)
            texts, n_words, n_removed = [], [], []
            for lo, hi in slices(offsets, 1 << 20):
                part = offsets[lo : hi + 1]
                own = raw[part[0] : part[-1]]
                data = own.tobytes()
                first, end = word_bounds(own, part - part[0])
                at = np.searchsorted(first, part - part[0])
                for i in range(hi - lo):
                    n, begin, stop = int(at[i + 1] - at[i]), int(part[i] - part[0]), int(part[i + 1] - part[0])
                    found = runs[lo + i]
                    n_words.append(n)
                    if not column[lo + i].is_valid:
                        texts.append(None)
                        n_removed.append(0)
                        continue
                    if not found.is_valid:
                        texts.append(data[begin:stop])
                        n_removed.append(0)
                        continue
                    gone = np.zeros(n + 1, np.int64)
                    starts = found.values.field("start").to_numpy()
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.minimum(starts + found.values.field("n").to_numpy() + k - 1, n), -1)
                    cut = np.cumsum(gone[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~cut, [False]]).astype(np.int8)))
                    words = first[at[i] : at[i + 1]]
                    bounds = np.append(words, stop)
                    bounds[0] = begin if not cut[0] else bounds[0]
                    texts.append(b"".join(data[bounds[a] : bounds[b]] for a, b in edge.reshape(-1, 2)))
                    n_removed.append(int(cut.sum()))
            arrays = [batch.column(j) for j in range(len(rest))]
            arrays[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_words", "n_removed"])

    # by place: the names may hold dots
    return joined.toDF(*(f"c{i}" for i in range(len(joined.columns)))).mapInArrow(drop, schema)
