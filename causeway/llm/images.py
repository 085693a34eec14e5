"""Cropped or edited copies among images, by local descriptors.

1. Corners are found on several scales, the strongest ``most_corners`` of each. A patch gets an orientation from its
   intensity centroid and 256 binary tests turned by it: 256 bits that light and contrast do not change.
2. Descriptors are cut into 8 parts of 32 bits. Two that differ in at most 7 bits have a part in common, so tables keyed by
   (part, value) meet every such pair. Values that a count-min sketch knows to occur once stay out. A table row carries its
   descriptor folded to 64 bits, halves upon halves by exclusive or: folded, two differ in no more bits than in full, so
   pairs that differ too much go at once; those left are counted in full.
3. Each matched pair of corners proposes a rotation, scale and shift. Two images are copies when ``least`` matches or more
   agree on one, in bins that overlap.

Equal images are one node from the start. A value that very many corners share is dealt to blocks, by a second sketch's
estimate of its count, and blocks meet two by two, so no task holds a whole popular value. All links are found, for
n_links counts them: what is passed on grows with the links, quadratic in a class of edits of one picture.

Images are binary columns in a netpbm format (P5 grey, P6 colour). Cases: null, empty or unreadable images, and images
without corners, are copies of nothing but images with equal bytes (null ones: of nothing); repeated rows are equal
images; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causeway.llm.common import U, dropped, mix, sketch_tasks, written
from causeway.llm.jaccard import Cells, capped, components
from causeway.llm.substring import BLOCK_CELLS, MOST_CELLS, Sketch

RADIUS = 9
TURNS = 32
LEVELS = (1.0, 0.7)
#: Rows of one table value that meet in one place.
BLOCK_ROWS = 2048
#: Counters of the sketch that tells popular values apart.
COUNTERS = 1 << 20
#: Images of one Arrow batch.
BATCH_IMAGES = 64
BITS = ["b0", "b1", "b2", "b3"]
FEATURES = "node long, corner int, x float, y float, scale float, angle float, b0 long, b1 long, b2 long, b3 long"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a P5 or P6 image; None for anything else."""
    head = re.match(rb"(P[56])\s+(?:#.*\n)?(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head or int(head[4]) > 255:
        return None
    w, h, depth = int(head[2]), int(head[3]), 1 if head[1] == b"P5" else 3
    body = np.frombuffer(data, np.uint8, offset=head.end())
    if not w * h or len(body) < w * h * depth:
        return None
    return body[: w * h * depth].reshape(h, w, depth).mean(2).astype(np.float32)


def encode(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, edges repeated."""
    p = np.pad(a, r + 1, mode="edge")[:, :]
    s = p.cumsum(0).cumsum(1)
    n = 2 * r + 1
    return s[n:-1, n:-1] - s[: -n - 1, n:-1] - s[n:-1, : -n - 1] + s[: -n - 1, : -n - 1]


def resize(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    if scale == 1:
        return a
    h, w = max(1, int(a.shape[0] * scale)), max(1, int(a.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def corners(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the strongest corners, far enough from the edge for a patch."""
    edge = RADIUS + 2
    if min(a.shape) <= 2 * edge:
        return np.empty(0, int), np.empty(0, int)
    gy, gx = np.gradient(a)
    xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 2, constant_values=-np.inf), (5, 5)).max((2, 3))
    peak = (strength == around) & (strength > 1)
    peak[:edge] = peak[-edge:] = False
    peak[:, :edge] = peak[:, -edge:] = False
    r, c = np.nonzero(peak)
    best = np.lexsort((c, r, -strength[r, c]))[:most]
    return r[best], c[best]


def _tests() -> np.ndarray:
    """For each turn, 256 pairs of offsets within the patch, turned: (turns, 256, 2, 2) of (row, column)."""
    rng = np.random.default_rng(11)
    base = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS + 2, RADIUS - 2)
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], 1), np.stack([-np.sin(a), np.cos(a)], 1)], 1)
    return np.clip(np.rint(np.einsum("tij,kpj->tkpi", turn, base)), -RADIUS, RADIUS).astype(int)


TESTS = _tests()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID**2).sum(0) <= RADIUS**2


def describe(grey: np.ndarray, most: int = 40) -> tuple[np.ndarray, ...]:
    """(x, y, scale, angle, bits) of the corners of all levels; x and y on the full scale."""
    out = []
    for scale in LEVELS:
        a = resize(grey, scale)
        r, c = corners(a, most)
        if not len(r):
            continue
        smooth = box(a, 1)
        patch = np.lib.stride_tricks.sliding_window_view(a, (2 * RADIUS + 1, 2 * RADIUS + 1))[r - RADIUS, c - RADIUS] * _DISC
        angle = np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        t = TESTS[turn]
        value = smooth[r[:, None, None] + t[..., 0], c[:, None, None] + t[..., 1]]
        bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
        out.append(((c + 0.5) / scale, (r + 0.5) / scale, np.full(len(r), 1 / scale), angle, bits))
    if not out:
        return (np.empty(0),) * 4 + (np.empty((0, 32), np.uint8),)
    return tuple(np.concatenate(x) for x in zip(*out))


def features(images: DataFrame, most: int) -> DataFrame:
    """The described corners of (node, image) rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                grey = decode(data.as_py())
                if grey is None:
                    continue
                x, y, scale, angle, bits = describe(grey, most)
                if len(x):
                    columns = [pa.array(np.full(len(x), node)), pa.array(np.arange(len(x), dtype=np.int32))]
                    columns += [pa.array(v.astype(np.float32)) for v in (x, y, scale, angle)]
                    columns += [pa.array(v) for v in np.ascontiguousarray(bits).view(np.int64).T.copy()]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "corner", "x", "y", "scale", "angle", *BITS])

    return images.mapInArrow(find, FEATURES)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``keys``."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        columns = [held.column(c).to_numpy() for c in keys]
        change = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0)) if len(held) else []
        if len(change):
            yield held.slice(0, int(change[-1]) + 1)
            held = held.slice(int(change[-1]) + 1)
    if held is not None and len(held):
        yield held


def part_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the 64-bit keys of its eight (part, value), and its folded bits."""
    bits = np.stack([batch.column(c).to_numpy() for c in BITS], 1).view(U)
    parts = np.ascontiguousarray(bits).view(np.uint32).astype(U)  # eight of each row
    return mix(parts + (np.arange(8, dtype=U) << U(32))), np.bitwise_xor.reduce(bits, 1)


def table_rows(found: DataFrame, n: int) -> DataFrame:
    """key, blocks, node, corner, fold of descriptor parts whose value is estimated to occur twice among ``n`` corners.

    Most values occur once and meet nothing. A count-min sketch over all of them, which only overestimates, keeps these
    out of the shuffle; it grows with the corners up to ``MOST_CELLS`` and is broadcast as bits. A second one, of few
    counters, tells how many blocks a popular value needs: what it says above the level that all counters share.
    """
    spark = found.sparkSession
    cells = min(MOST_CELLS, max(1 << 16, 1 << (n * 32).bit_length()))
    block = min(BLOCK_CELLS, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, counts = Sketch(cells), Cells(np.zeros(COUNTERS, np.uint32))
        for batch in batches:
            if len(batch):
                keys = part_keys(batch)[0].ravel()
                sketch.add(keys)
                counts.add(keys)
        out = [(-1, zlib.compress(counts.data.tobytes(), 1))] if counts.data.any() else []
        for b in range(cells // block):
            once, more = (x[b * block // 8 : (b + 1) * block // 8] for x in (sketch.once, sketch.more))
            if once.any():
                out.append((b, zlib.compress(once.tobytes() + more.tobytes(), 1)))
        for b, data in out:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], names=["block", "cells"])

    def merge(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, total = np.zeros(block // 8, np.uint8), np.zeros(block // 8, np.uint8), np.zeros(COUNTERS, np.int64)
        counters = key[0].as_py() < 0
        for batch in rows:
            for data in batch.column("cells"):
                data = zlib.decompress(data.as_buffer())
                if counters:
                    total += np.frombuffer(data, np.uint32)
                    continue
                new_once, new_more = np.frombuffer(data, np.uint8).reshape(2, -1)
                more |= new_more | once & new_once
                once |= new_once
        out = zlib.compress((capped(total) if counters else more).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "cells"])

    schema, more, counters = "block int, cells binary", np.zeros(cells // 8, np.uint8), np.zeros(COUNTERS, np.uint32)
    merged = found.select(*BITS).coalesce(sketch_tasks(spark, n * 64)).mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema)
    for row in merged.toLocalIterator():
        data = zlib.decompress(row.cells)
        if row.block < 0:
            counters[:] = np.frombuffer(data, np.uint32)
        else:
            more[row.block * block // 8 : (row.block + 1) * block // 8] = np.frombuffer(data, np.uint8)
    held = spark.sparkContext.broadcast((more, counters, int(np.median(counters))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more, counters, level = held.value
        sketch, counts = Sketch(cells, more, more), Cells(counters, level)
        for batch in batches:
            if not len(batch):
                continue
            keys, fold = part_keys(batch)
            row, part = np.nonzero(sketch.repeated(keys.ravel()).reshape(keys.shape))
            keys, take = keys[row, part], pa.array(row)
            blocks = 1 + counts.estimate(keys) // BLOCK_ROWS
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(blocks.astype(np.int32)), batch.column("node").take(take), batch.column("corner").take(take), pa.array(fold[row].view(np.int64))],
                names=["key", "blocks", "node", "corner", "fold"],
            )

    return found.select("node", "corner", *BITS).mapInArrow(keep, "key long, blocks int, node long, corner int, fold long")


PAIRS = "a long, ca int, b long, cb int"


def matches(rows: DataFrame, reach: int) -> DataFrame:
    """Pairs of corners (a, ca, b, cb) of images a < b that share a table value and, folded, differ in at most ``reach`` bits."""
    own = F.pmod(F.xxhash64("node", "corner"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "corner", "fold")
    keys = ["key", "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            column = {c: t.column(c).to_numpy() for c in (*keys, "own", "node", "corner", "fold")}
            new = np.ones(len(t), bool)
            new[1:] = np.any([column[c][1:] != column[c][:-1] for c in keys], axis=0)
            group, lag, x = np.cumsum(new), 0, np.arange(len(t))
            while True:
                lag += 1
                x = x[x + lag < len(t)]
                x = x[group[x + lag] == group[x]]
                if not len(x):
                    break
                y = x + lag
                ok = (column["node"][x] != column["node"][y]) & (np.bitwise_count(column["fold"][x] ^ column["fold"][y]) <= reach)
                ok &= (column["i"][x] == column["j"][x]) | (column["own"][x] != column["own"][y])
                p, q = x[ok], y[ok]  # rows are sorted by node
                if len(p):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column["node"][p]), pa.array(column["corner"][p]), pa.array(column["node"][q]), pa.array(column["corner"][q])], names=["a", "ca", "b", "cb"]
                    )

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node", "corner").mapInArrow(meet, PAIRS).distinct()


def consensus(pairs: DataFrame, found: DataFrame, reach: int, least: int) -> DataFrame:
    """The image pairs (a, b) of which ``least`` corners match in full and agree on rotation, scale and shift."""
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    found = found.join(met, "node", "left_semi")
    side = lambda k: found.select(
        F.col("node").alias(k), F.col("corner").alias(f"c{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("x", "y", "scale", "angle", *BITS))
    )
    m = pairs.join(side("a"), ["a", "ca"]).join(side("b"), ["b", "cb"])
    apart = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS]
    m = m.where(sum(apart[1:], apart[0]) <= reach)
    zoom = F.col("scale_b") / F.col("scale_a")
    turn = F.col("angle_b") - F.col("angle_a")
    cos, sin = F.cos(turn) * zoom, F.sin(turn) * zoom
    m = m.select(
        "a", "b", "ca", "cb",
        F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("half"),
        (F.col("x_b") - (cos * F.col("x_a") - sin * F.col("y_a"))).alias("dx"),
        (F.col("y_b") - (sin * F.col("x_a") + cos * F.col("y_a"))).alias("dy"),
        F.round(F.log2(zoom) * 2).alias("zoom"),
        F.pmod(F.round(turn / (3.141592653589793 / 8)), F.lit(16.0)).alias("turn"),
    )
    cell = lambda d: F.floor(F.col(d) / 12 + F.col("half"))
    votes = m.groupBy("a", "b", "half", "zoom", "turn", cell("dx").alias("ix"), cell("dy").alias("iy")).agg(
        F.countDistinct("ca").alias("n_a"), F.countDistinct("cb").alias("n_b")
    )
    return votes.where((F.col("n_a") >= least) & (F.col("n_b") >= least)).select("a", "b").distinct()


def find_copies(images: DataFrame, most_corners: int = 40, reach: int = 7, least: int = 5) -> DataFrame:
    """image_id, n_links (images of other bytes found to be copies of it directly) and copy_id (the least id of its class).

    ``images``: image_id long, image binary.
    """
    spark = images.sparkSession
    node = F.when(F.col("image").isNotNull(), F.xxhash64(F.sha2("image", 256)))
    images = images.select(F.col("image_id").cast("long").alias("image_id"), "image").withColumn("node", node)
    owners = written(images.select("image_id", "node"), "owners")
    first = owners.where("node is not null").groupBy("node").agg(F.min("image_id").alias("first_id"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(BATCH_IMAGES))  # pictures are long rows
    chosen = images.join(first, (images["node"] == first["node"]) & images["image_id"].eqNullSafe(first["first_id"]), "left_semi")
    found = written(features(chosen.select("node", "image"), most_corners), "features")
    spark.conf.set(key, before)
    pairs = written(matches(table_rows(found, found.count()), reach), "pairs")
    links = written(consensus(pairs, found, reach, least), "links")
    dropped(pairs, found)
    roots = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    # the least id of each node, then of each class; both are summed within tasks first
    linked = first.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("node", "least_id")
    known = first.join(named, "node", "left").join(degree, "node", "left")
    known = known.select("node", F.coalesce("least_id", "first_id").alias("copy"), "n_links")
    return owners.join(known, "node", "left").select(
        "image_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy", "image_id").alias("copy_id")
    )


def rendered(vectors: DataFrame, side: int = 96, cell: int = 4) -> DataFrame:
    """Pictures of the vectors, as the given tables hold none: a mosaic whose cells are drawn from the vector's values.

    image_id is 4 * vec_id; a vector whose id leaves 3 on division by 10 also gets edited copies at 4 * vec_id + 1 (cropped,
    darker) and + 2 (framed, with more contrast).
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None:
                    continue
                values = np.nan_to_num(np.array([x or 0.0 for x in v], np.float64))
                n = side // cell
                rng = np.random.default_rng(values.view(np.uint64) % (1 << 32) if len(values) else 0)
                strength = np.resize(np.abs(values) / (np.abs(values).max(initial=0) + 1e-9), n * n).reshape(n, n)
                mosaic = 128 + np.where(rng.random((n, n)) < 0.5, -1, 1) * (30 + 60 * strength)
                grey = np.kron(mosaic, np.ones((cell, cell)))
                ids.append(4 * i)
                out.append(encode(grey))
                if i % 10 == 3:
                    ids += [4 * i + 1, 4 * i + 2]
                    out.append(encode(grey[10:, 6 : side - 5] * 0.8))
                    out.append(encode(np.pad(128 + (grey - 128) * 1.2, 8, constant_values=40)))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(draw, "image_id long, image binary")
