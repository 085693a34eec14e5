"""Exact Jaccard self-join of texts on word n-grams, by token-combination prefixes.

A text's set holds its distinct shingles of ``n`` words (a shorter text: its whole sequence). Two texts link when
den * |intersection| >= num * |union|; the result names for each text the smallest id that links lead to.

1. A count-min sketch over all texts gives each shingle a frequency that is never too low. It sets the order, rare
   first, and two classes: a rare shingle is a signature by itself; frequent ones are signatures in pairs. Frequencies
   are taken above the level that the sketch's cells share (their median), so that classes and order hold when texts
   outgrow it: that level then hides differences of up to some four of its square roots.
2. A set that may miss ``e`` of its shingles is cut to a prefix that no e misses can free of signatures: each rare
   shingle stands for one miss, and a group of m frequent shingles, paired among themselves, for m - 1. So the prefix
   is extended by one for each such group. Of two sets that link, the one whose prefix ends first keeps a signature
   whose shingles the other has too, and has in its prefix. Groups are numbered by size bands, and a set at the low end
   of a band signs for the band below as well, so that two sets of one link always meet in a band.
3. Sets that share a signature are compared by bitmaps whose differing bits bound the sets' difference from below, and
   what may link is verified on the whole texts. First only neighbours within a signature meet, a number linear in its
   members; what they link is merged. Then, for signatures that still hold several components, members of different
   components meet, in blocks. A block passes on two spanning forests of what may link, at most two pairs for each of its
   components; pairs that verify are merged, and while some do not, blocks go on without these, with eight times as many
   forests each time. So no link that could join two components is left out, and pairs grow linearly with a group of copies.

Equal sets are one node from the start, so groups of copies cost one row a task. A signature that very many sets share
is dealt to pieces by its estimate. Minima over a component are summed within tasks first, by the key and its hash, so that
joins on a hot key have plain shuffles on both sides, which Spark splits at run time. Helper tables are few, and their files
too: where the shared folder is a local one, Hadoop starts a process for every file and folder that it makes. Nothing but
sketches, of bounded size, is broadcast.

Cases: a null text, or one without words, has no shingles and is a component of its own; repeated rows and ties are
equal sets, and link; a null id stands for no document: its row stays, is never smallest, and names its component if it
has a document; very long texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from causeway.llm.common import U, WordHasher, dropped, lean_batches, mix, sketch_tasks, slices, string_buffers, text_bytes, written

#: Shingles with a lower estimate, above what the sketch's cells share, are rare: they sign alone.
RARE = 32
#: Sets that share a signature are dealt to pieces of about so many before neighbours meet.
PIECE_ROWS = 1 << 14
FIRST_BAND = 8
#: Bits of the bitmap that stands for a set before its text is looked at: a power of two, at least two for each shingle.
BITS = 512, 1 << 16
#: Rows of one signature that meet in one place.
BLOCK_ROWS = 4096
LAGS = tuple(1 << i for i in range(10))
BLOCK_CELLS = 1 << 20
MOST_CELLS = 1 << 25
#: Rows of a table of edges that go to one file, once there are more than one file a core.
FILE_ROWS = 1 << 20
BLOOM_BITS = 1 << 27
#: Names of sets that a counting task remembers, so that equal sets count once in it.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Rule:
    """n words a shingle; link when den * intersection >= num * union."""

    n: int = 5
    num: int = 80
    den: int = 100

    def links(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def largest_partner(self, size: int) -> int:
        return self.den * size // self.num

    def misses_as_larger(self, size: int) -> int:
        """Shingles that a set may miss when linked with one of at most its size."""
        return size - -(-self.num * size // self.den)

    def misses_as_smaller(self, size: int) -> int:
        return size - -(-2 * self.num * size // (self.num + self.den))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher, n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words, _, _, at = hasher(raw, offsets)
    for i in range(len(offsets) - 1):
        own = words[at[i] : at[i + 1]]
        yield np.unique(hasher.windows(own, min(n, len(own)))) if len(own) else own


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = np.add.reduce(mix(shingles), keepdims=True) + np.array([len(shingles)], U) * U(0x9E3779B97F4A7C15)
    return int(mix(total).view(np.int64)[0])


def bands(size: int, rule: Rule) -> list[tuple[int, int, bool]]:
    """(band, groups of frequent shingles, also as the smaller set) that a set of ``size`` signs for.

    Band 0 holds sets under FIRST_BAND shingles and pairs none of them: groups = 0.
    """
    own = 0 if size < FIRST_BAND else (size // FIRST_BAND).bit_length()
    out = [(own, groups_of(own, rule), True)]
    if own:
        top = FIRST_BAND * (1 << (own - 1)) - 1  # the largest set of the band below
        if size <= rule.largest_partner(top):
            out.append((own - 1, groups_of(own - 1, rule), False))
    return out


def groups_of(band: int, rule: Rule) -> int:
    """So many groups that, with all shingles frequent, a prefix has about six of each."""
    if band == 0:
        return 0
    return max(1, round((1 - rule.num / rule.den) * FIRST_BAND * (1 << (band - 1)) * 1.4 / 5))


def signatures(shingles: np.ndarray, often: np.ndarray, rule: Rule, rare_below: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, whether each is also one of the shorter prefix that serves as the smaller set, sets that may share it)."""
    size = len(shingles)
    level = np.zeros(size, np.int64)
    level[often > 0] = np.floor(np.log2(often[often > 0]))
    order = np.lexsort((shingles, level))
    tokens, often = shingles[order], often[order]
    rare = often < rare_below
    out, small, shared = [], [], []
    for band, groups, as_smaller in bands(size, rule):
        worth = np.ones(size, np.int64)
        single = rare.copy()
        if groups == 0:
            single[:] = True
        else:
            frequent = np.flatnonzero(~rare)
            group = (mix(tokens[frequent]) % U(groups)).astype(np.int64)
            _, head = np.unique(group, return_index=True)
            worth[frequent[head]] = 0  # the first of each group only opens it
        total = np.cumsum(worth)
        end = int(np.searchsorted(total, rule.misses_as_larger(size) + 1)) + 1
        short = int(np.searchsorted(total, rule.misses_as_smaller(size) + 1)) + 1 if as_smaller else 0
        salt = U((band + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        alone = np.flatnonzero(single[:end])
        out.append(mix(tokens[alone] ^ salt))
        small.append(alone < short)
        shared.append(often[alone])
        if groups:
            inside = frequent < end
            at, group = frequent[inside], group[inside]
            by = np.argsort(group, kind="stable")
            at, group = at[by], group[by]
            for lag in range(1, int(np.bincount(group).max(initial=0))):
                same = np.flatnonzero(group[lag:] == group[:-lag])
                a, b = at[same], at[same + lag]
                out.append(mix((mix(tokens[a]) + mix(tokens[b])) ^ salt ^ U(1)))
                small.append(np.maximum(a, b) < short)
                shared.append(np.minimum(often[a], often[b]))
    return np.concatenate(out), np.concatenate(small), np.concatenate(shared)


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit: two sets differ in at least as many shingles as bits."""
    bits = min(BITS[1], max(BITS[0], 1 << (2 * len(shingles) - 1).bit_length()))
    n = np.bincount((mix(shingles ^ U(0xA0761D6478BD642F)) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(n & 1).tobytes()


class Bitmaps:
    """Bitmaps of several lengths. Half as long, a bitmap is its halves' exclusive or; so two of neighbouring lengths compare."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        raw = column.to_pylist()
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.length, self.rows, self.at = length, {}, {}
        for n in np.unique(length).tolist():
            own, twice = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
            whole = np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), n // 8)
            longer = np.frombuffer(b"".join(raw[i] for i in twice), np.uint64).reshape(len(twice), 2, n // 8)
            self.rows[n] = np.concatenate([whole, longer[:, 0] ^ longer[:, 1]]) if len(twice) else whole
            self.at[n] = at = np.full(len(raw), -1)
            at[np.concatenate([own, twice])] = np.arange(len(own) + len(twice))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The differing bits of rows x and y, pair by pair; 0 (no bound) for lengths too far apart."""
        out = np.zeros(len(x), np.int64)
        short = np.minimum(self.length[x], self.length[y])
        for n in np.unique(short).tolist():
            pick = np.flatnonzero((short == n) & (self.at[n][x] >= 0) & (self.at[n][y] >= 0))
            for lo in range(0, len(pick), 1 << 14):
                p = pick[lo : lo + (1 << 14)]
                rows, at = self.rows[n], self.at[n]
                out[p] = np.bitwise_count(rows[at[x[p]]] ^ rows[at[y[p]]]).sum(1, dtype=np.int64)
        return out


def may_link(rule: Rule, apart: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether so few bits differ that sets of these sizes can link."""
    # apart <= |a| + |b| - 2 both, so both <= (|a| + |b| - apart) / 2
    total = size_a + size_b
    return (rule.den + rule.num) * (total - apart) >= 2 * rule.num * total


class Cells:
    """Count-min in two rows of 32-bit counters that stop at their end."""

    def __init__(self, data: np.ndarray, level: int = 0):
        self.data, self.bits, self.level = data, len(data).bit_length() - 1, level

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down, half = U(64 - self.bits + 1), np.int64(len(self.data) // 2)
        return (mix(keys) >> down).astype(np.int64), (mix(keys ^ U(0x5851F42D4C957F2D)) >> down).astype(np.int64) + half

    def add(self, keys: np.ndarray) -> None:
        for at in self.at(keys):
            at, n = np.unique(at, return_counts=True)
            self.data[at] = capped(self.data[at] + n)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs, at least, above the common level."""
        a, b = self.at(keys)
        return np.maximum(np.minimum(self.data[a], self.data[b]).astype(np.int64) - self.level, 0)

    def rare_below(self) -> int:
        return RARE + int(4 * self.level**0.5)


def capped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def cells_for(n_bytes: int) -> int:
    """A power of two of about a cell for each sixteen shingles, at 6 bytes a word."""
    return min(MOST_CELLS, max(1 << 14, 1 << int(n_bytes / 96).bit_length()))


def described(docs: DataFrame, rule: Rule, lower: bool, cells: int, tasks: int) -> DataFrame:
    """One pass over the texts. Rows of documents: doc_id, n_shingles, node, bits; rows of counts: block, bits."""
    block = min(BLOCK_CELLS, cells)
    names = ["doc_id", "n_shingles", "node", "block", "bits"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, seen = WordHasher(lower=lower), Cells(np.zeros(cells, np.uint32)), set()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(offsets):
                part, rows, new = offsets[lo : hi + 1], [], []
                for i, own in enumerate(shingle_sets(raw[part[0] : part[-1]], part - part[0], hasher, rule.n), lo):
                    if not len(own):
                        rows.append((ids[i], 0, None, None, None))
                        continue
                    node = node_of(own)
                    rows.append((ids[i], len(own), node, None, bitmap(own)))
                    if node not in seen:
                        seen.add(node)
                        new.append(own)
                if new:
                    counts.add(np.concatenate(new))
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for b in range(cells // block):
            part = counts.data[b * block : (b + 1) * block]
            if part.any():
                row = (None, None, None, b, zlib.compress(part.tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    return docs.coalesce(tasks).mapInArrow(describe, "doc_id long, n_shingles long, node long, block int, bits binary")


def broadcast_counts(rows: DataFrame, cells: int):
    """The tasks' counts merged block by block and broadcast with the median of their cells: 4 * ``cells`` bytes."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.int64)
        for batch in batches:
            for data in batch.column("bits"):
                total += np.frombuffer(zlib.decompress(data.as_buffer()), np.uint32)
        out = zlib.compress(capped(total).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["block", "bits"])

    data, block = np.zeros(cells, np.uint32), min(BLOCK_CELLS, cells)
    merged = rows.where("block is not null").select("block", "bits").groupBy("block").applyInArrow(merge, "block int, bits binary")
    for row in merged.toLocalIterator():
        data[row.block * block : (row.block + 1) * block] = np.frombuffer(zlib.decompress(row.bits), np.uint32)
    return rows.sparkSession.sparkContext.broadcast((data, int(np.median(data))))


#: A signature row's ``about`` holds its piece, its set's size, and whether it is of the shorter prefix.
PIECE_AT = 40


def signed(docs: DataFrame, rule: Rule, lower: bool, counts) -> DataFrame:
    """sig, node, about: the signatures of all texts; equal sets of a task once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch, seen = WordHasher(lower=lower), Cells(*counts.value), set()
        rare_below = sketch.rare_below()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part, out = offsets[lo : hi + 1], []
                for own in shingle_sets(raw[part[0] : part[-1]], part - part[0], hasher, rule.n):
                    if not len(own) or (node := node_of(own)) in seen:
                        continue
                    seen.add(node)
                    sig, small, shared = signatures(own, sketch.estimate(own), rule, rare_below)
                    pieces = shared // PIECE_ROWS  # the same for all sets of the signature, as it comes from the sketch
                    piece = np.where(pieces > 0, 1 + node % np.maximum(pieces + 1, 1), 0)
                    out.append((sig, np.full(len(sig), node), piece << PIECE_AT | len(own) << 1 | small))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if out:
                    sig, node, about = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(about)], names=["sig", "node", "about"])

    return docs.mapInArrow(sign, "sig long, node long, about long")


def neighbours(rows: DataFrame, rule: Rule) -> DataFrame:
    """From signature rows: members (b null) of signatures with two nodes at least, and pairs (a, b) of near members.

    Members are neighbours within a piece of their signature; those of a signature in pieces are all shown.
    """
    names = ["sig", "a", "size", "small", "b"]
    reach = LAGS[-1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()

        def emit(sig, node, about, fresh, last):
            """Rows from ``fresh`` on are new; without ``last`` the final one waits for its follower."""
            piece, size, small = about >> PIECE_AT, (about & (1 << PIECE_AT) - 1) >> 1, (about & 1).astype(bool)
            same = np.zeros(len(sig), bool)
            same[1:] = (sig[1:] == sig[:-1]) & (piece[1:] == piece[:-1])
            twin = np.zeros(len(sig), bool)  # equal sets met in two tasks
            twin[1:] = same[1:] & (node[1:] == node[:-1])
            many = same | (piece > 0)
            many[:-1] |= same[1:]
            show = np.flatnonzero(many & ~twin)
            show = show[(show >= fresh) & (show < len(sig) - (not last))]
            if len(show):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[show]), pa.array(node[show]), pa.array(size[show].astype(np.int32)), pa.array(small[show]), pa.nulls(len(show), pa.int64())], names=names
                )
            pairs = []
            for lag in LAGS:
                if lag >= len(sig):
                    break
                y = np.arange(max(lag, fresh), len(sig) - (not last))
                x = y - lag
                ok = (sig[x] == sig[y]) & (piece[x] == piece[y]) & (node[x] != node[y]) & small[x] & (rule.num * size[y] <= rule.den * size[x])
                pairs.append(np.stack([node[x[ok]], node[y[ok]]], 1))
            if pairs and len(p := np.unique(np.sort(np.concatenate(pairs), 1), axis=0)):
                p = [t for t in map(tuple, p.tolist()) if t not in sent]
                sent.update(p)
                if len(sent) > REMEMBERED:
                    sent.clear()
                if p:
                    a, b = zip(*p)
                    nulls = [pa.nulls(len(p), t) for t in (pa.int64(), pa.int32(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([nulls[0], pa.array(a, pa.int64()), *nulls[1:], pa.array(b, pa.int64())], names=names)

        held, fresh = None, 0
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            yield from emit(*held, fresh, False)
            keep = min(len(held[0]), reach + 1)
            held = [x[len(x) - keep :] for x in held]
            fresh = keep - 1
        if held is not None:
            yield from emit(*held, fresh, True)

    return (
        rows.repartition("sig", F.shiftright("about", PIECE_AT)).sortWithinPartitions("sig", "about", "node")
        .mapInArrow(near, "sig long, a long, size int, small boolean, b long")
    )


def texts_of(docs: DataFrame, nodes: DataFrame, rule: Rule, lower: bool, tasks: int) -> DataFrame:
    """node and text of the nodes asked for. A bounded Bloom filter keeps most other texts from being shuffled."""
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (nodes.count() * 16).bit_length()))
    block = min(bits, 1 << 20)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[(mix(batch.column(0).to_numpy().view(U)) % U(bits)).astype(np.int64)] = True
        for b in range(bits // block):
            part = own[b * block : (b + 1) * block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["block", "bits"])

    def merge(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block // 8, np.uint8)
        for batch in rows:
            for data in batch.column("bits"):
                total |= np.frombuffer(data.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "bits"])

    schema, filled = "block int, bits binary", np.zeros(bits // 8, np.uint8)
    marked = nodes.select("node").coalesce(tasks).mapInArrow(mark, schema).groupBy("block").applyInArrow(merge, schema)
    for row in marked.toLocalIterator():
        filled[row.block * block // 8 : (row.block + 1) * block // 8] = np.frombuffer(row.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(lower=lower), set()
        for batch in batches:
            column = batch.column(1)
            raw, offsets = string_buffers(column)
            for lo, hi in slices(offsets):
                part, keep, found = offsets[lo : hi + 1], [], []
                for i, own in enumerate(shingle_sets(raw[part[0] : part[-1]], part - part[0], hasher, rule.n), lo):
                    if not len(own) or (node := node_of(own)) in seen:
                        continue
                    bit = int(mix(np.array([node]).view(U))[0] % U(bits))
                    if held.value[bit >> 3] >> (7 - (bit & 7)) & 1:
                        seen.add(node)
                        keep.append(i)
                        found.append(node)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), column.take(pa.array(keep))], names=["node", "text"])

    named = docs.mapInArrow(name, "node long, text string")
    return named.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule, lower: bool) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=lower)
        for batch in batches:
            keep = []
            raws = [string_buffers(batch.column(i)) for i in (2, 3)]
            for i in range(len(batch)):
                x, y = (next(shingle_sets(raw[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]]), hasher, rule.n)) for raw, o in raws)
                if rule.links(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y)):
                    keep.append(i)
            if keep:
                yield batch.select([0, 1]).take(pa.array(keep))

    return both.mapInArrow(links, "a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """As many edges (u, v), u > v, as each task needs to hold together what its own rows link."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def out() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
            u, v = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > REMEMBERED:
                yield out()
                up.clear()
        yield out()

    return edges.mapInArrow(join, "u long, v long")


def by_key(rows: DataFrame, key: str, *sums: Column) -> DataFrame:
    """``rows`` summed by ``key``, to be joined by it: dealt by its hash as well, so that the join deals the sums anew.

    Sums that lie where the join wants them would be no plain shuffle, and Spark would not split the other side's hot keys.
    """
    return rows.groupBy(key, F.xxhash64(key).alias("dealt_by")).agg(*sums).drop("dealt_by")


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's least node) for all nodes with links (a, b), but for the roots themselves.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to the
    least among them. Both sides of the joins with that least are plain shuffles, which Spark splits where a node has very
    many neighbours.
    """
    cores = links.sparkSession.sparkContext.defaultParallelism

    def with_least(rows: DataFrame) -> DataFrame:
        return rows.join(by_key(rows, "u", F.min("v").alias("m")), "u")

    edges, before = written(forest(links.select("a", "b")), "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, files = now, max(cores, now[0] // FILE_ROWS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large.coalesce(files), "large")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = with_least(large).select(ends).select("e.u", "e.v").where("u <> v").distinct()
        after = written(after.coalesce(files), "edges")
        dropped(edges, large)
        edges = after


def bound_pairs(pairs: DataFrame, info: DataFrame, rule: Rule) -> DataFrame:
    """a, b and apart of the pairs whose bitmaps let them link."""
    left = info.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("n_shingles").alias("size_a"))
    right = info.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("n_shingles").alias("size_b"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = np.arange(len(batch))
            bits = Bitmaps(pa.chunked_array([batch.column("bits_a"), batch.column("bits_b")]))
            apart = bits.apart(n, n + len(batch))
            keep = pa.array(may_link(rule, apart, batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(apart).filter(keep)], names=["a", "b", "apart"]
            )

    return pairs.join(left, "a").join(right, "b").mapInArrow(bound, "a long, b long, apart long")


def dealt_members(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` with own, i, j: each signature's rows dealt so that all its pairs meet in its ``blocks`` of bounded size."""
    met = members.join(blocks, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


BLOCK = ["sig", "i", "j"]


def crossing(dealt: DataFrame, roots: DataFrame, info: DataFrame, failed: DataFrame | None, rule: Rule, forests: int) -> DataFrame:
    """sig, i, j, a, b: pairs of a block (sig, i, j) that are of different components, and may link by their bitmaps.

    A block passes on what ``forests`` spanning forests of its components need, each as if all pairs before were links:
    while fewer than that many of its pairs hold two components together, another goes on. ``failed`` pairs are left out.
    """
    rooted = dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    columns = [*BLOCK, "own", "node", "root", "size", "small", "bits"]
    met = rooted.join(info.select("node", "bits"), "node").select(*columns, F.lit(None).cast("long").alias("b"))
    if failed is not None:
        void = {"own": "int", "root": "long", "small": "boolean", "bits": "binary"}
        out = failed.withColumnRenamed("a", "node").withColumns({c: F.lit(None).cast(k) for c, k in void.items()})
        met = met.unionByName(out.withColumn("size", F.lit(-1)).select(*columns, "b"))  # size -1: before the members

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def find(up: dict[int, int], x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
            void = pc.is_valid(t.column("b"))
            known = t.filter(void)
            known = set(zip(known.column("node").to_pylist(), known.column("b").to_pylist()))
            t = t.filter(pc.invert(void))
            if not len(t):
                return
            sig, i, j, own, node, root, size, small = (t.column(c).to_numpy() for c in (*BLOCK, "own", "node", "root", "size", "small"))
            bits, size = Bitmaps(t.column("bits")), size.astype(np.int64)
            new = np.ones(len(t), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.cumsum(new)
            # a label for each component of each block; ups: the forests by label, joined: what the last one holds together
            order = np.lexsort((root, group))
            head = np.ones(len(t), bool)
            head[1:] = (root[order][1:] != root[order][:-1]) | (group[order][1:] != group[order][:-1])
            label = np.empty(len(t), np.int64)
            label[order] = np.cumsum(head) - 1
            ups: list[dict[int, int]] = [{} for _ in range(forests)]
            joined = np.arange(int(head.sum()))
            out, lag, x = [], 0, np.arange(len(t))
            while True:
                lag += 1
                x = x[x + lag < len(t)]
                x = x[group[x + lag] == group[x]]
                if not len(x):
                    break
                y = x + lag
                ok = small[x] & (joined[label[x]] != joined[label[y]]) & (rule.num * size[y] <= rule.den * size[x])
                ok &= (i[x] == j[x]) | (own[x] != own[y])
                p, q = x[ok], y[ok]
                if not len(p):
                    continue
                ok = may_link(rule, bits.apart(p, q), size[p], size[q])
                for p, q in zip(p[ok].tolist(), q[ok].tolist()):
                    a, b = sorted((int(node[p]), int(node[q])))
                    if (a, b) in known:
                        continue
                    for k, up in enumerate(ups):
                        m, n = sorted((find(up, int(label[p])), find(up, int(label[q]))))
                        if m != n:
                            up[n] = m
                            if k == forests - 1:
                                joined[joined == n] = m
                            out.append((int(sig[p]), int(i[p]), int(j[p]), a, b))
                            break
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*BLOCK, "a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            # all but the last group are whole; that one has at most two blocks of rows
            keys = [held.column(c).to_numpy() for c in BLOCK]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if len(held) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from meet(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from meet(held)

    return (
        met.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "size", "node")
        .mapInArrow(pairs, "sig long, i int, j int, a long, b long")
    )


def all_linked(members: DataFrame, links: DataFrame, info: DataFrame, texts: DataFrame, rule: Rule, lower: bool) -> DataFrame:
    """The components of ``links`` and of all further links between ``members`` of a signature."""
    roots, failed, forests = components(links), None, 2
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    # what a signature of very many sets is joined to is written first, so that Spark can split it
    mixed = written(mixed, "mixed")
    left = members.join(mixed, "sig", "left_semi")
    blocks = by_key(left, "sig", F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = written(dealt_members(left, blocks), "dealt")
    dropped(mixed)
    while True:
        met = written(crossing(dealt, roots, info, failed, rule, forests), "crossing")
        if met.isEmpty():
            return roots
        new = written(verified(met.select("a", "b").distinct(), texts, rule, lower), "links")
        wrong = written(met.join(new, ["a", "b"], "left_anti"), "failed")
        if not new.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
        dropped(met, new)
        if wrong.isEmpty():
            return roots
        # a block all of whose pairs are links is done: they hold together all that may link in it
        failed = wrong if failed is None else failed.unionByName(wrong)
        left = wrong.select(*BLOCK).distinct()
        dealt, before = written(dealt.join(left, BLOCK, "left_semi"), "dealt"), dealt
        failed = failed.join(left, BLOCK, "left_semi")
        dropped(before)
        forests *= 8


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), lower: bool = True) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; ``lower`` folds A-Z."""
    spark = docs.sparkSession
    lean_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = text_bytes(docs)
    cells, tasks = cells_for(n_bytes), sketch_tasks(spark, n_bytes)
    rows = written(described(docs, rule, lower, cells, tasks), "described")
    owners = rows.where("block is null").select("doc_id", "n_shingles", "node", "bits")
    counts = broadcast_counts(rows, cells)
    near = written(neighbours(signed(docs, rule, lower, counts), rule), "near")
    counts.unpersist()
    members = near.where("b is null").select("sig", F.col("a").alias("node"), "size", "small")
    nodes = written(members.select("node").distinct(), "nodes")
    info = owners.where("node is not null").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    info = written(info.select("node", "n_shingles", "bits"), "info")
    texts = written(texts_of(docs, nodes, rule, lower, tasks), "texts")

    # of each set's near ones the closest is verified first; what is left meets again below
    bounded = bound_pairs(near.where("b is not null").select("a", "b").distinct(), info, rule)
    closest = bounded.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    links = written(verified(closest, texts, rule, lower), "links")
    roots = all_linked(members, links, info, texts, rule, lower)
    dropped(texts, info, nodes, near)

    # the least id of each set, then of each component; both are summed within tasks first, and so that Spark can split
    # what a hot key is joined to
    first = written(owners.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id")), "first")
    linked = first.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node")
    named = linked.join(by_key(linked, "root", F.min("first_id").alias("least_id")), "root").select("node", "least_id")
    own = written(first.join(named, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("component")), "own")
    dropped(first)
    return owners.join(own, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
