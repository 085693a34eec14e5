"""Target-distribution importance resampling over hashed word n-grams, read by an Aho-Corasick automaton.

Words are runs of a-z, digits and all that is not ASCII, after A-Z is lower-cased; features are the runs of 1 to ``longest``
words joined by one space, each in the bucket that the CRC-32 of its bytes gives. A bucket's gain says how much commoner it is
in the target than in the documents; a document's weight is the sum of its features' gains. The share with the greatest weight
plus Gumbel noise (drawn from a digest of the id) is a sample without replacement, weighted towards the target.

1. The words of all documents are counted, and the ``most_words`` commonest of at most LONGEST_ENTRY bytes make the dictionary
   (ties by their letters). It is bounded: some 3 MB are sent to the executors, each of whose workers builds one automaton.
2. An entry is a word with a space before and after, and carries the CRC-32 and the length of the word. Texts, with each
   delimiter turned into a space, run through the automaton, which emits the payloads. Words that are not in the dictionary are
   the ends of words at which nothing was emitted: their payloads are computed from their bytes, so the dictionary decides
   about speed only.
3. Payloads of adjacent words compose: the CRC of a feature is that of its head, moved on by the length of its last word and
   the space, xor that of the space and the last word. No feature is ever spelled out.
4. One pass adds up counts by bucket, within tasks first; a second one sums gains by document. Only ids and numbers are sorted.

Cases: null texts have no words; texts without words have weight 0; a null id takes part with the digest of "seed:" alone and
comes last among ties; repeated rows are scored, ranked and drawn each; an empty table gives no rows, an empty target gains
as the formula says; very long texts are read whole; other columns are kept whatever their names, but for those that are added.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.llm.common import lean_batches, numbered, slices, string_buffers, written

#: Bytes a word consists of, A-Z lower-cased; all others become spaces.
_BYTES = np.full(256, 0x20, np.uint8)
for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BYTES[lo:hi] = np.arange(lo, hi)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD = _BYTES.tobytes()

LONGEST_ENTRY = 64
SPACE = zlib.crc32(b" ")
#: Words that a task counts before it sends the counts on.
COUNTED = 300_000


def crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 register, by the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


class Shift:
    """Moves CRCs on by a number of zero bytes: a linear map, held as one table for each of a CRC's four bytes."""

    def __init__(self, short: int = LONGEST_ENTRY + 1, bits: int = 32):
        self.table = crc_table()
        basis = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.short = np.empty((short + 1, 4, 256), np.uint32)
        for n in range(short + 1):
            self.short[n] = basis
            basis = (basis >> np.uint32(8)) ^ self.table[basis & np.uint32(255)]
        self.doubled = [self.short[1]]
        for _ in range(bits - 1):
            last = self.doubled[-1]
            self.doubled.append(self.apply(last[None], np.zeros(last.size, np.int64), last.ravel()).reshape(last.shape))

    @staticmethod
    def apply(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(crc), np.uint32)
        for k in range(4):
            out ^= tables[which, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC moved on by n bytes."""
        is_short = n < len(self.short)
        out = self.apply(self.short, np.where(is_short, n, 0), crc)
        long = np.flatnonzero(~is_short)
        if len(long):
            value, left = crc[long], n[long]
            for bit, table in enumerate(self.doubled):
                on = np.flatnonzero(left >> bit & 1)
                if len(on):
                    value[on] = self.apply(table[None], np.zeros(len(on), np.int64), value[on])
            out[long] = value
        return out


class Reader:
    """Buckets of the features of many texts at once."""

    def __init__(self, words: list[bytes], buckets: int, longest: int):
        self.buckets, self.longest, self.shift = buckets, longest, Shift()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: CRC-32 of each entry; the automaton hands out 31 bits, so that an entry carries its place here
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        for i, w in enumerate(words):
            # one character stands for one byte
            self.automaton.add_word(f" {w.decode('latin-1')} ", i << 7 | len(w))
        if words:
            self.automaton.make_automaton()

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, CRC, length) of each word of a folded text that begins and ends with a space."""
        raw = np.frombuffer(text, np.uint8)
        inside = raw != 0x20
        first, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        payload = np.full(len(end), -1, np.int64)
        if len(self.automaton):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            # an entry ends with the space after its word, in the same order as the words do
            payload[np.searchsorted(end, found[:, 0])] = found[:, 1]
        known = payload >= 0
        crc, size = np.zeros(len(end), np.uint32), payload & 127
        crc[known] = self.crc[payload[known] >> 7]
        for i in np.flatnonzero(~known):
            word = text[first[i] : end[i]]
            crc[i], size[i] = zlib.crc32(word), len(word)
        return end, crc, size

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(words before each text, and after the last; for 1 to ``longest`` words, the bucket of the feature ending at each word, or -1)."""
        end, crc, size = self.payloads(b" " + b" ".join(texts) + b" ")
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        offsets = np.searchsorted(end, bounds)
        own = np.arange(len(end)) - np.repeat(offsets[:-1], np.diff(offsets))  # words before it in its text
        spaced = self.shift(np.full(len(crc), SPACE, np.uint32), size) ^ crc
        out, head = [(crc % np.uint32(self.buckets)).astype(np.int64)], crc
        for n in range(2, self.longest + 1):
            head = np.append(np.uint32(0), self.shift(head[:-1], size[1:] + 1) ^ spaced[1:])[: len(crc)]
            out.append(np.where(own >= n - 1, (head % np.uint32(self.buckets)).astype(np.int64), -1))
        return offsets, out


#: The reader of a Python worker, kept from task to task: building an automaton takes longer than a small task.
_HELD: dict[tuple, Reader] = {}


def reader(words: list[bytes], buckets: int, longest: int) -> Reader:
    key = (zlib.crc32(b" ".join(words)), len(words), buckets, longest)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Reader(words, buckets, longest)
    return _HELD[key]


def folded(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of some 1 MB with their texts, A-Z lower-cased and delimiters turned into spaces."""
    for batch in batches:
        raw, offsets = string_buffers(batch.column(at))
        for lo, hi in slices(offsets, 1 << 20):
            data, start = raw[offsets[lo] : offsets[hi]].tobytes().translate(FOLD), offsets[lo]
            yield batch.slice(lo, hi - lo), [data[a - start : b - start] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]


def dictionary(docs: DataFrame, most_words: int) -> list[bytes]:
    """The commonest words of ``docs`` (text), at most ``most_words`` of at most LONGEST_ENTRY bytes, ties by their bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            some = {w: n for w, n in counts.items() if len(w) <= LONGEST_ENTRY}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(some.keys(), pa.binary()), pa.array(some.values(), pa.int64())], names=["word", "n"])

        for _, texts in folded(batches, 0):
            for t in texts:
                counts.update(t.split())
            if len(counts) > COUNTED:
                yield send()
        yield send()

    words = docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # a top-k would send each part's candidates to the driver; ranks send the chosen ones only
    first = numbered(words, [F.desc("n"), F.col("word")], "rank").where(F.col("rank") <= most_words)
    return [bytes(r.word) for r in sorted(first.collect(), key=lambda r: r["rank"])]


def bucket_counts(docs: DataFrame, words, buckets: int, longest: int) -> DataFrame:
    """bucket, n: the features of all texts of ``docs`` (text) by bucket; tasks add up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = reader(words.value, buckets, longest), np.zeros(buckets, np.int64)
        for _, texts in folded(batches, 0):
            for found in own(texts)[1]:
                total += np.bincount(found[found >= 0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, words, buckets: int, longest: int) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket: ``buckets`` numbers at the driver."""
    found = np.zeros((2, buckets), np.int64)
    for k, side in enumerate((docs, target)):
        for r in bucket_counts(side, words, buckets, longest).collect():
            found[k, r.bucket] = r.n
    (s, t), (own, wanted) = found.astype(float), found.sum(1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (own + buckets) / ((s + 1) * (wanted + buckets)))).astype(np.int64)


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, id: str = "doc_id", text: str = "text", least_words: int = 20,
    buckets: int = 10_000, longest: int = 3, seed: int = 42, most_words: int = 50_000,
) -> DataFrame:
    """``docs``, less its text, with n_words, n_features, weight, score and rank (from 1; null if not drawn).

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn. ``target`` has the same text column.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    words = spark.sparkContext.broadcast(dictionary(docs.select(F.col(f"`{text}`")), most_words))
    gain = spark.sparkContext.broadcast(gains(docs.select(F.col(f"`{text}`")), target.select(F.col(f"`{text}`")), words, buckets, longest))
    added = ("n_words", "n_features", "weight", "score", "rank")
    rest = [c for c in docs.columns if c not in (text, *added)]
    held = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    names = [*held.columns[1:], "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value = reader(words.value, buckets, longest), np.append(gain.value, 0)  # the last one is that of bucket -1
        for rows, texts in folded(batches, 0):
            offsets, found = own(texts)
            total = np.append(0, np.cumsum(sum(value[b] for b in found)))
            n = np.diff(offsets)
            features = sum(np.maximum(n - k, 0) for k in range(longest))
            more = [pa.array(x.astype(np.int64)) for x in (n, features, total[offsets[1:]] - total[offsets[:-1]])]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], *more], names=names)

    schema = T.StructType([*held.schema.fields[1:], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    own_id = F.col(f"c{rest.index(id)}")
    scored = held.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise(own_id, seed))
    scored = written(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last(own_id)], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.union(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *added)


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns, by their ids; options as of ``importance_resample``."""
    id = how.get("id", "doc_id")
    ids = importance_resample(docs.select(F.col(f"`{id}`"), F.col(f"`{how.get('text', 'text')}`")), target, **how)
    ids = ids.where("rank is not null").select(F.col(f"`{id}`").alias("drawn_id"))
    return docs.join(ids, F.col(f"`{id}`").eqNullSafe(F.col("drawn_id")), "left_semi")
