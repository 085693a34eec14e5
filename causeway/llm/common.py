"""Helpers that the corpus operators share: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U = np.uint64
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster, whose machines have no such folder in common,
    gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows instead of Spark's default of 10,000, as texts are long rows; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors. ``dropped`` deletes it.

    It gets no file that marks its end, as it is read only once it is whole.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``df`` with ``number``, from 1 in the order of ``order``: a range-partitioned sort, written, and each part's first number.

    Rows that tie in ``order`` are numbered in any way. The driver holds one count for each part.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("nb_part", F.spark_partition_id()).withColumn("nb_place", F.monotonically_increasing_id()), "numbered")
    before, start = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("nb_part").count().collect())):
        start.append((part, before + 1 - (part << 33)))
        before += n
    starts = df.sparkSession.createDataFrame(start, "nb_part int, nb_start long")
    out = rows.join(F.broadcast(starts), "nb_part").withColumn(number, F.col("nb_place") + F.col("nb_start"))
    return out.select(*df.columns, number)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_limit(spark: SparkSession) -> int:
    """The session's bound in bytes for what may be broadcast; below 0: nothing."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(said[-1:])
    return int(said[:-1]) << unit if unit else int(said)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; one narrow aggregate in the JVM."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def sketch_tasks(spark: SparkSession, n_bytes: int) -> int:
    """Tasks that each fill a sketch of their own: one for each core, and more beyond 4 GB of text a task."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // (4 << 30)))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word; texts meet at ``offsets``, and no word crosses from one to the next."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[raw]
    begins = ~space
    ends = begins.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = ~space[edges]
    ends[edges - 1] = ~space[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


#: Masks that keep the first 0 .. 8 bytes of a little-endian 64-bit load.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Longer words are hashed by BLAKE2b, whatever their letters repeat.
LONG_WORD = 64


class WordHasher:
    """Keyed 64-bit hashes of the words of many texts at once; the same on every executor for one seed.

    A word is taken eight bytes at a time, each mixed into what came before: up to eight bytes, words of one length never
    share a hash. Words over LONG_WORD bytes are hashed by keyed BLAKE2b.
    """

    def __init__(self, seed: int = 1, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.key = rng.integers(0, 1 << 63, 2, dtype=np.uint64) * U(2) + U(1)
        self.fold = np.arange(256, dtype=np.uint8)
        self.lower = lower
        if lower:
            self.fold[65:91] = self.fold[97:123]
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers: dict[int, np.ndarray] = {}

    def powers(self, value: int, n: int) -> np.ndarray:
        got = self._powers.get(value)
        if got is None or len(got) < n:
            got = np.full(max(n, 1 << 12), U(value))
            got[0] = 1
            np.multiply.accumulate(got, out=got)
            self._powers[value] = got
        return got[:n]

    def words(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each word raw[first:end]."""
        if not len(first):
            return np.empty(0, U)
        data = np.zeros(len(raw) + 8, np.uint8)
        data[:-8] = self.fold[raw] if self.lower else raw
        eight = np.ndarray(len(raw) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
        size = end - first
        h = mix(size.astype(U) * self.key[0] + self.key[1])
        h = mix(h ^ (eight[first] & _FIRST[np.minimum(size, 8)]))
        for at in range(8, LONG_WORD, 8):
            rest = np.flatnonzero(size > at)
            if not len(rest):
                break
            h[rest] = mix(h[rest] * self.key[0] ^ (eight[first[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]))
        for i in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(data[first[i] : end[i]], digest_size=8, key=self.key.tobytes()).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
        return h

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first byte, end byte) of each word, and the words' offsets by text."""
        first, end = word_bounds(raw, offsets)
        return self.words(raw, first, end), first, end, np.searchsorted(first, offsets)

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """The hash of each k consecutive words of one sequence."""
        n = len(words) - k + 1
        if n <= 0:
            return np.empty(0, U)
        total = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words) * self.powers(self.base, len(words)), out=total[1:])
        return mix((total[k:] - total[:-k]) * self.powers(self.inverse, n))


def arrow_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).fill_null("").to_pylist()
