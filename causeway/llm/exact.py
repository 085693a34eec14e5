"""Exact dedup by deterministic block naming: documents of equal texts get one integer identity, without collisions.

A normalised text (A-Z lower-cased) is cut into blocks of ``block`` bytes, the last one shorter; an empty text is one empty
block. All blocks are sorted (by a hash, then by contents), and each distinct block is named by its place in that order. Then adjacent names of a document
are taken in pairs (an odd last one with 0), and all pairs are sorted and named in the same way, from the names given so far
on, until each document has one name left: its identity. Names stand for contents, never for hashes of them: two documents
get one identity only for equal texts, and the identities do not depend on how the rows were dealt.

A naming is one sort by ranges of (hash of the contents, document, place), so that a block which a third of all rows hold is many
tasks; within a part rows are sorted by hash, then contents, and numbered as they stream by. Where contents go on from one
part to the next is found by comparing the edges of the parts. Should different contents of one hash meet at such an edge, the
sort is done anew with the contents themselves among the ranges: the order, and so the names, are the same. The driver holds
samples of short keys and one number for each part. Texts are shuffled once; above the blocks, a name of 8 bytes stands for each.

Rows travel as (id, SHA-256 of the text), which only keeps rows of one id and different texts apart.

Cases: null texts are empty texts, and equal each other; of equal texts the row with the largest id stays, a null id being
the smallest; of repeated rows (one id and one text) that would all stay, one does; texts of any length go through in blocks;
an empty table gives no rows; other columns take no part, and ``kept_documents`` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from causeway.llm.common import dropped, lean_batches, string_buffers, written

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut_into_blocks(docs: DataFrame, block: int) -> DataFrame:
    """id, digest, n, place, content: the blocks of each row of ``docs`` (id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            raw = _FOLD[raw]
            size = np.diff(offsets)
            n = np.maximum(1, -(-size // block))
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            bounds = np.append(offsets[row] + place * block, offsets[-1]).astype(np.int32)
            content = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(digest, pa.binary()).take(take), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32)), content],
                names=["id", "digest", "n", "place", "content"],
            )

    fields = [docs.schema[0], *T.StructType.fromDDL("digest binary, n int, place int, content binary").fields]
    return docs.mapInArrow(cut, T.StructType(fields))


def named(df: DataFrame, keys: list[str], after: int, short: int) -> tuple[DataFrame, int]:
    """``df`` (id, digest, n, place and ``keys``) with ``name`` for the keys, and the last name given.

    Distinct values of the keys, none null, are numbered in ascending order from ``after`` + 1 on. The first ``short`` of the
    keys deal the rows to parts; what ties in them may go on in the next part.
    """
    spark, rest = df.sparkSession, ["id", "digest", "n", "place"]
    # what follows the keys only splits common ones; equal rows are split by the task that they come from
    ranged = df.select(*rest, *keys).repartitionByRange(*keys[:short], "id", "place", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of mark 0 are those of df; a part ends with two more: its first keys (mark 1) and its last (mark 2),
        # with the number of values (``alike``) that tie with them in the short keys
        part, local, first, last, group, first_group = TaskContext.get().partitionId(), 0, None, None, 0, None

        def rows(columns: list[pa.Array], own: list[pa.Array], mark: int, alike: int, rank: np.ndarray) -> pa.RecordBatch:
            size = len(rank)
            more = [pa.array(np.full(size, x, np.int32)) for x in (mark, part)] + [pa.array(np.full(size, alike)), pa.array(rank)]
            return pa.RecordBatch.from_arrays([*columns, *own, *more], names=[*rest, *keys, "mark", "part", "alike", "rank"])

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            own = batch.columns[len(rest) :]
            new, lead = np.zeros(size, bool), np.zeros(size, bool)
            begins, ends = ([c[i].as_py() for c in own] for i in (0, size - 1))
            new[0] = begins != last
            lead[0] = last is not None and begins[:short] != last[:short]
            for i, c in enumerate(own):
                differs = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
                new[1:] |= differs
                if i < short:
                    lead[1:] |= differs
            at = np.flatnonzero(lead)
            if len(at):
                first_group = group + int(new[: at[0]].sum()) if first_group is None else first_group
                group = 0
            group += int(new[at[-1] if len(at) else 0 :].sum())
            first, last = first or begins, ends
            rank = local + np.cumsum(new)
            local = int(rank[-1])
            yield rows(batch.columns[: len(rest)], [pa.nulls(size, c.type) for c in own], 0, 0, rank)
        if first:
            kinds = [c.type for c in batch.columns]
            for mark, edge, alike in ((1, first, group if first_group is None else first_group), (2, last, group)):
                none = [pa.nulls(1, k) for k in kinds[: len(rest)]]
                own = [pa.array([v], k) for v, k in zip(edge, kinds[len(rest) :], strict=True)]
                yield rows(none, own, mark, alike, np.array([local]))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ranged.schema])
    for name, kind in (("mark", T.IntegerType()), ("part", T.IntegerType()), ("alike", T.LongType()), ("rank", T.LongType())):
        schema = schema.add(name, kind)
    table = written(ranged.mapInArrow(number, schema), "names")
    ends = table.where("mark > 0")
    counts = sorted((r.part, r.rank) for r in ends.where("mark = 2").select("part", "rank").collect())
    follows = spark.createDataFrame([(b[0], a[0]) for a, b in zip(counts, counts[1:])], "part int, before int")
    head = ends.where("mark = 1").select("part", F.struct(*keys).alias("head"), F.struct(*keys[:short]).alias("near"), F.col("alike").alias("some"))
    tail = ends.where("mark = 2").select(F.col("part").alias("before"), F.struct(*keys).alias("tail"), F.struct(*keys[:short]).alias("far"), "alike")
    met = head.join(follows, "part").join(tail, "before").where("near = far")
    met = met.select("part", F.expr("head = tail and some = 1 and alike = 1").alias("clean")).collect()
    if not all(r.clean for r in met):
        dropped(table)
        return named(df, keys, after, len(keys))
    same, starts = {r.part for r in met}, []
    for part, n in counts:
        after -= part in same
        starts.append((part, after))
        after += n
    start = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    return table.where("mark = 0").join(start, "part").select(*rest, (F.col("rank") + F.col("start")).alias("name")), after


def identities(docs: DataFrame, block: int = 4096) -> DataFrame:
    """id, digest, copies, identity: a row for each id and text of ``docs`` (id, text), ``copies`` being its number of rows."""
    lean_batches(docs.sparkSession)
    left, last = named(cut_into_blocks(docs, block).withColumn("hash", F.xxhash64("content")), ["hash", "content"], 0, 1)
    # equal rows have equal names
    rows = left.where("place = 0").groupBy("id", "digest", "n").agg(F.count("*").alias("copies"), F.max("name").alias("name"))
    left, ended = left.where("n > 1"), None
    while not left.isEmpty():
        even, pair = F.col("place") % 2 == 0, F.floor(F.col("place") / 2).cast("int").alias("place")
        pairs = left.groupBy("id", "digest", "n", pair).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b")
        )
        named_pairs, last = named(pairs.withColumn("n", F.floor((F.col("n") + 1) / 2).cast("int")), ["a", "b"], last, 2)
        whole, left = named_pairs.where("n = 1"), named_pairs.where("n > 1")
        ended = whole if ended is None else ended.union(whole)
    out = rows.where("n = 1").select("id", "digest", "copies", F.col("name").alias("identity"))
    if ended is not None:
        ended = ended.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), F.col("name").alias("identity"))
        long = rows.where("n > 1").join(ended, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
        out = out.union(long.select("id", "digest", "copies", "identity"))
    return out


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """For each row of ``docs``: its id, keep_id, group_size, kept, text_sha256 (of the normalised text) and identity."""
    held = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = written(identities(held, block), "identities")
    # written, so that Spark can split an identity that very many rows have
    groups = written(rows.groupBy("identity").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    each = rows.join(groups, "identity").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select(
        F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "identity"
    )


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id, text, block).where("kept").select(F.col(id).alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no name of the input can clash
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (id, text))
    folded = F.translate(F.coalesce(own_text, F.lit("")), LETTERS, LETTERS.lower())
    held = held.withColumn("own_id", own_id).withColumn("own_sha256", F.sha2(F.encode(folded, "UTF-8"), 256))
    rows = held.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha256") == F.col("kept_sha256")), "left_semi")
    rows = rows.dropDuplicates(["own_id", "own_sha256"])
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
