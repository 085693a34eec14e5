"""Best-fit packing: documents as token sequences, packed into as few full sequences as possible.

Bounded-space online best-fit: a fixed number of bins is open at a time, kept in a bitset keyed by free space.
Each piece goes to the open bin that it fills best; when too many are open, the fullest closes first.

Cases: a null text is an empty one and becomes its end id alone; repeated rows are packed as often as they occur;
a null id packs like any other; an empty table gives no rows; other columns of the input are ignored, whatever their names. A text of any length is
cut into pieces of ``capacity`` tokens; the first piece holds the rest, so it may be shorter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causeway.llm.common import arrow_texts, lean_batches, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Bytes of text for each packing task: some 60,000 sequences of 1,024 tokens.
SHARD_BYTES = 256 << 20


#: Longer runs of white space go through ``tokenizers`` itself, as the faster encoder's splitting would backtrack over them.
LONG_SPACE = re.compile(r"\s{4096}")


class ByteBpe:
    """An encoder for a byte-level BPE file of ``tokenizers`` whose ids follow the merge order.

    The file's vocabulary serves as rank table, so ids equal those of ``tokenizers`` at a quarter of its time. Special
    tokens in a text become their ids, as ``tokenizers`` does by default.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown}
        to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.path, self.special = path, special
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.slow = None

    def encode(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(token in text for token in self.special):
            return self.bpe.encode(text, allowed_special="all")
        return self.bpe.encode_ordinary(text)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of each document: its place in the document, length and checksum."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            texts = arrow_texts(batch)
            for at in range(0, len(texts), 512):
                rows = []
                for doc, text in zip(ids[at : at + 512].to_pylist(), texts[at : at + 512]):
                    tokens = np.array([*bpe.encode(text), end_id], "<u4")
                    rows += [
                        (doc, k, s, n, zlib.crc32(tokens[s : s + n].tobytes()))
                        for k, (s, n) in enumerate(cut(len(tokens), capacity))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


class Bins:
    """Open bins by free space. Bit f of ``free`` is set while some open bin has f tokens free."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of n tokens."""
        fits = self.free >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - n
        if left:
            if self.open >= self.most_open:
                fullest = (self.free & -self.free).bit_length() - 1
                if fullest >= left:  # the bin at hand is itself the fullest
                    return bin_id, self.capacity - free
                self._take(fullest)
            self.by_free[left].append(bin_id)
            self.free |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches, ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while sum(map(len, held)) + len(batch) >= rows:
            need = rows - sum(map(len, held))
            yield pa.Table.from_batches([*held, batch.slice(0, need)])
            held, batch = [], batch.slice(need)
        if len(batch):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def pack(
    cut_pieces: DataFrame, capacity: int = 1024, most_open: int = 4096, shards: int = 1, look_ahead: int = 8192
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; each shard packs its own pieces in one streaming pass.

    A buffer of ``look_ahead`` pieces arrives longest first, so that short ones are left to fill gaps.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = Bins(capacity, most_open), TaskContext.get().partitionId() << 40
        for block in blocks(batches, look_ahead):
            block = block.take(np.argsort(-block["length"].to_numpy(), kind="stable"))
            placed = [bins.place(n) for n in block["length"].to_pylist()]
            block = block.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
            yield from block.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        cut_pieces.repartition(shards, key)
        .sortWithinPartitions(key, "doc_id", "piece")
        .mapInArrow(place, PACKED)
    )


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, most_open: int = 4096) -> DataFrame:
    """Tokenises, cuts and packs all documents. The number of packing tasks follows the bytes of text."""
    lean_batches(docs.sparkSession)
    shards = max(1, -(-text_bytes(docs) // SHARD_BYTES))
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, most_open, shards)
