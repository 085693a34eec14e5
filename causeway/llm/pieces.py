"""Sentence-piece encoding and decoding with n-best segmentations.

A text, spaces shown as a mark and one mark set before it, is a lattice of the model's pieces; a character without a
piece is an edge of its bytes' pieces at a penalty. A forward Viterbi pass scores the best way to each place. An A* search
from the end back uses these scores as heuristic: they are exact, so the n best segmentations leave the queue in order.

No piece crosses certain places (between a word's last character and what follows, and beside line ends), so the
lattice of a text falls into chunks there. Chunks repeat much, and each task keeps what it found for them. The n best
of a text are its best one changed at chunks with the least loss: n - 1 of these are searched, the rest cannot matter.

The search keeps no more open ways than segmentations are still wanted: as heuristics are exact, each open way ends in a
segmentation of just its estimate, so any beyond these is worse than n others. Memory is linear in a chunk, however long.

Pieces and scores are those of the model file. For a BPE file the best sum of scores need not be the segmentation that
merging in order gives, which is what that model's own encoder returns.

Ties: of equal ways to a place the one with the longest last piece wins; equal scores of a text come in search order.
Cases: a null or empty text has no pieces, one segmentation of score 0 (null decodes to null); repeated rows are encoded
alike; a text of any length is encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Odd multipliers that give a substring its 64-bit key.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Chunks that a task remembers.
REMEMBERED = 600_000
#: Chunks of more characters do not keep their edges.
LONG_CHUNK = 4096
NONE = np.uint32(0xFFFFFFFF)


class PieceModel:
    """Pieces, scores and chunking of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte_id = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.raw.append(piece.encode())
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.raw[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        self.longest = max(map(len, self.ids))
        keyed = sorted((self._key(p), w) for p, w in self.score.items())
        self.keys, self.key_score = np.array([k for k, _ in keyed], np.uint64), np.array([w for _, w in keyed])
        number = {self._key(p): i for p, i in self.ids.items()}
        self.key_id = np.array([number[k] for k, _ in keyed], np.uint32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.seen = np.zeros(1 << 20, bool)  # the keys' upper bits: most substrings are no pieces
        self.seen[self.keys >> np.uint64(44)] = True
        self.penalty = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        inner = {b for a, b in pairs if re.match(r"\w", a) and not re.match(r"\w", b)}
        while more := {b for a, b in pairs if a in inner and not re.match(r"\w", b)} - inner:
            inner |= more
        if MARK in inner or any("\n" in p and p != "\n" for p in self.ids):
            self.chunk = re.compile(r"(?s).+")  # no safe places: a text is one chunk
        else:
            word = r"\w" + "".join(map(re.escape, sorted(inner)))
            self.chunk = re.compile(rf"\n|{MARK}*[^{word}{MARK}\n]*[{word}]+|{MARK}*[^{word}{MARK}\n]+|{MARK}+")
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_ends = np.cumsum(self.raw_sizes)
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered of chunks: their numbers, and by number score, loss and place of the ids."""
        self.number: dict[str, int] = {}
        self.score_of, self.loss_of = np.empty(1024), np.empty(1024)
        self.begin, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.flat, self.used = np.empty(4096, np.uint32), 0

    def remember(self, chunks: Sequence[str], ids: np.ndarray, counts: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        have, more = len(self.number), len(chunks)
        while have + more > len(self.score_of):
            self.score_of, self.loss_of, self.begin, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.score_of, self.loss_of, self.begin, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        at = slice(have, have + more)
        self.score_of[at], self.loss_of[at], self.count[at] = score, loss, counts
        self.begin[at] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(chunks, range(have, have + more)))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = h * int(BASE) + ord(c) + 1 & 0xFFFFFFFFFFFFFFFF
        return h * int(SPREAD) & 0xFFFFFFFFFFFFFFFF

    def into(self, chunk: str, e: int) -> list[tuple[int, float]]:
        """The (start, score) of edges that end at place e, longest first."""
        get, longest = self.score.get, self.longest
        found = [(s, w) for s in range(e - longest if e > longest else 0, e) if (w := get(chunk[s:e])) is not None]
        if not found or found[-1][0] != e - 1:
            found.append((e - 1, self.penalty))
        return found

    def edges(self, chunk: str) -> Sequence[list[tuple[int, float]]]:
        """``into`` for each end place; of long chunks, taken anew each time."""
        if len(chunk) > LONG_CHUNK:
            return LateEdges(self, chunk)
        return [[], *(self.into(chunk, e) for e in range(1, len(chunk) + 1))]

    @staticmethod
    def forward(edges: Sequence[list[tuple[int, float]]]) -> tuple[array, array]:
        """(best score to each place, the start of its last piece)."""
        best, back = array("d", [0.0]), array("q", [0])
        for e in range(1, len(edges)):
            top, at = -np.inf, 0
            for s, w in edges[e]:
                w += best[s]
                if w > top:
                    top, at = w, s
            best.append(top)
            back.append(at)
        return best, back

    def ids_of(self, chunk: str, start: int, end: int) -> Sequence[int]:
        i = self.ids.get(chunk[start:end])
        return (i,) if i is not None else [self.byte_id[b] for b in chunk[start:end].encode()]

    def best(self, chunk: str) -> tuple[list[int], float, float]:
        """(ids, score, what the second best loses; infinite without one)."""
        whole = self.ids.get(chunk) if len(chunk) == 1 else None
        if whole is not None:
            return [whole], self.score[chunk], np.inf
        edges = self.edges(chunk)
        best, back = self.forward(edges)
        place = n = len(chunk)
        cuts = array("q", [n])
        while place:
            place = back[place]
            cuts.append(place)
        cuts.reverse()
        ids: list[int] = []
        for s, e in zip(cuts, cuts[1:]):
            ids += self.ids_of(chunk, s, e)
        taken = dict(zip(cuts[1:], cuts))
        rest = array("d", [-np.inf]) * n + array("d", [0.0])
        top = -np.inf  # of ways that leave the best one somewhere
        for e in range(n, 0, -1):
            tail, kept = rest[e], taken.get(e, -1)
            for s, w in edges[e]:
                w += tail
                if w > rest[s]:
                    rest[s] = w
                if s != kept and (w := w + best[s]) > top:
                    top = w
        return ids, best[n], best[n] - top

    def learn(self, chunks: list[str]) -> np.ndarray:
        """The numbers of chunks; ``best`` of new ones is found for many at once, chunks of one length as rows of arrays."""
        get = self.number.get
        at = np.array([get(c, -1) for c in chunks], np.int64)
        if (at >= 0).all():
            return at
        new = dict.fromkeys(chunks[i] for i in np.flatnonzero(at < 0).tolist())
        if len(self.number) + len(new) > REMEMBERED and self.number:
            self.forget()
            return self.learn(chunks)
        by_length: dict[int, list[str]] = {}
        for c in new:
            by_length.setdefault(len(c), []).append(c)
        for n, same in by_length.items():
            if not 1 < n <= 32 or len(same) < 8:
                found = [self.best(c) for c in same]
                counts = np.array([len(f[0]) for f in found])
                ids = np.fromiter((i for f in found for i in f[0]), np.uint32, int(counts.sum()))
                self.remember(same, ids, counts, np.array([f[1] for f in found]), np.array([f[2] for f in found]))
                continue
            for lo in range(0, len(same), 1 << 15):
                self._learn(same[lo : lo + (1 << 15)], n)
        get = self.number.get
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = get(chunks[i])
        return at

    def entry(self, chunk: str) -> tuple[list[int], float, float]:
        """``best`` of a chunk that is remembered."""
        i = self.number[chunk]
        return self.ids_at(np.array([i])).tolist(), float(self.score_of[i]), float(self.loss_of[i])

    def ids_at(self, at: np.ndarray) -> np.ndarray:
        """The ids of remembered chunks, one after another."""
        n = self.count[at]
        return self.flat[np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def _learn(self, chunks: list[str], n: int) -> None:
        rows = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n).astype(np.uint64)
        weight: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}  # ids; NONE where no piece is
        for s in range(n):
            h = np.zeros(rows, np.uint64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = h * BASE + codes[:, e - 1] + np.uint64(1)
                w = np.full(rows, self.penalty if e == s + 1 else -np.inf)
                key = h * SPREAD
                maybe = np.flatnonzero(self.seen[key >> np.uint64(44)])
                at = np.searchsorted(self.keys, key[maybe])
                hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key[maybe]
                if not hit.any() and e > s + 1:
                    continue
                w[maybe[hit]] = self.key_score[at[hit]]
                weight[s, e] = w
                piece[s, e] = own = np.full(rows, NONE)
                own[maybe[hit]] = self.key_id[at[hit]]
        best, back = np.full((n + 1, rows), -np.inf), np.zeros((n + 1, rows), np.int64)
        best[0] = 0
        for s, e in sorted(weight, key=lambda p: (p[1], p[0])):
            w = best[s] + weight[s, e]
            more = w > best[e]
            best[e][more] = w[more]
            back[e][more] = s
        place, taken = np.full(rows, n), np.full((n + 1, rows), -1)
        for e in range(n, 0, -1):
            on = place == e
            taken[e][on] = back[e][on]
            place = np.where(on, back[e], place)
        rest, top = np.full((n + 1, rows), -np.inf), np.full(rows, -np.inf)
        rest[n] = 0
        for s, e in sorted(weight, key=lambda p: -p[1]):
            w = weight[s, e] + rest[e]
            np.maximum(rest[s], w, out=rest[s])
            np.maximum(top, np.where(taken[e] == s, -np.inf, w + best[s]), out=top)
        row, start, ids = [], [], []
        for s, e in weight:
            own = np.flatnonzero(taken[e] == s)
            row.append(own)
            start.append(np.full(len(own), s))
            ids.append(piece[s, e][own])
        row, start, ids = map(np.concatenate, (row, start, ids))
        odd = np.unique(row[ids == NONE])  # with characters that are no piece: their bytes are
        plain = np.ones(rows, bool)
        plain[odd] = False
        keep = plain[row]
        order = np.lexsort((start[keep], row[keep]))
        counts = np.bincount(row[keep], minlength=rows)
        whole = np.flatnonzero(plain)
        self.remember([chunks[i] for i in whole.tolist()], ids[keep][order], counts[whole], best[n][whole], (best[n] - top)[whole])
        if len(odd):
            found = [self.best(chunks[i]) for i in odd.tolist()]
            counts = np.array([len(f[0]) for f in found])
            self.remember(
                [chunks[i] for i in odd.tolist()], np.fromiter((i for f in found for i in f[0]), np.uint32, int(counts.sum())), counts,
                np.array([f[1] for f in found]), np.array([f[2] for f in found]),
            )

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one chunk, (score, ids), best first."""
        edges = self.edges(chunk)
        best, _ = self.forward(edges)
        place_of, came = array("q", [len(chunk)]), array("q", [-1])  # of each way that was open: its place, and the way before
        queue = [(-best[len(chunk)], 0, 0, 0.0)]  # sorted: (estimate, order of entry, way, score so far)
        count, found = 0, []
        while queue and len(found) < n:
            _, _, way, tail = queue.pop(0)
            place = place_of[way]
            if place == 0:
                ids: list[int] = []
                while came[way] >= 0:
                    ids += self.ids_of(chunk, place_of[way], place_of[came[way]])
                    way = came[way]
                found.append((tail, tuple(ids)))
                continue
            most = n - len(found)
            for s, w in edges[place]:
                count += 1
                estimate = -(best[s] + w + tail)
                if len(queue) < most or estimate < queue[-1][0]:
                    place_of.append(s)
                    came.append(way)
                    insort(queue, (estimate, count, len(came) - 1, tail + w))
                    del queue[most:]
        return found

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return self.ids_at(self.learn(self.chunks(text))).tolist()

    def ranked(self, chunks: list[str], at: np.ndarray, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The n best segmentations as (score, ids of the chunks that are changed against the best one), best first."""
        loss = self.loss_of[at]
        change = np.argsort(loss, kind="stable")[: n - 1] if len(loss) < 4 * n else np.argpartition(loss, n - 2)[: n - 1] if n > 1 else []
        ways: list[tuple[float, dict]] = [(0.0, {})]  # losses, with what is changed where
        for i in sorted(int(i) for i in change if loss[i] < np.inf):
            others = self.search(chunks[i], n)
            top = float(self.score_of[at[i]])
            ways = heapq.nsmallest(
                n, ((lost + top - s, {**swap, i: own} if k else swap) for lost, swap in ways for k, (s, own) in enumerate(others)),
                key=lambda w: w[0],
            )
        total = float(self.score_of[at].sum())
        return [(total - lost, swap) for lost, swap in ways]

    def ids_with(self, at: np.ndarray, swap: dict[int, tuple[int, ...]]) -> np.ndarray:
        """The ids of the chunks numbered ``at``, those of ``swap`` in place of the best ones."""
        parts, last = [], 0
        for i in sorted(swap):
            parts += [self.ids_at(at[last:i]), np.array(swap[i], np.uint32)]
            last = i + 1
        return np.concatenate([*parts, self.ids_at(at[last:])]).astype("<u4")

    def together(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """(chunks, their numbers) of each text; texts are chunked together, some million characters at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1_000_000):
                size += len(texts[hi])
                hi += 1
            chunked = [self.chunks(t) for t in texts[lo:hi]]
            every = [c for chunks in chunked for c in chunks]
            at, done = self.learn(every), 0
            for chunks in chunked:
                yield chunks, at[done : done + len(chunks)]
                done += len(chunks)
            lo = hi

    def nbest_of(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """``nbest`` of each text."""
        for chunks, at in self.together(texts):
            yield [(score, self.ids_with(at, swap)) for score, swap in self.ranked(chunks, at, n)]

    def nbest(self, text: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text, (score, ids), best first."""
        return next(self.nbest_of([text], n))

    def decode(self, ids: Sequence[int]) -> str:
        ids = np.asarray(ids, np.int64)
        n = self.raw_sizes[ids]
        at = np.repeat(self.raw_ends[ids] - np.cumsum(n), n) + np.arange(int(n.sum()))
        return self.raw_bytes[at].tobytes().decode("utf-8", "replace").removeprefix(MARK).replace(MARK, " ")


class LateEdges:
    """``PieceModel.edges`` of a long chunk, each list made when it is asked for."""

    def __init__(self, model: PieceModel, chunk: str):
        self.model, self.chunk = model, chunk

    def __len__(self) -> int:
        return len(self.chunk) + 1

    def __getitem__(self, e: int) -> list[tuple[int, float]]:
        return self.model.into(self.chunk, e)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model: str, n: int = 1) -> DataFrame:
    """doc_id, ids (of the best segmentation) and nbest: the n best as (score, ids), best first."""
    schema = "doc_id long, ids array<int>, nbest array<struct<score: double, ids: array<int>>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                ways = list(own.nbest_of(part.column(1).fill_null("").to_pylist(), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([w[0][1] for w in ways], pa.list_(pa.int32())), pa.array([[{"score": s, "ids": i} for s, i in w] for w in ways], kind)],
                    names=["doc_id", "ids", "nbest"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from ids; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [None if i is None else own.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def segmentations(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """For each document: n_pieces, ids_crc32 (unsigned 32-bit ids), the scores of its n best, and whether it decodes back."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, restored boolean"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                rows = []
                texts = part.column(1).fill_null("").to_pylist()
                for text, (chunks, at) in zip(texts, own.together(texts)):
                    ids = own.ids_at(at).astype("<u4")
                    scores = [s for s, _ in own.ranked(chunks, at, n)]
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), scores, own.decode(ids) == text))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_pieces", "ids_crc32", "scores", "restored"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, schema)
