"""Toxicity by a convolutional text classifier, trained in numpy.

Words, folded to lower case and stripped of punctuation, are hashed to rows of an embedding table. Filters of several
widths slide over a text's embeddings; each keeps its largest response in the whole text, and a logistic layer turns
those into a score. Training is by Adam on the fit rows, at most ``most_rows`` of them and ``most_bytes``, by a hash of the id; a
fifth of these is held back to calibrate: scores are stretched so that the best cut lies at ``cut``, and for each
language with enough rows a threshold of its own is kept.

A text is scored whole, in pieces that overlap by the widest filter; its maximum over pieces is that of the whole text.
Language serves for the thresholds alone; score and prediction at the common cut never see it.

Cases: a null or empty text has no words and gets the score of no response at all; repeated rows get equal scores; with
no fit rows, or rows of one label only, every score is the share of label 1 (0 without rows); an empty table gives no
rows; an unknown or null language takes the common threshold; a row without an id is scored, and not held out; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causeway.llm.common import U, WordHasher, lean_batches, mix, slices, string_buffers

#: Punctuation that words shed at their ends.
EDGES = b".,;:!?\"'()[]{}|*#%&<>-_/\\"


def word_rows(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(two embedding rows of each word, the words' offsets by text): one for the word, one for its first four bytes.

    Row 0 is kept for padding; words lie in the upper half of the table, beginnings in the lower.
    """
    edge = np.zeros(256, bool)
    edge[list(EDGES)] = True
    plain = np.where(edge[raw], np.uint8(32), raw)
    h, first, end, at = hasher(plain, offsets)
    half = U(buckets // 2)
    begin = np.zeros(len(first), U)
    for j in range(4):
        begin = begin * U(256) + np.where(first + j < end, hasher.fold[plain[np.minimum(first + j, len(plain) - 1)]], 0).astype(U)
    rows = np.stack([h % half + half, mix(begin) % (half - U(1)) + U(1)], 1).astype(np.int64)
    return rows, at


@dataclass
class ConvNet:
    """Embeddings, filters of several widths with max pooling, and a logistic output."""

    buckets: int = 1 << 15
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    share: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 5) -> "ConvNet":
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.01, (self.buckets, self.dim)), "out": rng.normal(0, 0.3, len(self.widths) * self.filters), "b": np.zeros(1)}
        self.p["e"][0] = 0
        for w in self.widths:
            self.p[f"w{w}"] = rng.normal(0, 0.5, (w, self.dim, self.filters))
            self.p[f"c{w}"] = np.zeros(self.filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def tables(self) -> None:
        """Each filter's response to each embedding row, by place: scoring then adds rows instead of multiplying."""
        self.by_place = {w: [self.p["e"] @ self.p[f"w{w}"][j] for j in range(w)] for w in self.widths}

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in one text, at least 0."""
        out = []
        pad = np.zeros((max(self.widths) - 1, 2), np.int64)
        rows = np.concatenate([rows, pad])
        n = len(rows) - len(pad)
        for w in self.widths:
            best = np.zeros(self.filters, np.float32)
            for lo in range(0, n, 1 << 14):
                hi = min(n, lo + (1 << 14))
                part = sum(self.by_place[w][j][rows[lo + j : hi + j, k]] for j in range(w) for k in (0, 1))
                best = np.maximum(best, part.max(0) + self.p[f"c{w}"])
            out.append(best)
        return np.concatenate(out)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.p["out"] + self.p["b"][0]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(pooled), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(pooled).astype(float) + self.shift, -30, 30)))

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.02, seed: int = 5, batch_words: int = 60_000) -> None:
        """Adam on the log loss. Gradients reach only the words that gave the maxima, so embeddings update sparsely."""
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step, pad = 0, max(self.widths) - 1
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            at = 0
            while at < len(order):
                take, words = [], 0
                while at < len(order) and (not take or words + len(texts[order[at]]) < batch_words) and len(take) < 64:
                    take.append(order[at])
                    words += len(texts[order[at]]) + pad
                    at += 1
                rows = np.concatenate([np.concatenate([texts[i], np.zeros((pad, 2), np.int64)]) for i in take])
                sizes = np.array([len(texts[i]) + pad for i in take])
                begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                self._step(rows, begin, y[take].astype(np.float32), moments, step := step + 1, rate * (1 - epoch / epochs))

    def _step(self, rows, begin, y, moments, step, rate) -> None:
        p, pad = self.p, max(self.widths) - 1
        emb = p["e"][rows[:, 0]] + p["e"][rows[:, 1]]
        grads = {}
        parts, where = [], []
        n = len(rows) - pad
        for w in self.widths:
            act = sum(emb[j : n + j] @ p[f"w{w}"][j] for j in range(w)) + p[f"c{w}"]
            top = np.maximum.reduceat(act, begin, axis=0)
            spot = np.empty((len(begin), self.filters), np.int64)
            for t, (lo, hi) in enumerate(zip(begin, np.append(begin[1:] - pad, n))):
                spot[t] = lo + act[lo : max(hi, lo + 1)].argmax(0)
            top = np.maximum(np.take_along_axis(act, spot, 0), 0)
            parts.append(top)
            where.append(spot)
        pooled = np.concatenate(parts, 1)
        off = (1 / (1 + np.exp(-np.clip(pooled @ p["out"] + p["b"][0], -30, 30))) - y) / len(y)
        grads["out"], grads["b"] = pooled.T @ off + 1e-4 * p["out"], off.sum(keepdims=True)
        touched, flows = [], []
        for k, w in enumerate(self.widths):
            back = off[:, None] * p["out"][k * self.filters : (k + 1) * self.filters] * (parts[k] > 0)
            grads[f"c{w}"] = back.sum(0)
            g = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                words = where[k] + j
                g[j] = np.einsum("tfd,tf->df", emb[words], back)
                flow = np.einsum("tf,df->tfd", back, p[f"w{w}"][j]).reshape(-1, self.dim)
                for kind in (0, 1):
                    touched.append(rows[words, kind].ravel())
                    flows.append(flow)
            grads[f"w{w}"] = g
        ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        sparse = np.zeros((len(ids), self.dim), np.float32)
        np.add.at(sparse, inverse, np.concatenate(flows))
        sparse[ids == 0] = 0
        for key, g in [*grads.items(), ("e", sparse)]:
            rest = ids if key == "e" else slice(None)
            m, v = moments[key]
            m[rest] = 0.9 * m[rest] + 0.1 * g
            v[rest] = 0.999 * v[rest] + 0.001 * g * g
            p[key][rest] -= (rate * (m[rest] / (1 - 0.9**step)) / (np.sqrt(v[rest] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut between scores with the best F1; the middle of the widest gap that has it."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    lower = np.append(s, s[-1] - 1)[best + 1]
    k = int(np.argmax(s[best] - lower))
    return float((s[best][k] + lower[k]) / 2)


def fit(rows: list[tuple[int, str | None, str | None, int]], cut: float = 0.3, **sizes) -> ConvNet:
    """A net from (id, text, language, label) rows."""
    y = np.array([r[3] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return ConvNet(share=float(y.mean()) if len(y) else 0.0, **sizes)
    net, hasher = ConvNet(**sizes).start(), WordHasher(seed=3, lower=True)
    texts = []
    for r in rows:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        texts.append(word_rows(data, np.array([0, len(data)]), hasher, net.buckets)[0])
    held = np.array([zlib.crc32(b"calibrate %d" % r[0]) % 5 == 0 for r in rows])
    if not (0 < y[held].sum() < held.sum()) or not (0 < y[~held].sum() < (~held).sum()):
        held[:] = False
    use = np.flatnonzero(~held)
    net.train([texts[i] for i in use], y[use])
    net.tables()
    check = np.flatnonzero(held) if held.any() else use
    logit = net.logit(np.stack([net.pooled(texts[i]) for i in check])).astype(float)
    middle = best_cut(logit, y[check])
    net.shift = float(np.log(cut / (1 - cut)) - net.slope * middle)
    langs = np.array([rows[i][2] or "" for i in check])
    for lang in np.unique(langs):
        own = langs == lang
        if lang and 10 <= y[check][own].sum() < own.sum():
            # half way between the common cut and the language's own, which rests on few rows
            at = (best_cut(logit[own], y[check][own]) + middle) / 2
            net.thresholds[str(lang)] = float(1 / (1 + np.exp(-(net.slope * at + net.shift))))
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_bytes: int = 64 << 20) -> list:
    """Labelled rows outside of the held-out fold: those with the least hash of the id, ``most_rows`` and ``most_bytes`` at most.

    Sizes come to the driver first, then the texts chosen; an id that occurs more than once is taken once.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where("y is not null")
    known = known.where(fold(F.col("label_id")) != 2).groupBy("label_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    joined = docs.select("doc_id", "text", "lang").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    sized = joined.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    total, chosen = 0, []
    for r in sized.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.n <= most_bytes:  # a text too long for what is left is passed over, shorter ones still come in
            total += r.n
            chosen.append((r.doc_id,))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "chosen_id long")
    rows = joined.join(F.broadcast(wanted), F.col("doc_id") == F.col("chosen_id"))
    rows = rows.groupBy("doc_id", "y").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("d"))
    return sorted((r.doc_id, r.d.text, r.d.lang, r.y) for r in rows.collect())


def score_documents(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 6000, cut: float = 0.3, net: ConvNet | None = None,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= cut) and flagged (score >= the language's threshold)."""
    lean_batches(docs.sparkSession)
    net = net or fit(fit_rows(docs, labels, label, most_rows, most_bytes), cut)
    if net.p:
        net.tables()
    held = docs.sparkSession.sparkContext.broadcast(net)
    schema = "doc_id long, lang string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, hasher = held.value, WordHasher(seed=3, lower=True)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            out = []
            for lo, hi in slices(offsets, 1 << 20):
                if not net.p:
                    out.append(net.score(np.empty(hi - lo)))
                    continue
                part = offsets[lo : hi + 1]
                rows, at = word_rows(raw[part[0] : part[-1]], part - part[0], hasher, net.buckets)
                out.append(net.score(np.stack([net.pooled(rows[at[i] : at[i + 1]]) for i in range(hi - lo)])))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(out))], names=["doc_id", "lang", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(score, schema)
    own = F.lit(cut)
    for lang, threshold in net.thresholds.items():
        own = F.when(F.col("lang") == lang, F.lit(threshold)).otherwise(own)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        (F.col("score") >= own).alias("flagged"),
    )
