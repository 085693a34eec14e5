"""Periodic run detection by string synchronising sets: stretches of words that repeat with a period, and texts without them.

A run is a stretch of consecutive words with smallest period q, at least ``exponent`` x q and ``least`` words long, that no
neighbouring word extends. ``exponent`` is at least 4. Texts are taken some MB at a time, as one sequence of word numbers
with a number of its own between two texts, so that no run crosses from one to the next.

Periods below SMALL are read off directly: words are compared with those q places on. Longer ones come scale by scale, for
tau = SMALL, 2 SMALL, 4 SMALL ..., each for periods of tau to 2 tau - 1:

* A place whose next tau words lie in a run found before, of a period of at most tau / 4, is highly periodic: it is left out.
  Its run was supplied at a lower scale.
* Of the others each has a hash of its next tau words. A place i is in the synchronising set if the least hash of the places
  i .. i + tau is that of i or of i + tau. Whether it is depends on the 2 tau words from i on alone, so equal contexts are chosen
  alike, and any 3 tau - 1 words that are not highly periodic hold a chosen place among their first tau.
* Chosen places with equal contexts of 2 tau words, next to each other among those with this context and tau to 2 tau - 1
  apart, propose their distance as a period. In a run of period q the first chosen place s is followed by s + q, as the run
  holds 4 q >= 3 tau + q words, and by no other equal context before, so no run is missed.
* A proposal is extended word by word to both sides, which makes a run exact whatever the hashes did.

Work is some n log n for n words; memory some 100 bytes a word of the longest text or slice. Nothing is shuffled.

Cases: a null text stays null and has no words nor runs; empty and short texts have none; repeated rows are worked out each;
an empty table stays empty; other columns are kept whatever their names, but for the four that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from causeway.llm.common import U, WordHasher, lean_batches, mix, slices, string_buffers

#: Periods below this are compared directly; the least scale.
SMALL = 8
NEVER = U(0xFFFFFFFFFFFFFFFF)
RUN = np.dtype([("start", np.int64), ("length", np.int64), ("period", np.int64)])
ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each stretch of consecutive numbers in ascending ``places``."""
    if not len(places):
        return places, places
    head = np.flatnonzero(np.append(True, np.diff(places) > 1))
    return places[head], np.diff(np.append(head, len(places)))


def small_periods(words: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """Runs of periods below SMALL, by comparing each word with that ``q`` places on."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SMALL, len(words))):
        first, n = stretches(np.flatnonzero(words[:-q] == words[q:]))
        for k in np.flatnonzero(n >= (exponent - 1) * q):
            # the same stretch with a period that divides q came first
            found.setdefault((int(first[k]), int(n[k]) + q), q)
    return [(start, length, q) for (start, length), q in found.items()]


def synchronising(hasher: WordHasher, words: np.ndarray, tau: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of their contexts of 2 tau words) of the synchronising set; ``periodic`` marks the places left out."""
    h = hasher.windows(words.astype(U), tau)
    least = np.minimum(h, NEVER - U(1))
    least[periodic[: len(h)]] = NEVER
    own = least
    n = len(own) - tau
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    span = 1
    while span * 2 <= tau + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[tau + 1 - span : tau + 1 - span + n])
    chosen = np.flatnonzero(((own[:n] == least) | (own[tau : tau + n] == least)) & (least != NEVER))
    return chosen, mix(h[chosen] ^ mix(h[chosen + tau] + U(0x9E3779B97F4A7C15)))


def matching(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch of places about ``at`` whose words equal those ``period`` places on."""
    end, step, top = at, 64, len(words) - period
    while end < top:
        stop = min(end + step, top)
        bad = np.flatnonzero(words[end:stop] != words[end + period : stop + period])
        if len(bad):
            end += int(bad[0])
            break
        end, step = stop, step * 2
    begin, step = at, 64
    while begin > 0:
        start = max(begin - step, 0)
        bad = np.flatnonzero(words[start:begin] != words[start + period : begin + period])
        if len(bad):
            begin = start + int(bad[-1]) + 1
            break
        begin, step = start, step * 2
    return begin, end


def smallest_period(words: np.ndarray, period: int) -> bool:
    """Whether no divisor of ``period`` is a period of these words too."""
    return not any(period % d == 0 and np.array_equal(words[:-d], words[d:]) for d in range(1, period // 2 + 1))


def large_periods(hasher: WordHasher, words: np.ndarray, tau: int, known: list[tuple[int, int, int]], exponent: int) -> list[tuple[int, int, int]]:
    """Runs of periods of tau to 2 tau - 1; ``known`` holds those of smaller ones."""
    edge = np.zeros(len(words) + 1, np.int32)
    for start, length, q in known:
        if 4 * q <= tau <= length:
            edge[start] += 1
            edge[start + length - tau + 1] -= 1
    place, context = synchronising(hasher, words, tau, np.cumsum(edge[:-1]) > 0)
    order = np.argsort(context, kind="stable")
    place, context = place[order], context[order]
    apart = place[1:] - place[:-1]
    pair = np.flatnonzero((context[1:] == context[:-1]) & (apart >= tau) & (apart < 2 * tau))
    order = np.lexsort((place[pair], apart[pair]))
    found, before, until = [], 0, 0
    for at, d in zip(place[pair][order].tolist(), apart[pair][order].tolist(), strict=True):
        if d == before and at < until:
            continue  # within the stretch of the proposal before
        begin, end = matching(words, at, d)
        before, until = d, end
        if end - begin >= (exponent - 1) * d and smallest_period(words[begin : end + d], d):
            found.append((begin, end - begin + d, d))
    return found


def periodic_stretches(hasher: WordHasher, words: np.ndarray, offsets: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``exponent`` periods; texts are words[offsets[i]:offsets[i + 1] - 1], with a number of its own after each."""
    found = small_periods(words, exponent)
    size, tau = np.diff(offsets), SMALL
    while exponent * tau < size.max(initial=0):
        # only texts that can hold four such periods go on, and what is known of them
        row = np.flatnonzero(size > exponent * tau)
        begins = np.cumsum(size[row]) - size[row]
        shift = np.full(len(size), -1, np.int64)
        shift[row] = begins - offsets[row]
        part = np.concatenate([words[offsets[i] : offsets[i + 1]] for i in row])
        of = np.searchsorted(offsets, [x[0] for x in found], side="right") - 1
        known = [(s + int(shift[i]), n, q) for (s, n, q), i in zip(found, of.tolist(), strict=True) if size[i] > exponent * tau]
        new = large_periods(hasher, part, tau, known, exponent)
        of = np.searchsorted(begins, [x[0] for x in new], side="right") - 1
        found += [(s - int(shift[row[i]]), n, q) for (s, n, q), i in zip(new, of.tolist(), strict=True)]
        tau *= 2
    return sorted(found, key=lambda x: (x[0], x[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: the smallest start, then period, as ``runs`` are sorted."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words less those that any run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period), strongest (the run of most periods) and collapsed (the words kept)."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods can be missed at the scales searched")
    lean_batches(docs.sparkSession)
    added = T.StructType.fromDDL(ADDED)
    rest = [c for c in docs.columns if c not in added.names]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])  # no name of the input can clash
    at, names = rest.index(text), [*held.columns, *added.names]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        run = pa.struct([(c, pa.int64()) for c in RUN.names])
        for batch in batches:
            column = batch.column(at)
            raw, offsets = string_buffers(column)
            n_words, runs, top, kept = [], [], [], []
            for lo, hi in slices(offsets, 1 << 20):
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(lo, hi)]
                number: dict[bytes, int] = {}
                begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
                own = np.empty(begins[-1], np.int64)
                for i, t in enumerate(texts):
                    own[begins[i] : begins[i + 1] - 1] = [number.setdefault(w, len(number)) for w in t]
                own[begins[1:] - 1] = -1 - np.arange(len(texts))
                n_words += map(len, texts)
                of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for start, length, period in periodic_stretches(hasher, own, begins, exponent):
                    if length >= least:
                        i = int(np.searchsorted(begins, start, side="right")) - 1
                        of[i].append((start - int(begins[i]), length, period))
                runs += [[dict(zip(RUN.names, x, strict=True)) for x in r] for r in of]
                top += [dict(zip(RUN.names, x, strict=True)) if (x := strongest(r)) else None for r in of]
                kept += map(collapsed, texts, of)
            valid = np.asarray(column.is_valid())
            arrays = [
                *batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(top, run),
                pa.array(kept, pa.binary(), mask=~valid).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = held.mapInArrow(search, T.StructType([*held.schema.fields, *added.fields]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *added.names)
