import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from causeway.llm import queries, runs
from causeway.llm.common import WordHasher

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """Every run by its definition: each period's stretches, less those with a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rnd, letters, most):
    """Text with nested and neighbouring repeats."""
    words = []
    for _ in range(rnd.randint(0, 5)):
        unit = [rnd.choice(letters) for _ in range(rnd.randint(1, rnd.choice([2, 9, 40])))]
        if rnd.random() < 0.4:
            unit = unit * rnd.randint(2, 5) + [rnd.choice(letters)]
        words += (unit * rnd.randint(1, 7))[: rnd.randint(1, most)]
        if words and rnd.random() < 0.3:
            words[rnd.randrange(len(words))] = rnd.choice(letters)
    return words


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghijklmnop"])
def test_against_brute_force(letters):
    rnd, hasher = random.Random(len(letters)), WordHasher()
    large = 0
    for _ in range(60):
        texts = [made(rnd, letters, 300) for _ in range(4)]
        own = np.concatenate([np.append([ord(w) for w in t], -1 - i).astype(np.int64) for i, t in enumerate(texts)])
        offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        got = runs.periodic_stretches(hasher, own, offsets, 4)
        want = [(s + int(o), n, q) for o, t in zip(offsets, texts) for s, n, q in brute(t, least=4)]
        assert got == sorted(want, key=lambda x: (x[0], x[2]))
        large += sum(q >= runs.SMALL for _, _, q in want)
    assert large > 20


def test_all_scales():
    """Periods of each size, just four of them, at odd places of a long text."""
    rng, hasher = np.random.default_rng(1), WordHasher()
    for q in [1, 7, 8, 9, 15, 16, 17, 31, 32, 63, 64, 100, 127, 128, 129, 255, 256, 1000, 4095, 4096]:
        for head in (0, 1, 13):
            unit = rng.integers(0, 1 << 30, q)
            words = np.concatenate([rng.integers(1 << 31, 1 << 32, head), np.tile(unit, 4), [-7, -1]])
            want = [(head, 4 * q, q)]
            assert runs.periodic_stretches(hasher, words, np.array([0, len(words)]), 4) == want


def test_set_is_consistent_and_dense():
    """Equal contexts are chosen alike; 3 tau - 1 words that are not highly periodic hold a chosen place."""
    rng, hasher = np.random.default_rng(2), WordHasher()
    words, tau = rng.integers(0, 3, 4000), 8
    words[1000:1400] = 1
    periodic = np.zeros(len(words), bool)
    periodic[1000:1393] = True
    chosen, _ = runs.synchronising(hasher, words, tau, periodic)
    member = set(chosen.tolist())
    alike = {}
    for i in range(len(words) - 2 * tau + 1):
        context = tuple(words[i : i + 2 * tau])
        assert alike.setdefault(context, i in member) == (i in member)
    for i in range(len(words) - 3 * tau + 2):
        if not periodic[i : i + 2 * tau].all():
            assert member & set(range(i, i + tau))
    assert not member & set(range(1000, 1380))


def test_cases(spark):
    rows = [
        (1, None, 1), (2, "", 2), (3, " \n ", 3), (4, "a b c", 4), (5, "a " * 6, 5), (6, "a " * 5, 6), (7, "x y " * 4, 7), (7, "x y " * 4, 7),
        (None, "é 日本 " * 5 + "end", 8), (9, "p q r s t u v w z " * 4 + "p q", 9), (10, "w " * 300_000, 10), (11, "long" * 100_000 + " b" * 8, 11),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").select("*", "n_words", "doc_id").toDF("doc_id", "text", "n_words", "a.b", "runs")
    got = runs.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "strongest", "collapsed"]
    for r in got.collect():
        words = WORDS.findall(r.text or "")
        found = brute(words) if len(words) < 1000 else [(0, 300_000, 1)]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == found
        assert r.collapsed == (None if r.text is None else kept(words, found))
    assert got.where("doc_id = 7").count() == 2
    assert runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(df, exponent=3)


def test_strongest_is_exact():
    # 9007199254740993 / 2 and 9007199254740992 / 2 are one double
    assert runs.strongest([(0, 2**53, 2), (5, 2**53 + 1, 2), (9, 2**53 + 1, 2)]) == (5, 2**53 + 1, 2)


def test_query_against_brute_force(spark, sf_dir):
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op13_periodic_runs(spark, sf_dir).collect()
    assert len(got) == len(texts)
    planted = 0
    for r in got:
        words = WORDS.findall(texts[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 3000:
            continue  # too long for the brute force
        found = brute(words)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        assert (r.n_runs, r.runs_sha256) == (len(found), hashlib.sha256(lines.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
    assert planted > 5
