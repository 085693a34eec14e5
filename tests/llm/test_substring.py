import hashlib
import random
import re

import numpy as np
import pytest

from causeway.llm import queries, substring
from causeway.llm.common import WordHasher

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k):
    """{doc_id: (words, kept words)} by a dictionary of whole windows."""
    first = {}
    words = {d: WORDS.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for s in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][s : s + k]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (d, s):
                gone.update(range(s, s + k))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def check(spark, docs, k, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_removed string").repartition(5)
    got = {r.doc_id: r for r in substring.substring_dedup(df, k=k, **more).collect()}
    want = brute(docs, k)
    assert set(got) == set(want)
    for d, (n, kept) in want.items():
        assert (got[d].n_words, got[d].n_removed) == (n, n - len(kept))
        assert WORDS.findall(got[d].text or "") == kept
        if n == len(kept):
            assert got[d].text == dict(docs)[d]


@pytest.mark.parametrize("cells", [1 << 16, 64])
def test_against_brute_force(spark, cells):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本", "a" * 50]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(8, 60))] for _ in range(10)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(passages) if rnd.random() < 0.4 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        docs.append((d * 3, rnd.choice([" ", "\n", "\t ", " \r\n"]).join(w)))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "same " * 500), (1004, "same " * 500), (1005, " ".join(passages[0]))]
    substring_cells = {"most_cells": cells}
    check(spark, docs, 20, **substring_cells)


@pytest.mark.parametrize("cells", [1 << 29, 64])
def test_repeated_rows_stay(spark, cells):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring.substring_dedup(df, most_cells=cells).collect())
    assert got == [(1, 0), (1, 0), (2, 40)]


@pytest.mark.parametrize("cells", [1 << 29, 64])
def test_empty(spark, cells):
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string"), most_cells=cells).collect() == []


def test_shards_let_few_unique_windows_through(spark, monkeypatch):
    """Beyond the bound of what is broadcast, pass 2 still gets little but true repeats, and all of them."""
    monkeypatch.setattr(substring, "CHUNK", 500)
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    own = lambda d: " ".join(f"{d}.{rnd.randrange(10**9)}" for _ in range(300))
    docs = [(d, f"{own(d)} {passage if d % 3 == 0 else ''} {own(d)}") for d in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    cells = substring.sketch_cells(sum(len(t) for _, t in docs))
    got = {(r.doc_id, s) for r in substring.suspects(df, 20, 8, cells, 1 << 12).collect() for s in range(r.start, r.start + r.n)}
    repeated = {(d, s) for d in range(0, 90, 3) for s in range(300, 331)}
    assert cells > 1 << 12 and repeated <= got
    assert len(got) < len(repeated) + 0.1 * 90 * 600
    check(spark, docs, 20, most_cells=1 << 12)


def test_anchor_is_the_least_run():
    h = WordHasher()
    words = np.random.default_rng(0).integers(0, 1 << 62, 200).astype(np.uint64)
    runs = h.windows(words, 8)
    least, place = substring.anchors(h, words, 20, 8)
    for i in range(181):
        assert least[i] == runs[i : i + 13].min() and runs[place[i]] == least[i] and i <= place[i] < i + 13


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows], 20)
    got = queries.op6_substring_dedup(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("cells", [1 << 29, 64])
def test_null_and_large_ids(spark, cells):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), ((1 << 53) + 3, text), ((1 << 53) + 1, text), (5, text + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(df, most_cells=cells).collect()}
    assert got == {None: (30, 0), 5: (31, 0), (1 << 53) + 1: (30, 30), (1 << 53) + 3: (30, 30)}


def test_long_words_of_one_pattern_are_told_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {word}"), (2, f"{head} {word.translate(str.maketrans('ab', 'ba'))}")]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_clashing_columns_are_kept(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "a", 1.5, "x", 7, "t"), (2, words, "b", 2.5, "y", 8, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sd_id string, `a.b` double, sd_runs string, n_words int, of string")
    for cells in (substring.MOST_CELLS, 1 << 10):
        got = substring.substring_dedup(docs, k=20, most_cells=cells)
        assert got.columns == ["doc_id", "text", "sd_id", "a.b", "sd_runs", "of", "n_words", "n_removed"]
        assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [
            (1, words, "a", 1.5, "x", "t", 30, 0), (2, "", "b", 2.5, "y", "u", 30, 30)
        ]
