import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from causeway.llm import queries, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    """Rows (doc_id, n_features, weight, score, rank), by spelling out every feature."""
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total + 10000.0) / ((s[b] + 1.0) * (wanted + 10000.0))))
    rows = []
    for d, words, f in own:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((d, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    out = [(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)]
    return sorted(out + [(r[0], *r[2:], None) for r in able[len(drawn) :]] + [(r[0], *r[2:], None) for r in rows if r[1] < least], key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("most_words", [0, 3, 50_000])
def test_against_brute_force(spark, most_words):
    rnd = random.Random(1)
    vocabulary = ["The", "the", "cat", "Éclair", "éclair", "日本", "x" * 64, "y" * 65, "z" * 3000, "a1", "9", "ß"]
    join = lambda: rnd.choice([" ", "  ", ", ", "\n", "-", "_", "\t.", "@"])
    text = lambda n: "".join(rnd.choice(vocabulary) + join() for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 2, 19, 20, 50]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,"), (None, text(30)), (None, text(5)), (203, "cat " * 30_000)] + [(204, docs[9][1] + text(20))] * 3
    target = [text(40), "the cat", None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(df, want, percent=30, most_words=most_words)
    assert rows_of(got) == brute(docs, target, percent=30)


def test_payloads_compose():
    """CRCs of features from those of their words, at lengths below, at and beyond the table."""
    own = resample.Reader([b"ab", b"b"], 10_000, 4)
    texts = [b"ab b " + b"q" * n + b" ab b" for n in (1, 63, 64, 65, 66, 1000, 70_000)] + [b"", b"b", b" b  ab  b "]
    offsets, found = own(texts)
    for i, t in enumerate(texts):
        words = t.split()
        assert offsets[i + 1] - offsets[i] == len(words)
        for n in range(1, 5):
            want = [-1] * min(n - 1, len(words)) + [zlib.crc32(b" ".join(words[k : k + n])) % 10_000 for k in range(len(words) - n + 1)]
            assert found[n - 1][offsets[i] : offsets[i + 1]].tolist() == want


def test_automaton_emits_each_entry_of_the_dictionary():
    """Overlapping delimiters, words within words, and words that no entry covers."""
    own = resample.Reader([b"a", b"aa", b"aaa", "é".encode()], 10_000, 1)
    hidden = zlib.crc32
    end, crc, size = own.payloads(" a aa aaa aaaa é a ".encode())
    assert size.tolist() == [1, 2, 3, 4, 2, 1]
    assert crc.tolist() == [hidden(w) for w in "a aa aaa aaaa é a".encode().split()]


def test_dictionary_is_the_commonest_words(spark, monkeypatch):
    monkeypatch.setattr(resample, "COUNTED", 2)
    df = spark.createDataFrame([("B b a C",), ("c b a-a " + "w" * 65,), (None,)], "text string").repartition(3)
    assert resample.dictionary(df, 10) == [b"a", b"b", b"c"]
    assert resample.dictionary(df, 2) == [b"a", b"b"]


def test_towards_the_target(spark):
    """Documents that use the target's words are drawn far more often than their share."""
    rnd = random.Random(2)
    text = lambda words: " ".join(rnd.choice(words) for _ in range(60))
    plain, wanted = [f"p{i}" for i in range(200)], [f"w{i}" for i in range(200)]
    docs = [(i, text(wanted + plain if i % 10 == 0 else plain)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(text(wanted),) for _ in range(50)], "text string")
    drawn = [r.doc_id for r in resample.drawn_documents(df, target, percent=10).collect()]
    assert len(drawn) == 40 and sum(d % 10 == 0 for d in drawn) > 35


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "word " * 25, 2, "s"), (2, "other " * 25, 3, "t")], "doc_id long, text string, weight int, `a.b` string")
    none = spark.createDataFrame([], "text string")
    got = resample.importance_resample(df, none, percent=50)
    assert got.columns == ["doc_id", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute([(1, "word " * 25), (2, "other " * 25)], [], percent=50)
    assert resample.importance_resample(df.limit(0), df).collect() == []
    assert resample.drawn_documents(df, df, percent=100).columns == df.columns


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    assert rows_of(queries.op11_importance_resampling(spark, sf_dir)) == brute(docs, target)


def test_shift_is_that_of_appended_bytes():
    shift, rng = resample.Shift(), np.random.default_rng(0)
    for n in (0, 1, 64, 65, 66, 12345):
        head, tail = rng.bytes(20), rng.bytes(n)
        got = shift(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(tail))
        assert got == zlib.crc32(head + tail)
