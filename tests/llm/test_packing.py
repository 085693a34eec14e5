import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from causeway.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_equals_tokenizers(reference):
    bpe = packing.byte_bpe(PATH)
    for text in ["", " ", "a  b\n\n c", "naïve Ünïcode 日本語 🙂", "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n b <|endof", "x" * 3000, "don't we'll 12345 --- !!", "a" + " " * 100_000 + "b\n" + "\t" * 5000]:
        assert [*bpe.encode(text), 2] == reference(text)


def test_pieces_tile_documents_and_sequences(spark, reference):
    texts = [None, "", "word " * 5000, "a b c", "a b c", *(f"doc {i} " * (i % 90) for i in range(300))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = packing.best_fit(docs, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(reference(text or ""), "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == 1024 for r in got[1:])
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / 1024 + 1


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (4, 7, 5)] == [(0, 0), (1, 0), (0, 4)]
    assert bins.place(9) == (2, 0)  # the fullest of three: it closes itself or the bin with least room goes
    assert bins.open <= 2


def test_cut_leaves_the_rest_first():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def naive(sizes, capacity, most_open):
    """(bin, offset) by looking at every open bin: the fullest that has room, else a new one; the fullest closes first."""
    used, open_bins, out = [], [], []
    for n in sizes:
        fits = [b for b in open_bins if used[b] + n <= capacity]
        if fits:
            b = max(fits, key=lambda b: (used[b], open_bins.index(b)))
            open_bins.remove(b)
        else:
            used.append(0)
            b = len(used) - 1
        out.append((b, used[b]))
        used[b] += n
        if used[b] < capacity:
            if len(open_bins) >= most_open:
                fullest = max(open_bins, key=lambda o: (used[o], open_bins.index(o)))
                if used[fullest] <= used[b]:
                    continue
                open_bins.remove(fullest)
            open_bins.append(b)
    return out


def test_bins_against_a_naive_search():
    rng = np.random.default_rng(4)
    for capacity, most_open in ((10, 3), (50, 1), (100, 8), (1024, 64)):
        sizes = rng.integers(1, capacity + 1, 600).tolist()
        bins = packing.Bins(capacity, most_open)
        assert [bins.place(n) for n in sizes] == naive(sizes, capacity, most_open)


def test_null_ids_are_packed(spark):
    rows = packing.best_fit(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 1), ("None", 3), ("None", 3)]
