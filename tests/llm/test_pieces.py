import itertools
import math
import random

import public_tokenizers
import pytest

from causeway.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def every(model, text):
    """All segmentations of a short text: (score, ids)."""
    if not text:
        return [(0.0, [])]
    shown = pieces.MARK + text.replace(" ", pieces.MARK)
    out = []
    for cuts in itertools.product([0, 1], repeat=len(shown) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(shown)]
        score, ids = 0.0, []
        for s, e in zip(at, at[1:]):
            w = model.score.get(shown[s:e])
            if w is None:
                if e - s > 1:
                    break
                w = model.penalty
            score += w
            ids += model.ids_of(shown, s, e)
        else:
            out.append((score, ids))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", "a", "hello", "the end", "a, b.", "x\ny z", "日本𓀀", "a  b", " in the", "l'été", "don't 12"])
def test_nbest_against_all_segmentations(model, text):
    want = every(model, text)
    got = [(s, i.tolist()) for s, i in model.nbest(text, 6)]
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert all((s, i) in want for s, i in got)
    assert len({tuple(i) for _, i in got}) == len(got)
    assert got[0][0] == want[0][0] and model.encode(text) == got[0][1]
    assert all(model.decode(i) == text for _, i in got)


def test_chunks_are_exact_cuts(model):
    rnd = random.Random(0)
    for _ in range(60):
        text = "".join(rnd.choice("ab,.' \n-é(1") for _ in range(10))
        chunked = model.nbest(text, 4)
        shown = pieces.MARK + text.replace(" ", pieces.MARK)
        assert "".join(model.chunks(text)) == shown
        whole = model.search(shown, 4)
        assert all(math.isclose(a[0], b[0]) for a, b in zip(chunked, whole)) and len(chunked) == len(whole)


def test_learning_together_equals_one_by_one(model):
    rnd = random.Random(4)
    chunks = {pieces.MARK + "".join(rnd.choice("etaoinshré日𓀀") for _ in range(rnd.randint(1, 20))) for _ in range(2000)}
    together, single = pieces.PieceModel(PATH), pieces.PieceModel(PATH)
    together.learn(list(chunks))
    assert all(together.entry(c) == single.best(c) for c in chunks)


def test_documents_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "▁ tricky"), (-4, "\x00\x7f é")], docs.schema)
    encoded = pieces.encode_documents(docs.union(odd.where("doc_id <> -3")), PATH)
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded, PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.union(odd.where("doc_id <> -3")).collect()}


def test_query_restores_all(spark, sf_dir):
    from causeway.llm import queries

    got = queries.op2_pieces(spark, sf_dir)
    assert got.where("not restored or size(scores) < 1").count() == 0
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.limit(0).collect() == []


def test_a_long_unbroken_word_takes_linear_memory(model):
    import tracemalloc

    rnd = random.Random(6)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    tracemalloc.start()
    got = model.nbest(word, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1000 * len(word)
    assert len(got) == 3 and got[0][0] >= got[1][0] >= got[2][0]
    assert len({tuple(i) for _, i in got}) == 3 and all(model.decode(i) == word for _, i in got)


def test_numbers_start_anew_when_many_are_remembered(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    small = pieces.PieceModel(PATH)
    for i in range(40):
        text = " ".join(f"word{i * 7 + j}" for j in range(9))
        assert small.encode(text) == model.encode(text)


def test_odd_tables(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(str, (tuple(r) for r in pieces.segmentations(df, PATH).collect())))
    assert len(got) == 4 and got[0] == got[1]
    assert pieces.segmentations(df.limit(0), PATH).collect() == []
