"""Each stage against a brute-force version on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from causeway.llm import toxicity
from causeway.llm.common import written
from causeway.llm.jaccard import Rule
from tests.llm.test_jaccard import brute as near
from tests.llm.test_substring import brute as passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "near_copies", "passages", "packing"]


def test_toxic_documents_go(spark, sf_dir, stages):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0]} - bad
    assert all(r.asDict() in [x.asDict() for x in stages[0]] for r in stages[1][:20])


def test_boilerplate_goes(stages):
    pages = Counter(r.source for r in stages[1])
    seen = Counter((r.source, x) for r in stages[1] for x in {x.strip(" ") for x in (r.text or "").split("\n")})
    after = {r.doc_id: r for r in stages[2]}
    assert len(after) == len(stages[1])
    for r in stages[1]:
        bad = lambda x: x and seen[r.source, x] >= 3 and seen[r.source, x] > 0.05 * pages[r.source]
        kept = "\n".join(x for x in r.text.split("\n") if not bad(x.strip(" "))) if r.text is not None else None
        assert after[r.doc_id].text == kept and after[r.doc_id].n_chars == (len(kept) if kept is not None else None)


def test_one_of_near_copies_stays(stages):
    want = {d for d, (_, c) in near([(r.doc_id, r.text) for r in stages[2]], Rule(5, 80, 100)).items() if d == c}
    assert {r.doc_id for r in stages[3]} == want and len(stages[3]) == len(want)


def test_passages_go(stages):
    want = passages([(r.doc_id, r.text) for r in stages[3]], 50)
    assert {r.doc_id: WORDS.findall(r.text or "") for r in stages[4]} == {d: kept for d, (_, kept) in want.items()}


def test_all_left_is_packed(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    by = {}
    for r in stages[5]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 1024


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "word " * 100, "en", None, 500), (3, "word " * 100, "en", None, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    left = [r.doc_id for r in docs.collect()]
    assert {1, 2, 3} <= set(left) and left.count(3) == 1  # of repeated rows one stays
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.collect() == []


def test_a_large_group_of_copies_keeps_one_whole_text(spark, sf_dir):
    page = lambda k: "\n".join(" ".join(f"w{k}x{j}y{i}" for i in range(20)) for j in range(10))
    base, other = page("copy"), page("other")
    for n in (9, 300):
        texts = [base] * (n // 6) + [base.replace(f"wcopyx{i % 10}y7", f"edit{i}", 1) for i in range(n // 6)]
        texts += [other + f"\nlast {i}" for i in range(n // 20)]
        texts += [f"menu of the site\n{page(i)}" for i in range(n - len(texts))]
        docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        docs = corpus_pipeline.drop_boilerplate(spark, docs, sf_dir)
        left = corpus_pipeline.keep_one_of_near_copies(spark, written(docs, "left"), sf_dir).collect()
        assert [r.text for r in left if "wcopy" in r.text] == [base]
        assert all(r.text for r in left) and not any("menu" in r.text for r in left)
        assert sum(other in r.text for r in left) == (n >= 20)
