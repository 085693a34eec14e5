import random
import re

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import jaccard, queries
from causeway.llm.jaccard import Rule

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, rule):
    """{doc_id: (set size, least id reachable)} by comparing every pair that shares a shingle."""
    sets = {d: shingles(t, rule.n) for d, t in docs}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        common = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, both in common.items():
            if rule.links(both, len(s), len(sets[e])):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(rnd, size, words, vocabulary):
    base = [rnd.choice(vocabulary) for _ in range(words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, max(1, words // 40))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        yield " ".join(w)


def made(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "A b C d", "a b c d e", "x " * 50, "x " * 70]
    for size, words in ((150, 120), (40, 30), (60, 300), (20, 12), (5, 2000), (30, 8)):
        texts += family(rnd, size, words, vocabulary)
    common = " ".join(rnd.choice(vocabulary) for _ in range(40))
    texts += [common + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(120)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rule", [Rule(4, 85, 100), Rule(5, 80, 100)])
def test_against_brute_force(spark, rule, monkeypatch):
    docs = made(rule.n)
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, node string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, rule).collect()}
    assert got == brute(docs, rule)


def test_prefixes_of_linked_sets_share_a_signature():
    rng, rule = np.random.default_rng(1), Rule(4, 85, 100)
    for trial in range(3000):
        size = int(rng.integers(1, 400))
        union = rng.permutation(1 << 12)[: size * 2].astype(np.uint64) + np.uint64(1)
        x = np.sort(union[:size])
        drop, more = rng.integers(0, size // 8 + 1), rng.integers(0, size // 8 + 1)
        y = np.sort(np.concatenate([x[rng.permutation(size)[drop:]], union[size : size + more]]))
        both = len(np.intersect1d(x, y))
        if not len(y) or not rule.links(both, len(x), len(y)):
            continue
        often = lambda s: ((s * np.uint64(2654435761)) % np.uint64(97)).astype(np.uint8)
        a, b = sorted((x, y), key=len)
        (sa, small, _), (sb, _, _) = jaccard.signatures(a, often(a), rule), jaccard.signatures(b, often(b), rule)
        assert np.intersect1d(sa[small], sb).size, (len(a), len(b), both)


def test_bitmaps_never_part_linked_sets():
    rng, rule = np.random.default_rng(2), Rule(4, 85, 100)
    for _ in range(300):
        size = int(rng.integers(20, 3000))
        x = rng.integers(0, 1 << 62, size).astype(np.uint64)
        y = x[int(size * 0.15 * rng.random()) :]
        apart = jaccard.Bitmaps(pa.array([jaccard.bitmap(s) for s in (x, y)])).apart(np.array([0]), np.array([1]))
        assert apart[0] <= len(x) - len(y)
        assert jaccard.may_link(rule, apart, np.array([len(x)]), np.array([len(y)])) or not rule.links(len(y), len(x), len(y))


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(50)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == r for n, r in root.items())


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(rows, Rule(4, 85, 100))


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_of_one_pattern_are_told_apart(spark):
    for n in (16, 32, 64, 128, 2048):
        a, b = thue_morse(n)
        df = spark.createDataFrame([(1, f"{a} {b} {a} {a}"), (2, f"{b} {a} {b} {b}")], "doc_id long, text string")
        assert sorted(tuple(r) for r in jaccard.jaccard_components(df, Rule(4, 85, 100)).collect()) == [(1, 1, 1), (2, 1, 2)]


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Every member is near its neighbours in a chain of edits; blocks and pieces are small, so that groups are split."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 64)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(50)}"
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, Rule(5, 80, 100)).collect()}
    assert got == brute(docs, Rule(5, 80, 100))


def test_blocks_pass_on_forests(spark):
    """Pairs of a group whose members all may link grow linearly with it; failed ones make way for others."""
    n = 300
    bits = bytes(64)
    rows = [(1, i, 50, True, 0, 0, 0) for i in range(n)]
    members = spark.createDataFrame(rows, "sig long, node long, size int, small boolean, own int, i int, j int")
    info = spark.createDataFrame([(i, bytearray(bits)) for i in range(n)], "node long, bits binary")
    roots = spark.createDataFrame([], "node long, root long")
    met = jaccard.crossing(members, roots, info, None, Rule(), 1).collect()
    assert len(met) == n - 1 and all(r.a < r.b for r in met)
    failed = spark.createDataFrame(met[:100])
    more = jaccard.crossing(members, roots, info, failed, Rule(), 2).collect()
    assert n - 1 <= len(more) <= 2 * (n - 1) and not {(r.a, r.b) for r in more} & {(r.a, r.b) for r in met[:100]}


def test_odd_ids(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (9, None), (None, None), (8, "A b c D e")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(None, 1, 7), (7, 1, 7), (9, 0, 9), (None, 0, None), (8, 1, 7)]))


def test_classes_hold_when_texts_outgrow_the_sketch():
    rng = np.random.default_rng(3)
    cells = jaccard.Cells(np.zeros(1 << 10, np.uint32))
    once, often = rng.integers(1, 1 << 62, 200_000).astype(np.uint64), rng.integers(1, 1 << 62, 20).astype(np.uint64)
    cells.add(once)
    for _ in range(2000):
        cells.add(often)
    cells.level = int(np.median(cells.data))
    assert (cells.estimate(often) >= cells.rare_below()).all()
    assert (cells.estimate(once) < cells.rare_below()).mean() > 0.9


def test_hot_keys_of_components_are_split(spark, monkeypatch):
    """Most rows on one key: the plans that ran split the joins with the minima."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    skewed, write = [], jaccard.written

    def seen(df, name):
        if name in ("large", "edges"):
            df.collect()
            skewed.extend([name] * ("skew=true" in df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        star = [(0, i) for i in range(1, 20_000)] + [(30_000 + 2 * i, 30_001 + 2 * i) for i in range(500)]
        monkeypatch.setattr(jaccard, "written", seen)
        roots = {r.node: r.root for r in jaccard.components(spark.createDataFrame(star, "a long, b long").repartition(8)).collect()}
        assert all(roots[i] == 0 for i in range(1, 20_000)) and all(roots[30_001 + 2 * i] == 30_000 + 2 * i for i in range(500))
        assert "large" in skewed
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_helper_tables_are_few_and_in_few_files(spark, monkeypatch):
    """Where many partitions stay as they are, a round of components makes two tables, each of a file a core at most."""
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in many}
    files, write = [], jaccard.written

    def counted(df, name):
        out = write(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(jaccard, "written", counted)
        chains = [(i, i + 1) for i in range(4000) if i % 20]
        links = spark.createDataFrame(chains, "a long, b long").repartition(8)
        roots = {r.node: r.root for r in jaccard.components(links).collect()}
        assert all(roots[b] == (b - 1) // 20 * 20 + 1 for _, b in chains)
        assert {name for name, _ in files} == {"edges", "large"}
        assert max(n for _, n in files) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
