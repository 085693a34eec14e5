import random
import zlib

import numpy as np
import pytest

from causeway.llm import queries, toxicity


def made(n=600, seed=1):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        y = int(rnd.random() < 0.25)
        if y:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["badone", "badtwo", "badthree"]))
        rows.append((i, " ".join(w), rnd.choice(["en", "fr"]), y))
    return rows


@pytest.fixture(scope="module")
def net():
    net = toxicity.fit(made())
    net.tables()
    return net


def scored(net, texts):
    out = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        rows, _ = toxicity.word_rows(data, np.array([0, len(data)]), toxicity.WordHasher(seed=3, lower=True), net.buckets)
        out.append(net.pooled(rows))
    return net.score(np.stack(out))


def test_learns_and_is_calibrated(net):
    test = made(400, seed=2)
    got = scored(net, [r[1] for r in test]) >= 0.3
    y = np.array([r[3] for r in test]) == 1
    assert (got == y).mean() > 0.97


def test_whole_of_long_texts_counts(net):
    filler = " ".join(f"word{i % 200}" for i in range(60_000))
    clean, toxic = scored(net, [filler, filler + " badone badtwo badthree"])
    assert clean < 0.3 <= toxic


def test_odd_rows_and_independence_of_language(spark, net):
    docs = [(1, None, None, 0), (2, "", "en", 0), (3, "badone badtwo badone", "en", 0), (4, "badone badtwo badone", "fr", 0), (5, "word1", "xx", 0), (5, "word1", "xx", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    got = toxicity.score_documents(df, None, net=net).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[3].score == by[4].score >= 0.3 and by[1].score == by[2].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, labels).collect()] == [0.0]
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_fit_rows_leave_the_held_out_fold(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.fit_rows(docs, labels, "toxic", 10_000)
    assert rows and all(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows)
    assert len(toxicity.fit_rows(docs, labels, "toxic", 7)) == 7
    assert 1 <= len(toxicity.fit_rows(docs, labels, "toxic", 10_000, most_bytes=20_000)) < len(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, p = got["toxic"] == 1, got["predicted"] == 1
    assert 2 * (y & p).sum() / (y.sum() + p.sum()) > 0.75


def small(seed=0, dtype=np.float64):
    """A net of few rows with weights of some size, and texts of word rows; one text is empty."""
    rng = np.random.default_rng(seed)
    net = toxicity.ConvNet(buckets=40, dim=3, widths=(1, 2, 3), filters=4).start()
    net.p = {k: rng.normal(0, 0.6, v.shape).astype(dtype) for k, v in net.p.items()}
    net.p["e"][0] = 0
    texts = [np.stack([rng.integers(20, 40, n), rng.integers(1, 20, n)], 1) for n in (5, 1, 12, 0, 7, 2)]
    return net, texts, np.array([1, 0, 1, 0, 0, 1], float)


def naive(net, rows):
    """Every filter at every place of one text, whose end is padded by rows of zeros."""
    emb = [net.p["e"][a] + net.p["e"][b] for a, b in rows] + [np.zeros(net.dim)] * (max(net.widths) - 1)
    out = []
    for w in net.widths:
        for f in range(net.filters):
            best = 0.0
            for t in range(len(rows)):
                total = net.p[f"c{w}"][f]
                for j in range(w):
                    for d in range(net.dim):
                        total += emb[t + j][d] * net.p[f"w{w}"][j, d, f]
                best = max(best, total)
            out.append(best)
    return np.array(out)


def test_convolution_and_pooling_against_loops():
    net, texts, _ = small()
    net.tables()
    for rows in texts:
        assert net.pooled(rows) == pytest.approx(naive(net, rows), abs=1e-5)


def test_gradients_against_differences():
    """One step's gradients, which the first moments hold, against the loss at weights a little to either side."""
    net, texts, y = small(1)
    texts, y = [t for t in texts if len(t)], y[[0, 1, 2, 4, 5]]

    def loss():
        z = np.array([naive(net, t) @ net.p["out"] + net.p["b"][0] for t in texts])
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.5e-4 * (net.p["out"] ** 2).sum()

    rng, differences = np.random.default_rng(2), {}
    for key, value in net.p.items():
        for i in rng.permutation(value.size)[:25]:
            at = np.unravel_index(i, value.shape)
            if key == "e" and at[0] == 0:
                continue
            was, h = value[at], 1e-6
            value[at] = was + h
            up = loss()
            value[at] = was - h
            differences[key, at] = (up - loss()) / (2 * h)
            value[at] = was
    pad = max(net.widths) - 1
    rows = np.concatenate([np.concatenate([t, np.zeros((pad, 2), np.int64)]) for t in texts])
    begin = np.cumsum([0] + [len(t) + pad for t in texts])[:-1]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    net._step(rows, begin, y, moments, 1, 0.01)
    assert len(differences) > 100 and sum(abs(d) > 1e-3 for d in differences.values()) > 40
    for (key, at), want in differences.items():
        assert moments[key][0][at] / 0.1 == pytest.approx(want, abs=2e-6), (key, at)
    assert not net.p["e"][0].any()


def test_best_cut_against_all_cuts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        score, y = rng.normal(size=30).round(1), (rng.random(30) < 0.4).astype(float)
        if not 0 < y.sum() < 30:
            continue
        f1 = lambda c: 2 * (y * (score >= c)).sum() / ((score >= c).sum() + y.sum())
        cuts = np.append(np.unique(score), score.max() + 1)
        assert f1(toxicity.best_cut(score, y)) == pytest.approx(max(map(f1, cuts)))


def test_thresholds_by_language(spark):
    """Each language's threshold lies half way between the common cut and its own best one on the rows held back."""
    rnd, rows = random.Random(4), []
    for i in range(1500):
        lang = ("en", "fr", "xx")[0 if i % 20 else 2] if i % 2 else "fr"
        y = int(rnd.random() < 0.35)
        words = [f"{lang}{rnd.randrange(100)}" for _ in range(rnd.randint(5, 30))]
        # in French the bad words are seen in clean texts as well
        if y or (lang == "fr" and rnd.random() < 0.2):
            words += [rnd.choice(["badone", "badtwo"]) for _ in range(3 if y else 1)]
        rows.append((i, " ".join(words), lang, y))
    net = toxicity.fit(rows)
    net.tables()
    held = [r for r in rows if zlib.crc32(b"calibrate %d" % r[0]) % 5 == 0]
    pooled = []
    for r in held:
        data = np.frombuffer(r[1].encode(), np.uint8)
        pooled.append(net.pooled(toxicity.word_rows(data, np.array([0, len(data)]), toxicity.WordHasher(seed=3, lower=True), net.buckets)[0]))
    logit, y, langs = net.logit(np.stack(pooled)).astype(float), np.array([r[3] for r in held], float), np.array([r[2] for r in held])
    middle = toxicity.best_cut(logit, y)
    want = {}
    for lang in ("en", "fr", "xx"):
        own = langs == lang
        if 10 <= y[own].sum() < own.sum():
            at = (toxicity.best_cut(logit[own], y[own]) + middle) / 2
            want[lang] = 1 / (1 + np.exp(-(net.slope * at + net.shift)))
    assert net.thresholds == pytest.approx(want) and {"en", "fr"} <= set(want)
    df = spark.createDataFrame([(*r[:3], r[3]) for r in rows] + [(9000, "en1 badone", None, 0), (9001, "en1 badone", "de", 0)], "doc_id long, text string, lang string, y int")
    for r in toxicity.score_documents(df, None, net=net).join(df.select("doc_id", "lang"), "doc_id").collect():
        assert r.flagged == (r.score >= net.thresholds.get(r.lang, 0.3)) and r.predicted == int(r.score >= 0.3)
