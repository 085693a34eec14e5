import numpy as np
import pytest

from causeway.llm import images, queries

SCHEMA = "image_id long, image binary, node string"


def mosaic(seed, side=96, cell=4):
    rng = np.random.default_rng(seed)
    n = side // cell
    return np.kron(128 + np.where(rng.random((n, n)) < 0.5, -1, 1) * (30 + 60 * rng.random((n, n))), np.ones((cell, cell)))


def brute(pictures, reach=7, least=5):
    """Links between all pairs of images by comparing every two descriptors."""
    data = {i: images.describe(images.decode(b)) for i, b in pictures.items()}
    links = set()
    for a in data:
        for b in data:
            if a >= b:
                continue
            xa, ya, sa, ta, ba = data[a]
            xb, yb, sb, tb, bb = data[b]
            if not len(xa) or not len(xb):
                continue
            apart = np.bitwise_count(ba[:, None] ^ bb[None]).sum(2)
            votes = {}
            for p, q in np.argwhere(apart <= reach):
                zoom, turn = np.float32(sb[q]) / np.float32(sa[p]), np.float32(tb[q]) - np.float32(ta[p])
                dx = xb[q] - zoom * (np.cos(turn) * xa[p] - np.sin(turn) * ya[p])
                dy = yb[q] - zoom * (np.sin(turn) * xa[p] + np.cos(turn) * ya[p])
                for half in (0, 0.5):
                    key = (half, round(float(np.log2(zoom)) * 2), round(turn / (np.pi / 8)) % 16, np.floor(dx / 12 + half), np.floor(dy / 12 + half))
                    votes.setdefault(key, (set(), set()))
                    votes[key][0].add(p), votes[key][1].add(q)
            if any(min(map(len, v)) >= least for v in votes.values()):
                links.add((a, b))
    return links


def test_copies_as_by_brute_force(spark):
    pictures = {}
    for s in range(12):
        g = mosaic(s)
        pictures[s] = images.encode(g)
        if s % 3 == 0:
            pictures[100 + s] = images.encode(g[12:, 8:90] * 0.7)
            pictures[200 + s] = images.encode(np.pad(g, 10, constant_values=20))
            pictures[300 + s] = images.encode(np.rot90(g))
    df = spark.createDataFrame([(i, bytearray(b), "") for i, b in pictures.items()], SCHEMA)
    got = {r.image_id: r.copy_id for r in images.find_copies(df).collect()}
    root = {i: i for i in pictures}
    for _ in range(4):
        for a, b in brute(pictures):
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert all(got[100 + s] == got[200 + s] == s for s in range(0, 12, 3))
    assert all(got[s] == s for s in range(12))


def test_many_edits_of_one_image(spark):
    g = mosaic(1)
    rows = [(i, bytearray(images.encode(g[i % 7 :, i // 7 :] * (0.6 + i / 100))), "") for i in range(40)]
    got = images.find_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.copy_id for r in got} == {0}


def test_number_of_links_as_by_brute_force(spark):
    g = mosaic(3)
    pictures = {i: images.encode(g[i % 4 :, i // 4 :] * (0.7 + i / 100)) for i in range(16)} | {50: images.encode(mosaic(4))}
    links = brute(pictures)
    df = spark.createDataFrame([(i, bytearray(b), "") for i, b in pictures.items()], SCHEMA)
    got = {r.image_id: r.n_links for r in images.find_copies(df).collect()}
    assert got == {i: sum(i in link for link in links) for i in pictures}
    assert got[0] > 10 and got[50] == 0


def test_odd_images(spark):
    same = bytearray(images.encode(mosaic(2)))
    rows = [(1, None, ""), (2, None, ""), (3, bytearray(b""), ""), (4, bytearray(b"junk"), ""), (5, same, ""), (6, same, ""), (6, same, ""), (7, bytearray(images.encode(np.full((5, 5), 9))), "")]
    got = sorted((r.image_id, r.copy_id) for r in images.find_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7)]


def test_empty(spark):
    assert images.find_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_finds_the_edited_copies(spark, sf_dir):
    got = {r.image_id: r.copy_id for r in queries.op4_image_copies(spark, sf_dir).collect()}
    edited = [i for i in got if i % 4]
    assert len(edited) == 100
    assert sum(got[i] == got[i - i % 4] for i in edited) >= 98
    assert all(got[i] == i for i in got if i % 4 == 0)
