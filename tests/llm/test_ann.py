import math
from decimal import Decimal

import numpy as np
import pytest

from causeway.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, vector string"


def exact(x, ids, q, own, k):
    s = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != own][:k]


@pytest.mark.parametrize("shard_nodes", [300, 8192])
def test_recall_against_brute_force(spark, shard_nodes):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(ann.build_index(vectors, shard_nodes=shard_nodes), vectors.where("vec_id % 50 = 0"), k=5).toPandas()
    rows = vectors.toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        want = exact(x, ids, x[i], ids[i], 5)
        mine = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert (np.diff(mine["score"]) <= 0).all()
        hit += len({v for v, _ in want} & set(mine["vec_id"]))
        total += 5
        score = dict(exact(x, ids, x[i], ids[i], len(ids)))
        assert all(math.isclose(score[v], s, abs_tol=1e-12) for v, s in zip(mine["vec_id"], mine["score"]))
    assert hit / total >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], ""), (1, None, ""), (2, [0.0, 0.0], ""), (3, [1.0, None], ""), (4, [nan, 1.0], ""), (5, [inf, 1.0], ""),
            (9, [1.0, 0.0], ""), (7, [1.0, 0.0], ""), (8, [0.0, 2.0], ""), (50, [], ""), (100, [1.0, 2.0, 3.0], ""), (7, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in ann.nearest(ann.build_index(df), df.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 9, 1.0), (0, 3, 8, 0.0)]


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.5], "") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(ann.build_index(df), df.where("vec_id = 400"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4, 5, 7]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(ann.build_index(df), df).collect() == []


def test_query(spark, sf_dir):
    got = queries.op5_nearest_neighbours(spark, sf_dir)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert got.count() == 5 * 10


def test_an_index_with_too_few_ids_is_an_error(spark):
    rows = [(i, [1.0, 0.0]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        ann.nearest(ann.build_index(vectors), vectors, k=6)
    got = ann.nearest(ann.build_index(vectors, most_ids=8), vectors.where("vec_id = 3"), k=7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5, 6, 7]


def test_colinear_vectors_tie_and_scale_does_not_matter(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(50, [2.0, 1.0, 5.0])] + [(i, [i * c for c in base]) for i in (3, 7, 11, 13, 49)]
    rows += [(100, [3e200, 6e200, 9e200]), (101, [3e-200, 6e-200, 9e-200])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(ann.build_index(vectors), vectors.where("vec_id = 50"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 7, 11, 13, 49]
    assert {r.score for r in got} == {float(Decimal(19) / Decimal(14 * 30).sqrt())}
    far = ann.nearest(ann.build_index(vectors), vectors.where("vec_id = 100"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in far] == [(i, 1.0) for i in (3, 7, 11, 13, 49)]


def test_clashing_columns(spark):
    rows = [(i, [1.0, float(i)], "x", 1) for i in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, rank int")
    got = ann.nearest(ann.build_index(vectors), vectors.where("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]


def test_every_node_has_a_home_that_a_path_leads_to():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16))
    x = np.repeat(centres, 150, axis=0) + rng.normal(size=(600, 16)) * 1e-7
    nodes = np.unique(ann.unit(x).astype(np.float32), axis=0)
    graph = ann.Graph(nodes, degree=8, beam=16)
    home = graph.homes()
    met, front = {graph.start}, [graph.start]
    while front:
        near = [int(n) for n in graph.edges[front.pop()] if n >= 0 and int(n) not in met]
        met.update(near)
        front += near
    assert set(home.tolist()) <= met
    assert all(home[i] == i for i in met)
    assert (np.abs(nodes - nodes[home]).max(1) < 1e-5).mean() > 0.9


def test_shards_grow_with_the_root_of_the_vectors_within_memory():
    size = [ann.shard_size(n, 64) for n in (2000, 51282, 615000, 22_000_000)]
    assert size[0] == size[1] == ann.SHARD_NODES and size[3] == ann.MOST_NODES
    assert 19_000 < size[2] < 22_000 and ann.shard_size(22_000_000, 4096) == 2048


def test_a_graph_of_many_vectors_is_made_by_products_and_found_again():
    rng = np.random.default_rng(3)
    x = ann.unit(rng.normal(size=(6000, 32))).astype(np.float32)
    prune = ann.Graph._prune
    rows = []

    def counted(self, points, pool, degree):
        rows.append(len(points))
        return prune(self, points, pool, degree)

    ann.Graph._prune = counted
    try:
        graph = ann.Graph(x)
    finally:
        ann.Graph._prune = prune
    assert sum(rows) == 2 * 6000  # near and opposite edges of each node, without a search
    met, dist = graph.search(x[:300], 64)
    want = np.argsort(-(x[:300] @ x.T), 1)[:, :6]
    assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(want.tolist(), met.tolist())]) >= 0.95
    assert (met[:, 0] == np.arange(300)).all() and (np.diff(dist, axis=1) >= 0).all()
    assert all(len(set(m)) == 64 for m in met.tolist())


def test_an_id_of_many_vectors_does_not_hide_others(spark):
    rows = [(50, [1.0, i / 1000]) for i in range(20)] + [(i, [1.0, float(i)]) for i in range(1, 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(ann.build_index(vectors), vectors.where("vec_id = 50 and embedding[1] = 0"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
