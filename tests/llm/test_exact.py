import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.llm import exact

LOWER = str.maketrans(exact.LETTERS, exact.LETTERS.lower())


def brute(rows):
    """The rows' (id, keep_id, group_size, kept, sha256), by a dictionary of whole texts."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return sorted(out, key=str)


def found(spark, rows, block, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return exact.exact_dedup(df, block=block)


@pytest.mark.parametrize("block", [1, 16, 4096])
def test_against_brute_force(spark, block):
    rnd = random.Random(block)
    texts = ["", "a", "A", "aa", "ab" * 8, "ab" * 8 + "c", "É", "é", "日本", "x" * 47, "x" * 48, "x" * 49, "X" * 48, None]
    texts += ["".join(rnd.choice("abAB") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    rows = [(i, rnd.choice(texts)) for i in range(200)] + [(None, "aa"), (None, "aa"), (None, "only null ids"), (7, "two texts"), (7, "Two texts"), (7, "of one id")]
    rows += [(3, "repeated row"), (3, "repeated row")]
    got = found(spark, rows, block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == brute(rows)
    # one identity for one text, whatever its length
    assert len({r.identity for r in got}) == len({r.text_sha256 for r in got}) == len({(r.identity, r.text_sha256) for r in got})


def test_names_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [(i, t) for i, t in enumerate(["b", "a", "c", "a", "B", "abc", "abcd", "abcdefgh"])]
    runs = [{r.doc_id: r.identity for r in found(spark, rows, 2, parts).collect()} for parts in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]
    one = runs[0]
    assert one[1] == one[3] and one[0] == one[4] and len(set(one.values())) == 6


def test_a_value_over_many_parts_gets_one_name(spark):
    """The copies of one text are dealt to many parts of the sort."""
    rows = [(i, "the same text of two blocks") for i in range(3000)] + [(5000 + i, f"{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    table, last = exact.named(exact.cut_into_blocks(df, 16), ["content"], 10, 1)
    got = table.groupBy("name").count().collect()
    assert last == 10 + 42 and sorted(r["count"] for r in got) == [1] * 40 + [3000, 3000]
    assert table.select("name").distinct().count() == 42
    assert {r.group_size for r in exact.exact_dedup(df, "id", "text", 16).collect()} == {1, 3000}


def test_contents_of_one_hash_at_the_edge_of_a_part(spark):
    """Where the short key ties, contents that mix over the parts are sorted anew, to the same names."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, "abcd"[i % 4] * 9) for i in range(2000)], "id long, text string").repartition(4)
        blocks = exact.cut_into_blocks(df, 4096)
        parts = blocks.withColumn("hash", F.lit(1)).repartitionByRange("hash", "id", "place")
        sizes = [r["count"] for r in parts.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 1000  # one hash is many tasks
        names = []
        for hashed in (F.lit(1), F.ascii("content") % 2, F.ascii("content")):
            table, last = exact.named(blocks.withColumn("hash", hashed), ["hash", "content"], 0, 1)
            assert last == 4 and all(r["count"] == 500 for r in table.groupBy("name").count().collect())
            names.append({r.id: r.name for r in table.collect()})
        assert names[0] == names[2] and names[0][0] == 1 and names[1][0] == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_text_empty_table_and_clashing_names(spark):
    long = "word " * 40_000
    rows = [(1, long, "n", 1), (2, long.upper(), "m", 2), (3, long + "x", None, 3), (3, long + "x", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, identity int")
    got = exact.kept_documents(df).collect()
    assert df.columns == exact.kept_documents(df).columns
    assert sorted((r.doc_id, r.identity) for r in got) == [(2, 2), (3, 3)]
    none = spark.createDataFrame([], df.schema)
    assert exact.exact_dedup(none).collect() == [] and exact.kept_documents(none).collect() == []


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "A"), (None, "a")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact.exact_dedup(df).collect()) == [("None", "u2", False), ("u1", "u2", False), ("u2", "u2", True)]


def test_query(same_as_sql):
    same_as_sql("op12_exact_dedup")
