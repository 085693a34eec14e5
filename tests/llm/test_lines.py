from causeway.llm import lines


def test_drops_what_exceeds_the_ratio_on_its_host(spark):
    rows = [(i, f"menu\nunique {i}\n  menu  \n\nfooter" if i < 8 else f"menu\nonly {i}", "a" if i < 8 else "b", 1) for i in range(20)]
    rows += [(90, None, "a", 1), (91, "", "a", 1), (92, "menu", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    got = {r.doc_id: r for r in lines.line_dedup(df, ratio=0.5, least_pages=3).collect()}
    assert got[0].text == "unique 0\n" and got[0].n_lines == 5 and got[0].n_removed == 3
    assert got[9].text == "only 9"
    assert got[90].text is None and got[90].n_lines == 0
    assert got[91].text == "" and got[91].n_removed == 0
    assert got[92].text == "menu"


def test_salted_join_gives_the_same(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, lines.line_dedup(df).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, lines.line_dedup(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_query(same_as_sql):
    same_as_sql("op1_line_dedup")


def test_clashing_names_repeated_rows_and_long_texts(spark):
    long = "\n".join(f"own {i}" for i in range(20_000))
    rows = [(i, f"menu\npage {i}", "h", "bp", "l", "k", 7) for i in range(10)] + [(10, long + "\nmenu", "h", None, None, None, 8)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bp_host string, bp_lines string, bp_kept string, n_lines int")
    got = lines.line_dedup(df, ratio=0.3).orderBy("doc_id").collect()
    assert [r.text for r in got] == [*(f"page {i}" for i in range(10)), long, long]
    assert {(r.bp_host, r.bp_lines, r.bp_kept, r.n_lines, r.n_removed) for r in got} == {("bp", "l", "k", 2, 1), (None, None, None, 20_001, 1)}
