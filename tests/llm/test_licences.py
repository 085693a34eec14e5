from causeway.llm import licences


def test_finds_templates_and_edits(spark):
    mit = licences.TEMPLATES["mit-text"]
    texts = [
        "Released under the MIT License.", "text\n  RELEASED under the mit license!!\nmore words here", mit.replace("Software", "Program", 1),
        "intro\n\n" + "\n".join(mit[i : i + 80] for i in range(0, len(mit), 80)) + "\n\nend", "nothing to see", "", None, "license", "a " * 30_000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    got = {r.doc_id: [m.template for m in r.matches] for r in licences.scan(df).collect()}
    assert got[0] == got[1] == ["mit"] and got[2] == ["mit-text"]
    assert got[4] == got[5] == got[6] == got[7] == got[8] == []


def test_paragraph_over_lines(spark):
    text = "x\n\nReleased under\nthe MIT License.\n\ny"
    (row,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(m.template, m.dice, m.passage) for m in row.matches] == [("mit", 1.0, "Released under\nthe MIT License.")]


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(same_as_sql):
    same_as_sql("op3_licence_scan")


def test_families_ties_and_repeated_rows(spark):
    texts = {n: t for n, t in licences.TEMPLATES.items()}
    rows = [(i, f"Some prose.\n{t}\nMore prose.") for i, t in enumerate(texts.values())] * 2
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        best = max(r.matches, key=lambda m: m.dice)
        assert best.template == list(texts)[r.doc_id] and best.dice == 1.0
    twins = {"b": "One and the same text here", "a": "One and the same text here"}
    r = licences.scan(spark.createDataFrame([(1, twins["a"])], "doc_id long, text string"), twins).first()
    assert [m.template for m in r.matches] == ["a"]
