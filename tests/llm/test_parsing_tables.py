from weftgraph.llm.parsing import unparsed


def test_tables(spark):
    rows = [("r/a.py", "x = 1\n", "py", True)] * 2 + [("r/b.PY", "x = (\n", "", True), ("r/c.json", "{}", "", True), ("r/d.go", None, "", True), ("r/e.js", "", "", True), ("r/f.txt", "((", "", True), (None, "((", "", True), ("r/g.ts", "const a = {\n" + "b: 1,\n" * 20000, "", True), ("r/h.c", "int x;\n", "", True), ("r/h.c", "int x", "", True)]
    df = spark.createDataFrame(rows, "id string, content string, lang string, ok boolean")
    got = {r["id"]: r["ok"] for r in unparsed(df).collect()}
    assert got == {"r/a.py": True, "r/b.PY": False, "r/c.json": True, "r/g.ts": False, "r/h.c": False}
    assert unparsed(df.limit(0)).count() == 0


def test_comments_alone_are_valid(spark):
    df = spark.createDataFrame([("a.js", "// x\n"), ("b.c", "/* y */"), ("c.py", "# z\n"), ("d.json", "  ")], "id string, content string")
    assert {r["id"]: r["ok"] for r in unparsed(df).collect()} == {"a.js": True, "b.c": True, "c.py": True, "d.json": False}
