import json

from pyspark.sql import functions as F

from weftgraph.functions import extract
from weftgraph.operators import search, symbols
from weftgraph.streaming import live


def test_alias_chase(spark):
    al = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z"), ("p", "q", "r", "q"), ("r", "q", "p", "q")], "file string, exported string, source string, orig string")
    want = spark.createDataFrame([("a", "x"), ("b", "y"), ("p", "q"), ("n", "n")], "file string, name string")
    got = {(r["file"], r["name"]): (r["target_file"], r["target_name"], r["steps"]) for r in symbols.chase_aliases(want, al).collect()}
    assert got["a", "x"] == ("c", "z", 2) and got["b", "y"] == ("c", "z", 1) and got["n", "n"] == ("n", "n", 0) and got["p", "q"][2] == 6


def test_dispatch_caps(spark):
    ext = spark.createDataFrame([(f"S{i:02}", "B") for i in range(30)] + [("T", "S00")], "cls string, base string")
    has = spark.createDataFrame([(f"S{i:02}", "m") for i in range(30)] + [("T", "m")], "cls string, method string")
    calls = spark.createDataFrame([("c1", "B", "m"), ("c2", "S00", "m"), ("c3", "T", "m")], "call string, cls string, method string")
    got = symbols.dispatch(calls, ext, has).collect()
    assert sum(r["call"] == "c1" for r in got) == 24 and all(r["capped"] for r in got if r["call"] == "c1")
    assert [(r["target"], r["capped"]) for r in got if r["call"] == "c2"] == [("T.m", False)] and not any(r["call"] == "c3" for r in got)


def test_flow_and_argument_reach(spark):
    text = "def a(x, y):\n    z = x\n    b(z, 1)\n    y = y + 1\n    b(2, y)\n    return c(x)\n\ndef b(p, q):\n    return p\n\ndef c(w):\n    w = w + 1\n    d(w)\n\ndef d(v):\n    pass\n"
    flow = extract.python_flow(spark.createDataFrame([("m.py", text), ("bad.py", "def ("), ("n.js", "x")], "id string, content string"))
    args = {(r["fn"], r["name"], r["arg"], r["origin"]) for r in flow.where("fact = 'arg'").collect()}
    assert args == {("a", "b", 0, "param:x"), ("a", "b", 1, "literal"), ("a", "b", 0, "literal"), ("a", "b", 1, "unknown"), ("a", "c", 0, "param:x"), ("c", "d", 0, "unknown")}
    got = {(r["fn"], r["param"], r["depth"]) for r in symbols.argument_reach(flow, "a", "x").collect()}
    assert got == {("a", "x", 0), ("b", "p", 1), ("c", "w", 1)}


def test_versions_of_symbols(spark):
    s = "file string, name string, signature string"
    old = spark.createDataFrame([("f", "a", "1"), ("f", "b", "1"), ("f", "c", "1"), ("f", "c", "2")], s)
    new = spark.createDataFrame([("f", "a", "2"), ("f", "b", "1"), ("f", "c", "3"), ("f", "n", "1")], s)
    assert [tuple(r) for r in symbols.signature_delta(old, new).collect()] == [("f", "a", "1", "2")]
    dead = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r["id"] for r in symbols.newly_dead(dead("a"), dead("a", "b")).collect()} == {"b"}
    assert symbols.newly_dead(dead("z"), dead("a", "b", "c"), most=2).count() == 0


def test_named(spark):
    s = spark.createDataFrame([("f#a@1", "a"), ("g#a@1", "a"), ("h#C.m@3", "C.m")], "symbol string, name string")
    assert {(r["symbol"], r["ambiguous"]) for r in symbols.named(s, "a").collect()} == {("f#a@1", True), ("g#a@1", True)}
    assert [(r["symbol"], r["ambiguous"]) for r in symbols.named(s, "m").collect()] == [("h#C.m@3", False)]
    assert [r["symbol"] for r in symbols.named(s, "f#a@1").collect()] == ["f#a@1"] and symbols.named(s, "none").count() == 0


def test_notebook_models_and_deprecated(spark):
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["import os\n", "%magic\n", "x = 1"]}, {"cell_type": "markdown", "source": ["no"]}]})
    c = spark.createDataFrame([("n.ipynb", nb), ("s.prisma", "model User {\n id Int\n}\n"), ("m.py", "class A(Base):\n    x = 1\n"), ("t.ts", "const t = pgTable('users', {})\n"), ("d.py", "\n" * 20 + "# deprecated: use g\ndef f(): pass\n")], "id string, content string")
    assert [tuple(r) for r in extract.notebook_code(c).collect()] == [("n.ipynb.py", "import os\nx = 1")]
    assert {(r["name"], r["kind"]) for r in extract.models(c).collect()} == {("User", "prisma"), ("A", "sqlalchemy"), ("users", "drizzle")}
    at = spark.createDataFrame([("s1", "d.py", 22), ("s2", "m.py", 1), ("s3", "gone.py", 1)], "symbol string, file string, line long")
    assert {r["symbol"]: r["deprecated"] for r in extract.deprecated(c, at).collect()} == {"s1": True, "s2": False, "s3": False}


def test_cosine_batch_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(120):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / n for x in v]))
    rows += [(500, rows[3][1]), (501, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for r in search.cosine_batch(df, df.where("id % 50 = 0"), 5, block=2).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    by = {r["id"]: r["vector"] for r in df.where("vector is not null").collect()}
    for q in (0, 50, 100, 500):
        best = sorted((x for x in by if x != q), key=lambda x: (-round(sum(a * b for a, b in zip(by[q], by[x])), 5), x))[:5]
        assert got[q] == best
    assert search.cosine_batch(df, df.limit(0)).count() == 0


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    schema = "seq long, session_id long, cs_session string, tool string, id string, ts timestamp_ntz, meta map<string,string>"
    rows = spark.sql("SELECT id AS seq, 1L AS session_id, CAST(NULL AS STRING) AS cs_session, IF(id % 2 = 0, 'read', 'edit') AS tool, 'f' AS id, TIMESTAMP_NTZ '2023-01-01 00:00:00' + MAKE_INTERVAL(0, 0, 0, 0, CAST(id AS INT)) AS ts, map() AS meta FROM range(10)")
    rows = spark.createDataFrame(rows.union(rows).collect(), schema)
    rows.write.parquet(str(tmp_path / "t" / "trace_events.parquet"))
    got = {(str(r["hour"]), r["tool"], r["n_events"]) for r in live.hourly(spark, str(tmp_path / "t")).collect()}
    assert len(got) == 10 and all(n == 1 for _, _, n in got)


def test_leases(spark):
    b = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2023-01-01 00:00:00'), ('a', TIMESTAMP '2023-01-01 00:00:30'), ('b', TIMESTAMP '2023-01-01 00:00:10'), ('c', TIMESTAMP '2023-01-01 00:00:20') AS t(id, ts)")
    assert {r["id"] for r in live.lease_states(b).collect()} == {"a", "c"}


def test_extractors(spark):
    c = spark.createDataFrame([
        ("a.ts", "import x from './x';\nexport * from './y';\nconst z = require('z');\njest.mock('./m');\nfetch(`/api/${x}/1`); axios.get('/b');\napp.get('/r/:id', h);\nconst k = process.env.KEY_A; eval('1');\n"),
        ("b.py", "from .a import b\nimport os\nos.environ['KEY_B']\n@app.route('/p', methods=['GET'])\ndef f(): pass\n"), ("c.css", "@import 'r.css'; .a{background:url(data:x)}"), ("d.md", "[x](./y.md) [z](https://z.invalid/long)"),
        ("e.rs", "mod m;\nuse a::b;\n"), ("f.html", "<script src='s.js'></script><link href=\"c.css\">"), ("g.unknown", "import x"),
    ], "id string, content string")
    imp = {(r["id"], r["spec"], r["kind"]) for r in extract.imports(c).collect()}
    assert {("a.ts", "./x", "import"), ("a.ts", "./y", "reexport"), ("a.ts", "z", "require"), ("a.ts", "./m", "mock"), ("b.py", ".a", "import"), ("b.py", "os", "import"), ("c.css", "r.css", "import"), ("d.md", "./y.md", "ref"), ("e.rs", "m", "import"), ("f.html", "s.js", "asset"), ("f.html", "c.css", "asset")} <= imp
    assert not any(s.startswith(("http", "data:")) for _, s, _ in imp)
    assert {(r["id"], r["var"]) for r in extract.env_reads(c).collect()} == {("a.ts", "KEY_A"), ("b.py", "KEY_B")}
    assert {(r["url"], r["partial"]) for r in extract.api_calls(c).where("id = 'a.ts'").collect()} == {("/api/", True), ("/b", False)}
    assert {(r["method"], r["path"]) for r in extract.routes(c).collect()} == {("GET", "/r/:id"), ("ANY", "/p")}
    assert {r["id"]: r["confidence"] for r in extract.dynamic(c).collect()}["a.ts"] == "low"
    assert {(r["url"], r["n"]) for r in extract.urls(c).collect()} == {("https://z.invalid/long", 1)}
