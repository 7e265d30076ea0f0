import time
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from weftgraph.operators import audit, graph, resolve, search, trace

E = "s string, t string, k string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "import") for a, b in pairs], E)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_bfs_cycle_self_missing_and_empty(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "c"))
    got = {(r["id"], r["depth"]) for r in graph.bfs(nodes(spark, ["a"]), e, 5, "deps").collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["id"] for r in graph.bfs(nodes(spark, ["c"]), e, 1, "users").collect()} == {"c", "b", "d"}
    assert [tuple(r) for r in graph.bfs(nodes(spark, ["zz"]), e, 3).collect()] == [("zz", "zz", 0)]
    assert graph.bfs(nodes(spark, []), e, 3).count() == 0


@pytest.mark.parametrize("hub_rows", [0, 30])
def test_bfs_packed_is_bfs(spark, hub_rows):
    # two hubs, chains between their users, and seeds for two words of 64
    star = [(f"n{i:03}", "hub" if i % 2 else "hob") for i in range(150)] + [(f"n{i:03}", f"n{i * 7 % 150:03}") for i in range(1, 150, 3)] + [("hub", "far"), ("far", "end")]
    e = edges(spark, *star)
    seeds = nodes(spark, [f"n{i:03}" for i in range(100)] + ["hub", "alone", "n001"])
    rows = lambda df: sorted(map(tuple, df.collect()))
    for depth, direction in ((2, "both"), (9, "deps")):
        assert rows(graph.bfs_packed(seeds, e, depth, direction, hub_rows)) == rows(graph.bfs(seeds, e, depth, direction))
    assert graph.bfs_packed(nodes(spark, []), e, 2).count() == 0


def test_bfs_packed_shuffles_no_row_a_pair(spark):
    # 2,000 users of a hub, all of them seeds: four million rows, which bfs shuffles one by one
    e = spark.range(2_000).select(F.concat(F.lit("n"), "id").alias("s"), F.lit("hub").alias("t"), F.lit("import").alias("k"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert graph.bfs_packed(e.select(F.col("s").alias("id")), e, 2, "both", 1 << 10).agg(F.count("seed")).first()[0] == 2_000 * 2_001
    time.sleep(2)  # the store follows the tasks
    assert 0 < written() - before < 2 << 20


def test_components_closure_reachable(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    e = edges(spark, *chain, ("x", "y"))
    lab = {r["id"]: r["component"] for r in graph.components(nodes(spark, [f"n{i:03}" for i in range(41)] + ["x", "y", "z"]), e).collect()}
    assert set(lab.values()) == {"n000", "x", "z"} and lab["n040"] == "n000" and lab["y"] == "x"
    pairs = {(r["seed"], r["id"]): r["depth"] for r in graph.closure(edges(spark, *chain)).collect()}
    assert len(pairs) == 41 * 40 // 2 and pairs["n000", "n040"] == 40
    ring = {(r["seed"], r["id"]): r["depth"] for r in graph.closure(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))).collect()}
    assert ring == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2}
    assert {r["id"] for r in graph.reachable(nodes(spark, ["n038"]), e).collect()} == {"n038", "n039", "n040"}


def test_bundle_keeps_first_and_stops_at_overflow(spark):
    rows = [("q", "big", 0, 0, 400), ("q", "b", 1, 5, 4), ("r", "a", 0, 0, 8), ("r", "b", 1, 9, 400), ("r", "c", 1, 1, 4)]
    got = {(r["seed"], r["id"]) for r in graph.bundle(spark.createDataFrame(rows, "seed string, id string, depth long, n_in long, size long"), 50).collect()}
    assert got == {("q", "big"), ("r", "a")}


def test_owner_is_the_longest_root(spark):
    p = spark.createDataFrame([("r", "a"), ("q", "a/b"), ("q2", "a/b")], "name string, rel_root string")
    got = {r["id"]: r["package"] for r in graph.owners(nodes(spark, ["a/b/c.js", "a/bc.js", "z.js", "ab/c.js"]), p).collect()}
    assert got == {"a/b/c.js": "q", "a/bc.js": "r", "z.js": None, "ab/c.js": None}


def test_import_resolution(spark):
    ids = nodes(spark, ["src/b.ts", "src/c.tsx", "src/d/index.ts", "x.py", "src/e.js", "src/e.ts"])
    rows = [("src/a.ts", "./b.js"), ("src/a.ts", "./c.jsx"), ("src/a.ts", "./d"), ("src/a.ts", "../x"), ("src/a.ts", "../../x"), ("src/a.ts", "pkg"), ("src/a.ts", "./e.js"), ("src/a.ts", "./none")]
    got = {r["spec"]: r["t"] for r in resolve.resolve_imports(spark.createDataFrame([(a, b, "import") for a, b in rows], "s string, spec string, kind string"), ids).collect()}
    assert got == {"./b.js": "src/b.ts", "./c.jsx": "src/c.tsx", "./d": "src/d/index.ts", "../x": "x.py", "../../x": None, "./e.js": "src/e.js", "./none": None}


def test_api_links(spark):
    schema = "id string, api_calls array<struct<method:string,url:string,via:string,partial:boolean>>, routes array<struct<method:string,path:string,handler:string>>"
    rows = [("c1", [("GET", "/x/5?q=1", None, False), ("ANY", "/y/", None, True), ("GET", "https://h.invalid/x/5", None, False)], []), ("s1", [], [("GET", "/x/:id", None), ("ALL", "/z/*", None), ("ANY", "/y/:id", None), ("POST", "/x/{id}", None)])]
    df = spark.createDataFrame(rows, schema)
    assert {(r["s"], r["t"], r["path"]) for r in resolve.api_links(df).collect()} == {("c1", "s1", "/x/:id")}
    assert {r["path"] for r in resolve.api_links(df, strict=False).collect()} == {"/x/:id", "/y/:id"}


def test_enclosing_and_nearest(spark):
    spans = spark.createDataFrame([("a", "foo", 1, 10), ("a", "bar", 3, 5), ("b", "baz", 1, 8), ("b", "qux", 10, 15), ("a", "wide", 1, 100000)], "file string, id string, lo long, hi long")
    pts = spark.createDataFrame([("p1", "a", 4), ("p2", "a", 8), ("p3", "b", 12), ("p4", "b", 9), ("p5", "no", 1), ("p6", "a", 90000)], "point string, file string, line long")
    assert {r["point"]: r["id"] for r in resolve.enclosing(pts, spans, "file").collect()} == {"p1": "bar", "p2": "foo", "p3": "qux", "p4": None, "p5": None, "p6": "wide"}
    marks = spans.select("file", "id", F.col("lo").alias("at"))
    near = {r["point"]: r["id"] for r in resolve.nearest(pts, marks, ["file"]).collect()}
    assert near["p1"] == "bar" and near["p4"] == "qux" and near["p5"] is None


def test_call_resolution_counts_every_call(spark):
    sym = spark.createDataFrame([("a#f", "f", "a", False), ("b#f", "f", "b", False), ("b#g", "g", "b", False), ("c#g", "g", "c", False), ("d#h", "h", "d", False), ("t#h", "h", "t", True), ("e#k", "k", "e", False), ("m#k", "k", "m", False)], "symbol string, name string, file string, aux boolean")
    calls = spark.createDataFrame([("1", "a", "f"), ("2", "z", "f"), ("3", "z", "g"), ("4", "z", "h"), ("5", "z", "none"), ("6", "y", "k"), ("7", "y", "F")], "call string, caller_file string, name string")
    imps = spark.createDataFrame([("z", "b"), ("y", "e"), ("y", "m")], "file string, imported string")
    got = {r["call"]: (r["target"], r["reason"]) for r in resolve.resolve_calls(calls, sym, imps).collect()}
    assert got == {"1": ("a#f", None), "2": ("b#f", None), "3": ("b#g", None), "4": ("d#h", None), "5": (None, "no-match"), "6": (None, "imported-ambiguous"), "7": (None, "no-match")}
    many = spark.createDataFrame([(f"f{i}#n", "n", f"f{i}", False) for i in range(30)], "symbol string, name string, file string, aux boolean")
    cand = resolve.candidates(spark.createDataFrame([("1", "a", "n")], "call string, caller_file string, name string"), many).collect()
    assert len(cand) == 24 and all(r["capped"] for r in cand)


def test_inherited(spark):
    ext = spark.createDataFrame([("C", "B"), ("B", "A"), ("X", "Y"), ("Y", "X")], "cls string, base string")
    has = spark.createDataFrame([("A", "m"), ("B", "n")], "cls string, method string")
    want = spark.createDataFrame([("C", "m"), ("C", "n"), ("X", "m")], "cls string, method string")
    assert {(r["cls"], r["method"]): (r["owner"], r["steps"]) for r in resolve.inherited(ext, has, want).collect()} == {("C", "m"): ("A", 2), ("C", "n"): ("B", 1)}


def test_test_pairs(spark):
    got = {r["test"]: r["source"] for r in resolve.test_pairs(nodes(spark, ["r/a.ts", "r/t/a.test.ts", "q/a.ts", "q/test_b.py", "q/b.py", "q/FooTest.java", "q/Foo.java", "q/lone.spec.js"])).collect()}
    assert got == {"r/t/a.test.ts": "r/a.ts", "q/test_b.py": "q/b.py", "q/FooTest.java": "q/Foo.java"}


def test_partition_of_reach(spark):
    ids = ["main", "used", "chained", "ref", "dead", "deadChained"]
    sure = edges(spark, ("main", "used"), ("used", "chained"), ("dead", "deadChained"))
    got = {r["id"]: r["class"] for r in audit.partition_reach(nodes(spark, ids), nodes(spark, ["main"]), sure, edges(spark, ("main", "ref"))).collect()}
    assert got == {"main": "entry", "used": "reachable", "chained": "reachable", "ref": "possible", "dead": "dead", "deadChained": "dead"}


def files(spark, rows):
    schema = "id string, ext string, loc long, size long, last_seen timestamp, routes array<struct<method:string,path:string>>, api_calls array<struct<method:string,url:string>>, external_urls array<struct<url:string,count:long>>, dynamic_patterns array<string>, env_usage array<string>"
    return spark.createDataFrame([(i, "js", 1, 1, None, [], [], [], d, []) for i, d in rows], schema)


def test_safety_thresholds(spark):
    f = files(spark, [("hub", []), ("mid", []), ("low", []), ("dyn", ["eval"])] + [(f"u{i}", []) for i in range(31)])
    e = edges(spark, *[(f"u{i}", "hub") for i in range(31)], *[(f"u{i}", "mid") for i in range(6)], *[(f"u{i}", "low") for i in range(5)])
    got = {r["id"]: (r["level"], r["dependents"], r["confidence"]) for r in audit.safety(nodes(spark, ["hub", "mid", "low", "dyn"]), f, e).collect()}
    assert got == {"hub": ("risky", 31, "high"), "mid": ("caution", 6, "high"), "low": ("safe", 5, "high"), "dyn": ("caution", 0, "limited")}


def test_cleanup_and_superseded(spark):
    f = files(spark, [("a/legacy/x.js", []), ("a/foo_old.js", []), ("a/foo.js", []), ("lone.js", []), ("index.js", []), ("lone.test.js", ["eval"])])
    e = edges(spark, ("a/foo.js", "a/legacy/x.js"), ("a/foo_old.js", "a/foo.js"))
    got = {(r["id"], r["category"]): (r["marker"], r["confidence"]) for r in audit.cleanup(f, e).collect()}
    assert got == {("a/legacy/x.js", "path"): ("legacy", 0.7), ("a/foo_old.js", "name"): ("_old marker", 0.8), ("lone.js", "orphan"): (None, 0.85), ("lone.test.js", "orphan"): (None, 0.3)}
    assert {(r["id"], r["current"]) for r in audit.superseded(f, e).collect()} == {("a/foo.js", True), ("a/foo_old.js", False)}


def test_search_positions(spark):
    c = spark.createDataFrame([("a", "xx Needle needleneedle\r\nno\n\tNEEDLE"), ("b", "nothing"), ("c", None)], "id string, content string")
    got = {(r["line"], r["col"], r["total"]) for r in search.search(c, "needle").collect()}
    assert got == {(1, 4, 4), (1, 11, 4), (1, 17, 4), (3, 2, 4)}
    assert search.search(c, "n[oe]", regex=True, case=True).count() == 4
    assert search.search(c, "needle", per_file=2).count() == 2


def test_line_diff_rebuilds_the_new_text(spark):
    a, b = "a\nb\nc\nd\ne", "a\nx\nc\ne\nf\nb"
    rows = search.line_diff(spark.createDataFrame([("1", a, b), ("2", None, "q"), ("3", "z\n" * 3000, "y\n" * 3000)], "id string, before string, after string")).collect()
    one = sorted((r for r in rows if r["id"] == "1"), key=lambda r: r["n"])
    assert "\n".join(r["text"] for r in one if r["op"] != "del") == b and "\n".join(r["text"] for r in one if r["op"] != "add") == a
    assert sum(r["op"] == "eq" for r in one) == 3
    assert [r["op"] for r in rows if r["id"] == "3"] == ["note"]


def test_explore_keywords(spark):
    assert search.keywords("the a of") == [] and search.keywords("parseHTTPRequests handlers") == ["parse", "http", "request", "handler"]
    s = spark.createDataFrame([("s1", "authenticate", "src/auth.ts", 0, False, False, False), ("s2", "validate", "src/auth.ts", 5, False, False, False)], "symbol string, name string, file string, n_in long, deprecated boolean, aux boolean, entry boolean")
    assert [(r["symbol"], r["group"]) for r in search.explore(s, "authenticate").collect()] == [("s1", "exact_match")]
    assert search.explore(s, "the a of").count() == 0


def test_trace_edges(spark):
    ev = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, datetime(2023, 1, 1))], "seq long, ts timestamp_ntz")
    assert trace.histogram(ev).count() == 0
    ev = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, datetime(2023, 1, 2)), (3, datetime(2023, 1, 3))], "seq long, ts timestamp_ntz")
    assert {(r["bucket"], r["n_events"]) for r in trace.histogram(ev).collect()} == {(0, 1), (10, 1), (19, 1)}
    p = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "c"), ("x", "y")], "s string, t string")
    got = {(r["s"], r["t"]): r["verdict"] for r in trace.classify_observed(p, p.where("t = 'b'"), p.where("t = 'c'")).collect()}
    assert got == {("a", "b"): "confirmed-static", ("a", "c"): "confirmed-candidate", ("x", "y"): "new-dynamic"}


def test_nearest_as_by_brute_force(spark):
    import random

    rng = random.Random(5)
    marks = [(rng.choice("ab"), rng.randrange(40), rng.randrange(-3000, 9000)) for _ in range(60)] + [("c", 7, None)]
    points = [(i, rng.choice("abcd"), rng.randrange(-5000, 12000)) for i in range(120)] + [(500, "a", None)]
    want = {}
    for p, k, x in points:
        near = [(abs(x - at), i) for g, i, at in marks if g == k and at is not None] if x is not None else []
        want[p] = min(near)[1] if near else None
    p, m = spark.createDataFrame(points, "point long, grp string, line long"), spark.createDataFrame(marks, "grp string, id long, at long")
    assert {r["point"]: r["id"] for r in resolve.nearest(p, m, ["grp"], width=256).collect()} == want


def test_broadcasts_are_checked_in_bytes(spark):
    from weftgraph.session import small

    other = spark.createDataFrame([(i, i) for i in range(50)], "k long, v long").hint("shuffle_merge")
    few = spark.createDataFrame([(1, ["x" * 10] * 3, None), (2, None, "y" * 1000)], "k long, words array<string>, t string")
    planned = lambda most: other.join(small(few, most), "k")
    hinted, plain = planned(1 << 20), planned(500)
    assert "strategy=broadcast" in hinted._jdf.queryExecution().logical().toString() and "strategy=broadcast" not in plain._jdf.queryExecution().logical().toString()
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "t").collect()))
    assert rows(hinted) == rows(plain) == [(1, 1, None), (2, 2, "y" * 1000)]


def test_clusters_must_name_a_shared_folder():
    from types import SimpleNamespace

    from weftgraph.session import shared_dir

    fake = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(fake("spark://h:7077", "hdfs:///x/")) == "hdfs:///x" and shared_dir(fake("local[4]", None)).startswith("file:")
    for master in ("spark://h:7077", "local-cluster[2,1,512]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(fake(master, None))


def test_walks_longer_than_the_tables_they_hold(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "x") for i in range(20)], "s string, t string, k string")
    seed = spark.createDataFrame([("n000",)], "id string")
    assert graph.reachable(seed, chain).count() == 21
    assert {r["id"]: r["depth"] for r in graph.bfs(seed, chain, None, "deps").collect()}["n020"] == 20


def test_pairs_of_tests_and_hot_stems(spark):
    files = [(f"r{i}/src/index.js",) for i in range(30)] + [("r5/test/index.test.js",), ("zz/index_test.js",), ("r1/a/util.js",), ("r2/a/util.js",), ("r2/b/test_util.js",), ("r3/none.test.js",)]
    got = {r["test"]: r["source"] for r in resolve.test_pairs(spark.createDataFrame(files, "id string")).collect()}
    assert got == {"r5/test/index.test.js": "r5/src/index.js", "zz/index_test.js": "r0/src/index.js", "r2/b/test_util.js": "r2/a/util.js"}
