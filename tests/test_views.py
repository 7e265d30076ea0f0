import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph import plugins
from weftgraph.operators import search, views
from weftgraph.sources import code_tree, sinks
from weftgraph.streaming import live

E = "s string, t string, k string"


def test_blast_leaves_the_seed_out(spark):
    e = spark.createDataFrame([("b", "a", "c"), ("c", "b", "c"), ("a", "c", "c"), ("d", "c", "c"), ("x", "y", "c")], E)
    sym = spark.createDataFrame([(i, i + "f", 2 if i == "d" else 0) for i in "abcdxy"], "id string, file string, n_dynamic long")
    got = {r["seed"]: tuple(r)[1:] for r in views.symbol_blast(spark.createDataFrame([("a",), ("x",), ("no",)], "id string"), e, sym).collect()}
    assert got == {"a": (3, 3, 1, 1, 1, 2), "x": (0, 0, 0, 0, 0, 0), "no": (0, 0, 0, 0, 0, 0)}


def test_urls_meet_the_route_with_fewest_open_segments(spark):
    urls = ["/a/b", "/a/7", "/a", "/", "/x/y/z", "/A/b", "/f/1/2/3", "/f", "/q/r"]
    routes = ["/a/b", "/a/:id", "/:any", "/x/*", "/f/[...rest]", "/f/{one}/2/3", "/", "/:p/r"]
    u, r = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((urls, "path"), (routes, "route")))
    got = {x["path"]: x["route"] for x in views.match_urls(u, r).collect()}
    assert got == {"/a/b": "/a/b", "/a/7": "/a/:id", "/a": "/:any", "/": "/", "/x/y/z": "/x/*", "/f/1/2/3": "/f/[...rest]", "/f": "/:any", "/q/r": "/:p/r"} or got["/f/1/2/3"] == "/f/{one}/2/3"


def test_usage_of_models_by_words(spark):
    c = spark.createDataFrame([("a", "User and UserName"), ("b", "my User."), ("c", None), ("d", "user"), (None, "User")], "id string, content string")
    m = spark.createDataFrame([("User",), ("Order",), (None,)], "model string")
    assert {tuple(r) for r in views.model_usage(m, c).collect()} == {("User", "a"), ("User", "b")}


def test_scope_and_files_and_rates(spark):
    sym = spark.createDataFrame([("f", "g", 3, "f#g@3"), ("f", "g", 9, "f#g@9")], "file string, name string, line long, symbol string")
    asked = spark.createDataFrame([("f", "g", 9), ("f", "g", 4), ("h", "g", 3)], "file string, name string, line long")
    assert {(r["line"], r["symbol"]) for r in views.scope_local(asked, sym).collect()} == {(9, "f#g@9"), (4, None), (3, None)}
    c = spark.createDataFrame([("a.py", "é"), ("../b", "x"), ("/etc/c", "x"), ("d", None), ("e", "x" * 2097153)], "id string, content string")
    assert {r["id"]: (r["state"], r["bytes"]) for r in views.read_files(c).collect()} == {"a.py": ("ok", 2), "../b": ("outside", 1), "/etc/c": ("outside", 1), "d": ("unread", 0), "e": ("too large", 2097153)}
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "k long")
    assert tuple(views.rates(one([1, 2, 2, 3]), one([2, 3, 4, 5]), ["k"]).first()) == (3, 4, 2, 0.666667, 0.5)
    assert tuple(views.rates(one([]), one([]), ["k"]).first()) == (0, 0, 0, None, None)


def test_changes_with_removals_as_a_stream(spark, tmp_path):
    def scan(version, rows):
        spark.createDataFrame([(i, m, version) for i, m in rows], "id string, mark string, version long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen = []
    put = lambda df, v: seen.append((v, sorted(map(tuple, df.collect()))))
    scan(1, [("a", "1"), ("b", "1"), ("c", None)])
    stream = live.manifests(spark, str(tmp_path / "in"))
    live.changes(stream, put)
    assert seen == [(1, [("a", "add"), ("b", "add"), ("c", "add")])]
    before, after = ([("a", "1"), ("b", "1"), ("c", None)], [("a", "2"), ("c", None), ("d", "1")])
    df = views.file_changes(*[spark.createDataFrame(x, "id string, mark string") for x in (before, after)])
    assert sorted(map(tuple, df.collect())) == [("a", "change"), ("b", "unlink"), ("d", "add")]
    facts = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "kept")], "id string, fact string")
    fresh = spark.createDataFrame([("a", "new"), ("d", "new"), ("c", "not read")], "id string, fact string")
    assert sorted(map(tuple, views.merge_facts(facts, df, fresh).collect())) == [("a", "new"), ("c", "kept"), ("d", "new")]
    told = views.alerts(spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("f", "g", "(a)", "(a, b)")], "file string, name string, before string, after string"))
    assert {tuple(r) for r in told.collect()} == {("dead", "x", None), ("signature", "f#g", "(a) -> (a, b)")}


def test_observed_pairs_are_compacted_and_cycles_deduplicated(spark, tmp_path):
    path, schema = str(tmp_path / "obs"), "cf string, cl long, ef string, el long, batch_ts timestamp, cf_mtime long"
    t = lambda d: datetime.datetime(2024, 1, d)
    for d in (1, 2, 3):
        sinks.append_observed(spark.createDataFrame([("a", 1, "b", 2, t(d), d), ("a", 1, "c", d, t(d), d)], schema), path)
    assert not sinks.compact_observed(spark, path, 1 << 30) and spark.read.parquet(path).count() == 6
    assert sinks.compact_observed(spark, path, 10)
    assert {(r["ef"], r["el"], r["cf_mtime"]) for r in spark.read.parquet(path).collect()} == {("b", 2, 3), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3)}
    stream = spark.readStream.schema(schema).parquet(path)
    assert live.run(live.profile_cycles(stream, "900 days").drop("seen_at"), "cycles", "append").count() == 4
    sinks.trace_json(spark.createDataFrame([(2, "b"), (1, "a")], "seq long, tool string"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_the_first_ignore_file_counts_alone(spark, tmp_path):
    (tmp_path / ".graphignore").write_text("b/\n")
    assert [k for _, k in code_tree.project_rules(str(tmp_path))] == [True]
    (tmp_path / ".weftignore").write_text("a/\n")
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.py").write_text("x = 1\n")
    files, _ = code_tree.scan(spark, str(tmp_path))
    assert {r["id"] for r in files.collect()} == {"b/x.py"}
    assert code_tree.project_rules(str(tmp_path / "a")) == []


def test_plugins_get_what_they_were_granted(spark):
    f, e = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b", "x")], E)
    g = plugins.Graph(f, e)
    assert g.degrees().count() == 2 and g.neighbours(f.where("id = 'a'")).count() == 2
    for refused in (g.contents, lambda: g.add_edges(e)):
        with pytest.raises(PermissionError):
            refused()
    assert plugins.Graph(f, e, granted=("read", "write")).add_edges(e).count() == 1
    plugins.LAYOUTS["line"] = lambda files, edges: files.where("id = 'a'").select("id", F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("z"))
    assert {tuple(r) for r in plugins.laid_out("line", f, e).collect()} == {("a", 1.0, 2.0, 3.0), ("b", 0.0, 0.0, 0.0)}
    plugins.EXPORTERS["n"] = lambda files, edges: str(files.count())
    assert plugins.exported("n", f, e) == "2"
    with pytest.raises(KeyError):
        plugins.exported("none", f, e)

    @plugins.symbol_parser("zz")
    def zz(contents):
        return contents.select("id", F.col("content").alias("name"), F.lit("word").alias("kind"), F.lit(1).cast("long").alias("line"))

    assert [tuple(r) for r in plugins.parsed_symbols(spark.createDataFrame([("a.ZZ", "w"), ("b.py", "v")], "id string, content string")).collect()] == [("a.ZZ", "w", "word", 1)]


def test_embedding_in_batches(spark):
    sizes = lambda texts: [[len(t), len(texts)] for t in texts]
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 71)] + [(100, None), (101, ""), (1, "zz")], "id long, text string").coalesce(1)
    got = {r["id"]: r["vector"] for r in search.embedded(df, sizes).collect()}
    assert len(got) == 70 and got[5][0] == 5.0 and got[1][0] == 1.0 and max(v[1] for v in got.values()) <= 32


def test_vendor_directories_by_signs(spark):
    from weftgraph.operators import audit

    ids = ["p/package.json", "p/a/lib/package.json", "p/a/lib/LICENSE", "p/a/lib/vendor/x.js", "p/third_party/LICENSE", "p/b/.git/config", "p/b/c.py", "q/sub/go.mod", "q/vendor/y.go", "p/deep/er/and/er/LICENSE"]
    got = {r["dir"]: (r["confidence"], r["reasons"]) for r in audit.vendor_dirs(spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert got == {"p/a/lib": (0.5, "own licence, own manifest"), "p/third_party": (0.4, "own licence, usual name"), "p/b": (0.5, "nested repository")}


def test_server_routes(spark):
    from weftgraph.functions import paths

    want = {
        "src/app/api/users/[id]/route.ts": ("ANY", "/api/users/:id"), "pages/api/x/index.js": ("ANY", "/api/x"), "src/routes/(g)/a/+server.ts": ("ANY", "/a"), "server/api/item.get.ts": ("GET", "/api/item"), "server/routes/b/[...all].ts": ("ANY", "/b/*"), "src/app/page.tsx": None,
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", paths.server_route("p").alias("r"))
    assert {r["p"]: (tuple(r["r"]) if r["r"] else None) for r in df.collect()} == want


def test_files_are_written_and_restored_and_reports_told(spark):
    c = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content string")
    t = lambda d: datetime.datetime(2024, 1, d)
    v = spark.createDataFrame([("a", t(1), "old"), ("a", t(3), "newer")], "id string, ts timestamp, content string")
    assert {tuple(r) for r in sinks.written(c, "c", "3").collect()} == {("a", "1"), ("b", "2"), ("c", "3")} and {tuple(r) for r in sinks.written(c, "a", "9").collect()} == {("a", "9"), ("b", "2")}
    assert {tuple(r) for r in sinks.restored(c, v, "a", t(2)).collect()} == {("a", "old"), ("b", "2")} and {tuple(r) for r in sinks.restored(c, v, "b", t(2)).collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(ValueError):
        sinks.written(c, "../x", "")
    blast = spark.createDataFrame([("f", 12, 1), ("g", 3, 0)], "seed string, dependents long, tests long")
    assert '"high": true' in sinks.ci_json(blast) and sinks.ci_plain(blast).splitlines()[0] == "f: 12 dependents, 1 tests"
    f = spark.createDataFrame([("x.ts", "ts"), ("y.ts", "ts"), ("z.py", "py")], "id string, ext string")
    e = spark.createDataFrame([("y.ts", "x.ts", "i"), ("z.py", "x.ts", "i"), ("x.ts", "y.ts", "i")], E)
    files, edges = sinks.chosen(f, e, ".TS", 1)
    assert {r["id"] for r in files.collect()} == {"x.ts", "y.ts"} and edges.count() == 2


def test_statuses_trees_and_budgets(spark, tmp_path):
    import subprocess

    assert code_tree.git_statuses("A\ta.py\nR087\told.py\tnew.py\nD\tx\n\nU\ty\n") == [("a.py", "added", None), ("new.py", "renamed", "old.py"), ("x", "deleted", None)]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x.invalid", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    git("add", "-A"), git("commit", "-qm", "1")
    (tmp_path / "a.py").rename(tmp_path / "b.py")
    (tmp_path / "c.py").write_text("y\n")
    git("add", "-A"), git("commit", "-qm", "2")
    assert {tuple(r) for r in code_tree.git_diff(spark, str(tmp_path), "HEAD~1", "HEAD").collect()} == {("b.py", "renamed", "a.py"), ("c.py", "added", None)}
    assert {tuple(r) for r in code_tree.git_tree(spark, str(tmp_path), "HEAD~1").collect()} == {("a.py", 120)}
    sym = spark.createDataFrame([("s1", "login", "a", 0, False, False, False, 10), ("s2", "loginForm", "b", 5, False, False, False, 10), ("s3", "other", "c", 9, False, False, False, 10)], "symbol string, name string, file string, n_in long, deprecated boolean, aux boolean, entry boolean, tokens long")
    vec = spark.createDataFrame([("s3", [1.0, 0.0]), ("s1", [0.0, 1.0])], "id string, vector array<float>")
    got = [(r["symbol"], r["group"], r["total"]) for r in search.explore_with_vectors(sym, "login", vec, [1.0, 0.0], 25).orderBy("total").collect()]
    assert got == [("s3", "semantic", 10), ("s1", "exact_match", 20)]


def test_pairs_by_a_stem_within_and_points_of_the_module(spark):
    from weftgraph.operators import resolve

    files = [("r/a/user.js",), ("r/a/userstore.js",), ("q/userstore.js",), ("r/t/userstore_login.test.js",), ("r/t/abc.test.js",), ("r/a/abcd.js",)]
    got = {r["test"]: r["source"] for r in resolve.test_pairs(spark.createDataFrame(files, "id string")).collect()}
    assert got == {"r/t/userstore_login.test.js": "r/a/userstore.js"}
    spans = spark.createDataFrame([("a", "f", 2, 5)], "file string, id string, lo long, hi long")
    pts = spark.createDataFrame([("1", "a", 3), ("2", "a", 9), ("3", "b", 1)], "point string, file string, line long")
    assert {r["point"]: r["id"] for r in resolve.enclosing(pts, spans, "file", module=True).collect()} == {"1": "f", "2": "a#<module>", "3": None}


def test_leases_run_out_in_a_stream(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    for k, rows in enumerate(([("a", t(0)), ("a", t(10)), ("b", t(5))], [("b", t(60)), ("b", t(200))], [("c", t(400))], [("c", t(401))])):
        spark.createDataFrame(rows, "id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "beats"))
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "beats"))
    got = {(r["id"], r["n_beats"], (r["last_beat"] - t(0)).seconds) for r in live.run(live.expired_leases(stream), "leases", "append").collect()}
    assert {("a", 2, 10), ("b", 1, 5), ("b", 1, 60), ("b", 1, 200)} <= got and not any(i == "c" for i, _, _ in got)


def test_days_of_commits(spark):
    from weftgraph.operators import trace

    rows = [("c1", datetime.datetime(2024, 1, 1, 9), "a"), ("c1", datetime.datetime(2024, 1, 1, 9), "b"), ("c2", datetime.datetime(2024, 1, 1, 23), "a"), ("c3", datetime.datetime(2024, 1, 2, 1), "a")]
    got = {(str(r["day"]), r["n_commits"], r["n_files"]) for r in trace.commit_days(spark.createDataFrame(rows, "commit string, ts timestamp, id string")).collect()}
    assert got == {("2024-01-01", 2, 2), ("2024-01-02", 1, 1)}


def test_workspaces_and_their_packages(spark):
    assert code_tree.yaml_list("packages:\n  - 'a/*'\n  # c\n  - b # d\nother: x\n", "packages") == ["a/*", "b"] and code_tree.yaml_list('packages: ["x/*", y]', "packages") == ["x/*", "y"]
    kinds = lambda **f: code_tree.workspace({k.replace("__", "-").replace("_", "."): v for k, v in f.items()})
    assert kinds(pnpm__workspace_yaml="packages:\n- p/*\n", package_json='{"workspaces": ["q/*"]}') == ("pnpm", ["p/*"])
    assert kinds(package_json='{"workspaces": {"packages": ["q/*"]}}', yarn_lock="") == ("yarn", ["q/*"]) and kinds(package_json='{"workspaces": ["q"]}', turbo_json="{}") == ("turbo", ["q"])
    assert kinds(lerna_json="{}") == ("lerna", ["packages/*"]) and kinds(rush_json='{"projects": [{"projectFolder": "r/a"},]}') == ("rush", ["r/a"])
    assert kinds(pyproject_toml="[project]\nname='x'\n[tool.poetry]\n") == ("poetry", []) and kinds() == (None, [])
    rows = [("package.json", '{"name": "top", "workspaces": ["p/*", "!p/old"]}'), ("p/a/package.json", '{"name": "same",}'), ("p/b/package.json", '{"name": "same"}'), ("p/old/package.json", '{"name": "o"}'), ("x/package.json", '{"name": "out"}'), ("g/go.mod", "module m/g\n"), ("h/setup.py", None)]
    got = {(r["name"], r["rel_root"], r["kind"], r["language"]) for r in code_tree.packages(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {("top", "", "npm", "js"), ("same", "p/a", "npm", "js"), ("same (p/b)", "p/b", "npm", "js"), ("m/g", "g", "npm", "go"), ("h", "h", "npm", "py")}
