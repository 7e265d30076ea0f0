import json
import subprocess
from datetime import datetime

from weftgraph.functions import extract, paths
from weftgraph.sources import code_tree, logs, sinks

TREE = {
    "src/index.ts": "import { u } from './lib/utils';\nimport App from './components/App';\nconst x = import('./lib/lazy');\nconst k = process.env.STRIPE_KEY + process.env.MISSING;\n",
    "src/lib/utils.ts": "export const u = 1;\n", "src/lib/lazy.ts": "export default 1;\n",
    "src/components/App.tsx": "import { u } from '../lib/utils.js';\nexport function App() { return u }\n",
    "src/components/index.tsx": "export * from './App';\n",
    "styles/main.css": "@import 'reset.css';\n.a { background: url(https://x.invalid/y.png) }\n", "styles/reset.css": "a{}",
    "pipeline/main.py": "from .utils import f\nfrom .nested.sub import g\n\ndef run():\n    return f(g())\n", "pipeline/utils.py": "def f(x):\n    return x\n", "pipeline/nested/sub.py": "def g():\n    return 1\n",
    "node_modules/junk.js": "x", ".env": "STRIPE_KEY=1\nexport UNUSED_KEY = 2\n# NO=1\n", "package.json": '{"name": "app", "workspaces": ["packages/*"], "dependencies": {"a": "^1"}}', "packages/b/package.json": '{"name": "app", "devDependencies": {"c": "2"}}',
    "out.log": "no",
}


def tree(tmp_path):
    for name, text in TREE.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "src/bin.ts").write_bytes(b"a\x00b")
    return str(tmp_path)


def test_scan_edges_env_and_packages(spark, tmp_path):
    files, contents = code_tree.scan(spark, tree(tmp_path))
    ids = {r["id"]: r for r in files.collect()}
    assert "node_modules/junk.js" not in ids and "out.log" not in ids and ids["src/bin.ts"]["confidence"] == "low" and ids["src/bin.ts"]["loc"] == 0
    assert ids["src/lib/utils.ts"]["loc"] == 2
    got = {(r["s"], r["t"], r["k"]) for r in code_tree.edges(files, contents).collect()}
    assert got == {
        ("src/index.ts", "src/lib/utils.ts", "import"), ("src/index.ts", "src/components/App.tsx", "import"), ("src/index.ts", "src/lib/lazy.ts", "dynamic"), ("src/components/App.tsx", "src/lib/utils.ts", "import"),
        ("src/components/index.tsx", "src/components/App.tsx", "reexport"), ("styles/main.css", "styles/reset.css", "import"), ("pipeline/main.py", "pipeline/utils.py", "import"), ("pipeline/main.py", "pipeline/nested/sub.py", "import"),
    }
    from weftgraph.operators.audit import env_status

    used = extract.env_reads(contents).select("var", extract.F.col("id").alias("file"))
    assert {(r["var"], r["status"]) for r in env_status(code_tree.env_files(contents), used).collect()} == {("STRIPE_KEY", "ok"), ("UNUSED_KEY", "unused"), ("MISSING", "undeclared")}
    assert {(r["name"], r["rel_root"], r["kind"]) for r in code_tree.packages(contents).collect()} == {("app", "", "npm"), ("app (packages/b)", "packages/b", "npm")}
    assert {(r["dep"], r["section"]) for r in code_tree.declared_deps(contents).collect()} == {("a", "dependencies"), ("c", "devDependencies")}


def test_ignore_rules(spark):
    rules = paths.ignore_rules("# c\n/tools/\n*.log\nvendor\n!keep.log\na/**/z.py\n")
    cases = {"tools/x": True, "src/tools/x": False, "a.log": True, "d/b.log": True, "keep.log": False, "x/vendor/y": True, "a/z.py": True, "a/b/c/z.py": True, "z.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "id string")
    assert {r["id"]: r["i"] for r in df.select("id", paths.ignored_by("id", rules).alias("i")).collect()} == cases


def test_path_functions(spark):
    rows = [("src/app/(shop)/items/[id]/page.tsx", "/items/:id"), ("app/page.tsx", "/"), ("pages/blog/index.mdx", "/blog"), ("pages/_app.tsx", None), ("pages/api/x.ts", None), ("src/routes/a/[...rest]/+page.svelte", "/a/*"), ("lib/x.ts", None)]
    df = spark.createDataFrame(rows, "id string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", paths.page_route("id").alias("got")).collect())
    urls = spark.createDataFrame([("https://A.invalid:8/x/y/?q#f", "/x/y", "a.invalid"), ("x/", "/x", ""), ("/", "/", "")], "u string, p string, h string")
    assert all(r["p"] == r["gp"] and r["h"] == r["gh"] for r in urls.select("p", "h", paths.url_path("u").alias("gp"), paths.url_host("u").alias("gh")).collect())
    names = spark.createDataFrame([("a/foo_old.js", "foo"), ("foo-v2.ts", "foo"), ("Foo.copy1.py", "foo"), ("x/.env", ".env"), ("plain.js", "plain")], "id string, want string")
    assert all(r["want"] == r["got"] for r in names.select("want", paths.logical_name("id").alias("got")).collect())


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.invalid", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for n in ("a", "b"):
        (tmp_path / f"{n}.py").write_text(n)
        run("add", ".")
        run("commit", "-qm", f"add {n}")
    assert [(r["subject"], r["id"]) for r in code_tree.git_history(spark, str(tmp_path)).orderBy("id").collect()] == [("add a", "a.py"), ("add b", "b.py")]
    assert [r["id"] for r in code_tree.git_changed(spark, str(tmp_path), "HEAD~1", "HEAD").collect()] == ["b.py"]
    assert code_tree.git_history(spark, str(tmp_path / "none")).count() == 0


def test_event_log_round_trip(spark, tmp_path):
    p = tmp_path / "log" / "x.jsonl"
    p.parent.mkdir()
    p.write_text('{"type": "meta", "session_id": 1}\n{"seq": 1, "session_id": 1, "tool": "read", "id": "a", "meta": {"n": "2"}}\nbroken\n')
    ev = logs.read_events(spark, str(p.parent))
    assert [(r["seq"], r["tool"], r["meta"]) for r in ev.collect()] == [(1, "read", {"n": "2"})]
    logs.append_events(ev, str(tmp_path / "out"))
    assert logs.read_events(spark, str(tmp_path / "out")).count() == 1


def test_profile_pairs(spark, tmp_path):
    node = lambda i, f, line, kids: {"id": i, "callFrame": {"functionName": "f", "url": f, "lineNumber": line}, "children": kids}
    doc = {"nodes": [node(1, "", -1, [2]), node(2, "file:///r/a.js", 2, [3, 4]), node(3, "file:///r/b.js", 4, []), node(4, "node:x", 0, [])]}
    (tmp_path / "p.cpuprofile").write_text(json.dumps(doc))
    assert [tuple(r) for r in logs.profile_pairs(spark, str(tmp_path), "/r/").collect()] == [("/r/a.js", 3, "/r/b.js", 5)]


def test_observed_validity(spark):
    t = datetime
    obs = spark.createDataFrame([("a", 1, "b", 2, t(2023, 1, 1), 5, 6), ("a", 1, "b", 2, t(2023, 1, 2), 5, 7), ("a", 2, "c", 2, t(2023, 1, 2), 5, 1)], "cf string, cl int, ef string, el int, batch_ts timestamp, cf_mtime long, ef_mtime long")
    files = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "id string, mtime long")
    assert [tuple(r) for r in logs.valid_observed(obs, files).collect()] == [("a", 1, "b", 2)]


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a", "js", 1, 2), ('b"', "js", 1, 2)], "id string, ext string, loc long, size long")
    edges = spark.createDataFrame([("a", 'b"', "import")], "s string, t string, k string")
    sinks.graph_json(files, edges, str(tmp_path / "g"))
    assert {(r["id"], r["mass"]) for r in spark.read.json(str(tmp_path / "g/nodes")).collect()} == {("a", 0), ('b"', 1)}
    sinks.edges_csv(edges, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    assert [tuple(r) for r in back] == [("a", 'b"', "import")]
    assert "n0 --> n1" in sinks.mermaid(edges)
    report = sinks.ci_report(spark.createDataFrame([("a", 12, 1), ("b", 2, 0)], "seed string, dependents long, tests long"))
    assert "| **a** | 12 | 1 |" in report and "| b | 2 | 0 |" in report
    c = spark.createDataFrame([("a", "x y x"), ("b", "q")], "id string, content string")
    assert [tuple(r) for r in sinks.replace_once(c, "a", "y", "z").collect()] == [("a", "x z x", "replaced")]
    assert sinks.replace_once(c, "a", "x", "z").first()["outcome"] == "not-unique" and sinks.replace_once(c, "b", "x", "z").first()["outcome"] == "not-found"
    v = spark.createDataFrame([("a", datetime(2023, 1, d), s) for d, s in ((1, "p"), (2, "p"), (3, "q"), (4, "r"), (5, "s"))], "id string, ts timestamp, content string")
    assert sorted(r["content"] for r in sinks.history(v).collect()) == ["q", "r", "s"]
    known = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in sinks.append_new(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string"), known, ["id"], 1).collect()] == ["b"]


def test_plugins(spark):
    from weftgraph import plugins

    @plugins.extractor("foo")
    def _foo(c):
        return c.select("id", extract.F.lit("x").alias("spec"), extract.F.lit("import").alias("kind"))

    got = plugins.extracted(spark.createDataFrame([("a.foo", ""), ("b.js", "")], "id string, content string"))
    assert [tuple(r) for r in got.collect()] == [("a.foo", "x", "import")]
    plugins.ENGINES["own"] = lambda f: f.select(f["id"].alias("s"), extract.F.lit("z").alias("t"), extract.F.lit("import").alias("k"))
    e = spark.createDataFrame([("a", "z", "import")], "s string, t string, k string")
    out = plugins.enriched(e, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {(r["s"], r["via"]) for r in out.collect()} == {("a", None), ("b", "own")}
    plugins.ENGINES.clear()
    plugins.EXTRACTORS.clear()
