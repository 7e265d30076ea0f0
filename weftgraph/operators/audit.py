"""Audits over a snapshot and its edges: summary, hubs, environment, external hosts, safety, cleanup, preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import graph
from weftgraph.session import small

# Markers of age in directories and names, with the confidence each carries; the first that matches counts.
PATH_MARKERS = (
    (r"(?i)(?:^|/)_legacy(?:/|$|_)", "_legacy", 0.92), (r"(?i)(?:^|/)_archive(?:/|$|_)", "_archive", 0.92), (r"(?i)(?:^|/)_old(?:/|$|_)", "_old", 0.88),
    (r"(?i)(?:^|/)legacy(?:/|$)", "legacy", 0.80), (r"(?i)(?:^|/)archive(?:/|$)", "archive", 0.80), (r"(?i)(?:^|/)deprecated(?:/|$)", "deprecated", 0.90),
    (r"(?i)(?:^|/)old(?:/|$)", "old", 0.75), (r"(?i)(?:^|/)backups?(?:/|$)", "backup", 0.85), (r"(?i)(?:^|/)v[0-9]+_old(?:/|$)", "vN_old", 0.92),
    (r"(?i)(?:^|/)trash(?:/|$)", "trash", 0.95), (r"(?i)(?:^|/)unused(?:/|$)", "unused", 0.88), (r"(?i)(?:^|/)v[0-9]+(?:/|$)", "vN folder", 0.45),
)
NAME_MARKERS = (
    (r"(?i)[._-]old[._]", "_old marker", 0.80), (r"(?i)[._-]old\.[a-z]+$", "name_old.ext", 0.85), (r"(?i)[._-]legacy[._]", "_legacy marker", 0.85),
    (r"(?i)[._-]legacy\.[a-z]+$", "name_legacy.ext", 0.88), (r"(?i)[._-]deprecated[._]", "_deprecated marker", 0.90), (r"(?i)[._-]backup[._]", "_backup marker", 0.85),
    (r"(?i)[._-]bak\.[a-z]+$", ".bak.ext", 0.90), (r"(?i)\.bak$", ".bak suffix", 0.92), (r"(?i)\.orig$", ".orig suffix", 0.90), (r"(?i)\.tmp\.", ".tmp marker", 0.70),
    (r"(?i)[._-]copy(?:\d+)?\.[a-z]+$", "copy variant", 0.85), (r"(?i)[._-]v[0-9]+\.[a-z]+$", "vN variant", 0.40),
)
ENTRY_PATH = (
    r"(?:^|/)(?:index|main|server|app|cli|preload)\.[cm]?[jt]sx?$|(?:^|/)(?:bin|scripts)/[^/]+$|(?:^|/)(?:examples?|demos?|fixtures?|playground)/|"
    r"(?:^|/)(?:manifest\.json|theme\.css)$|(?:^|/)(?:vite|webpack|next|rollup|esbuild)\.config\.|(?:^|/)tsconfig(?:\.[a-z]+)?\.json$|"
    r"(?:^|/)package(?:-lock)?\.json$|(?:^|/)pnpm-lock\.yaml$|(?:^|/)yarn\.lock$|(?i:(?:^|/)(?:README|CHANGELOG|CONTRIBUTING|CODE_OF_CONDUCT)\.md$|(?:^|/)LICENSE)|"
    r"(?:^|/)\.[a-z]+rc(?:\.[a-z]+)?$|\.config\.[cm]?[jt]s$|\.d\.ts$|(?:^|/)\.github/"
)
LEGACY_TEST = r"(?i)\.(?:test|spec)\.[a-z]+$|(?:^|/)(?:__tests__|tests?)/"


def _first(path, markers):
    """(label, confidence) of the first marker that matches, as two columns."""
    label, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rx, name, c in reversed(markers):
        hit = path.rlike(rx)
        label, conf = F.when(hit, name).otherwise(label), F.when(hit, c).otherwise(conf)
    return label, conf


def env_status(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(var, status, n_declared, n_used): full outer join of (var, file) declared and used."""
    d = declared.select("var", "file").distinct().groupBy("var").agg(F.count(F.lit(1)).alias("n_declared"))
    u = used.select("var", "file").distinct().groupBy("var").agg(F.count(F.lit(1)).alias("n_used"))
    status = F.when(F.col("n_declared").isNull(), "undeclared").when(F.col("n_used").isNull(), "unused").otherwise("ok")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.join(u, "var", "full_outer").select("var", status.alias("status"), n("n_declared"), n("n_used"))


def external_calls(files: DataFrame) -> DataFrame:
    """Distinct (domain, proto, file, url, method) of absolute URLs in API calls and texts."""
    calls = files.select(F.col("id").alias("file"), F.explode("api_calls").alias("c")).where(F.col("c.url").rlike(r"^(?i:https?)://")).select("file", "c.url", F.coalesce("c.method", F.lit("GET")).alias("method"))
    urls = files.select(F.col("id").alias("file"), F.explode("external_urls.url").alias("url")).withColumn("method", F.when(F.startswith(paths.url_scheme("url"), F.lit("ws")), "WS").otherwise("GET"))
    both = calls.unionByName(urls).withColumn("domain", paths.url_host("url")).withColumn("proto", paths.url_scheme("url"))
    return both.where(F.col("domain") != "").select("domain", "proto", "file", "url", "method").distinct()


def secret_leaks(files: DataFrame) -> DataFrame:
    """(var, file): environment variables without a public prefix that frontend code reads."""
    own = files.where((paths.side("id") == "frontend") & ~F.col("id").rlike(paths.STYLE_EXT))
    return own.select(F.explode("env_usage").alias("var"), F.col("id").alias("file")).where(~F.col("var").rlike(paths.PUBLIC_ENV)).distinct()


def untested_hubs(files: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """(id, n_in) of files with at least ``least`` edges in, none of them from a test."""
    d = edges.groupBy(F.col("t").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.max(paths.is_test("s").cast("int")).alias("_test"))
    return files.select("id").join(d.where((F.col("n_in") >= least) & (F.col("_test") == 0)), "id").select("id", "n_in")


def cleanup(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, category, marker, confidence, n_in): orphan, path and name candidates of abandoned files.

    Confidence falls with what still depends on a file and stays within 0.1 and 0.99.
    """
    d = files.join(graph.degrees(files, edges), "id")
    dyn = F.size(F.coalesce("dynamic_patterns", F.array())) > 0
    bound = lambda c: F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.99), c)), 4)
    cut = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    lone = d.where((F.col("n_in") == 0) & (F.col("n_out") == 0) & ~F.col("id").rlike(ENTRY_PATH)).select(
        "id", F.lit("orphan").alias("category"), F.lit(None).cast("string").alias("marker"),
        bound(F.lit(0.85) - cut(dyn, 0.35) - cut(F.col("id").rlike(LEGACY_TEST), 0.20) - cut(F.col("ext").isin("md", "json", "yaml", "yml"), 0.25)).alias("confidence"), "n_in",
    )
    out = lone
    for category, on, markers, most, each in (("path", F.col("id"), PATH_MARKERS, 0.4, 0.1), ("name", paths.base_name("id"), NAME_MARKERS, 0.35, 0.08)):
        label, conf = _first(on, markers)
        out = out.unionByName(
            d.withColumn("marker", label).where(F.col("marker").isNotNull())
            .select("id", F.lit(category).alias("category"), "marker", bound(conf - F.least(F.lit(most), F.lit(each) * F.col("n_in"))).alias("confidence"), "n_in")
        )
    return out


def superseded(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, id, n_in, marked, current): groups of two to six files of one logical name of which one carries a marker of age."""
    d = files.join(graph.degrees(files, edges), "id")
    marked = _first(F.col("id"), PATH_MARKERS)[0].isNotNull() | _first(paths.base_name("id"), NAME_MARKERS)[0].isNotNull()
    named = d.select(F.concat(paths.logical_name("id"), F.lit("."), F.coalesce("ext", F.lit(""))).alias("name"), "id", "n_in", marked.alias("marked"))
    sizes = named.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("marked").cast("int")).alias("_m")).where(F.col("_n").between(2, 6) & (F.col("_m") == 1))
    w = Window.partitionBy("name").orderBy(F.col("n_in").desc(), "id")
    return named.join(sizes.select("name"), "name").select("name", "id", "n_in", "marked", (F.row_number().over(w) == 1).alias("current"))


def safety(seeds: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(id, level, dependents, n_routes, n_api, n_external, dynamic, tests, confidence) of files, by what a change reaches.

    More than 30 dependents are risky; routes, URLs, calls, dynamic patterns or more than 5 dependents ask for caution.
    """
    reach = graph.bfs(seeds, edges, depth, "users")
    n = lambda c: F.size(F.coalesce(c, F.array())).cast("long")
    facts = files.select("id", n("routes").alias("n_routes"), n("api_calls").alias("n_api"), n("external_urls").alias("n_external"), (n("dynamic_patterns") > 0).alias("dynamic"))
    inside = reach.join(files.select("id", (n("dynamic_patterns") > 0).alias("_d")), "id")
    hit = inside.groupBy("seed").agg(
        (F.count(F.lit(1)) - 1).alias("dependents"), F.sum(paths.is_test("id").cast("long")).alias("tests"), F.max("_d").alias("_dyn"),
    )
    j = facts.join(hit.withColumnRenamed("seed", "id"), "id")
    level = (
        F.when(F.col("dependents") > 30, "risky")
        .when((F.col("n_routes") > 0) | (F.col("n_external") > 0) | (F.col("n_api") > 0) | F.col("dynamic") | (F.col("dependents") > 5), "caution")
        .otherwise("safe")
    )
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("dependents") > 30, "many dependents"), F.when(F.col("n_routes") > 0, "routes"), F.when(F.col("n_external") > 0, "external URLs"), F.when(F.col("n_api") > 0, "API calls"),
        F.when(F.col("dynamic"), "dynamic"), F.when(F.col("dependents").between(6, 30), "dependents"),
    )), ", ")
    return j.select("id", level.alias("level"), reasons.alias("reasons"), "dependents", "n_routes", "n_api", "n_external", "dynamic", "tests", F.when(F.col("dynamic") | F.col("_dyn"), "limited").otherwise("high").alias("confidence"))


def partition_reach(nodes: DataFrame, entries: DataFrame, sure: DataFrame, maybe: DataFrame) -> DataFrame:
    """(id, class): entry, reachable (along sure edges), possible (along any) or dead; every node is in one class."""
    by_sure = graph.reachable(entries, sure)
    by_any = graph.reachable(entries, sure.select("s", "t").unionByName(maybe.select("s", "t")))
    mark = lambda df, c: df.select("id").distinct().withColumn(c, F.lit(True))
    j = nodes.select("id").distinct().join(mark(entries, "_e"), "id", "left").join(mark(by_sure, "_s"), "id", "left").join(mark(by_any, "_a"), "id", "left")
    return j.select("id", F.when(F.col("_e"), "entry").when(F.col("_s"), "reachable").when(F.col("_a"), "possible").otherwise("dead").alias("class"))


def preflight(files: DataFrame, edges: DataFrame, env: DataFrame) -> DataFrame:
    """(key, status, n): checks of the snapshot as rows; fail, warn, info or ok."""
    n_files = files.count()
    one = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    checks = [
        (one(env.where("status = 'undeclared'")), "env-undeclared", "fail", 1),
        (one(secret_leaks(files).select("var").distinct()), "secret-leak", "fail", 1),
        (one(external_calls(files).where("proto = 'http'")), "http-urls", "fail", 1),
        (one(untested_hubs(files, edges)), "hub-tests", "warn", 1),
        (one(graph.orphans(files, edges).where(~F.col("id").rlike(paths.NOT_CODE))), "orphans", "warn", max(1, -(-3 * n_files // 10))),
        (one(files.where(F.size(F.coalesce("dynamic_patterns", F.array())) > 0)), "dynamic", "info", n_files // 10 + 1),
        (one(env.where("status = 'unused'")), "env-unused", "info", 1),
    ]
    out = None
    for df, key, bad, least in checks:
        row = df.select(F.lit(key).alias("key"), F.when(F.col("n") >= least, bad).otherwise("ok").alias("status"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# Names of vendor directories and of the files that make a directory a project.
VENDOR_NAMES = ("vendor", "vendors", "third_party", "third-party", "external", "externals", "deps", "submodules")
LICENCE_FILE, MANIFEST_FILE = r"/(?:LICENSE|LICENCE|COPYING|LICENSE\.md|LICENSE\.txt)$", r"/(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod|Gemfile|pom\.xml)$"


def vendor_dirs(files: DataFrame, least: float = 0.3, depth: int = 3) -> DataFrame:
    """(dir, confidence, reasons): directories that look like a project of someone else, ``depth`` levels below a project's root.

    A repository of its own counts 0.5, an own manifest where the root has one too 0.3, a licence 0.2, a usual name 0.2; below a
    directory that reaches ``least`` no other is looked for. The first segment of a path is the project.
    """
    ids = files.select("id").where("id is not null").distinct()
    p = F.split("id", "/")
    prefixes = lambda most: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(p) - 1)), lambda n: F.array_join(F.slice(p, 1, n), "/"))
    dirs = ids.where(F.instr("id", "/") > 0).select(F.explode(prefixes(depth + 1)).alias("dir")).distinct()
    up = F.regexp_extract("id", r"^(.*)/[^/]*$", 1)
    sign = lambda rx, name: ids.where(F.col("id").rlike(rx)).select(up.alias("dir"), F.lit(name).alias("sign"))
    git = ids.where(F.col("id").rlike(r"/\.git/")).select(F.regexp_extract("id", r"^(.*?)/\.git/", 1).alias("dir"), F.lit("git").alias("sign"))
    manifest = sign(MANIFEST_FILE, "manifest")
    rooted = manifest.where(F.instr("dir", "/") == 0).select(F.col("dir").alias("top"), F.lit(True).alias("_root")).distinct()
    signs = sign(LICENCE_FILE, "licence").unionByName(manifest).unionByName(git).groupBy("dir").agg(F.collect_set("sign").alias("signs"))
    j = dirs.withColumn("top", F.substring_index("dir", "/", 1)).join(signs, "dir", "left").join(rooted, "top", "left").withColumn("signs", F.coalesce("signs", F.array()))
    has = lambda name: F.array_contains("signs", name)
    why = F.array_compact(F.array(
        F.when(has("git"), "nested repository"), F.when(has("licence"), "own licence"), F.when(has("manifest") & F.col("_root") & (F.instr("dir", "/") > 0), "own manifest"), F.when(F.lower(F.substring_index("dir", "/", -1)).isin(*VENDOR_NAMES), "usual name"),
    ))
    worth = F.create_map(*[F.lit(x) for x in ("nested repository", 50, "own licence", 20, "own manifest", 30, "usual name", 20)])
    scored = j.where(F.instr("dir", "/") > 0).select("dir", why.alias("why")).withColumn("c", F.aggregate("why", F.lit(0), lambda n, w: n + worth[w]))
    hits = scored.where(F.col("c") >= F.lit(round(least * 100)))
    d = F.split("dir", "/")
    above = hits.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(d) - 1), lambda n: F.array_join(F.slice(d, 1, n), "/"))).alias("_a"))
    below = above.join(hits.select(F.col("dir").alias("_a")), "_a", "left_semi").select("dir").distinct()
    return hits.join(below, "dir", "left_anti").select("dir", (F.least(F.lit(100), F.col("c")) / 100.0).cast("double").alias("confidence"), F.array_join("why", ", ").alias("reasons"))
