"""Queries over the code-graph tables: listings, degrees, traversal, resolution, packages and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import audit, graph, modules, resolve
from weftgraph.session import Cut, table
from weftgraph.sources.code_tree import ENV_NAME

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LF = r"""lf AS (SELECT * EXCLUDE (rn, ext), coalesce(nullif(ltrim(lower(ext), '.'), ''), lower(regexp_extract(id, '\.([^./]+)$', 1))) AS ext
 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, size DESC NULLS LAST, loc DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""
_CE = "ce AS (SELECT DISTINCT s, t, k FROM edges WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t)"
_KE = "ke AS (SELECT * FROM ce WHERE s IN (SELECT id FROM lf) AND t IN (SELECT id FROM lf))"
_DEG = """deg AS (SELECT l.id, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(o.n, 0)::BIGINT AS n_out FROM lf l
 LEFT JOIN (SELECT t AS id, count(*) AS n FROM ke GROUP BY t) i ON i.id = l.id LEFT JOIN (SELECT s AS id, count(*) AS n FROM ke GROUP BY s) o ON o.id = l.id)"""
_G = f"WITH RECURSIVE {_LF}, {_CE}, {_KE}, {_DEG}"
_TEST = paths.TEST_PATH


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _files(spark, d):
    return graph.snapshot(table(spark, d, "files"))


def _edges(spark, d, files=None):
    return graph.known_edges(table(spark, d, "edges"), files if files is not None else table(spark, d, "files").select("id"))


def _flat(spark, d, *cols):
    """The snapshot with only the columns asked for, read from the scan on."""
    want = {"id", "ext", "last_seen", "size", "loc", *cols}
    f = table(spark, d, "files")
    return graph.snapshot(f.select(*[c for c in f.columns if c in want]))


@query(f"WITH {_LF} SELECT id, ext, size, loc, pkg, confidence, last_seen FROM lf")
def s5_snapshot(spark, d):
    return _flat(spark, d, "pkg", "confidence").select("id", "ext", "size", "loc", "pkg", "confidence", "last_seen")


@query(
    "SELECT DISTINCT id, len(list_filter(string_split(id, '/')[:-2], lambda x: x IN ("
    + ", ".join(f"'{x}'" for x in paths.IGNORED_DIRS)
    + f") OR regexp_matches(x, '{paths.IGNORED_PREFIX}'))) > 0 AS ignored FROM files"
)
def s2_ignored(spark, d):
    return table(spark, d, "files").select("id").distinct().select("id", paths.ignored("id").alias("ignored"))


_RULES = "# built\n/ts-tonrost/lib/\n*.min.js\n**/vendor/**\ngen/\n!*.keep.ts\n"


@query(r"""SELECT DISTINCT id, NOT regexp_matches(id, '(?:^|/)[^/]*\.keep\.ts(?:/|$)') AND (regexp_matches(id, '^ts-tonrost/lib/') OR regexp_matches(id, '(?:^|/)[^/]*\.min\.js(?:/|$)') OR regexp_matches(id, '(?:^|/)vendor/.') OR regexp_matches(id, '(?:^|/)gen/')) AS ignored FROM files""")
def s3_ignore_rules(spark, d):
    """Paths under the rules of an ignore file; the last rule that matches decides."""
    rules = paths.ignore_rules(_RULES)
    return table(spark, d, "files").select("id").distinct().select("id", paths.ignored_by("id", rules).alias("ignored"))


@query(r"""SELECT DISTINCT id, CASE WHEN content IS NULL THEN NULL WHEN content = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + 1 END::BIGINT AS loc,
 coalesce(strlen(content), 0)::BIGINT AS bytes, content IS NULL AS unread FROM file_content WHERE id IS NOT NULL""")
def s5_records(spark, d):
    c = table(spark, d, "file_content").where(F.col("id").isNotNull())
    loc = F.when(F.col("content").isNull(), None).when(F.col("content") == "", 0).otherwise(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1)
    return c.select("id", loc.cast("long").alias("loc"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"), F.col("content").isNull().alias("unread")).distinct()


_ENV_KEY = r"^(?:export\s+)?([A-Z][A-Z0-9_]*)\s*="


def _declared(spark, d):
    c = table(spark, d, "file_content").where(F.col("id").rlike(ENV_NAME))
    lines = c.select(F.col("id").alias("file"), F.explode(F.split("content", "\n")).alias("l"))
    return lines.select("file", F.regexp_extract(F.trim("l"), _ENV_KEY, 1).alias("var")).where(F.col("var") != "").distinct()


_DECL = rf"""decl AS (SELECT DISTINCT file, regexp_extract(trim(l), '{_ENV_KEY}', 1) AS var FROM (SELECT id AS file, unnest(string_split(content, chr(10))) AS l
 FROM file_content WHERE regexp_matches(id, '{ENV_NAME}')) WHERE regexp_extract(trim(l), '{_ENV_KEY}', 1) <> '')"""


@query(f"WITH {_DECL} SELECT file, var FROM decl")
def s6_env_keys(spark, d):
    return _declared(spark, d).select("file", "var")


_VENDOR_LEAST = 0.2


@query(rf"""WITH ids AS (SELECT DISTINCT id FROM files WHERE id IS NOT NULL), dirs AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS dir FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(id, '/') AS p FROM ids)) WHERE n BETWEEN 2 AND 4),
 lic AS (SELECT DISTINCT regexp_extract(id, '^(.*)/[^/]*$', 1) AS dir FROM ids WHERE regexp_matches(id, '{audit.LICENCE_FILE}')), man AS (SELECT DISTINCT regexp_extract(id, '^(.*)/[^/]*$', 1) AS dir FROM ids WHERE regexp_matches(id, '{audit.MANIFEST_FILE}')),
 git AS (SELECT DISTINCT regexp_extract(id, '^(.*?)/\.git/', 1) AS dir FROM ids WHERE contains(id, '/.git/')),
 sc AS (SELECT dir, [CASE WHEN dir IN (SELECT dir FROM git) THEN 50 ELSE 0 END, CASE WHEN dir IN (SELECT dir FROM lic) THEN 20 ELSE 0 END, CASE WHEN dir IN (SELECT dir FROM man) AND string_split(dir, '/')[1] IN (SELECT dir FROM man) THEN 30 ELSE 0 END,
  CASE WHEN lower(regexp_extract(dir, '([^/]*)$', 1)) IN ({", ".join(f"'{x}'" for x in audit.VENDOR_NAMES)}) THEN 20 ELSE 0 END] AS c FROM dirs), h AS (SELECT * FROM sc WHERE list_sum(c) >= 20)
 SELECT dir, (least(100, list_sum(c)) / 100.0)::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN c[1] > 0 THEN 'nested repository' END, CASE WHEN c[2] > 0 THEN 'own licence' END, CASE WHEN c[3] > 0 THEN 'own manifest' END, CASE WHEN c[4] > 0 THEN 'usual name' END], lambda x: x IS NOT NULL), ', ') AS reasons
 FROM h WHERE NOT EXISTS (SELECT 1 FROM h a WHERE starts_with(h.dir, a.dir || '/'))""")
def s7_vendor_dirs(spark, d):
    """Directories with signs of a vendored project, by confidence; a usual name alone is enough here, since the tables hold no manifests."""
    return audit.vendor_dirs(table(spark, d, "files").select("id"), _VENDOR_LEAST)


@query(f"WITH {_LF} SELECT id, regexp_extract(regexp_extract(id, '([^/]*)$', 1), '^(.*)$', 1) AS name, ext FROM lf WHERE contains(lower(id), 'shared')")
def proj4_find_shared(spark, d):
    return _flat(spark, d).where(F.contains(F.lower("id"), F.lit("shared"))).select("id", paths.base_name("id").alias("name"), "ext")


@query(f"{_G} SELECT l.id, l.ext, l.loc, l.size, d.n_in FROM lf l JOIN deg d ON d.id = l.id WHERE l.ext = 'ts' AND d.n_in >= 2 ORDER BY d.n_in DESC, l.id LIMIT 50 OFFSET 10")
def proj1_listing(spark, d):
    """A page of the listing: one extension, a least mass, sorted by mass and then id."""
    f = _flat(spark, d)
    deg = graph.degrees(f, _edges(spark, d))
    return f.where("ext = 'ts'").join(deg.where("n_in >= 2"), "id").select("id", "ext", "loc", "size", "n_in").orderBy(F.col("n_in").desc(), "id").offset(10).limit(50)


@query(f"""{_G}, u AS (SELECT t, string_agg(s, ', ' ORDER BY s) AS importers FROM (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY s) AS r FROM (SELECT DISTINCT s, t FROM ke)) WHERE r <= 20 GROUP BY t)
 SELECT l.id, l.ext, l.loc, l.size, sha256(c.content) AS sha256, d.n_in, d.n_out, coalesce(u.importers, '') AS importers FROM lf l LEFT JOIN u ON u.t = l.id JOIN deg d ON d.id = l.id
 JOIN (SELECT id, max(content) AS content FROM file_content GROUP BY id) c ON c.id = l.id WHERE c.content IS NOT NULL""")
def proj2_node_detail(spark, d):
    f = _flat(spark, d)
    c = table(spark, d, "file_content").where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.sha2("content", 256)).alias("sha256"), F.count_distinct(F.sha2("content", 256)).alias("_n"))
    e = _edges(spark, d)
    return f.join(c.where("sha256 is not null"), "id").join(graph.degrees(f, e), "id").join(graph.first_users(e, 20), "id", "left").select("id", "ext", "loc", "size", "sha256", "n_in", "n_out", F.coalesce("importers", F.lit("")).alias("importers"))


@query(f"{_G}, hub AS (SELECT id FROM deg ORDER BY n_in DESC, id LIMIT 1) SELECT s, t, k FROM ke WHERE t IN (SELECT id FROM hub)")
def proj3_users_of_hub(spark, d):
    e = _edges(spark, d)
    hub = e.groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(1).select("t")
    return e.join(F.broadcast(hub), "t").select("s", "t", "k")


@query(rf"""WITH {_LF} SELECT id, CASE WHEN regexp_matches(id, '{_TEST}') THEN 'tests' WHEN regexp_matches(id, '{paths.CONFIG_PATH}') THEN 'config'
 WHEN regexp_matches(id, '{paths.DOC_PATH}') THEN 'docs' WHEN coalesce(ext, '') <> '' THEN 'source' ELSE 'other' END AS category,
 CASE WHEN regexp_matches(lower(id), '{paths.BACKEND_PATH}') THEN 'backend' WHEN regexp_matches(lower(id), '{paths.FRONTEND_PATH}') THEN 'frontend'
 WHEN regexp_matches(id, '{paths.FRONTEND_EXT}') THEN 'frontend' WHEN regexp_matches(id, '{paths.BACKEND_EXT}') THEN 'backend' ELSE 'shared' END AS side FROM lf""")
def proj7_proj8_classes(spark, d):
    f = _flat(spark, d)
    return f.select("id", paths.path_category("id", "ext").alias("category"), paths.side("id").alias("side"))


@query()
def proj9_page_routes(spark, d):
    """URLs of files under file-system routing, of each package as its own root."""
    f = table(spark, d, "files").select("id").distinct()
    inner = F.regexp_replace("id", r"^[^/]+/(?:packages/[^/]+/)?", "")
    return f.select("id", paths.page_route(inner).alias("url")).where(F.col("url").isNotNull())


@query(rf"""WITH {_LF}, r AS (SELECT DISTINCT l.id AS t, x.path AS path, x.method AS method FROM lf l, unnest(l.routes) AS u(x) WHERE x.path IS NOT NULL)
 SELECT path, count(DISTINCT t)::BIGINT AS n_files, string_agg(DISTINCT method, ',' ORDER BY method) AS methods,
 len(list_filter(string_split(path, '/'), lambda s: s LIKE ':%' OR s = '*'))::BIGINT AS n_dynamic FROM r GROUP BY path""")
def proj10_route_index(spark, d):
    r = _files(spark, d).select(F.col("id").alias("t"), F.explode("routes").alias("r")).select("t", "r.path", "r.method").where(F.col("path").isNotNull())
    dyn = F.size(F.filter(F.split("path", "/"), lambda s: F.startswith(s, F.lit(":")) | (s == "*"))).cast("long")
    return r.groupBy("path").agg(F.count_distinct("t").alias("n_files"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")).select("path", "n_files", "methods", dyn.alias("n_dynamic"))


@query(rf"""WITH {_LF}, m AS (SELECT id, CASE WHEN contains(lower(id), 'tel') THEN 'path' WHEN len(list_filter(routes, lambda r: contains(lower(coalesce(r.path, '')), 'tel'))) > 0 THEN 'route'
 WHEN len(list_filter(api_calls, lambda c: contains(lower(coalesce(c.url, '')), 'tel'))) > 0 THEN 'api-call' END AS via FROM lf)
 SELECT id, via, CASE WHEN regexp_matches(lower(id), '{paths.BACKEND_PATH}') THEN 'backend' WHEN regexp_matches(lower(id), '{paths.FRONTEND_PATH}') THEN 'frontend'
 WHEN regexp_matches(id, '{paths.FRONTEND_EXT}') THEN 'frontend' WHEN regexp_matches(id, '{paths.BACKEND_EXT}') THEN 'backend' ELSE 'shared' END AS side FROM m WHERE via IS NOT NULL""")
def proj15_feature(spark, d):
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("tel"))
    via = F.when(has(F.col("id")), "path").when(F.exists("routes", lambda r: has(r["path"])), "route").when(F.exists("api_calls", lambda c: has(c["url"])), "api-call")
    return _files(spark, d).select("id", via.alias("via"), paths.side("id").alias("side")).where(F.col("via").isNotNull())


@query(f"WITH {_LF}, {_CE}, {_KE} SELECT s, t, k FROM ke")
def j4_j21_edges(spark, d):
    return _edges(spark, d)


@query(f"{_G} SELECT id, n_in, n_out FROM deg")
def a2_degrees(spark, d):
    f = table(spark, d, "files").select("id").where("id is not null")
    return graph.degrees(f, _edges(spark, d))


@query(f"{_G} SELECT d.id, d.n_in FROM deg d JOIN lf l ON l.id = d.id WHERE d.n_in >= 2 AND l.ext NOT IN ('md','mdx','markdown','rst','txt','adoc') ORDER BY d.n_in DESC, d.id LIMIT 10")
def a3_top_hubs(spark, d):
    f = _flat(spark, d)
    return f.join(graph.degrees(f, _edges(spark, d)), "id").where((F.col("n_in") >= 2) & ~F.col("ext").isin(*paths.DOC_EXTS)).select("id", "n_in").orderBy(F.col("n_in").desc(), "id").limit(10)


@query(f"{_G} SELECT l.id, l.ext, l.loc FROM lf l JOIN deg d ON d.id = l.id WHERE n_in = 0 AND n_out = 0")
def a4_orphans(spark, d):
    return graph.orphans(_flat(spark, d), _edges(spark, d)).select("id", "ext", "loc")


def _walk_sql(direction: str, depth: int, seeds: str) -> str:
    on = {"users": "e.t = w.id", "deps": "e.s = w.id", "both": "(e.t = w.id OR e.s = w.id)"}[direction]
    to = {"users": "e.s", "deps": "e.t", "both": "CASE WHEN e.t = w.id THEN e.s ELSE e.t END"}[direction]
    return f"seeds AS ({seeds}), w(seed, id, depth) AS (SELECT id, id, 0 FROM seeds UNION SELECT w.seed, {to}, w.depth + 1 FROM w JOIN ke e ON {on} WHERE w.depth < {depth}), hop AS (SELECT seed, id, min(depth)::BIGINT AS depth FROM w GROUP BY seed, id)"


_HUB = "SELECT id FROM deg ORDER BY n_in DESC, id LIMIT 1"
#: The query set of operators on changed files: files that an older scan knows too, and the most used one.
_SEEDS = "SELECT id FROM (SELECT id FROM files WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT last_seen) > 1 UNION (SELECT id FROM deg ORDER BY n_in DESC, id LIMIT 1))"


@query(f"{_G}, {_walk_sql('users', 3, _HUB)} SELECT h.id, h.depth, l.size, l.loc, CASE WHEN regexp_matches(h.id, '{_TEST}') THEN 'tests' WHEN regexp_matches(h.id, '{paths.CONFIG_PATH}') THEN 'config' WHEN regexp_matches(h.id, '{paths.DOC_PATH}') THEN 'docs' WHEN coalesce(l.ext, '') <> '' THEN 'source' ELSE 'other' END AS category, round(coalesce(l.size, 0) / 4)::BIGINT AS tokens FROM hop h JOIN lf l ON l.id = h.id")
def r1_blast_users(spark, d):
    """Everything within three hops that depends on the most used file."""
    f = _flat(spark, d)
    e = _edges(spark, d)
    hub = e.groupBy(F.col("t").alias("id")).count().orderBy(F.col("count").desc(), "id").limit(1)
    hop = graph.bfs(hub, e, 3, "users")
    return hop.join(f, "id").select("id", "depth", "size", "loc", paths.path_category("id", "ext").alias("category"), F.round(F.coalesce(F.col("size"), F.lit(0)) / 4).cast("long").alias("tokens"))


def _seeds(spark, d, e):
    f = table(spark, d, "files").select("id", "last_seen").where("id is not null")
    changed = f.groupBy("id").agg(F.count_distinct("last_seen").alias("n")).where("n > 1").select("id")
    return changed.union(graph.degrees(f, e).orderBy(F.col("n_in").desc(), "id").limit(1).select("id")).distinct()


@query(f"{_G}, {_walk_sql('deps', 2, _SEEDS)} SELECT seed, id, depth FROM hop")
def r1_blast_deps(spark, d):
    e = _edges(spark, d)
    return graph.bfs(_seeds(spark, d, e), e, 2, "deps")


@query(f"{_G}, {_walk_sql('users', 2, _SEEDS)} SELECT seed, count(*) - 1 AS dependents, count(*) FILTER (WHERE regexp_matches(id, '{_TEST}')) AS tests FROM hop GROUP BY seed")
def r3_ci_blast(spark, d):
    """For each of several changed files, what depends on it within two hops and how much of that is tests."""
    e = _edges(spark, d)
    hop = graph.bfs(_seeds(spark, d, e), e, 2, "users")
    return hop.groupBy("seed").agg((F.count(F.lit(1)) - 1).alias("dependents"), F.sum(paths.is_test("id").cast("long")).alias("tests"))


@query(f"{_G}, {_walk_sql('users', 2, _SEEDS)} SELECT 'dependents' AS gate, max(n)::BIGINT AS worst, max(n) <= 50 AS passed FROM (SELECT seed, count(*) - 1 AS n FROM hop GROUP BY seed)")
def r4_ci_gate(spark, d):
    got = r3_ci_blast(spark, d)
    return got.agg(F.max("dependents").alias("worst")).select(F.lit("dependents").alias("gate"), "worst", (F.col("worst") <= 50).alias("passed"))


@query(f"""{_G}, {_walk_sql('users', 2, _SEEDS)}, b AS (SELECT h.seed, h.id, h.depth, d.n_in, ceil(coalesce(l.size, 0) / 4.0)::BIGINT AS tokens FROM hop h JOIN lf l ON l.id = h.id JOIN deg d ON d.id = h.id),
 s AS (SELECT *, sum(tokens) OVER w AS total, row_number() OVER w AS r FROM b WINDOW w AS (PARTITION BY seed ORDER BY depth, n_in DESC, id ROWS UNBOUNDED PRECEDING))
 SELECT seed, id, depth, tokens, total::BIGINT AS total FROM s WHERE total <= 4000 OR r = 1""")
def r8_bundle(spark, d):
    f = _flat(spark, d)
    e = _edges(spark, d)
    hop = graph.bfs(_seeds(spark, d, e), e, 2, "users").join(f.select("id", "size"), "id").join(graph.degrees(f, e), "id")
    return graph.bundle(hop, 4000).select("seed", "id", "depth", "tokens", "total")


@query(f"{_G}, {_walk_sql('both', 2, _SEEDS)} SELECT seed, id, depth FROM hop")
def r9_focus_distances(spark, d):
    e = Cut(spark, "focus")(_edges(spark, d))
    return graph.bfs_packed(_seeds(spark, d, e), e, 2, "both")


@query(f"""{_G}, lab(id, c) AS (SELECT id, id FROM lf UNION SELECT e.s, l.c FROM lab l JOIN ke e ON e.t = l.id WHERE l.c < e.s AND e.k = 'reexport' UNION SELECT e.t, l.c FROM lab l JOIN ke e ON e.s = l.id WHERE l.c < e.t AND e.k = 'reexport')
 SELECT id, min(c) AS component FROM lab GROUP BY id""".replace("UNION SELECT e.t, l.c", "UNION SELECT e.t, l.c"))
def r10_components(spark, d):
    """Components of the re-export links."""
    e = _edges(spark, d).where("k = 'reexport'")
    return graph.components(table(spark, d, "files").select("id").where("id is not null").distinct(), e)


SQL["r10_components"] = f"""WITH RECURSIVE {_LF}, {_CE}, {_KE}, u AS (SELECT s AS a, t AS b FROM ke WHERE k = 'reexport' UNION SELECT t, s FROM ke WHERE k = 'reexport'),
 lab(id, c) AS (SELECT id, id FROM lf UNION SELECT u.b, l.c FROM lab l JOIN u ON u.a = l.id WHERE l.c < u.b OR l.c < l.id)
 SELECT id, min(c) AS component FROM lab GROUP BY id"""


@query()
def r5_reachable(spark, d):
    """Files that entry files reach along imports and re-exports."""
    e = _edges(spark, d).where(F.col("k").isin("import", "require", "include", "reexport"))
    f = table(spark, d, "files").select("id").distinct()
    return graph.reachable(f.where(F.col("id").rlike(r"(?:^|/)(?:index|main)\.[a-z]+$")), e)


SQL["r5_reachable"] = f"""WITH RECURSIVE {_LF}, {_CE}, {_KE}, r(id) AS (SELECT id FROM lf WHERE regexp_matches(id, '(?:^|/)(?:index|main)\\.[a-z]+$')
 UNION SELECT e.t FROM r JOIN ke e ON e.s = r.id WHERE e.k IN ('import', 'require', 'include', 'reexport')) SELECT id FROM r"""


@query()
def r6_accounting(spark, d):
    """Every file as entry, reachable, possible (dynamic edges too) or dead."""
    e = _edges(spark, d)
    f = table(spark, d, "files").select("id").distinct()
    entries = f.where(F.col("id").rlike(r"(?:^|/)(?:index|main)\.[a-z]+$"))
    sure = e.where(F.col("k").isin("import", "require", "include", "reexport"))
    return audit.partition_reach(f, entries, sure, e.where(F.col("k").isin("dynamic", "ref", "worker", "process")))


SQL["r6_accounting"] = f"""WITH RECURSIVE {_LF}, {_CE}, {_KE}, en AS (SELECT id FROM lf WHERE regexp_matches(id, '(?:^|/)(?:index|main)\\.[a-z]+$')),
 r(id) AS (SELECT id FROM en UNION SELECT e.t FROM r JOIN ke e ON e.s = r.id WHERE e.k IN ('import', 'require', 'include', 'reexport')),
 p(id) AS (SELECT id FROM en UNION SELECT e.t FROM p JOIN ke e ON e.s = p.id WHERE e.k IN ('import', 'require', 'include', 'reexport', 'dynamic', 'ref', 'worker', 'process'))
 SELECT id, CASE WHEN id IN (SELECT id FROM en) THEN 'entry' WHEN id IN (SELECT id FROM r) THEN 'reachable' WHEN id IN (SELECT id FROM p) THEN 'possible' ELSE 'dead' END AS class FROM lf"""

_OWN = """own AS (SELECT id, arg_max(name, length(root)) AS package FROM (SELECT l.id, p.root, p.name FROM lf l JOIN (SELECT rel_root AS root, min(name) AS name FROM packages GROUP BY rel_root) p ON starts_with(l.id, p.root || '/')) GROUP BY id)"""


@query(f"WITH {_LF}, {_OWN} SELECT l.id, o.package FROM lf l LEFT JOIN own o ON o.id = l.id")
def j7_package_owner(spark, d):
    return graph.owners(table(spark, d, "files").select("id").where("id is not null"), table(spark, d, "packages"))


@query(f"""WITH {_LF}, {_CE}, {_KE}, {_OWN} SELECT a.package AS s_pkg, b.package AS t_pkg, count(*) AS n_edges, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS kinds
 FROM ke JOIN own a ON a.id = ke.s JOIN own b ON b.id = ke.t WHERE a.package <> b.package GROUP BY 1, 2""")
def r11_package_edges(spark, d):
    owned = graph.owners(table(spark, d, "files").select("id").where("id is not null"), table(spark, d, "packages"))
    return graph.package_edges(_edges(spark, d), owned)


@query(f"""WITH {_LF}, {_CE}, {_KE}, {_OWN}, pe AS (SELECT a.package AS s_pkg, b.package AS t_pkg FROM ke JOIN own a ON a.id = ke.s JOIN own b ON b.id = ke.t WHERE a.package <> b.package)
 SELECT o.package, count(*) AS n_files, coalesce(sum(l.loc), 0)::BIGINT AS loc, coalesce(sum(l.size), 0)::BIGINT AS size,
 (SELECT count(*) FROM pe WHERE t_pkg = o.package) AS edges_in, (SELECT count(*) FROM pe WHERE s_pkg = o.package) AS edges_out FROM own o JOIN lf l ON l.id = o.id GROUP BY o.package""")
def a6_packages(spark, d):
    f = _flat(spark, d)
    owned = graph.owners(f.select("id"), table(spark, d, "packages")).where("package is not null")
    pe = graph.package_edges(_edges(spark, d), owned)
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    base = owned.join(f, "id").groupBy("package").agg(F.count(F.lit(1)).alias("n_files"), z(F.sum("loc")).alias("loc"), z(F.sum("size")).alias("size"))
    i = pe.groupBy(F.col("t_pkg").alias("package")).agg(F.sum("n_edges").alias("_i"))
    o = pe.groupBy(F.col("s_pkg").alias("package")).agg(F.sum("n_edges").alias("_o"))
    return base.join(i, "package", "left").join(o, "package", "left").select("package", "n_files", "loc", "size", z(F.col("_i")).alias("edges_in"), z(F.col("_o")).alias("edges_out"))


@query(f"""{_G} SELECT (SELECT count(*) FROM lf) AS files, (SELECT count(*) FROM ke WHERE k IS DISTINCT FROM 'asset') AS code_edges, (SELECT count(*) FROM ke WHERE k = 'asset') AS asset_edges,
 (SELECT count(*) FROM deg WHERE n_in = 0 AND n_out = 0) AS orphans, (SELECT count(*) FROM lf WHERE len(dynamic_patterns) > 0) AS dynamic_files,
 (SELECT count(*) FROM lf WHERE confidence = 'low') AS low, (SELECT count(*) FROM lf WHERE confidence = 'medium') AS medium,
 (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM (SELECT ext AS x, count(*) AS n FROM lf GROUP BY ext ORDER BY n DESC, x LIMIT 5)) AS top_ext, (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM (SELECT string_split(id, '/')[1] AS x, count(*) AS n FROM lf GROUP BY 1 ORDER BY n DESC, x LIMIT 5)) AS top_folders,
 (SELECT string_agg(id, ', ' ORDER BY n_in DESC, id) FROM (SELECT id, n_in FROM deg WHERE n_in >= 2 AND NOT regexp_matches(id, '{paths.DOC_PATH}') ORDER BY n_in DESC, id LIMIT 10)) AS top_hubs,
 (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM (SELECT regexp_extract(lower(u.url), '^(?:https?|wss?)://([^/:?#]+)', 1) AS x, sum(u.count) AS n FROM (SELECT unnest(external_urls) AS u FROM lf) GROUP BY 1 ORDER BY n DESC, x LIMIT 5)) AS top_domains""")
def a1_summary(spark, d):
    """Counts, and the greatest extensions, folders, hubs and external domains as lists."""
    f = _flat(spark, d, "confidence", "dynamic_patterns", "external_urls")
    e = _edges(spark, d)
    deg = graph.degrees(f, e)

    def top(df, most, name):
        """One row: the first ``most`` x of (x, n) by n and then x."""
        first = df.orderBy(F.col("n").desc(), "x").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "x"))).alias("l"))
        return first.select(F.array_join(F.transform("l", lambda r: r["x"]), ", ").alias(name))

    n = F.count(F.lit(1)).alias("n")
    lists = [
        top(f.groupBy(F.col("ext").alias("x")).agg(n), 5, "top_ext"), top(f.groupBy(F.substring_index("id", "/", 1).alias("x")).agg(n), 5, "top_folders"),
        top(deg.where((F.col("n_in") >= 2) & ~F.col("id").rlike(paths.DOC_PATH)).select(F.col("id").alias("x"), F.col("n_in").alias("n")), 10, "top_hubs"),
        top(f.select(F.explode("external_urls").alias("u")).groupBy(paths.url_host(F.col("u.url")).alias("x")).agg(F.sum("u.count").alias("n")), 5, "top_domains"),
    ]
    a = f.agg(F.count(F.lit(1)).alias("files"), F.sum((F.size(F.coalesce("dynamic_patterns", F.array())) > 0).cast("long")).alias("dynamic_files"), F.sum((F.col("confidence") == "low").cast("long")).alias("low"), F.sum((F.col("confidence") == "medium").cast("long")).alias("medium"))
    b = e.agg(F.sum((~F.col("k").eqNullSafe("asset")).cast("long")).alias("code_edges"), F.sum((F.col("k").eqNullSafe("asset")).cast("long")).alias("asset_edges"))
    c = deg.agg(F.sum(((F.col("n_in") == 0) & (F.col("n_out") == 0)).cast("long")).alias("orphans"))
    out = a.join(F.broadcast(b)).join(F.broadcast(c))
    for one in lists:
        out = out.join(F.broadcast(one))
    return out.select("files", "code_edges", "asset_edges", "orphans", "dynamic_files", "low", "medium", "top_ext", "top_folders", "top_hubs", "top_domains")


@query(f"WITH {_LF} SELECT ext, count(*) AS n, coalesce(sum(loc), 0)::BIGINT AS loc FROM lf GROUP BY ext")
def a1_ext_mix(spark, d):
    return _flat(spark, d).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))


@query("""SELECT dir, count(*) AS n_files FROM (SELECT array_to_string(p[1:n], '/') AS dir FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT DISTINCT id, string_split(id, '/') AS p FROM files WHERE id IS NOT NULL))) GROUP BY dir""")
def a24_file_tree(spark, d):
    p = F.split("id", "/")
    each = table(spark, d, "files").select("id").where("id is not null and instr(id, '/') > 0").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))).alias("dir"))
    return each.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))


_EXT_SQL = rf"""ext AS (SELECT DISTINCT regexp_extract(lower(url), '^(?:https?|wss?)://([^/:?#]+)', 1) AS domain, regexp_extract(lower(url), '^(https?|wss?)://', 1) AS proto, file, url, method FROM (
 SELECT l.id AS file, c.url AS url, coalesce(c.method, 'GET') AS method FROM lf l, unnest(l.api_calls) AS x(c) WHERE regexp_matches(lower(c.url), '^https?://')
 UNION ALL SELECT l.id, u.url, CASE WHEN starts_with(lower(u.url), 'ws') THEN 'WS' ELSE 'GET' END FROM lf l, unnest(l.external_urls) AS y(u)) WHERE regexp_extract(lower(url), '^(?:https?|wss?)://([^/:?#]+)', 1) <> '')"""


@query(f"WITH {_LF}, {_EXT_SQL} SELECT domain, min(proto) AS proto, count(*) AS n_calls, count(DISTINCT file) AS n_files FROM ext GROUP BY domain")
def a5_external_domains(spark, d):
    x = audit.external_calls(_files(spark, d))
    return x.groupBy("domain").agg(F.min("proto").alias("proto"), F.count(F.lit(1)).alias("n_calls"), F.count_distinct("file").alias("n_files"))


_USED = "used AS (SELECT DISTINCT v AS var, l.id AS file FROM lf l, unnest(l.env_usage) AS x(v) WHERE v IS NOT NULL)"
_ENV = """env AS (SELECT coalesce(d.var, u.var) AS var, CASE WHEN d.n IS NULL THEN 'undeclared' WHEN u.n IS NULL THEN 'unused' ELSE 'ok' END AS status, coalesce(d.n, 0)::BIGINT AS n_declared, coalesce(u.n, 0)::BIGINT AS n_used
 FROM (SELECT var, count(*) AS n FROM decl GROUP BY var) d FULL JOIN (SELECT var, count(*) AS n FROM used GROUP BY var) u ON u.var = d.var)"""


def _env(spark, d):
    used = _flat(spark, d, "env_usage").select(F.explode("env_usage").alias("var"), F.col("id").alias("file")).where("var is not null")
    return audit.env_status(_declared(spark, d), used)


@query(f"WITH {_LF}, {_DECL}, {_USED}, {_ENV} SELECT var, status, n_declared, n_used FROM env")
def a9_env_status(spark, d):
    return _env(spark, d)


@query(rf"""WITH {_LF}, {_USED} SELECT var, file FROM used WHERE (regexp_matches(lower(file), '{paths.FRONTEND_PATH}') OR regexp_matches(file, '{paths.FRONTEND_EXT}')) AND NOT regexp_matches(lower(file), '{paths.BACKEND_PATH}')
 AND NOT regexp_matches(file, '{paths.STYLE_EXT}') AND NOT regexp_matches(var, '{paths.PUBLIC_ENV}')""")
def a10_secret_leaks(spark, d):
    return audit.secret_leaks(_flat(spark, d, "env_usage"))


@query(f"WITH {_LF} SELECT m.name AS model, m.kind AS kind, l.id AS file, m.table_name AS table_name, len(m.fields)::BIGINT AS n_fields FROM lf l, unnest(l.db_models) AS x(m)")
def a11_schema_index(spark, d):
    m = _files(spark, d).select(F.col("id").alias("file"), F.explode("db_models").alias("m"))
    return m.select(F.col("m.name").alias("model"), "m.kind", "file", "m.table_name", F.size("m.fields").cast("long").alias("n_fields"))


@query(f"""{_G}, {_walk_sql('users', 3, _SEEDS)}, hit AS (SELECT h.seed AS id, count(*) - 1 AS dependents, count(*) FILTER (WHERE regexp_matches(h.id, '{_TEST}')) AS tests, max(CASE WHEN len(l.dynamic_patterns) > 0 THEN 1 ELSE 0 END) AS dyn
 FROM hop h JOIN lf l ON l.id = h.id GROUP BY h.seed), f AS (SELECT id, coalesce(len(routes), 0)::BIGINT AS n_routes, coalesce(len(api_calls), 0)::BIGINT AS n_api, coalesce(len(external_urls), 0)::BIGINT AS n_external, coalesce(len(dynamic_patterns), 0) > 0 AS dynamic FROM lf)
 SELECT f.id, array_to_string(list_filter([CASE WHEN dependents > 30 THEN 'many dependents' END, CASE WHEN n_routes > 0 THEN 'routes' END, CASE WHEN n_external > 0 THEN 'external URLs' END, CASE WHEN n_api > 0 THEN 'API calls' END, CASE WHEN dynamic THEN 'dynamic' END, CASE WHEN dependents BETWEEN 6 AND 30 THEN 'dependents' END], lambda x: x IS NOT NULL), ', ') AS reasons,
 CASE WHEN dependents > 30 THEN 'risky' WHEN n_routes > 0 OR n_external > 0 OR n_api > 0 OR dynamic OR dependents > 5 THEN 'caution' ELSE 'safe' END AS level,
 dependents, n_routes, n_api, n_external, dynamic, tests, CASE WHEN dynamic OR dyn = 1 THEN 'limited' ELSE 'high' END AS confidence FROM f JOIN hit ON hit.id = f.id""")
def a12_safety(spark, d):
    f = _files(spark, d)
    e = _edges(spark, d)
    return audit.safety(_seeds(spark, d, e), f, e)


@query(rf"""{_G}, {_DECL}, {_USED}, {_ENV}, {_EXT_SQL}, n(key, bad, least, n) AS (
 SELECT 'env-undeclared', 'fail', 1, (SELECT count(*) FROM env WHERE status = 'undeclared')
 UNION ALL SELECT 'secret-leak', 'fail', 1, (SELECT count(DISTINCT var) FROM used WHERE (regexp_matches(lower(file), '{paths.FRONTEND_PATH}') OR regexp_matches(file, '{paths.FRONTEND_EXT}')) AND NOT regexp_matches(lower(file), '{paths.BACKEND_PATH}') AND NOT regexp_matches(file, '{paths.STYLE_EXT}') AND NOT regexp_matches(var, '{paths.PUBLIC_ENV}'))
 UNION ALL SELECT 'http-urls', 'fail', 1, (SELECT count(*) FROM ext WHERE proto = 'http')
 UNION ALL SELECT 'hub-tests', 'warn', 1, (SELECT count(*) FROM deg d WHERE n_in >= 10 AND NOT EXISTS (SELECT 1 FROM ke WHERE ke.t = d.id AND regexp_matches(ke.s, '{_TEST}')))
 UNION ALL SELECT 'orphans', 'warn', (SELECT greatest(1, ceil(0.3 * count(*))) FROM lf), (SELECT count(*) FROM deg WHERE n_in = 0 AND n_out = 0 AND NOT regexp_matches(id, '{paths.NOT_CODE}'))
 UNION ALL SELECT 'dynamic', 'info', (SELECT count(*) // 10 + 1 FROM lf), (SELECT count(*) FROM lf WHERE len(dynamic_patterns) > 0)
 UNION ALL SELECT 'env-unused', 'info', 1, (SELECT count(*) FROM env WHERE status = 'unused'))
 SELECT key, CASE WHEN n >= least THEN bad ELSE 'ok' END AS status, n FROM n""")
def a13_preflight(spark, d):
    return audit.preflight(_files(spark, d), _edges(spark, d), _env(spark, d))


@query(f"{_G} SELECT id, n_in FROM deg d WHERE n_in >= 10 AND NOT EXISTS (SELECT 1 FROM ke WHERE ke.t = d.id AND regexp_matches(ke.s, '{_TEST}'))")
def a15_untested_hubs(spark, d):
    return audit.untested_hubs(table(spark, d, "files").select("id").distinct(), _edges(spark, d))


def _case(column: str, markers, what: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{m[0]}') THEN {repr(m[what])}" for m in markers) + " END"


_BASE = "regexp_extract(d.id, '([^/]*)$', 1)"


@query(rf"""{_G}, d AS (SELECT deg.*, lf.ext, len(lf.dynamic_patterns) > 0 AS dyn FROM deg JOIN lf ON lf.id = deg.id)
 SELECT id, 'orphan' AS category, NULL AS marker, round(greatest(0.1, least(0.99, 0.85 - CASE WHEN dyn THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches(id, '{audit.LEGACY_TEST}') THEN 0.2 ELSE 0 END - CASE WHEN ext IN ('md', 'json', 'yaml', 'yml') THEN 0.25 ELSE 0 END)), 4)::DOUBLE AS confidence, n_in
 FROM d WHERE n_in = 0 AND n_out = 0 AND NOT regexp_matches(id, '{audit.ENTRY_PATH}')
 UNION ALL SELECT id, 'path', {_case('d.id', audit.PATH_MARKERS, 1)}, round(greatest(0.1, least(0.99, {_case('d.id', audit.PATH_MARKERS, 2)} - least(0.4, 0.1 * n_in))), 4)::DOUBLE, n_in FROM d WHERE {_case('d.id', audit.PATH_MARKERS, 1)} IS NOT NULL
 UNION ALL SELECT id, 'name', {_case(_BASE, audit.NAME_MARKERS, 1)}, round(greatest(0.1, least(0.99, {_case(_BASE, audit.NAME_MARKERS, 2)} - least(0.35, 0.08 * n_in))), 4)::DOUBLE, n_in FROM d WHERE {_case(_BASE, audit.NAME_MARKERS, 1)} IS NOT NULL""")
def a16_cleanup(spark, d):
    f = _flat(spark, d, "dynamic_patterns")
    return audit.cleanup(f, _edges(spark, d))


@query()
def a16_superseded(spark, d):
    return audit.superseded(_flat(spark, d), _edges(spark, d))


@query(f"""WITH {_LF}, {_CE}, {_KE}, calls AS (SELECT DISTINCT l.id AS s, c.method AS method, c.url AS url, CASE WHEN p = '' THEN '/' WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM (
  SELECT l.id, x.c, regexp_replace(regexp_replace(regexp_replace(x.c.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', '') AS p FROM lf l, unnest(l.api_calls) AS x(c) WHERE x.c.url IS NOT NULL AND NOT regexp_matches(lower(x.c.url), '^(https?|wss?)://')) l),
 routes AS (SELECT DISTINCT l.id AS t, r.method AS m, r.path AS path, '^' || regexp_replace(regexp_replace(r.path, ':[A-Za-z_]\\w*|\\{{[^/}}]*\\}}|<[^/>]*>', '[^/]+', 'g'), '\\*', '.*', 'g') || '$' AS re FROM lf l, unnest(l.routes) AS x(r) WHERE r.path IS NOT NULL)
 SELECT DISTINCT s, t, method, url, path FROM calls JOIN routes ON (m = method OR m = 'ALL') AND regexp_matches(p, re) AND s <> t""")
def j5_api_links(spark, d):
    return resolve.api_links(_files(spark, d))


_TRIED = [("b", 0), *[(f"b || '.{e}'", 1 + i) for i, e in enumerate(resolve.PROBE_EXT)], *[(f"CASE WHEN regexp_matches(b, '\\.(js|jsx|mjs|cjs)$') THEN regexp_replace(b, '\\.(js|jsx|mjs|cjs)$', '') || '.{e}' END", 20 + i) for i, e in enumerate(("ts", "tsx"))], *[(f"b || '/{n}'", 30 + i) for i, n in enumerate(resolve.INDEX_FILES)]]


@query(rf"""WITH {_LF}, a AS (SELECT DISTINCT s, i.spec AS spec, i.kind AS kind, regexp_replace(s, '/?[^/]*$', '') AS here FROM (SELECT id AS s, unnest(imports) AS i FROM lf) WHERE regexp_matches(i.spec, '^\.\.?(/|$)')),
 b AS (SELECT *, CASE WHEN spec LIKE '../%' THEN regexp_replace(here, '/?[^/]*$', '') || '/' || spec[4:] ELSE here || '/' || spec[3:] END AS b FROM a), c AS ({" UNION ALL ".join(f"SELECT s, spec, kind, {x} AS t, {r} AS r FROM b" for x, r in _TRIED)})
 SELECT b.s, b.spec, b.kind, k.t FROM b LEFT JOIN (SELECT s, spec, kind, arg_min(t, r) AS t FROM c WHERE t IN (SELECT id FROM lf) GROUP BY s, spec, kind) k ON k.s = b.s AND k.spec = b.spec AND k.kind IS NOT DISTINCT FROM b.kind""")
def j1_imports(spark, d):
    """Relative import specifiers of every file resolved against the snapshot's ids."""
    f = _files(spark, d)
    imps = f.select(F.col("id").alias("s"), F.explode("imports").alias("i")).select("s", "i.spec", "i.kind")
    return resolve.resolve_imports(imps, f.select("id"))


@query(rf"""WITH {_LF}, x AS (SELECT *, lower(regexp_extract(s, '\.([^./]+)$', 1)) AS e, regexp_replace(s, '/?[^/]*$', '') AS here FROM (SELECT DISTINCT id AS s, i.spec AS spec FROM (SELECT id, unnest(imports) AS i FROM lf)) WHERE spec <> ''),
 b AS (SELECT s, spec, here || '/' || replace(ltrim(spec, '.'), '.', '/') AS b FROM x WHERE e = 'py' AND spec LIKE '.%' AND spec NOT LIKE '..%'),
 c AS (SELECT s, spec, b || '.py' AS t, 0 AS r FROM b UNION ALL SELECT s, spec, b || '/__init__.py', 1 FROM b UNION ALL SELECT s, spec, here || '/' || spec, 0 FROM x WHERE e IN ('c', 'h')
  UNION ALL SELECT x.s, x.spec, l.id, 100 + length(l.id) FROM x JOIN lf l ON x.e IN ('c', 'h') AND string_split(l.id, '/')[1] = string_split(x.s, '/')[1] AND ends_with(l.id, '/' || x.spec))
 SELECT x.s, x.spec, k.t FROM x LEFT JOIN (SELECT s, spec, min(struct_pack(r := r, t := t)).t AS t FROM c WHERE t IN (SELECT id FROM lf) GROUP BY s, spec) k ON k.s = x.s AND k.spec = x.spec""")
def j2_lookups(spark, d):
    """Specifiers that are no script's paths, looked up by their language's rules within the repository."""
    f = _files(spark, d)
    imps = f.select(F.col("id").alias("s"), F.explode("imports").alias("i")).select("s", "i.spec")
    return modules.resolve_modules(imps, f.select("id"), table(spark, d, "file_content").select("id", "content"), by_project=True)


@query(f"""WITH RECURSIVE {_LF}, {_CE}, {_KE}, w(seed, id, n) AS (SELECT s, t, 1 FROM ke WHERE k = 'reexport' AND s IN (SELECT t FROM ke WHERE k = 'import') UNION SELECT w.seed, e.t, w.n + 1 FROM w JOIN ke e ON e.s = w.id AND e.k = 'reexport' WHERE w.n < 400),
 r AS (SELECT seed, id, min(n) AS n FROM w WHERE seed <> id GROUP BY seed, id) SELECT u.s AS "user", r.id, min(r.n)::BIGINT AS depth FROM (SELECT DISTINCT s, t FROM ke WHERE k = 'import') u JOIN r ON r.seed = u.t GROUP BY u.s, r.id""")
def j8_barrel_reach(spark, d):
    """Files that an import reaches through re-exports, to any depth, for files that import a re-exporting one."""
    e = _edges(spark, d)
    re = e.where("k = 'reexport'")
    users = e.where("k = 'import'").select(F.col("s").alias("user"), F.col("t").alias("seed")).distinct()
    imported = re.select(F.col("s").alias("id")).distinct().join(users.select(F.col("seed").alias("id")).distinct(), "id", "left_semi")
    reach = graph.bfs(imported, re, None, "deps").where("depth > 0")
    return users.join(reach, "seed").groupBy("user", "id").agg(F.min("depth").alias("depth"))


SQL["j8_barrel_reach"] = f"""WITH RECURSIVE {_LF}, {_CE}, {_KE}, w(seed, id, depth) AS (SELECT DISTINCT s, s, 0 FROM ke WHERE k = 'reexport' UNION SELECT w.seed, e.t, w.depth + 1 FROM w JOIN ke e ON e.s = w.id AND e.k = 'reexport' WHERE w.depth < 130),
 hop AS (SELECT seed, id, min(depth) AS depth FROM w GROUP BY seed, id) SELECT u.s AS "user", h.id, min(h.depth)::BIGINT AS depth FROM (SELECT DISTINCT s, t FROM ke WHERE k = 'import') u JOIN hop h ON h.seed = u.t WHERE h.depth > 0 AND h.id <> h.seed GROUP BY u.s, h.id"""


@query(r"""WITH b AS (SELECT DISTINCT id, regexp_extract(id, '([^/]*)$', 1) AS n, string_split(id, '/')[1] AS top FROM files WHERE id IS NOT NULL),
 m AS (SELECT id, top, lower(regexp_replace(regexp_replace(n, '\.[^.]*$', ''), '(?i)(?:^test[_-]?|[._-]?(?:test|tests|spec)$)', '', 'g')) AS stem, regexp_matches(n, '(?i)^test_|[._-](?:test|spec)\.|_test\.|(?:Test|Tests|Spec)\.') AS t FROM b),
 x AS (SELECT a.id AS test, min(struct_pack(n := -length(b.stem), far := a.top <> b.top, id := b.id)).id AS source FROM m a JOIN m b ON a.t AND NOT b.t AND b.stem <> '' AND (b.stem = a.stem OR length(b.stem) >= 4 AND contains(a.stem, b.stem)) GROUP BY a.id) SELECT test, source FROM x""")
def j18_test_pairs(spark, d):
    return resolve.test_pairs(table(spark, d, "files").select("id").where("id is not null"))


@query(f"{_G}, {_walk_sql('users', 1, _HUB)} SELECT s || chr(9) || t || chr(9) || coalesce(k, '') AS line FROM ke")
def k1_edges_tsv(spark, d):
    return _edges(spark, d).select(F.concat_ws("\t", "s", "t", F.coalesce("k", F.lit(""))).alias("line"))


@query(f"""WITH {_LF}, {_CE}, {_KE} SELECT k, count(*) AS n, count(DISTINCT s) AS n_sources, count(DISTINCT t) AS n_targets FROM ke GROUP BY k""")
def a21_edge_kinds(spark, d):
    return _edges(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_sources"), F.count_distinct("t").alias("n_targets"))


@query(f"""{_G} SELECT (SELECT count(*) FROM lf) AS nodes, (SELECT count(*) FROM ke) AS edges, round(2.0 * (SELECT count(*) FROM ke) / greatest(1, (SELECT count(*) FROM lf)), 6)::DOUBLE AS mean_degree, (SELECT max(n_in + n_out) FROM deg) AS max_degree""")
def a23_graph_stats(spark, d):
    f = table(spark, d, "files").select("id").where("id is not null")
    deg = graph.degrees(f, _edges(spark, d))
    return deg.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_in").alias("edges"), F.round(F.lit(2.0) * F.sum("n_in") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("mean_degree"), F.max(F.col("n_in") + F.col("n_out")).alias("max_degree"))


@query(f"""WITH {_LF} SELECT ext, count(*) AS n_files, ext IN ('py', 'js', 'ts', 'go', 'java', 'c') AS covered FROM lf GROUP BY ext""")
def a20_coverage(spark, d):
    return _flat(spark, d).groupBy("ext").agg(F.count(F.lit(1)).alias("n_files")).select("ext", "n_files", F.col("ext").isin("py", "js", "ts", "go", "java", "c").alias("covered"))


@query("SELECT id, count(*) AS n_scans, min(last_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(size, last_seen) - arg_min(size, last_seen) AS size_delta FROM (SELECT DISTINCT id, last_seen, max(size) OVER (PARTITION BY id, last_seen) AS size FROM files WHERE last_seen IS NOT NULL AND id IS NOT NULL) GROUP BY id HAVING count(*) > 1")
def a32_changes(spark, d):
    f = table(spark, d, "files").where("id is not null and last_seen is not null").groupBy("id", "last_seen").agg(F.max("size").alias("size"))
    w = f.groupBy("id").agg(F.count(F.lit(1)).alias("n_scans"), F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("_l"), (F.max_by("size", F.struct(F.col("size").isNotNull(), "last_seen")) - F.min_by("size", F.struct(F.col("size").isNull(), "last_seen"))).alias("size_delta"))
    return w.where("n_scans > 1").select("id", "n_scans", "first_seen", F.col("_l").alias("last_seen"), "size_delta")


@query(f"""{_G}, en AS (SELECT id FROM lf WHERE regexp_matches(id, '(?:^|/)(?:index|main|app|server|cli)\\.[a-z]+$') ORDER BY length(id), id LIMIT 3),
 hu AS (SELECT id FROM deg WHERE n_in >= 2 AND id NOT IN (SELECT id FROM en) ORDER BY n_in DESC, id LIMIT 5), ex AS (SELECT id FROM lf WHERE len(external_urls) > 0 AND id NOT IN (SELECT id FROM en) AND id NOT IN (SELECT id FROM hu) ORDER BY len(external_urls) DESC, id LIMIT 3)
 SELECT id, 'entry' AS stop FROM en UNION ALL SELECT id, 'hub' FROM hu UNION ALL SELECT id, 'external' FROM ex""")
def a18_tour(spark, d):
    f = _flat(spark, d, "external_urls")
    entry = f.where(F.col("id").rlike(r"(?:^|/)(?:index|main|app|server|cli)\.[a-z]+$")).orderBy(F.length("id"), "id").limit(3).select("id")
    hubs = graph.degrees(f, _edges(spark, d)).where("n_in >= 2").join(F.broadcast(entry), "id", "left_anti").orderBy(F.col("n_in").desc(), "id").limit(5).select("id")
    n = F.size(F.coalesce("external_urls", F.array()))
    ext = f.where(n > 0).join(F.broadcast(entry), "id", "left_anti").join(F.broadcast(hubs), "id", "left_anti").orderBy(n.desc(), "id").limit(3).select("id")
    return entry.withColumn("stop", F.lit("entry")).union(hubs.withColumn("stop", F.lit("hub"))).union(ext.withColumn("stop", F.lit("external")))


@query(f"""{_G} SELECT coalesce(l.ext, '') AS ext, l.confidence, count(*) AS n, count(*) FILTER (WHERE d.n_in = 0 AND d.n_out = 0) AS n_alone, count(*) FILTER (WHERE d.n_in >= 10) AS n_hubs FROM lf l JOIN deg d ON d.id = l.id GROUP BY coalesce(l.ext, ''), l.confidence""")
def a21_node_kinds(spark, d):
    """Nodes by extension and confidence, with those that stand alone and hubs of ten users or more."""
    f = _flat(spark, d, "confidence")
    j = f.join(graph.degrees(f, _edges(spark, d)), "id")
    n = lambda c: F.sum(c.cast("long"))
    return j.groupBy(F.coalesce("ext", F.lit("")).alias("ext"), "confidence").agg(F.count(F.lit(1)).alias("n"), n((F.col("n_in") == 0) & (F.col("n_out") == 0)).alias("n_alone"), n(F.col("n_in") >= 10).alias("n_hubs"))
