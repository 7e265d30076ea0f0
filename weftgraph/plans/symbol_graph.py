"""Queries over symbols, and the remaining listings and audits, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import extract, paths
from weftgraph.operators import audit, graph, resolve, search, symbols
from weftgraph.plans import code_graph as cg
from weftgraph.plans import facts
from weftgraph.session import Cut, table

#: Nodes of one payload of the graph view.
PAYLOAD_NODES = 40_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_PARTS = """sym AS (SELECT DISTINCT p_name || '@' || p_brand AS symbol, p_name AS name, p_brand AS file, min(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY p_name, p_brand) = 1 AS aux FROM part),
 calls AS (SELECT DISTINCT a.l_orderkey || '-' || pa.p_brand || '-' || pb.p_name AS call, pa.p_brand AS caller_file, pb.p_name AS name FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part pa ON pa.p_partkey = a.l_partkey JOIN part pb ON pb.p_partkey = b.l_partkey),
 imps AS (SELECT DISTINCT a.p_brand AS file, b.p_brand AS imported FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size < 5 AND a.p_brand <> b.p_brand)"""


def _parts(spark, d):
    part = table(spark, d, "part")
    sym = part.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("file")).agg((F.min((F.col("p_size") > 40).cast("int")) == 1).alias("aux")).withColumn("symbol", F.concat_ws("@", "name", "file"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    a = li.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("caller_file")), "l_partkey").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), "caller_file").distinct()
    b = li.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").select("l_orderkey", "l_linenumber", "name").distinct()
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), "caller_file", "name").alias("call"), "caller_file", "name").distinct()
    x = part.where("p_size < 5").select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_brand").alias("file"))
    imps = x.join(part.select("p_partkey", F.col("p_brand").alias("imported")), "p_partkey").where("file <> imported").select("file", "imported").distinct()
    return calls, sym, imps


@query(f"""WITH {_PARTS}, own AS (SELECT c.call, s.symbol FROM calls c JOIN sym s ON s.file = c.caller_file AND s.name = c.name),
 imp AS (SELECT c.call, count(*) AS n, min(s.symbol) AS symbol FROM calls c JOIN imps i ON i.file = c.caller_file JOIN sym s ON s.file = i.imported AND s.name = c.name GROUP BY c.call),
 al AS (SELECT name, count(*) AS n, min(symbol) AS symbol FROM sym WHERE NOT aux GROUP BY name)
 SELECT c.call, CASE WHEN o.symbol IS NOT NULL OR i.n = 1 OR (i.n IS NULL AND a.n = 1) THEN 'resolved' ELSE 'declined' END AS outcome,
 CASE WHEN o.symbol IS NOT NULL THEN o.symbol WHEN i.n = 1 THEN i.symbol WHEN i.n IS NULL AND a.n = 1 THEN a.symbol END AS target,
 CASE WHEN o.symbol IS NOT NULL OR i.n = 1 THEN NULL WHEN i.n > 1 THEN 'imported-ambiguous' WHEN a.n = 1 THEN NULL WHEN a.n IS NULL THEN 'no-match' ELSE 'ambiguous' END AS reason
 FROM calls c LEFT JOIN own o ON o.call = c.call LEFT JOIN imp i ON i.call = c.call LEFT JOIN al a ON a.name = c.name""")
def j10_priority_resolver(spark, d):
    """The priority resolver over parts as symbols and lines that follow each other as calls."""
    return resolve.resolve_calls(*_parts(spark, d))


_RE = f"WITH RECURSIVE {cg._LF}, {cg._CE}, {cg._KE}"


@query(f"""{_RE}, w(base, sub, n) AS (SELECT s, t, 1 FROM ke WHERE k = 'reexport' UNION SELECT w.base, e.t, w.n + 1 FROM w JOIN ke e ON e.s = w.sub AND e.k = 'reexport' WHERE w.n < 130),
 o AS (SELECT DISTINCT base, sub FROM w WHERE base <> sub AND sub IN (SELECT s FROM ke WHERE k = 'import')),
 r AS (SELECT base, sub, row_number() OVER (PARTITION BY base ORDER BY sub) AS r, count(*) OVER (PARTITION BY base) AS n FROM o)
 SELECT c.s AS call, r.sub || '.imports' AS target, r.n > 24 AS capped FROM (SELECT DISTINCT s, t FROM ke WHERE k = 'import') c JOIN r ON r.base = c.t WHERE r.r <= 24""")
def j14_dispatch(spark, d):
    """Imports of a re-exporting file as calls, its re-exports as subtypes: what each may reach, 24 at most."""
    e = cg._edges(spark, d)
    calls = e.where("k = 'import'").select(F.col("s").alias("call"), F.col("t").alias("cls"), F.lit("imports").alias("method")).distinct()
    ext = e.where("k = 'reexport'").select(F.col("t").alias("cls"), F.col("s").alias("base"))
    return symbols.dispatch(calls, ext, e.where("k = 'import'").select(F.col("s").alias("cls"), F.lit("imports").alias("method")).distinct())


@query(f"""{_RE}, st AS (SELECT s, min(t) AS n FROM ke WHERE k = 'reexport' GROUP BY s), c(file, place, steps) AS (SELECT s, s, 0 FROM st UNION ALL SELECT c.file, st.n, c.steps + 1 FROM c JOIN st ON st.s = c.place WHERE c.steps < 6)
 SELECT file, 'default' AS name, arg_max(place, steps) AS target_file, 'default' AS target_name, max(steps)::BIGINT AS steps FROM c GROUP BY file""")
def j9_alias_chase(spark, d):
    """Re-exports as aliases: where what a file hands on comes from, six steps at most."""
    e = cg._edges(spark, d).where("k = 'reexport'")
    al = e.select(F.col("s").alias("file"), F.lit("default").alias("exported"), F.col("t").alias("source"), F.lit("default").alias("orig"))
    return symbols.chase_aliases(al.select("file", F.col("exported").alias("name")), al)


@query()
def j5_api_links_loose(spark, d):
    """API calls joined with routes where ANY and partial URLs count."""
    return resolve.api_links(cg._files(spark, d), strict=False)


@query(f"WITH {facts._KEPT} SELECT DISTINCT * FROM ({facts._union(extract.MODELS, 'name')})")
def x23_models(spark, d):
    return extract.models(table(spark, d, "file_content").select("id", "content"))


@query()
def x32_python_flow(spark, d):
    return extract.python_flow(table(spark, d, "file_content").select("id", "content"))


@query()
def r7_argument_reach(spark, d):
    """Where the most common parameter of the smallest function name flows to."""
    flow = Cut(spark, "flow")(extract.python_flow(table(spark, d, "file_content").select("id", "content")))
    first = flow.where("fact = 'param'").orderBy("fn", "arg").select("fn", "name").first()
    return symbols.argument_reach(flow, first["fn"] if first else "", first["name"] if first else "")


@query(rf"""WITH {cg._LF} SELECT id, ext FROM lf WHERE regexp_matches(id, '^ts\-[^/]*/src/(?:.*/)?[^/]*\.ts$')""")
def proj6_glob(spark, d):
    """Files under a glob."""
    return cg._flat(spark, d).where(F.col("id").rlike("^" + paths.glob_regex("ts-*/src/**/*.ts") + "$")).select("id", "ext")


@query(f"""WITH {facts._KEPT}, y AS (SELECT DISTINCT id || '#' || name AS symbol, name, kind FROM ({facts._union(extract.SYMBOLS, 'name')})) SELECT symbol, name, kind FROM y WHERE contains(lower(name), 'drim') ORDER BY name, symbol LIMIT 50""")
def proj11_symbol_find(spark, d):
    s = extract.symbols(table(spark, d, "file_content").select("id", "content")).select(F.concat_ws("#", "id", "name").alias("symbol"), "name", "kind")
    return symbols.find(s, "drim")


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE}, hub AS (SELECT t FROM ke WHERE k = 'import' GROUP BY t ORDER BY count(*) DESC, t LIMIT 1) SELECT DISTINCT s AS caller, t AS callee, s IN (SELECT t FROM ke WHERE k = 'import') AS is_used FROM ke WHERE k = 'import' AND t IN (SELECT t FROM hub)""")
def proj13_callers(spark, d):
    """Who uses the most used target, and whether each is used itself."""
    e = cg._edges(spark, d).where("k = 'import'")
    hub = e.groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(1).select("t")
    used = e.select(F.col("t").alias("s")).distinct().withColumn("_u", F.lit(True))
    return e.join(F.broadcast(hub), "t").join(used, "s", "left").select(F.col("s").alias("caller"), F.col("t").alias("callee"), F.coalesce("_u", F.lit(False)).alias("is_used")).distinct()


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE} SELECT DISTINCT id FROM (SELECT id FROM lf WHERE contains(id, '/src/core/') UNION SELECT t FROM ke WHERE k = 'worker') WHERE id IN (SELECT id FROM lf WHERE confidence = 'high')""")
def proj14_active_set(spark, d):
    """Union of two sets of files, kept where a file has high confidence."""
    f = cg._flat(spark, d, "confidence")
    a = f.where(F.contains("id", F.lit("/src/core/"))).select("id").union(cg._edges(spark, d).where("k = 'worker'").select("t"))
    return a.distinct().join(f.where("confidence = 'high'").select("id"), "id", "left_semi")


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE}, n AS (SELECT id FROM lf ORDER BY id LIMIT {PAYLOAD_NODES}) SELECT s, t, k FROM ke WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)""")
def a22_payload(spark, d, most: int = PAYLOAD_NODES):
    """Edges with both ends among the nodes that one payload holds, ``most`` at most."""
    n = cg._flat(spark, d).select("id").orderBy("id").limit(most)
    return cg._edges(spark, d).join(n.withColumnRenamed("id", "s"), "s", "left_semi").join(n.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t", "k")


@query(f"""WITH {cg._LF} SELECT count(*) AS files, ceil(sum(coalesce(size, 0)) / 4.0)::BIGINT AS tokens, max(last_seen) AS scanned_at FROM lf""")
def a26_a33_health(spark, d):
    return cg._flat(spark, d).agg(F.count(F.lit(1)).alias("files"), F.ceil(F.sum(F.coalesce(F.col("size"), F.lit(0))) / 4.0).cast("long").alias("tokens"), F.max("last_seen").alias("scanned_at"))


@query("""SELECT CAST(first_seen AS DATE) AS day, count(*) AS n_new FROM (SELECT id, min(last_seen) AS first_seen FROM files WHERE id IS NOT NULL AND last_seen IS NOT NULL GROUP BY id) GROUP BY 1""")
def a32_first_seen_days(spark, d):
    """Files by the day they were first seen."""
    f = table(spark, d, "files").where("id is not null and last_seen is not null").groupBy("id").agg(F.min("last_seen").alias("t"))
    return f.groupBy(F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n_new"))


@query(f"""{cg._G}, {cg._walk_sql('both', 2, cg._HUB)} SELECT h.id, h.depth, d.n_in + d.n_out AS mass FROM hop h JOIN deg d ON d.id = h.id ORDER BY h.depth, 3 DESC, h.id LIMIT 40""")
def a25_labels(spark, d):
    """The forty nodes to label round a focus: nearest first, then heaviest."""
    f = table(spark, d, "files").select("id").where("id is not null")
    e = cg._edges(spark, d)
    deg = graph.degrees(f, e)
    hub = deg.orderBy(F.col("n_in").desc(), "id").limit(1).select("id")
    return graph.bfs(hub, e, 2, "both").join(deg, "id").select("id", "depth", (F.col("n_in") + F.col("n_out")).alias("mass")).orderBy("depth", F.col("mass").desc(), "id").limit(40)


@query(f"""WITH {cg._LF}, o AS (SELECT id, arg_min(size, last_seen) AS before, arg_max(size, last_seen) AS after FROM files WHERE last_seen IS NOT NULL AND size IS NOT NULL GROUP BY id) SELECT id, before, after FROM o WHERE before <> after""")
def a32_changed_sizes(spark, d):
    """Files whose first and newest scan differ."""
    f = table(spark, d, "files").where("id is not null and last_seen is not null and size is not null").groupBy("id").agg(F.min_by("size", "last_seen").alias("before"), F.max_by("size", "last_seen").alias("after"))
    return f.where("before <> after")


@query(f"""WITH p AS ({cg.SQL["a13_preflight"]}), o(rank, priority, key) AS (VALUES (0, 'high', 'env-undeclared'), (1, 'high', 'hub-tests'), (2, 'medium', 'orphans'), (3, 'medium', 'env-unused'), (4, 'low', 'dynamic')), v AS ({cg.SQL["s7_vendor_dirs"]}) SELECT o.rank, o.priority, o.key, p.n FROM o JOIN p ON p.key = o.key WHERE p.status <> 'ok' UNION ALL SELECT 5, 'low', 'vendored', n FROM (SELECT count(*) AS n FROM v) WHERE n > 0""")
def a14_suggestions(spark, d):
    """What to look at next, by priority: environment, hubs without tests, orphans, unused variables, dynamic share, vendored directories."""
    checks = {r["key"]: r for r in audit.preflight(cg._files(spark, d), cg._edges(spark, d), cg._env(spark, d)).collect()}
    order = [("high", "env-undeclared"), ("high", "hub-tests"), ("medium", "orphans"), ("medium", "env-unused"), ("low", "dynamic")]
    rows = [(i, p, k, checks[k]["n"]) for i, (p, k) in enumerate(order) if checks[k]["status"] != "ok"]
    vendored = cg.s7_vendor_dirs(spark, d).count()
    if vendored:
        rows.append((len(order), "low", "vendored", vendored))
    return spark.createDataFrame(rows, "rank int, priority string, key string, n long")


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 5) AS similarity FROM v, v q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) SELECT query, id, similarity, rank FROM r WHERE rank <= 10""")
def t4_cosine_batch(spark, d):
    """The ten nearest rows of each query vector (ids divisible by 50), against all rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.cosine_batch(e, e.where("id % 50 = 0"), 10)


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE} SELECT to_json(struct_pack(source := s, target := t, kind := k)) AS line FROM ke""")
def k2_json_lines(spark, d):
    return cg._edges(spark, d).select(F.to_json(F.struct(F.col("s").alias("source"), F.col("t").alias("target"), F.col("k").alias("kind")), {"ignoreNullFields": "false"}).alias("line"))
