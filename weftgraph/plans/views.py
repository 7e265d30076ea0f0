"""Queries of views: symbols, packages, files, URLs, models, layouts, changes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import views
from weftgraph.plans import code_graph as cg
from weftgraph.session import table

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


def _symbols(spark, d):
    n = F.size(F.coalesce("dynamic_patterns", F.array())).cast("long")
    return cg._flat(spark, d, "dynamic_patterns").select("id", F.substring_index("id", "/", 2).alias("file"), n.alias("n_dynamic"))


_SYM = "sym AS (SELECT id, array_to_string(string_split(id, '/')[:2], '/') AS file, coalesce(len(dynamic_patterns), 0) AS n_dynamic FROM lf)"


@query(f"""{cg._G}, {_SYM}, {cg._walk_sql('users', 3, cg._SEEDS)}, r AS (SELECT h.seed, h.id, h.depth, s.file, s.n_dynamic FROM hop h JOIN sym s ON s.id = h.id WHERE h.depth > 0),
 sd AS (SELECT DISTINCT seed FROM hop) SELECT sd.seed, count(r.id)::BIGINT AS total, count(DISTINCT r.file)::BIGINT AS files, count(*) FILTER (WHERE r.depth = 1)::BIGINT AS at_1, count(*) FILTER (WHERE r.depth = 2)::BIGINT AS at_2,
 count(*) FILTER (WHERE r.depth = 3)::BIGINT AS at_3, coalesce(sum(r.n_dynamic), 0)::BIGINT AS dynamic_sites FROM sd LEFT JOIN r ON r.seed = sd.seed GROUP BY sd.seed""")
def r2_symbol_blast(spark, d):
    """How far changed symbols (here: modules) reach over calls, three steps against their direction."""
    e = cg._edges(spark, d)
    return views.symbol_blast(cg._seeds(spark, d, e), e, _symbols(spark, d), 3)


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE}, {_SYM} SELECT s.id, (SELECT count(*) FROM ke WHERE t = s.id AND coalesce(k, '') <> 'dynamic') AS callers, (SELECT count(*) FROM ke WHERE ke.s = s.id AND coalesce(k, '') <> 'dynamic') AS callees,
 (SELECT count(*) FROM ke WHERE ke.s = s.id AND k = 'dynamic') AS candidates, s.n_dynamic::BIGINT AS n_dynamic, c.source FROM sym s LEFT JOIN (SELECT id, max(substr(content, 1, 4000)) AS source FROM file_content WHERE content IS NOT NULL GROUP BY id) c ON c.id = s.id""")
def proj12_symbol_node(spark, d):
    """Callers, callees, candidates and source of every symbol (here: module); dynamic edges are its candidates."""
    e = cg._edges(spark, d).select("s", "t", F.when(F.col("k") == "dynamic", "candidate").otherwise(F.col("k")).alias("k"))
    return views.symbol_nodes(_symbols(spark, d), e, table(spark, d, "file_content").select("id", F.col("content").alias("text")))


@query(f"""{cg._G}, o AS (SELECT id, pkg AS package FROM lf WHERE pkg IS NOT NULL), x AS (SELECT ke.s, ke.t FROM ke JOIN o a ON a.id = ke.s JOIN o b ON b.id = ke.t WHERE a.package <> b.package)
 SELECT o.package, o.id, d.n_in + d.n_out AS mass, (SELECT count(*) FROM x WHERE x.t = o.id) AS n_in_cross, (SELECT count(*) FROM x WHERE x.s = o.id) AS n_out_cross FROM o JOIN deg d ON d.id = o.id""")
def a7_package_detail(spark, d):
    """Files of each package by mass, with the edges that cross its border."""
    return views.package_detail(cg._flat(spark, d, "pkg").select("id", F.col("pkg").alias("package")), cg._edges(spark, d))


@query("""SELECT DISTINCT id, coalesce(strlen(content), 0)::BIGINT AS bytes, CASE WHEN strlen(content) <= 2097152 THEN sha256(content) END AS sha256, CASE WHEN content IS NULL THEN 'unread' WHEN strlen(content) > 2097152 THEN 'too large' ELSE 'ok' END AS state FROM file_content WHERE id IS NOT NULL""")
def proj5_file_read(spark, d):
    return views.read_files(table(spark, d, "file_content").select("id", "content"))


_PATHS = r"""u AS (SELECT DISTINCT CASE WHEN p = '' THEN '/' WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path FROM (SELECT regexp_replace(regexp_replace(regexp_replace(c.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', '') AS p FROM (SELECT unnest(api_calls) AS c FROM lf) WHERE c.url IS NOT NULL))"""


@query(f"""WITH {cg._LF}, {_PATHS}, r AS (SELECT DISTINCT x.path AS route, len(list_filter(string_split(x.path, '/'), lambda y: regexp_matches(y, '^(:|\\{{|<|\\[|\\*)')))::BIGINT AS dynamic,
  '^/*' || regexp_replace(regexp_replace(regexp_replace(x.path, '^/+', ''), '(:[^/]*|\\{{[^/]*|<[^/]*)', '[^/]+', 'g'), '/?\\*[^/]*$', '(/.*)?') || '/*$' AS re FROM (SELECT unnest(routes) AS x FROM lf) WHERE x.path IS NOT NULL),
 h AS (SELECT u.path, min(struct_pack(d := r.dynamic, r := r.route)) AS x FROM u JOIN r ON regexp_matches(u.path, r.re) GROUP BY u.path) SELECT path, x.r AS route, x.d AS dynamic FROM h""")
def proj10_match_url(spark, d):
    """The route that serves each called URL."""
    f = cg._flat(spark, d, "routes", "api_calls")
    urls = f.select(F.explode("api_calls").alias("c")).where("c.url is not null").select(paths.url_path(F.col("c.url")).alias("path"))
    return views.match_urls(urls, f.select(F.explode("routes").alias("r")).where("r.path is not null").select(F.col("r.path").alias("route")))


@query(f"""WITH {cg._LF}, m AS (SELECT DISTINCT x.name AS model FROM (SELECT unnest(db_models) AS x FROM lf) WHERE x.name IS NOT NULL), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '[a-zA-Z0-9_]+')) AS model FROM file_content WHERE content IS NOT NULL AND id IS NOT NULL),
 h AS (SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY id) AS r FROM w WHERE model IN (SELECT model FROM m)) SELECT model, id FROM h WHERE r <= 200""")
def a11_schema_usage(spark, d):
    """Files that use the name of a model."""
    m = cg._flat(spark, d, "db_models").select(F.explode("db_models").alias("m")).select(F.col("m.name").alias("model"))
    return views.model_usage(m, table(spark, d, "file_content").select("id", "content"))


@query(f"{cg._G} SELECT l.ext, count(*) AS n_files, sum(d.n_in)::BIGINT AS n_in, sum(d.n_out)::BIGINT AS n_out FROM lf l JOIN deg d ON d.id = l.id GROUP BY l.ext ORDER BY 2 DESC, 1 LIMIT 30")
def a23a_legend(spark, d):
    return views.legend(cg._flat(spark, d).select("id", "ext"), cg._edges(spark, d))


@query("""WITH p AS (SELECT label AS part, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), m AS (SELECT part, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM p GROUP BY part),
 d AS (SELECT p.part, m.n, round(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2), 6) AS d FROM p JOIN m ON m.part = p.part), r AS (SELECT part, d, row_number() OVER (PARTITION BY part ORDER BY d) - 1 AS i, n FROM d)
 SELECT m.part, round(mx, 6) AS x, round(my, 6) AS y, round(mz, 6) AS z, m.n, r.d AS radius FROM m JOIN r ON r.part = m.part AND r.i = floor(r.n * 0.95)""")
def a23b_centroids(spark, d):
    """Centre and radius of each part of a layout; the first three components of the vectors are the places."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return views.centroids(table(spark, d, "embeddings").select(F.col("label").alias("part"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


@query(f"""WITH {cg._LF} SELECT DISTINCT id || '#' || m.name AS symbol, m.name AS name, 'model' AS kind, id AS file, array_to_string(list_transform(m.fields, lambda f: f.name), ',') AS fields FROM (SELECT id, unnest(db_models) AS m FROM lf) WHERE m.name IS NOT NULL""")
def j20_model_symbols(spark, d):
    """Database models as symbols of their files."""
    m = cg._flat(spark, d, "db_models").select("id", F.explode("db_models").alias("m")).where("m.name is not null")
    return m.select(F.concat_ws("#", "id", "m.name").alias("symbol"), "m.name", F.lit("model").alias("kind"), F.col("id").alias("file"), F.array_join(F.transform("m.fields", lambda f: f["name"]), ",").alias("fields")).distinct()


@query(f"""WITH {cg._LF}, {cg._CE}, {cg._KE}, f AS (SELECT DISTINCT s, t FROM ke JOIN lf ON lf.id = ke.s WHERE lf.confidence = 'high'), tr AS (SELECT DISTINCT s, t FROM ke WHERE k = 'import')
 SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM tr) AS n_true, n AS n_both, round(n / (SELECT nullif(count(*), 0) FROM f), 6) AS precision, round(n / (SELECT nullif(count(*), 0) FROM tr), 6) AS recall FROM (SELECT count(*) AS n FROM f JOIN tr ON tr.s = f.s AND tr.t = f.t)""")
def t7_rates(spark, d):
    """Precision and recall of the links of trusted files against imports."""
    e = cg._edges(spark, d)
    sure = e.join(cg._flat(spark, d, "confidence").where("confidence = 'high'").select(F.col("id").alias("s")), "s", "left_semi")
    return views.rates(sure, e.where("k = 'import'"), ["s", "t"])


@query("""WITH h AS (SELECT epoch_us(min(last_seen)) // 2 + epoch_us(max(last_seen)) // 2 AS t FROM files), f AS (SELECT * FROM files WHERE id IS NOT NULL AND last_seen IS NOT NULL),
 b AS (SELECT id, arg_max(size, struct_pack(a := last_seen, b := size)) AS m FROM f WHERE epoch_us(last_seen) <= (SELECT t FROM h) AND size IS NOT NULL GROUP BY id), a AS (SELECT id, arg_max(size, struct_pack(a := last_seen, b := size)) AS m FROM f WHERE size IS NOT NULL GROUP BY id)
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'add' WHEN a.id IS NULL THEN 'unlink' ELSE 'change' END AS change FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.m <> b.m""")
def w1_file_changes(spark, d):
    """What changed between the manifest of half the time and the newest one."""
    f = table(spark, d, "files").where("id is not null and last_seen is not null and size is not null").select("id", "size", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("us"))
    every = table(spark, d, "files").select(F.unix_micros(F.col("last_seen").cast("timestamp")).alias("us"))
    half = every.agg((F.floor(F.min("us") / 2) + F.floor(F.max("us") / 2)).alias("half"))
    newest = lambda df: df.groupBy("id").agg(F.max_by("size", F.struct("us", "size")).alias("mark"))
    return views.file_changes(newest(f.join(F.broadcast(half)).where("us <= half")), newest(f))
