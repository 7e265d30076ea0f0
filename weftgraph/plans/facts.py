"""Queries that extract facts from file contents, and symbol-level resolution over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import extract, paths, references
from weftgraph.operators import calls, graph, resolve, search
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


def _c(spark, d):
    return table(spark, d, "file_content").select("id", "content")


def _q(s: str) -> str:
    return s.replace("'", "''")


_LANG = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.FAMILY.items()) + " ELSE e END"
_KEPT = rf"kept AS (SELECT id, content, {_LANG} AS lang FROM (SELECT DISTINCT id, content, lower(regexp_extract(id, '\.([^./]+)$', 1)) AS e FROM file_content WHERE id IS NOT NULL AND length(content) > 0))"


def _union(patterns: dict, name: str) -> str:
    return " UNION ".join(f"SELECT id, unnest(regexp_extract_all(content, '{_q(rx)}', 1)) AS {name}, '{k}' AS kind FROM kept WHERE lang = '{lang}'" for lang, rules in patterns.items() for rx, k in rules)


@query(f"WITH {_KEPT}, g AS ({_union(extract.IMPORTS, 'spec')}) SELECT id, spec, kind FROM g WHERE NOT (kind IN ('asset', 'ref', 'use') AND regexp_matches(spec, '^(?:https?:|//|data:|mailto:|#)'))")
def x2_x14_imports(spark, d):
    return extract.imports(_c(spark, d))


@query(f"WITH {_KEPT}, u AS (SELECT id, regexp_replace(unnest(regexp_extract_all(content, '{_q(extract.URL)}', 1)), '[.,;:!?]+$', '') AS url FROM kept) SELECT id, url, count(*) AS n FROM u WHERE length(url) >= 12 GROUP BY id, url")
def x21_urls(spark, d):
    return extract.urls(_c(spark, d))


@query(f"WITH {_KEPT} " + " UNION ".join(f"SELECT id, unnest(regexp_extract_all(content, '{_q(p)}', 1)) AS var FROM kept" for p in extract.ENV_READS))
def x22_env_reads(spark, d):
    return extract.env_reads(_c(spark, d))


_DYN = ", ".join("CASE WHEN regexp_matches(content, '" + _q(rx.replace(r"(?<![\w.])", r"(?:^|[^\w.])")) + f"') THEN '{n}' END" for n, rx in extract.DYNAMIC)


@query(f"""WITH {_KEPT}, p AS (SELECT id, list_sort(list_distinct(flatten(list(list_filter([{_DYN}], lambda x: x IS NOT NULL))))) AS p FROM kept GROUP BY id)
 SELECT id, coalesce(array_to_string(p, ','), '') AS patterns, CASE WHEN list_has_any(p, ['eval', 'new-function', 'exec', 'injection']) THEN 'low' WHEN len(p) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM p""")
def x25_x26_dynamic(spark, d):
    return extract.dynamic(_c(spark, d))


@query(
    f"WITH {_KEPT}, r AS ("
    + " UNION ".join(f"SELECT id, upper(unnest(regexp_extract_all(content, '{_q(p)}', 1))) AS m, unnest(regexp_extract_all(content, '{_q(p)}', 2)) AS path FROM kept" for p in extract.ROUTES)
    + ") SELECT DISTINCT id, CASE WHEN m IN ('ROUTE', 'HANDLE', 'HANDLEFUNC') THEN 'ANY' ELSE m END AS method, path FROM r"
)
def x15_x17_routes(spark, d):
    return extract.routes(_c(spark, d))


@query(
    f"WITH {_KEPT}, u AS (" + " UNION ".join(f"SELECT id, unnest(regexp_extract_all(content, '{_q(p)}', 1)) AS u FROM kept" for p in extract.CALLS)
    + r") SELECT DISTINCT id, regexp_replace(u, '\$\{.*$', '') AS url, contains(u, '${') AS partial FROM u WHERE regexp_replace(u, '\$\{.*$', '') <> ''"
)
def x19_x20_api_calls(spark, d):
    return extract.api_calls(_c(spark, d))


@query(f"WITH {_KEPT} SELECT DISTINCT * FROM ({_union(extract.SYMBOLS, 'name')})")
def x27_x30_symbols(spark, d):
    return extract.symbols(_c(spark, d))


@query()
def x5_x29_python_facts(spark, d):
    return extract.python_facts(_c(spark, d))


@query()
def j10_resolve_calls(spark, d):
    """Calls of Python files resolved against declarations and imports, or declined with a reason."""
    return resolve.resolve_calls(*_python(spark, d))


@query()
def j12_candidates(spark, d):
    """What a declined call could mean."""
    asked, symbols, imps = _python(spark, d)
    open_ = resolve.resolve_calls(asked, symbols, imps).where("outcome = 'declined'").select("call")
    return resolve.candidates(asked.join(open_, "call"), symbols)


def _python(spark, d):
    facts = extract.python_facts(_c(spark, d))
    symbols = facts.where(F.col("fact").isin("function", "method", "class")).select(
        F.concat_ws("#", "id", "name", F.col("line").cast("string")).alias("symbol"), F.substring_index("name", ".", -1).alias("name"), F.col("id").alias("file"), paths.is_test("id").alias("aux"),
    )
    asked = facts.where("fact = 'call'").select(F.concat_ws("#", "id", F.col("line").cast("string"), "name").alias("call"), F.col("id").alias("caller_file"), "name").distinct()
    e = graph.clean_edges(table(spark, d, "edges")).where("k = 'import'")
    return asked, symbols, e.select(F.col("s").alias("file"), F.col("t").alias("imported"))


@query()
def j15_enclosing_symbol(spark, d):
    """The tightest Python definition round each call."""
    facts = extract.python_facts(_c(spark, d))
    spans = facts.where(F.col("fact").isin("function", "method", "class")).select(F.col("id").alias("file"), F.concat_ws("#", "id", "name", F.col("line").cast("string")).alias("id"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    points = facts.where("fact = 'call'").select(F.concat_ws("#", "id", F.col("line").cast("string"), "name").alias("point"), F.col("id").alias("file"), "line").distinct()
    return resolve.enclosing(points, spans, "file")


_BUCKETS = """spans AS (SELECT p_brand AS grp, p_partkey AS id, p_partkey AS lo, p_partkey + p_size AS hi FROM part),
 points AS (SELECT DISTINCT l_partkey * 100000 + l_suppkey AS point, p_brand AS grp, l_partkey + l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
 p1 AS (SELECT point, min(grp) AS grp, min(line) AS line FROM points GROUP BY point)"""


@query(f"WITH {_BUCKETS} SELECT point, (SELECT min(struct_pack(w := s.hi - s.lo, id := s.id)).id FROM spans s WHERE s.grp = p1.grp AND p1.line BETWEEN s.lo AND s.hi) AS id FROM p1")
def j15_range_join(spark, d):
    """Tightest interval round points, per group: parts' key ranges within a brand."""
    part = table(spark, d, "part")
    spans = part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi"))
    li = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    points = li.groupBy((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("point")).agg(F.min("p_brand").alias("grp"), F.min(F.col("l_partkey") + F.col("l_linenumber")).alias("line"))
    return resolve.enclosing(points, spans, "grp")


@query(f"WITH {_BUCKETS} SELECT point, (SELECT min(struct_pack(w := abs(p1.line - s.lo), id := s.id)).id FROM spans s WHERE s.grp = p1.grp) AS id FROM p1")
def j16_nearest(spark, d):
    """Nearest mark of the same group: as-of-like join of points with parts' keys within a brand."""
    part = table(spark, d, "part")
    marks = part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("at"))
    li = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    points = li.groupBy((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("point")).agg(F.min("p_brand").alias("grp"), F.min(F.col("l_partkey") + F.col("l_linenumber")).alias("line"))
    return resolve.nearest(points, marks, ["grp"])


@query(rf"""WITH m AS (SELECT DISTINCT id, content FROM file_content WHERE contains(lower(content), 'password')),
 l AS (SELECT id, n, string_split(replace(content, chr(13), ''), chr(10))[n] AS text FROM (SELECT id, content, unnest(range(1, length(content) - length(replace(content, chr(10), '')) + 2)) AS n FROM m))
 SELECT id, n AS line, len(regexp_extract_all(lower(text), 'password'))::BIGINT AS n_matches FROM l WHERE contains(lower(text), 'password')""")
def t1_search_lines(spark, d):
    """Lines with a needle, any case, and how often it stands there."""
    got = search.search(_c(spark, d).where("id is not null"), "password")
    return got.groupBy("id", "line").agg(F.count(F.lit(1)).alias("n_matches"))


@query()
def t1_search(spark, d):
    """The first hundred matches, ten a file, with column and snippet."""
    return search.search(_c(spark, d).where("id is not null"), "password", most=100, per_file=10)


@query()
def t3_explore(spark, d):
    """Symbols that match a query's keywords, by class."""
    s = extract.symbols(_c(spark, d))
    deg = graph.degrees(s.select("id").distinct(), graph.clean_edges(table(spark, d, "edges")))
    sym = s.join(deg.select("id", "n_in"), "id").select(F.concat_ws("#", "id", "name").alias("symbol"), "name", F.col("id").alias("file"), "n_in", F.lit(False).alias("deprecated"), F.col("id").rlike(r"(?i)\.(?:gen|min)\.").alias("aux"), F.col("id").rlike(r"(?:^|/)(?:index|main)\.").alias("entry")).distinct()
    return search.explore(sym, "sharedTelRost handlers")


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, (SELECT v FROM q)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS similarity FROM embeddings)
 SELECT id, similarity FROM s WHERE similarity > 0.1 ORDER BY similarity DESC, id LIMIT 30""")
def t4_cosine_top(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine_top(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 30, 0.1)


@query()
def t6_revision_diff(spark, d):
    """Line differences of each revision with the one before it."""
    r = table(spark, d, "documents").where("text is not null").groupBy("rev_id").agg(F.min_by(F.struct("text", "parent_rev_id"), "doc_id").alias("r")).select("rev_id", F.col("r.text").alias("after"), F.col("r.parent_rev_id").alias("p"))
    before = r.select(F.col("rev_id").alias("p"), F.col("after").alias("before"))
    return search.line_diff(r.where("p is not null").join(before, "p").select(F.col("rev_id").alias("id"), "before", "after")).where("op <> 'eq'")


@query()
def x28_call_sites(spark, d):
    """Calls of every language by patterns, with receivers and their types."""
    return references.call_sites(_c(spark, d))


@query()
def x29b_bases(spark, d):
    """Bases of declared classes."""
    return references.inheritance(_c(spark, d))


@query()
def x24_foreign(spark, d):
    """Foreign code that texts call."""
    return references.foreign(_c(spark, d))


@query(rf"""WITH {_KEPT}, l AS (SELECT DISTINCT id, l FROM (SELECT id, unnest(string_split(content, chr(10))) AS l FROM kept WHERE lang IN ('js', 'java', 'go', 'rs')) WHERE regexp_matches(l, '^\s*(?:(?:export|default|public|private|protected|static|final|abstract|async|pub) +)*(?:function|class|interface|func|fn|enum|type) +[A-Za-z_]')),
 s AS (SELECT id, l, regexp_extract(l, '(?:function|class|interface|func|fn|enum|type) +([A-Za-z_][a-zA-Z0-9_]*)', 1) AS name FROM l)
 SELECT DISTINCT id, name, regexp_matches(substr(l, 1, 120), '\b(?:pub|public|export|open)\b') OR regexp_matches(regexp_extract(l, '([A-Za-z_][a-zA-Z0-9_]*)', 1), '^[A-Z]') AS exported FROM s""")
def x29c_exported(spark, d):
    """Whether declarations are seen from outside, by their line."""
    c = extract.with_family(_c(spark, d)).where(F.col("lang").isin("js", "java", "go", "rs"))
    lines = c.select("id", F.explode(F.split("content", "\n")).alias("l")).where(F.col("l").rlike(r"^\s*(?:(?:export|default|public|private|protected|static|final|abstract|async|pub) +)*(?:function|class|interface|func|fn|enum|type) +[A-Za-z_]"))
    name = F.regexp_extract("l", r"(?:function|class|interface|func|fn|enum|type) +([A-Za-z_]\w*)", 1)
    return lines.select("id", name.alias("name"), references.exported(F.col("l")).alias("exported")).distinct()


@query(f"""WITH {_KEPT}, y AS (SELECT DISTINCT id, name FROM ({_union(extract.SYMBOLS, 'name')})), lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, size DESC NULLS LAST, loc DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1),
 h AS (SELECT DISTINCT id, r.method AS method, r.path AS path, r.handler AS handler FROM (SELECT id, unnest(routes) AS r FROM lf) WHERE r.handler IS NOT NULL)
 SELECT h.id AS file, h.method, h.path, h.handler, CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.id = h.id AND y.name = h.handler) THEN h.id || '#' || h.handler WHEN (SELECT count(DISTINCT y.id) FROM y WHERE y.name = h.handler) = 1 THEN (SELECT min(y.id) FROM y WHERE y.name = h.handler) || '#' || h.handler END AS target FROM h""")
def j19_route_handlers(spark, d):
    """Routes with the symbol that their handler names: of their own file, else the only one of that name."""
    r = graph.snapshot(table(spark, d, "files").select("id", "ext", "size", "loc", "last_seen", "routes")).select(F.col("id").alias("file"), F.explode("routes").alias("r"))
    h = r.select("file", "r.method", "r.path", "r.handler").where("handler is not null").distinct()
    y = extract.symbols(_c(spark, d)).select("id", F.col("name").alias("handler")).distinct()
    own = y.select(F.col("id").alias("file"), "handler", F.lit(True).alias("_own"))
    alone = y.groupBy("handler").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).where("_n = 1")
    j = h.join(own, ["file", "handler"], "left").join(alone, "handler", "left")
    return j.select("file", "method", "path", "handler", F.concat_ws("#", F.coalesce(F.when(F.col("_own"), F.col("file")), F.col("_id")), F.when(F.col("_own") | F.col("_id").isNotNull(), F.col("handler"))).alias("t")).select("file", "method", "path", "handler", F.nullif("t", F.lit("")).alias("target"))


@query()
def j10_calls(spark, d):
    """Python calls with receivers and types, resolved in full: qualified names and bases, methods against functions, imports and what they hand on."""
    c = _c(spark, d)
    facts = extract.python_facts(c).where(F.col("fact").isin("function", "method", "class"))
    last = F.substring_index("name", ".", -1)
    own = facts.select(
        F.concat_ws("#", "id", "name", F.col("line").cast("string")).alias("symbol"), last.alias("name"), F.when(F.col("fact") == "method", F.substring_index("name", ".", -2)).otherwise(last).alias("qualified"),
        F.col("id").alias("file"), "line", paths.is_test("id").alias("aux"),
    )
    sites = references.call_sites(c.where(F.col("id").rlike(r"(?i)\.py$")))
    typed = F.col("receiver_type").isNotNull()
    asked = sites.select(
        F.concat_ws("#", "id", F.col("line").cast("string"), F.coalesce("receiver", F.lit("")), "name").alias("call"), F.col("id").alias("caller_file"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"),
        F.when(typed, F.concat_ws(".", "receiver_type", "name")).otherwise(F.col("name")).alias("name"), F.col("receiver").isNotNull().alias("member"), typed.alias("typed"), F.lit(False).alias("imported_only"), F.lit(None).cast("string").alias("module"),
    )
    e = graph.clean_edges(table(spark, d, "edges"))
    bases = references.inheritance(c).select(F.col("class").alias("cls"), "base").distinct()
    none = spark.createDataFrame([], "file string, exported string, source string, orig string")
    return calls.resolve_calls(asked, own, e.where("k = 'import'").select(F.col("s").alias("file"), F.col("t").alias("imported")), bases, e.where("k = 'reexport'").select(F.col("s").alias("file"), F.col("t").alias("source")), none)
