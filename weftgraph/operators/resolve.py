"""Resolution joins: imports to files, calls to routes, points to intervals, names to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.session import Cut

#: Extensions that a specifier without one may stand for, in order, and names of index files.
PROBE_EXT = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "css", "json")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py")


def normalise_path(path):
    """A path without ``.`` and ``..`` segments; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, empty,
        lambda acc, p: F.when(acc.isNull(), acc).when((p == "..") & (F.size(acc) == 0), F.lit(None)).when(p == "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(folded, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(s, spec, kind, t): for relative (s, spec, kind), the file that a specifier names; null where none does.

    Candidates in order: the path as written, with each extension, a .js written for a .ts source, an index file of the
    directory. They are rows with a rank; one equi-join with the files' ids and the least rank decide.
    """
    here = F.array_join(paths.dirs("s"), "/")
    base = normalise_path(F.concat_ws("/", here, F.col("spec")))
    twin = F.regexp_replace(base, r"\.(?:js|jsx|mjs|cjs)$", "")
    cands = F.array(
        base, *[F.concat(base, F.lit("." + e)) for e in PROBE_EXT],
        *[F.when(base.rlike(r"\.(?:js|jsx|mjs|cjs)$"), F.concat(twin, F.lit("." + e))) for e in ("ts", "tsx")],
        *[F.concat(base, F.lit("/" + n)) for n in INDEX_FILES],
    )
    rel = imports.where(F.col("spec").rlike(r"^\.\.?(?:/|$)")).select("s", "spec", "kind").distinct()
    each = rel.select("s", "spec", "kind", F.posexplode(cands).alias("_rank", "t")).where(F.col("t").isNotNull())
    hits = each.join(files.select(F.col("id").alias("t")).distinct(), "t")
    best = hits.groupBy("s", "spec", "kind").agg(F.min_by("t", "_rank").alias("t"))
    return rel.join(best, ["s", "spec", "kind"], "left")


def api_links(files: DataFrame, strict: bool = True) -> DataFrame:
    """(s, t, method, url, path): API calls of files joined with the routes that serve them.

    Method equal, or the route's is ALL; with ``strict`` False ANY on either side matches as well, and a partial
    URL matches as a prefix. Patterns are compared within equal keys only: the first segment where a route writes it
    out, and the number of segments where it has no ``*``; routes that leave the first segment open have a key of
    their own, which every call looks up too.
    """
    calls = (
        files.select(F.col("id").alias("s"), F.explode("api_calls").alias("c")).select("s", "c.method", "c.url", "c.partial")
        .where(F.col("url").isNotNull() & ~F.col("url").rlike(r"^(?i:https?|wss?)://"))
        .withColumn("_p", paths.url_path("url")).distinct()
    )
    n = lambda c: F.size(F.split(c, "/"))
    first = lambda c: F.split_part(F.ltrim(c, F.lit("/")), F.lit("/"), F.lit(1))
    routes = (
        files.select(F.col("id").alias("t"), F.explode("routes").alias("r")).select("t", F.col("r.method").alias("_m"), F.col("r.path").alias("path"))
        .where(F.col("path").isNotNull()).distinct()
        .withColumn("_re", paths.route_regex(F.col("path"))).withColumn("_star", F.instr("path", "*") > 0)
    )
    open_ = first(F.col("path")).rlike(r"[:*\[{<$]") | (first(F.col("path")) == "")
    routes = routes.withColumn("_key", F.struct(F.when(open_, F.lit("")).otherwise(F.lower(first(F.col("path")))), F.when(F.col("_star"), F.lit(-1)).otherwise(n("path"))))
    wild = ("ALL",) if strict else ("ALL", "ANY")
    same = (F.col("_m") == F.col("method")) | F.col("_m").isin(*wild)
    if not strict:
        same = same | (F.col("method") == "ANY")
    looks = [F.struct(k, m) for k in (F.lit(""), F.lower(first(F.col("_p")))) for m in (F.lit(-1), n("_p"))]
    asked = calls.withColumn("_key", F.explode(F.array_distinct(F.array(*looks))))
    cols = ["s", "t", "method", "url", "path"]
    out = asked.join(routes, "_key").where(same & F.expr("_p rlike _re")).select(cols)
    if not strict:
        # a partial URL is whole segments of the route: they share the first one, unless it is empty
        begun = routes.withColumn("_seg", F.explode(F.array(F.lit(""), first(F.col("path")))))
        head = calls.where(F.col("partial")).withColumn("_seg", first(F.col("_p"))).join(begun, "_seg").where(F.startswith(F.col("path"), F.concat(F.regexp_replace("_p", "/$", ""), F.lit("/"))))
        out = out.unionByName(head.select(cols))
    return out.where(F.col("s") != F.col("t")).distinct()


def enclosing(points: DataFrame, spans: DataFrame, group: str, width: int = 64, module: bool = False) -> DataFrame:
    """For (point, <group>, line), the tightest of (<group>, id, lo, hi) that holds the line; null where none does.

    A range join by buckets: a span is a row for each bucket of ``width`` lines it touches, a point looks into one bucket;
    spans longer than 1024 buckets are joined by group alone. With ``module`` a point of a known group outside all its spans gets the
    group's ``<module>``.
    """
    wide = (F.col("hi") - F.col("lo")) >= width * 1024
    cut = spans.where(~wide).withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    p = points.withColumn("_b", F.floor(F.col("line") / width))
    within = F.col("line").between(F.col("lo"), F.col("hi"))
    hits = p.join(cut, [group, "_b"]).where(within).select("point", "id", "lo", "hi")
    hits = hits.unionByName(points.join(spans.where(wide), group).where(within).select("point", "id", "lo", "hi"))
    best = hits.groupBy("point").agg(F.min(F.struct(F.col("hi") - F.col("lo"), "id")).alias("_x")).select("point", F.col("_x.id").alias("id"))
    if module:
        # a point outside every interval belongs to its group as a whole, where the group is known at all
        known = spans.select(group).distinct()
        whole = points.select("point", group).distinct().join(known, group).select("point", F.concat(group, F.lit("#<module>")).alias("_whole"))
        return points.select("point").distinct().join(best, "point", "left").join(whole, "point", "left").select("point", F.coalesce("id", "_whole").alias("id"))
    return points.select("point").distinct().join(best, "point", "left")


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """For (point, keys, line), the id of (keys, id, at) with the nearest ``at``; ties go to the smaller id, null where a key has no mark.

    Points and marks meet by sorting, never in pairs: within a bucket of ``width`` lines the last mark before and the
    first one after a point come from a window over both; where the bucket has none, from the nearest buckets that have
    marks, of which one row each is kept. A hot key is as many tasks as it has buckets.
    """
    b = lambda c: F.floor(F.col(c) / width).alias("_b")
    one = marks.where(F.col("at").isNotNull()).groupBy(*keys, "at").agg(F.min("id").alias("id")).select(*keys, b("at"), F.col("at").alias("_at"), F.struct("at", "id").alias("_m"))
    spots = points.select("point", *keys, "line").where(F.col("line").isNotNull())
    ends = one.groupBy(*keys, "_b").agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    each = spots.select(*keys, b("line")).distinct().join(ends, [*keys, "_b"], "full")
    along = Window.partitionBy(*keys).orderBy("_b")
    near = each.select(
        *keys, "_b", F.last("_hi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.first("_lo", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    none = F.lit(None)
    both = spots.select("point", *keys, b("line"), F.col("line").alias("_at"), none.cast(one.schema["_m"].dataType).alias("_m")).unionByName(
        one.select(none.cast(points.schema["point"].dataType).alias("point"), *keys, "_b", "_at", "_m")
    )
    here = Window.partitionBy(*keys, "_b").orderBy("_at")
    found = both.select(
        "point", *keys, "_b", "_at", F.last("_m", ignorenulls=True).over(here.rangeBetween(Window.unboundedPreceding, 0)).alias("_before"),
        F.first("_m", ignorenulls=True).over(here.rangeBetween(0, Window.unboundedFollowing)).alias("_after"),
    ).where(F.col("point").isNotNull())
    joined = found.join(near, [*keys, "_b"])
    away = lambda c: F.when(c.isNotNull(), F.struct(F.abs(F.col("_at") - c["at"]).alias("d"), c["id"].alias("id")))
    best = F.array_min(F.array_compact(F.array(away(F.coalesce("_before", "_prev")), away(F.coalesce("_after", "_next")))))
    got = joined.groupBy("point").agg(F.min(best).alias("_x"))
    return points.select("point").distinct().join(got.select("point", F.col("_x.id").alias("id")), "point", "left")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(call, outcome, target, reason): each call of (call, caller_file, name) resolved, or declined with a counted reason.

    ``symbols``: (symbol, name, file, aux). ``imports``: (file, imported). By rank: a symbol of the caller's own file;
    one of exactly one imported file (several: ``imported-ambiguous``); else the only one outside auxiliary paths anywhere
    (none: ``no-match``, several: ``ambiguous``). Names match with their case. Every call gives exactly one row.

    Candidates of a name are aggregated to counts and least ids per (name, file) before the join, so a name that
    thousands of files declare is two numbers for a call, not a thousand rows.
    """
    per_file = symbols.groupBy("name", "file").agg(F.min("symbol").alias("symbol"), F.min(F.col("aux").cast("int")).alias("_aux"))
    anywhere = per_file.where("_aux = 0").groupBy("name").agg(F.count(F.lit(1)).alias("_n_any"), F.min("symbol").alias("_any"))
    c = calls.select("call", "caller_file", "name").distinct()
    own = per_file.select(F.col("file").alias("caller_file"), "name", F.col("symbol").alias("_own"))
    through = (
        c.select("caller_file", "name").distinct()
        .join(imports.select(F.col("file").alias("caller_file"), "imported").distinct(), "caller_file")
        .join(per_file.select(F.col("file").alias("imported"), "name", "symbol"), ["imported", "name"])
        .groupBy("caller_file", "name").agg(F.count(F.lit(1)).alias("_n_imp"), F.min("symbol").alias("_imp"))
    )
    j = c.join(own, ["caller_file", "name"], "left").join(through, ["caller_file", "name"], "left").join(anywhere, "name", "left")
    n_imp, n_any = F.coalesce("_n_imp", F.lit(0)), F.coalesce("_n_any", F.lit(0))
    reason = F.when(F.col("_own").isNotNull(), None).when(n_imp == 1, None).when(n_imp > 1, "imported-ambiguous").when(n_any == 1, None).when(n_any == 0, "no-match").otherwise("ambiguous")
    target = F.when(F.col("_own").isNotNull(), F.col("_own")).when(n_imp == 1, F.col("_imp")).when((n_imp == 0) & (n_any == 1), F.col("_any"))
    return j.select("call", F.when(reason.isNull(), "resolved").otherwise("declined").alias("outcome"), target.alias("target"), reason.alias("reason"))


def candidates(calls: DataFrame, symbols: DataFrame, cap: int = 24) -> DataFrame:
    """(call, target, capped): the first ``cap`` symbols outside auxiliary paths of each declined call's name, by id; ``capped`` tells of more.

    The rank is cut before the shuffle as well as after it, and how many there are is a count of its own, so a name of
    thousands of symbols leaves ``cap`` rows and one number a partition.
    """
    w = Window.partitionBy("name").orderBy("symbol")
    asked = calls.select("call", "name").distinct()
    own = symbols.where(~F.col("aux")).select("name", "symbol").distinct().join(asked.select("name").distinct(), "name", "left_semi")
    listed = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    sizes = own.groupBy("name").agg((F.count(F.lit(1)) > cap).alias("capped"))
    return asked.join(listed.join(sizes, "name"), "name").select("call", F.col("symbol").alias("target"), "capped")


def inherited(classes: DataFrame, methods: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """(cls, method, owner, steps): the nearest class up the ``extends`` chain of (cls, base) that declares a wanted (cls, method)."""
    cut = Cut(classes.sparkSession, "mro")
    open_ = cut(wanted.select("cls", "method", F.col("cls").alias("at"), F.lit(0).cast("long").alias("steps")).distinct())
    found = None
    for _ in range(limit + 1):
        here = open_.join(methods.select(F.col("cls").alias("at"), "method").distinct(), ["at", "method"], "left_semi").select("cls", "method", F.col("at").alias("owner"), "steps")
        found = here if found is None else found.unionByName(here)
        rest = open_.join(methods.select(F.col("cls").alias("at"), "method").distinct(), ["at", "method"], "left_anti")
        nxt = rest.join(classes.select(F.col("cls").alias("at"), "base"), "at").select("cls", "method", F.col("base").alias("at"), (F.col("steps") + 1).alias("steps")).distinct()
        open_ = cut(nxt)
        if open_.isEmpty():
            break
    return found.groupBy("cls", "method").agg(F.min(F.struct("steps", "owner")).alias("_x")).select("cls", "method", F.col("_x.owner").alias("owner"), F.col("_x.steps").alias("steps"))


def test_pairs(files: DataFrame) -> DataFrame:
    """(test, source): test files paired with the source of the same stem; same directory tree first, then the smallest id.

    A test without such a source takes the one whose stem, of four letters or more, stands in its own: the longest, then the same
    tree, then the smallest id. Stretches of the test's stem are keys, so no test is compared with all sources.
    """
    stem = F.regexp_replace(F.regexp_replace(paths.base_name("id"), r"\.[^.]*$", ""), r"(?i)(?:^test[_-]?|[._-]?(?:test|tests|spec)$)", "")
    marked = files.select("id", F.lower(stem).alias("_stem"), paths.base_name("id").rlike(r"(?i)^test_|[._-](?:test|spec)\.|_test\.|(?:Test|Tests|Spec)\.").alias("_t"), F.substring_index("id", "/", 1).alias("_top")).distinct()
    tests, sources = marked.where("_t"), marked.where("not _t")
    # of sources only the least of each stem, and of each stem and tree, can be an answer: index and main are single rows
    sources = sources.where(F.length("_stem") > 0)
    near = sources.groupBy("_stem", "_top").agg(F.min("id").alias("_near"))
    far = sources.groupBy("_stem").agg(F.min("id").alias("_far"))
    j = tests.select(F.col("id").alias("test"), "_stem", "_top").join(far, "_stem").join(near, ["_stem", "_top"], "left")
    exact = j.select("test", F.coalesce("_near", "_far").alias("source"))
    n = F.length("_stem")
    parts = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n - 3), lambda a: F.transform(F.sequence(F.lit(4), n - a + 1), lambda k: F.col("_stem").substr(a, k)))), lambda x: x != F.col("_stem"))
    open_ = tests.join(exact.select(F.col("test").alias("id")), "id", "left_anti").where(n >= 5)
    keys = open_.select(F.col("id").alias("test"), "_top", F.explode(F.array_distinct(parts)).alias("_stem"))
    k = keys.join(far, "_stem").join(near, ["_stem", "_top"], "left")
    best = F.min(F.struct((-F.length("_stem")).alias("a"), F.col("_near").isNull().alias("b"), F.coalesce("_near", "_far").alias("source"))).alias("x")
    return exact.unionByName(k.groupBy("test").agg(best).select("test", F.col("x.source").alias("source")))
