"""Views of symbols, packages, files, URLs and versions: what a detail panel or an alert shows, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph

#: Characters of source that a symbol's view shows, bytes up to which a file is handed out, files that a model's usage lists, extensions of a legend.
SOURCE_CHARS, FILE_BYTES, USAGE_FILES, LEGEND = 4000, 2 << 20, 200, 30


def _n(c) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def symbol_blast(seeds: DataFrame, calls: DataFrame, symbols: DataFrame, depth: int = 3, direction: str = "users") -> DataFrame:
    """(seed, total, files, at_1 .. at_<depth>, dynamic_sites): how far each symbol of (id) reaches over (s, t) calls, itself left out.

    ``symbols``: (id, file, n_dynamic). All seeds walk at once; their reach is combined before it is shuffled.
    """
    reach = graph.bfs(seeds, calls, depth, direction).where("depth > 0").join(symbols, "id")
    at = [F.sum((F.col("depth") == k).cast("long")).alias(f"at_{k}") for k in range(1, depth + 1)]
    got = reach.groupBy("seed").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"), *at, F.sum("n_dynamic").alias("dynamic_sites"))
    out = seeds.select(F.col("id").alias("seed")).distinct().join(got, "seed", "left")
    return out.select("seed", *[_n(F.col(c)).alias(c) for c in got.columns if c != "seed"])


def symbol_nodes(symbols: DataFrame, calls: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, callers, callees, candidates, n_dynamic, source): each symbol of (id, n_dynamic) with its calls of (s, t, k) and the head of its source.

    Calls of kind ``candidate`` count apart. ``sources``: (id, text); of a long text the first ``SOURCE_CHARS`` characters are shown.
    """
    sure, maybe = calls.where("k <> 'candidate' or k is null"), calls.where("k = 'candidate'")
    count = lambda df, at, name: df.groupBy(F.col(at).alias("id")).agg(F.count(F.lit(1)).alias(name))
    j = symbols.select("id", "n_dynamic").distinct()
    for part in (count(sure, "t", "callers"), count(sure, "s", "callees"), count(maybe, "s", "candidates")):
        j = j.join(part, "id", "left")
    shown = sources.where("text is not null").groupBy("id").agg(F.max(F.substring("text", 1, SOURCE_CHARS)).alias("source"))
    return j.join(shown, "id", "left").select("id", *[_n(F.col(c)).alias(c) for c in ("callers", "callees", "candidates", "n_dynamic")], "source")


def scope_local(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, line, symbol): the symbol declared under exactly this file, name and line; null where there is none."""
    own = symbols.groupBy("file", "name", "line").agg(F.min("symbol").alias("symbol"))
    return asked.select("file", "name", "line").distinct().join(own, ["file", "name", "line"], "left")


def package_detail(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, id, mass, n_in_cross, n_out_cross): the files of (id, package) by what uses them and what crosses the package's border."""
    owned = files.where("package is not null").select("id", "package").distinct()
    a, b = (owned.select(F.col("id").alias(c), F.col("package").alias(f"_{c}")) for c in ("s", "t"))
    crossing = edges.join(a, "s").join(b, "t").where("_s <> _t")
    deg = graph.degrees(owned.select("id"), edges).select("id", (F.col("n_in") + F.col("n_out")).alias("mass"))
    j = owned.join(deg, "id").join(crossing.groupBy(F.col("t").alias("id")).agg(F.count(F.lit(1)).alias("i")), "id", "left").join(crossing.groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("o")), "id", "left")
    return j.select("package", "id", "mass", _n(F.col("i")).alias("n_in_cross"), _n(F.col("o")).alias("n_out_cross"))


def read_files(contents: DataFrame) -> DataFrame:
    """(id, bytes, sha256, state): what reading each file gives: ``ok``, ``too large``, ``unread`` (no content), or ``outside`` for a path that leaves the tree."""
    outside = F.col("id").rlike(r"(?:^|/)\.\.(?:/|$)|^/|^[A-Za-z]:|\x00")
    size = F.octet_length("content").cast("long")
    state = F.when(outside, "outside").when(F.col("content").isNull(), "unread").when(size > FILE_BYTES, "too large").otherwise("ok")
    return contents.where("id is not null").select("id", _n(size).alias("bytes"), F.when(state == "ok", F.sha2("content", 256)).alias("sha256"), state.alias("state")).distinct()


def match_urls(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """(path, route, dynamic): for each path of (path) the route of (route) that serves it with the fewest open segments, then the first by name.

    Segments are compared one by one within equal numbers of segments and, where the route writes it out, an equal first one;
    a route whose last segment is open to any rest (``*``) is asked with every shorter number of segments as a key.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    free = lambda x: x.rlike(r"^(?::|\{|<|\[)|^\*")
    r = routes.select("route").distinct().withColumn("_r", parts(F.col("route")))
    r = r.withColumn("_rest", F.coalesce(F.try_element_at("_r", F.lit(-1)).rlike(r"^\*|^\[\.\.\."), F.lit(False)))
    r = r.withColumn("_fix", F.when(F.col("_rest"), F.slice("_r", F.lit(1), F.size("_r") - 1)).otherwise(F.col("_r"))).withColumn("dynamic", F.size(F.filter("_r", free)).cast("long"))
    head = lambda c: F.when(F.coalesce(free(F.get(c, F.lit(0))), F.lit(True)), "").otherwise(F.lower(F.get(c, F.lit(0))))
    r = r.withColumn("_k", F.struct(head(F.col("_fix")).alias("h"), F.size("_fix").alias("n"), F.col("_rest").alias("r")))
    u = urls.select("path").distinct().withColumn("_p", parts(F.col("path")))
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_p")), lambda n: F.array(*[F.struct(h.alias("h"), n.alias("n"), x.alias("r")) for h in (F.lit(""), head(F.col("_p"))) for x in (F.lit(True), F.lit(False))])))
    u = u.withColumn("_k", F.explode(F.array_distinct(keys))).where(F.col("_k.r") | (F.col("_k.n") == F.size("_p")))
    same = F.forall(F.arrays_zip(F.col("_fix").alias("a"), F.slice("_p", F.lit(1), F.size("_fix")).alias("b")), lambda z: free(z["a"]) | (z["a"] == z["b"]))
    hit = u.join(r, "_k").where(same).groupBy("path").agg(F.min(F.struct("dynamic", "route")).alias("x"))
    return hit.select("path", F.col("x.route").alias("route"), F.col("x.dynamic").alias("dynamic"))


def model_usage(models: DataFrame, contents: DataFrame) -> DataFrame:
    """(model, id): files whose text holds the name of a model as a word, the first ``USAGE_FILES`` of each by id.

    Words of the texts are keys; the cut is taken before the shuffle as well as after it.
    """
    words = contents.where("content is not null and id is not null").select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)"), F.lit(1)))).alias("model"))
    hit = words.join(models.select("model").where("model is not null").distinct(), "model").distinct()
    w = Window.partitionBy("model").orderBy("id")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= USAGE_FILES).select("model", "id")


def legend(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(ext, n_files, n_in, n_out) of the ``LEGEND`` most frequent extensions."""
    j = files.select("id", "ext").join(graph.degrees(files, edges), "id")
    return j.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).orderBy(F.col("n_files").desc(), "ext").limit(LEGEND)


def centroids(points: DataFrame) -> DataFrame:
    """(part, x, y, z, n, radius): mean place of each part of (part, x, y, z) and the distance within which 95 of 100 of its points lie.

    The radius is the value of rank floor(0.95 n) from 0; ranks are counted over distances rounded to six places.
    """
    mean = points.groupBy("part").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))
    far = F.round(F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz")), 6)
    # the ranks are made of counts of equal distances, so a part is never sorted as points
    d = points.join(mean, "part").groupBy("part", "n", far.alias("d")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("d"))
    p95 = d.withColumn("_u", upto).where(F.col("_u") > F.floor(F.col("n") * 0.95)).groupBy("part").agg(F.min("d").alias("radius"))
    return mean.join(p95, "part").select("part", *[F.round(f"_{c}", 6).alias(c) for c in "xyz"], "n", "radius")


def rates(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(n_found, n_true, n_both, precision, recall) of two sets of keys; a rate without a base is null."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(1)), truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    n = a.join(b, keys, "full").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for c, k in ((F.col("_f"), "n_found"), (F.col("_t"), "n_true"), (F.col("_f") * F.col("_t"), "n_both"))])
    part = lambda c: F.round(F.when(F.col(c) > 0, F.col("n_both") / F.col(c)), 6)
    return n.select("*", part("n_found").alias("precision"), part("n_true").alias("recall"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): ``add``, ``change`` or ``unlink`` between two manifests of (id, mark); a null mark equals a null mark."""
    one = lambda df, c: df.where("id is not null").groupBy("id").agg(F.max("mark").alias(c), F.lit(True).alias(f"_{c}"))
    j = one(before, "b").join(one(after, "a"), "id", "full")
    kind = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "unlink").when(~F.col("a").eqNullSafe(F.col("b")), "change")
    return j.select("id", kind.alias("change")).where("change is not null")


def merge_facts(facts: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts of (id, ...) after changes: those of changed and removed files are dropped, those of ``fresh`` come in; the rest is not read again."""
    return facts.join(changes.select("id").distinct(), "id", "left_anti").select(*facts.columns).unionByName(fresh.join(changes.where("change <> 'unlink'").select("id").distinct(), "id", "left_semi").select(*facts.columns))


def alerts(dead: DataFrame, changed: DataFrame) -> DataFrame:
    """(kind, subject, detail): symbols that died and names whose signature changed, as one relation."""
    return dead.select(F.lit("dead").alias("kind"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("detail")).unionByName(
        changed.select(F.lit("signature").alias("kind"), F.concat_ws("#", "file", "name").alias("subject"), F.concat_ws(" -> ", "before", "after").alias("detail"))
    )
