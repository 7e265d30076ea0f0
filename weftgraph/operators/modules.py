"""Import specifiers that are no paths: package manifests, source roots and module trees as keyed candidate rows.

Every lookup is the same plan: a specifier's prefixes or suffixes become keys, an equi-join with the anchors of its
language (what manifests and files declare) gives candidate paths with a rank, an equi-join with the files' ids keeps those
that exist, and the least rank decides. Nothing is compared by a condition without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators.resolve import INDEX_FILES, PROBE_EXT, normalise_path

SCRIPT = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte", "astro")
#: Conditions of a package's exports in the order in which they are asked.
CONDITIONS = ("import", "module", "default", "require", "types", "node")
_NAME = r"([^/]+)$"


def _dir(path) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _under(base: Column, rest: Column) -> Column:
    """base/rest without empty parts, ``.`` and ``..``."""
    return normalise_path(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))


def _prefixes(spec: Column, sep: str) -> Column:
    """(key, rest) of every prefix of a specifier in whole parts, the whole of it included."""
    p = F.split(spec, sep)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.struct(F.array_join(F.slice(p, 1, n), "/").alias("key"), F.array_join(F.slice(p, n + 1, F.size(p)), "/").alias("rest")))


def _target(value: Column, depth: int = 4) -> Column:
    """The file of an exports value: a string, the first of a list, or the first condition that holds one, nested up to ``depth``."""

    def peel(v):
        first = F.coalesce(*[F.get_json_object(v, f"$['{c}']") for c in CONDITIONS])
        return F.when(v.rlike(r"^\s*\["), F.get_json_object(v, "$[0]")).when(v.rlike(r"^\s*\{"), first).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), value, lambda v, _: peel(v))


def anchors(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(lang, key, dir, sub, how): what a specifier's prefix stands for in each language.

    ``dir`` is the directory (or, with ``how`` = ``file``, the file) that the prefix names; ``sub`` marks what follows it: any path
    (``any``), nothing (``none``), or a pattern with one ``*`` of a package's exports. Files that cannot be read as their format give
    no rows.
    """
    own = contents.where(F.col("content").isNotNull()).select("id", F.regexp_extract("id", _NAME, 1).alias("name"), _dir(F.col("id")).alias("at"), "content").where(~F.col("id").rlike(r"(?:^|/)(?:node_modules|vendor|target)/"))
    of = lambda *names: own.where(F.col("name").isin(*names))
    row = lambda lang, key, d, sub, how: (F.lit(lang).alias("lang"), key.alias("key"), d.alias("dir"), sub.alias("sub"), F.lit(how).alias("how"))
    said = lambda rx: F.regexp_extract("content", rx, 1)
    go = of("go.mod").select(*row("go", said(r"(?m)^\s*module\s+(\S+)"), F.col("at"), F.lit("any"), "dir"))
    dart = of("pubspec.yaml").select(*row("dart", said(r"(?m)^name:\s*(\S+)"), _under(F.col("at"), F.lit("lib")), F.lit("any"), "dir"))
    cargo = of("Cargo.toml").select("at", said(r"(?s)\[package\](.*?)(?:\n\s*\[|\Z)").alias("content")).select(*row("rs", F.translate(said(r"\bname\s*=\s*[\"']([^\"']+)[\"']"), "-", "_"), _under(F.col("at"), F.lit("src")), F.lit("any"), "dir"))
    loads = of("composer.json").select("at", F.explode(F.array(*[F.from_json(F.get_json_object("content", f"$.{k}['psr-4']"), "map<string,string>") for k in ("autoload", "autoload-dev")])).alias("m")).select("at", F.explode("m").alias("p", "d"))
    each = F.explode(F.when(F.col("d").startswith("["), F.from_json("d", "array<string>")).otherwise(F.array("d")))
    php = loads.select("at", "p", each.alias("d")).select(*row("php", F.regexp_replace(F.regexp_replace("p", r"\\+$", ""), r"\\", "/"), _under(F.col("at"), F.col("d")), F.lit("any"), "dir"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//[^\n]*", "$1"), r",(\s*[}\]])", "$1")
    conf = of("tsconfig.json", "jsconfig.json").select("at", F.from_json(F.get_json_object(bare, "$.compilerOptions"), "baseUrl string, paths map<string,array<string>>").alias("c"))
    conf = conf.select("at", F.coalesce("c.baseUrl", F.lit(".")).alias("base"), F.explode("c.paths").alias("p", "ts")).select("at", "base", "p", F.explode("ts").alias("t"))
    open_ = F.endswith(F.col("p"), F.lit("/*"))
    ts = conf.select(*row("tsconfig", F.regexp_replace("p", r"/\*$", ""), _under(_under(F.col("at"), F.col("base")), F.regexp_replace("t", r"/\*$", "")), F.when(open_, "any").otherwise("none"), "dir"))
    pkg = of("package.json").select("at", F.get_json_object("content", "$.name").alias("key"), F.get_json_object("content", "$.exports").alias("x"), F.coalesce(F.get_json_object("content", "$.module"), F.get_json_object("content", "$.main")).alias("main")).where("key is not null")
    keyed = F.coalesce(F.from_json(F.when(F.col("x").rlike(r"^\s*\{\s*\"\."), F.col("x")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    root = F.coalesce(_target(F.when(F.size(keyed) > 0, keyed["."]).otherwise(F.col("x"))), F.col("main"))
    entry = pkg.where(root.isNotNull()).select(*row("js", F.col("key"), _under(F.col("at"), root), F.lit("none"), "file"))
    subs = pkg.select("at", "key", F.explode(keyed).alias("k", "v")).where("k like './%'").withColumn("v", _target(F.col("v"))).where("v is not null")
    subs = subs.select(*row("js", F.col("key"), _under(F.col("at"), F.col("v")), F.substring("k", 3, 1000), "file"))
    whole = pkg.select(*row("js", F.col("key"), F.col("at"), F.lit("any"), "dir"))
    tops = files.select(F.regexp_extract("id", r"^(?:(.*)/)?([^/]+)/__init__\.py$", 1).alias("d"), F.regexp_extract("id", r"^(?:.*/)?([^/]+)/__init__\.py$", 1).alias("k"))
    mods = files.select(_dir(F.col("id")).alias("d"), F.regexp_extract("id", r"([^/]+)\.py$", 1).alias("k")).where("k not in ('', '__init__')")
    py = tops.where("k <> ''").unionByName(mods).select(*row("py", F.col("k"), F.col("d"), F.lit("any"), "dir"))
    out = go
    for more in (dart, cargo, php, ts, entry, subs, whole, py):
        out = out.unionByName(more)
    return out.where(F.col("key").isNotNull() & (F.col("key") != "")).distinct()


def _suffixes(files: DataFrame, project) -> DataFrame:
    """(project, key, t): for every suffix of whole parts of every path, the shortest and then smallest id of a project that ends in it."""
    p = F.split("id", "/")
    each = files.select("id", project("id").alias("project"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, n, F.size(p)), "/"))).alias("key"))
    return each.groupBy("project", "key").agg(F.min(F.struct(F.length("id"), "id")).alias("x")).select("project", "key", F.col("x.id").alias("t"))


def resolve_modules(imports: DataFrame, files: DataFrame, contents: DataFrame, by_project: bool = False) -> DataFrame:
    """(s, spec, t): the file that a specifier of (s, spec) names by its language's own rules; null where it names none (an external package).

    By extension of ``s``. Scripts: path mappings, then packages of the workspace (entry, exports with the most specific
    pattern, source directory). Python: relative dots, then the roots that hold the first part, the deepest first. C: beside the
    file, then any directory. Java and Kotlin: the path that a qualified name ends in, or that of its owner. PHP: the longest namespace prefix,
    then the mirrored path. Ruby: beside the file, load path. Dart: packages and relative paths. Rust: crate, self, super,
    other crates, children of the module, to the deepest file there is.

    With ``by_project`` the first part of a path names its project: roots begin there, and no specifier leaves it. Null
    and empty specifiers give no rows, repeated ones give one.
    """
    project = lambda c: F.substring_index(c, "/", 1) if by_project else F.lit("")
    ext = F.regexp_extract("s", r"\.([^./]+)$", 1)
    asked = imports.select("s", "spec").where(F.col("s").isNotNull() & (F.col("spec") != "")).distinct().withColumn("e", F.lower(ext)).withColumn("here", _dir(F.col("s")))
    ids = files.select("id").where("id is not null").distinct()
    known = anchors(ids, contents)
    rows = []  # (s, spec, rank: array<int>, cand)

    def put(df: DataFrame, *rank) -> None:
        rows.append(df.select("s", "spec", F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("int") for x in rank]).alias("rank"), "cand").where(F.col("cand").isNotNull()))

    def tried(base: Column) -> Column:
        """Script files that a path without extension may mean."""
        return F.array(base, *[F.concat(base, F.lit("." + e)) for e in PROBE_EXT], *[F.concat(base, F.lit("/" + n)) for n in INDEX_FILES])

    def keyed(df: DataFrame, lang: str, spec: Column, sep: str) -> DataFrame:
        at = df.withColumn("k", F.explode(_prefixes(spec, sep))).select("*", F.col("k.key").alias("key"), F.col("k.rest").alias("rest")).drop("k")
        return at.join(known.where(F.col("lang") == lang).drop("lang"), "key").where((F.col("sub") != "none") | (F.col("rest") == ""))

    long_ = lambda: -F.length("key")
    script = asked.where(F.col("e").isin(*SCRIPT) & ~F.col("spec").rlike(r"^[./]"))
    mapped = keyed(script, "tsconfig", F.col("spec"), "/").select("s", "spec", "key", F.posexplode(tried(_under(F.col("dir"), F.col("rest")))).alias("i", "cand"))
    put(mapped, 0, long_(), F.col("i"))
    space = keyed(script, "js", F.col("spec"), "/")
    star = F.instr("sub", "*") > 0
    pre, post = F.substring_index("sub", "*", 1), F.substring_index("sub", "*", -1)
    fits = star & F.startswith(F.col("rest"), pre) & F.endswith(F.col("rest"), post) & (F.length("rest") >= F.length(pre) + F.length(post))
    held = F.expr("substring(rest, length(substring_index(sub, '*', 1)) + 1, length(rest) - length(sub) + 1)")
    exact = space.where((F.col("how") == "file") & ((F.col("sub") == F.col("rest")) | (F.col("sub") == "none") | fits))
    exact = exact.withColumn("p", F.when(star, F.replace("dir", F.lit("*"), held)).otherwise(F.col("dir"))).withColumn("w", F.when(star, F.length(pre) * 1000 + F.length(post)).otherwise(1_000_000))
    put(exact.select("s", "spec", "key", "w", F.posexplode(tried(F.regexp_replace("p", r"^\./", ""))).alias("i", "cand")), 1, long_(), -F.col("w"), F.col("i"))
    inside = space.where("how = 'dir'").select("s", "spec", "key", F.posexplode(F.array(_under(F.col("dir"), F.concat_ws("/", F.lit("src"), F.nullif("rest", F.lit("")))), _under(F.col("dir"), F.col("rest")))).alias("j", "b"))
    put(inside.select("s", "spec", "key", "j", F.posexplode(tried(F.col("b"))).alias("i", "cand")), 2, long_(), F.col("j"), F.col("i"))

    py = asked.where("e = 'py'")
    module = lambda p: F.array(F.concat(p, F.lit(".py")), F.when(p == "", F.lit("__init__.py")).otherwise(F.concat(p, F.lit("/__init__.py"))))
    dots = F.length(F.regexp_extract("spec", r"^(\.+)", 1))
    tail = F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    up = F.array_join(F.slice(F.split("here", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("here", "/")) - dots + 1)), "/")
    put(py.where("spec like '.%'").select("s", "spec", F.posexplode(module(_under(up, tail))).alias("i", "cand")), 0, F.col("i"))
    whole = py.where("spec not like '.%'").withColumn("path", F.translate("spec", ".", "/"))
    roots = keyed(whole, "py", F.split_part("spec", F.lit("."), F.lit(1)), "/").select("s", "spec", "path", F.col("dir"))
    roots = roots.unionByName(whole.select("s", "spec", "path", F.explode(F.array(project("s"), F.concat_ws("/", F.nullif(project("s"), F.lit("")), F.lit("src")))).alias("dir")))
    put(roots.select("s", "spec", "dir", F.posexplode(module(_under(F.col("dir"), F.col("path")))).alias("i", "cand")), 1, -F.length("dir"), F.col("i"))

    beside = asked.where(F.col("e").isin("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "rb", "dart") & ~F.col("spec").rlike("^(?:dart|package):"))
    ruby = F.when((F.col("e") == "rb") & ~F.endswith(F.col("spec"), F.lit(".rb")), F.concat("spec", F.lit(".rb"))).otherwise(F.col("spec"))
    put(beside.select("s", "spec", _under(F.col("here"), ruby).alias("cand")), 0)
    put(beside.where("e = 'rb'").select("s", "spec", F.posexplode(F.array(ruby, F.concat(F.lit("lib/"), ruby))).alias("i", "cand")), 1, F.col("i"))

    php = asked.where("e = 'php'").withColumn("path", F.regexp_replace("spec", r"\\", "/"))
    put(keyed(php, "php", F.col("path"), "/").select("s", "spec", "key", F.concat(_under(F.col("dir"), F.col("rest")), F.lit(".php")).alias("cand")), 0, long_())
    dart = asked.where("e = 'dart' and spec like 'package:%'")
    put(keyed(dart, "dart", F.substring("spec", 9, 1000), "/").select("s", "spec", "key", _under(F.col("dir"), F.col("rest")).alias("cand")), 0, long_())
    for df in _rust(asked.where("e = 'rs'"), known):
        put(df, 0, F.col("i"))

    ends = _suffixes(ids, project)
    owner = F.regexp_replace("path", r"/[^/]+$", "")
    jvm = asked.where(F.col("e").isin("java", "kt")).withColumn("path", F.translate(F.regexp_replace("spec", r"\.\*$", ""), ".", "/"))
    wanted = jvm.select("s", "spec", F.posexplode(F.array(*[F.concat(p, F.lit("." + x)) for p in (F.col("path"), owner) for x in ("java", "kt")])).alias("i", "key"))
    wanted = wanted.unionByName(php.select("s", "spec", F.lit(9).alias("i"), F.concat("path", F.lit(".php")).alias("key"))).unionByName(beside.where("e not in ('rb', 'dart')").select("s", "spec", F.lit(9).alias("i"), F.col("spec").alias("key")))
    put(wanted.withColumn("project", project("s")).join(ends, ["project", "key"]).select("s", "spec", "i", F.col("t").alias("cand")), 5, F.col("i"))

    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    hits = every.where(project("s") == project("cand")).join(ids.withColumnRenamed("id", "cand"), "cand")
    best = hits.groupBy("s", "spec").agg(F.min(F.struct("rank", "cand")).alias("x")).select("s", "spec", F.col("x.cand").alias("t"))
    return asked.select("s", "spec").join(best, ["s", "spec"], "left")


def _rust(asked: DataFrame, known: DataFrame) -> list[DataFrame]:
    """(s, spec, i, cand): files of a module path in order, the deepest first."""
    srcs = known.where("lang = 'rs'").select(F.col("key").alias("crate"), F.col("dir").alias("src"))
    parts = F.split("s", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    mine = asked.select("s", F.explode(ups).alias("src")).distinct().join(srcs.select("src").distinct(), "src").groupBy("s").agg(F.max_by("src", F.length("src")).alias("src"))
    a = asked.join(mine, "s", "left").withColumn("src", F.coalesce("src", F.when(F.startswith(F.col("s"), F.lit("src/")), "src"), F.lit("")))
    rel = F.regexp_replace(F.when(F.col("src") == "", F.col("s")).otherwise(F.expr("substring(s, length(src) + 2)")), r"\.rs$", "")
    mod = F.split(rel, "/")
    mod = F.when(F.try_element_at(mod, F.lit(-1)) == "mod", F.slice(mod, F.lit(1), F.size(mod) - 1)).when(rel.isin("lib", "main"), F.array().cast("array<string>")).otherwise(mod)
    raw = F.filter(F.split("spec", "::"), lambda p: ~p.isin("", "*"))
    a = a.select("s", "spec", "src", mod.alias("mod"), raw.alias("raw")).where(F.size("raw") > 0)
    head = F.get("raw", F.lit(0))
    n_super = F.size(F.filter("raw", lambda p: p == "super"))
    after = F.slice("raw", n_super + F.when(F.try_element_at(F.col("raw"), F.greatest(F.lit(1), n_super + 1)) == "self", 2).otherwise(1), F.size("raw"))
    base = F.slice("mod", F.lit(1), F.greatest(F.lit(0), F.size("mod") - n_super))
    rest = F.slice("raw", F.lit(2), F.size("raw"))
    inner = a.select("s", "spec", "src", F.when(head == "crate", rest).when(head.isin("self", "super"), F.concat(base, after)).otherwise(F.concat("mod", "raw")).alias("segs"), head.isin("crate", "self", "super").alias("rooted"), F.translate(head, "-", "_").alias("crate"), rest.alias("rest"))
    other = inner.where("not rooted").join(srcs.withColumnRenamed("src", "src2"), "crate").select("s", "spec", F.col("src2").alias("src"), F.col("rest").alias("segs"), F.lit(True).alias("rooted"))
    out = []
    for df in (inner.select("s", "spec", "src", "segs", "rooted"), other):
        steps = df.select("s", "spec", "src", "segs", F.explode(F.sequence(F.size("segs"), F.when(F.col("rooted"), 0).otherwise(F.size("segs")))).alias("n"))
        path = F.array_join(F.slice("segs", F.lit(1), F.col("n")), "/")
        pre = F.when(F.col("src") == "", "").otherwise(F.concat("src", F.lit("/")))
        named = F.when(~path.isin("lib", "main"), F.concat(pre, path, F.lit(".rs")))
        files = F.when(F.col("n") > 0, F.array(named, F.concat(pre, path, F.lit("/mod.rs")))).otherwise(F.array(F.concat(pre, F.lit("lib.rs")), F.concat(pre, F.lit("main.rs"))))
        each = steps.select("s", "spec", "segs", "n", F.posexplode(files).alias("j", "cand"))
        out.append(each.select("s", "spec", ((F.size("segs") - F.col("n")) * 2 + F.col("j")).alias("i"), "cand"))
    return out


def resolve_units(imports: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """(s, spec, t): every file of the unit that a specifier names: a Go package's directory, a C# namespace, a Swift module.

    Go: the longest module prefix of a go.mod gives the directory. C#: the declared namespace, looked up through the
    namespaces that enclose the importing file, the innermost first; only without any declaration at all the folder of that name. Swift:
    the directory below ``Sources``, at any depth. All keys are equal keys; a unit of any size is as many rows.
    """
    asked = imports.select("s", "spec").where(F.col("s").isNotNull() & (F.col("spec") != "")).distinct().withColumn("e", F.lower(F.regexp_extract("s", r"\.([^./]+)$", 1)))
    ids = files.select("id").where("id is not null").distinct().withColumn("at", _dir(F.col("id")))
    mods = anchors(ids.select("id"), contents).where("lang = 'go'").select("key", "dir")
    go = asked.where("e = 'go'").withColumn("k", F.explode(_prefixes(F.col("spec"), "/"))).select("s", "spec", "k.key", "k.rest").join(mods, "key")
    go = go.groupBy("s", "spec").agg(F.max_by(F.struct("dir", "rest"), F.length("key")).alias("x")).select("s", "spec", F.coalesce(_under(F.col("x.dir"), F.col("x.rest")), F.lit("")).alias("at"))
    out = go.join(ids.where("id like '%.go'"), "at").select("s", "spec", F.col("id").alias("t"))

    declared = contents.where(F.col("id").rlike(r"\.cs$")).select("id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^\W?\s*namespace\s+([A-Za-z_][\w.]*)"), F.lit(1))).alias("i", "ns"))
    own = declared.where("i = 0").select(F.col("id").alias("s"), F.split("ns", r"\.").alias("base"))
    cs = asked.where("e = 'cs'").join(own, "s", "left").withColumn("base", F.coalesce("base", F.array().cast("array<string>")))
    tries = cs.select("s", "spec", F.explode(F.sequence(F.size("base"), F.lit(0))).alias("n"), "base").select("s", "spec", "n", F.concat_ws(".", F.nullif(F.array_join(F.slice("base", F.lit(1), F.col("n")), "."), F.lit("")), F.col("spec")).alias("ns"))
    best = tries.join(declared.select("ns").distinct(), "ns").groupBy("s", "spec").agg(F.max_by("ns", "n").alias("ns"))
    out = out.unionByName(best.join(declared.select("ns", F.col("id").alias("t")).distinct(), "ns").where("t <> s").select("s", "spec", "t"))
    any_ns = declared.agg((F.count(F.lit(1)) > 0).alias("_any"))
    parts = F.split("spec", r"\.")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    tails = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    folders = asked.where("e = 'cs'").join(F.broadcast(any_ns)).where("not _any").select("s", "spec", F.posexplode(F.concat(heads, tails)).alias("i", "at"))
    out = out.unionByName(_first_unit(folders, ids.where("id like '%.cs'")))

    swift = asked.where("e = 'swift'").withColumn("m", F.split_part("spec", F.lit("."), F.lit(1)))
    dirs = F.split("at", "/")
    spots = ids.where("id like '%.swift'").select("id", "at", F.explode(F.sequence(F.lit(1), F.size(dirs))).alias("n"))
    d = lambda k: F.get(dirs, F.col("n") - k)
    named = spots.select("id", F.explode(F.array_compact(F.array(
        F.when(d(2) == "Sources", F.struct(F.lit(0).alias("i"), d(1).alias("m"))), F.when(d(1) == "Sources", F.struct(F.lit(1).alias("i"), d(2).alias("m"))), F.struct(F.lit(2).alias("i"), d(1).alias("m")),
    ))).alias("x")).select("id", "x.i", "x.m").distinct()
    hits = swift.join(named, "m").select("s", "spec", "i", "id")
    least = hits.groupBy("s", "spec").agg(F.min("i").alias("i"))
    return out.unionByName(hits.join(least, ["s", "spec", "i"]).select("s", "spec", F.col("id").alias("t"))).distinct()


def _first_unit(folders: DataFrame, ids: DataFrame) -> DataFrame:
    """Files of the first directory of (s, spec, i, at) that holds any."""
    there = folders.join(ids.select("at").distinct(), "at").groupBy("s", "spec").agg(F.min_by("at", "i").alias("at"))
    return there.join(ids, "at").select("s", "spec", F.col("id").alias("t"))
