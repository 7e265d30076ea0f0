"""References of brace languages and scripts by patterns: call sites with receivers and their types, bases of classes, exports, foreign code, script blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.extract import with_family

#: Strings, templates and comments, which hold no references; what is left of them keeps its line ends.
#: Repeats are possessive: Java matches a greedy repeated group by recursion, which overflows the stack on a string of some thousand characters.
_QUIET = r"""(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"""
_QUIET_PY = r"""(?s)#[^\n]*|[rRbBuUfF]{0,2}\"\"\".*?\"\"\"|[rRbBuUfF]{0,2}\'\'\'.*?\'\'\'|[rRbBuUfF]{0,2}"(?:[^"\\\n]++|\\.)*+"|[rRbBuUfF]{0,2}'(?:[^'\\\n]++|\\.)*+'"""
# Words that stand before a bracket and call nothing.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "with", "super", "and", "or", "not", "in", "def", "class", "elif", "assert", "yield", "del", "func", "range", "make", "sizeof", "do", "else", "new", "throw", "lambda", "import", "from", "is", "print", "constructor", "synchronized")
#: Languages whose calls without a receiver may mean a method of the enclosing class.
IMPLICIT_THIS = ("java", "cs", "kt", "swift", "scala", "cpp", "c")
_CALL = r"(new\s+)?((?:[A-Za-z_$][\w$]*+\s*+(?:\?\.|\.)\s*+)*+)([A-Za-z_$][\w$]*+)\s*+\("


def code_lines(contents: DataFrame) -> DataFrame:
    """(id, lang, line, code): lines of source without strings and comments; a comment of several lines leaves empty ones."""
    c = with_family(contents)
    # a quiet stretch over lines is blanked line by line: what is not a line end goes
    py = F.col("lang") == "py"
    blank = lambda rx: F.aggregate(F.regexp_extract_all("content", F.lit(rx), F.lit(0)), F.col("content"), lambda t, q: F.when(F.contains(q, F.lit("\n")), F.replace(t, q, F.regexp_replace(q, r"[^\n]", ""))).otherwise(t))
    some = F.when(py, F.col("content").rlike("\"\"\"|'''")).otherwise(F.col("content").rlike(r"/\*|`"))
    text = F.when(some, F.when(py, blank(_QUIET_PY)).otherwise(blank(_QUIET))).otherwise(F.col("content"))
    quiet = F.when(py, F.regexp_replace(text, _QUIET_PY, "\"\"")).otherwise(F.regexp_replace(text, _QUIET, "\"\""))
    return c.select("id", "lang", F.posexplode(F.split(quiet, "\n")).alias("i", "code")).where(F.col("code").rlike(r"\S")).select("id", "lang", (F.col("i") + 1).cast("long").alias("line"), "code")


def call_sites(contents: DataFrame) -> DataFrame:
    """(id, line, name, receiver, receiver_type, is_new): calls of code lines.

    ``receiver`` is what stands before the last dot, null for a bare call. Its type is what the same file tells of the name: an
    annotation, a construction (``x = new T(``, in Python ``x = T(``) or a factory (``T.create(``); names with a capital are their own
    type. A name that is told two types has none.
    """
    lines = code_lines(contents)
    got = lambda g: F.regexp_extract_all("code", F.lit(_CALL), F.lit(g))
    declared = F.col("code").rlike(r"^\s*(?:export\s+|default\s+|async\s+|static\s+|public\s+|private\s+|protected\s+)*(?:function|def|func|class)\b")
    each = lines.select("id", "lang", "line", declared.alias("declared"), F.posexplode(F.arrays_zip(got(1).alias("n"), got(2).alias("r"), got(3).alias("name"))).alias("i", "c"))
    calls = each.where(~F.col("c.name").isin(*NO_CALLS) & ~(F.col("declared") & (F.col("i") == 0))).select(
        "id", "line", "c.name", F.nullif(F.regexp_replace(F.regexp_replace("c.r", r"\s|\?", ""), r"\.$", ""), F.lit("")).alias("receiver"), (F.col("c.n") != "").alias("is_new"),
    )
    types = bindings(lines)
    head = F.col("receiver").rlike(r"^[A-Z][\w$]*$")
    j = calls.join(types.withColumnRenamed("name", "receiver"), ["id", "receiver"], "left")
    return j.select("id", "line", "name", "receiver", F.when(head, F.col("receiver")).otherwise(F.col("type")).alias("receiver_type"), "is_new").distinct()


def bindings(lines: DataFrame) -> DataFrame:
    """(id, name, type): names of a file that one type alone is told of."""
    rules = (r"\b([A-Za-z_$][\w$]*)\s*\??:\s*([A-Z][\w$]*)", r"\b([A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\], ]+)?=\s*(?:await\s+)?new\s+([A-Z][\w$]*)", r"\b([A-Za-z_$][\w$]*)\s*:?=\s*&?([A-Z][\w$]*)(?:\(|\{|\.(?:create|of|from|getInstance|build)\()", r"\b(?:final\s+)?([A-Z][\w$]*)(?:<[^<>]*>)?\s+([a-z_$][\w$]*)\s*(?:=|;|,|\))")
    told = F.flatten(F.array(*[
        F.zip_with(F.regexp_extract_all("code", F.lit(rx), F.lit(2 if k == 3 else 1)), F.regexp_extract_all("code", F.lit(rx), F.lit(1 if k == 3 else 2)), lambda n, t: F.struct(n.alias("name"), t.alias("type")))
        for k, rx in enumerate(rules)
    ]))
    each = lines.select("id", F.explode(told).alias("b")).select("id", "b.name", "b.type").distinct()
    return each.groupBy("id", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("type").alias("type")).where("_n = 1").drop("_n")


def inheritance(contents: DataFrame) -> DataFrame:
    """(id, class, base, kind): bases of declared classes; ``extends`` or ``implements``.

    Java and scripts say which; of C# bases the first is extended and the others are implemented; all Python bases are extended.
    """
    lines = code_lines(contents)
    names = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"<[^<>]*>", ""), ","), lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$.]*)\s*$", 1)), lambda x: x != "")
    part = lambda rx, g: F.regexp_extract("code", rx, g)
    cls = r"\b(?:class|interface|record|enum)\s+([A-Za-z_$][\w$]*)"
    as_ = lambda xs, kind: F.transform(xs, lambda b: F.struct(b.alias("base"), F.lit(kind).alias("kind")))
    braces = F.concat(as_(names(part(r"\bextends\s+([^{]*?)(?:\bimplements\b|\{|$)", 1)), "extends"), as_(names(part(r"\bimplements\s+([^{]*)", 1)), "implements"))
    py = as_(F.filter(names(part(r"^\s*class\s+\w+\s*\(([^()]*)\)", 1)), lambda b: ~b.rlike("=")), "extends")
    cs = names(part(r"\bclass\s+\w+(?:<[^<>]*>)?\s*:\s*([^{]*)", 1))
    sharp = F.concat(as_(F.slice(cs, 1, 1), "extends"), as_(F.slice(cs, F.lit(2), F.greatest(F.lit(0), F.size(cs) - 1)), "implements"))
    bases = F.when(F.col("lang") == "py", py).when(F.col("lang") == "cs", sharp).otherwise(braces)
    got = lines.where(F.col("code").rlike(cls)).select("id", part(cls, 1).alias("class"), F.explode(bases).alias("b"))
    return got.select("id", "class", "b.base", "b.kind").distinct()


def exported(signature) -> Column:
    """Is a declaration seen from outside: a word of export in its first 120 characters, or a first name with a capital."""
    head = F.substring(signature, 1, 120)
    return head.rlike(r"\b(?:pub|public|export|open)\b") | F.regexp_extract(signature, r"([A-Za-z_]\w*)", 1).rlike(r"^[A-Z]")


def implicit_this(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, target): bare calls of (call, lang, cls, name) inside a class that mean its own method of (cls, name, symbol), in languages that allow it."""
    own = methods.groupBy("cls", "name").agg(F.min("symbol").alias("target"))
    return calls.where(F.col("lang").isin(*IMPLICIT_THIS) & F.col("cls").isNotNull()).join(own, ["cls", "name"]).select("call", "target").distinct()


# How code reaches foreign binaries; group 1 is the library where the text names it.
FOREIGN = (
    ("wasm", r"WebAssembly\.(?:instantiate|compile)\w*\s*\(|[\"']([^\"'\n]+\.wasm)[\"']"), ("node", r"require\s*\(\s*[\"']([^\"'\n]+\.node)[\"']"), ("node", r"\bbindings\s*\(\s*[\"']([^\"'\n]+)[\"']"),
    ("ctypes", r"\bctypes\.(?:CDLL|cdll\.LoadLibrary|WinDLL|PyDLL)\s*\(\s*[\"']?([^\"')\n]*)"), ("cffi", r"\bffi\.dlopen\s*\(\s*[\"']?([^\"')\n]*)"), ("ext", r"\b(?:from|import)\s+([\w.]*_ext)\b"),
    ("jni", r"System\.load(?:Library)?\s*\(\s*[\"']([^\"'\n]+)"), ("rust", r"()#\[no_mangle\]|extern\s+[\"']C[\"']|#\[(?:pyfunction|wasm_bindgen|napi)\b"), ("cgo", r"import\s+[\"'](C)[\"']"),
)


def foreign(contents: DataFrame) -> DataFrame:
    """(id, kind, library): foreign code that a text calls; an empty library is one that the text does not name."""
    as_ = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit("")).alias("library"))
    each = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), as_(k)) for k, rx in FOREIGN]))
    return with_family(contents).select("id", F.explode(each).alias("x")).select("id", "x.kind", "x.library").distinct()


def script_blocks(contents: DataFrame) -> DataFrame:
    """(id, content): component files as the code of their script blocks and frontmatter, under an id that ends in .ts or .js."""
    own = contents.where(F.col("id").rlike(r"(?i)\.(?:vue|svelte|astro)$") & F.col("content").isNotNull())
    blocks = F.regexp_extract_all("content", F.lit(r"(?si)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    front = F.when(F.col("id").rlike(r"(?i)\.astro$"), F.regexp_extract("content", r"(?s)\A\s*---\r?\n(.*?)\n---", 1)).otherwise("")
    code = F.array_join(F.filter(F.concat(F.array(front), blocks), lambda x: x != ""), "\n")
    ext = F.when(F.col("content").rlike(r"(?i)<script\b[^>]*\blang\s*=\s*[\"']?ts") | F.col("id").rlike(r"(?i)\.astro$"), ".ts").otherwise(".js")
    return own.select(F.concat("id", ext).alias("id"), code.alias("content")).where("content <> ''")


def use_trees(uses: DataFrame) -> DataFrame:
    """(id, spec) of (id, use): grouped imports of Rust and PHP written out, without aliases, globs and, in Rust, with ``self`` as the group.

    ``a::{b, c::{d, self}} `` gives a::b, a::c::d and a::c; the outermost group is written out first, one level a step.
    """
    sep = F.when(F.instr("use", "\\") > 0, F.lit("\\")).otherwise(F.lit("::"))
    clean = F.regexp_replace(F.regexp_replace("use", r"\s+as\s+\w+", ""), r"\s+", "")
    rows = uses.select("id", sep.alias("sep"), clean.alias("spec")).where("spec <> ''")

    def cut_outer(spec):
        # members of the outermost group, told apart at commas of depth one
        head, body = F.regexp_extract(spec, r"(?s)^([^{}]*)\{(.*)\}$", 1), F.regexp_extract(spec, r"(?s)^([^{}]*)\{(.*)\}$", 2)
        parts = F.filter(F.regexp_extract_all(body, F.lit(r"((?:[^,{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})+)"), F.lit(1)), lambda x: x != "")
        return F.when(F.contains(spec, F.lit("{")), F.transform(parts, lambda x: F.concat(head, x))).otherwise(F.array(spec))

    every = F.array("spec")
    for _ in range(4):  # groups nest four deep at most
        every = F.flatten(F.transform(every, cut_outer))
    flat = rows.select("id", "sep", F.explode(every).alias("spec"))
    bare = F.regexp_replace(F.regexp_replace("spec", r"(?:::|\\)\*$", ""), r"::self$", "")
    return flat.select("id", bare.alias("spec")).where(~F.contains("spec", F.lit("{")) & (F.col("spec") != "")).distinct()


def _triples(rx: str, groups: tuple[int, int, int]):
    a, b, c = (F.regexp_extract_all("content", F.lit(rx), F.lit(g)) for g in groups)
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), z["c"].alias("c")))


def route_handlers(contents: DataFrame) -> DataFrame:
    """(id, method, path, handler): routes with the name of what handles them.

    Scripts: calls on a router with a named last argument, below the prefix under which the same file mounts the router; a router
    without a mount serves its paths as they stand. Python: decorators with their methods (GET where a plain route names none),
    handled by the function they decorate.
    """
    c = with_family(contents)
    js = c.where("lang = 'js'")
    calls = _triples(r"""\b([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete|all)\s*\(\s*['"`]([^'"`\n]*)['"`]""", (1, 2, 3))
    named = F.regexp_extract_all("content", F.lit(r"""\b[A-Za-z_$][\w$]*\.(?:get|post|put|patch|delete|all)\s*\(\s*['"`][^'"`\n]*['"`](?:\s*(?:,\s*[\w$.]+\s*)*?,\s*([A-Za-z_$][\w$.]*)\s*\)|)"""), F.lit(1))
    each = js.select("id", F.explode(F.arrays_zip(calls.alias("r"), named.alias("h"))).alias("x")).select("id", F.col("x.r.a").alias("router"), F.upper("x.r.b").alias("method"), F.col("x.r.c").alias("path"), F.nullif("x.h", F.lit("")).alias("handler")).where(F.startswith(F.col("path"), F.lit("/")))
    mounts = js.select("id", F.explode(_triples(r"""\b([A-Za-z_$][\w$]*)\.use\s*\(\s*['"`](/[^'"`\n]*)['"`]\s*,\s*([A-Za-z_$][\w$]*)\s*\)""", (1, 2, 3))).alias("m")).select("id", F.col("m.c").alias("router"), F.regexp_replace("m.b", "/+$", "").alias("prefix"))
    scripts = each.join(mounts, ["id", "router"], "left").select("id", "method", F.concat(F.coalesce("prefix", F.lit("")), F.when(F.col("prefix").isNotNull() & (F.col("path") == "/"), "").otherwise(F.col("path"))).alias("path"), "handler")
    deco = r"""@\w+\.(route|get|post|put|patch|delete)\s*\(\s*['"]([^'"\n]+)['"]([^)\n]*)\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)"""
    py = c.where("lang = 'py'").select("id", F.explode(F.arrays_zip(_triples(deco, (1, 2, 3)).alias("r"), F.regexp_extract_all("content", F.lit(deco), F.lit(4)).alias("h"))).alias("x"))
    said = F.regexp_extract_all("x.r.c", F.lit(r"""['"]([A-Za-z]+)['"]"""), F.lit(1))
    methods = F.when(F.col("x.r.a") != "route", F.array(F.upper("x.r.a"))).when(F.contains("x.r.c", F.lit("methods")) & (F.size(said) > 0), F.transform(said, F.upper)).otherwise(F.array(F.lit("GET")))
    python = py.select("id", F.explode(methods).alias("method"), F.col("x.r.b").alias("path"), F.col("x.h").alias("handler"))
    return scripts.unionByName(python).distinct()


def client_calls(contents: DataFrame) -> DataFrame:
    """(id, method, url, via, partial): API calls of client code; of calls alike in method and URL the one that tells its client is kept.

    A URL that a template continues ends at the hole, is partial and may have ANY method; ``fetch`` is GET unless its options name another.
    """
    c = with_family(contents).where("lang = 'js'")
    clients = r"""(?<![\w$.])(axios|http|client|api|ky|got|\$fetch|useFetch)(?:\.(get|post|put|patch|delete))?\s*\(\s*['"`]([^'"`\n]+)['"`]"""
    plain = r"""(?<![\w$.])fetch\s*\(\s*(['"`])([^'"`\n]+)['"`]\s*(?:,\s*\{[^}]*?\bmethod\s*:\s*['"](\w+)['"])?"""
    of = c.select("id", F.explode(F.concat(
        F.transform(_triples(clients, (1, 2, 3)), lambda z: F.struct(z["a"].alias("via"), z["b"].alias("m"), z["c"].alias("u"))), F.transform(_triples(plain, (1, 2, 3)), lambda z: F.struct(F.lit(None).cast("string").alias("via"), z["c"].alias("m"), z["b"].alias("u"))),
    )).alias("x"))
    hole = F.contains("x.u", F.lit("${"))
    rows = of.select("id", F.when(hole, "ANY").otherwise(F.coalesce(F.upper(F.nullif("x.m", F.lit(""))), F.lit("GET"))).alias("method"), F.regexp_replace("x.u", r"\$\{.*$", "").alias("url"), "x.via", hole.alias("partial")).where("url <> ''")
    return rows.groupBy("id", "method", "url").agg(F.min("via").alias("via"), F.max("partial").alias("partial")).select("id", "method", "url", "via", "partial")


def model_fields(contents: DataFrame) -> DataFrame:
    """(id, model, table_name, field, type): fields of database models in schema files and in Python and script classes.

    A model's body is what follows its head up to the next line that begins with a letter, a closing brace or another model.
    """
    c = with_family(contents)
    heads = {
        "prisma": (r"(?ms)^model\s+(\w+)\s*\{(.*?)^\}", r"(?m)^\s+(\w+)\s+(\w+)", r"@@map\(\s*\"([^\"]+)\""),
        "py": (r"(?ms)^class\s+(\w+)\s*\([^)\n]*(?:Base|Model)\b[^)\n]*\)\s*:(.*?)(?=^\S|\Z)", r"(?m)^\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:\w+\.)*(?:Column|mapped_column)?\(?\s*(?:\w+\.)*(\w+?)(?:Field)?\s*[(,)]", r"(?:__tablename__|db_table)\s*=\s*['\"]([^'\"]+)"),
        "js": (r"(?ms)@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)[^{]*\{(.*?)^\}", r"(?m)@(?:PrimaryGeneratedColumn|PrimaryColumn|Column|\w*To\w+)\([^\n]*?\)\s*(\w+)\s*[?!]?\s*:\s*(\w+)", r"(?!)()"),
    }
    out = None
    for lang, (head, field, table) in heads.items():
        m = c.where(F.col("lang") == lang).select("id", "content", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(head), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(head), F.lit(2)).alias("b"))).alias("x"))
        named = F.regexp_extract("content", r"@Entity\(\s*['\"]([^'\"]+)", 1) if lang == "js" else F.regexp_extract("x.b", table, 1)
        rows = m.select("id", F.col("x.n").alias("model"), F.nullif(named, F.lit("")).alias("table_name"), F.explode(F.arrays_zip(F.regexp_extract_all("x.b", F.lit(field), F.lit(1)).alias("f"), F.regexp_extract_all("x.b", F.lit(field), F.lit(2)).alias("t"))).alias("y"))
        rows = rows.select("id", "model", "table_name", F.col("y.f").alias("field"), F.col("y.t").alias("type")).where(~F.col("field").rlike("^__"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
