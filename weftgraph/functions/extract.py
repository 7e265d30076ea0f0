"""Facts of source text as column expressions: imports, URLs, environment reads, routes, API calls, symbols, dynamic patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths

# How each language writes what is extracted; group 1 is the fact.
IMPORTS = {
    "js": ((r"""(?m)^\s*import\b[^'"\n;]*?['"]([^'"\n]+)['"]""", "import"), (r"""(?m)^\s*export\b[^'"\n;]*?\bfrom\s*['"]([^'"\n]+)['"]""", "reexport"), (r"""\brequire\s*\(\s*['"]([^'"\n]+)['"]\s*\)""", "require"), (r"""\bimport\s*\(\s*['"]([^'"\n]+)['"]\s*\)""", "dynamic"), (r"""\b(?:jest|vi)\.mock\s*\(\s*['"]([^'"\n]+)['"]""", "mock"), (r"""\bnew\s+Worker\s*\(\s*['"]([^'"\n]+)['"]""", "worker")),
    "py": ((r"(?m)^\s*from\s+([.\w]+)\s+import\b", "import"), (r"(?m)^\s*import\s+([\w.]+)", "import"), (r"""\b(?:importlib\.import_module|__import__)\s*\(\s*['"]([^'"\n]+)['"]""", "dynamic")),
    "go": ((r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""", "import"),),
    "java": ((r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "import"),),
    "c": ((r"""(?m)^\s*#\s*include\s*[<"]([^>"\n]+)[>"]""", "include"),),
    "css": ((r"""@import\s+(?:url\()?\s*['"]?([^'")\s;]+)""", "import"), (r"""@(?:use|forward)\s+['"]([^'"\n]+)['"]""", "use"), (r"""url\(\s*['"]?([^'")\s]+)""", "asset")),
    "md": ((r"!?\[[^\]\n]*\]\(([^)\s#]+)", "ref"),),
    "sh": ((r"(?m)^\s*(?:source|\.)\s+([^\s;&|]+)", "source"),),
    "html": ((r"""(?i)<(?:script|img|iframe|video|source|audio|embed)\b[^>]*?\bsrc\s*=\s*["']([^"']+)""", "asset"), (r"""(?i)<link\b[^>]*?\bhref\s*=\s*["']([^"']+)""", "asset")),
    "rs": ((r"(?m)^\s*(?:pub\s+)?mod\s+([A-Za-z_]\w*)\s*;", "import"), (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "use"), (r"(?m)^\s*extern\s+crate\s+([A-Za-z_]\w*)", "import")),
    "rb": ((r"""(?m)^\s*require(?:_relative)?\s*\(?\s*['"]([^'"\n]+)""", "require"),),
    "php": ((r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"\n]+)""", "require"), (r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\\\]+)", "use")),
    "cs": ((r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", "using"),),
    "swift": ((r"(?m)^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)", "import"),),
    "dart": ((r"""(?m)^\s*import\s+['"]([^'"\n]+)""", "import"), (r"""(?m)^\s*export\s+['"]([^'"\n]+)""", "export"), (r"""(?m)^\s*part\s+['"]([^'"\n]+)""", "part")),
    "ps1": ((r"(?m)^\s*\.\s+['\"]?([^\s'\"]+\.ps1)", "source"), (r"(?mi)^\s*Import-Module\s+['\"]?([^\s'\"]+)", "import-module")),
    "clj": ((r"\[([a-zA-Z][\w.-]*\.[\w.-]+)(?:\s+:(?:as|refer))", "require"),),
    "lisp": ((r"(?i)\((?:load|require)\s+['\"]+([^\s'\")]+)", "require"),),
    "rst": ((r"(?m)^\.\.\s+include::\s*(\S+)", "include"), (r":doc:`(?:[^`<\n]*<)?([^`>\n]+)", "doc")),
    "lua": ((r"""\brequire\s*\(?\s*['"]([^'"\n]+)""", "require"),),
}
# How model definitions begin; group 1 is the name.
MODELS = {
    "prisma": ((r"(?m)^model\s+([A-Za-z_]\w*)\s*\{", "prisma"),),
    "py": ((r"(?m)^class\s+([A-Za-z_]\w*)\s*\([^)\n]*\b(?:Base|Model|DeclarativeBase|SQLModel)\b", "sqlalchemy"),),
    "js": ((r"""\b(?:pgTable|mysqlTable|sqliteTable)\s*\(\s*['"]([^'"\n]+)""", "drizzle"), (r"""\bmongoose\.model\s*(?:<[^>\n]*>)?\(\s*['"]([^'"\n]+)""", "mongoose"), (r"@Entity\([^)\n]*\)\s*(?:export\s+)?class\s+([A-Za-z_]\w*)", "typeorm")),
}
FAMILY = {"ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "cjs": "js", "pyi": "py", "pyw": "py", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "kt": "java", "scss": "css", "less": "css", "sass": "css", "bash": "sh", "zsh": "sh", "mdx": "md", "htm": "html", "kts": "java", "psm1": "ps1", "cljc": "clj", "lsp": "lisp", "el": "lisp", "scm": "lisp", "vue": "js", "svelte": "js", "astro": "js"}
ENV_READS = (
    r"process\.env\.([A-Z][A-Z0-9_]*)", r"""process\.env\[\s*['"]([A-Z][A-Z0-9_]*)""", r"import\.meta\.env\.([A-Z][A-Z0-9_]*)", r"""os\.(?:environ\.get|getenv)\(\s*['"]([A-Z][A-Z0-9_]*)""",
    r"""os\.environ\[\s*['"]([A-Z][A-Z0-9_]*)""", r"""os\.(?:Getenv|LookupEnv)\(\s*"([A-Z][A-Z0-9_]*)""", r"""System\.getenv\(\s*"([A-Z][A-Z0-9_]*)""", r"""\bgetenv\(\s*"([A-Z][A-Z0-9_]*)""", r"""env::var\(\s*"([A-Z][A-Z0-9_]*)""", r"""ENV\[\s*['"]([A-Z][A-Z0-9_]*)""", r"\$\{([A-Z][A-Z0-9_]*)[}:-]",
)
URL = r"""((?:https?|wss?)://[^\s'"`<>)\]}\\]+)"""
DYNAMIC = (("eval", r"\beval\s*\("), ("new-function", r"\bnew\s+Function\s*\("), ("exec", r"(?<![\w.])exec\s*\("), ("import-expression", r"\bimport\s*\(\s*[^'\"\s)]"), ("require-expression", r"\brequire\s*\(\s*[^'\"\s)]"), ("importlib", r"\bimportlib\.import_module\s*\(|\b__import__\s*\("), ("reflection", r"\bgetattr\s*\(|\bClass\.forName\s*\(|\breflect\.\w+\(|\bMethod\.invoke\("), ("injection", r"@(?:Inject|Autowired|Injectable)\b"))
ROUTES = (
    r"""(?:app|router|server|api|fastify)\.(get|post|put|patch|delete|all)\s*\(\s*['"`]([^'"`\n]+)""", r"""@(?:\w+\.)?(get|post|put|patch|delete|route)\s*\(\s*['"]([^'"\n]+)""", r"""@(Get|Post|Put|Patch|Delete)(?:Mapping)?\s*\(\s*['"]([^'"\n]+)""", r"""\.(GET|POST|PUT|PATCH|DELETE|Handle|HandleFunc)\s*\(\s*"([^"\n]+)""",
)
CALLS = (r"""\b(?:fetch|load|\$fetch|useFetch)\s*\(\s*['"`]([^'"`\n]+)""", r"""\b(?:axios|http|client|api|requests|httpx)\.(?:get|post|put|patch|delete)\s*\(\s*['"`]([^'"`\n]+)""")
SYMBOLS = {
    "js": ((r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "function"), (r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "class"), (r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>", "function"), (r"(?m)^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface"), (r"(?m)^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]", "type")),
    "py": ((r"(?m)^(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"(?m)^[ \t]+(?:async\s+)?def\s+([A-Za-z_]\w*)", "method"), (r"(?m)^\s*class\s+([A-Za-z_]\w*)", "class")),
    "go": ((r"(?m)^func\s+([A-Za-z_]\w*)", "function"), (r"(?m)^func\s+\([^)\n]*\)\s*([A-Za-z_]\w*)", "method"), (r"(?m)^type\s+([A-Za-z_]\w*)\s+struct", "struct"), (r"(?m)^type\s+([A-Za-z_]\w*)\s+interface", "interface")),
    "java": ((r"\b(?:class|record)\s+([A-Za-z_]\w*)", "class"), (r"\binterface\s+([A-Za-z_]\w*)", "interface"), (r"\benum\s+([A-Za-z_]\w*)", "enum"), (r"(?m)^\s*(?:public|private|protected)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\(", "method")),
    "c": ((r"(?m)^(?:static\s+|inline\s+|extern\s+)*(?:const\s+)?(?:unsigned\s+|struct\s+)*[A-Za-z_]\w*[\s*]+([A-Za-z_]\w*)\s*\([^;{]*\)\s*\{", "function"), (r"(?m)^\s*(?:typedef\s+)?struct\s+([A-Za-z_]\w*)\s*\{", "struct")),
}


def family(ext: Column | str) -> Column:
    """Language family of an extension."""
    c = F.col(ext) if isinstance(ext, str) else ext
    m = F.create_map(*[x for k, v in FAMILY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), c)


def with_family(contents: DataFrame) -> DataFrame:
    """Distinct (id, content, lang) of contents that were kept."""
    ext = F.lower(F.regexp_extract("id", r"\.([^./]+)$", 1))
    return contents.where(F.col("id").isNotNull() & (F.length("content") > 0)).select("id", "content", family(ext).alias("lang")).distinct()


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _of_kind(kind: str):
    return lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind"))


def by_language(contents: DataFrame, patterns: dict) -> DataFrame:
    """(id, value, kind) of the patterns of each file's language, one pass over the text, JVM-side."""
    whole = None
    for lang, rules in patterns.items():
        found = F.flatten(F.array(*[F.transform(_all(rx), _of_kind(k)) for rx, k in rules]))
        whole = F.when(F.col("lang") == lang, found) if whole is None else whole.when(F.col("lang") == lang, found)
    return contents.where(F.col("lang").isin(*patterns)).select("id", F.explode(F.array_distinct(whole)).alias("x")).select("id", "x.value", "x.kind")


def imports(contents: DataFrame) -> DataFrame:
    """(id, spec, kind) of import statements; bare, absolute and data URLs of styles and documents are left out."""
    got = by_language(with_family(contents), IMPORTS).withColumnRenamed("value", "spec")
    return got.where(~(F.col("kind").isin("asset", "ref", "use") & F.col("spec").rlike(r"^(?:https?:|//|data:|mailto:|#)")))


def urls(contents: DataFrame) -> DataFrame:
    """(id, url, n): absolute URLs of at least 12 characters with their counts; trailing punctuation belongs to the text."""
    each = with_family(contents).select("id", F.explode(_all(URL)).alias("u")).select("id", F.regexp_replace("u", r"[.,;:!?]+$", "").alias("url"))
    return each.where(F.length("url") >= 12).groupBy("id", "url").agg(F.count(F.lit(1)).alias("n"))


def env_reads(contents: DataFrame) -> DataFrame:
    """(id, var): environment variables that a text reads."""
    return with_family(contents).select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_all(p) for p in ENV_READS])))).alias("var")).distinct()


def dynamic(contents: DataFrame) -> DataFrame:
    """(id, patterns, confidence): dynamic patterns and the trust in a file's edges: low with evaluated code or injection, medium with any other, else high."""
    found = F.filter(F.array(*[F.when(F.col("content").rlike(rx), F.lit(n)) for n, rx in DYNAMIC]), lambda x: x.isNotNull())
    d = with_family(contents).select("id", found.alias("p"))
    d = d.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("p"))
    low = F.arrays_overlap("p", F.array(*[F.lit(x) for x in ("eval", "new-function", "exec", "injection")]))
    return d.select("id", F.array_join("p", ",").alias("patterns"), F.when(low, "low").when(F.size("p") > 0, "medium").otherwise("high").alias("confidence"))


def routes(contents: DataFrame) -> DataFrame:
    """(id, method, path) of routes that code registers; a registration without method serves ANY."""
    c = with_family(contents)
    both = F.flatten(F.array(*[F.zip_with(_all(rx, 1), _all(rx, 2), lambda m, p: F.struct(F.upper(m).alias("m"), p.alias("p"))) for rx in ROUTES]))
    each = c.select("id", F.explode(F.array_distinct(both)).alias("r"))
    return each.select("id", F.when(F.col("r.m").isin("ROUTE", "HANDLE", "HANDLEFUNC"), "ANY").otherwise(F.col("r.m")).alias("method"), F.col("r.p").alias("path")).distinct()


def api_calls(contents: DataFrame) -> DataFrame:
    """(id, url, partial): URLs that client code calls; those with a template's hole end at it and are partial."""
    each = with_family(contents).select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_all(rx) for rx in CALLS])))).alias("u"))
    return each.select("id", F.regexp_replace("u", r"\$\{.*$", "").alias("url"), F.contains("u", F.lit("${")).alias("partial")).where("url <> ''").distinct()


def symbols(contents: DataFrame) -> DataFrame:
    """(id, name, kind) of declarations by patterns of each language."""
    return by_language(with_family(contents), SYMBOLS).withColumnRenamed("value", "name")


def models(contents: DataFrame) -> DataFrame:
    """(id, name, kind) of database models that code or schema files define."""
    return by_language(with_family(contents), MODELS).withColumnRenamed("value", "name")


def notebook_code(contents: DataFrame) -> DataFrame:
    """(id, content): notebooks as the Python of their code cells, without lines of magics, under an id that ends in .py."""
    cell = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    nb = contents.where(F.col("id").rlike(r"(?i)\.ipynb$")).select("id", F.from_json("content", cell).alias("j"))
    code = F.transform(F.filter("j.cells", lambda c: c["cell_type"] == "code"), lambda c: F.array_join(F.filter(c["source"], lambda x: ~x.rlike(r"^\s*[%!]")), ""))
    return nb.select(F.concat("id", F.lit(".py")).alias("id"), F.array_join(code, "\n").alias("content")).where(F.col("content").isNotNull())


def deprecated(contents: DataFrame, symbols_at: DataFrame) -> DataFrame:
    """(symbol, deprecated) of (symbol, file, line): a marker in the first five lines of the file or in the five above the declaration."""
    lines = contents.select(F.col("id").alias("file"), F.split("content", "\n").alias("ls")).where(F.col("ls").isNotNull())
    near = lambda at, n: F.array_join(F.slice("ls", at, n), "\n").rlike(r"(?i)@?deprecated")
    j = symbols_at.join(lines, "file", "left")
    start = F.greatest(F.lit(1), F.col("line") - 5).cast("int")
    return j.select("symbol", F.coalesce(near(F.lit(1), F.lit(5)) | near(start, (F.col("line") - start).cast("int")), F.lit(False)).alias("deprecated"))


def python_flow(contents: DataFrame) -> DataFrame:
    """(id, fn, fact, name, arg, origin, line): where the arguments and returns of each Python function come from.

    ``fact`` is param, arg (``name`` is the callee, ``arg`` the position) or return; ``origin`` is ``param:x``, ``call:f``, ``literal`` or
    ``unknown``. A name that is assigned twice, or from itself, is unknown.
    """
    import ast
    import warnings

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = "id string, fn string, fact string, name string, arg long, origin string, line long"
    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]

    def called(node):
        f = node.func
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def facts(i: str, text: str):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        for fn in ast.walk(tree):
            if not isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            params = [a.arg for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs)]
            known = {p: f"param:{p}" for p in params}
            inside = [n for n in ast.walk(fn) if n is not fn]

            def origin(e):
                if isinstance(e, ast.Constant):
                    return "literal"
                if isinstance(e, ast.Name):
                    return known.get(e.id, "unknown")
                if isinstance(e, ast.Call) and called(e):
                    return f"call:{called(e)}"
                return "unknown"

            targets: dict[str, int] = {}
            for n in inside:
                if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For)):
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        for x in ast.walk(t):
                            if isinstance(x, ast.Name):
                                targets[x.id] = targets.get(x.id, 0) + (2 if isinstance(n, (ast.AugAssign, ast.For)) else 1)
            for n in inside:
                if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                    x = n.targets[0].id
                    known[x] = origin(n.value) if targets[x] == 1 and x not in params else "unknown"
            for x, times in targets.items():
                if times > 1 or x in params:
                    known[x] = "unknown"
            for k, p in enumerate(params):
                yield i, fn.name, "param", p, k, None, fn.lineno
            for n in inside:
                if isinstance(n, ast.Call) and called(n):
                    for k, a in enumerate(n.args):
                        yield i, fn.name, "arg", called(n), k, origin(a), n.lineno
                elif isinstance(n, ast.Return) and n.value is not None:
                    yield i, fn.name, "return", None, None, origin(n.value), n.lineno

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for i, t in zip(*[c.to_pylist() for c in b.columns]) for r in facts(i, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "fn", "fact", "name", "arg", "origin", "line"])

    return with_family(contents).where("lang = 'py'").select("id", "content").mapInArrow(run, schema).distinct()


def python_facts(contents: DataFrame) -> DataFrame:
    """(id, fact, name, line, end_line, owner) of Python files by the standard library's parser, in Arrow batches.

    Facts: import, module (what an import may mean: the package and the package with the name), dynamic import (literals), class,
    function, method, call; ``owner`` is the enclosing definition. A text that does not parse gives one row ``error``.
    """
    import ast
    import warnings

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = "id string, fact string, name string, line long, end_line long, owner string"
    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]

    def facts(i: str, text: str):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            yield i, "error", None, None, None, None
            return
        todo = [(tree, "")]
        while todo:
            node, owner = todo.pop()
            for child in ast.iter_child_nodes(node):
                mine = owner
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    mine = f"{owner}.{child.name}" if owner else child.name
                    fact = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                    yield i, fact, mine, child.lineno, child.end_lineno, owner or None
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield i, "import", a.name, child.lineno, child.end_lineno, owner or None
                elif isinstance(child, ast.ImportFrom):
                    for a in child.names:
                        yield i, "import", "." * child.level + (child.module or "") + (":" + a.name), child.lineno, child.end_lineno, owner or None
                        # what is imported may be a module of the package or a name in it: both are asked for
                        yield i, "module", "." * child.level + (child.module or ""), child.lineno, child.end_lineno, owner or None
                        if a.name != "*":
                            yield i, "module", "." * child.level + ".".join(x for x in (child.module, a.name) if x), child.lineno, child.end_lineno, owner or None
                elif isinstance(child, ast.Call):
                    f = child.func
                    n = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if n in ("import_module", "__import__") and child.args and isinstance(child.args[0], ast.Constant) and isinstance(child.args[0].value, str):
                        yield i, "dynamic import", child.args[0].value, child.lineno, child.end_lineno, owner or None
                    if n:
                        yield i, "call", n, child.lineno, child.end_lineno, owner or None
                todo.append((child, mine))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for i, t in zip(*[c.to_pylist() for c in b.columns]) for r in facts(i, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "fact", "name", "line", "end_line", "owner"])

    own = with_family(contents).where("lang = 'py'").select("id", "content")
    return own.mapInArrow(run, schema).distinct()
