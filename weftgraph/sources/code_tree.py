"""Source trees as relations: files, contents, manifests, packages, environment files, history."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import extract, paths

#: Contents larger than this many bytes, and contents with a NUL, are recorded without text.
PARSE_GATE = 2 * 1024 * 1024
# Extensions that are tracked.
TRACKED = (
    "js jsx ts tsx mjs cjs py pyw pyi ipynb lsp dcl lisp el clj scm cljc css scss sass less styl html htm vue svelte astro json yaml yml toml md mdx rst "
    "java kt kts cs swift dart rs go rb php c cc cpp h hpp sh bash zsh ps1 psm1 sql xml prisma scala lua"
).split()
ENV_NAME = r"(?:^|/)\.env(?:\.[\w.-]+)?$|(?:^|/)[^/]+\.env$"


def scan(spark: SparkSession, root: str, ignore_text: str = "") -> tuple[DataFrame, DataFrame]:
    """(files, contents) of a directory tree that all executors see; ``ignore_text`` and the tree's own ignore file leave paths out.

    The driver lists names only, leaving tool directories out as it walks; executors read the files. (Spark's own file
    sources pass over names that begin with a dot or an underscore, which source trees are full of.) Only tracked
    extensions and environment files stay. ``loc`` counts lines (0 without text). An unreadable or binary text is null,
    one beyond the gate empty.
    """
    listed = []
    for at, below, names in os.walk(root):
        below[:] = sorted(x for x in below if x not in paths.IGNORED_DIRS and not re.match(paths.IGNORED_PREFIX, x))
        for n in sorted(names):
            full = os.path.join(at, n)
            rel = os.path.relpath(full, root).replace(os.sep, "/")
            if rel.rpartition(".")[2].lower() in TRACKED or re.search(ENV_NAME, rel):
                try:
                    st = os.stat(full)
                except OSError:
                    continue
                listed.append((rel, st.st_size, int(st.st_mtime * 1_000_000)))
    names = spark.createDataFrame(listed, "id string, size long, mtime long")
    names = names.where(~paths.ignored_by("id", paths.ignore_rules(ignore_text)) & ~paths.ignored_by("id", project_rules(root))).repartition(max(1, len(listed) // 500))
    base, gate = os.path.abspath(root), PARSE_GATE

    def read(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for i, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    raw = b"" if size > gate else open(os.path.join(base, i), "rb").read()
                    texts.append(None if b"\x00" in raw else raw.decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["id", "size", "mtime", "content"])

    rows = names.mapInArrow(read, "id string, size long, mtime long, content string")
    loc = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("content", "\n"))).cast("long")
    files = rows.select(
        "id", F.lower(F.regexp_extract("id", r"\.([^./]+)$", 1)).alias("ext"), loc.alias("loc"), "size", F.timestamp_micros("mtime").cast("timestamp_ntz").alias("last_seen"),
        F.when(F.col("content").isNull(), "low").otherwise("high").alias("confidence"),
    )
    return files, rows.select("id", "content")


#: Names of a project's own ignore file in the order in which they are asked; the first that exists counts, alone.
PROJECT_IGNORE = (".weftignore", ".graphignore")


def project_rules(root: str, names: tuple[str, ...] = PROJECT_IGNORE) -> list[tuple[str, bool]]:
    """Ignore rules of a tree's own ignore file; none if no such file can be read."""
    for n in names:
        try:
            with open(os.path.join(root, n), encoding="utf-8", errors="replace") as f:
                return paths.ignore_rules(f.read())
        except OSError:
            continue
    return []


def env_files(contents: DataFrame) -> DataFrame:
    """(file, var) declared by environment files at most four directories deep."""
    own = contents.where(F.col("id").rlike(ENV_NAME) & (F.size(F.split("id", "/")) <= 5))
    lines = own.select(F.col("id").alias("file"), F.explode(F.split("content", r"\r?\n")).alias("l"))
    return lines.select("file", F.regexp_extract(F.trim("l"), r"^(?:export\s+)?([A-Z][A-Z0-9_]*)\s*=", 1).alias("var")).where("var <> ''").distinct()


def edges(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(s, t, k): imports of contents resolved to files; what is declined has no row."""
    from weftgraph.operators.resolve import resolve_imports

    found = extract.imports(contents).select(F.col("id").alias("s"), "spec", "kind")
    # styles, markup and includes name their neighbours without a leading dot, Python its own packages with dots
    dotted = F.regexp_extract("spec", r"^(\.+)", 1)
    rest = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
    python = F.when(F.length(dotted) > 0, F.concat(F.lit("./"), F.repeat(F.lit("../"), F.length(dotted) - 1), rest)).otherwise(F.concat(F.lit("./"), rest))
    lang = extract.family(F.lower(F.regexp_extract("s", r"\.([^./]+)$", 1)))
    spec = F.when(lang == "py", python).when(lang.isin("css", "c", "md") & ~F.col("spec").rlike(r"^\.\.?/"), F.concat(F.lit("./"), F.col("spec"))).otherwise(F.col("spec"))
    got = resolve_imports(found.select("s", spec.alias("spec"), "kind"), files)
    return got.where(F.col("t").isNotNull() & (F.col("s") != F.col("t"))).select("s", "t", F.col("kind").alias("k")).distinct()


# Manifests with their languages, files of workspace tools and tables of Python's in the order in which they are asked.
MANIFESTS = {"package.json": "js", "pyproject.toml": "py", "setup.py": "py", "Cargo.toml": "rs", "go.mod": "go", "pom.xml": "java"}
WORKSPACE_FILES = ("pnpm-workspace.yaml", "lerna.json", "rush.json", "turbo.json", "nx.json", "yarn.lock")
PYTHON_TOOLS = (("uv", "[tool.uv"), ("poetry", "[tool.poetry"), ("pdm", "[tool.pdm"), ("hatch", "[tool.hatch"), ("setuptools", "[tool.setuptools"), ("pep621", "[project]"))


def yaml_list(text: str, key: str) -> list[str]:
    """The items of a list of plain strings under a key of a YAML text, written as lines or as a flow."""
    flow = re.search(rf"(?m)^{key}\s*:\s*\[([^\]]*)\]", text)
    if flow:
        return [x.strip().strip("'\"") for x in flow[1].split(",") if x.strip()]
    block = re.search(rf"(?m)^{key}\s*:\s*(?:#.*)?\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|\Z))*)", text)
    return [x.strip().strip("'\"") for x in re.findall(r"(?m)^[ \t]*-[ \t]*((?:'[^'\n]*'|\"[^\"\n]*\"|[^#\n])+)", block[1])] if block else []


def workspace(root_files: dict[str, str]) -> tuple[str | None, list[str]]:
    """(kind, globs) that the files at a project's root tell: which tool keeps its packages, and where they are.

    pnpm, then npm or yarn workspaces, lerna, rush; turbo and nx give their name to what the others list. Python projects are named
    after the first tool whose table their manifest has.
    """
    spaces = _json(root_files.get("package.json", "")).get("workspaces")
    spaces = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    kind, globs = None, []
    if "pnpm-workspace.yaml" in root_files:
        kind, globs = "pnpm", yaml_list(root_files["pnpm-workspace.yaml"], "packages")
    elif isinstance(spaces, list):
        kind, globs = "yarn" if "yarn.lock" in root_files else "npm", spaces
    elif "lerna.json" in root_files:
        kind, globs = "lerna", _json(root_files["lerna.json"]).get("packages") or ["packages/*"]
    elif "rush.json" in root_files:
        kind, globs = "rush", [p["projectFolder"] for p in _json(root_files["rush.json"]).get("projects", []) if isinstance(p, dict) and "projectFolder" in p]
    kind = next((k for k in ("turbo", "nx") if f"{k}.json" in root_files), kind)
    if kind is None:
        kind = next((k for k, mark in PYTHON_TOOLS if mark in root_files.get("pyproject.toml", "")), None)
    return kind, [g for g in globs if isinstance(g, str)]


def packages(contents: DataFrame) -> DataFrame:
    """(name, rel_root, manifest, kind, language) of the manifests in a tree.

    The kind is that of the workspace tool; only the files at the root that tell it, which are of a few fixed names, are read on the
    driver. Where a workspace lists its packages, script packages outside of its globs are left out. Of equal names the later root
    is told by its path; a manifest without a name has its directory's.
    """
    name = paths.base_name("id")
    at_root = contents.where(F.col("id").isin(*MANIFESTS, *WORKSPACE_FILES)).select("id", F.coalesce("content", F.lit("")).alias("c"))
    kind, globs = workspace({r["id"]: r["c"] for r in at_root.groupBy("id").agg(F.max("c").alias("c")).collect()})
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    said = {"pyproject.toml": r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", "setup.py": r"\bname\s*=\s*[\"']([^\"']+)", "Cargo.toml": r"(?m)^\s*name\s*=\s*\"([^\"]+)", "go.mod": r"(?m)^module\s+(\S+)", "pom.xml": r"<artifactId>([^<]+)"}
    own = F.when(F.col("manifest") == "package.json", F.get_json_object("text", "$.name"))
    for m, rx in said.items():
        own = own.when(F.col("manifest") == m, F.regexp_extract("text", rx, 1))
    rows = contents.where(name.isin(*MANIFESTS)).select("id", name.alias("manifest"), F.regexp_replace("id", r"/?[^/]*$", "").alias("rel_root"), text.alias("text")).dropDuplicates(["id"])
    keep, drop = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
    member = lambda gs: F.col("rel_root").rlike("|".join("^" + paths.glob_regex(g.removeprefix("./").rstrip("/")) + "$" for g in gs)) if gs else F.lit(False)
    if keep:
        rows = rows.where((F.col("manifest") != "package.json") | (F.col("rel_root") == "") | (member(keep) & ~member(drop)))
    language = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    named = rows.select("id", F.coalesce(F.nullif(own, F.lit("")), F.nullif("rel_root", F.lit("")), F.lit("root")).alias("own"), "rel_root", "manifest", language[F.col("manifest")].alias("language"))
    first = named.groupBy("own").agg(F.min("id").alias("_first"))
    n = named.agg(F.count(F.lit(1)).alias("_n"))
    out = named.join(first, "own").join(F.broadcast(n))
    label = F.lit(kind) if kind else F.when(F.col("_n") > 1, "multi-package").otherwise("single")
    return out.select(F.when(F.col("id") == F.col("_first"), F.col("own")).otherwise(F.concat("own", F.lit(" ("), "rel_root", F.lit(")"))).alias("name"), "rel_root", "manifest", label.alias("kind"), "language")


def _json(text: str) -> dict:
    try:
        got = json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", text)))
        return got if isinstance(got, dict) else {}
    except ValueError:
        return {}



def declared_deps(contents: DataFrame) -> DataFrame:
    """(manifest, dep, range, section) of package.json files."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    schema = "struct<" + ",".join(f"{k}:map<string,string>" for k in kinds) + ">"
    parsed = contents.where(paths.base_name("id") == "package.json").select(F.col("id").alias("manifest"), F.from_json("content", schema).alias("j"))
    out = None
    for k in kinds:
        rows = parsed.select("manifest", F.explode(F.col(f"j.{k}")).alias("dep", "range"), F.lit(k).alias("section"))
        out = rows if out is None else out.unionByName(rows)
    return out


def git_history(spark: SparkSession, root: str) -> DataFrame:
    """(hash, ts, subject, id): files that each commit added, oldest first; no rows where there is no repository."""
    cmd = ["git", "-C", root, "log", "--reverse", "--diff-filter=A", "--name-only", "--format=%x01%H%x02%ct%x02%s"]
    got = subprocess.run(cmd, capture_output=True, text=True).stdout
    rows, now = [], None
    for line in got.splitlines():
        if line.startswith("\x01"):
            h, ts, subject = line[1:].split("\x02", 2)
            now = (h, int(ts), subject)
        elif line and now:
            rows.append((*now, line))
    out = spark.createDataFrame(rows, "hash string, _ts long, subject string, id string")
    return out.select("hash", F.timestamp_seconds("_ts").alias("ts"), "subject", "id")


def git_statuses(text: str) -> list[tuple[str, str, str | None]]:
    """(id, status, before) of the lines of ``git diff --name-status``: added, modified, deleted, renamed or copied, with the name before."""
    names, out = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}, []
    for line in text.splitlines():
        parts = line.split("\t")
        if len(parts) >= 2 and parts[0][:1] in names:
            out.append((parts[-1], names[parts[0][0]], parts[1] if len(parts) > 2 else None))
    return out


def git_diff(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """(id, status, before) of files that differ between two commits; the list is one command's output."""
    got = subprocess.run(["git", "-C", root, "diff", "--name-status", "-M", f"{base}..{head}"], capture_output=True, text=True).stdout
    return spark.createDataFrame(git_statuses(got), "id string, status string, before string")


def git_tree(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """(id, size) of the files of a commit's tree, whatever is checked out."""
    got = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-l", "-z", commit], capture_output=True, text=True).stdout
    rows = [(name, int(meta.split()[-1]) if meta.split()[-1].isdigit() else None) for x in got.split("\0") if x for meta, _, name in (x.partition("\t"),)]
    return spark.createDataFrame(rows, "id string, size long")


def git_changed(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """(id) of files that differ between two commits."""
    got = subprocess.run(["git", "-C", root, "diff", "--name-only", "--diff-filter=ACMR", f"{base}..{head}"], capture_output=True, text=True).stdout
    return spark.createDataFrame([(x,) for x in got.splitlines() if x], "id string")
