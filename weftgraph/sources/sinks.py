"""Exports: graph dumps, edge lists, diagrams, reports, append-only logs, version history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph, trace


def graph_json(files: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two directories, written in parallel."""
    nodes = files.join(graph.degrees(files, edges), "id").select("id", "ext", "loc", "size", F.col("n_in").alias("mass"))
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("k").alias("kind")).write.mode("overwrite").json(f"{path}/edges")


def chosen(files: DataFrame, edges: DataFrame, ext: str | None = None, min_mass: int = 0) -> tuple[DataFrame, DataFrame]:
    """Files of one extension and at least so many users, and the edges between them."""
    own = files.join(graph.degrees(files, edges).where(F.col("n_in") >= min_mass).select("id"), "id", "left_semi")
    own = own.where(F.col("ext") == ext.lower().lstrip(".")) if ext else own
    ids = own.select("id").distinct()
    return own, edges.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi").select(*edges.columns)


def edges_csv(edges: DataFrame, path: str, sep: str = ",") -> None:
    """Edges with a header; fields with separators, quotes or line ends are quoted and quotes doubled."""
    out = edges.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("k").alias("kind"))
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def mermaid(edges: DataFrame, most: int = 500) -> str:
    """A flow chart of at most ``most`` edges; the text is for reading, so it is bounded."""
    rows = edges.select("s", "t").distinct().orderBy("s", "t").limit(most).collect()
    alias: dict[str, str] = {}
    name = lambda x: alias.setdefault(x, f"n{len(alias)}")
    links = [f"  {name(r['s'])} --> {name(r['t'])}" for r in rows]
    marks = [f'  {a}["{x}"]' for x, a in alias.items()]
    return "\n".join(["graph LR", *marks, *links])


def ci_report(blast: DataFrame, high: int = 10, most: int = 20) -> str:
    """Markdown of (seed, dependents, tests): the changes that reach most, those of ``high`` dependents or more marked."""
    rows = blast.orderBy(F.col("dependents").desc(), "seed").limit(most).collect()
    lines = ["| file | dependents | tests |", "|---|---|---|"]
    lines += [f"| {'**' if r['dependents'] >= high else ''}{r['seed']}{'**' if r['dependents'] >= high else ''} | {r['dependents']} | {r['tests']} |" for r in rows]
    return "\n".join(lines)


def ci_json(blast: DataFrame, high: int = 10, most: int = 20) -> str:
    """The rows of ``ci_report`` as JSON."""
    rows = blast.orderBy(F.col("dependents").desc(), "seed").limit(most).collect()
    return json.dumps([{"file": r["seed"], "dependents": r["dependents"], "tests": r["tests"], "high": r["dependents"] >= high} for r in rows])


def ci_plain(blast: DataFrame, most: int = 20) -> str:
    """The rows of ``ci_report`` as lines of text."""
    rows = blast.orderBy(F.col("dependents").desc(), "seed").limit(most).collect()
    return "\n".join(f"{r['seed']}: {r['dependents']} dependents, {r['tests']} tests" for r in rows)


def audit_log(requests: DataFrame, path: str) -> None:
    """Appends (ts, ...) as JSON lines, a directory for each UTC day."""
    requests.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def append_new(rows: DataFrame, known: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows whose keys are not known yet, the first ``most`` by key."""
    return rows.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti").orderBy(*keys).limit(most)


def replace_once(contents: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """(id, content, outcome): one file's text with ``old`` replaced if it stands there exactly once; otherwise why not."""
    n = (F.length("content") - F.length(F.replace("content", F.lit(old), F.lit("")))) / len(old)
    outcome = F.when(n == 1, "replaced").when(n == 0, "not-found").otherwise("not-unique")
    return contents.where(F.col("id") == path).select("id", F.when(n == 1, F.replace("content", F.lit(old), F.lit(new))).otherwise(F.col("content")).alias("content"), outcome.alias("outcome"))


def written(contents: DataFrame, path: str, text: str) -> DataFrame:
    """(id, content) with one file's text replaced, or added where it was not there; a path that leaves the tree is refused."""
    if ".." in path.split("/") or path.startswith("/"):
        raise ValueError(f"{path} leaves the tree")
    new = contents.sparkSession.createDataFrame([(path, text)], "id string, content string")
    return contents.select("id", "content").where((F.col("id") != path) | F.col("id").isNull()).unionByName(new)


def restored(contents: DataFrame, versions: DataFrame, path: str, ts) -> DataFrame:
    """(id, content) with one file's text as the newest of (id, ts, content) that is not younger than ``ts``; unchanged if there is none."""
    old = versions.where((F.col("id") == path) & (F.col("ts") <= F.lit(ts))).groupBy("id").agg(F.max_by("content", "ts").alias("_old"), F.lit(True).alias("_has"))
    return contents.select("id", "content").join(F.broadcast(old), "id", "left").select("id", F.when(F.col("_has"), F.col("_old")).otherwise(F.col("content")).alias("content"))


def history(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """Versions of (id, ts, content) without repeats of the one before, the newest ``keep`` of each id."""
    return trace.versions(snapshots, keep)


def context_document(summary: DataFrame, packages: DataFrame, external: DataFrame, cleanup_count: int, most: int = 20, routes: DataFrame | None = None, models: DataFrame | None = None, env: DataFrame | None = None) -> str:
    """A short Markdown account of a project from bounded reports."""
    s = summary.first().asDict()
    out = ["# Project", *[f"- {k}: {v}" for k, v in s.items()], "## Packages"]
    out += [f"- {r['package']}: {r['n_files']} files" for r in packages.orderBy(F.col("n_files").desc(), "package").limit(most).collect()]
    out += ["## External hosts"] + [f"- {r['domain']} ({r['n_calls']})" for r in external.orderBy(F.col("n_calls").desc(), "domain").limit(most).collect()]
    for title, df, order, line in (
        ("Routes", routes, ("path", "method"), lambda r: f"{r['method']} {r['path']}"), ("Schema", models, ("model",), lambda r: f"{r['model']} ({r['n_fields']} fields)"), ("Environment", env, ("var",), lambda r: f"{r['var']}: {r['status']}"),
    ):
        if df is not None:
            out += [f"## {title}"] + [f"- {line(r)}" for r in df.orderBy(*order).limit(most).collect()]
    return "\n".join([*out, f"## Cleanup candidates: {cleanup_count}"])


def trace_json(events: DataFrame, path: str) -> None:
    """A trace in the order of its events as one JSON-lines file; a trace is one session's log, which a reader opens whole."""
    events.orderBy("seq").coalesce(1).write.mode("overwrite").json(path)


def append_observed(pairs: DataFrame, path: str) -> None:
    """Appends a batch of observed pairs (cf, cl, ef, el, batch_ts, ...) to a Parquet directory."""
    pairs.write.mode("append").parquet(path)


def compact_observed(spark, path: str, most_bytes: int = 512 << 10) -> bool:
    """Rewrites a directory of observed pairs without older repeats once it is larger than ``most_bytes``; tells whether it did.

    The new table is written beside the old one and renamed into its place, so a reader sees either.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at) or fs.getContentSummary(at).getLength() <= most_bytes:
        return False
    old = spark.read.parquet(path)
    keys = ["cf", "cl", "ef", "el"]
    rest = [c for c in old.columns if c not in keys]
    newest = old.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_ts").alias("_r")).select(*keys, "_r.*").select(*old.columns)
    fresh, gone = (jvm.org.apache.hadoop.fs.Path(path + tail) for tail in (".new", ".old"))
    newest.write.mode("overwrite").parquet(path + ".new")
    fs.rename(at, gone)
    fs.rename(fresh, at)
    fs.delete(gone, True)
    return True
