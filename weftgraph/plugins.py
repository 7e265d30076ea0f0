"""Registries: extractors by extension, exporters by name, engines that add edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
EXPORTERS: dict[str, Callable[[DataFrame, DataFrame], str]] = {}
LAYOUTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
SYMBOL_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
ENGINES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(*extensions: str):
    """Registers a function from (id, content) to (id, spec, kind) for extensions."""

    def put(f):
        for e in extensions:
            EXTRACTORS[e.lower()] = f
        return f

    return put


def extracted(contents: DataFrame) -> DataFrame | None:
    """What all registered extractors find, each over the contents of its extensions."""
    out = None
    ext = F.lower(F.regexp_extract("id", r"\.([^./]+)$", 1))
    for f in dict.fromkeys(EXTRACTORS.values()):
        rows = f(contents.where(ext.isin(*[e for e, g in EXTRACTORS.items() if g is f])))
        out = rows if out is None else out.unionByName(rows)
    return out


def enriched(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with those of the registered engines that are not there yet; ``via`` names the engine."""
    out = edges.select("s", "t", "k", F.lit(None).cast("string").alias("via"))
    for name, f in ENGINES.items():
        more = f(files).select("s", "t", "k").distinct().join(out.select("s", "t", "k"), ["s", "t", "k"], "left_anti")
        out = out.unionByName(more.withColumn("via", F.lit(name)))
    return out


def exported(name: str, files: DataFrame, edges: DataFrame) -> str:
    """What a registered exporter makes of a graph."""
    if name not in EXPORTERS:
        raise KeyError(f"no exporter {name}; there are {', '.join(sorted(EXPORTERS)) or 'none'}")
    return EXPORTERS[name](files, edges)


def laid_out(name: str, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y, z) of a registered layout: one row a file, at the origin where the layout places none."""
    if name not in LAYOUTS:
        raise KeyError(f"no layout {name}; there are {', '.join(sorted(LAYOUTS)) or 'none'}")
    placed = LAYOUTS[name](files, edges).groupBy("id").agg(*[F.first(c).cast("double").alias(c) for c in "xyz"])
    return files.select("id").distinct().join(placed, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"])


def symbol_parser(*extensions: str):
    """Registers a function from (id, content) to (id, name, kind, line) for extensions; the last registration of one counts."""

    def put(f):
        for e in extensions:
            SYMBOL_PARSERS[e.lower()] = f
        return f

    return put


def parsed_symbols(contents: DataFrame) -> DataFrame | None:
    """(id, name, kind, line) of all registered symbol parsers, each over the contents of its extensions."""
    ext, out = F.lower(F.regexp_extract("id", r"\.([^./]+)$", 1)), None
    for f in dict.fromkeys(SYMBOL_PARSERS.values()):
        rows = f(contents.where(ext.isin(*[e for e, g in SYMBOL_PARSERS.items() if g is f]))).select("id", "name", "kind", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


class Graph:
    """What a plugin may ask of a graph: files, edges, neighbours and degrees, and nothing it was not granted.

    ``granted`` names of ``read`` (files and edges), ``content`` and ``write`` (more edges); asking for more raises.
    """

    def __init__(self, files: DataFrame, edges: DataFrame, contents: DataFrame | None = None, granted: tuple[str, ...] = ("read",)):
        self._files, self._edges, self._contents, self._granted = files, edges, contents, frozenset(granted)

    def _need(self, right: str) -> None:
        if right not in self._granted:
            raise PermissionError(f"the plugin was not granted {right}")

    def files(self) -> DataFrame:
        self._need("read")
        return self._files

    def edges(self) -> DataFrame:
        self._need("read")
        return self._edges

    def contents(self) -> DataFrame:
        self._need("content")
        return self._contents

    def neighbours(self, seeds: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
        from weftgraph.operators import graph

        self._need("read")
        return graph.bfs(seeds, self._edges, depth, direction)

    def degrees(self) -> DataFrame:
        from weftgraph.operators import graph

        self._need("read")
        return graph.degrees(self._files, self._edges)

    def add_edges(self, more: DataFrame) -> DataFrame:
        self._need("write")
        self._edges = self._edges.select("s", "t", "k").unionByName(more.select("s", "t", "k")).distinct()
        return self._edges
