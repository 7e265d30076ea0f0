"""Text, vector and line-difference operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(contents: DataFrame, needle: str, regex: bool = False, case: bool = False, most: int | None = None, per_file: int | None = None) -> DataFrame:
    """(id, line, col, snippet, total): non-overlapping matches by line and column from 1, with 50 characters round them.

    ``total`` counts the matches of the file before any cut. A filter on the whole text runs first; only lines of texts
    that contain the needle are split. Texts of any length are searched whole; none is skipped.
    """
    pattern = needle if regex else re.escape(needle)
    pattern = pattern if case else "(?i)" + pattern
    have = contents.where(F.col("content").rlike(pattern)).select("id", "content").distinct()
    lines = have.select("id", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("_i", "text")).where(F.col("text").rlike(pattern))
    found = lines.select("id", (F.col("_i") + 1).cast("long").alias("line"), "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("_m"))
    # the column of a match is where the rest of the line, after the matches before it, holds it
    at = F.aggregate(
        "_m", F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("cols")),
        lambda acc, m: F.struct(
            (_locate(m, acc["next"]) + F.greatest(F.length(m), F.lit(1))).alias("next"),
            F.array_append(acc["cols"], _locate(m, acc["next"])).alias("cols"),
        ),
    )
    rows = found.withColumn("_c", at["cols"]).select("id", "line", "text", F.explode("_c").alias("col"))
    snippet = F.regexp_replace(F.substring(F.col("text"), F.greatest(F.lit(1), F.col("col") - 50), F.lit(100 + len(needle))), r"\s+", " ")
    out = rows.select("id", "line", F.col("col").cast("long").alias("col"), snippet.alias("snippet"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("total"))
    if per_file:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("line", "col"))).where(F.col("_r") <= per_file).drop("_r")
    return out.orderBy("id", "line", "col").limit(most) if most else out


def _locate(m, start):
    """1-based place of ``m`` in ``text`` from ``start`` on."""
    return F.instr(F.substring(F.col("text"), start, F.length("text")), m) + start - 1


def cosine_top(vectors: DataFrame, query: list[float], k: int = 30, least: float = 0.3) -> DataFrame:
    """(id, similarity) of (id, vector) above ``least``, the ``k`` best; vectors of unit length. The query is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("vector", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.select("id", F.round(dot, 6).alias("similarity")).where(F.col("similarity") > least).orderBy(F.col("similarity").desc(), "id").limit(k)


def cosine_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query, id, similarity, rank): for each query of (id, vector) its ``k`` best other rows; vectors of unit length, ties by id.

    Queries go to the executors in blocks of ``block`` rows, which bounds what a task holds; each Arrow batch is one matrix product
    and keeps ``k`` rows a query, so what is shuffled is ``k`` rows a query and batch.
    """
    import numpy as np

    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    out = None
    rows: list = []

    def part(chunk):
        ids = [r["id"] for r in chunk]
        m = np.array([r["vector"] for r in chunk], np.float64)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                own = np.array(b.column(0).to_pylist(), object)
                v = np.array(b.column(1).to_pylist(), np.float64)
                sims = np.round(m @ v.T, 5)
                q, i, s = [], [], []
                for j, x in enumerate(ids):
                    order = sorted(np.flatnonzero(own != x).tolist(), key=lambda p: (-sims[j, p], own[p]))[:k] if len(own) <= 4 * k else None
                    if order is None:
                        row = np.where(own == x, -np.inf, sims[j])
                        edge = np.partition(row, len(row) - k)[len(row) - k]
                        order = sorted(np.flatnonzero(row >= edge).tolist(), key=lambda p: (-sims[j, p], own[p]))[:k]
                    q += [x] * len(order)
                    i += [own[p] for p in order]
                    s += [float(sims[j, p]) for p in order]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s, pa.float64())], names=["query", "id", "similarity"])

        return vectors.select("id", "vector").where(F.col("vector").isNotNull()).mapInArrow(run, f"query {kind}, id {kind}, similarity double")

    for r in queries.select("id", "vector").where(F.col("vector").isNotNull()).orderBy("id").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out, rows = (part(rows) if out is None else out.unionByName(part(rows))), []
    if rows:
        out = part(rows) if out is None else out.unionByName(part(rows))
    if out is None:
        return spark.createDataFrame([], f"query {kind}, id {kind}, similarity double, rank long")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def line_diff(pairs: DataFrame, most_cells: int = 2_000_000) -> DataFrame:
    """(id, n, op, before_line, after_line, text) of (id, before, after): longest common subsequence of lines; deletions first on ties.

    Pairs beyond ``most_cells`` give one row with op ``note``.
    """
    import numpy as np

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = "id string, n long, op string, before_line long, after_line long, text string"
    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]

    def diff(a: list[str], b: list[str]):
        table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        ids = {}
        x = np.array([ids.setdefault(s, len(ids)) for s in a])
        y = np.array([ids.setdefault(s, len(ids)) for s in b])
        for i in range(len(a) - 1, -1, -1):
            eq = y == x[i] if len(b) else np.zeros(0, bool)
            best = np.maximum(table[i + 1, :-1], np.where(eq, table[i + 1, 1:] + 1, 0))
            table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and x[i] == y[j]:
                yield "eq", i + 1, j + 1, a[i]
                i, j = i + 1, j + 1
            elif i < len(a) and (j == len(b) or table[i + 1, j] >= table[i, j + 1]):
                yield "del", i + 1, None, a[i]
                i += 1
            else:
                yield "add", None, j + 1, b[j]
                j += 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                a, b = (a or "").split("\n"), (b or "").split("\n")
                if len(a) * len(b) > most_cells:
                    rows.append((i, 1, "note", None, None, "too large to compare"))
                    continue
                rows.extend((i, n, *r) for n, r in enumerate(diff(a, b), 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "n", "op", "before_line", "after_line", "text"])

    return pairs.select(F.col("id").cast("string"), "before", "after").mapInArrow(run, schema)


STOP = {"the", "a", "an", "of", "in", "and", "to", "is", "for", "on", "with", "by", "at", "as", "it", "this", "that", "how", "what", "where", "which", "does", "do", "are", "be", "or", "from"}


def keywords(query: str) -> list[str]:
    """Words of a query, split at case changes, in lower case, lightly stemmed, without stop words."""
    out: list[str] = []
    for part in re.findall(r"[^\W_]+", query):
        for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+", part):
            w = w.lower()
            for end, put in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
                if w.endswith(end) and len(w) - len(end) >= 4:
                    w = w[: len(w) - len(end)] + put
                    break
            if w not in STOP and len(w) > 1 and w not in out:
                out.append(w)
    return out


def explore(symbols: DataFrame, query: str, per_group: int = 8) -> DataFrame:
    """(symbol, group, rank, n_in) of (symbol, name, file, n_in, deprecated, aux, entry): keyword matches by class, the most used first.

    Classes in order: exact_match, deprecated, test, aux, entry, orphan, active (three users or more), normal.
    """
    words = keywords(query)
    if not words:
        return symbols.where("false").select("symbol", F.lit("").alias("group"), F.lit(0).cast("long").alias("rank"), "n_in")
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("name"), F.lit(w)) | F.contains(F.lower("file"), F.lit(w))
    group = (
        F.when(F.lower("name") == query.strip().lower(), "exact_match").when(F.col("deprecated"), "deprecated").when(F.col("file").rlike(r"(?i)(?:^|/)(?:__tests__|tests?|spec)/"), "test")
        .when(F.col("aux"), "aux").when(F.col("entry"), "entry").when(F.col("n_in") == 0, "orphan").when(F.col("n_in") >= 3, "active").otherwise("normal")
    )
    g = symbols.where(hit).select("symbol", group.alias("group"), "n_in")
    w = Window.partitionBy("group").orderBy(F.col("n_in").desc(), "symbol")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_group).select("symbol", "group", "rank", "n_in")


def explore_with_vectors(symbols: DataFrame, query: str, vectors: DataFrame, query_vector: list[float], budget: int, per_group: int = 8, k: int = 30) -> DataFrame:
    """(symbol, group, rank, total): ``explore`` with a group ``semantic`` of the nearest (id, vector), within ``budget`` tokens.

    ``symbols`` has ``tokens`` too. Groups stand in order, the nearest vectors first; a symbol counts once, in its first group; the prefix whose
    tokens fit the budget is kept, the first row always. What both legs give is bounded by ``per_group`` and ``k``.
    """
    near = cosine_top(vectors, query_vector, k).select(F.col("id").alias("symbol"), F.lit("semantic").alias("group"), F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")).cast("long").alias("rank"))
    order = F.create_map(*[F.lit(x) for i, g in enumerate(("semantic", "exact_match", "active", "normal", "entry", "orphan", "aux", "test", "deprecated")) for x in (g, i)])
    both = near.unionByName(explore(symbols, query, per_group).select("symbol", "group", "rank")).withColumn("_o", order[F.col("group")])
    once = both.groupBy("symbol").agg(F.min(F.struct("_o", "rank", "group")).alias("x")).select("symbol", "x.group", "x.rank", F.col("x._o").alias("_o"))
    w = Window.orderBy("_o", "rank", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    run = once.join(symbols.select("symbol", "tokens").dropDuplicates(["symbol"]), "symbol").withColumn("total", F.sum("tokens").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return run.where((F.col("total") <= budget) | (F.col("_n") == 1)).select("symbol", "group", "rank", "total")


def embedded(symbols: DataFrame, embed, batch: int = 32) -> DataFrame:
    """(id, vector) of (id, text): ``embed`` turns lists of at most ``batch`` texts into vectors, loaded once a task and fed by Arrow batches.

    Null and empty texts get no vector; repeated ids one, of the least text.
    """
    kind = symbols.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            vectors = [v for at in range(0, len(texts), batch) for v in embed(texts[at : at + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["id", "vector"])

    own = symbols.where(F.length("text") > 0).groupBy("id").agg(F.min("text").alias("text"))
    return own.mapInArrow(run, f"id {kind}, vector array<float>")
