"""Mixing sources to target weights: token counts, min-cost flow over membership patterns, seeded selection."""

from __future__ import annotations

import base64
import heapq
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.llm.batches import spread
from weftgraph.session import Cut, small

#: A public byte-level BPE vocabulary as base64 ranks; any file of that form will do.
VOCABULARY = os.environ.get("WEFT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED, FINE = 17, 4096


def token_count(text, vocabulary: str = VOCABULARY):
    """Column: number of tokens of a text (0 for null), special tokens' names taken as ordinary text.

    The vocabulary (about 1 MB) travels with the function, so executors need no file.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    made: list = []

    @pandas_udf("long")
    def count(texts):
        import tiktoken

        if not made:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            made.append(tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        encode = made[0].encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a greatest flow of least cost; costs are not negative.

    Successive shortest paths with potentials. The graph has a node for each pattern and each source, never a document.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
    lift = [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e]:
                    nd = d + cost[e] + lift[x] - lift[to[e]]
                    if dist[to[e]] is None or nd < dist[to[e]]:
                        dist[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        most = max(d for d in dist if d is not None)
        lift = [p + (most if d is None else d) for p, d in zip(lift, dist)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def _routes(patterns: list[tuple[str, str, int]], targets: list[tuple[str, float, int]], total: int, text_repeat: int | None = None) -> dict[tuple[str, str], int]:
    """Tokens that each source takes from each membership pattern: {(pattern, source): tokens}.

    ``patterns`` holds (pattern, source, tokens that one use of the source's documents of this pattern has).
    The first use of a pattern's tokens, and of a source's part of them, costs nothing, each further use one more than the last (convex), so
    tokens are repeated as little as the quotas allow, and a text that several sources hold is first shared out.
    With ``text_repeat`` a pattern gives at most so many uses of its tokens to all its sources together, so sources that
    hold the same texts compete; without it each source may use its own documents as often as its target allows.
    """
    repeat = {s: max(0, int(m or 0)) for s, _, m in targets}
    names = sorted({p for p, _, _ in patterns})
    node = {p: 2 + i for i, p in enumerate(names)}
    end = {s: 2 + len(names) + i for i, (s, _, _) in enumerate(targets)}
    arcs, keys = [], []
    for p in names:
        own = [(s, t) for q, s, t in patterns if q == p and s in repeat]
        once = max((t for _, t in own), default=0)
        most = sum(t * repeat[s] for s, t in own)
        if text_repeat is not None:
            most = min(most, once * text_repeat)
        layer = 0
        while most > 0 and once > 0:
            arcs.append((0, node[p], min(once, most), layer))
            most -= once
            layer += 1
        for s, t in own:
            for use in range(repeat[s]):
                keys.append((len(arcs), p, s))
                arcs.append((node[p], end[s], t, use))
    for s, w, _ in targets:
        arcs.append((end[s], 1, quota(w, total), 0))
    flow = min_cost_flow(2 + len(names) + len(targets), arcs, 0, 1)
    out: dict[tuple[str, str], int] = {}
    for i, p, s in keys:
        out[p, s] = out.get((p, s), 0) + flow[i]
    return out


def quota(weight: float | None, total: int) -> int:
    """Tokens a source must give: the least whole number that is not below weight * total."""
    q = (weight or 0.0) * total
    return int(-(-q // 1))


class Mix:
    """A plan: ``report`` (one row a target source), ``documents`` (uses of each document).

    Sources are compared in lower case without blanks at either end; targets keep their spelling. Documents of no
    target source and null texts count in the total and are never used. A text that stands under several sources is one
    text with a membership pattern (the set of its sources); repeated rows count each time. The total size of the mix
    is the number of tokens of all documents. Empty documents give quota 0 for every source. ``text_repeat`` bounds the uses of
    a text over all its sources (none by default).
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, text_repeat: int | None = None):
        self.cut, self.seed, self.text_repeat = Cut(docs.sparkSession, "mix"), seed, text_repeat
        norm = lambda c: F.lower(F.trim(c))
        #: the targets are a table of parameters, one row a source
        self.targets = [(r["source"], r["weight"], r["max_repeat"]) for r in targets.select("source", "weight", "max_repeat").where(F.col("source").isNotNull()).orderBy("source").collect()]
        self.spelt = {t[0].strip().lower(): t[0] for t in self.targets}
        sized = spread(docs.select("doc_id", "source", "text")).select("doc_id", norm(F.col("source")).alias("source"), F.md5("text").alias("_text"), token_count(F.col("text"), vocabulary).alias("tokens"))
        self.sized = self.cut(sized)

    def _patterned(self) -> DataFrame:
        """Rows of target sources with the pattern of their text."""
        own = self.sized.where(F.col("source").isin(list(self.spelt))) if self.spelt else self.sized.where("false")
        where = own.select("_text", "source").distinct().groupBy("_text").agg(F.array_join(F.array_sort(F.collect_set("source")), "\n").alias("pattern"))
        # most texts stand under one source: only the others are joined
        several = where.where(F.col("pattern").contains("\n"))
        return own.join(small(self.cut(several)), "_text", "left").withColumn("pattern", F.coalesce("pattern", "source"))

    def report(self) -> DataFrame:
        """source, weight, max_repeat, tokens, quota, routed, share, passes, reachable: the plan of the flow, before documents are chosen."""
        spark = self.sized.sparkSession
        rows = self.cut(self._patterned())
        self.rows = rows
        total = self.sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        #: at most one row for each pattern and source: sets of targets that occur
        sums = [(p, self.spelt[s], int(t)) for p, s, t in rows.groupBy("pattern", "source").agg(F.sum("tokens")).collect()]
        self.sums = sums
        self.flow = _routes(sums, self.targets, total, self.text_repeat)
        out, mixed = [], sum(self.flow.values())
        for s, w, m in self.targets:
            have = sum(t for _, q, t in sums if q == s)
            routed = sum(v for (_, q), v in self.flow.items() if q == s)
            out.append((s, w, m, have, quota(w, total), routed, routed / mixed if mixed else 0.0, routed / have if have else 0.0, routed >= quota(w, total)))
        return spark.createDataFrame(out, "source string, weight double, max_repeat int, tokens long, quota long, routed long, share double, passes double, reachable boolean")

    def reached(self) -> DataFrame:
        """The report with what the chosen documents have: ``reached`` tokens, their ``share`` of the mix and ``passes`` over the source."""
        plan = self.report()
        sizes = self.rows.groupBy("doc_id", "source").agg(F.max("tokens").alias("_t"))
        used = self.documents().groupBy("doc_id", "source").agg(F.sum("uses").alias("_u")).join(sizes, ["doc_id", "source"])
        sums = used.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("_u") * F.col("_t")).alias("reached"))
        # one row a target source
        out = plan.drop("share", "passes").join(F.broadcast(sums), F.lower(F.trim("source")) == F.col("_s"), "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
        total = out.agg(F.sum("reached").alias("_all"))
        part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        return out.join(F.broadcast(total)).select(*[c for c in plan.columns if c not in ("share", "passes", "reachable")], "reached", part("reached", "_all").alias("share"), part("reached", "tokens").alias("passes"), "reachable")

    def documents(self) -> DataFrame:
        """(doc_id, source, uses): how often the mix uses each document; whole documents only.

        A source takes whole passes over a pattern's documents, and of the last pass the documents of least seeded hash
        until the rest is reached (the document that passes it is still taken). The cut is found in two rounds of
        hash buckets, summed by Spark, so no source is sorted in one task.
        """
        if not hasattr(self, "flow"):
            self.report()
        spark = self.sized.sparkSession
        per = {(p, s): t for p, s, t in self.sums}
        plan = [(p, s.strip().lower(), v // per[p, s], v % per[p, s]) for (p, s), v in self.flow.items() if per[p, s]]
        routes = F.broadcast(spark.createDataFrame(plan, "pattern string, source string, passes long, rest long"))
        h = F.xxhash64(F.col("doc_id"), F.lit(self.seed))
        rows = self.rows.join(routes, ["pattern", "source"]).withColumn("_h", h).withColumn("_a", F.pmod(h, F.lit(FINE))).withColumn("_c", F.pmod(F.shiftright(h, 12), F.lit(FINE)))
        part = ["pattern", "source"]

        def before(df, keys, order):
            """Tokens of the buckets before each one."""
            sums = df.groupBy(*keys, order).agg(F.sum("tokens").alias("_t"))
            w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            return sums.select(*keys, order, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias(f"{order}_before"), F.col("_t").alias(f"{order}_own"))

        rows = rows.join(small(self.cut(before(rows, part, "_a"))), [*part, "_a"])
        whole = F.col("_a_before") + F.col("_a_own") <= F.col("rest")
        edge = rows.where(~whole & (F.col("_a_before") < F.col("rest")))
        edge = edge.join(before(edge, [*part, "_a"], "_c"), [*part, "_a", "_c"]).withColumn("_b", F.col("_a_before") + F.col("_c_before"))
        w = Window.partitionBy(*part, "_a", "_c").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        fine = edge.withColumn("_b", F.col("_b") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
        uses = lambda df, more: df.select("doc_id", "source", (F.col("passes") + more.cast("long")).alias("uses"))
        out = uses(rows.where(whole | (F.col("_a_before") >= F.col("rest"))), whole & (F.col("rest") > 0)).unionByName(uses(fine, F.col("_b") < F.col("rest")))
        return out.where(F.col("uses") > 0)
