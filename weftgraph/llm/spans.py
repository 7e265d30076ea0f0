"""Long exact spans shared between documents: a de Bruijn graph over window-minimum tokens.

Tokens are the stretches between consecutive window minima of a text (``winnow.minima``); an edge is a run of tokens
(a token k-mer). Any stretch of ``min_len`` characters holds a chain of minima that is the same wherever the stretch
stands, and of that chain at least one whole edge. So two texts that share such a stretch share an edge: nothing is
lost, though only about one position in ``W / 2`` is ever shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.batches import map_arrow, spread
from weftgraph.llm.winnow import Rolling, codes, minima_of_all, pair
from weftgraph.session import Cut, small

MIN_LEN, Q, W = 400, 24, 112
#: Characters handled at a time; longer texts go in overlapping pieces of this size.
PIECE = 1 << 20
#: Characters of shorter texts handled together, so that the arrays beside them stay in a core's cache.
GROUP = 1 << 16


def _pieces(texts: list[str], margin_left: int, margin_right: int):
    """(row, offset, first, last, text): stretches of texts; positions first..last of each are its own."""
    for i, t in enumerate(texts):
        if len(t) <= PIECE + margin_right:
            yield i, 0, 0, len(t), t
            continue
        for s in range(0, len(t), PIECE):
            a = max(0, s - margin_left)
            yield i, a, s - a, min(s + PIECE, len(t)) - a, t[a : s + PIECE + margin_right]


def _groups(pieces):
    got, size = [], 0
    for p in pieces:
        if got and size + len(p[4]) > min(PIECE, GROUP):
            yield got
            got, size = [], 0
        got.append(p)
        size += len(p[4])
    if got:
        yield got


def token_edges(docs: DataFrame, min_len: int = MIN_LEN, q: int = Q, w: int = W) -> DataFrame:
    """(doc_id, pos, len, key, row, fwd, bwd) of (doc_id, text): the edges of each text of at least ``min_len`` characters.

    ``key`` identifies the characters of a run of tokens of ``min_len - 3 * w + 3`` characters or more, ``row`` the text.
    ``fwd`` identifies the edge, the next one of the text and the distance between them, ``bwd`` the same of the edge before; 0 if there is none.
    """
    least = min_len - 3 * w + 3
    if least < q:
        raise ValueError("w is too large for min_len")

    def fn(cols):
        ids, texts, numbers = cols
        out = []
        for group in _groups(_pieces(texts, 2 * w, 2 * min_len + 2 * w + q)):
            cp, at = codes([p[4] for p in group])
            if len(cp) < q:
                continue
            roll = Rolling(cp)
            m = minima_of_all(roll.grams(q), at, q, w)
            j = np.searchsorted(m, m + (least - q))
            text = np.searchsorted(at, m, "right") - 1
            use = j < len(m)
            use[use] = text[j[use]] == text[use]
            if not use.any():
                continue
            s, end, text = m[use], m[j[use]] + q, text[use]
            key, link = roll.spans(s, end), np.zeros(len(s) + 1, np.uint64)
            follows = text[1:] == text[:-1]
            link[1:-1][follows] = pair(key[:-1], key[1:], s[1:] - s[:-1])[follows]
            row, off, first, last = (np.array(x, np.int64) for x in list(zip(*group))[:4])
            own = (s >= (at[:-1] + first)[text]) & (s < (at[:-1] + last)[text])
            got = row[text], s + (off - at[:-1])[text], end - s, key.view(np.int64), link[1:].view(np.int64), link[:-1].view(np.int64)
            out.append([x[own] for x in got])
        if not out:
            return None
        row, pos, ln, key, fwd, bwd = (np.concatenate(x) for x in zip(*out))
        import pyarrow as pa

        row = pa.array(row)
        return [pa.array(ids).cast(id_type).take(row), pa.array(pos.astype(np.int32)), pa.array(ln.astype(np.int32)), pa.array(key), pa.array(numbers, pa.int64()).take(row), pa.array(fwd), pa.array(bwd)]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    kind = docs.schema["doc_id"].dataType.simpleString()
    long_enough = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_len))
    numbered = spread(long_enough).select("doc_id", "text", F.monotonically_increasing_id())
    return map_arrow(numbered, fn, f"doc_id {kind}, pos int, len int, key long, row long, fwd long, bwd long")


def _repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one document. Only the least and greatest id are kept of a group of any size."""
    return (
        df.groupBy(key).agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where(F.col("_a") != F.col("_b")).select(key)
    )


def compact(edges: DataFrame) -> DataFrame:
    """(doc_id, row, pos, len, unitig, from_): the edges that two documents share, merged along nonbranching paths; ``from_`` is where the path stands.

    e and f merge if every occurrence of e is followed by f and every occurrence of f is preceded by e, each time at
    the same distance. An occurrence of one edge of a path is then an occurrence of the whole path, so any text that holds
    it shows the path in full: it is labelled by its first edge, and no walk over the graph is needed, however long the
    path. What stands before and behind an edge that two documents share, and merges with it, is shared by these too. There are
    no rings: the last occurrence of an edge of a ring in a text would have no next one.
    """
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    nodes = edges.groupBy("key").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), one("fwd").alias("_on"), one("bwd").alias("_back"))
    nodes = nodes.where(F.col("_a") != F.col("_b")).select("key", "_on", "_back")
    by_text = Window.partitionBy("row").orderBy("pos")
    led = edges.select("doc_id", "row", "pos", "len", "key").join(nodes, "key")
    led = led.withColumn("_head", ~(F.col("_back") & F.coalesce(F.lag("_on").over(by_text), F.lit(False))))
    head = lambda c: F.last(F.when(F.col("_head"), F.col(c)), ignorenulls=True).over(by_text.rowsBetween(Window.unboundedPreceding, 0))
    return led.select("doc_id", "row", "pos", "len", head("key").alias("unitig"), head("pos").alias("from_"))


def _runs(cut: Cut, edges: DataFrame) -> DataFrame:
    """(doc_id, unitig, from_, to_, end_): where the merged paths of all shared edges stand, with the starts of first and last edge.

    Every occurrence of one edge of a path is an occurrence of the whole path, so all runs of a unitig have the same
    length, and stand in two documents at least.
    """
    paths = compact(edges).groupBy("row", "doc_id", "unitig", "from_").agg(F.max("pos").alias("to_"), F.max(F.col("pos") + F.col("len")).alias("end_"))
    return cut(paths.drop("row"))


def _slices(cut: Cut, docs: DataFrame, claims: DataFrame, min_len: int) -> DataFrame:
    """(doc_id, group, slice) of (doc_id, group, at): the ``min_len`` characters of the document at each place."""
    at = cut(claims.groupBy("doc_id").agg(F.collect_set(F.struct("group", "at")).alias("_at")))
    have = docs.select("doc_id", "text").where(F.length("text") >= min_len).join(small(at), "doc_id").select("doc_id", "text", F.explode("_at").alias("_c"))
    return have.select("doc_id", F.col("_c.group").alias("group"), F.substring("text", F.col("_c.at") + 1, F.lit(min_len)).alias("slice")).where(F.length("slice") == min_len)


def same_text(cut: Cut, docs: DataFrame, claims: DataFrame, mine: DataFrame | None, min_len: int) -> DataFrame:
    """doc_id of those of (doc_id, group, at), of the documents ``mine`` or all, whose characters there equal those of another document of the group.

    Claims come from hashes; here the characters themselves are compared. Each document asks with one claim, against the
    least and greatest document of its group, so a group of any size is never gathered. Documents that this leaves open
    (unequal texts of equal hash) are compared within all their groups, text by text.
    """
    place = F.struct("doc_id", "at")
    groups = claims.groupBy("group").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where(F.col("lo.doc_id") != F.col("hi.doc_id"))
    asking = claims if mine is None else claims.join(mine, "doc_id", "left_semi")
    ask = cut(asking.join(groups, "group").groupBy("doc_id").agg(F.min(F.struct("group", "at", "lo", "hi")).alias("c")).select("doc_id", "c.group", "c.at", "c.lo", "c.hi"))
    both = ask.select("group", F.explode(F.array(place, "lo", "hi")).alias("p")).select("p.doc_id", "group", "p.at").distinct()
    read = cut(_slices(cut, docs, both, min_len))
    lent = read.join(ask.select("group", F.explode(F.array("lo.doc_id", "hi.doc_id")).alias("doc_id")).distinct(), ["group", "doc_id"], "left_semi")
    lent = lent.select("group", F.col("doc_id").alias("_other"), F.col("slice").alias("_slice"))
    equal = read.join(lent, "group").where((F.col("slice") == F.col("_slice")) & (F.col("doc_id") != F.col("_other")))
    found = cut(equal.select(F.explode(F.array("doc_id", "_other")).alias("doc_id")).distinct())
    open_ = ask.join(found, "doc_id", "left_anti")
    if open_.isEmpty():
        return found
    again = asking.join(open_.select("doc_id"), "doc_id", "left_semi").select("group").distinct()
    rest = cut(_slices(cut, docs, claims.join(again, "group", "left_semi").distinct(), min_len))
    twice = rest.groupBy("group", "slice").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where(F.col("_a") != F.col("_b")).select("group", "slice")
    return found.unionByName(rest.join(twice, ["group", "slice"], "left_semi").select("doc_id")).distinct()


def _windows(cut: Cut, docs: DataFrame, places: DataFrame, min_len: int) -> DataFrame:
    """(doc_id, pos, hash) of every stretch of ``min_len`` characters that begins at one of ``places`` (doc_id, lo, hi)."""
    starts = cut(places.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("at")))
    have = docs.select("doc_id", "text").join(small(starts), "doc_id")

    def fn(cols):
        ids, texts, ats = cols
        import pyarrow as pa

        rows, pos, hashes = [], [], []
        for i, (t, at) in enumerate(zip(texts, ats)):
            n = len(t) - min_len + 1
            mark = np.zeros(n + 1, np.int64)
            for a in at:
                lo, hi = max(0, a["lo"]), min(n, a["hi"] + 1)
                if lo < hi:
                    mark[lo] += 1
                    mark[hi] -= 1
            s = np.flatnonzero(np.cumsum(mark[:n]) > 0)
            # the prefix sums of a long text are made piece by piece
            for p in range(0, n, PIECE):
                own = s[(s >= p) & (s < p + PIECE)]
                if len(own):
                    cp, _ = codes([t[p : p + PIECE + min_len]])
                    hashes.append(Rolling(cp).spans(own - p, own - p + min_len).view(np.int64))
                    pos.append(own)
                    rows.append(np.full(len(own), i))
        if not rows:
            return None
        return [pa.array(ids).cast(id_type).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(hashes))]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return map_arrow(have, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, hash long")


def _round(runs: DataFrame, w: int) -> DataFrame:
    """Places of all stretches whose first edge is one of a run's: they begin less than ``w`` characters before it at the earliest."""
    return runs.select("doc_id", (F.col("from_") - (w - 1)).alias("lo"), F.col("to_").alias("hi"))


def shared_documents(docs: DataFrame, min_len: int = MIN_LEN, w: int = W) -> DataFrame:
    """doc_id of every document that has ``min_len`` consecutive characters in common with another doc_id.

    1. Edges that stand in two documents are compacted along nonbranching paths (``compact``).
    2. A path of ``min_len`` characters or more is a long repeated span; the characters at its source coordinates settle
       its documents (``same_text``).
    3. Where two texts begin to differ, a path ends: a longer stretch that runs over several short paths begins or ends
       near an end of one. The stretches of ``min_len`` characters that begin at a path's start, or end at its end, are compared
       for the documents still open and whoever holds the same paths.
    4. What is left can share a stretch that is hardly longer than ``min_len``: every one that begins at a path of an
       open document is compared.

    Groups are kept as (least, greatest id) while they are counted, so an edge that a third of all documents hold is
    never gathered; work in steps 3 and 4 is in proportion to paths and characters, not to pairs. Hashes propose, characters decide.

    Null and empty texts, texts shorter than ``min_len`` and null ids share nothing. Repeated rows of one doc_id are
    the same document. The ids' type is kept; other columns are ignored.
    """
    cut = Cut(docs.sparkSession, "spans")
    runs = _runs(cut, cut(token_edges(docs, min_len, w=w)))
    long_ = runs.where(F.col("end_") - F.col("from_") >= min_len)
    settled = same_text(cut, docs, long_.select("doc_id", F.col("unitig").alias("group"), F.col("from_").alias("at")), None, min_len)
    ends = lambda r: r.select("doc_id", F.explode(F.array("from_", F.col("end_") - min_len)).alias("lo")).where("lo >= 0").distinct().withColumn("hi", F.col("lo"))
    for places in (ends, lambda r: _round(r, w)):
        open_ = cut(runs.select("doc_id", "unitig").distinct().join(settled, "doc_id", "left_anti"))
        if open_.isEmpty():
            break
        win = cut(_windows(cut, docs, places(runs.join(open_.select("unitig").distinct(), "unitig", "left_semi")), min_len))
        late = same_text(cut, docs, win.select("doc_id", F.col("hash").alias("group"), F.col("pos").alias("at")), open_.select("doc_id").distinct(), min_len)
        settled = cut(settled.unionByName(late).distinct())
    return settled


def shared_coverage(docs: DataFrame, min_len: int = MIN_LEN, w: int = W) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_spans, share): how much of each document stands, in stretches of ``min_len`` or more, elsewhere.

    The compacted paths of ``min_len`` characters or more cover the inner part of shared stretches. What runs beyond a
    path's ends, or over several short ones, is told by the stretches of ``min_len`` characters that begin there; where
    these are follows from the path alone, so all documents that hold it compare the same ones. Documents that share nothing have 0;
    a null text has n_chars 0 and share 0. Spans are told apart by 64-bit hashes of their characters.
    """
    cut = Cut(docs.sparkSession, "coverage")
    runs = _runs(cut, cut(token_edges(docs, min_len, w=w)))
    size = F.col("end_") - F.col("from_")
    long_ = runs.where(size >= min_len)
    inner = long_.select("doc_id", F.col("from_").alias("pos"), size.alias("len"))
    before = long_.select("doc_id", (F.col("from_") - (w - 1)).alias("lo"), (F.col("from_") - 1).alias("hi"))
    beyond = long_.select("doc_id", (F.col("end_") - (min_len - 1)).alias("lo"), F.col("to_").alias("hi"))
    places = _round(runs.where(size < min_len), w).unionByName(before).unionByName(beyond)
    win = cut(_windows(cut, docs, places, min_len))
    outer = win.join(_repeated(win, "hash"), "hash", "left_semi").select("doc_id", "pos", F.lit(min_len).alias("len"))
    spans = inner.unionByName(outer).select("doc_id", F.col("pos").cast("long").alias("a"), (F.col("pos") + F.col("len")).cast("long").alias("b"))
    over = Window.partitionBy("doc_id").orderBy("a", "b")
    far = F.max("b").over(over.rowsBetween(Window.unboundedPreceding, -1))
    union = (
        spans.withColumn("_far", F.coalesce(far, F.lit(-1)))
        .groupBy("doc_id")
        .agg(
            F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "_far"))).alias("shared_chars"),
            F.sum((F.col("a") > F.col("_far")).cast("long")).alias("n_spans"),
        )
    )
    sizes = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(union, "doc_id", "left").select(
        "doc_id", "n_chars", n("shared_chars"), n("n_spans"),
        F.round(F.coalesce(F.col("shared_chars"), F.lit(0)) / F.greatest("n_chars", F.lit(1)), 6).alias("share"),
    )


def unitigs(docs: DataFrame, min_len: int = MIN_LEN, w: int = W) -> DataFrame:
    """(unitig, span_chars, n_docs): the merged paths of all edges that two documents share, spanning ``min_len`` or more."""
    cut = Cut(docs.sparkSession, "unitigs")
    runs = _runs(cut, cut(token_edges(docs, min_len, w=w)))
    span = (F.col("end_") - F.col("from_")).cast("long")
    return (
        runs.where(span >= min_len)
        .groupBy("unitig", "doc_id").agg(F.max(span).alias("span_chars"))
        .groupBy("unitig").agg(F.max("span_chars").alias("span_chars"), F.count(F.lit(1)).alias("n_docs"))
    )
