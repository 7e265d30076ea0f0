"""Evaluation texts inside a training corpus: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import map_arrow, spread
from weftgraph.session import Cut, small

#: Words of a seed, of a run that counts as a leak, kept on either side of seeds, and items that one pass over the corpus takes.
N, RUN, CONTEXT, BLOCK = 5, 15, 48, 20_000
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOTE = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>?", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BREAK = re.compile(r"<(?:br|hr|p|/p|li|/li|div|/div)\b[^<>]*>", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTER = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]*\s*([^\]]*)\]|\[(?:https?|ftp|mailto):[^\s\]]*\s*([^\]]*)\]", re.I)
_QUOTES = re.compile(r"'{2,5}")
_UNSEEN = re.compile("[­​-‏⁠﻿]")


def shown(text: str) -> str:
    """Wiki markup as a reader sees it, as far as words go.

    Comments and notes show nothing (a note whose end tag lacks its bracket ends there all the same), links show
    their label, tags and the quote marks of bold and italic vanish, entities are decoded once, invisible characters
    vanish. Templates and tables stay as they are written.
    """
    if "<" in text:
        text = _COMMENT.sub("", text)
        text = _NOTE.sub("", text)
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "[" in text:
        before = None
        while before != text and "[[" in text:
            before, text = text, _LINK.sub(r"\1", text)
        text = _OUTER.sub(lambda m: m[1] or m[2] or "", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _UNSEEN.sub("", text)


def words(text: str) -> list[str]:
    """Runs of letters or digits, without case."""
    return _WORD.findall(text.lower())


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n ids from each place; 0 where one of them is 0 (no word of any item)."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    x = np.zeros(len(ids) - n + 1, np.uint64)
    bad = np.zeros(len(x), bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = ids[i : len(ids) - n + 1 + i]
            x = (x ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            bad |= part == 0
    x[bad] = 0
    return x.view(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two word-id arrays: best score, longest run of equal words, end of the best alignment in ``b``.

    A row of the table at a time; the gap along the row is a running maximum, so no cell is visited by Python.
    """
    m = len(b)
    prev = np.zeros(m + 1, np.int64)
    run = np.zeros(m + 1, np.int64)
    ramp = np.arange(m + 1) * -GAP
    best = longest = end = 0
    for w in a:
        eq = b == w if w else np.zeros(m, bool)
        cur = np.empty(m + 1, np.int64)
        cur[0] = 0
        np.maximum(prev[:-1] + np.where(eq, MATCH, MISMATCH), 0, out=cur[1:])
        np.maximum(cur[1:], prev[1:] + GAP, out=cur[1:])
        cur = np.maximum.accumulate(cur + ramp) - ramp
        top = int(cur.argmax())
        if cur[top] > best:
            best, end = int(cur[top]), top
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.where(eq, run[:-1] + 1, 0)
        longest = max(longest, int(new.max()))
        prev, run = cur, new
    return best, longest, end


def word_id(word: str) -> int:
    """A word's id: 63 bits of its hash, never 0; the same whatever other words there are."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) | 1


def _items(rows: list[tuple], n: int):
    """Vocabulary, word ids of each item, and its n-grams: [(item, ids, grams)]."""
    vocab: dict[str, int] = {}
    items = []
    for item, text in rows:
        found = words(shown(text or ""))
        vocab.update((w, word_id(w)) for w in found if w not in vocab)
        ids = np.array([vocab[w] for w in found], np.int64)
        if len(ids) >= n:
            items.append((item, ids, _grams(ids, n)))
    return vocab, items


def _sole(items: DataFrame, n: int) -> DataFrame:
    """(gram, item_id): the n-grams that one item alone holds, of all items whatever block they are taken in."""

    def fn(cols):
        got = [(i, np.unique(_grams(np.array([word_id(w) for w in words(shown(t))], np.int64), n))) for i, t in zip(*cols)]
        got = [(i, g) for i, g in got if len(g)]
        if not got:
            return None
        return [pa.array([i for i, g in got for _ in range(len(g))]), pa.array(np.concatenate([g for _, g in got]))]

    each = map_arrow(items.select("item_id", "text"), fn, f"item_id {items.schema['item_id'].dataType.simpleString()}, gram long")
    return each.groupBy("gram").agg(F.min("item_id").alias("item_id"), F.max("item_id").alias("_b")).where(F.col("item_id") == F.col("_b")).select("gram", "item_id")


def _hits(docs: DataFrame, vocab: dict[str, int], known: np.ndarray, n: int) -> DataFrame:
    """(doc_id, start, ids, grams): stretches of documents round places where an n-gram of any item stands.

    Places at most ``CONTEXT`` words apart share one stretch, which has ``CONTEXT`` more words on either side.
    """

    def fn(cols):
        doc_ids, texts = cols
        get = vocab.get
        rows, starts, outs, grams = [], [], [], []
        for i, t in enumerate(texts):
            found = words(shown(t))
            if len(found) < n:
                continue
            ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
            g = _grams(ids, n)
            at = np.searchsorted(known, g)
            at[at == len(known)] = 0
            places = np.flatnonzero((known[at] == g) & (g != 0))
            if not len(places):
                continue
            for part in np.split(places, np.flatnonzero(np.diff(places) > CONTEXT) + 1):
                a, b = max(0, int(part[0]) - CONTEXT), min(len(ids), int(part[-1]) + n + CONTEXT)
                rows.append(i)
                starts.append(a)
                outs.append(ids[a:b])
                grams.append(np.unique(g[part]))
        if not rows:
            return None
        return [pa.array(doc_ids).cast(id_type).take(pa.array(rows)), starts, [x.tolist() for x in outs], [x.tolist() for x in grams]]

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    have = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_arrow(spread(have), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, ids array<long>, grams array<long>")


def _seeds(items: list, counts: dict[int, int], sole: set, run: int, n: int) -> list[tuple]:
    """(gram, item): for each run of ``run`` words of an item its rarest n-gram, and the n-grams that no other item has (``sole``).

    A stretch of ``run`` words in a document brings all n-grams of the run with it, the rarest among them: no such
    stretch is missed, stock instructions that many items share included. Runs with an n-gram that the corpus never has
    need no seed. N-grams of one item alone find edited copies too.
    """
    out = set()
    for item, ids, g in items:
        g = g.tolist()
        span = max(1, min(run, len(ids)) - n + 1)
        for i in range(len(g) - span + 1):
            least = min(g[i : i + span], key=lambda x: (counts.get(x, 0), x))
            if counts.get(least, 0):
                out.add((least, item))
        out.update((x, item) for x in g if x in sole and counts.get(x, 0))
    return sorted(out)


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, n: int = N, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, run, score, identity, at): alignments of items with the passages of documents that share a seed.

    ``run`` is the longest run of the item's words that stands in the document in the same order with nothing in
    between, ``score`` the Smith-Waterman score over words (match 2, others -1), ``identity`` the score over that of a
    perfect copy of the item, ``at`` the word of the document at which the best alignment ends. One row a pair.

    The items are the stated query set: they are taken in blocks of ``block`` against all documents, so vocabulary and
    n-grams on the driver have that bound whatever their number; words, n-grams and what makes one rare or sole do not
    depend on the block, so the rows are the same for any ``block``. Documents are read once a block; only stretches
    round n-grams of items leave that pass, and pairs arise from seeds alone.

    Null and empty texts of either side give no rows, nor do items of fewer than ``n`` words. Repeated rows of an id
    give one row. An item shorter than ``run`` words aligns from its rarest n-gram.
    """
    spark = docs.sparkSession
    cut = Cut(spark, "leaks")
    clean = items.select("item_id", "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    item_type, doc_type = (d.schema[c].dataType.simpleString() for d, c in ((items, "item_id"), (docs, "doc_id")))
    schema = f"item_id {item_type}, doc_id {doc_type}, run int, score int, identity double, at int"
    blocks = -(-clean.count() // block)
    if not blocks:
        return spark.createDataFrame([], schema)
    sole = cut(_sole(clean, n))
    if blocks > 1:
        clean = cut(clean.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    out = None
    for b in range(blocks):
        part = clean.where(F.col("_b") == b).drop("_b") if blocks > 1 else clean
        rows = [tuple(r) for r in part.select("item_id", "text").toLocalIterator()]
        own = {r[0] for r in sole.join(part.select("item_id").distinct(), "item_id", "left_semi").select("gram").toLocalIterator()}
        got = _block(cut, docs, rows, own, run, n, schema, item_type)
        out = got if out is None else out.unionByName(got)
    return out


def _block(cut, docs, rows, sole, run, n, schema, item_type):
    spark = docs.sparkSession
    vocab, items = _items(rows, n)
    if not items:
        return spark.createDataFrame([], schema)
    known = np.unique(np.concatenate([g for _, _, g in items]))
    hits = cut(_hits(docs, vocab, known, n))
    each = hits.select(F.explode("grams").alias("gram"))
    # at most one row for each n-gram of the block's items
    counts = {r[0]: r[1] for r in each.groupBy("gram").count().toLocalIterator()}
    seeds = spark.createDataFrame([(int(g), i) for g, i in _seeds(items, counts, sole, run, n)], f"gram long, item_id {item_type}")
    texts = spark.createDataFrame([(i, k, x.tolist()) for k, (i, x, _) in enumerate(items)], f"item_id {item_type}, _k int, item_ids array<long>")
    pairs = (
        hits.select("doc_id", "start", F.explode("grams").alias("gram"))
        .join(small(cut(seeds)), "gram")
        .select("doc_id", "start", "item_id")
        .distinct()
        .join(small(cut(texts)), "item_id")
        .join(hits.select("doc_id", "start", "ids").dropDuplicates(["doc_id", "start", "ids"]), ["doc_id", "start"])
        .select("item_id", "doc_id", "start", "item_ids", "ids")
    )

    def fn(cols):
        item_ids, doc_ids, starts, a, b = cols
        got = [align(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(a, b)]
        return [item_ids, doc_ids, [r for _, r, _ in got], [s for s, _, _ in got], [s / (MATCH * len(x)) for (s, _, _), x in zip(got, a)], [p + e for p, (_, _, e) in zip(starts, got)]]

    rows_ = map_arrow(pairs, fn, schema)
    best = F.max_by(F.struct("score", "identity", "at"), F.struct(F.col("score"), -F.col("at"))).alias("b")
    return rows_.groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), best).select("item_id", "doc_id", "run", "b.score", "b.identity", "b.at")
