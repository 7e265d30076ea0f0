import random

import numpy as np

from weftgraph.llm import spans
from weftgraph.llm.winnow import Rolling, codes, minima
from weftgraph.session import Cut

DOC = "doc_id long, text string, key string, pos int"


def text(rng, n):
    return "".join(rng.choice("abcdefghij klmnop\n") for _ in range(n))


def brute(rows, length):
    where = {}
    for i, t in rows:
        for x in range(len(t or "") - length + 1) if t else ():
            where.setdefault(t[x : x + length], set()).add(i)
    found, cover = set(), {}
    for i, t in rows:
        marked = set()
        for x in range(len(t or "") - length + 1) if t else ():
            if len(where[t[x : x + length]]) > 1:
                marked.update(range(x, x + length))
        cover[i] = max(cover.get(i, 0), len(marked))
        if marked:
            found.add(i)
    return found, cover


def test_minima_agree_inside_a_common_stretch():
    rng = random.Random(1)
    core = text(rng, 900)
    a, b = text(rng, 321) + core + text(rng, 50), text(rng, 17) + core + text(rng, 400)
    q, w = 24, 112
    sets = []
    for t, at in ((a, 321), (b, 17)):
        cp, _ = codes([t])
        m = minima(Rolling(cp).grams(q), 0, len(t), q, w) - at
        sets.append({x for x in m.tolist() if w <= x <= 900 - q - w})
    assert sets[0] == sets[1] and sets[0]


def test_rolling_spans_depend_on_content_alone():
    cp, at = codes(["xxhello worldyy", "hello world"])
    r = Rolling(cp)
    assert r.spans(np.array([2]), np.array([13]))[0] == r.spans(at[1:2], at[2:3])[0]


def test_found_and_coverage_equal_brute_force(spark):
    rng = random.Random(2)
    base = [text(rng, 1500) for _ in range(4)]
    rows = []
    for i in range(40):
        t = text(rng, rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            b = rng.choice(base)
            s = rng.randrange(len(b) - 700)
            t += b[s : s + rng.choice([150, 390, 399, 400, 401, 415, 650])] + text(rng, 60)
        rows.append((i, t))
    rows += [(100, base[0]), (101, base[0]), (102, None), (103, ""), (104, "y" * 1000), (105, "z" + "y" * 450), (106, "ab" * 600), (107, "Zürich — " * 80), (108, "x" + "Zürich — " * 70), (None, base[0]), (109, base[0][:399]), (101, base[0])]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOC)
    known = [(i, t) for i, t in rows if i is not None]
    found, cover = brute(known, 400)
    assert {r[0] for r in spans.shared_documents(df).collect()} == found
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_coverage(df).collect()}
    assert got == cover


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(spans, "PIECE", 2000)
    shared = text(rng, 420)
    rows = [(1, text(rng, 5790) + shared + text(rng, 3000)), (2, text(rng, 100) + shared), (3, text(rng, 9000))]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOC)
    assert sorted(r[0] for r in spans.shared_documents(df).collect()) == [1, 2]


def test_empty_and_string_ids(spark):
    assert spans.shared_documents(spark.createDataFrame([], DOC)).count() == 0
    assert spans.shared_coverage(spark.createDataFrame([], DOC)).count() == 0
    t = text(random.Random(4), 500)
    df = spark.createDataFrame([("a", t), ("b", t), ("c", t[:200])], "doc_id string, text string")
    assert {r[0] for r in spans.shared_documents(df).collect()} == {"a", "b"}


def test_unitigs_merge_what_is_shared_alike(spark):
    t = text(random.Random(6), 3000)
    df = spark.createDataFrame([(1, t), (2, t), (3, t[500:1500])], "doc_id long, text string")
    got = [(r["span_chars"], r["n_docs"]) for r in spans.unitigs(df).collect()]
    assert any(n == 3 and s > 600 for s, n in got) and any(n == 2 and s > 1000 for s, n in got)


def test_tables_written_do_not_grow_with_a_path(spark):
    written = []
    for n in (600, 40_000):
        t = text(random.Random(7), n)
        cut = Cut(spark, "runs")
        edges = cut(spans.token_edges(spark.createDataFrame([(1, t), (2, "x" + t), (3, t[:300])], "doc_id long, text string")))
        runs = spans._runs(cut, edges).orderBy("doc_id").collect()
        assert [r["doc_id"] for r in runs] == [1, 2] and runs[0]["unitig"] == runs[1]["unitig"] and runs[0]["end_"] - runs[0]["from_"] > n - 400
        written.append(cut.n)
    assert written == [2, 2]


def test_paths_end_where_texts_differ(spark):
    rng = random.Random(8)
    a, b = text(rng, 700), text(rng, 700)
    rows = [(1, a + "x" + b), (2, a + "y" + b), (3, "z" + a[:450]), (3, b[-420:] + "z"), (3, b[-420:] + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, cover = brute(rows[:3], 400)
    got = {r["doc_id"]: (r["shared_chars"], r["n_spans"]) for r in spans.shared_coverage(df.where("doc_id < 3")).collect()}
    assert got == {1: (1400, 2), 2: (1400, 2)} and found == {1, 2, 3}
    assert {r[0] for r in spans.shared_documents(df).collect()} == {1, 2, 3}


def test_edges_and_links_do_not_depend_on_pieces(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, text(rng, n)) for i, n in enumerate((9000, 500, 12_345, 450))], "doc_id long, text string")
    pick = lambda: sorted(map(tuple, spans.token_edges(df).select("doc_id", "pos", "len", "key", "fwd", "bwd").collect()))
    whole = pick()
    monkeypatch.setattr(spans, "PIECE", 2000)
    assert pick() == whole and [r[4] for r in whole if r[4]] == [r[5] for r in whole if r[5]]
