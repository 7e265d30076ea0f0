import random

import numpy as np

from weftgraph.llm.leaks import align, leaks, shown, words

DOC, ITEM = "doc_id long, text string, item_id string, run int", "item_id long, text string, task string, doc_id int"


def test_shown():
    assert words(shown("[[A b|c ''d'']]e <!-- x [[y]] -->''f''<ref name=\"z\">note</ref>&nbsp;g&amp;h [http://u.invalid/x label] <br>i")) == ["c", "de", "f", "g", "h", "label", "i"]
    assert words(shown("a<ref x/>b <ref>c</ref\n\nd &#233;")) == ["ab", "d", "é"]
    assert shown("plain") == "plain" and words("It's_A 3x") == ["it", "s", "a", "3x"]


def naive(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    run = np.zeros_like(h)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            eq = a[i - 1] == b[j - 1] and a[i - 1] != 0
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if eq else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            run[i, j] = run[i - 1, j - 1] + 1 if eq else 0
    return int(h.max()), int(run.max())


def test_alignment_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 25))])
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 40))])
        assert align(a, b)[:2] == naive(a, b)


def brute(items, docs, n=15):
    out = set()
    for i, x in items:
        w = words(shown(x or ""))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            v = words(shown(t or ""))
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((i, d))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    stock = " choose the option that best completes the text"
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 14, 15, 16, 40]))) + (stock if i % 2 else "")) for i in range(30)]
    items += [(90, None), (91, ""), (92, items[4][1]), (None, items[5][1]), (3, items[3][1])]
    docs = []
    for d in range(1000, 1060):
        w = rng.choices(vocab, k=rng.randrange(0, 150))
        if d % 2:
            x = words(rng.choice(items[:30])[1])
            k = rng.choice([10, 14, 15, 20, 60])
            s = rng.randrange(max(1, len(x) - k))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [f"'''{y}'''" if rng.random() < 0.2 else f"[[{y.upper()}]]" if rng.random() < 0.2 else y for y in x[s : s + k]]
        docs.append((d, " ".join(w) + (stock if d % 3 == 0 else "")))
    docs += [(2000, None), (2001, ""), (None, items[4][1]), (1001, docs[1][1]), (2002, "x " * 30000 + items[4][1])]
    got = leaks(spark.createDataFrame([(d, t, "z", 1) for d, t in docs], DOC), spark.createDataFrame([(i, x, "t", 1) for i, x in items], ITEM))
    found = {(r["item_id"], r["doc_id"]) for r in got.where("run >= 15").collect()}
    assert found == brute([(i, x) for i, x in items if i is not None], [(d, t) for d, t in docs if d is not None])
    blocks = leaks(spark.createDataFrame([(d, t, "z", 1) for d, t in docs], DOC), spark.createDataFrame([(i, x, "t", 1) for i, x in items], ITEM), block=7)
    assert {(r["item_id"], r["doc_id"]) for r in blocks.where("run >= 15").collect()} == found


def test_edited_copy_is_aligned_and_tables_may_be_empty(spark):
    x = " ".join(f"u{i}" for i in range(40))
    edited = " ".join(f"u{i}" if i % 7 else "other" for i in range(40))
    items = spark.createDataFrame([(1, x)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "before " + edited + " after"), (6, "nothing of it")], "doc_id long, text string")
    (row,) = leaks(docs, items).collect()
    assert (row["item_id"], row["doc_id"], row["run"]) == (1, 5, 6) and row["identity"] > 0.7
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_rows_do_not_depend_on_the_blocks(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(90)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(24)]
    items += [(30 + i, " ".join(words(items[i][1])[:20] + rng.choices(vocab, k=10))) for i in range(6)]
    docs = []
    for d in range(100, 160):
        x = words(rng.choice(items)[1])
        docs.append((d, " ".join(rng.choices(vocab, k=20) + [w for w in x if rng.random() < 0.85] + rng.choices(vocab, k=20))))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda block: sorted(tuple(r) for r in leaks(df, it, block=block).collect())
    one = rows(1000)
    assert len(one) > 40 and rows(7) == one
