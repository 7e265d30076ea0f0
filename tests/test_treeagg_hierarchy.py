import random
from collections import defaultdict

from weftgraph.operators.hierarchy import all_descendants, descendants, hierarchy, tree_links
from weftgraph.operators.treeagg import heavy_keys, tree_aggregate

EDGE = "s string, t string, k string, _ta_m string, n_rows int"


def test_tree_aggregate_counts_nulls_repeats_and_clashing_columns(spark):
    rows = [("a", "x", "i", "z", 1)] * 3 + [("b", "x", "i", "z", 1), (None, "x", "i", "z", 2), ("a", None, "i", "z", 2), ("a", "y", None, None, None), (None, None, None, None, None)]
    got = {tuple(r) for r in tree_aggregate(spark.createDataFrame(rows, EDGE), ["t", "k"], "s").collect()}
    assert got == {("x", "i", 5, 2), (None, "i", 1, 1), ("y", None, 1, 1), (None, None, 1, 0)}


def test_tree_aggregate_empty_and_hot_key(spark):
    empty = spark.createDataFrame([], EDGE)
    assert tree_aggregate(empty, ["t", "k"], "s").count() == 0
    assert heavy_keys(empty, ["t", "k"], 0.01).count() == 0
    hot = [(f"s{i % 700}", "hub" if i % 3 else f"t{i}", "k", None, 0) for i in range(3000)]
    got = {r["t"]: (r["n_rows"], r["n_members"]) for r in tree_aggregate(spark.createDataFrame(hot, EDGE), ["t", "k"], "s").collect()}
    assert got["hub"] == (2000, len({f"s{i % 700}" for i in range(3000) if i % 3}))
    assert [r["t"] for r in heavy_keys(spark.createDataFrame(hot, EDGE), ["t", "k"], 0.5).collect()] == ["hub"]


def test_heavy_share_counts_null_rows_and_is_inclusive(spark):
    rows = [("s", "t", "k", None, 0)] * 2 + [("s", None, "k", None, 0)] * 98 + [("s", "u", "k", None, 0)] * 100
    got = {r["t"] for r in heavy_keys(spark.createDataFrame(rows, EDGE), ["t", "k"], 0.01).collect()}
    assert got == {"t", "u"}


def brute(links):
    parent = defaultdict(set)
    for s, t in links:
        if s is not None and t is not None and s != t:
            parent[t].add(s)
    up = {t: min(p) for t, p in parent.items()}
    out = {}
    for x in set(up) | set(up.values()):
        path, at = [x], x
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at in up:
            ring = path[path.index(up[at]) :]
            out[x] = (min(ring), -1, None)
        else:
            out[x] = (at, len(path) - 1, path[::-1])
    return out


def check(spark, links, every=3, plain_too=False):
    df = spark.createDataFrame(links, "s string, t string")
    want = brute(links)
    got = {r["id"]: r for r in hierarchy(tree_links(df, "s", "t"), with_path=True, splitter_every=every).collect()}
    assert set(got) == set(want)
    for x, (root, depth, path) in want.items():
        assert (got[x]["root"], got[x]["depth"], got[x]["path"]) == (root, depth, path), x
    if not plain_too:
        return df
    plain = {r["id"]: (r["root"], r["depth"]) for r in hierarchy(tree_links(df, "s", "t"), splitter_every=every).collect()}
    assert plain == {x: v[:2] for x, v in want.items()}
    return df


def test_hierarchy_chain_star_rings_and_dirt(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"l{i}") for i in range(50)]
    rings = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "x1"), ("x1", "x2"), ("q1", "q2"), ("q2", "q1")] + [(f"x{i}", f"x{i + 1}") for i in range(2, 20)]
    dirt = [(None, "a"), ("a", None), ("a", "a"), ("c000", "c001"), ("z", "two"), ("y", "two")]
    df = check(spark, chain + star + rings + dirt, plain_too=True)
    tree = hierarchy(tree_links(df, "s", "t"), with_path=True, splitter_every=3)
    below = {(r["id"], r["below"]): r["distance"] for r in descendants(tree).collect()}
    assert below["c000", "c060"] == 60 and below["hub", "l7"] == 1 and not any(a.startswith("r") for a, _ in below)


def test_hierarchy_random_graphs_and_splitter_choices(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(120)}", f"n{i}") for i in range(120)]
    check(spark, links, 2)
    check(spark, links, 1000)


def test_hierarchy_empty(spark):
    df = spark.createDataFrame([], "s string, t string")
    assert hierarchy(tree_links(df, "s", "t"), with_path=True).count() == 0


def test_all_descendants_on_and_below_rings(spark):
    rng = random.Random(8)
    links = [(f"n{rng.randrange(60)}", f"n{i}") for i in range(60)] + [("r2", "r3"), ("r3", "r1"), ("r1", "r2"), ("r3", "x1"), ("x1", "x2"), ("r1", "y1"), ("c0", "c1"), ("c1", "c2"), ("q1", "q2"), ("q2", "q1")]
    up = {t: s for s, t in links if s != t}
    want = {}
    for x in up:
        at, d = up[x], 1
        while at != x and (at, x) not in want:
            want[at, x] = d
            if at not in up:
                break
            at, d = up[at], d + 1
    got = [(r["id"], r["below"], r["distance"]) for r in all_descendants(tree_links(spark.createDataFrame(links, "s string, t string"), "s", "t")).collect()]
    assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == want
    assert want["r1", "r3"] == 2 and want["r1", "x2"] == 4 and want["x1", "x2"] == 1
