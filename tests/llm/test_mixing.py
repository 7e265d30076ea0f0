import itertools
import os

import pytest

from weftgraph.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary here")
DOC = "doc_id long, text string, source string, tokens int, pattern string"
TARGET = "source string, weight double, max_repeat int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "p") for i, (t, s) in enumerate(rows)], DOC)


def test_min_cost_flow_against_all_flows():
    arcs = [(0, 2, 3, 0), (0, 2, 3, 1), (0, 3, 2, 0), (2, 4, 4, 0), (2, 5, 4, 0), (3, 5, 2, 0), (4, 1, 3, 0), (5, 1, 4, 0)]
    flow = mixing.min_cost_flow(6, arcs, 0, 1)
    best = None
    for f in itertools.product(*[range(c + 1) for _, _, c, _ in arcs]):
        if all(sum(x for x, a in zip(f, arcs) if a[1] == v) == sum(x for x, a in zip(f, arcs) if a[0] == v) for v in range(2, 6)):
            key = (-sum(x for x, a in zip(f, arcs) if a[0] == 0), sum(x * a[3] for x, a in zip(f, arcs)))
            best = min(best, key) if best else key
    assert (-sum(x for x, a in zip(flow, arcs) if a[0] == 0), sum(x * a[3] for x, a in zip(flow, arcs))) == best


def test_report_and_selection(spark):
    rows = [("one two three four five", "A ")] * 3 + [("six seven eight", "a")] + [("nine ten", "b")] * 2 + [("shared words of two", "a"), ("shared words of two", "B")] + [(None, "a"), ("", "b"), ("left out entirely", None), ("other source", "zz")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2), ("c", 0.1, 5)], TARGET)
    mix = mixing.Mix(docs(spark, rows), targets)
    rep = {r["source"]: r for r in mix.report().collect()}
    assert rep["a"]["reachable"] and not rep["b"]["reachable"] and not rep["c"]["reachable"] and rep["c"]["tokens"] == 0
    assert abs(sum(r["share"] for r in rep.values()) - 1) < 1e-9
    used = {(r["doc_id"], r["source"]): r["uses"] for r in mix.documents().collect()}
    assert all(u <= {"a": 1, "b": 2}[s] for (_, s), u in used.items())
    taken = {}
    sizes = {r["doc_id"]: r["tokens"] for r in mix.sized.collect()}
    for (d, s), u in used.items():
        taken[s] = taken.get(s, 0) + u * sizes[d]
    for s in ("a", "b"):
        assert 0 <= taken[s] - rep[s]["routed"] < max(sizes.values()) * 3
    again = {(r["doc_id"], r["source"]): r["uses"] for r in mixing.Mix(docs(spark, rows), targets).documents().collect()}
    assert again == used


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    none = mixing.Mix(docs(spark, [("x", "a")]).limit(0), targets)
    assert [r["quota"] for r in none.report().collect()] == [0] and none.documents().count() == 0
    alone = mixing.Mix(docs(spark, [("x", "a")]), targets.limit(0))
    assert alone.report().count() == 0 and alone.documents().count() == 0


def test_reached_shares_are_those_of_the_chosen_documents(spark):
    rows = [(f"word{i} " * (3 + i % 7), "a" if i % 3 else "b") for i in range(60)]
    mix = mixing.Mix(docs(spark, rows), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET))
    got = {r["source"]: r for r in mix.reached().collect()}
    sizes = {r["doc_id"]: r["tokens"] for r in mix.sized.collect()}
    taken = {"a": 0, "b": 0}
    for r in mix.documents().collect():
        taken[r["source"]] += r["uses"] * sizes[r["doc_id"]]
    assert {s: got[s]["reached"] for s in taken} == taken and abs(got["a"]["share"] - taken["a"] / sum(taken.values())) < 1e-9


def test_sources_of_the_same_texts_compete():
    patterns, targets = [("a\nb", "a", 100), ("a\nb", "b", 100), ("b", "b", 30)], [("a", 0.5, 2), ("b", 0.5, 2)]
    free, bound = mixing._routes(patterns, targets, 200), mixing._routes(patterns, targets, 200, 1)
    assert sum(free.values()) == 200 and sum(bound.values()) == 130 and bound["b", "b"] == 30
