from weftgraph.operators.calls import resolve_calls

CALL = "call string, caller_file string, src string, lo long, hi long, name string, member boolean, typed boolean, imported_only boolean, module string"
SYM = "symbol string, name string, qualified string, file string, line long, aux boolean"


def call(k, name, file="a", src=None, lo=None, hi=None, member=False, typed=False, io=False, module=None):
    return (k, file, src, lo, hi, name, member, typed, io, module)


def world(spark, calls, **kw):
    symbols = [
        ("a#leaf@1", "leaf", "leaf", "a", 1, False), ("a#mid@5", "mid", "mid", "a", 5, False), ("a#leaf@7", "leaf", "leaf", "a", 7, False), ("a#C.go", "go", "C.go", "a", 20, False), ("b#D.go", "go", "D.go", "b", 3, False),
        ("b#only", "only", "only", "b", 1, False), ("b#solo", "solo", "B.solo", "b", 9, False), ("c#pick", "pick", "pick", "c", 1, False), ("d#pick", "pick", "pick", "d", 1, False), ("t#aux", "aux", "aux", "test/t", 1, True),
        ("e#get", "get", "get", "e", 1, False), ("e#_bar", "_bar", "_bar", "e", 2, False), ("f#slug", "slug", "slug", "f", 1, False), ("g#slug", "slug", "slug", "g", 1, False), ("h#lone", "lone", "lone", "h", 1, False), ("p#two", "two", "two", "p", 1, False), ("q#two", "two", "two", "q", 1, False),
    ]
    made = resolve_calls(
        spark.createDataFrame(calls, CALL), spark.createDataFrame(symbols, SYM), spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "barrel")], "file string, imported string"),
        spark.createDataFrame([("Sub", "Mid"), ("Mid", "B")], "cls string, base string"), spark.createDataFrame([("barrel", "f")], "file string, source string"),
        spark.createDataFrame([("mod", "bar", "e", "_bar")], "file string, exported string, source string, orig string"), **kw,
    )
    return {r["call"]: (r["outcome"], r["target"], r["reason"]) for r in made.collect()}


def test_every_step_of_the_order(spark):
    calls = [
        call("shadow", "leaf", src="a#mid@5", lo=5, hi=10), call("own", "leaf", src="x", lo=30, hi=40), call("builtin", "v.get", member=True), call("namespace", "get", member=True, io=True, module="e"),
        call("exact", "C.go", member=True, typed=True), call("base", "Sub.solo", member=True, typed=True), call("unknown type", "Set.solo", member=True, typed=True), call("alias", "bar", member=True, io=True, module="mod"),
        call("many methods", "go", member=True), call("one method", "solo", member=True), call("no method", "only", member=True), call("bare is no method", "solo"), call("imported", "only"), call("two imported", "pick"),
        call("reach", "slug", member=True, io=True, module="barrel"), call("wide", "slug", member=True, io=True), call("nothing", "nowhere"), call("aux", "aux"), call("lone", "lone"), call("two", "two"), call("builtin bare", "get"), call("case", "LEAF"), call("case", "LEAF"),
    ]
    got = world(spark, calls)
    no = ("open", None, None)
    assert got == {
        "shadow": ("resolved", "a#leaf@7", None), "own": ("resolved", "a#leaf@1", None), "builtin": ("declined", None, "builtin-method"), "namespace": ("resolved", "e#get", None),
        "exact": ("resolved", "a#C.go", None), "base": ("resolved", "b#solo", None), "unknown type": no, "alias": ("resolved", "e#_bar", None),
        "many methods": ("declined", None, "ambiguous-user-method"), "one method": ("resolved", "b#solo", None), "no method": ("declined", None, "no-match"), "bare is no method": ("declined", None, "no-match"),
        "imported": ("resolved", "b#only", None), "two imported": ("declined", None, "imported-ambiguous"), "reach": ("resolved", "f#slug", None), "wide": ("resolved", "f#slug", None), "nothing": no,
        "aux": ("declined", None, "no-match"), "lone": ("resolved", "h#lone", None), "two": ("declined", None, "ambiguous-prod"), "builtin bare": ("declined", None, "builtin-fallback"), "case": no,
    }
    strict = world(spark, calls, allow_any=False)
    assert strict["lone"] == no and strict["imported"] == got["imported"]


def test_empty(spark):
    assert world(spark, []) == {}
