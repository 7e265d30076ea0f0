import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from weftgraph.llm import origin as O
from weftgraph.session import Cut

FILE = "id string, ext string, size long, loc long, last_seen timestamp, lines int, kind string"
T = datetime(2023, 1, 1)


def code(tag, n=30):
    return "\n".join(f"export function {tag}Handler{i}(request{i}) {{ return {tag}.store.read('{tag}-{i}') }}" for i in range(n))


def kinds(spark, contents, extra=()):
    files = [(i, "js", len(c or ""), 1, T, 0, "z") for i, c in contents] + [(i, None, s, 0, T, 0, "z") for i, s in extra]
    f = spark.createDataFrame(files + files[:2], FILE)
    c = spark.createDataFrame([(i, x, "t", True) for i, x in [*contents, *contents[:2]]], "id string, content string, tool string, own boolean")
    return {r["id"]: r["kind"] for r in O.origins(f, c).collect()}


def test_kinds(spark):
    minified = "!function(e,t){\"use strict\";" + "".join(f"e.a{i}=function(n){{return n*{i}}};var b{i}=e[{i}];" for i in range(40)) + "}(this);"
    data = "const a = [\n" + "".join("  " + ", ".join(str(j * 7919 % 9973) for j in range(i, i + 12)) + ",\n" for i in range(12)) + "];\n"
    got = kinds(spark, [
        ("r/a/hand.js", code("hand")),
        ("r/a/gen1.js", "// Code generated by toolc. DO NOT EDIT.\n" + code("gen1")),
        ("r/a/gen2.js", code("gen2") + "\n// end of output of toolgen\n"),
        ("r/a/gen3.js", "// Autogenerated with toolc; do not modify by hand\nx\n"),
        ("r/a/talks.js", "// called by the code generator, written by hand\n// ids are generated by the store, do not edit them here\n// the vendored copy was dropped in favour of this file\nconst H = '%s @generated';\n" + code("talks")),
        ("r/a/min.js", code("plain")),
        ("r/a/squeezed.js", minified),
        ("r/a/table.js", data),
        ("r/a/x.min.js", "a"),
        ("r/build/y.js", "b"),
        ("r/generators/z.js", code("zz")),
        ("r/package-lock.json", "{}"),
        ("r/vendor/lib/m.js", code("lib")),
        ("r/a/up.js", "// vendored: lib 1.2.3 by lib contributors\n" + code("up")),
        ("r/vendor/own.js", "// Copyright (c) the r authors\n" + code("own")),
        ("s/other/copy.js", code("lib").replace("Handler3(", "Changed(")),
        ("r/a/query.js", "const Q = 'select " + ", ".join(f"column_{'x' * (i % 5)}" for i in range(80)) + "';\n" + code("q", 3)),
        ("r/a/null.js", None),
    ], [("r/a/big.py", 5_000_000), ("r/a/small.py", 10), ("r/third_party/k.c", None)])
    want = {"r/a/hand.js": "hand", "r/a/gen1.js": "generated", "r/a/gen2.js": "generated", "r/a/gen3.js": "generated", "r/a/talks.js": "hand", "r/a/min.js": "hand", "r/a/squeezed.js": "minified",
            "r/a/table.js": "data", "r/a/x.min.js": "generated", "r/build/y.js": "generated", "r/generators/z.js": "hand", "r/package-lock.json": "lock", "r/vendor/lib/m.js": "vendored", "r/a/up.js": "vendored",
            "r/vendor/own.js": "own", "s/other/copy.js": "vendored", "r/a/query.js": "hand", "r/a/null.js": "hand", "r/a/big.py": "unkept", "r/a/small.py": "hand", "r/third_party/k.c": "vendored"}
    assert got == want


def test_many_copies_meet_without_pairs(spark):
    """Thirty edited copies of one file: each keeps most rare lines, none is lost, the upstream with its own licence stays."""
    base = code("lib", 40).split("\n")
    contents = [("up/src/lib.js", "// Copyright (c) the up authors\n" + "\n".join(base))]
    for k in range(30):
        contents.append((f"r{k}/src/f{k}.js", "\n".join(x if i % 40 != k else f"changed line {k} of this file" for i, x in enumerate(base))))
    contents += [(f"t{k}/a.js", code(f"t{k}", 6)) for k in range(3100)]
    got = kinds(spark, contents)
    assert got["up/src/lib.js"] == "own" and got["t5/a.js"] == "hand"
    assert {got[f"r{k}/src/f{k}.js"] for k in range(30)} == {"vendored"}


def test_marks_below_a_licence_block():
    """Marks stand anywhere in the comments before the first and after the last line of code."""
    licence = [f"// licence text, line {i}" for i in range(14)]
    body = ["const a = 1;"] * 6 + ["// generated by toolc, says a comment within code"] + ["f(a);"] * 3
    marks = lambda *lines: O.comment_marks(list(lines), "r")
    assert marks(*licence, "// Code generated by toolc. DO NOT EDIT.", *body) == (True, False, False, False)
    assert marks("/*", *[x[3:] for x in licence], "vendored from lib 1.2.3", "*/", *body) == (False, True, False, False)
    assert marks("'use strict';", *licence, "// Copyright (c) the r authors", *body) == (False, False, True, False)
    assert marks(*body, "// Copyright (c) the other authors", *licence) == (False, False, False, True)
    assert marks(*body, "/*", "Code generated by toolc", *[x[3:] for x in licence], "*/") == (True, False, False, False)
    assert marks("const b = 2; /* one", "generated by toolc */", *body) == marks(*licence, *body) == (False,) * 4


def test_copies_that_make_their_own_lines_frequent(spark):
    """A third of the files are edited copies of one file: its lines are frequent, so nothing rare is left to compare; a shared licence is no copy."""
    base = code("lib", 40).split("\n")
    licence = [f"// licence text of everyone, line {i}" for i in range(9)]
    contents = [("up/src/lib.js", "// Copyright (c) the up authors\n" + "\n".join(licence + base))]
    for k in range(30):
        contents.append((f"r{k}/src/f{k}.js", "\n".join(x if i % 20 != k % 20 else f"changed line {k}.{i} of this file" for i, x in enumerate(base))))
    contents += [(f"t{k}/a.js", "\n".join([*licence, f"export const only{k} = load({k})"])) for k in range(60)]
    got = kinds(spark, contents)
    assert got["up/src/lib.js"] == "own" and {got[f"t{k}/a.js"] for k in range(60)} == {"hand"}
    assert {got[f"r{k}/src/f{k}.js"] for k in range(30)} == {"vendored"}


def test_copies_of_any_version_as_by_brute_force(spark):
    """Versions of libraries share lines, so a copy's version is seldom the least or greatest holder of its lines."""
    rng = random.Random(3)
    held, marked = {}, []
    for lib, (versions, pool, share) in enumerate([(40, 60, 0.5), (5, 40, 0.6), (5, 40, 0.6), (7, 50, 0.5)]):
        lines = [2 * (1000 * (lib + 1) + i) for i in range(pool)]
        for v in range(versions):
            held[f"v{v}/lib{lib}.js"] = set(rng.sample(lines, int(pool * share)))
            marked.append(f"v{v}/lib{lib}.js")
        for c in range(versions // 2):
            of = held[f"v{rng.randrange(versions)}/lib{lib}.js"]
            held[f"c{c}/copy{lib}.js"] = set(rng.sample(sorted(of), 17)) | {2 * (10**6 + 1000 * lib + 10 * c + i) for i in range(rng.choice([2, 3, 6]))}
    n = Counter(x for lines in held.values() for x in lines)
    common, want = max(O.COMMON_LEAST, int(O.COMMON_SHARE * len(held))), set()
    for f, lines in held.items():
        rare = {x for x in lines if n[x] <= common}
        for counted in [rare] + [lines] * (len(rare) < 0.5 * len(lines)):
            if len(counted) >= O.FEWEST and any(o.split("/")[0] != f.split("/")[0] and len(counted & held[o]) / len(counted) >= O.CONTAINED for o in marked):
                want.add(f)
    df = spark.createDataFrame([(f, sorted(x)) for f, x in held.items()], "id string, lines array<long>")
    got = O.copies(Cut(spark, "copies"), df, spark.createDataFrame([(m,) for m in marked], "id string"))
    assert len(want) >= 12 and {r["id"] for r in got.where("marked").collect()} == want
    # without marks the same lines find the same copies, and whoever else is contained in an unmarked file
    bare = O.copies(Cut(spark, "bare"), df, spark.createDataFrame([], "id string"))
    got = {(r["id"], r["marked"]) for r in bare.collect()}
    pairs = lambda f, counted: any(o.split("/")[0] != f.split("/")[0] and len(counted & x) / len(counted) >= O.CONTAINED for o, x in held.items() if o != f)
    every = set()
    for f, lines in held.items():
        rare = {x for x in lines if n[x] <= common}
        every |= {(f, False) for counted in [rare] + [lines] * (len(rare) < 0.5 * len(lines)) if len(counted) >= O.FEWEST and pairs(f, counted)}
    assert got == every and {f for f, _ in every} >= want


def test_unmarked_copies_come_through_the_index(spark, monkeypatch):
    """An edited copy without any hint in name, directory or comment: the file seen first is the origin. Without the index nothing tells it."""
    base = code("lib", 40).split("\n")
    edited = lambda k: "\n".join(x if i % 20 != k else f"changed line {k}.{i} here" for i, x in enumerate(base))
    contents = [("one/src/parse.js", "\n".join(base)), ("two/app/reader.js", edited(3)), ("three/core/scan.js", edited(7)), ("one/src/again.js", edited(9)), ("four/x/own.js", code("own", 30))]
    t = lambda d: datetime(2024, 1, d)
    files = [("two/app/reader.js", t(5)), ("one/src/parse.js", t(2)), ("one/src/parse.js", t(9)), ("three/core/scan.js", None), ("four/x/own.js", t(1)), ("one/src/again.js", t(3))]
    f = spark.createDataFrame([(i, "js", 100, 1, d, 0, "z") for i, d in files], FILE)
    c = spark.createDataFrame(contents, "id string, content string")
    found = lambda: {r["id"] for r in O.origins(f, c).where("kind = 'vendored'").collect()}
    assert found() == {"two/app/reader.js", "three/core/scan.js"}
    none = lambda cut, lines, marked: lines.where("false").select("id", F.col("id").alias("other"), F.lit(1.0).alias("contained"), F.lit(True).alias("marked"))
    monkeypatch.setattr(O, "copies", none)
    assert found() == set()


def test_empty(spark):
    f = spark.createDataFrame([], FILE)
    c = spark.createDataFrame([], "id string, content string")
    assert O.origins(f, c).count() == 0
