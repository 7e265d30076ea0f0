"""Import lookups: for each case the importing file, the specifier, the files there are and the one that is meant; all in one tree."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.modules import resolve_modules, resolve_units

ONE = [
    ("main.py", "data.loader", ["utils.py", "data/loader.py"], {}, "data/loader.py"),
    ("src/attr/_make.py", "attr.converters", ["src/attr/converters.py", "src/attr/__init__.py"], {}, "src/attr/converters.py"),
    ("src/attr/_make.py", "attr", ["src/attr/converters.py", "src/attr/__init__.py"], {}, "src/attr/__init__.py"),
    ("tools/x.py", "lib.a", ["lib/a.py", "deep/down/lib/a.py", "deep/down/lib/__init__.py"], {}, "deep/down/lib/a.py"),
    ("p/q/a.py", "..b.c", ["p/b/c.py", "p/q/b/c.py"], {}, "p/b/c.py"),
    ("p/q/a.py", ".", ["p/q/__init__.py"], {}, "p/q/__init__.py"),
    ("src/a.c", "b.h", ["src/b.h", "include/b.h"], {}, "src/b.h"),
    ("src/a.c", "inc.h", ["include/inc.h"], {}, "include/inc.h"),
    ("src/a.c", "stdio.h", ["src/b.h"], {}, None),
    ("com/a/B.java", "com.a.C", ["com/a/C.java"], {}, "com/a/C.java"),
    ("src/com/d/B.java", "com.d.E.inner", ["src/com/d/E.java"], {}, "src/com/d/E.java"),
    ("faraday.rb", "faraday/version", ["faraday/version.rb"], {}, "faraday/version.rb"),
    ("faraday/request/body.rb", "multipart_boundary", ["faraday/request/multipart_boundary.rb"], {}, "faraday/request/multipart_boundary.rb"),
    ("faraday.rb", "json", ["faraday.rb"], {}, None),
    ("src/Monolog/Logger.php", "Monolog\\Handler\\StreamHandler", ["src/Monolog/Handler/StreamHandler.php"], {}, "src/Monolog/Handler/StreamHandler.php"),
    ("src/Monolog/Logger.php", "Psr\\Log\\LoggerInterface", ["src/Monolog/Logger.php"], {}, None),
    ("a.php", "Lib\\Psr7\\Uri", ["src/Uri.php", "lib/Psr7/Uri.php"], {"composer.json": '{"autoload": {"psr-4": {"Lib\\\\": "lib/", "Lib\\\\Psr7\\\\": ["src/"]}}}'}, "src/Uri.php"),
    ("lib/http.dart", "src/client.dart", ["lib/src/client.dart"], {}, "lib/src/client.dart"),
    ("lib/main.dart", "dart:async", ["lib/foo.dart"], {}, None),
    ("a/lib/main.dart", "package:other/x.dart", ["b/lib/x.dart"], {"b/pubspec.yaml": "name: other\nversion: 1\n"}, "b/lib/x.dart"),
    ("src/a.ts", "@x/common/util", ["packages/common/src/util.ts"], {"tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@x/common/*": ["./packages/common/src/*"],}} }'}, "packages/common/src/util.ts"),
    ("src/a.ts", "@s/pkg", ["packages/p/src/index.ts"], {"packages/p/package.json": '{"name": "@s/pkg", "main": "dist/index.js"}'}, "packages/p/src/index.ts"),
    ("src/a.ts", "@s/round/shapes/circle", ["packages/r/internal/shapes/circle.ts", "packages/r/any/shapes/circle.ts"], {"packages/r/package.json": '{"name": "@s/round", "exports": {"./*": "./any/*.ts", "./shapes/*": {"import": {"node": "./internal/shapes/*.ts"}}}}'}, "packages/r/internal/shapes/circle.ts"),
    ("src/a.ts", "react", ["src/b.ts"], {}, None),
]
RUST = ["src/lib.rs", "src/de.rs", "src/de/enum_.rs", "src/internals/mod.rs", "src/internals/attr.rs", "src/bound.rs"]
ONE += [(s, spec, RUST, {}, t) for s, spec, t in [
    ("src/de.rs", "enum_", "src/de/enum_.rs"), ("src/bound.rs", "crate::internals::attr", "src/internals/attr.rs"), ("src/bound.rs", "crate::internals::Ctxt", "src/internals/mod.rs"), ("src/de.rs", "crate::bound", "src/bound.rs"),
    ("src/de/enum_.rs", "super::enum_", "src/de/enum_.rs"), ("src/internals/mod.rs", "self::attr", "src/internals/attr.rs"), ("src/bound.rs", "crate::internals::attr::deep::Foo", "src/internals/attr.rs"), ("src/de.rs", "crate::Reexport", "src/lib.rs"), ("src/de.rs", "syn::Token", None),
]]
ONE += [("app/src/x.rs", "my_core::util::F", ["core/src/lib.rs", "core/src/util.rs", "app/src/lib.rs"], {"core/Cargo.toml": '[package]\nname = "my-core"\n[dependencies]\n', "app/Cargo.toml": '[package]\nname = "app"\n'}, "core/src/util.rs")]
MANY = [
    ("Sources/Other/C.swift", "M", ["Sources/M/A.swift", "Sources/M/sub/B.swift", "Sources/Other/C.swift"], {}, {"Sources/M/A.swift", "Sources/M/sub/B.swift"}),
    ("X.cs", "Internal", ["Internal/A.cs", "Internal/B.cs", "Internal/Sub/C.cs", "X.cs"], {}, {"Internal/A.cs", "Internal/B.cs"}),
    ("x/X.cs", "Res", ["a/A.cs", "b/B.cs", "x/X.cs"], {"a/A.cs": "namespace Foo.Res;\n", "b/B.cs": "namespace Res\n{\n}\n", "x/X.cs": "namespace Foo.Bar\n{}\n"}, {"a/A.cs"}),
    ("cmd/main.go", "example.invalid/m/sub/pkg", ["sub/pkg/a.go", "sub/pkg/b.go", "sub/pkg/deep/c.go", "cmd/main.go"], {"go.mod": "module example.invalid/m\n\ngo 1.22\n"}, {"sub/pkg/a.go", "sub/pkg/b.go"}),
    ("cmd/main.go", "fmt", ["cmd/main.go"], {"go.mod": "module example.invalid/m\n"}, set()),
]


def world(spark, cases):
    ids = sorted({i for s, _, files, contents, _ in cases for i in (s, *files, *contents)})
    said = {i: t for c in cases for i, t in c[3].items()}
    return (
        spark.createDataFrame([c[:2] for c in cases], "s string, spec string"), spark.createDataFrame([(i,) for i in ids], "id string"),
        spark.createDataFrame([(i, said.get(i)) for i in ids], "id string, content string"),
    )


def test_one_file(spark):
    got = {(r["s"], r["spec"]): r["t"] for r in resolve_modules(*world(spark, ONE)).collect()}
    assert {k: v for k, v in got.items() if v != {c[:2]: c[4] for c in ONE}[k]} == {} and len(got) == len(ONE)


def test_projects_stay_apart(spark):
    files = spark.createDataFrame([(i,) for i in ("one/src/a.c", "one/inc/x.h", "two/x.h", "one/lib/a.py", "two/lib/b.py", "one/src/lib2/c.py", "two/lib2/c.py")], "id string")
    imports = spark.createDataFrame([("one/src/a.c", "x.h"), ("one/lib/a.py", "lib.b"), ("one/lib/a.py", "lib2.c"), ("two/lib/b.py", "lib.b")], "s string, spec string")
    none = spark.createDataFrame([], "id string, content string")
    got = {(r["s"], r["spec"]): r["t"] for r in resolve_modules(imports, files, none, by_project=True).collect()}
    assert got == {("one/src/a.c", "x.h"): "one/inc/x.h", ("one/lib/a.py", "lib.b"): None, ("one/lib/a.py", "lib2.c"): "one/src/lib2/c.py", ("two/lib/b.py", "lib.b"): "two/lib/b.py"}


@pytest.mark.parametrize("cases", [[c for c in MANY if not c[0].endswith(".cs")]] + [[c] for c in MANY if c[0].endswith(".cs")])
def test_units(spark, cases):
    got = {c[:2]: set() for c in cases}
    for r in resolve_units(*world(spark, cases)).collect():
        got[r["s"], r["spec"]].add(r["t"])
    assert got == {c[:2]: c[4] for c in cases}


def test_nulls_and_empty_tables(spark):
    files, contents = spark.createDataFrame([("a/x.py",), (None,)], "id string"), spark.createDataFrame([("package.json", "{"), ("go.mod", None)], "id string, content string")
    imports = spark.createDataFrame([(None, "x"), ("a/x.py", None), ("a/x.py", ""), ("a/x.py", "zz"), ("a/x.py", "zz")], "s string, spec string")
    assert [tuple(r) for r in resolve_modules(imports, files, contents).collect()] == [("a/x.py", "zz", None)]
    assert resolve_modules(imports.where(F.lit(False)), files, contents).count() == 0 == resolve_units(imports, files.limit(0), contents.limit(0)).count()
