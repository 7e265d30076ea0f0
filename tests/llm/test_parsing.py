import json

import pytest

from weftgraph.llm import parsing
from weftgraph.llm.lexing import Bad, classes
from weftgraph.llm.parsing import PERMITTED, confirmed, levels, unparsed

VALID = {
    "js": [
        "import a, { b as c } from './x.js';\nimport * as ns from \"y\";\nimport 'side';\nexport * from './z';\nexport default class extends Base { #p = 1; static s() { return super.s(); } get v() { return this.#p; } }\n",
        "const f = async (x, { y = 2, ...rest }, [a, , b] = []) => { await x?.y?.[0]?.(1); return `a${b + `c${d}`}` };\nlet re = /[/\"'`({]+\\//gi, q = a / b / c;\nfor (const [k, v] of Object.entries(o)) { if (k in o) continue; else break }\n",
        "label: for (;;) { break label }\nswitch (x) { case 1: case 'a': { y(); break } default: z() }\ndo { i++ } while (i < 10)\ntry { f() } catch { g() } finally { h() }\nvar t = typeof x === 'y' ? void 0 : new (foo())(1), u = !(-x ** 2), w = x ? y : z;\n",
        "module.exports = { a, b() {}, async c() {}, *d() { yield* e() }, ['f' + 1]: 2, get g() { return 1 }, 'h': 3, ...i };\n!function(e,t){\"use strict\";for(var x in e)e.a(1)&&(t=2);return x?(y,1):void 0}(this)\nif (a) b(); else if (c) d()\n",
        "const half1 = (x) => x / 2 / 1;\nx = a\n  .b()\n  .c\ndelete x.y, a ||= b, c ??= d;\nlet y = function* () {}, z = class A {};\nwhile (1) ;\nexport { a as default, b };\nexport const g = 1, h = 2\n",
        "// a ( b\n/* [ { */\n",
    ],
    "ts": [
        "import type { A } from './a';\nexport interface B<T extends object = {}> extends C, D<T> { readonly x?: number[]; [k: string]: any; (a: string): void; m?(): Promise<T>; new (x: number): B }\n",
        "type U = 'a' | 'b' | { kind: 'c'; v: [number, string?] } | ((x: number) => void);\nexport enum E { A = 1, B, C = 'x' }\ndeclare module 'm' { export function f(a: number, ...b: string[]): a is string; }\n",
        "export abstract class Q<T> implements R { private static readonly z: Map<string, Array<T>> = new Map(); constructor(public a: number, private b?: string) { super(); } abstract f(): void; get v(): number { return this.a!; } }\n",
        "const f = <T,>(x: T): T => x as unknown as T;\nlet v = <any>w, o = y! + 1, k: keyof typeof x = 'a';\nfunction g(this: Window, a?: number): asserts a is number {}\nfunction h<T>(x: T[]): x is T[] { return true }\nnamespace N.M { export const a = 1 }\n",
        "@Component({ a: 1 })\nexport class X { @Input() y: string = ''; @Output() z = new E<string>(); handler = async (e: Event): Promise<void> => { await 1 } }\nexport default function <T>(a: T) { return a satisfies T }\n",
    ],
    "go": [
        "// c\npackage main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n\t_ \"x\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype T struct {\n\tX, Y int `json:\"x\"`\n\t*Z\n\tf func(a int, b ...string) (int, error)\n}\n\ntype I interface {\n\tM(x int) error\n\t~int | string\n}\n",
        "package p\n\nfunc (t *T) F(a, b int, c []string) (r int, err error) {\n\tif x, ok := m[a]; ok && !y {\n\t\treturn x, nil\n\t} else if z {\n\t}\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range m {\n\t\t_ = k + v\n\t}\n\tswitch v := a.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase x := <-ch:\n\tcase ch <- 1:\n\t}\n\tdefer func() { recover() }()\n\tgo f(a...)\n\tx := []int{1, 2,\n\t\t3,\n\t}\n\ty := map[string]struct{}{\"a\": {}}\n\tz := &T{X: 1}\n\t*p = 'x'\n\treturn\n}\n\nfunc G[T any](x T) T { return x }\n\nvar c chan<- int\nvar d = func(s string) bool { return s != \"\" }\n",
    ],
    "java": [
        "package a.b;\n\nimport java.util.*;\nimport static x.Y.z;\n\n@A(b = 1, c = {\"x\"})\npublic final class C<T extends Comparable<T>> extends D implements E, F<T> {\n  private static final Map<String, List<int[]>> M = new HashMap<>();\n  int[] a = {1, 2}, b = new int[3];\n  static { x(); }\n  C(int x) { this.x = x; super.f(); }\n  @Override public <R> R f(Function<? super T, ? extends R> g, String... s) throws IOException, X {\n    for (int i = 0, n = 5; i < n; i++) ;\n    for (String t : s) { if (!(t instanceof String u)) continue; else break; }\n    try (var r = o()) { } catch (A | B e) { throw new X(e); } finally { }\n    switch (x) { case 1: case 2: y = (int) z; break; default: }\n    int q = a > b ? -c : ~d; q += 3 >> 1; q >>>= 2;\n    Runnable l = () -> { }; h(C::new, this::m, (p, k) -> p + k);\n    do { w--; } while (w > 0);\n    synchronized (this) { }\n    return (R) (Object) t;\n  }\n  enum G { A(1) { void f() {} }, B; int v; G(int... v) {} }\n  interface H { int X = 1; default void f() {} }\n  record P(int x, int y) { }\n  @interface J { String value() default \"\"; }\n}\n",
    ],
    "c": [
        "#include <stdio.h>\n#include \"a.h\"\n#ifdef X\n#define M(a, b) do { f(a); \\\n  g(b); } while (0)\n#endif\n\ntypedef struct s { int a : 3; struct s *n; char b[16]; union { int x; } u; } s_t;\nstatic const char *const names[] = { \"a\" \"b\", [2] = \"c\", };\nextern int (*fp)(int, char **);\nenum e { A = 1, B };\n\nstatic inline unsigned long f(const s_t *p, int n, ...)\n{\n    int i = 0, *q = &n;\n    struct s v = { .a = 1, .u = { 2 } };\n    for (i = 0; i < n; ++i) { if (!p->n) continue; else break; }\n    switch (n) { case 'a': case 2: return sizeof(int); default: break; }\n    while (*q++ && (n & ~1)) ;\n    do n--; while (n);\n    *(int *)q = (unsigned char)-1 ? 1 : 2;\nend:\n    goto end;\n    return v.a == p->a ? 1UL : 0x1fu;\n}\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": {}}], "c": "\\u00e9 \\" x"}', "[]", "3", ' "x" '],
    "py": ["def f(a, /, b=1, *, c: int = 2, **k) -> int:\n    return a if b else c\n\nif (n := 3) > 1: pass\nx = {**a, 'b': [*c]}\nmatch x:\n    case 1:\n        pass\nasync def g():\n    async with a as b, c:\n        yield\nclass A(B, metaclass=C): x: int\n@d.e(1)\ndef h(): ...\nlambda *a: (yield)\nprint(f'{a!r:>{w}}' 'b', a[1:2, ::3], not a)\ntry:\n    x\nexcept (A, B) as e:\n    raise X from e\nelse:\n    y\nfinally:\n    z\n"],
}

INVALID = {
    "js": ["const a = {\n", "const x\n", "import { a }\n", "f(a b)\n", "if (a { b }\n", "const a = 'x\n", "<<<<<<< HEAD\nvar a\n=======\nvar b\n>>>>>>> x\n", "set -e\necho \"a\" || exit 3\n", "function f(a: number) {}\n", "```js\nx\n```\n", "<!DOCTYPE html>\n<html></html>\n", "  1| const a = 1\n", "a = \n", "return 1\n"],
    "ts": ["interface A { x: string;\n", "def f(a):\n  return a\n", "let x = (1;\n", "`a${b`\n"],
    "go": ["func f() {}\n", "package p\nfunc f() {\n", "package p\nx ] y\n", "package p\nfunc f() int {\n\tif x {\n\t} else return 2\n}\n", "package p\n@@ -1 +1 @@\n"],
    "java": ["class A { int x = ; }", "class A { void f() { }", "package a.b;\nclass A { int[] a = {1, 2; }", "a: b\nc: true\n", "class A { void f() { int = 3; } }", "class A { int f() { return 1 } }", "public class A { String s = \"x; }\n"],
    "c": ["int f(void) { return 1;\n", "int x = ;\n", "a: b\nc: true\n", "int f() { g(1, ); ) }\n", "int main(void) { return 0 }\n", "void f() { else { } }\n", "package a;\nimport java.util.*;\n"],
    "json": ["{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1 2]", '{"a": 01}', "// x\n{}"],
    "py": ["def f(:\n    pass\n", "if x\n    y\n", "def f():\nreturn 1\n", "  x = 1\ny = 2\n", "try:\n    x\n", "x = (1,\n", "for a in b: :\n    c\n", "from a import\n", "x = 'a\n"],
}




def table(spark, texts):
    return spark.createDataFrame([(f"r/{k}.{lang}", t) for k, (lang, t) in enumerate(texts)], "id string, content string")


@pytest.fixture(scope="module")
def judged(spark):
    texts = [(lang, t) for pool in (VALID, INVALID) for lang, ts in pool.items() for t in ts]
    rows = {r["id"]: r for r in unparsed(table(spark, texts)).collect()}
    return {t: rows[f"r/{k}.{lang}"] for k, (lang, t) in enumerate(texts)}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(judged, lang, text):
    assert judged[text]["ok"], judged[text]["reason"]


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(judged, lang, text):
    assert not judged[text]["ok"]


def test_levels_shrink_inner_brackets(spark):
    tokens = spark.createDataFrame([(1, "js", "i(i(i),n);{i}"), (2, "js", "{(i}")], "f long, lang string, kinds string")
    got = {(r["f"], r["level"]) for r in levels(tokens).collect()}
    assert {(1, "^i);}"), (1, "(i),n)"), (1, "(i)"), (1, "{i}")} == {x for x in got if x[0] == 1}
    assert (2, "(i}") in got


def test_pairs_decide_by_the_anti_join(spark, monkeypatch):
    """With every pair permitted, texts that only a pair tells are no longer found."""
    texts = [("js", "f(a b)\n"), ("go", "package p\nx ] y\n"), ("js", "f(a, b)\n")]
    found = lambda: {r["id"] for r in unparsed(table(spark, texts)).where("not ok").collect()}
    assert found() == {"r/0.js", "r/1.go"}
    signs = "^$insk()[]{};,.:?@#=oO+!u>ENHwdDrRqehb"
    monkeypatch.setattr(parsing, "PERMITTED", {lang: frozenset(c + a + b for c in "TBPSOA" for a in signs for b in signs) for lang in parsing.LANGUAGES})
    assert found() == {"r/1.go"}


@pytest.mark.parametrize("text", ['{"a": NaN}', "[Infinity, 1]", "-Infinity"])
def test_json_has_no_constants_beyond_null_true_false(text):
    assert confirmed(text, "json")


@pytest.mark.parametrize("lang", ["js", "ts"])
def test_long_imports(spark, lang):
    names = ", ".join(f"n{i}" for i in range(5000))
    texts = [f"import {{ {names} }} from 'lib'\n", f"import {{ {names} }}\n", f"import {{ {names} }}\nimport a from 'b'\n"]
    got = {r["id"]: r["reason"] for r in unparsed(table(spark, [(lang, t) for t in texts])).collect()}
    assert [got[f"r/{k}.{lang}"] for k in range(3)] == [None, "import without source", "import without source"]


def test_python_indentation():
    assert classes("if x:\n    y\n\n  # c\n    z\nw\n", "py") == "gi:N`iNiN~iN"
    assert classes("f(a,\n  b)\n", "py") == "i(i,i)N"
    for text in ("if x:\n        y\n    z\n", "if x:\n\ty\n        z\n"):
        with pytest.raises(Bad):
            classes(text, "py")


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [("a/x.json", "{}", 1), ("a/x.json", "{", 2), ("a/x.json", "{", 3), (None, "{", 4), ("a/y.py", None, 5), ("a/z.py", "", 6), ("a/w.PY", "x = = 1\n", 7), ("a/n.txt", "(", 8)]
    got = {r["id"]: r["ok"] for r in unparsed(spark.createDataFrame(rows, "id string, content string, f int")).collect()}
    assert got == {"a/x.json": False, "a/w.PY": False}
    assert unparsed(spark.createDataFrame([], "id string, content string")).count() == 0
    deep = json.dumps([[1]] * 3).replace("1", "[" * 300 + "]" * 300)
    assert unparsed(spark.createDataFrame([("d.json", deep), ("e.json", deep[:-1])], "id string, content string")).where("ok").count() == 1
