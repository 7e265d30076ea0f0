"""Source files that are no valid text of their language: token pairs against the grammar's, nesting, statement productions."""

from __future__ import annotations

import ast
import json
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.batches import map_arrow, spread
from weftgraph.llm.lexing import COARSE, LANGUAGES, Bad, classes
from weftgraph.session import Cut

def _pairs(lang: str) -> set[str]:
    """Permissible pairs of a language as ``context + left + right``.

    Derived from what its grammar lets follow an operand, an operator, an opening bracket, a separator or a statement
    word. Contexts: T top level, B in braces, P in parentheses, S in square brackets. ``^`` is the start of the
    text and ``$`` its end.
    """
    c_like = lang in ("c", "java")
    js = lang in ("js", "ts")
    ends = set("insk)]}u") | {"w"}
    names = set("iw")
    starts = set("insk([{+!uwr") | ({"d", "@", "E"} if js else set()) | ({"E", "d"} if lang == "go" else set())
    if lang == "py":
        starts = set("insk([{+!wrE") | {"o"}
    closes = set(")]}")
    out: set[str] = set()

    def allow(ctx: str, left, right) -> None:
        for x in ctx:
            for a in left:
                for b in right:
                    out.add(x + a + b)

    every = "TBPS"
    infix = set("o+=.,?:q") | {">"}
    allow(every, ends, infix | {"(", "[", ")", "]", "}", ";", "N", "u", "$"})
    allow(every, set("o+=!?>Eq,"), starts)
    allow(every, "r", starts | set(";:N)}],.$="))
    allow(every, ".", names | set("kdrqehb") | {"(", "[", "#", "s"} | ({"o", "+", "N"} if lang in ("py", "java", "js", "ts", "go") else set()))
    allow(every, ":", starts | set("N;dhbre}"))
    allow(every, "(", starts | {")", "N", "o", "h", "d", ";", ".", "E", "@"})
    allow(every, "[", starts | {"]", "N", ",", "o", "q", "d", "h", ".", "@", ":"})
    allow(every, "{", starts | {"}", "N", "h", "d", "b", "e", ";", ".", "@", "o", "q", "E", "r"})
    allow(every, ",", closes | {"N", "d", "h", "@", "E", "o", ".", ",", ":"})
    allow(every, "u", names | {"(", "[", "k"})
    allow(every, "N", starts | closes | set("hdbeqNo,.?:=;@#$E>"))
    allow(every, ";", starts | set("hdbeN);}@#$.o"))
    allow(every, "H", starts | set("hdbeN;{}o."))
    allow(every, "dehb", starts | set("hdbN;{(o=.:)],}@$?") | {"s"})
    allow("TB", "}", starts | set("hdbeqN;@#$o") | names)
    allow(every, "}", {"q", "e", "w", "i", "k", "{", "s"} if js or c_like else set())
    allow(every, "w", starts | set("dhobqeH<@:"))
    allow(every, "@", names | set("dkr("))
    allow(every, "E", starts | {")", "]", ",", "o", ".", "N", "}"})
    allow("T", "^", starts | set("hdbeN;@#$") - {"n"})
    if js:
        allow(every, "i", {"{", ">", "!", "e", "r", "s"} - {"e", "s"})
        allow(every, ")", {"{", "e", "!", "w"})
        allow(every, "]", {"{", "!", "r", "w"})
        allow(every, "ik)", {"w", "r"})
        allow(every, "s", {"w", "{"} - {"{"})
        allow(every, "?:o>=(,[+", {"o", "q", "d"})
        allow(every, "o", {"[", "o", ")", ",", ">", ";", "N", "=", "}", "]", "(", "{", "."} if lang == "ts" else {"[", "("})
        allow(every, "?", {":", ".", ",", ")", "="})
        allow(every, "+", {"w", ".", "N", "o"})
        allow(every, "o+=?>Eq.,:(", "N")
        allow(every, "r", {"d", "o", "e", "h", "b", "(", "{", "@", "!"})
        allow(every, "k", {"!", "{"})
        allow(every, "!", {"d", ".", ")", ";", ",", "N", "=", "o"})
        allow("B", "#", "i")
        allow("B", "{", "#")
        allow("S", "?", "]")
        if lang == "ts":
            allow("T", "s", "{")
        allow(every, "q", {"w", "d"})
        allow(every, "d", {"+", "o"})
        allow(every, "}", {"r"})
        allow("T", "^", {"s"})
        allow(every, "e", {"h"})
        allow(every, "w", {"i", "r", "s", "k", "+"})
    elif lang == "go":
        allow(every, "ik)]}", {"{", "i", "d", "r", "(", "[", "+"} - {"+"})
        allow(every, "i", {"d", "i", "{", "s", "E", "o", "+", "r"})
        allow(every, "s", {"{"})
        allow(every, "nu", {"{"})
        allow(every, "+o=,:(!r", {"d", "[", "N", "o"})
        allow(every, "]", {"i", "d", "[", "(", "+", "o"})
        allow(every, ")", {"d", "i", "r", "["})
        allow(every, "d", {"i", "[", "(", "{", "s", "d", "+", "o", "N"})
        allow(every, "r", {"d", "r", "h", "b"})
        allow(every, "}", {"r", "s", "d", "("})
        allow(every, "E", {"d", "[", "+"})
        allow("T", "^", {"d"})
        out -= {"T^" + x for x in "insk([{+!uwrhbe;@#o"}
        out -= {x + "}" + y for x in every for y in "in"}
        out -= {x + ":" + y for x in every for y in "}"}
    elif lang == "java":
        allow(every, "iw]ko", {"i", "w", "d"})
        allow(every, "i", {"{", "r", "w", "E", ">", "o"})
        allow(every, ")", {"{", "r", "i", "n", "s", "k", "(", "!", "w", "d", "@"})
        allow(every, "]", {"{", "i"})
        allow(every, "o", {"i", "w", "o", ">", ")", ",", "{", ".", "(", "?", ";", "[", "r", "="})
        allow(every, "?", {"r", "o", ",", "?"})
        allow(every, "w", {"d", "o", "[", "E", ".", "{", "@"})
        allow("B", "w", {"s", "n"})
        allow("PB", ",", {"?"})
        allow(every, "@", "d")
        allow(every, "d", {"i", "w"})
        allow(every, ";", set("hdbe@") | {"w"})
        out |= {"T.O", "TO;"}
        allow("T", "^", set("dw@i;"))
        allow("B", "}", {"w", "i"})
        out -= {"T^" + x for x in "nsk([{+!u"} | {x + a + "[" for x in every for a in "r=(,+o?>!q"} | {x + a + "N" for x in every for a in "insk"}
        out -= {"T" + a + b for a in "iwk)]" for b in ":?=+"}
        out -= {x + a + "s" for x in every for a in "iwks]}"} - {"B}s"}
        out -= {x + "]" + "n" for x in every}
    elif lang == "c":
        allow(every, "iw", {"i", "w", "+", "d", "{"})
        allow(every, "s", {"s", "i"})
        allow(every, ")", {"{", "i", "n", "s", "(", "!", "+", "w", "u", "k"})
        allow(every, "]", {"=", "{"})
        allow(every, "=,({", {"."})
        allow(every, "+=?:,(", {"+", "w", "r"})
        allow(every, "w", {"i", "w", "+", "{", ")", ",", "d"})
        allow(every, "}", {"i", "w", "+"})
        allow("T", "^", set("dwi#"))
        allow(every, "r", {"w"})
        out -= {"T^" + x for x in "nsk([{+!u;."} | {x + a + "s" for x in every for a in "wn]}k"} | {x + "is" for x in every} | {x + a + "[" for x in every for a in "r=,+o?!q"}
        out -= {"T" + a + b for a in "iw)]k" for b in ":?."} | {x + "]" + b for x in every for b in "insw"}
    elif lang == "py":
        allow(every, ends, {"h", "q", "e", ":", "r", ">"})
        allow(every, "s", {"s"})
        allow(every, "r", {"o", "h", "q", "e", ":", "d", "r"})
        allow(every, "q", {"q", "r", "h"})
        allow(every, "o=+(,[{:", {"o", "r", "h"})
        allow(every, ":", {"N", "]", ",", ")", "d", "h", "r", "e", ":", "="} - {":"})
        allow("S", ":", {":"})
        allow(every, "d", {"i", "w", ".", "E", "(", "r", "k"})
        allow(every, "e", {"i", "h", ":", "s", "(", "[", "n", "k", "{", "d", "w"})
        allow(every, "h", {"i", "(", "n", "s", "k", "[", "{", "r", "d", "w", "+", "h", "!", "o"})
        allow(every, ".", {"d", ".", "E", "r", "e", "h"})
        allow(every, "E", {"d", "i", "w"})
        allow(every, "w", {"i", "h", "q", "e", "d", "s", "k"})
        allow(every, "@", {"i", "w"})
        allow(every, "iw.", {"d"})
        allow("PBS", "o+", {",", ")", "]"})
        out -= {x + a + b for x in every for a in "insk)]}" for b in "insk{!"} - {x + "ss" for x in every}
        out -= {x + a + b for x in every for a in "s" for b in "w"}
        out -= {"TN" + x for x in "=:.>?,q"} | {"TN)", "TN]", "TN}", "T^)"}
        out -= {x + "," + "," for x in every}
    if js:
        # words that begin statements stand where a declaration may, never after an operator
        for p in [p for p in out if p[2] == "d" and p[1] in "N;}{^Hdeb:h" and p[0] in "TB"]:
            out |= {p[:2] + "D", p[:2] + "R"}
        out |= {p[0] + "D" + p[2] for p in out if p[1] == "d"} | {p[0] + "R" + p[2] for p in out if p[1] == "r"}
        out |= {x + "DR" for x in "TB"} | {x + "DD" for x in "TB"} | {x + "Rd" for x in every} | {x + "Dd" for x in "TB"} | {x + "Dw" for x in every} | {x + ".R" for x in every} | {x + ".D" for x in every}
        out |= {x + "D" + b for x in "TP" for b in "iw{["} | {x + a + "D" for x in "P" for a in "("} | {"BD" + b for b in "iw{["} | {x + a + "R" for x in "TB" for a in ":,{"} | {"BR:", "BR(", "T^D", "T^R", "BwR", "Bw,"}
    if lang in ("js", "ts", "java", "c"):
        only = starts - {"d", "D", "E"} if js else starts - {"w"}
        out |= {x + a + "O" for x in every for a in ends} | {x + "O" + b for x in every for b in only}
        if js:
            out |= {x + "O" + b for x in every for b in "Nd"} | {x + "NO" for x in every} | {x + "O" + b for x in every for b in "(["}
            out |= {x + a + "O" for x in every for a in ("({,;" if lang == "ts" else "{")} | {x + "RO" for x in every if lang == "ts"}
        if lang == "ts":
            out |= {x + a + b for x in every for a in "=:" for b in "O"} | {x + "oO" for x in every} | {x + "Oo" for x in every}
        else:
            out |= {"BdO", "TdO", "BwO"} if js else set()
        out |= {x + "!" + "O" for x in every if lang == "ts"} | {"B{O", "BNO"}
    if lang != "py":
        out -= {x + "::" for x in every}
    if lang not in ("js", "ts"):
        out -= {x + ",," for x in every}
    if lang == "c":
        allow("B", ",{", {"["})
    out -= {x + a + b for x in every for a in "=o" for b in ";)]}$"} - ({x + a + b for x in every for a in "o" for b in ";)]}"} if lang in ("ts", "java") else set()) - {"Po)"}
    if lang == "c":
        out |= {"P+)", "P+,"}
    if lang == "java":
        out |= {"Bws", "Bwn"}
    return out


def _json_pairs() -> set[str]:
    """JSON has a grammar of pairs alone: O before a key, V after the colon's value, A in a list."""
    out = {"T^" + v for v in "snk{["} | {"T" + a + "$" for a in "snk}]"}
    out |= {"O{s", "O{}", "Os:", "O,s"} | {"O:" + v for v in "snk{["} | {"O" + v + b for v in "snk}]" for b in ",}"}
    out |= {"A[" + v for v in "snk{[]"} | {"A," + v for v in "snk{["} | {"A" + v + b for v in "snk}]" for b in ",]"}
    return out


PERMITTED: dict[str, frozenset[str]] = {lang: frozenset(_json_pairs() if lang == "json" else _pairs(lang)) for lang in LANGUAGES}


# Productions that pairs cannot say, as patterns of what must not stand in a level: the tokens of one bracket pair, or of the
# whole text (between ^ and $), in which every inner bracket pair is one closing bracket (H after a header).
_LINE = r"(?:^|(?<=[NQ]))A?+"
_CLAUSE = r"(?![%s])[^NQ]*NQ?%s"
_LAST = {"js": "oO=a!.,?:>hrdqmDRCVXIFcE", "go": "oO=a+!.,:dP@", "java": r"oOa=+!.,?:>hrYJdqpUb@iknsw)\]", "c": r"oOa=+!.,?:hrYJUbd@iknswey)\]", "py": "oa=+!.,qmFcIfd@", "json": ",:"}
_LAST["ts"] = _LAST["js"]
_IMPORT = r"(?<!\.)I(?![)\.s=])(?![^=a;)IXCLVFcf]*(?:fs|=))"
_JS = (
    ("const without value", "", r"(?<!\.)C[iwfjWL](?![=:jm])"),
    ("import without source", "", _IMPORT),
    ("function without name", "", r"(?<!\.)F(?![iwfjlWLko+)])"),
    ("class without body", "", r"(?<!\.)c(?![iwfjlWL}r])"),
    ("return outside a function", "^", r"(?<![.,{])Y(?![:),(=])"),
)
#: For each language (reason, the bracket whose level is meant or nothing for all, pattern).
PRODUCTIONS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "js": _JS + (("type annotation", "(", ":"), ("type annotation", "^", r"[)H]:"), ("interface", "", r"Wi\}")),
    "ts": _JS,
    "go": (("no package clause", "^", r"^N*[^NP]"), ("else without block", "", r"y(?![}g])")),
    "java": (
        ("call at top level", "^", r"(?<![@.i])i\)"), ("type without name", "", r"p[=;+?:u!]"),
        ("statement without end", "{", r"[YJU][^;{}]*$"), ("else alone", "{", r"^y|[^;}]y|^[^h]*y"),
    ),
    "c": (("statement without end", "{", r"[YJU][^;{}]*$"), ("else alone", "{", r"^y|[^;}]y|^[^h]*y")),
    "json": (("nothing", "^", r"^$"),),
    "py": (
        ("header without colon", "", _LINE + r"(?:[Fcgxylptz]|[Xv](?!\.))[^:N]*N"),
        ("block missing", "", r":N(?!Q)"),
        ("indentation", "", r"(?<!:N)Q"),
        ("empty header", "", _LINE + r"[gxlpvFc]:"),
        ("header", "", _LINE + r"[yzt](?!:)"),
        ("for without in", "", _LINE + r"l[^m:N]*:"),
        ("def", "", _LINE + r"F(?![iwkMK][)\]])"),
        ("class", "", _LINE + r"c(?![iwMK])"),
        ("no statement before", "", r"^[xyXz]"),
        ("no statement before", "", _LINE + _CLAUSE % ("gx", "x")),
        ("no statement before", "", _LINE + _CLAUSE % ("gxlpX", "y")),
        ("no statement before", "", _LINE + _CLAUSE % ("tX", "X")),
        ("no statement before", "", _LINE + _CLAUSE % ("tXy", "z")),
        ("try alone", "", r"(?:^|(?<=[NQ]))t:[^NQ]*NQ?+(?![Xz])"),
        ("colon", "", _LINE + r"(?![FcgxylptzXvMK])[^NQ]*:N"),
        ("import", "", _LINE + r"I(?![^N]*[iwMK)]N)"),
        ("from without import", "", _LINE + r"f(?:I|(?![^N]*I[^N]+N))"),
    ),
}
_OPENS, _CLOSES, _STRAY, _OPEN_END = "([{`", ")]}~", "\x01", "\x02"


def bracket_rows(tokens: DataFrame) -> DataFrame:
    """(f, lang, pos, txt, depth, next) of (f, lang, kinds): a row for each bracket, with the tokens up to the next one.

    ``depth`` counts the brackets open behind it and ``next`` is the bracket that follows, both over the window of the
    file's rows. Files are placed by ``f`` before their tokens become rows, so the window shuffles nothing more; repeated
    files count once.
    """
    each = tokens.dropDuplicates(["f"]).select("f", "lang", F.posexplode(F.split(F.concat(F.lit("^"), "kinds"), r"(?=[()\[\]{}`~])")).alias("pos", "txt"))
    by_file = Window.partitionBy("f").orderBy("pos")
    first = F.substring("txt", 1, 1)
    step = F.when(first.isin(*_OPENS), 1).when(first.isin(*_CLOSES), -1).otherwise(0)
    return each.select("f", "lang", "pos", "txt", F.sum(step).over(by_file).alias("depth"), F.lead(first).over(by_file).alias("next"))


def levels(tokens: DataFrame) -> DataFrame:
    """(f, lang, level): the tokens of each bracket pair and of each whole text, inner pairs shrunk to their closing bracket.

    Rows of one depth are reduced in the order of the text; where a bracket opens, a level begins. Its last sign is the
    bracket that closes it; a bracket that closes nothing and a level that nothing closes leave marks.
    """
    closes = F.col("next").isin(*_CLOSES)
    end = F.when(closes, F.when(F.col("depth") == 0, F.lit(_STRAY)).otherwise(F.col("next"))).when(F.col("next").isNull() & (F.col("depth") > 0), F.lit(_OPEN_END)).otherwise("")
    rows = bracket_rows(tokens).where("depth >= 0").select("f", "lang", F.struct("depth", "pos", F.concat("txt", end).alias("t")).alias("row"))
    whole = rows.groupBy("f", "lang").agg(F.array_join(F.array_sort(F.collect_list("row"))["t"], "").alias("all"))
    return whole.select("f", "lang", F.explode(F.split("all", r"(?=[(\[{`^])")).alias("level"))


def _common(column):
    """The column's classes as members of pairs, by its row's language."""
    out = column
    for name in LANGUAGES:
        if COARSE[name]:
            out = F.when(F.col("lang") == name, F.translate(column, "".join(COARSE[name]), "".join(COARSE[name].values()))).otherwise(out)
    return out


def read_levels(distinct: DataFrame) -> DataFrame:
    """(lang, level, broken, ctx, common) of (lang, level): the nesting rule or production that a level breaks, and its members of pairs."""
    lang, level, open_ = F.col("lang"), F.col("level"), F.substring("level", 1, 1)
    root = F.col("open") == "^"
    end = F.substring(level, -1, 1)
    wrong = F.when(level.contains(_STRAY), "nesting").when(level.contains(_OPEN_END), "unclosed").when(~(open_ == "^") & (end != F.translate(open_, _OPENS, _CLOSES)), "nesting")
    inner = F.when(open_ == "^", F.expr("substring(level, 2)")).otherwise(F.expr("substring(level, 2, greatest(length(level) - 2, 0))"))
    # line ends say nothing inside ( and [, nor in braces of Python and JSON
    quiet = (open_.isin("(", "[") & (lang != "go")) | ((open_ == "{") & lang.isin("py", "json"))
    out = distinct.select("lang", "level", open_.alias("open"), wrong.alias("wrong"), F.when(quiet, F.translate(inner, "N", "")).otherwise(inner).alias("body"))
    cancelled = F.translate("body", "N", "")
    for _ in range(4):
        cancelled = F.regexp_replace(cancelled, r"\?[^?:]*:", "k")  # a conditional takes its colon along
    typed = (lang == "js") & F.col("open").isin("(", "^") & F.col("body").contains(":")
    lambdas = F.when(F.col("body").contains("L"), F.regexp_replace(F.regexp_replace("body", "L[^:L]*:", "k"), "L[^:L]*:", "k")).otherwise(F.col("body"))
    flat = F.when(lang.isin("js", "ts"), F.translate("body", "N", "")).when(lang == "py", F.translate(lambdas, "~", "Q")).otherwise(F.col("body"))
    common = _common(F.col("body"))
    common = F.when(root, F.concat(F.lit("^"), F.regexp_replace(common, "(?<!:)N+$", ""), F.lit("$"))).otherwise(F.concat(F.translate("open", "`", "N"), common, F.translate(F.substring("level", -1, 1), "~", "N")))
    ctx = F.when(lang == "json", F.translate("open", "^{[(", "TOAT")).otherwise(F.translate("open", "^`([{", "TTPSB"))
    out = out.select("lang", "level", "open", "wrong", "body", flat.alias("flat"), F.when(typed, cancelled).alias("typed"), ctx.alias("ctx"), F.regexp_replace(common, r"(h|@.)\)", "$1H").alias("common"))
    hits = [F.col("wrong")]
    for name, rules in PRODUCTIONS.items():
        for reason, o, rx in rules:
            text = F.col("typed") if reason == "type annotation" else F.col("flat")
            hits.append(F.when((lang == name) & text.rlike(rx) & ((F.col("open") == o) if o else F.lit(True)), F.lit(reason)))
    for name, last in _LAST.items():
        hits.append(F.when((lang == name) & root & F.regexp_replace("common", "H", ")").isNotNull() & F.rtrim(F.translate("body", "N", " ")).rlike(f"[{last}]$"), F.lit("dangling end")))
    return out.select("lang", "level", F.coalesce(*hits).alias("broken"), "ctx", "common")


def pair_rows(read: DataFrame) -> DataFrame:
    """(lang, level, pair): each two neighbouring tokens of each level; an inner bracket pair is seen from its left as its opening bracket."""
    # one pass over a level gives its pairs, however long it is
    two = F.regexp_extract_all("common", F.lit(r"(?s)(?=(..))"), F.lit(1))
    at = read.where(F.col("common") != "^$").select("lang", "level", "ctx", F.length("common").alias("n"), F.posexplode(two).alias("i", "two"))
    inner = F.concat(F.substring("two", 1, 1), F.translate(F.substring("two", 2, 1), ")]}H", "([{("))
    return at.select("lang", "level", F.concat("ctx", F.when(F.col("i") + 2 < F.col("n"), inner).otherwise(F.col("two"))).alias("pair"))


def _no_constant(name: str):
    raise ValueError(name)  # NaN and Infinity, which json.loads accepts and JSON does not have


def confirmed(text: str, lang: str) -> bool:
    """The exact check where the standard library has a parser; of other languages every finding stands."""
    try:
        if lang == "json":
            json.loads(text, parse_constant=_no_constant)
            return False
        if lang == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return False
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return True
    return True


def unparsed(files: DataFrame) -> DataFrame:
    """(id, lang, ok, reason) of every (id, content) whose name ends in one of seven extensions, one row an id.

    1. Each text is lexed to token classes (``lexing.classes``), which become rows at their brackets (``bracket_rows``).
    2. Nesting: a running count of brackets over each file's rows gives their depth; the rows of one depth are reduced to
       levels (``levels``), the tokens of one bracket pair with inner pairs shrunk to one sign. Python's blocks nest likewise.
    3. Statement productions, and what a level ends in, are checked on levels; levels repeat, so each one is read once.
    4. The adjacent tokens of each level are rows too: an anti-join with the pairs that the language's grammar permits (a
       fixed table of some thousand rows, made from rules) leaves those that no valid text has.
    5. Findings in Python and JSON are confirmed by the standard library's parsers, which only remove findings.

    What is shuffled are token classes, one byte a token. Null and empty contents are not judged; several contents of
    one id are judged each, one invalid one is enough. Null ids are dropped; the extension is compared without case.
    """
    spark = files.sparkSession
    cut = Cut(spark, "parsing")
    ext = F.lower(F.regexp_extract("id", r"\.([A-Za-z]+)$", 1))
    have = files.where(F.col("id").isNotNull() & (F.length("content") > 0)).select("id", ext.alias("lang"), F.xxhash64("id", "content").alias("f"), "content").where(F.col("lang").isin(*LANGUAGES))

    def lexed(cols):
        ids, langs, fs, texts = cols
        kinds, reasons = [], []
        for lang, t in zip(langs, texts):
            try:
                k, r = classes(t, lang), None
            except Bad as e:
                k, r = None, f"token {e}"
            kinds.append(k)
            reasons.append(r)
        return [ids, langs, fs, kinds, reasons]

    lex = cut(map_arrow(spread(have), lexed, "id string, lang string, f long, kinds string, reason string"))
    level = cut(levels(lex.where("reason is null").select("f", "lang", "kinds")))
    read = cut(read_levels(level.select("lang", "level").distinct()))
    permitted = F.broadcast(spark.createDataFrame([(lang, p) for lang in LANGUAGES for p in sorted(PERMITTED[lang])], "lang string, pair string"))
    odd = pair_rows(read).join(permitted, ["lang", "pair"], "left_anti").select("lang", "level", F.concat(F.lit("pair "), "pair").alias("fault"))
    faults = read.where("broken is not null").select("lang", "level", F.col("broken").alias("fault")).unionByName(odd).groupBy("lang", "level").agg(F.min("fault").alias("fault"))
    found = level.join(faults, ["lang", "level"]).select("f", "fault").unionByName(lex.where("reason is not null").select("f", F.col("reason").alias("fault")))
    found = cut(found.groupBy("f").agg(F.min("fault").alias("fault")))

    def stands(cols):
        fs, langs, texts = cols
        return [fs, [confirmed(t, lang) for t, lang in zip(texts, langs)]]

    again = have.where(F.col("lang").isin("py", "json")).join(found, "f", "left_semi").select("f", "lang", "content")
    cleared = map_arrow(again, stands, "f long, stands boolean").where("not stands").select("f").distinct()
    faulty = found.join(cleared, "f", "left_anti")
    rows = lex.select("id", "lang", "f").join(faulty, "f", "left")
    return rows.groupBy("id", "lang").agg(F.min("fault").alias("reason")).select("id", "lang", F.col("reason").isNull().alias("ok"), "reason")
