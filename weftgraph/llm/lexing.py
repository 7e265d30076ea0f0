"""Lexers of seven languages: a text becomes a string of token classes, one character a token.

Classes (the same in every language as far as it has them):

    i name            n number         s string, character, template or regular expression
    k name-like keyword that ends an operand (this, null, true, ...)
    w word that may be a name or a modifier (async, static, type, unsigned, ...)
    d word that starts a declaration or statement    r word that wants an operand (return, new, typeof, ...)
    q infix word (in, of, instanceof, and, ...)      e word that follows a block or header (else, finally, ...)
    h word before a bracketed header (if, while, ...)
    ( ) [ ] { }  and  ; , . : ? @ #   stand for themselves
    D, R  declaring and returning words that no operator comes before
    = assignment      o infix operator (O where < and > are told apart, for they may enclose types)    + infix or prefix operator    ! prefix operator    u ++ or --
    > arrow           E spread or ellipsis    N line end where it can end a statement
    ` and ~ enclose a block of Python
    a compound assignment; words that productions tell apart have a class of their own (``COARSE`` gives the common one)
"""

from __future__ import annotations

import re

LANGUAGES = ("py", "js", "ts", "go", "java", "c", "json")


class Bad(Exception):
    """A text that cannot be lexed: an unterminated literal or comment, or a character outside the language."""


def _words(**classes: str) -> dict[str, str]:
    return {w: c for c, ws in classes.items() for w in ws.split()}


# The reserved and contextual words of each language by class.
_JS = _words(
    k="this null true false super undefined",
    w="async get set static as type namespace declare readonly public private protected abstract override module is satisfies keyof unique infer asserts accessor using",
    f="from", j="of", l="enum", W="interface", L="let",
    I="import", F="function", c="class",
    C="const", V="var", X="export",
    r="new typeof void delete await yield extends implements",
    R="throw case", Y="return", Z="default",
    q="instanceof", m="in",
    e="else catch finally",
    h="if for while switch with",
    b="do try break continue debugger",
)
WORDS = {
    "js": _JS,
    "ts": _JS,
    "go": _words(
        k="nil true false iota",
        P="package",
        d="import func type var const struct interface map chan",
        r="return go defer case default range select goto for switch break continue fallthrough",
        g="if", y="else",
    ),
    "java": _words(
        k="this null true false super",
        w="public private protected static final abstract synchronized native transient volatile strictfp default sealed record var",
        p="int long short byte char boolean float double void",
        d="class interface enum package import",
        r="new assert case extends implements throws",
        Y="return", J="throw yield", U="break continue",
        q="instanceof",
        e="catch finally", y="else",
        h="if for while switch",
        b="do try",
    ),
    "c": _words(
        w="const static extern inline register volatile restrict unsigned signed int long short char float double void auto _Bool bool struct union enum",
        d="typedef",
        r="case default sizeof",
        Y="return", J="goto", U="break continue",
        y="else",
        h="if for while switch",
        b="do",
    ),
    "py": _words(
        k="None True False",
        w="type _", M="match", K="case",
        F="def", c="class", I="import", f="from",
        d="global nonlocal",
        r="return raise del assert yield await not pass break continue",
        X="except", L="lambda", v="with",
        q="is and or", m="in",
        e="as", y="else", x="elif", z="finally", t="try",
        g="if", l="for", p="while", A="async",
    ),
    "json": _words(k="true false null"),
}
#: Fine classes, which productions tell apart, and the class that they have as a pair's member.
_COARSE_JS = {"f": "w", "j": "w", "l": "w", "W": "w", "L": "w", "I": "d", "F": "d", "c": "d", "C": "D", "V": "D", "X": "D", "Y": "R", "Z": "R", "m": "q", "a": "="}
COARSE = {
    "js": _COARSE_JS,
    "ts": _COARSE_JS,
    "go": {"P": "d", "g": "r", "y": "r", "a": "="},
    "java": {"p": "w", "Y": "r", "J": "r", "U": "b", "y": "e", "a": "="},
    "c": {"Y": "r", "J": "r", "U": "b", "y": "e", "a": "="},
    "py": {"M": "w", "K": "w", "F": "d", "c": "d", "I": "d", "f": "d", "X": "r", "L": "r", "v": "r", "m": "q", "y": "e", "x": "e", "z": "e", "t": "e", "g": "h", "l": "h", "p": "h", "A": "h", "a": "=", "`": "N", "~": "N"},
    "json": {},
}

_NUM = r"0[xX][0-9a-fA-F_]+[uUlLn]*|0[bB][01_]+n?|0[oO]?[0-7_]+(?![\d.eE])[uUlLn]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[uUlLfFdDnj]*"
_DQ, _SQ = r"\"(?:[^\"\\\n]|\\.|\\\n)*\"", r"'(?:[^'\\\n]|\\.|\\\n)*'"
_SPACE = r"[ \t\r\f\v﻿\xa0]+"
_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_NAME = r"[A-Za-z_$ª-￿][\w$]*"
_PUNCT = {
    "js": r">>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|<<=|>>=|\.\.\.|=>|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|<<|\*\*|[-+*/%&|^~!<>=?:;,.(){}\[\]@#]",
    "go": r"&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&\^|<<|>>|[-+*/%&|^!<>=:;,.(){}\[\]~]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^~!<>=?:;,.(){}\[\]@]",
    "c": r"<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\#\#|[-+*/%&|^~!<>=?:;,.(){}\[\]\#]",
    "py": r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^~<>=:;,.(){}\[\]@]",
    "json": r"[-,:{}\[\]]",
}
_CLASS = {p: p for p in "()[]{};,.:?@#"} | {"...": "E", "=>": ">", "->": ">", "++": "u", "--": "u", "!": "!", "~": "!", "+": "+", "-": "+", "?.": ".", "::": ".", "##": "o"}
_TOKEN: dict[str, re.Pattern] = {}
for _lang, _extra in (
    ("js", rf"({_C_COMMENT})|(\n)|({_DQ}|{_SQ})"),
    ("go", rf"({_C_COMMENT})|(\n)|({_DQ}|{_SQ}|`[^`]*`)"),
    ("java", rf"({_C_COMMENT})|(\n)|(\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|{_DQ}|{_SQ})"),
    ("c", rf"({_C_COMMENT}|(?<![^\n])[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)|(\n)|((?:[LuU]|u8)?(?:{_DQ}|{_SQ}))"),
    ("py", rf"(\#[^\n]*|\\\r?\n)|(\n)|((?:[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|(?!\"\"\"|''')(?:{_DQ}|{_SQ})))"),
    ("json", r"(?!)()|(\n)|(\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")"),
):
    _num = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?" if _lang == "json" else _NUM
    _TOKEN[_lang] = re.compile(rf"(?:{_SPACE})?(?:{_extra}|({_NAME})|({_num})|({_PUNCT[_lang]})|(\Z))", re.S)
_TOKEN["ts"] = _TOKEN["js"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BLANKS = re.compile(rf"(?:{_SPACE})?")
_CONFLICT = re.compile(r"(?:<{7}|>{7}|={7})(?![<>=])")
_DIRECTIVE = re.compile(r"\s*#\s*(?:include\s*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)|define\s+[A-Za-z_]\w*|undef\s+[A-Za-z_]\w*|(?:if|elif|ifdef|ifndef)\s*\S|else\b|endif\b|pragma\b|error\b|warning\b|line\b|embed\b|$)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_ENDS = {lang: set("insk)]}uw") | {f for f, g in COARSE[lang].items() if g in "iknsw"} for lang in LANGUAGES}
_SIGN = {"js": "+-*<", "ts": "+-*<", "go": "+-*&^<", "java": "+-", "c": "+-*&", "py": "+-*", "json": ""}
_SPLIT, _LINED = ("js", "ts", "java", "c"), ("js", "ts", "go", "py")
_MARKER = re.compile(r"^(?:<{7}|>{7}|={7})(?![<>=])", re.M)
#: What a token that is no word may begin with in the table of seen tokens, and the class of what does not fit.
_NO, _QUOTES = "\x00", "\"'`"


def _operator(t: str, lang: str) -> str:
    c = _CLASS.get(t)
    if c is not None:
        return c
    if t[-1] == "=" and t not in ("==", "===", "!=", "!==", "<=", ">="):
        return "=" if t in ("=", ":=") and lang != "py" or t == "=" else "a"
    return "+" if t in _SIGN[lang] else "O" if lang in _SPLIT and t not in "<>" else "o"


class _Seen(dict):
    """Class of a token by its text. Words and operators are remembered; literals and comments are told by how they begin."""

    def __init__(self, lang: str):
        self.lang, self.lined = lang, lang in _LINED
        self.update(WORDS[lang])

    def __missing__(self, t: str) -> str:
        lang, a = self.lang, t[:1]
        if not a:
            return ""
        if a == "\n":
            return "N" if self.lined else ""
        if lang == "c" and t.lstrip()[:1] == "#" and t != "##":
            return "" if _DIRECTIVE.match(t) else _NO
        if a == "/" and t[:2] in ("//", "/*"):
            return "N" if lang in ("js", "ts") and "\n" in t else ""
        if lang in ("js", "ts") and a in _BEFORE and len(t) > 3 and t[1:].lstrip()[:1] == "/":
            return self[a] + "s"
        if a == "#" and lang == "py" or a == "\\" and len(t) > 1:
            return ""
        if t[-1] in _QUOTES and len(t) > 1:
            return "s"
        if a.isdigit() or a == "." and len(t) > 1 and t[1].isdigit() or a == "-" and lang == "json" and len(t) > 1:
            return "n"
        if a == "_" or a == "$" or a <= "\uffff" and (a.isalpha() or a > "\x7f"):
            if len(self) < 60_000:
                self[t] = "i"
            return "i"
        if t in ("/", "/=", "`") and lang in ("js", "ts"):
            return _NO
        c = _operator(t, lang) if t in _KNOWN[lang] else _NO
        self[t] = c
        return c


_KNOWN = {lang: frozenset(re.sub(r"\\(.)", r"\1", x) for x in re.split(r"(?<!\\)\|", _PUNCT[lang].rpartition("|[")[0])) | frozenset(re.sub(r"\\(.)", r"\1", _PUNCT[lang].rpartition("|[")[2][:-1])) for lang in _PUNCT}
_KNOWN["json"] = frozenset("-,:{}[]")
for _lang in ("js",):
    _KNOWN[_lang] |= {"?.", "||", "|", "|=", "||="}
for _lang in ("go", "java", "c", "py"):
    _KNOWN[_lang] |= {"||", "|", "|="}
_KNOWN["ts"] = _KNOWN["js"]
_SEEN = {lang: _Seen(lang) for lang in LANGUAGES}
#: Signs after which a slash begins a regular expression.
_BEFORE = "(,=:[!&|?{};+*%~^<>"
_REGEX_AFTER = rf"[{re.escape(_BEFORE)}][ \t]*{_REGEX.pattern}"
_LINE_END = r"\n(?:[ \t\f\r]*(?:\#[^\n]*)?\n)*[ \t\f]*"
_FAST: dict[str, re.Pattern] = {}
for _lang in LANGUAGES:
    _base = "js" if _lang == "ts" else _lang
    _inner = _TOKEN[_base].pattern
    _inner = _inner[_inner.index(")?(?:") + 5 : _inner.rindex("|(\\Z))")]
    if _base == "py":
        _inner = _inner.replace(r"|(\n)|", rf"|({_LINE_END})|", 1)
    if _base == "js":
        _inner = rf"{_REGEX_AFTER}|" + _inner + rf"|(`[^`\\$]*(?:(?:\\.|\$(?!\{{)|\$\{{(?:[^{{}}`\"']|{_DQ}|{_SQ})*\}})[^`\\$]*)*`)"
    # groups of the exact pattern become plain alternatives of one group, so a text is one call
    _plain = re.sub(r"(?<!\\)\((?!\?)", "(?:", _inner)
    _num_end = r"(?!\w)" if _base != "c" else ""
    _plain = _plain.replace(f"(?:{_NUM})", f"(?:{_NUM}){_num_end}", 1)
    # most tokens are names: they are tried first, but for the prefixes of strings
    _FAST[_lang] = re.compile(rf"(?:{_SPACE})?({_NAME}(?![\w$\"'])|{_plain}|.)", re.S)


def _fast(text: str, lang: str) -> list[tuple[str, str]] | None:
    """Tokens by one call of the pattern; None where a text needs the exact way (what a slash or a brace means, or an error)."""
    tokens = _FAST[lang].findall(text)
    # a marker in a comment is none: outside of one its signs come as equal operators
    if _MARKER.search(text) and any(a == b and a[-1:] in "<>=" for a, b in zip(tokens, tokens[1:]) if a):
        return None
    kinds = list(map(_SEEN[lang].__getitem__, tokens))
    if _NO in kinds and lang in ("js", "ts"):
        ends, prev = _ENDS[lang], ""
        for k, c in enumerate(kinds):
            if c == _NO:
                # an operand before a slash makes it a division
                if tokens[k] not in ("/", "/=") or prev[-1:] not in ends or not prev:
                    return None
                kinds[k] = c = _operator(tokens[k], lang)
            prev = c or prev
    return None if _NO in kinds else list(zip(kinds, tokens)) if lang == "py" else kinds


def _blocks(tokens: list[tuple[str, str]], text: str) -> str:
    """Class string of Python tokens: line ends inside brackets vanish, a deeper line opens a block and the next shallower one closes it.

    A line's indentation counts with tabs to multiples of eight and with tabs as one blank; both must tell the same.
    """
    first = re.match(r"(?:[ \t\f\r]*(?:\#[^\n]*)?\n)*([ \t\f]*)", text.removeprefix("\ufeff"))
    out, depth, levels = [], 0, [(0, 0)]

    def line(lead: str) -> None:
        lead = lead.rpartition("\f")[2]
        at = (len(lead.expandtabs(8)), len(lead))
        if at[0] == levels[-1][0]:
            if at[1] != levels[-1][1]:
                raise Bad("tabs")
        elif at[0] > levels[-1][0]:
            if at[1] <= levels[-1][1]:
                raise Bad("tabs")
            levels.append(at)
            out.append("`")
        else:
            while at[0] < levels[-1][0]:
                levels.pop()
                out.append("~")
            if at != levels[-1]:
                raise Bad("indentation")

    n = len(tokens)
    started = False
    for k, (c, t) in enumerate(tokens):
        if c == "N":
            if depth == 0 and started:
                out.append("N")
                if k + 1 < n and any(x for x, _ in tokens[k + 1 : k + 3]):
                    line(t.rpartition("\n")[2])
        elif c:
            if not started:
                started = True
                line(first[1])
            out.append(c)
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
    if out and out[-1] not in "N~":
        out.append("N")
    out.extend("~" * (len(levels) - 1))
    return "".join(out)


def _template(text: str, pos: int) -> int:
    """End of the template literal whose inside begins at ``pos``."""
    n = len(text)
    while True:
        pos = _TEMPLATE.match(text, pos).end()
        if pos >= n:
            raise Bad("template")
        if text[pos] == "`":
            return pos + 1
        pos += 2
        depth = 1
        while depth:
            if pos >= n:
                raise Bad("template")
            c = text[pos]
            if c == "`":
                pos = _template(text, pos + 1)
                continue
            if c in "\"'":
                m = (_DQ_RE if c == '"' else _SQ_RE).match(text, pos)
                if not m:
                    raise Bad("string")
                pos = m.end()
                continue
            depth += (c == "{") - (c == "}")
            pos += 1


_DQ_RE, _SQ_RE = re.compile(_DQ), re.compile(_SQ)


def lex(text: str, lang: str) -> list[tuple[str, str]]:
    """(class, text) of the tokens; line ends are kept as N where the language gives them a meaning, comments are dropped.

    Raises ``Bad`` where no token of the language begins.
    """
    token, words, ends = _TOKEN[lang], WORDS[lang], _ENDS[lang]
    out: list[tuple[str, str]] = []
    pos, n, js, prev = 0, len(text), lang in ("js", "ts"), ""
    lined = lang in _LINED
    match, put = token.match, out.append
    while pos < n:
        m = match(text, pos)
        if m is None:
            if js:
                at = _BLANKS.match(text, pos).end()
                if text[at : at + 1] == "`":
                    prev, pos = "s", _template(text, at + 1)
                    put(("s", "`"))
                    continue
            raise Bad(repr(text[pos : pos + 10]))
        g, pos = m.lastindex, m.end()
        t = m[g]
        if g == 4:
            c = words.get(t, "i")
        elif g == 6:
            if t in "<>=" or t[0] in "<>=":
                start = m.start(g)
                if _CONFLICT.match(text, start) and (start == 0 or text[start - 1] == "\n"):
                    raise Bad("conflict marker")
            if js and t in ("/", "/=") and prev not in ends:
                r = _REGEX.match(text, m.start(g))
                if not r:
                    raise Bad("regex")
                c, pos, t = "s", r.end(), "/"
            else:
                c = _operator(t, lang)
        elif g == 2:
            if not lined:
                continue
            if lang == "py":
                e = _LINE_RE.match(text, m.start(2))
                c, t, pos = "N", e[0], e.end()
            elif prev == "N":
                continue
            else:
                c, t = "N", "\n"
        elif g == 3:
            c = "s"
        elif g == 5:
            c = "n"
            if pos < n and (text[pos].isalnum() or text[pos] == "_") and lang != "c":
                raise Bad("number")
        elif g == 1:
            if lang == "c" and t.lstrip()[:1] == "#" and not _DIRECTIVE.match(t):
                raise Bad("directive")
            if js and "\n" in t and prev != "N":
                prev = "N"
                put(("N", "\n"))
            continue
        else:
            break
        prev = c
        put((c, t))
    return out


_LINE_RE = re.compile(_LINE_END)


def classes(text: str, lang: str) -> str:
    """The token classes of a text, one character a token; raises ``Bad`` where the text cannot be lexed."""
    if text.startswith("```"):
        raise Bad("fence")
    got = _fast(text, lang)
    if lang == "py":
        return _blocks(lex(text, lang) if got is None else got, text)
    return "".join([c for c, _ in lex(text, lang)] if got is None else got)
