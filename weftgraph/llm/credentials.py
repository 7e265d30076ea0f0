"""Credentials in source text: quoted strings and long tokens, judged by entropy, shape and the name beside them."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import map_arrow, spread

#: Shortest token judged by entropy alone, and the share of the greatest entropy for its length and alphabet that it must have;
#: the share for values that a name, a phrase or an option tells, which may be short.
LEAST_TOKEN, SHARE, TOLD_SHARE = 20, 0.78, 0.6

# Words of names and placeholders, and the public formats of keys.
_SECRET_WORDS = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "token", "credential", "credentials", "cred", "creds", "auth", "authorization", "apikey", "accesskey", "login", "bearer", "jwt"}
_KEY_WORDS = {"api", "access", "signing", "encryption", "license", "private", "secret", "master", "session", "auth", "account", "storage", "service", "client", "shared", "hmac", "crypt", "ssh", "x"}
_OTHER_WORDS = {"name", "url", "uri", "path", "hint", "id", "file", "type", "length", "len", "count", "min", "max", "public", "env", "field", "label", "endpoint", "format", "pattern", "regex", "header", "expires", "expiry", "ttl"}
_HASH_WORDS = {"sha", "sha1", "sha256", "sha512", "md5", "hash", "digest", "checksum", "integrity", "commit", "rev", "revision", "etag", "fingerprint", "uuid", "guid", "trace", "request", "tenant", "correlation", "span", "icon", "image", "img", "alphabet", "charset", "cert", "certificate", "public", "pub", "resolved", "sourcemappingurl", "nonce", "crc", "tree", "blob"}
_ORDINARY = {"required", "optional", "string", "text", "number", "boolean", "invalid", "missing", "empty", "default", "basic", "digest", "wrong", "weak", "strong", "expired", "enabled", "disabled", "input", "value", "user", "username", "email", "admin", "error", "failed", "refresh", "csrf", "reset", "change", "forgot", "new", "old", "current", "confirm", "show", "hide", "must", "not", "the", "json", "form", "local", "none", "unknown"}
_PLACEHOLDERS = re.compile(
    r"""(?ix)^(?:change[_-]?me|example|dummy|todo|fixme|null|none|nil|undefined|true|false|replace[_-]?me|replace.*|your[_-].*|my[_-]?(?:password|secret|token|key)|
    placeholder|redacted|removed|hidden|secret|password|passwd|token|apikey|api[_-]key|test|sample|foo(?:bar)?|bar|baz|see\ .*|in\ .*|ask\ .*|
    [x*.\-_#0]+|<.*>|\[.*\]|\{.*\}|\$.*|%.*%?|.*\$\{.*|.*\{\{.*|.*%\(.*|@.*@|\#\{.*|env[:.(].*|vault:.*|secret:.*|ref\+.*|op://.*|file:.*|
    (?:x|\*|\.){4,}.*|.*(?:\*|x){6,}|.*(?:changeme|placeholder|example|your[_-]?key).*)$"""
)
_LOOKUP = re.compile(r"(?i)process\.env|os\.environ|getenv|import\.meta\.env|\bENV\[|config\.get|vault|secrets?manager|keyring|\$\{|\$\(|\{\{")
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"A(?:KIA|SIA)[0-9A-Z]{16}|AIza[\w-]{30,}|xox[abposr]-[\w-]{10,}|sk-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9])"
)
#: What makes a line worth judging: words (found in lower case), two digits before a symbol in one word, the option of a user, the prefix of a format.
_SIGNS = ("pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "login", "account", "bearer", "basic", "digest", "jwt", "' + '", '" + "')
_SYMBOL = re.compile(r"\d{2}[A-Za-z0-9._~-]*[!?#+$%*&^~@]")
_OPTION = re.compile(r"\s-u|--user[= \s]")
_PREFIX = re.compile(r"gh[pousr]_|github_pat_|glpat-|npm_|pypi-|[srp]k_(?:live|test)_|A(?:KIA|SIA)[0-9A-Z]|AIza|xox[abposr]-|sk-[A-Za-z0-9_-]|hf_[A-Za-z0-9]|SG\.|eyJ")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----(.*?)(?:-----END \1-----|\Z)", re.S)
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://([^\s/:@\"'<>`]*):([^\s@\"'<>`]+)@[^\s\"'<>`]")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_ASSIGN = re.compile(r"([A-Za-z_][\w.-]*)[\"']?\]?\s*(?::\s*[A-Za-z_][\w<>\[\]]*\s*(?==))?(?:=>|:=|=|:)\s*(?:[\"'`]((?:[^\"'`\\]|\\.)*)[\"'`]|([^\s,;\"'`]+))")
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token|digest|apikey)\s+([A-Za-z0-9+/_=.~-]{8,})")
_USER = re.compile(r"(?:\s-u\s*|--user[= ]\s*)[\"']?([^\s:\"']+):([^\s\"']+)")
_SAID = re.compile(r"(?i)\b(?:pass(?:word|wd)?|pwd|login|account|secret|token|credentials?)\b[^:=\n]{0,60}?(?:\bis\b|:|=)\s*(?:[\w@.-]+\s*(?:/|,|:)\s*)?([^\s,;\"'`]+)")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_STRONG = re.compile(r"(?=[^\s]*[A-Z])(?=[^\s]*[a-z])(?=[^\s]*\d{2})[A-Za-z][A-Za-z0-9._~-]{4,40}(?:[!?#+*&^%@$~]|\$[A-Za-z0-9]{1,3})\Z")
#: Classes of characters: digit, upper, lower, separator.
_KINDS = str.maketrans({c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in map(chr, range(33, 127))})
_CONSONANTS = re.compile(r"(?i)[b-df-hj-np-tv-z]{5}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BARE = re.compile(r"\s*[\"']?[A-Za-z0-9+/=]{32,}[\"']?\s*[,+]?\s*\Z")


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _alphabet(s: str) -> int:
    """Size of the smallest usual alphabet that has all of ``s``: 10, 16, 36, 62 or 64."""
    if s.isdigit():
        return 10
    if _HEX.match(s):
        return 16
    if s.isalnum():
        return 36 if s == s.upper() or s == s.lower() else 62
    return 64


def even(s: str, share: float = TOLD_SHARE) -> bool:
    """Has a value at least this share of the entropy that its length and alphabet allow."""
    return entropy(s) >= share * math.log2(max(2, min(len(s), _alphabet(s))))


def _mixed(kinds: str) -> bool:
    """Do two classes change as often as chance makes them for this mix, less 2.5 deviations."""
    n, d = len(kinds), kinds.count("d")
    p = 2 * d * (n - d) / (n * (n - 1))
    return sum(map(ne, kinds, kinds[1:])) >= (n - 1) * p - 2.5 * math.sqrt((n - 1) * p * (1 - p))


def _wordlike(s: str) -> bool:
    """Do the letters read like words: vowels as frequent as in words, and no five consonants in a row."""
    letters = [c for c in s.lower() if c.isalpha()]
    return sum(c in "aeiou" for c in letters) > 0.33 * len(letters) and not _CONSONANTS.search(s)


def random_looking(s: str) -> bool:
    """Is a token too even for words: entropy near the most that its length and alphabet allow, and its classes of characters mixed.

    The most is log2(min(length, alphabet)); short tokens repeat characters by chance, so the bound is a share of it.
    Words joined with numbers reach that share at times, but change between classes of characters seldom.
    """
    core = s.rstrip("=")
    n = len(core)
    if n < LEAST_TOKEN:
        return False
    kinds = core.translate(_KINDS)
    letters = kinds.replace("s", "")
    present = set(letters)
    if "d" not in present or len(present) < 2:
        return False
    turns = sum(map(ne, letters, letters[1:])) / (n - 1)
    if turns < (0.35 if len(present) == 3 else 0.3) and not (len(present) == 2 and core.isalnum() and _mixed(letters) and not _wordlike(core)):
        return False
    size = _alphabet(core)
    return size not in (10, 16) and even(core, SHARE)


def _name_kind(name: str) -> str:
    """``secret``, ``hash`` or ``other``, by the words of a name."""
    w = [x.lower() for x in _WORDS.findall(name) if not x.isdigit()]
    if not w:
        return "other"
    if w[-1] in _OTHER_WORDS or "public" in w:
        return "hash" if set(w) & _HASH_WORDS else "plain"
    joined = "".join(w)
    if set(w) & _SECRET_WORDS or any(a in _KEY_WORDS and b == "key" for a, b in zip(w, w[1:])) or re.search(r"(?:api|secret|access|private|license|signing|encryption)key|passw", joined):
        return "secret"
    return "hash" if set(w) & _HASH_WORDS else "other"


def _placeholder(v: str) -> bool:
    return len(set(v)) < 4 or bool(_PLACEHOLDERS.match(v) or _LOOKUP.search(v))


def _usable(v: str, quoted: bool = False) -> bool:
    """May a value beside a secret's name be one: not a placeholder, path, sentence, plain number, or word of such places.

    Without quotes a word of letters alone is taken for a name of something, not for a value.
    """
    if len(v) < 6 or " " in v or v[0] == "/" or "://" in v or _placeholder(v):
        return False
    if quoted and v.isascii() and not any(c.isdigit() for c in v):
        parts = {x.lower() for x in _WORDS.findall(v)}
        return any(c.isalpha() for c in v) and not re.search(r"[()\[\]{}<>|:;,$%\\]", v) and not parts & (_SECRET_WORDS | _KEY_WORDS | _OTHER_WORDS | _ORDINARY)
    return any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not re.fullmatch(r"[\w.]+\(.*|.*[()\[\]{}<>|].*", v)


def _basic(v: str) -> bool:
    """Is a value the base64 form of user:password."""
    try:
        user, colon, pw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(colon and user.isprintable() and pw.isprintable() and len(pw) >= 4 and not _placeholder(pw))


def _line(text: str, a: int, b: int, data: bool, found: set) -> None:
    """Adds (start, end, kind) of the credentials of the line text[a:b]."""
    line = text[a:b]
    add = lambda s, e, kind: found.add((a + s, a + e, kind))
    for m in _URL.finditer(line):
        if not _placeholder(m[2]) and len(m[2]) >= 4:
            add(m.start(2), m.end(2), "url")
    names: dict[int, str] = {}
    for m in _ASSIGN.finditer(line):
        g = 2 if m[2] is not None else 3
        kind = _name_kind(m[1])
        for p in range(m.start(g), m.end(g) + 1):
            names.setdefault(p, kind)
        v = (m[g] or "").rstrip("\r")
        if kind == "secret" and _usable(v, g == 2 and "login" not in m[1].lower()) and even(v):
            if not _UUID.match(v) or re.search(r"(?i)key|secret|token|pass", m[1]):
                add(m.start(g), m.start(g) + len(v), "named")
                # pieces of one value joined by +
                at = m.end()
                while p2 := re.compile(r"\s*\+\s*([\"'])([^\"'\n]*)\1").match(line, at):
                    add(p2.start(2), p2.end(2), "named")
                    at = p2.end()
    for m in _FORMAT.finditer(line):
        if not _placeholder(m[0]):
            add(m.start(), m.end(), "format")
    for m in _SCHEME.finditer(line):
        v = m[2]
        if m[1].lower() == "basic":
            if _basic(v):
                add(m.start(2), m.end(2), "basic")
        elif len(v) >= 16 and any(c.isdigit() for c in v) and not _placeholder(v) and (random_looking(v) or _HEX.match(v) and len(v) >= 32):
            add(m.start(2), m.end(2), "scheme")
    for m in _USER.finditer(line):
        if _usable(m[2]) and even(m[2]):
            add(m.start(2), m.end(2), "user")
    for m in _SAID.finditer(line):
        v = m[1].rstrip(".)")
        if _usable(v) and (_STRONG.match(v) or random_looking(v)):
            add(m.start(1), m.start(1) + len(v), "said")
    for m in _QUOTED.finditer(line):
        g = m.lastindex
        v = m[g]
        if v and 8 <= len(v) <= 48 and _STRONG.match(v) and not _placeholder(v):
            add(m.start(g), m.end(g), "strong")
    if data:
        return
    for m in _LONG.finditer(line):
        v = m[0]
        s = m.start()
        kind = names.get(s, "other")
        if kind == "hash":
            continue
        before = line[max(0, s - 60) : s]
        if "base64," in before[-24:] or re.search(r"(?i)sha\d{1,3}[-:]$", before) or re.match(r"(?i)sha\d{3}-", v) or "data:" in before[-40:]:
            continue
        if "abcdefgh" in v.lower() or "0123456789" in v or _UUID.match(v) or _placeholder(v):
            continue
        if "=" in v.rstrip("=") and not v.startswith("="):
            head, _, tail = v.partition("=")
            if _name_kind(head) == "hash":
                continue
            s, v = s + len(head) + 1, tail
        tail = v.rpartition("/")[2] if line[max(0, m.start() - 1) : m.start()] in ("/", ".") or "://" in before else v
        if random_looking(tail):
            add(m.end() - len(tail), m.end(), "entropy")
    if "' + '" in line or '" + "' in line:
        for m in re.finditer(r"([\"'])([A-Za-z0-9+/_=-]{8,})\1(?:\s*\+\s*\1([A-Za-z0-9+/_=-]{8,})\1)+", line):
            parts = list(re.finditer(r"[\"']([A-Za-z0-9+/_=-]{8,})[\"']", m[0]))
            if names.get(m.start(2), "other") != "hash" and random_looking("".join(p[1] for p in parts)):
                for p in parts:
                    add(m.start() + p.start(1), m.start() + p.end(1), "entropy")


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(line, start, end, kind) of every credential of a text; spans do not overlap and are in order.

    Kinds: ``key`` (private key block), ``url``, ``named``, ``format``, ``basic``, ``scheme``, ``user``, ``said``,
    ``strong`` and ``entropy``.
    """
    if not text:
        return []
    found: set[tuple[int, int, str]] = set()
    skip: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in _BLOCK.finditer(text):
            skip.append(m.span())
            if "PRIVATE KEY" in m[1]:
                body = m[2].replace("\\n", "")
                if sum(c.isalnum() for c in body) >= 40 and len(set(body)) > 12 and not _LOOKUP.search(body):
                    found.add((m.start(), m.end(), "key"))
    k = until = 0
    for a in sorted(_lines(text)):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        while k < len(skip) and skip[k][1] <= a:
            k += 1
        if k < len(skip) and skip[k][0] < b:
            # what stands before a block on its line is judged, the block is not
            b = max(a, skip[k][0])
        if b - a >= 8:
            if a >= abs(until):
                until = _data_until(text, a, b)
            _line(text, a, b, until > a, found)
    out, end, line, at = [], -1, 1, 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s < end:
            continue
        line += text.count("\n", at, s)
        at, end = s, e
        out.append((line, s, e, kind))
    return out


def _lines(text: str) -> set[int]:
    """Where the lines begin that hold a sign of a credential: a superset of those in which a rule finds one.

    Each rule has its sign: a name or word (named, scheme, said), the option of a user, a digit pair with a later symbol
    (strong), an address, a prefix of a format or a long token (entropy, also of joined pieces).
    """
    out: set[int] = set()
    low = text.lower()
    if len(low) != len(text):  # some letters change length: then only what stays in place is lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for sign in _SIGNS:
        p = low.find(sign)
        while p >= 0:
            out.add(text.rfind("\n", 0, p) + 1)
            p = low.find(sign, p + len(sign))
    for signs in (_SYMBOL, _PREFIX, _OPTION):
        for m in signs.finditer(text):
            out.add(text.rfind("\n", 0, m.start()) + 1)
    if "://" in text:
        for m in _URL.finditer(text):
            out.add(text.rfind("\n", 0, m.start()) + 1)
    for m in _LONG.finditer(text):
        t = m[0]
        if not t.isalpha() and (random_looking(t) or "/" in t and random_looking(t.rpartition("/")[2]) or "=" in t and (random_looking(v := t.partition("=")[2]) or "/" in v and random_looking(v.rpartition("/")[2]))):
            out.add(text.rfind("\n", 0, m.start()) + 1)
    return out


def _data_until(text: str, a: int, b: int) -> int:
    """Where the lines of literals end that the line text[a:b] begins or continues, negative if they are no embedded data; 0 outside of such.

    Data are three or more lines that hold nothing but a literal, long and all as wide but for the last: one value in
    lines. Literals between commas are a list, such as one of keys, unless they are joined.
    """
    if not _BARE.match(text, a, b):
        return 0
    while a and _BARE.match(text, p := text.rfind("\n", 0, a - 1) + 1, a - 1):
        a = p
    lines, p = [], a
    while p < len(text):
        e = text.find("\n", p)
        e = len(text) if e < 0 else e
        if not _BARE.match(text, p, e):
            break
        lines.append(text[p:e].strip())
        p = e + 1
    widths = [len(x.rstrip(" ,+").strip("\"'")) if x[0] in "\"'" else len(x.rstrip(",")) for x in lines]
    one = len(widths) >= 3 and widths[0] >= 60 and len(set(widths[:-1])) == 1 and widths[-1] <= widths[0]
    listed = lines[0].endswith(",") and not re.match(r"[^\n]*\b(?:join|concat)\b", text[p : p + 200])
    return p if one and not listed else -p


def redact(text: str | None) -> str | None:
    """``text`` with each character of its credentials replaced by ``x``: quotes, escapes, blanks, line ends and lengths stay.

    A letter has no meaning in any notation, so JSON, YAML, shell and code that could be read before can be read after.
    """
    return _masked(text)[0]


def _masked(text: str | None) -> tuple[str | None, int]:
    if not text:
        return text, 0
    parts, at, found = [], 0, find(text)
    for _, s, e, kind in found:
        parts.append(text[at:s])
        got = text[s:e]
        if kind == "key":
            head, tail = re.match(r"-----BEGIN [A-Z0-9 ]*-----", got)[0], re.search(r"(?:-----END [A-Z0-9 ]*-----)?\Z", got)[0]
            body = got[len(head) : len(got) - len(tail)]
            parts.append(head + re.sub(r"\\[nrt]|[A-Za-z0-9+/=]", lambda m: m[0] if m[0][0] == "\\" else "x", body) + tail)
        else:
            parts.append(re.sub(r"(\\.)|[^\s\"'`\\]", lambda m: m[1] or "x", got))
        at = e
    parts.append(text[at:])
    return "".join(parts), len(found)


def credentials(files: DataFrame) -> DataFrame:
    """(id, line, kind, start, length, entropy, alphabet) of every credential of (id, content), one row each for distinct rows.

    ``entropy`` is that of its characters in bits, ``alphabet`` the size of the smallest usual alphabet that has them all.

    Lines count from 1 and end at \\n; a credential over several lines counts at its first. ``start`` counts characters
    of the content from 0. Null and empty contents and null ids give no rows; repeated rows give one. Work is one pass
    over each text in the partition that reads it; only findings are shuffled.
    """

    def fn(cols):
        ids, texts = cols
        rows = [(i, *f, round(entropy(v := t[f[1] : f[2]]), 6), _alphabet(v)) for i, t in zip(ids, texts) for f in find(t)]
        if not rows:
            return None
        i, line, s, e, kind, bits, size = zip(*rows)
        return [pa.array(i), pa.array(line, pa.int64()), pa.array(kind), pa.array(s, pa.int32()), pa.array([y - x for x, y in zip(s, e)], pa.int32()), pa.array(bits), pa.array(size, pa.int32())]

    have = files.select("id", "content").where(F.col("id").isNotNull() & (F.length("content") > 0))
    return map_arrow(spread(have), fn, "id string, line long, kind string, start int, length int, entropy double, alphabet int").distinct()


def redacted(files: DataFrame) -> DataFrame:
    """(id, content, n_masked) for every row of (id, content): the content with its credentials masked, all else unchanged."""

    def fn(cols):
        ids, texts = cols
        return [ids, *zip(*[_masked(t) for t in texts])]

    return map_arrow(spread(files.select("id", "content")), fn, "id string, content string, n_masked int")
