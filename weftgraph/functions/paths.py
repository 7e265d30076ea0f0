"""Path and URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The conventions of paths by which files are told apart.
TEST_PATH = r"(?i)(?:^|/)(?:__tests__|test|tests|spec|e2e)/|\.(?:test|spec)\.[a-z]+$"
CONFIG_PATH = r"(?i)\.(?:json|ya?ml|toml|env|config|conf|ini|lock)(?:\.\w+)?$|^\.[a-z]+rc"
DOC_PATH = r"(?i)\.(?:md|mdx|txt|rst|adoc)$"
NOT_CODE = r"(?i)\.(?:md|mdx|rst|json|ya?ml|toml|html?|css|scss|sass|less)$"
BACKEND_PATH = r"^(?:src/)?(?:app/api|api|server|backend|routes|controllers|handlers)(?:/|$)"
FRONTEND_PATH = r"^(?:src/)?(?:app|pages|components|ui|screens|views|widgets|public|styles)(?:/|$)"
FRONTEND_EXT = r"(?i)\.(?:tsx|jsx|vue|svelte|astro|css|scss|sass|less|html|htm)$"
BACKEND_EXT = r"(?i)\.(?:py|pyi|rb|php|go|java|kt|rs|cs|swift)$"
PUBLIC_ENV = r"^(?:NEXT_PUBLIC|VITE|REACT_APP|PUBLIC|EXPO_PUBLIC|NUXT_PUBLIC|GATSBY|STORYBOOK)_"
STYLE_EXT = r"(?i)\.(?:css|scss|sass|less|html|htm)$"
IGNORED_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", ".next", ".nuxt", ".turbo", ".vercel", ".svelte-kit",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "venv", ".venv", "env", "site-packages", ".tox", "target",
    ".cache", ".parcel-cache", ".idea", ".vscode", ".DS_Store", "coverage", ".nyc_output", ".obsidian", ".logseq", ".foam",
    "Pods", "DerivedData", ".gradle", "vendor",
)
IGNORED_PREFIX = r"^(?:\.venv|venv-|\.env-py)"
DOC_EXTS = ("md", "mdx", "markdown", "rst", "txt", "adoc")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirs(path) -> Column:
    """The directories of a path, outermost first."""
    parts = F.split(_col(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(ext, path) -> Column:
    """A file's extension in lower case without dot; where the column has none, that of the name."""
    given = F.nullif(F.regexp_replace(F.lower(_col(ext)), r"^\.+", ""), F.lit(""))
    return F.coalesce(given, F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1)))


def ignored(path) -> Column:
    """Does any directory of the path belong to tools or dependencies."""
    return F.exists(dirs(path), lambda d: d.isin(*IGNORED_DIRS) | d.rlike(IGNORED_PREFIX))


def is_test(path) -> Column:
    return _col(path).rlike(TEST_PATH)


def path_category(path, ext) -> Column:
    """tests, config, docs, source or other; the first that holds."""
    p = _col(path)
    return (
        F.when(p.rlike(TEST_PATH), "tests").when(p.rlike(CONFIG_PATH), "config").when(p.rlike(DOC_PATH), "docs")
        .when(F.coalesce(_col(ext), F.lit("")) != "", "source").otherwise("other")
    )


def side(path) -> Column:
    """frontend, backend or shared, by path and then by extension."""
    p, low = _col(path), F.lower(_col(path))
    return (
        F.when(low.rlike(BACKEND_PATH), "backend").when(low.rlike(FRONTEND_PATH), "frontend")
        .when(p.rlike(FRONTEND_EXT), "frontend").when(p.rlike(BACKEND_EXT), "backend").otherwise("shared")
    )


def logical_name(path) -> Column:
    """The base name without extension and without markers of age, in lower case."""
    base = base_name(path)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.lower(F.regexp_replace(stem, r"(?i)[._-](?:old|legacy|deprecated|backup|bak|orig|copy\d*|v\d+)$", ""))


def url_path(url) -> Column:
    """Path of a URL or of a path: without scheme, host, query, fragment and trailing slash; empty means /."""
    p = F.regexp_replace(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    p = F.regexp_replace(F.regexp_replace(p, r"[?#].*$", ""), r"/+$", "")
    return F.when(p == "", "/").when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^(?i:https?|wss?)://([^/:?#]+)", 1))


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^((?i:https?|wss?))://", 1))


def route_regex(path) -> Column:
    """Pattern that a route's path matches: ``:id``, ``{id}`` and ``<id>`` stand for one segment, ``*`` for any rest."""
    p = F.regexp_replace(_col(path), r"[.+^$()|\[\]\\]", r"\\\\$0")
    p = F.regexp_replace(p, r":[A-Za-z_]\w*|\{[^/}]*\}|<[^/>]*>", "[^/]+")
    return F.concat(F.lit("^"), F.regexp_replace(p, r"\*", ".*"), F.lit("$"))


def page_route(path) -> Column:
    """URL that a page file serves under file-system routing; null for other files."""
    p = _col(path)
    app = F.regexp_extract(p, r"^(?:src/)?app/(.+)/page\.(?:tsx|jsx|ts|js|mdx)$", 1)
    pages = F.regexp_extract(p, r"^(?:src/)?pages/(.+)\.(?:tsx|jsx|ts|js|mdx|astro|md)$", 1)
    kit = F.regexp_extract(p, r"^(?:src/)?routes/(.+)/\+page\.(?:svelte|js|ts)$", 1)
    own = F.regexp_replace(F.regexp_replace(pages, r"/index$", ""), r"^index$", "")
    url = (
        F.when(app != "", F.concat(F.lit("/"), app))
        .when(p.rlike(r"^(?:src/)?app/page\.(?:tsx|jsx|ts|js|mdx)$"), "/")
        .when((pages != "") & ~pages.isin("_app", "_document") & ~F.startswith(pages, F.lit("api/")), F.concat(F.lit("/"), own))
        .when(kit != "", F.concat(F.lit("/"), kit))
        .when(p.rlike(r"^(?:src/)?routes/\+page\.(?:svelte|js|ts)$"), "/")
    )
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"/\([^)]+\)/", "/"), r"^/\([^)]+\)", ""), r"/\([^)]+\)$", "")
    url = F.regexp_replace(F.regexp_replace(url, r"\[\.\.\.(\w+)\]", "*"), r"\[(\w+)\]", ":$1")
    return F.when(url == "", "/").otherwise(url)


def server_route(path) -> Column:
    """(method, url) that a server file serves under file-system routing; null for other files.

    Route handlers and ``pages/api`` serve ANY method, as ``+server`` files do; a suffix of the name (``x.get.ts``) tells one method.
    """
    p = _col(path)
    ends = r"\.(?:ts|js|mjs|tsx|jsx)$"
    app = F.regexp_extract(p, r"^(?:src/)?app/(.+)/route" + ends, 1)
    pages = F.regexp_extract(p, r"^(?:src/)?pages/(api(?:/.+)?)" + ends, 1)
    kit = F.regexp_extract(p, r"^(?:src/)?routes/(.+)/\+server" + ends, 1)
    nitro = F.regexp_extract(p, r"^(?:server/)(?:(api/.+?)|routes/(.+?))(?:\.(?:get|post|put|patch|delete|head|options))?" + ends, 1)
    bare = F.regexp_extract(p, r"^server/routes/(.+?)(?:\.(?:get|post|put|patch|delete|head|options))?" + ends, 1)
    method = F.upper(F.regexp_extract(p, r"^server/.*\.(get|post|put|patch|delete|head|options)" + ends, 1))
    own = F.coalesce(*[F.nullif(x, F.lit("")) for x in (app, pages, kit, nitro, bare)])
    url = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), own), r"/\([^)]+\)", ""), r"/index$", "")
    url = F.regexp_replace(F.regexp_replace(url, r"\[\.\.\.(\w*)\]", "*"), r"\[(\w+)\]", ":$1")
    return F.when(own.isNotNull(), F.struct(F.when(method != "", method).otherwise("ANY").alias("method"), F.when(url == "", "/").otherwise(url).alias("url")))


def glob_regex(pattern: str) -> str:
    """Pattern of a glob: ``**`` any directories, ``*`` within a segment, ``?`` one character."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern, ignored) of the lines of an ignore file, in order: the last that matches a path decides."""
    rules = []
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        keep = s.startswith("!")
        s = s[1:] if keep else s
        only_dir, anchored = s.endswith("/"), s.startswith("/")
        s = s.strip("/")
        head = "^" if anchored or "/" in s else "(?:^|/)"
        rules.append((head + glob_regex(s) + ("/" if only_dir else "(?:/|$)"), not keep))
    return rules


def ignored_by(path, rules: list[tuple[str, bool]]) -> Column:
    """Is a path ignored under rules of which the last match wins."""
    out = F.lit(False)
    for pattern, state in rules:
        out = F.when(_col(path).rlike(pattern), F.lit(state)).otherwise(out)
    return out
