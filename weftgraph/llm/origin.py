"""Source files that nobody wrote in their repository: generated, minified, bundled, vendored, or data under a code extension."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.batches import map_arrow, spread
from weftgraph.session import Cut, small

#: A file is a copy of another if it holds at least this share of its counted lines; a line is rare in at most so many
#: files (a share of all files, or this number where that is more); shortest line that counts, and lines a file must have.
CONTAINED, COMMON_SHARE, COMMON_LEAST, LINE, FEWEST = 0.8, 0.01, 8, 12, 5
#: A file whose content was not kept is no one's handwriting from this size in bytes on.
TOO_LARGE = 1_000_000

# Conventions of directories and names that tools use.
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "externals", "deps", "pods", "carthage", "jspm_packages", "site-packages")
OUTPUT_DIRS = ("dist", "build", "generated", "__generated__", "gen", "autogen", "__pycache__")
OUTPUT_NAME = r"(?i)(?:[.\-](?:min|bundle|prod|chunk|pack|packed)\.[a-z]+|\.(?:pb|pb-c|gen|generated|g|designer|pb\.gw)\.[a-z]+|_pb2?(?:_grpc)?\.[a-z]+|_generated\.[a-z]+|[a-z0-9](?:Grpc|OuterClass|_grpc)\.[a-z]+)$"
LOCK_NAME = r"(?i)^(?:(?:package|composer|packages|pnpm|flake|deno)[-.]lock(?:\.(?:json|ya?ml))?|npm-shrinkwrap\.json|.*\.lock|go\.sum|.*\.lockb|.*[-.]lock\.(?:json|ya?ml|toml))$"
CODE = ("py", "js", "ts", "go", "java", "c", "h", "jsx", "tsx", "mjs", "cjs", "cpp", "cc", "hpp", "rb", "rs", "cs", "kt", "swift", "php", "scala", "css", "sh")

_COMMENT = re.compile(r"\s*(?://+|#+|/\*+!?|\*+|<!--|--+|;+|\"\"\"|''')\s*(.*)")
#: What a comment may begin with.
_OPENS = frozenset("/#*<-;\"'")
_TOOL = re.compile(
    r"(?i)(?:@generated\b|auto-?generated\b|(?:this )?(?:code|file|module|source)?(?: is| was|:)?\s*(?:auto-?generated|automatically generated|machine generated|generated by)\b|code generated\b|"
    r"machine[- ](?:written|generated|made)|generator: ?\S|generated (?:by|from|with|using) \S+|produced by (?:the )?.*(?:compiler|generator)|automati(?:sch|quement|camente) |"
    r"end of (?:the )?(?:output|file generated)|(?:eof|end)[, ]+(?:emitted|generated|written) by|output of \S|emitted by \S|compiled (?:by|from|with) \S|transpiled (?:by|from)|do not (?:edit|modify)[.!]?\s*(?:\*/)?$)"
)
_UPSTREAM = re.compile(
    r"(?i)(?:vendored\b ?(?::|from|at)|taken (?:unchanged|verbatim|over)? ?from \S+|bundled (?:copy|version) of|copied (?:unchanged |verbatim )?from \S+|imported from upstream|upstream: ?\S|"
    r"(?:copy|mirror|snapshot) of \S+ v?\d|\S+ v?\d+(?:\.\d+)+\S*\s*[-|,–]+\s*(?:\(c\)|©|copyright|mit|bsd|apache)|.*\bproject, \S+ licen[sc]ed)"
)
_HAND = re.compile(r"(?i)(?<!modify )(?<!edit )(?<!change )(?<!touch )by hand|hand-?written|manually written")
_LICENCE = re.compile(r"(?i)copyright \(c\)(?: \d{4}(?:-\d{4})?,?)? (?:the )?(\S+) (?:authors|contributors|developers|project)")
_TOKEN = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)(\s*:)?|(\d[\w.]*)|([A-Za-z_$][\w$]*)|([^\s\w])")
#: Openings of comments of several lines with their ends, and first lines that are no code yet.
_BLOCKS, _NO_CODE = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")), ("<?", '"use strict"', "'use strict'", "@charset")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_LITERAL_LINE = re.compile(r"[\s\[{(]*(?:[-+]?[\d.]+(?:[eE][-+]?\d+)?[fFuUlL]*|0[xX][0-9a-fA-F]+|\"[^\"\n]*\"|'[^'\n]*')(?:[\s,\]\[})({]+(?:[-+]?[\d.]+[fFuUlL]*|0[xX][0-9a-fA-F]+|\"[^\"\n]*\"|'[^'\n]*'))*[\s,\])}\[({]*$")


def _comments(lines: list[str]) -> list[str]:
    """What the comment lines at head and foot of stripped non-blank lines say."""
    said = [m[1] for x in lines[:6] + lines[-3:] if (m := _COMMENT.match(x))]
    close = ""
    for line in lines:
        m = _COMMENT.match(line)
        if close:
            # a plain line within a comment is comment too; within a string only what looks like one
            if m or close in ("*/", "-->"):
                said.append(m[1] if m else line)
            if close in line:
                close = ""
        elif m:
            said.append(m[1])
            close = next((c for o, c in _BLOCKS if line.startswith(o) and c not in line[len(o) :]), "")
        elif not line.startswith(_NO_CODE):
            break
    k = len(lines)
    while k:
        line = lines[k - 1]
        if line.endswith("*/") and "/*" not in line:
            j = k - 1
            while j and "/*" not in lines[j - 1]:
                j -= 1
            if not j or not lines[j - 1].startswith("/*"):
                break
            said += [m[1] if (m := _COMMENT.match(x)) else x for x in lines[j - 1 : k]]
            k = j - 1
        elif m := _COMMENT.match(line):
            said.append(m[1])
            k -= 1
        else:
            break
    return said


def comment_marks(lines: list[str], repository: str) -> tuple[bool, bool, bool, bool]:
    """(tool, upstream, own, foreign): what comment lines at head and foot say of a file's origin.

    Head and foot are the whole comment blocks before the first and after the last line of code, whatever their
    length, and at least six and three lines.
    Only what begins a comment counts, so code and comments that mention generators or vendored copies do not.
    """
    tool = upstream = own = foreign = False
    for said in _comments(lines):
        said = said.rstrip(" */->")
        if lic := _LICENCE.match(said):
            if lic[1].lower() == repository.lower():
                own = True
            else:
                foreign = True
        elif not _HAND.search(said):
            if _TOOL.match(said):
                tool = True
            elif _UPSTREAM.match(said):
                upstream = True
    return tool, upstream, own, foreign


def composition(text: str, lines: list[str]) -> tuple[bool, bool]:
    """(squeezed, data) of a text, by its composition of tokens.

    squeezed: most of the text stands in long lines of code with hardly any white space, short names and dense punctuation.
    data: numbers and strings, other than the keys of a mapping, are at least four fifths of the words and there are many.
    """
    n = len(text)
    longest = max(map(len, lines), default=0)
    digits = sum(map(text.count, "0123456789"))
    commas = text.count(",")
    squeezed = data = False
    if longest >= 300:
        dense = [x for x in lines if len(x) >= 300]
        size = sum(map(len, dense))
        if size >= 0.6 * n:
            body = "\n".join(dense)
            # strings are blanked: a long text or key in a line of code is no sign of a tool
            code = _STRING.sub(lambda m: m[0] if len(m[0]) < 26 else '""', body)
            blanks = code.count(" ") + code.count("\t")
            marks = sum(map(code.count, "{}();:,=.&|?!"))
            squeezed = len(code) >= 300 and len(code) >= 0.5 * size and blanks <= 0.08 * len(code) and marks >= 0.12 * len(code) and sum(map(code.count, "{;}")) >= 0.02 * len(code)
    if digits + commas >= 0.25 * n or longest >= 60:
        literal = [x for x in lines if len(x) >= 16 and _LITERAL_LINE.match(x)]
        held = sum(map(len, literal))
        if len(literal) >= 3 and held >= 0.7 * n:
            data = True
        elif digits + commas >= 0.2 * n or longest >= 300 and held < n:
            values = names = 0
            for m in _TOKEN.finditer(text):
                if m[1]:
                    if m[2]:
                        names += 1
                    else:
                        values += 1
                elif m[3]:
                    values += 1
                elif m[4]:
                    names += 1
            data = values >= 60 and values >= 0.8 * (values + names)
    return squeezed, data and not squeezed


def _features(files: DataFrame) -> DataFrame:
    """(id, tool, upstream, own, foreign, squeezed, data, kept, lines) of each content row; lines are hashes of its long distinct lines, odd for comments."""

    def fn(cols):
        ids, texts = cols
        out: list[list] = [[] for _ in range(9)]
        digest = xxhash.xxh3_64_intdigest
        for i, t in zip(ids, texts):
            t = t or ""
            code = i.rpartition(".")[2].lower() in CODE
            lines = t.splitlines()
            real = [s for x in lines if (s := x.strip())]
            marks = comment_marks(real, i.partition("/")[0]) if real else (False,) * 4
            squeezed, data = composition(t, lines) if code and real else (False, False)
            hashes = {(digest(x) - (1 << 63)) & -2 | (x[0] in _OPENS and _COMMENT.match(x) is not None) for x in real if len(x) >= LINE} if code else ()
            for c, v in zip(out, (i, *marks, squeezed, data, bool(t), list(hashes))):
                c.append(v)
        return out

    have = files.select("id", "content").where(F.col("id").isNotNull())
    return map_arrow(spread(have), fn, "id string, tool boolean, upstream boolean, own boolean, foreign boolean, squeezed boolean, data boolean, kept boolean, lines array<long>")


def _containing(cut: Cut, held: DataFrame, holders: DataFrame, repos: DataFrame) -> DataFrame:
    """(f, o, contained): files that hold at least ``CONTAINED`` of their counted lines in common with a holder ``o`` of another repository.

    ``held``: (f, r, line, rare, k, a, b), each line of each file with the number of holders, the least and the greatest
    one, null where no other repository has one. ``holders``: (o, line). ``repos``: (o, o_r).

    A file can only be a copy if that share of its lines is held elsewhere at all. Each line of such a file votes for its
    two holders, and enough votes for one of them prove the copy, so a group of any size is settled at its common holders.
    The others are compared, on the line sets, with the holders of those lines of which a copy must share one: first with the
    least and greatest of them, then, if no copy is found, with all, so no holder that contains a file is missed.
    """
    code, shared, total = F.col("line").bitwiseAND(1) == 0, F.col("k").isNotNull(), lambda c: F.sum(c.cast("long"))
    stats = held.groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), total(F.col("rare")).alias("rare"), total(F.col("rare") & shared).alias("rare_out"), total(code).alias("code"), total(code & shared).alias("code_out")
    )
    some = lambda whole, size, both, when: F.when(when & (F.col(size) >= FEWEST) & (F.col(both) / F.col(size) >= CONTAINED), F.struct(F.lit(whole).alias("whole"), F.col(size).alias("size"), F.col(both).alias("both")))
    ways = F.array_compact(F.array(some(False, "rare", "rare_out", F.lit(True)), some(True, "code", "code_out", F.col("rare") < 0.5 * F.col("n"))))
    todo = cut(stats.select("f", F.inline(ways)))
    counts = F.when(F.col("whole"), code).otherwise(F.col("rare"))
    mine = cut(held.where(shared).join(small(todo), "f").where(counts).select("f", "r", "whole", "line", "k", "a", "b", "size", "both"))
    enough = (F.col("n") / F.col("size")).alias("contained")
    voted = mine.select("f", "r", "whole", "size", F.explode(F.array_distinct(F.array("a", "b"))).alias("o")).groupBy("f", "r", "whole", "size", "o").agg(F.count(F.lit(1)).alias("n"))
    found = cut(voted.select("f", "r", "o", enough).where(F.col("contained") >= CONTAINED).join(repos, "o").where(F.col("r") != F.col("o_r")).select("f", "o", "contained"))

    def compared(left: DataFrame, pairs: DataFrame) -> DataFrame:
        both = left.select("f", "whole", "size", "line").join(pairs, ["f", "whole"]).join(holders, ["o", "line"])
        return cut(both.groupBy("f", "whole", "o", "size").agg(F.count(F.lit(1)).alias("n")).select("f", "o", enough).where(F.col("contained") >= CONTAINED))

    # a copy lacks fewer than `both - need + 1` of its shared lines, so its holder has one of so many: those with fewest holders are asked
    need = F.ceil(F.col("size") * CONTAINED - 1e-9)
    least = Window.partitionBy("f", "whole").orderBy("k", "line")
    left = cut(mine.join(found.select("f").distinct(), "f", "left_anti"))
    if left.isEmpty():
        return found
    asked = cut(left.withColumn("_i", F.row_number().over(least)).where(F.col("_i") <= F.col("both") - need + 1).select("f", "r", "whole", "line", "a", "b"))
    near = asked.select("f", "r", "whole", F.explode(F.array_distinct(F.array("a", "b"))).alias("o")).distinct().join(repos, "o")
    found = found.unionByName(compared(left, near.where(F.col("r") != F.col("o_r")).select("f", "whole", "o")))
    # least and greatest holders may be other versions than the one that was copied: what is left is compared with every holder
    last = cut(left.join(found.select("f").distinct(), "f", "left_anti"))
    if last.isEmpty():
        return found
    every = asked.join(last.select("f").distinct(), "f", "left_semi").select("f", "r", "whole", "line").join(holders, "line").join(repos, "o").where(F.col("r") != F.col("o_r"))
    return found.unionByName(compared(last, every.select("f", "whole", "o").distinct()))


def copies(cut: Cut, lines: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, other, contained, marked): for (id, lines), files that hold at least ``CONTAINED`` of their lines in common with a file of another repository.

    What counts of a file are its rare lines; of a file most of whose lines are frequent (a library copied into many
    repositories makes its lines frequent), all its lines of code. ``contained`` is a lower bound where votes settle it.

    An inverted index keeps for each line how many files hold it, and of the marked and the unmarked ones how many, the
    least and the greatest with their repositories: no pairs. Containment in marked files is solved first (``marked`` is
    true); unmarked files without such a copy are then compared with each other.
    """
    repo = F.xxhash64(F.substring_index("id", "/", 1))
    names = cut(lines.select("id", F.xxhash64("id").alias("f"), repo.alias("r")).distinct())
    known = cut(marked.select("id").distinct().withColumn("m", F.lit(True)))
    flagged = lines.join(small(known), "id", "left")
    each = cut(flagged.select(F.xxhash64("id").alias("f"), repo.alias("r"), F.col("m").isNotNull().alias("m"), F.explode("lines").alias("line")).distinct())
    common = max(COMMON_LEAST, int(COMMON_SHARE * names.count()))
    of_side = lambda of, c: F.when(F.col("m") == of, F.col(c))
    sides = ((True, ""), (False, "u"))
    index = each.groupBy("line").agg(
        F.count(F.lit(1)).alias("n"),
        *[x for of, t in sides for x in (
            F.count(of_side(of, "f")).alias(t + "k"), F.min(of_side(of, "f")).alias(t + "a"), F.max(of_side(of, "f")).alias(t + "b"),
            F.min(of_side(of, "r")).alias(t + "r_lo"), F.max(of_side(of, "r")).alias(t + "r_hi"))],
    )
    out = {t: F.coalesce((F.col(t + "r_lo") != F.col("r")) | (F.col(t + "r_hi") != F.col("r")), F.lit(False)) for _, t in sides}
    held = cut(each.join(index, "line").select("f", "r", "m", "line", (F.col("n") <= common).alias("rare"), *[F.when(out[t], F.col(t + c)).alias(t + c) for _, t in sides for c in ("k", "a", "b")]))
    repos = names.select(F.col("f").alias("o"), F.col("r").alias("o_r"))
    holders = lambda of: each.where(F.col("m") == of).select(F.col("f").alias("o"), "line")
    first = _containing(cut, held.select("f", "r", "line", "rare", "k", "a", "b"), holders(True), repos)
    open_ = held.where("not m").join(small(cut(first.select("f").distinct())), "f", "left_anti")
    second = _containing(cut, open_.select("f", "r", "line", "rare", *[F.col("u" + c).alias(c) for c in ("k", "a", "b")]), holders(False), repos)
    found = first.withColumn("marked", F.lit(True)).unionByName(second.withColumn("marked", F.lit(False)))
    return found.join(names.select("id", "f"), "f").join(names.select(F.col("id").alias("other"), F.col("f").alias("o")), "o").select("id", "other", "contained", "marked")


def derived(found: DataFrame, first_seen: DataFrame) -> DataFrame:
    """id of those of (id, other), files contained in one another across repositories, that are no origin.

    The origin of what meets at one holder is the file that was seen first (id, first), then the smallest id; a file without
    a time comes last. What stands in other repositories than the origin was copied in.
    """
    late = F.coalesce("first", F.lit("9999-12-31").cast(first_seen.schema["first"].dataType))
    when = first_seen.select("id", F.struct(late.alias("first"), "id").alias("key"))
    members = found.select("other", "id").unionByName(found.select("other", F.col("other").alias("id"))).distinct()
    hub = members.join(when, "id").groupBy("other").agg(F.min("key").alias("least"))
    return found.select("id", "other").join(hub, "other").join(when, "id").where(F.substring_index("id", "/", 1) != F.substring_index("least.id", "/", 1)).select("id").distinct()


def origins(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, kind): kind of origin of every distinct id of ``files``; ``hand`` for what was written in its repository.

    Kinds, the first that holds: ``own`` (a licence line of its own repository: never flagged), ``lock`` (lock files
    by name), ``vendored`` (a vendor directory, a line that names its upstream, another repository's licence line, or a copy
    of such a file or of one that carries its own repository's licence; of unmarked files that contain each other across
    repositories all but the one seen first), ``generated`` (tools' directories and names, or
    a line at head or foot that says so), ``minified``, ``data``, ``unkept`` (no content, but larger than anyone
    writes), ``hand``.

    The row of greatest last_seen gives ext and size; of several contents of an id, one that carries a mark is enough. Null
    and empty contents and ids without content are judged by path and size. Null ids are dropped; repeated rows
    count once; an empty table gives no rows.
    """
    cut = Cut(files.sparkSession, "origin")
    feats = cut(_features(contents))
    flags = feats.groupBy("id").agg(*[F.max(c).alias(c) for c in ("tool", "upstream", "own", "foreign", "squeezed", "data", "kept")])
    latest = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("size", "last_seen").alias("size"), F.max("size").alias("_s"))
    dirs, name = F.slice(F.split("id", "/"), 1, F.size(F.split("id", "/")) - 1), F.substring_index("id", "/", -1)
    within = lambda ds: F.exists(dirs, lambda p: F.lower(p).isin(*ds))
    base = cut(
        latest.join(flags, "id", "left").select(
            "id", F.coalesce("size", "_s", F.lit(0)).alias("size"),
            *[F.coalesce(c, F.lit(False)).alias(c) for c in ("tool", "upstream", "own", "foreign", "squeezed", "data", "kept")],
            within(VENDOR_DIRS).alias("vdir"), within(OUTPUT_DIRS).alias("odir"), name.rlike(OUTPUT_NAME).alias("oname"), name.rlike(LOCK_NAME).alias("lname"),
        )
    )
    marked = base.where(F.col("vdir") | F.col("upstream") | F.col("own") | F.col("foreign")).select("id")
    found = copies(cut, feats.select("id", "lines").where(F.size("lines") > 0), marked)
    found = cut(found)
    first = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("last_seen").alias("first"))
    copied = cut(found.where("marked").select("id").unionByName(derived(found.where("not marked"), first)).distinct()).withColumn("copied", F.lit(True))
    j = base.join(copied, "id", "left")
    kind = (
        F.when(F.col("own"), "own")
        .when(F.col("lname"), "lock")
        .when(F.col("vdir") | F.col("upstream") | F.col("foreign") | F.coalesce("copied", F.lit(False)), "vendored")
        .when(F.col("odir") | F.col("oname") | F.col("tool"), "generated")
        .when(F.col("squeezed"), "minified")
        .when(F.col("data"), "data")
        .when(~F.col("kept") & (F.col("size") >= TOO_LARGE), "unkept")
        .otherwise("hand")
    )
    return j.select("id", kind.alias("kind"))
