"""Calls to symbols in full: scope, builtin names, receiver types with inheritance, pinned modules, methods against functions, imports, what is left.

Everything is an equi-join with symbols that were aggregated per name and file before: a call meets counts and least ids, never
the list of what bears its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph, resolve, symbols as sym
from weftgraph.session import Cut

# Names that values of the language itself answer to, in lower case.
BUILTIN_NAMES = (
    "resolve", "reject", "emit", "on", "off", "once", "add", "remove", "delete", "has", "get", "set", "clear", "push", "pop", "shift", "unshift", "slice", "splice", "map", "filter", "reduce", "foreach", "find", "join", "split",
    "replace", "match", "test", "log", "warn", "error", "info", "debug", "write", "read", "close", "open", "end", "start", "stop", "run", "init", "setup", "destroy", "connect", "send", "next", "then", "catch", "append", "prepend",
    "save", "load", "update", "create", "show", "hide", "flush", "data", "tostring", "valueof", "keys", "values", "entries", "includes", "indexof", "trim", "concat", "flat", "sort", "reverse", "call", "apply", "bind",
    "defineproperty", "getownpropertydescriptor", "getownpropertynames", "getprototypeof", "setprototypeof", "freeze", "seal", "preventextensions", "startswith", "endswith", "normalize", "tolowercase", "touppercase",
    "padstart", "padend", "repeat", "charat", "charcodeat", "codepointat", "substring", "substr", "lastindexof", "tofixed",
)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame, reexports: DataFrame, aliases: DataFrame, allow_any: bool = True) -> DataFrame:
    """(call, outcome, target, reason): each call ``resolved``, ``declined`` with a reason that is counted, or ``open`` (nothing bears its name, or its known type has no such method).

    ``calls``: (call, caller_file, src, lo, hi, name, member, typed, imported_only, module); ``name`` may be ``Type.method``, ``src``
    with its lines is the calling symbol, ``module`` the file that a namespace stands for. ``symbols``: (symbol, name, qualified,
    file, line, aux). ``imports``: (file, imported); ``bases``: (cls, base); ``reexports``: (file, source); ``aliases``: (file,
    exported, source, orig).

    In order: a definition nested in the caller; a builtin name on an unknown receiver (``builtin-method``); the qualified name, then its
    bases'; an alias of the pinned module; several methods of that name (``ambiguous-user-method``); the own file; the
    pinned module's reach; the one imported file (several: ``imported-ambiguous``); the one symbol outside auxiliary paths
    (``builtin-fallback``, ``no-match``, ``ambiguous-prod``). A bare call never means a method, a member call of unknown receiver
    never a function. Names match with their case. Every call gives one row.
    """
    cut = Cut(calls.sparkSession, "calls")
    no = lambda c: F.coalesce(c, F.lit(False))
    tail = F.substring_index("name", ".", -1)
    c = cut(calls.dropDuplicates(["call"]).select(
        "call", "caller_file", "src", "lo", "hi", "name", no("member").alias("member"), no("typed").alias("typed"), no("imported_only").alias("io"), "module", tail.alias("tail"), (F.instr("name", ".") > 0).alias("dotted"),
    ).withColumn("kind", F.when(F.col("io"), "a").when(F.col("member"), "m").otherwise("f")))
    method = (F.instr("qualified", ".") > 0) & (F.col("qualified") != F.col("name"))
    s = cut(symbols.select("symbol", "name", "qualified", "file", "line", no("aux").alias("aux"), no(method).alias("method")))
    kinds = s.withColumn("kind", F.explode(F.array(F.lit("a"), F.when(F.col("method"), "m").otherwise("f"))))
    own = cut(kinds.groupBy("kind", F.col("name").alias("tail"), "file").agg(F.min("symbol").alias("symbol")))
    prod = kinds.where("not aux").groupBy("kind", F.col("name").alias("tail")).agg(F.count(F.lit(1)).alias("n_prod"), F.min("symbol").alias("prod"))
    named = s.groupBy(F.col("name").alias("tail")).agg(F.sum((F.col("method") & ~F.col("aux")).cast("int")).alias("n_methods"))

    shadow = c.where("not member and not dotted and lo is not null").join(s.select("symbol", F.col("name").alias("tail"), F.col("file").alias("caller_file"), "line"), ["caller_file", "tail"])
    shadow = shadow.where("symbol <> coalesce(src, '') and line > lo and line <= hi").groupBy("call").agg(F.min_by("symbol", "line").alias("shadow"))
    by_name = s.groupBy(F.col("qualified").alias("name")).agg(F.min("symbol").alias("exact"))
    exact = c.where("dotted").select("call", "name").join(by_name, "name").select("call", "exact")
    typed = c.where("dotted").join(exact, "call", "left_anti").select("call", F.expr("substring(name, 1, length(name) - length(tail) - 1)").alias("cls"), F.col("tail").alias("method"))
    has = s.where("method").select(F.expr("substring(qualified, 1, length(qualified) - length(name) - 1)").alias("cls"), F.col("name").alias("method"))
    up = resolve.inherited(bases, has, typed.select("cls", "method").distinct())
    mro = typed.join(up, ["cls", "method"]).select("call", F.concat_ws(".", "owner", "method").alias("name")).join(by_name, "name").select("call", F.col("exact").alias("mro"))

    pinned = c.where("io and module is not null").select("call", "module", "tail")
    chased = sym.chase_aliases(pinned.select(F.col("module").alias("file"), F.col("tail").alias("name")).distinct(), aliases).where("steps > 0")
    alias = pinned.join(chased.select(F.col("file").alias("module"), F.col("name").alias("tail"), "target_file", "target_name"), ["module", "tail"])
    alias = alias.join(own.where("kind = 'a'").select(F.col("file").alias("target_file"), F.col("tail").alias("target_name"), "symbol"), ["target_file", "target_name"]).groupBy("call").agg(F.min("symbol").alias("alias"))
    hands = reexports.select(F.col("file").alias("s"), F.col("source").alias("t")).distinct()
    reach = graph.bfs(pinned.select(F.col("module").alias("id")).distinct(), hands, None, "deps")
    pin = pinned.join(reach.select(F.col("seed").alias("module"), F.col("id").alias("file")), "module").join(own.where("kind = 'a'"), ["tail", "file"]).groupBy("call").agg(F.min("symbol").alias("pin"))

    plain = imports.select(F.col("file").alias("caller_file"), F.col("imported").alias("file")).distinct()
    through = c.where("io and module is null").select("caller_file").distinct().join(plain, "caller_file")
    far = graph.bfs(through.select(F.col("file").alias("id")).distinct(), hands, None, "deps").select(F.col("seed").alias("file"), F.col("id").alias("to"))
    wide = through.join(far, "file").select("caller_file", F.col("to").alias("file")).distinct()
    asked = c.where("not (io and module is not null)").select("kind", "caller_file", "tail").distinct()
    found = asked.where("kind <> 'a'").join(plain, "caller_file").unionByName(asked.where("kind = 'a'").join(wide, "caller_file")).join(own, ["kind", "tail", "file"])
    imported = found.groupBy("kind", "caller_file", "tail").agg(F.count(F.lit(1)).alias("n_imp"), F.min("symbol").alias("imp"))

    j = c.join(shadow, "call", "left").join(exact, "call", "left").join(mro, "call", "left").join(alias, "call", "left").join(pin, "call", "left")
    j = j.join(named, "tail", "left").join(own.withColumnRenamed("file", "caller_file").withColumnRenamed("symbol", "same"), ["kind", "tail", "caller_file"], "left")
    j = j.join(imported, ["kind", "caller_file", "tail"], "left").join(prod, ["kind", "tail"], "left")
    builtin = F.lower("tail").isin(*BUILTIN_NAMES)
    hit = lambda x: F.struct(F.lit("resolved").alias("outcome"), x.alias("target"), F.lit(None).cast("string").alias("reason"))
    left = lambda outcome, why=None: F.struct(F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("target"), F.lit(why).cast("string").alias("reason"))
    n = lambda x: F.coalesce(x, F.lit(0))
    got = (
        F.when(F.col("shadow").isNotNull(), hit(F.col("shadow")))
        .when(F.col("member") & ~F.col("io") & builtin, left("declined", "builtin-method"))
        .when(F.col("exact").isNotNull(), hit(F.col("exact"))).when(F.col("mro").isNotNull(), hit(F.col("mro")))
        .when(F.col("dotted") & F.col("typed"), left("open"))
        .when(F.col("alias").isNotNull(), hit(F.col("alias")))
        .when(F.col("n_methods").isNull(), left("open"))
        .when(F.col("member") & (F.col("n_methods") > 1), left("declined", "ambiguous-user-method"))
        .when(F.col("same").isNotNull() & ~F.col("io"), hit(F.col("same")))
        .when(F.col("pin").isNotNull(), hit(F.col("pin")))
        .when(n("n_imp") == 1, hit(F.col("imp"))).when(n("n_imp") > 1, left("declined", "imported-ambiguous"))
    )
    if allow_any:
        got = got.when(builtin, left("declined", "builtin-fallback")).when(n("n_prod") == 1, hit(F.col("prod"))).when(n("n_prod") == 0, left("declined", "no-match")).otherwise(left("declined", "ambiguous-prod"))
    else:
        got = got.otherwise(left("open"))
    return j.select("call", got.alias("x")).select("call", "x.outcome", "x.target", "x.reason")
