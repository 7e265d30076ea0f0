"""Operators over symbols: aliases, dispatch, argument flow, versions of signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.session import Cut


def chase_aliases(wanted: DataFrame, aliases: DataFrame, depth: int = 6) -> DataFrame:
    """(file, name, target_file, target_name, steps): where a name of (file, name) comes from through (file, exported, source, orig) aliases.

    Chains longer than ``depth`` stop there; a chain that comes back to where it was stops as well.
    """
    cut = Cut(wanted.sparkSession, "alias")
    cur = cut(wanted.select("file", "name", F.col("file").alias("target_file"), F.col("name").alias("target_name"), F.lit(0).cast("long").alias("steps")).distinct())
    step = aliases.groupBy(F.col("file").alias("target_file"), F.col("exported").alias("target_name")).agg(F.min(F.struct("source", "orig")).alias("_n"))
    for _ in range(depth):
        moved = cut(
            cur.join(step, ["target_file", "target_name"], "left")
            .select("file", "name", F.coalesce("_n.source", "target_file").alias("target_file"), F.coalesce("_n.orig", "target_name").alias("target_name"), (F.col("steps") + F.col("_n").isNotNull().cast("long")).alias("steps"), F.col("_n").isNotNull().alias("_m"))
        )
        more = moved.where("_m").limit(1).count()
        cur = moved.drop("_m")
        if not more:
            break
    return cur


def dispatch(calls: DataFrame, extends: DataFrame, methods: DataFrame, cap: int = 24) -> DataFrame:
    """(call, target, capped): overrides in subtypes that a call of (call, cls, method) may reach; the first ``cap`` by name.

    Subtypes are what a walk from the called classes down (cls, base) meets; ``methods`` holds (cls, method).
    """
    asked = calls.select("call", "cls", "method").distinct()
    walk = graph.bfs(asked.select(F.col("cls").alias("id")).distinct(), extends.select(F.col("base").alias("s"), F.col("cls").alias("t")), None, "deps")
    below = walk.where("depth > 0").select(F.col("seed").alias("cls"), F.col("id").alias("sub"))
    over = below.join(methods.select(F.col("cls").alias("sub"), "method").distinct(), "sub").distinct()
    w = Window.partitionBy("cls", "method").orderBy("sub")
    ranked = over.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    sizes = over.groupBy("cls", "method").agg((F.count(F.lit(1)) > cap).alias("capped"))
    return asked.join(ranked.join(sizes, ["cls", "method"]), ["cls", "method"]).select("call", F.concat_ws(".", "sub", "method").alias("target"), "capped")


def argument_reach(flow: DataFrame, fn: str, param: str, depth: int = 8) -> DataFrame:
    """(fn, param, depth): parameters that a value given to one parameter flows into, through callees whose name one function alone has."""
    cut = Cut(flow.sparkSession, "flow")
    params = flow.where("fact = 'param'").select("id", "fn", F.col("name").alias("param"), "arg")
    alone = params.groupBy("fn").agg(F.count_distinct("id").alias("_n")).where("_n = 1").select("fn")
    given = flow.where("fact = 'arg' and startswith(origin, 'param:')").select("fn", F.substring(F.col("origin"), F.lit(7), F.lit(1000)).alias("param"), F.col("name").alias("callee"), "arg")
    hop = cut(given.join(params.join(alone, "fn").select(F.col("fn").alias("callee"), F.col("param").alias("to"), "arg"), ["callee", "arg"]).select("fn", "param", "callee", "to").distinct())
    seen = frontier = cut(params.where((F.col("fn") == fn) & (F.col("param") == param)).select("fn", "param").distinct().withColumn("depth", F.lit(0).cast("long")))
    for level in range(1, depth + 1):
        frontier = cut(frontier.join(hop, ["fn", "param"]).select(F.col("callee").alias("fn"), F.col("to").alias("param")).distinct().join(seen, ["fn", "param"], "left_anti").withColumn("depth", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def signature_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, before, after) of names that stand once in either version of (file, name, signature) with another signature."""
    once = lambda df, c: df.groupBy("file", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("signature").alias(c)).where("_n = 1").drop("_n")
    return once(before, "before").join(once(after, "after"), ["file", "name"]).where(F.col("before") != F.col("after"))


def newly_dead(before: DataFrame, after: DataFrame, most: int = 30) -> DataFrame:
    """Ids dead in ``after`` and not in ``before``; none if there are more than ``most``, which is a rebuild and no event."""
    new = after.select("id").distinct().join(before.select("id"), "id", "left_anti")
    return new.join(F.broadcast(new.agg(F.count(F.lit(1)).alias("_n"))).where(F.col("_n") <= most)).select("id")


def find(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Symbols whose name contains a text, whatever the case; the first ``limit`` by name."""
    return symbols.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "symbol").limit(limit)


def named(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols that a name may mean, all of its best class: the id itself, the exact name, a qualified name that ends in it; ``ambiguous`` tells of several."""
    rank = F.when(F.col("symbol") == name, 0).when(F.col("name") == name, 1).when(F.endswith(F.col("name"), F.lit("." + name)), 2)
    hit = symbols.withColumn("_r", rank).where("_r is not null")
    best = hit.agg(F.min("_r").alias("_b"))
    out = hit.join(F.broadcast(best)).where("_r = _b").drop("_r", "_b")
    return out.join(F.broadcast(out.agg((F.count(F.lit(1)) > 1).alias("ambiguous"))))
