"""Operators over files and edges: snapshot, degrees, traversal, components, package edges, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.session import Cut, small

#: Hops after which what a walk has met is written as one table again.
SEEN_EVERY = 8
#: A node whose hop makes more rows than this is a hub of ``bfs_packed``; a task of its last hop has so many rows about.
HUB_ROWS, TASK_ROWS = 1 << 16, 1 << 19


def snapshot(files: DataFrame) -> DataFrame:
    """The newest row of each file id (ties: greater size, then greater loc), with a normalised ``ext``.

    One aggregation keyed by id; only the newest row of a partition leaves it.
    """
    rest = [c for c in files.columns if c != "id"]
    newest = F.max_by(F.struct(*rest), F.struct("last_seen", "size", "loc")).alias("_r")
    out = files.where(F.col("id").isNotNull()).groupBy("id").agg(newest).select("id", "_r.*")
    return out.withColumn("ext", paths.extension("ext", "id"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (s, t, k) with both ends, without self-links; a null kind is a kind."""
    ok = F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("s") != F.col("t"))
    return edges.where(ok).select("s", "t", "k").distinct()


def known_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Clean edges whose ends are both files."""
    ids = files.select("id").distinct()
    e = clean_edges(edges)
    return e.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi").select("s", "t", "k")


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of every file. Counts are combined before the shuffle, so a hub is a few partial rows."""
    both = edges.select(F.col("t").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        edges.select(F.col("s").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    sums = both.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select("id").distinct().join(sums, "id", "left").select("id", n("n_in"), n("n_out"))


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files at neither end of any edge."""
    ends = edges.select(F.col("s").alias("id")).union(edges.select("t"))
    return files.join(ends, "id", "left_anti")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next): ``users`` follows edges against, ``deps`` along, ``both`` either way."""
    along = edges.select(F.col("s").alias("at"), F.col("t").alias("next"))
    against = edges.select(F.col("t").alias("at"), F.col("s").alias("next"))
    return {"users": against, "deps": along, "both": along.union(against)}[direction].distinct()


def bfs(seeds: DataFrame, edges: DataFrame, depth: int | None, direction: str = "users") -> DataFrame:
    """(seed, id, depth): every id within ``depth`` hops of each seed by its first hop, the seed at 0.

    ``depth`` None walks until nothing new is met. Frontier joins: one hop expands the frontier by an equi-join with
    the edges and drops what was met before by an anti-join, for all seeds at once. A hop's result is cut by a table, and
    what was met is written together every ``SEEN_EVERY`` hops, so a plan holds so many tables at most; skewed hubs are split by AQE.
    """
    cut = Cut(seeds.sparkSession, "bfs")
    hops = cut(directed(edges, direction))
    start = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen, frontier, level = start, start, 0
    while depth is None or level < depth:
        level += 1
        new = (
            frontier.select("seed", F.col("id").alias("at")).join(hops, "at").select("seed", F.col("next").alias("id")).distinct()
            .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
            .withColumn("depth", F.lit(level).cast("long"))
        )
        frontier = cut(new, n=F.count(F.lit(1)))
        if not frontier._weft_seen["n"]:
            break
        seen = seen.unionByName(frontier)
        if level % SEEN_EVERY == 0:
            seen = cut(seen)
    return seen


def bfs_packed(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "users", hub_rows: int = HUB_ROWS) -> DataFrame:
    """The rows of ``bfs`` where many seeds meet at hubs, so that the result is far larger than the edges.

    Seeds are numbered, and 64 of them are one row of an id: (id, word of seeds, mask). A hop joins such rows with the edges and
    combines masks by ``bit_or``. Links of hubs, which make nearly all rows, are spread by their far end and meet the hubs' masks
    there by a broadcast, so their rows are combined where they are made, in no shuffle; the rest is combined before a shuffle.
    The last hop is not written, and masks become rows of (seed, id) as they are read.
    """
    cut = Cut(seeds.sparkSession, "bfs")
    hops = cut(directed(edges, direction))
    number = cut(seeds.select(F.col("id").alias("seed")).distinct().withColumn("n", F.monotonically_increasing_id()))
    number = number.select("seed", F.expr("n >> 6").alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit"))
    frontier = number.select(F.col("seed").alias("id"), "word", F.col("bit").alias("mask"))
    seen, none = frontier.withColumn("depth", F.lit(0).cast("long")), lambda kind: F.lit(None).cast(kind)
    for level in range(1, depth + 1):
        at = frontier.withColumnRenamed("id", "at")
        # what a hop from each node makes: its links times its words of seeds
        rows = at.groupBy("at").agg(F.count(F.lit(1)).alias("_w")).join(hops, "at").groupBy("at").agg(F.sum("_w").alias("_rows"))
        hubs = cut(rows.where(F.col("_rows") > hub_rows), n=F.sum("_rows"))
        masks = cut(at.join(hubs.select("at"), "at", "left_semi").withColumnsRenamed({"word": "_word", "mask": "_mask"}))
        few = small(hubs.select("at"))
        far = hops.join(few, "at", "left_semi").select(F.col("next").alias("id"), "at", none("long").alias("word"), none("long").alias("new"), none("long").alias("old"))
        near = (
            at.join(few, "at", "left_anti").join(hops, "at").groupBy(F.col("next").alias("id"), "word").agg(F.bit_or("mask").alias("new"))
            .select("id", none("string").alias("at"), "word", "new", none("long").alias("old"))
        )
        met = seen.select("id", none("string").alias("at"), "word", none("long").alias("new"), F.col("mask").alias("old"))
        tasks = max(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), (hubs._weft_seen["n"] or 0) // TASK_ROWS)
        all_ = far.unionByName(near).unionByName(met).repartition(tasks, "id").join(small(masks), "at", "left")
        both = all_.select("id", F.coalesce("word", "_word").alias("word"), F.coalesce("new", "_mask", F.lit(0)).alias("new"), F.coalesce("old", F.lit(0)).alias("old"))
        new = both.groupBy("id", "word").agg(F.bit_or("new").alias("_n"), F.bit_or("old").alias("_o")).select("id", "word", F.expr("_n & ~_o").alias("mask")).where("mask <> 0")
        if level < depth:
            new = cut(new, n=F.count(F.lit(1)))
            if not new._weft_seen["n"]:
                break
        frontier = new
        seen = seen.unionByName(new.withColumn("depth", F.lit(level).cast("long")))
    return seen.join(small(number), "word").where(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("seed", "id", "depth")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node is connected with, whatever the direction.

    Each round takes the least label of the neighbourhood and then the label of that label (pointer jumping), so long
    chains need a logarithmic number of rounds; labels of a round are a cut table. Minima are combined before the shuffle.
    """
    cut = Cut(nodes.sparkSession, "components")
    links = cut(directed(edges, "both"))
    label = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = (
            links.join(label.select(F.col("id").alias("next"), "component"), "next").groupBy(F.col("at").alias("id")).agg(F.min("component").alias("_m"))
        )
        near = label.join(least, "id", "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_m", "component")).alias("component"))
        near = cut(near)
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("_j"))
        new = cut(near.join(jump, "component", "left").select("id", F.least("component", F.coalesce("_j", "component")).alias("component"), "_old"))
        moved = new.where(F.col("component") != F.col("_old")).limit(1).count()
        Cut.drop(near)
        Cut.drop(label)
        label = new.select("id", "component")
        label._weft_path = new._weft_path
        if not moved:
            return label


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that the seeds reach along edges, themselves included; every id is visited once."""
    cut = Cut(seeds.sparkSession, "reach")
    hops = cut(directed(edges, "deps"))
    seen = frontier = cut(seeds.select("id").distinct())
    level = 0
    while True:
        level += 1
        frontier = cut(frontier.select(F.col("id").alias("at")).join(hops, "at").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"), n=F.count(F.lit(1)))
        if not frontier._weft_seen["n"]:
            return seen
        seen = seen.unionByName(frontier)
        if level % SEEN_EVERY == 0:
            seen = cut(seen)


def closure(edges: DataFrame) -> DataFrame:
    """(seed, id, depth): every other id that each id reaches along edges, by its shortest way.

    Doubling: pairs within 2**k steps, extended by the pairs of exactly 2**k, are the pairs within 2**(k + 1); so a
    chain of a hundred hops takes seven rounds. Ways of equal ends are reduced to the shortest before the next round.
    """
    cut = Cut(edges.sparkSession, "closure")
    exact = cut(edges.select(F.col("s").alias("seed"), F.col("t").alias("id")).distinct())
    within = exact.withColumn("depth", F.lit(1).cast("long"))
    reach, n = 1, -1
    while True:
        step = exact.select(F.col("seed").alias("id"), F.col("id").alias("to"))
        far = within.join(step, "id").select("seed", F.col("to").alias("id"), (F.col("depth") + reach).alias("depth"))
        within = cut(within.unionByName(far).where(F.col("seed") != F.col("id")).groupBy("seed", "id").agg(F.min("depth").alias("depth")))
        now = within.count()
        if now == n:
            return within
        n = now
        exact = cut(exact.join(step, "id").select("seed", F.col("to").alias("id")).distinct())
        if exact.isEmpty():
            return within
        reach *= 2


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(id, package): the package whose root is the longest prefix of each file's path; null where none is.

    Every directory prefix of a path is a key: an equi-join with the roots in place of a join on prefixes.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("id", "/")) - 1), lambda n: F.array_join(F.slice(F.split("id", "/"), 1, n), "/"))
    each = files.select("id").distinct().where(F.instr("id", "/") > 0).select("id", F.explode(prefixes).alias("root"))
    roots = packages.groupBy(F.col("rel_root").alias("root")).agg(F.min("name").alias("package"))
    best = each.join(roots, "root").groupBy("id").agg(F.max_by("package", F.length("root")).alias("package"))
    return files.select("id").distinct().join(best, "id", "left")


def package_edges(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """(s_pkg, t_pkg, n_edges, kinds) between different packages."""
    a = owned.where(F.col("package").isNotNull())
    return (
        edges.join(a.select(F.col("id").alias("s"), F.col("package").alias("s_pkg")), "s")
        .join(a.select(F.col("id").alias("t"), F.col("package").alias("t_pkg")), "t")
        .where(F.col("s_pkg") != F.col("t_pkg"))
        .groupBy("s_pkg", "t_pkg")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("k")), ",").alias("kinds"))
    )


def bundle(ranked: DataFrame, budget: int, partition: str = "seed") -> DataFrame:
    """The prefix of (seed, id, depth, n_in, size) by depth, then most used, whose tokens (a quarter of the size, rounded up) fit the budget.

    The first row is always kept; the first overflow ends the prefix.
    """
    w = Window.partitionBy(partition).orderBy("depth", F.col("n_in").desc(), "id")
    cost = F.ceil(F.coalesce(F.col("size"), F.lit(0)) / 4).cast("long")
    run = ranked.withColumn("tokens", cost).withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(w))
    return run.where((F.col("total") <= budget) | (F.col("_r") == 1)).drop("_r")


def first_users(edges: DataFrame, most: int) -> DataFrame:
    """(id, importers): the first ``most`` users of each file by id, as a list; the rank is cut before the shuffle as well as after it."""
    w = Window.partitionBy("t").orderBy("s")
    few = edges.select("s", "t").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return few.groupBy(F.col("t").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("importers"))
