"""Full hierarchies from parent-child rows: root, depth, path, descendants and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Cut

#: One node in so many is a splitter, by the hash of its id.
SPLITTER_EVERY = 8
#: Doubling more often than this would need more than 2**60 nodes.
MOST_ROUNDS = 60


def tree_links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct (id, parent) links of distinct, non-null ends.

    A child with several parents keeps the smallest one in byte order, so that the result is a forest with rings.
    """
    return (
        edges.select(F.col(f"`{parent}`").alias("parent"), F.col(f"`{child}`").alias("id"))
        .where(F.col("id").isNotNull() & F.col("parent").isNotNull() & (F.col("id") != F.col("parent")))
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )


def _double(cut: Cut, jumps: DataFrame, with_path: bool) -> DataFrame:
    """Pointer doubling of (id, to, dist, done[, path]) until each row is done, or none gets done any more.

    A walk of length d passes walks of every smaller length, so the first round in which the number of open rows
    stays as it is proves that all open rows lead into a ring. Only open rows are joined; the others are copied as they
    stand. A row that leads to an id without a pointer (a splitter whose own walk never ends) falls out. Returns the
    done rows.
    """
    open_rows = F.coalesce(F.sum((~F.col("done")).cast("long")), F.lit(0))
    now = cut(jumps, left=open_rows)
    left = now._weft_seen["left"]
    for _ in range(MOST_ROUNDS):
        if not left:
            break
        ahead = now.select(
            F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"),
            *([F.col("path").alias("path2")] if with_path else []),
        )
        step = now.where("not done").join(ahead, "to").select(
            "id",
            F.col("to2").alias("to"),
            (F.col("dist") + F.col("dist2")).alias("dist"),
            F.col("done2").alias("done"),
            *([F.concat("path", "path2").alias("path")] if with_path else []),
        )
        old, now = now, cut(now.where("done").unionByName(step), left=open_rows)
        Cut.drop(old)
        before, left = left, now._weft_seen["left"]
        if left == before:
            break
    return now.where("done")


def _rings(cut: Cut, links: DataFrame) -> DataFrame:
    """(id, root, on_ring) of nodes that all lead into rings; ``links`` holds (id, parent), closed under parent.

    Doubling keeps where a node is after 2**r steps and the smallest id on the way. The images shrink to the ring
    nodes; once every ring node's minimum stays as it is under a further doubling it is the minimum of its ring
    (an arc shorter than the ring that all shifts map onto itself does not exist).
    """
    cur = cut(links.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")))
    size = -1
    for _ in range(MOST_ROUNDS):
        image = cur.select(F.col("to").alias("id")).distinct()
        ahead = cur.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        nxt = cut(
            cur.join(ahead, "to")
            .select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        )
        now, moved = (
            nxt.join(image, "id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.max(F.col("moved").cast("int")), F.lit(0))).first()
        )
        stable, size = now == size and not moved, now
        cur = nxt.drop("moved")
        if stable:
            break
    ring = cur.select(F.col("to").alias("id")).distinct().withColumn("on_ring", F.lit(True))
    low = cur.select(F.col("id").alias("to"), F.col("low").alias("root"))
    return (
        cur.select("id", "to").join(low, "to").join(ring, "id", "left")
        .select("id", "root", F.coalesce("on_ring", F.lit(False)).alias("on_ring"))
    )


def hierarchy(links: DataFrame, with_path: bool = False, splitter_every: int = SPLITTER_EVERY) -> DataFrame:
    """Root, depth and (if asked) full path of every node of (id, parent) links with one parent a child.

    Returns ``id, root, depth, state`` and, with ``with_path``, ``path`` (array of ids from the root to the node).

    1. Splitters are the nodes whose hash is 0 modulo ``splitter_every``; the choice is the same in every run.
    2. Every node walks to its next splitter or root. The walk is short (geometric in ``splitter_every``) whatever
       the depth of the trees, and doubles its step each round.
    3. The splitters' own walks are a graph of pointers, smaller by that factor; it is solved by doubling.
    4. A node's answer is its walk followed by the answer of the splitter that the walk ends at.
    5. Nodes without an answer (their walks never end, on rings without a splitter, or their splitters never reach
       a root) are solved apart: depth -1, root = smallest id of the ring, state ``ring`` or ``below_ring``, path null.

    Each round is one shuffled join of open rows with pointers, all keyed by id: a parent of a third of all nodes
    is only ever the *looked-up* side, whose key is unique, and AQE splits the skewed side. Lineage is cut each
    round by a table in the shared folder.

    Nulls and self-links never reach the links (see ``tree_links``); an empty input gives no rows.
    """
    spark = links.sparkSession
    cut = Cut(spark, "hierarchy")
    links = cut(links)
    kids = links.select("id")
    roots = cut(links.select(F.col("parent").alias("id")).distinct().join(kids, "id", "left_anti"))
    is_root = roots.withColumn("_root", F.lit(True))
    first = (
        links.join(is_root.withColumnRenamed("id", "parent"), "parent", "left")
        .select(
            "id", F.col("parent").alias("to"), F.lit(1).cast("long").alias("dist"),
            (F.coalesce("_root", F.lit(False)) | (F.pmod(F.xxhash64("parent"), F.lit(splitter_every)) == 0)).alias("done"),
            *([F.array("parent").alias("path")] if with_path else []),
        )
    )
    walked = _double(cut, first, with_path).drop("done")
    mine = F.pmod(F.xxhash64("id"), F.lit(splitter_every)) == 0
    reduced = (
        walked.where(mine).join(is_root.withColumnRenamed("id", "to"), "to", "left")
        .select("id", "to", "dist", F.coalesce("_root", F.lit(False)).alias("done"), *(["path"] if with_path else []))
    )
    solved = _double(cut, reduced, with_path).drop("done")
    answers = solved.select(F.col("id").alias("to"), F.col("to").alias("root"), F.col("dist").alias("dist2"), *([F.col("path").alias("path2")] if with_path else []))
    if with_path:
        answers = answers.unionByName(roots.select(F.col("id").alias("to"), F.col("id").alias("root"), F.lit(0).cast("long").alias("dist2"), F.array().cast("array<string>").alias("path2")))
    else:
        answers = answers.unionByName(roots.select(F.col("id").alias("to"), F.col("id").alias("root"), F.lit(0).cast("long").alias("dist2")))
    full = [F.reverse(F.concat(F.array("id"), "path", "path2")).alias("path")] if with_path else []
    trees = cut(walked.join(answers, "to").select("id", "root", (F.col("dist") + F.col("dist2")).alias("depth"), F.lit("tree").alias("state"), *full))
    own = [F.array("id").alias("path")] if with_path else []
    out = roots.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("tree").alias("state"), *own).unionByName(trees)
    hanging = cut(kids.join(trees.select("id"), "id", "left_anti"))
    if not hanging.isEmpty():
        solved_rings = cut(_rings(cut, links.join(hanging, "id", "left_semi")))
        none = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
        out = out.unionByName(
            solved_rings.select(
                "id", "root", F.lit(-1).cast("long").alias("depth"),
                F.when(F.col("on_ring"), F.lit("ring")).otherwise(F.lit("below_ring")).alias("state"), *none,
            )
        )
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(id, below, distance): every node below each node of the trees, from a ``hierarchy`` with paths.

    One row a pair, by exploding the paths: a node above a third of all nodes never becomes one array in one task.
    """
    n = F.size("path")
    return (
        tree.where(F.col("path").isNotNull())
        .select(F.col("id").alias("below"), n.alias("_n"), F.posexplode("path").alias("_i", "id"))
        .where(F.col("_i") < F.col("_n") - 1)
        .select("id", "below", (F.col("_n") - 1 - F.col("_i")).cast("long").alias("distance"))
    )


def all_descendants(links: DataFrame) -> DataFrame:
    """(id, below, distance): every node below each node of (id, parent) links, on and below rings too.

    A node on a ring has the ring's other nodes below it, at their distance along the ring, and all that hangs on the
    ring. Trees come from their paths. For the others, rings are cut open at their smallest node, which makes trees
    whose paths start there; a ring's arcs are then followed once more round.
    """
    tree = hierarchy(links, with_path=True)
    cut = Cut(links.sparkSession, "descendants")
    tree = cut(tree)
    # on a ring, the root is its smallest node: without its link the ring and what hangs on it is a tree
    bad = cut(tree.where("path is null").select("id", "root", (F.col("state") == "ring").alias("on_ring")))
    if bad.isEmpty():
        return descendants(tree)
    opened = cut(hierarchy(links.join(bad.select("id", "root"), "id").where(F.col("id") != F.col("root")).select("id", "parent"), with_path=True))
    straight = descendants(opened)
    # each node's place on its ring: how far the node itself, or the ring node it hangs on, is from the root
    ring = bad.where("on_ring").select(F.col("id").alias("at"), "root")
    place = opened.select("id", "depth", F.posexplode("path").alias("i", "at")).join(ring, "at").groupBy("id", "root", "depth").agg(F.max("i").cast("long").alias("pos"))
    size = ring.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    # round the end of the ring: from a ring node to what hangs on an earlier one
    member = place.where(F.col("depth") == F.col("pos")).select("id", "root", F.col("pos").alias("pos_id"))
    below = place.select(F.col("id").alias("below"), "root", F.col("pos").alias("pos_below"), F.col("depth").alias("deep"))
    round_ = (
        member.join(size, "root").join(below, "root").where(F.col("pos_below") < F.col("pos_id"))
        .select("id", "below", (F.col("size") - F.col("pos_id") + F.col("deep")).alias("distance"))
    )
    return descendants(tree).unionByName(straight).unionByName(round_)
