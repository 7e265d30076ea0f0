"""Queries p4 and p5 over the code-graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators.hierarchy import all_descendants, descendants, hierarchy, tree_links
from weftgraph.operators.treeagg import heavy_keys, tree_aggregate
from weftgraph.session import table

#: A (t, k) is heavy from this share of all rows.
HEAVY_SHARE = 0.01


def p4_found(spark, sf_dir):
    e = table(spark, sf_dir, "edges").select("s", "t", "k")
    return heavy_keys(e, ["t", "k"], HEAVY_SHARE).select("t", "k")


def p4_key_stats(spark, sf_dir):
    e = table(spark, sf_dir, "edges").select("s", "t", "k")
    return tree_aggregate(e, ["t", "k"], "s").select("t", "k", "n_rows", F.col("n_members").alias("n_sources"))


def _links(spark, sf_dir):
    e = table(spark, sf_dir, "edges").where(F.col("k") == "reexport").select("s", "t")
    return tree_links(e, "s", "t")


def p5_found(spark, sf_dir):
    return hierarchy(_links(spark, sf_dir)).select("id", "root", "depth")


def p5_paths(spark, sf_dir):
    return hierarchy(_links(spark, sf_dir), with_path=True).select("id", "root", "depth", "state", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark, sf_dir):
    return descendants(hierarchy(_links(spark, sf_dir), with_path=True))


def p5_all_descendants(spark, sf_dir):
    """All files below every file, rings and what hangs on them included; ``p5_descendants`` has those of trees only."""
    return all_descendants(_links(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p4_found, p4_key_stats, p5_found, p5_paths, p5_descendants, p5_all_descendants)}

_P5_LINKS = "SELECT DISTINCT s, t FROM edges WHERE k = 'reexport' AND t IS NOT NULL AND s IS NOT NULL AND s <> t"

SQL = {
    "p4_found": "SELECT t, k FROM edges WHERE t IS NOT NULL AND k IS NOT NULL GROUP BY t, k HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p4_key_stats": "SELECT t, k, count(*) AS n_rows, count(DISTINCT s) AS n_sources FROM edges GROUP BY t, k",
    "p5_found": f"""
WITH RECURSIVE links AS ({_P5_LINKS}), up AS (SELECT t AS id, min(s) AS parent FROM links GROUP BY t),
nodes AS (SELECT id FROM up UNION SELECT parent FROM up),
walk(id, cur, d) AS (
  SELECT id, id, 0 FROM nodes
  UNION ALL
  SELECT w.id, u.parent, w.d + 1 FROM walk w JOIN up u ON u.id = w.cur WHERE w.d < 600
),
tree AS (SELECT w.id, w.cur AS root, CAST(w.d AS BIGINT) AS depth FROM walk w WHERE w.cur NOT IN (SELECT id FROM up)),
ringed AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
late AS (SELECT w.id, w.cur FROM walk w JOIN ringed r ON r.id = w.id WHERE w.d >= 300)
SELECT id, root, depth FROM tree
UNION ALL SELECT id, min(cur) AS root, CAST(-1 AS BIGINT) AS depth FROM late GROUP BY id""",
    "p5_descendants": f"""
WITH RECURSIVE links AS ({_P5_LINKS}), up AS (SELECT t AS id, min(s) AS parent FROM links GROUP BY t),
top AS (SELECT DISTINCT parent AS id FROM up WHERE parent NOT IN (SELECT id FROM up)),
inside(id) AS (SELECT id FROM top UNION SELECT u.id FROM inside i JOIN up u ON u.parent = i.id),
walk(below, id, distance) AS (
  SELECT u.id, u.parent, 1 FROM up u JOIN inside i ON i.id = u.id
  UNION ALL SELECT w.below, u.parent, w.distance + 1 FROM walk w JOIN up u ON u.id = w.id
)
SELECT id, below, CAST(distance AS BIGINT) AS distance FROM walk""",
    "p5_paths": f"""
WITH RECURSIVE links AS ({_P5_LINKS}), up AS (SELECT t AS id, min(s) AS parent FROM links GROUP BY t),
nodes AS (SELECT id FROM up UNION SELECT parent FROM up),
tree(id, root, depth, path) AS (
  SELECT n.id, n.id, CAST(0 AS BIGINT), n.id FROM nodes n WHERE n.id NOT IN (SELECT id FROM up)
  UNION ALL SELECT u.id, t.root, t.depth + 1, t.path || ' > ' || u.id FROM tree t JOIN up u ON u.parent = t.id
),
ringed AS (SELECT id, parent FROM up WHERE id NOT IN (SELECT id FROM tree)),
walk(id, cur, d) AS (SELECT id, id, 0 FROM ringed UNION ALL SELECT w.id, u.parent, w.d + 1 FROM walk w JOIN up u ON u.id = w.cur WHERE w.d < 600),
late AS (SELECT id, min(cur) AS root, bool_or(cur = id) AS on_ring FROM walk WHERE d >= 300 GROUP BY id)
SELECT id, root, depth, 'tree' AS state, path FROM tree
UNION ALL SELECT id, root, CAST(-1 AS BIGINT), CASE WHEN on_ring THEN 'ring' ELSE 'below_ring' END, NULL FROM late""",
}
