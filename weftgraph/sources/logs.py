"""Event logs and profiles: JSON lines, runtime profiles, observed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "seq long, session_id long, cs_session string, tool string, id string, ts timestamp, meta map<string,string>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that are no JSON are dropped, lines of type ``meta`` are left out."""
    rows = spark.read.schema(EVENT + ", type string").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce("type", F.lit("")) != "meta").drop("type")


def append_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, one directory a session."""
    events.write.mode("append").partitionBy("session_id").json(path)


def profile_pairs(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(cf, cl, ef, el): distinct caller and callee positions of sampling profiles whose nodes list their children.

    Each profile is one JSON document; parent and child nodes meet by an equi-join on (profile, node id).
    """
    frame = "struct<functionName:string,url:string,lineNumber:long>"
    schema = f"struct<nodes:array<struct<id:long,callFrame:{frame},children:array<long>>>>"
    docs = spark.read.option("wholetext", True).text(path).select(F.xxhash64("value").alias("p"), F.from_json("value", schema).alias("j"))
    nodes = docs.select("p", F.explode("j.nodes").alias("n")).select("p", "n.id", "n.children", F.regexp_replace("n.callFrame.url", "^file://", "").alias("f"), (F.col("n.callFrame.lineNumber") + 1).alias("l"))
    links = nodes.select("p", F.explode("children").alias("id"), F.col("f").alias("cf"), F.col("l").alias("cl"))
    pairs = links.join(nodes.select("p", "id", F.col("f").alias("ef"), F.col("l").alias("el")), ["p", "id"])
    inside = lambda c: F.startswith(F.col(c), F.lit(root)) & (F.col(c) != "")
    return pairs.where(inside("cf") & inside("ef")).select("cf", "cl", "ef", "el").distinct()


def valid_observed(observed: DataFrame, files: DataFrame) -> DataFrame:
    """Newest observation of each pair whose files have not changed since (``mtime`` of (id, mtime) equal on both sides)."""
    newest = observed.groupBy("cf", "cl", "ef", "el").agg(F.max_by(F.struct("cf_mtime", "ef_mtime"), "batch_ts").alias("m"))
    a = files.select(F.col("id").alias("cf"), F.col("mtime").alias("_a"))
    b = files.select(F.col("id").alias("ef"), F.col("mtime").alias("_b"))
    j = newest.join(a, "cf").join(b, "ef")
    return j.where((F.col("m.cf_mtime") == F.col("_a")) & (F.col("m.ef_mtime") == F.col("_b"))).select("cf", "cl", "ef", "el")
