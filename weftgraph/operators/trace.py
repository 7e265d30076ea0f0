"""Operators over trace events: log, statistics, histogram, sessions, deltas, observed pairs, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_events(events: DataFrame) -> DataFrame:
    """Events without exact repeats; maps are compared by their sorted entries."""
    return events.withColumn("_m", F.to_json(F.array_sort(F.map_entries("meta")))).dropDuplicates(["seq", "session_id", "cs_session", "tool", "id", "ts", "_m"]).drop("_m")


def trust(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events with ``conf`` and ``dyn`` of the file they name where it is known (a join with the snapshot)."""
    known = files.select("id", F.col("confidence").alias("conf"), (F.size(F.coalesce("dynamic_patterns", F.array())) > 0).alias("dyn"))
    return events.join(known, "id", "left")


def histogram(events: DataFrame, n: int = 20) -> DataFrame:
    """(bucket, n_events) of ``n`` equal stretches between first and last event; the last takes its end. No span, no rows."""
    t = events.where(F.col("ts").isNotNull()).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    ends = t.agg(F.min("u").alias("a"), F.max("u").alias("b"))
    at = F.least(F.lit(n - 1), F.floor((F.col("u") - F.col("a")) * n / (F.col("b") - F.col("a"))))
    return t.join(F.broadcast(ends)).where(F.col("b") > F.col("a")).groupBy(at.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n_events"))


def sessions(events: DataFrame) -> DataFrame:
    """One row a session: events, tools, files, first and last moment, seconds."""
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("tool").alias("n_tools"), F.count_distinct("id").alias("n_files"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).cast("long").alias("seconds"),
    )


def log(events: DataFrame, since=None, tool: str | None = None, limit: int = 200) -> DataFrame:
    """The newest ``limit`` events after ``since``, of one tool if named."""
    out = events
    if since is not None:
        out = out.where(F.col("ts") > F.lit(since))
    if tool:
        out = out.where(F.col("tool") == tool)
    return out.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit)


def delta(events: DataFrame, after: int, session: str | None = None) -> DataFrame:
    """Events past a cursor, which is a monotonic ``seq``; of one client session, if named, with those of none."""
    out = events.where(F.col("seq") > after)
    return out.where(F.col("cs_session").isNull() | (F.col("cs_session") == session)) if session else out


def newest_per(df: DataFrame, keys: list[str], order: str, keep: int = 1) -> DataFrame:
    """The ``keep`` newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def versions(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """(id, ts, content) of which a version equal to the one before is skipped and the newest ``keep`` stay."""
    w = Window.partitionBy("id").orderBy("ts")
    changed = snapshots.withColumn("_p", F.lag("content").over(w)).where(~F.col("_p").eqNullSafe(F.col("content")) | F.col("_p").isNull())
    return newest_per(changed.drop("_p"), ["id"], "ts", keep)


def classify_observed(pairs: DataFrame, confident: DataFrame, candidate: DataFrame) -> DataFrame:
    """(s, t, verdict) of distinct observed pairs: static, candidate or new; self pairs are dropped."""
    p = pairs.select("s", "t").where(F.col("s") != F.col("t")).distinct()
    a = confident.select("s", "t").distinct().withColumn("_a", F.lit(True))
    b = candidate.select("s", "t").distinct().withColumn("_b", F.lit(True))
    j = p.join(a, ["s", "t"], "left").join(b, ["s", "t"], "left")
    return j.select("s", "t", F.when(F.col("_a"), "confirmed-static").when(F.col("_b"), "confirmed-candidate").otherwise("new-dynamic").alias("verdict"))


def commit_days(commits: DataFrame) -> DataFrame:
    """(day, n_commits, n_files) of a history of (commit, ts, id): what each UTC day added."""
    return commits.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("commit").alias("n_commits"), F.count_distinct("id").alias("n_files"))
