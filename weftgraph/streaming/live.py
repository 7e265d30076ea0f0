"""Structured Streaming over directories of events and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Events of a directory of Parquet files as they arrive; a single file counts as the only one of its directory that is read."""
    schema = schema or spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repeats of (seq, session, tool, id, ts) that come within the watermark."""
    e = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return e.dropDuplicates(["seq", "session_id", "cs_session", "tool", "id", "event_time"])


def run(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result as a table of the shared folder, written by each micro-batch.

    The checkpoint lies in the shared folder too, so a restarted stream goes on where it was.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is run again overwrites its own directory
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, tool, n_events) of the trace stream."""
    path = f"{sf_dir}/trace_events.parquet"
    first = spark.read.parquet(path).schema
    events = event_stream(spark, path, first).where(F.col("ts").isNotNull())
    distinct = deduplicated(events, "3650 days")
    counts = distinct.groupBy(F.date_trunc("hour", F.col("event_time")).alias("hour"), "tool").agg(F.count(F.lit(1)).alias("n_events"))
    return run(counts, "hourly").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "tool", "n_events")


def enriched(events: DataFrame, files: DataFrame) -> DataFrame:
    """A stream of events joined with what is known of their files (stream-static)."""
    known = files.select("id", F.col("confidence").alias("conf"))
    return events.join(known, "id", "left")


def lease_states(beats: DataFrame, ttl_seconds: int = 15) -> DataFrame:
    """(id, last_seen) of holders whose newest heartbeat of (id, ts) is younger than the time to live, against the newest of all."""
    newest = beats.groupBy("id").agg(F.max("ts").alias("last_seen"))
    now = beats.agg(F.max("ts").alias("now"))
    return newest.join(F.broadcast(now)).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) <= ttl_seconds * 1_000_000).select("id", "last_seen")


def manifests(spark: SparkSession, path: str, schema: str = "id string, mark string, version long") -> DataFrame:
    """Manifests of a tree as they arrive: Parquet files of (id, mark, version), one version a scan."""
    return spark.readStream.schema(schema).parquet(path)


def changes(stream: DataFrame, on_changes) -> None:
    """Runs over the manifests that are there; ``on_changes(changes, version)`` gets the additions, changes and removals of each version.

    A file that a manifest no longer lists is removed, which only the manifest before can tell: it is kept as a table of the shared
    folder. All versions of one micro-batch settle to its newest one, so a burst of scans is one change. A batch that is run again
    after a failure compares with the same table, since that is named after the batch.
    """
    from weftgraph.operators.views import file_changes

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        newest = batch.agg(F.max("version")).first()[0]
        before = spark.read.parquet(f"{base}/{n - 1}") if n else batch.where("false").select("id", "mark")
        if newest is None:
            before.write.mode("overwrite").parquet(f"{base}/{n}")
            return
        batch.where(F.col("version") == newest).select("id", "mark").write.mode("overwrite").parquet(f"{base}/{n}")
        on_changes(file_changes(before, spark.read.parquet(f"{base}/{n}")), newest)

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()


def profile_cycles(pairs: DataFrame, late: str = "1 day") -> DataFrame:
    """Observed pairs of a stream of profile cycles (cf, cl, ef, el, batch_ts), each pair once within the watermark however many cycles see it."""
    return pairs.withColumn("seen_at", F.col("batch_ts").cast("timestamp")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["cf", "cl", "ef", "el"])


def expired_leases(beats: DataFrame, ttl_seconds: int = 15, late: str = "0 seconds") -> DataFrame:
    """(id, first_beat, last_beat, n_beats) of leases of a stream of (id, ts) that ran out: no heartbeat came for the time to live.

    A lease is a session window; its state is kept until the watermark passes its end, which is when it is told, once.
    """
    b = beats.select("id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    leases = b.groupBy("id", F.session_window("at", f"{ttl_seconds} seconds").alias("w")).agg(F.min("at").alias("first_beat"), F.max("at").alias("last_beat"), F.count(F.lit(1)).alias("n_beats"))
    return leases.select("id", "first_beat", "last_beat", "n_beats")
