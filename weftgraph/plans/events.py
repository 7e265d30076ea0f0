"""Queries over trace events and the event stream, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import graph, trace
from weftgraph.session import table
from weftgraph.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_EV = "ev AS (SELECT DISTINCT seq, session_id, cs_session, tool, id, ts FROM trace_events)"


def _events(spark, d):
    return table(spark, d, "trace_events").select("seq", "session_id", "cs_session", "tool", "id", "ts").distinct()


@query(f"WITH {_EV} SELECT tool, count(*) AS n_events, count(DISTINCT id) AS n_files FROM ev GROUP BY tool")
def a31_by_tool(spark, d):
    return _events(spark, d).groupBy("tool").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("id").alias("n_files"))


@query(f"WITH {_EV} SELECT id, count(*) AS n_events FROM ev WHERE id IS NOT NULL GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def a31_top_files(spark, d):
    return _events(spark, d).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.col("n_events").desc(), "id").limit(20)


@query(f"WITH {_EV}, b AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM ev) SELECT least(19, floor((epoch_us(ts) - a) * 20 / (b - a)))::BIGINT AS bucket, count(*) AS n_events FROM ev, b WHERE ts IS NOT NULL AND b > a GROUP BY 1")
def a31_histogram(spark, d):
    return trace.histogram(_events(spark, d))


@query(f"WITH {_EV} SELECT session_id, count(*) AS n_events, count(DISTINCT tool) AS n_tools, count(DISTINCT id) AS n_files, min(ts) AS first_ts, max(ts) AS last_ts, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS seconds FROM ev GROUP BY session_id")
def w6_sessions(spark, d):
    return trace.sessions(_events(spark, d))


@query(f"WITH {_EV} SELECT seq, session_id, tool, id, ts FROM ev WHERE ts > TIMESTAMP '2023-06-01' AND tool = 'edit' ORDER BY ts DESC, seq DESC LIMIT 200")
def w4_log(spark, d):
    return trace.log(_events(spark, d), since=F.lit("2023-06-01 00:00:00").cast("timestamp_ntz"), tool="edit").select("seq", "session_id", "tool", "id", "ts")


@query(f"WITH {_EV} SELECT seq, session_id, tool, id FROM ev WHERE seq > (SELECT max(seq) // 2 FROM ev) AND cs_session IS NULL")
def w5_delta(spark, d):
    e = _events(spark, d)
    half = e.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    return trace.delta(e, half).where("cs_session is null").select("seq", "session_id", "tool", "id")


@query(f"""WITH {_EV}, lf AS (SELECT * FROM (SELECT id, confidence, dynamic_patterns, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, size DESC NULLS LAST, loc DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)
 SELECT e.tool, l.confidence AS conf, coalesce(len(l.dynamic_patterns), 0) > 0 AS dyn, count(*) AS n FROM ev e LEFT JOIN lf l ON l.id = e.id WHERE l.id IS NOT NULL GROUP BY 1, 2, 3""")
def w4_trust(spark, d):
    f = graph.snapshot(table(spark, d, "files").select("id", "ext", "size", "loc", "last_seen", "confidence", "dynamic_patterns"))
    return trace.trust(_events(spark, d), f).where("dyn is not null").groupBy("tool", "conf", "dyn").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV} SELECT id, tool, ts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, seq DESC) AS r FROM ev WHERE id IS NOT NULL) WHERE r = 1")
def a30_newest_observation(spark, d):
    e = _events(spark, d).where("id is not null")
    return e.groupBy("id").agg(F.max_by(F.struct("tool", "ts"), F.struct("ts", "seq")).alias("x")).select("id", "x.tool", "x.ts")


@query(f"""WITH {_EV}, p AS (SELECT id AS s, lead(id) OVER (PARTITION BY session_id ORDER BY ts, seq, tool, id) AS t FROM ev WHERE id IS NOT NULL), o AS (SELECT DISTINCT s, t FROM p WHERE t IS NOT NULL AND s <> t),
 c AS (SELECT DISTINCT s, t FROM edges WHERE k IN ('import', 'require', 'include', 'reexport')), m AS (SELECT DISTINCT s, t FROM edges WHERE k IN ('dynamic', 'ref', 'mock'))
 SELECT o.s, o.t, CASE WHEN c.s IS NOT NULL THEN 'confirmed-static' WHEN m.s IS NOT NULL THEN 'confirmed-candidate' ELSE 'new-dynamic' END AS verdict FROM o LEFT JOIN c ON c.s = o.s AND c.t = o.t LEFT JOIN m ON m.s = o.s AND m.t = o.t""")
def a29_observed_pairs(spark, d):
    """Files visited one after the other in a session, against static and candidate edges."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("ts", "seq", "tool", "id")
    p = _events(spark, d).where("id is not null").select(F.col("id").alias("s"), F.lead("id").over(w).alias("t")).where("t is not null")
    e = table(spark, d, "edges").select("s", "t", "k")
    return trace.classify_observed(p, e.where(F.col("k").isin("import", "require", "include", "reexport")), e.where(F.col("k").isin("dynamic", "ref", "mock")))


@query(f"""WITH {_EV} SELECT date_trunc('hour', ts) AS hour, tool, count(*) AS n_events FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2""")
def w1_stream_hourly(spark, d):
    """The stream of events, without repeats, counted by hour; the same rows as a batch gives."""
    return live.hourly(spark, d)


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n_events FROM n GROUP BY user_id, k""")
def w6_gap_sessions(spark, d):
    """Sessions of a user that end after half an hour without an event."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n_events")
