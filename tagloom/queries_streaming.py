"""Registered queries of the streams: each streams the events table from files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.registry import query
from tagloom.sources import inputs as I
from tagloom.streaming import activity as A


def _events(spark, sf):
    return I.read(spark, sf, "events")


def _stream(spark, sf, at_once=1):
    e = _events(spark, sf)
    return A.as_files(e.select("event_id", "ts", "user_id", "event_type", "value", "props")).stream(spark, at_once)


def _updated(spark, stream, keys):
    """The final table of an aggregate in update mode: state goes when the watermark has passed it."""
    return A.latest(spark, A.run_once(stream, "update"), keys)


@query("stream_activity_source", "SELECT event_id, event_type FROM events WHERE event_id IS NOT NULL AND trim(event_type) <> ''")
def stream_activity_source(spark, sf):
    ok, _ = A.split_valid(_stream(spark, sf))
    return spark.read.parquet(A.run_once(ok.select("event_id", "event_type")))


@query("stream_events_by_type", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_events_by_type(spark, sf):
    return _updated(spark, A.events_by_type(_stream(spark, sf)), ["start", "event_type"])


@query("stream_daily_activity", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_activity(spark, sf):
    return _updated(spark, A.daily_activity(_stream(spark, sf)), ["day"]).withColumn("day", F.to_date("day"))


@query("stream_top_items", """WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(CAST(15 * k AS BIGINT)) AS start, user_id FROM events, (VALUES (0), (1), (2), (3)) v(k)), c AS (SELECT start, user_id, count(*) AS n FROM w GROUP BY ALL)
SELECT start, user_id, n, CAST(rnk AS INT) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id) AS rnk FROM c) x WHERE rnk <= 3""")
def stream_top_items(spark, sf):
    rows = _updated(spark, A.sliding_items(_stream(spark, sf)), ["start", "user_id"])
    return rows.withColumn("rnk", F.row_number().over(W.partitionBy("start").orderBy(F.desc("n"), "user_id"))).where("rnk <= 3")


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'purchase') > 0 AS converted FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    return spark.read.parquet(A.run_once(A.sessions(_stream(spark, sf))))


@query("stream_dedupe", "SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf):
    e = _events(spark, sf)
    twice = e.unionByName(e.where("event_id % 3 = 0")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    stream = A.as_files(twice).stream(spark)
    return spark.read.parquet(A.run_once(A.dedupe(stream, ["event_id"], "1 hour").select("event_id", "event_type")))


@query("stream_upsert", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    table = A.UpsertTable(spark, A._fresh(spark, "upsert"), ["user_id"], ["ts", "event_id"], schema="user_id long, event_id long, ts timestamp")
    A.run_once(_stream(spark, sf).select("user_id", "event_id", "ts"), each=table.write)
    return table.read().select("user_id", "event_id")


@query("stream_click_join", "SELECT a.user_id, a.event_id AS shown_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '10 minutes'")
def stream_click_join(spark, sf):
    e = _events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "props")
    fed = A.as_files(e)
    joined = A.click_join(fed.stream(spark, 8).where("event_type = 'view'"), fed.stream(spark, 8).where("event_type = 'click'"))
    return spark.read.parquet(A.run_once(joined))


@query("stream_running_profile", "SELECT user_id, count(*) AS events, max(ts) AS last_ts FROM events GROUP BY user_id")
def stream_running_profile(spark, sf):
    return _updated(spark, A.running_profile(_stream(spark, sf)), ["user_id"])


@query("stream_late_data", """WITH e AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS batch, date_trunc('hour', ts) AS start FROM events),
m AS (SELECT max(ts) FILTER (batch = 0) - INTERVAL '1 hour' AS w0, max(ts) - INTERVAL '1 hour' AS w2 FROM e),
late AS (SELECT count(DISTINCT (start, event_type)) AS dropped FROM e, m WHERE batch = 2 AND start + INTERVAL '1 hour' <= w0)
SELECT start, event_type, count(*) AS n, (SELECT dropped FROM late) AS dropped FROM e, m WHERE start + INTERVAL '1 hour' <= w2 AND NOT (batch = 2 AND start + INTERVAL '1 hour' <= w0) GROUP BY start, event_type""")
def stream_late_data(spark, sf):
    """A seventh of the events comes after the watermark has closed most of its
    windows. Closed windows without those rows, and how many hours and types of
    them the stream says it has dropped (it counts a file's rows of one window once)."""
    e = _events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "props")
    part = F.col("event_id") % 7
    fed = A.as_batches([e.where(part > 1), e.where(part == 1), e.where(part == 0)])  # lateness is judged by the watermark of the batch before
    out, dropped = A.run_once(A.events_by_type(fed.stream(spark)), counts=["numRowsDroppedByWatermark"])
    return spark.read.parquet(out).withColumn("dropped", F.lit(dropped).cast("long"))
