"""Streaming queries over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.plans.registry import query
from folioworks.sources import shared
from folioworks.streaming import ingest, progress, windows


@query("stream_events_progress", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_events_progress(spark, folder):
    out = ingest.collected(ingest.windowed_progress(ingest.source(spark, folder, "events")), ["window", "event_type"])
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


@query("stream_ingest_dedup", "SELECT count(DISTINCT sha256(html)) AS files FROM pages")
def stream_ingest_dedup(spark, folder):
    """Two runs over the same pages take each content once."""
    base = shared.place(spark, "ingest")
    pages = ingest.source(spark, folder, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))
    for run in ("one", "two"):
        ingest.ingest_once(pages, f"{base}/archive", f"{base}/{run}")
    return spark.read.parquet(f"{base}/archive").agg(F.count("*").alias("files"))


#: What the events table's types are in a run.
_TYPES = {"signup": "scan", "view": "processing", "click": "done_file", "purchase": "done_file", "error": "error"}


def _timed(spark, folder):
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _TYPES.items()), F.lit("filter"))
    return ingest.source(spark, folder, "events").select((F.col("user_id") % 3).alias("worker"), "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), kind.alias("type"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())
_MARK = "wm AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS w FROM events)"
_RUNS = f"""e AS (SELECT user_id % 3 AS worker, event_id, CASE event_type {_CASE} ELSE 'filter' END AS type, epoch_us(ts) AS tm FROM events, wm WHERE epoch_us(ts) < w),
 p AS (SELECT *, lag(tm) OVER o AS before, lead(tm) OVER o AS after FROM e WINDOW o AS (PARTITION BY worker ORDER BY tm, event_id)),
 r AS (SELECT *, max(CASE WHEN before IS NULL OR tm - before > {1000 * progress.GAP} THEN tm END) OVER (PARTITION BY worker ORDER BY tm, event_id) AS run FROM p),
 c AS (SELECT *, sum(CASE WHEN type IN ('scan', 'filter') THEN 1 ELSE 0 END) OVER q AS found, sum(CASE WHEN type = 'done_file' THEN 1 ELSE 0 END) OVER q AS processed, sum(CASE WHEN type = 'error' THEN 1 ELSE 0 END) OVER q AS errors
  FROM r WINDOW q AS (PARTITION BY worker, run ORDER BY tm, event_id)),
 o AS (SELECT worker, run, 0 AS k, type, tm, event_id, found, processed, errors FROM c UNION ALL SELECT DISTINCT worker, run, -1, 'start', run, NULL, 0, 0, 0 FROM c
  UNION ALL SELECT worker, run, 1, 'heartbeat', t, NULL, found, processed, errors FROM (SELECT *, tm + unnest(range(1, {progress.GAP // progress.BEAT})) * {1000 * progress.BEAT} AS t FROM c), wm WHERE t < coalesce(after, w) AND t < w
  UNION ALL SELECT worker, run, 2, 'done', tm + {1000 * progress.GAP}, NULL, found, processed, errors FROM c, wm WHERE tm + {1000 * progress.GAP} < coalesce(after, w) AND tm + {1000 * progress.GAP} < w)"""


@query("stream_run_states", f"WITH {_MARK}, {_RUNS} SELECT worker, run, row_number() OVER (PARTITION BY worker, run ORDER BY tm, k, event_id) - 1 AS seq, type, tm AS at, event_id, CAST(found AS BIGINT) AS found, CAST(processed AS BIGINT) AS processed, CAST(errors AS BIGINT) AS errors FROM o")
def stream_run_states(spark, folder):
    """Start, scan, filter, processing, done_file, error, heartbeat and done of every run, in order; what the watermark has passed."""
    return progress.gathered(progress.tracked(_timed(spark, folder)), "run-states")


@query("stream_sliding_windows", "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events FROM (SELECT event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR * ((hour(ts) % 2) + 2 * unnest(range(3))) AS w FROM events) GROUP BY 1, 2")
def stream_sliding_windows(spark, folder):
    """K8: events in windows of six hours that begin every two."""
    out = ingest.collected(windows.sliding(_timed(spark, folder), ["event_type"], "6 hours", "2 hours"), ["window", "event_type"])
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events")


@query("stream_session_windows", f"""WITH {_MARK}, e AS (SELECT user_id, epoch_us(ts) AS tm FROM events), g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) < 7200000000 THEN 0 ELSE 1 END AS new FROM e),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(tm) AS start, max(tm) + 7200000000 AS stop, count(*) AS events FROM s, wm GROUP BY user_id, n, w HAVING max(tm) + 7200000000 <= w""")
def stream_session_windows(spark, folder):
    """K8: each user's sessions that two idle hours and the watermark have closed."""
    out = progress.gathered(windows.sessions(_timed(spark, folder), ["user_id"], "2 hours"), "sessions")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "events")


@query("stream_repeats_dropped", "SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_repeats_dropped(spark, folder):
    """K8: a stream that is delivered twice counts once."""
    twice = _timed(spark, folder).unionByName(_timed(spark, folder))
    out = progress.gathered(windows.once(twice, ["event_id"]).select("event_id", "event_type"), "once")
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("stream_interval_join", "SELECT c.user_id, c.event_id AS first_id, p.event_id AS then_id FROM events c JOIN events p ON p.user_id = c.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 12 HOUR")
def stream_interval_join(spark, folder):
    """K8: purchases within twelve hours of a click."""
    clicks, purchases = (_timed(spark, folder).where(F.col("event_type") == kind) for kind in ("click", "purchase"))
    return progress.gathered(windows.followed(clicks, purchases, "user_id", "12 HOURS"), "followed")
