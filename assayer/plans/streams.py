"""Queries that drain a given table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.plans.evidence import QUERIES, query, rounded
from assayer.plans.grounding import tampered
from assayer.plans.oracle import hb
from assayer.sources import scratch, tables
from assayer.streaming import keyed, windows


#: A table's rows may come in files of any order: they are due when the feed is closed.
LATE, IDLE = "4000 days", 4000 * 86_400.0


def _events(s, d):
    """The events as a feed, and its stream."""
    f = keyed.feed(s, f"{d}/events.parquet")
    return f, f.rows


def _runs(e):
    return e.selectExpr("CASE event_id % 6 WHEN 0 THEN 'learned_a' WHEN 1 THEN 'geometric_a' WHEN 2 THEN 'face_a' WHEN 3 THEN 'compression_a' WHEN 4 THEN 'gen_a' ELSE 'gen_b' END AS detector", "event_id AS detection_id", "ts", "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'SKIPPED' WHEN 'view' THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS execution_status", "value AS duration")


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events")
def stream_source(s, d):
    return rounded(keyed.drained(keyed.timed(_events(s, d)[1], LATE).select("event_id", "user_id", "value"), "source"))


@query(f"SELECT id, detector, {hb('concat(id, detector)')} >= 0.4 AS resumed FROM v_scores")
def resume_scoring(s, d):
    """Predictions of a run of which a part was there already; taken up twice."""
    wanted, path, log = (scratch.place(s, name) for name in ("wanted", "predictions", "predictions-log"))
    scores = tables.scores(s, d).select("id", "detector")
    scores.write.parquet(wanted)
    scores.where(stats.hash_bucket(F.concat("id", "detector")) < 0.4).withColumn("resumed", F.lit(False)).write.parquet(f"{path}/_batch=-1")
    for _ in range(2):
        stream = s.readStream.schema(scores.schema).option("maxFilesPerTrigger", 4).parquet(wanted).withColumn("resumed", F.lit(True))
        windows.append_once(stream, path, ["id", "detector"], log)
    return s.read.parquet(path).select("id", "detector", "resumed")


_DETECTOR = "CASE event_id % 6 WHEN 0 THEN 'learned_a' WHEN 1 THEN 'geometric_a' WHEN 2 THEN 'face_a' WHEN 3 THEN 'compression_a' WHEN 4 THEN 'gen_a' ELSE 'gen_b' END"


@query(f"""WITH e AS (SELECT {_DETECTOR} AS detector, event_id, ts, event_type, value, sum((event_type NOT IN ('error', 'signup'))::INT) OVER (PARTITION BY event_id % 6 ORDER BY ts, event_id) AS good FROM events), f AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY detector, good ORDER BY ts, event_id) AS failures FROM e),
p AS (SELECT detector, good, value FROM e WHERE event_type NOT IN ('error', 'signup')), w AS (SELECT detector, good, list(value) OVER (PARTITION BY detector ORDER BY good ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM p)
SELECT f.detector, event_id AS detection_id, CASE WHEN failures >= 3 THEN 'FAILING' WHEN failures > 0 THEN 'DEGRADED' ELSE 'OPERATIONAL' END AS state, failures, round(list_sort(v)[least(len(v), floor(0.95 * len(v))::INT + 1)], 6) AS p95 FROM f LEFT JOIN w ON w.detector = f.detector AND w.good = f.good""")
def stream_health(s, d):
    f, late = keyed.by_time(s, f"{d}/events.parquet", ["event_id", "ts", "event_type", "value"], late=LATE)
    return rounded(keyed.drained(keyed.health(_runs(f.rows), late=late), "health", f))


@query("""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, detector, count(*) AS runs, count(*) FILTER (execution_status='FAILED') AS failed, count(*) FILTER (execution_status='INCONCLUSIVE') AS inconclusive FROM v_detections GROUP BY 1, 2""")
def stream_outcome_windows(s, d):
    f, e = _events(s, d)
    runs = _runs(e).withColumn("execution_status", F.when(F.col("execution_status") == "SKIPPED", "COMPLETED").otherwise(F.col("execution_status")))
    return keyed.drained(windows.outcome_windows(runs, late=LATE), "windows", f).withColumn("window_start", F.unix_timestamp("window_start"))


def stream_rate_limit(s, d):
    """Which requests of each client and endpoint are admitted as they arrive, and when the others may come back."""
    f, e = _events(s, d)
    requests = e.select("user_id", "event_type", F.col("event_id").alias("id"), "ts")
    return keyed.drained(keyed.admission(requests, ["user_id", "event_type"], 86_400, 5, LATE), "admission", f)


def stream_tracks(s, d):
    """The track of each region of each medium, frame by frame."""
    f, late = keyed.by_time(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_shipdate"], "l_shipdate", LATE)
    regions = f.rows.select(F.col("l_shipdate").alias("ts"), (F.col("l_suppkey") % 20).alias("media_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("bigint").alias("frame"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"), *[F.expr(e).alias(n) for n, e in (("x", "double(l_quantity)"), ("y", "double(l_quantity) / 2"), ("w", "10D + double(l_tax) * 100"), ("h", "10D + double(l_discount) * 100"), ("confidence", "double(l_quantity) / 50"))])
    return rounded(keyed.drained(keyed.tracks(regions, late=late, idle=6 * 86_400), "tracks", f))


@query("""SELECT media_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, round(max(combined_score), 6) AS peak_score FROM (SELECT *, sum((hot AND NOT was)::INT) OVER (PARTITION BY media_id ORDER BY frame_index) AS run FROM (SELECT *, combined_score >= 0.45 AS hot, coalesce(lag(combined_score >= 0.45) OVER (PARTITION BY media_id ORDER BY frame_index), false) AS was FROM v_frames)) WHERE hot OR was GROUP BY media_id, run""")
def stream_segments(s, d):
    f, e = _events(s, d)
    frames = e.select(F.col("user_id").alias("media_id"), "ts", F.col("event_id").alias("id"), F.expr("least(value / 100.0D, 1.0D)").alias("score"))
    return rounded(keyed.drained(keyed.segments(frames, late=LATE, idle=IDLE), "segments", f))


def stream_chain_check(s, d):
    """Every event of the audit chains as it arrives, and whether its link holds."""
    path = scratch.place(s, "chains")
    tampered(s, d).withColumn("ts", F.to_timestamp("occurred_at")).write.parquet(path)
    f = keyed.feed(s, path)
    return keyed.drained(keyed.chain_check(f.rows, LATE), "chain", f)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s, d):
    e = _events(s, d)[1].withColumn("sha256", F.sha2(F.concat_ws("|", "user_id", "event_type").cast("binary"), 256))
    return keyed.drained(windows.first_arrivals(e, "sha256", LATE).select("user_id", "event_type"), "arrivals")


@query("SELECT event_id // 4 AS run_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS started FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'purchase') AND epoch_ms(min(ts)) + 3600000 < (SELECT epoch_ms(max(ts)) FROM events)")
def stream_stale_runs(s, d):
    """Judged when the latest event has come."""
    f, events = _events(s, d)
    e = events.select(F.floor(F.col("event_id") / 4).alias("run_id"), "ts", (F.col("event_type") == "purchase").alias("done"))
    latest = s.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {LATE}")).first()[0]
    return keyed.drained(keyed.lost_runs(e, 3600, LATE), "lost", f, latest).select("run_id", F.unix_timestamp("started").alias("started"))


QUERIES |= {f.__name__: f for f in (stream_rate_limit, stream_tracks, stream_chain_check)}
