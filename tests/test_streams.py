"""Streams in several orders of files beside their batch forms, on tables that are files or folders."""

import datetime
import itertools
import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators import audit, calibration, sequences
from assayer.plans import streams
from assayer.plans.grounding import tampered
from assayer.sources import tables
from assayer.streaming import keyed

FILES = 3


def split(df, folder, order, by):
    """The rows of df in FILES files by time, which come in the given order, one a batch."""
    rows = df.toArrow().sort_by([(c, "ascending") for c in by])
    import pyarrow.parquet as pq

    for k, part in enumerate(order):
        n = -(-rows.num_rows // FILES)
        pq.write_table(rows.slice(part * n, n), f"{folder}/part-{k}.parquet")
        os.utime(f"{folder}/part-{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module", params=[(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def order(request):
    return request.param


@pytest.fixture
def events(spark, data, order, tmp_path):
    path = split(tables.table(spark, data, "events").where("user_id % 6 = 0"), tmp_path, order, ["ts", "event_id"])
    return keyed.feed(spark, path, files=1), spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def test_segments_in_any_order(events):
    feed, table = events
    score = F.expr("least(value / 100.0D, 1.0D)")
    got = keyed.drained(keyed.segments(feed.rows.select(F.col("user_id").alias("media_id"), "ts", F.col("event_id").alias("id"), score.alias("score")), late=streams.LATE, idle=streams.IDLE), "s", feed)
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    batch = sequences.suspicious_segments(table.select(F.col("user_id").alias("media_id"), at.cast("bigint").alias("frame_index"), score.alias("combined_score")))
    cols = ["media_id", "start_frame", "end_frame", "peak_score"]
    assert rows(got, *cols) == rows(batch, *cols) != []


def test_admission_in_any_order(events):
    feed, table = events
    cols = ["user_id", "event_type", F.col("event_id").alias("id"), "ts"]
    got = keyed.drained(keyed.admission(feed.rows.select(*cols), ["user_id", "event_type"], 864_000, 2, streams.LATE), "a", feed)
    batch = calibration.admitted(table.select(*cols), ["user_id", "event_type"], 864_000, 2)
    assert rows(got, "id", "admitted") == rows(batch, "id", "admitted") and got.where("not admitted").count() > 0


def test_chains_in_any_order(spark, data, order, tmp_path):
    chains = tampered(spark, data).where("chain % 2 = 1").withColumn("ts", F.to_timestamp("occurred_at"))
    feed = keyed.feed(spark, split(chains, tmp_path, order, ["ts", "sequence"]), files=1)
    got = keyed.drained(keyed.chain_check(feed.rows, streams.LATE), "c", feed)
    first = {r.chain: r.first for r in got.where("not ok").groupBy("chain").agg(F.min("sequence").alias("first")).collect()}
    assert first == {r.chain: r.first_broken_sequence for r in audit.verify(tampered(spark, data).where("chain % 2 = 1")).where("not intact").collect()} != {}
    assert got.count() == chains.count()


def test_tracks_and_health_do_not_depend_on_order(spark, order, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    regions = [(m, at + datetime.timedelta(seconds=f), f, 10 * f + r, float(5 * r + f), 1.0, 8.0, 8.0, 0.3 + 0.2 * r) for m in range(3) for f in range(12) for r in range(3) if f % 7 < 6]
    df = spark.createDataFrame(regions, "media_id bigint, ts timestamp, frame bigint, id bigint, x double, y double, w double, h double, confidence double")
    (tmp_path / "one").mkdir(), (tmp_path / "many").mkdir(), (tmp_path / "runs").mkdir()
    whole = keyed.feed(spark, split(df, tmp_path / "one", (0, 1, 2), ["ts", "id"]))
    parts = keyed.feed(spark, split(df, tmp_path / "many", order, ["ts", "id"]), files=1)
    cols = ["media_id", "frame", "id", "track", "confidence"]
    expected = rows(keyed.drained(keyed.tracks(whole.rows, late="1 day", idle=60), "t", whole).na.fill(-1), *cols)
    assert rows(keyed.drained(keyed.tracks(parts.rows, late="1 day", idle=60), "t", parts).na.fill(-1), *cols) == expected and len(expected) == len(regions)
    runs = spark.createDataFrame([("d", i, at + datetime.timedelta(minutes=i), "FAILED" if i % 5 > 1 else "COMPLETED", float(i)) for i in range(20)], "detector string, detection_id bigint, ts timestamp, execution_status string, duration double")
    feed = keyed.feed(spark, split(runs, tmp_path / "runs", order, ["ts"]), files=1)
    got = rows(keyed.drained(keyed.health(feed.rows, late="1 day"), "h", feed), "detection_id", "state", "failures")
    assert got == [(i, "FAILING" if i % 5 == 4 else "DEGRADED" if i % 5 > 1 else "OPERATIONAL", max(0, i % 5 - 1)) for i in range(20)]


def test_late_rows_are_counted_and_idle_keys_go(spark, tmp_path):
    """Hours 0 to 2 in the first file, 3 to 5 in the second, and then hour 0 again; the delay is an hour."""
    at = datetime.datetime(2024, 1, 1)
    frames = [(m, at + datetime.timedelta(hours=h), 10 * h + m, 0.9) for h in range(6) for m in (h // 3,)]
    import pyarrow.parquet as pq

    for k, part in enumerate((frames[:3], frames[3:], frames[:1])):
        pq.write_table(spark.createDataFrame(part, "media_id bigint, ts timestamp, id bigint, score double").toArrow(), f"{tmp_path}/part-{k}.parquet")
        os.utime(f"{tmp_path}/part-{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    feed = keyed.feed(spark, str(tmp_path), files=1)
    stream = keyed.segments(feed.rows, late="1 hour", idle=3600)
    open_ = keyed.drain(stream, "s")
    assert (rows(open_.rows, "media_id", "start_frame", "end_frame"), open_.late) == ([(0, 0, 2)], 1)  # medium 1 is not idle yet
    closed = keyed.drain(stream, "s", feed)
    assert (rows(closed.rows, "media_id", "start_frame", "end_frame"), closed.late) == ([(0, 0, 2), (1, 0, 2)], 1)


@pytest.mark.parametrize("kind", ["admission", "lost"])
def test_many_keys_share_few_states(spark, tmp_path, monkeypatch, kind):
    """Keys (one of them null, others beyond 2^53) are dealt into parts, and a part has one state."""
    monkeypatch.setattr(keyed, "PARTS", 3)
    at = datetime.datetime(2024, 1, 1)
    keys = [2**60 + k for k in range(40)] + ([None] if kind == "admission" else [])
    table = spark.createDataFrame([(k, 10 * i + n, at + datetime.timedelta(hours=n)) for i, k in enumerate(keys) for n in range(4)], "k bigint, id bigint, ts timestamp")
    table.coalesce(1).write.parquet(f"{tmp_path}/rows")
    feed = keyed.feed(spark, f"{tmp_path}/rows")
    stream = keyed.admission(feed.rows, ["k"], 10_800, 2, "1 day") if kind == "admission" else keyed.lost_runs(feed.rows.select(F.col("k").alias("run_id"), "ts", (F.col("id") % 20 == 0).alias("done")), 3600, "1 day")
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = keyed.drained(stream, "parts", feed)
    if kind == "admission":
        assert {(r.k, r.id, r.admitted) for r in got.collect()} == {(k, 10 * i + n, n != 2) for i, k in enumerate(keys) for n in range(4)}
    else:
        assert sorted(r.run_id for r in got.collect()) == keys[1::2]


def test_tracks_are_matched_in_blocks(monkeypatch):
    """Greedy pairs, ties included, beside a sorted list of all; hundreds of boxes a frame don't make a list of pairs."""
    import numpy as np

    rng = np.random.default_rng(8)
    for block, (n, m, most) in itertools.product((64, 1 << 17), ((40, 30, 50), (60, 60, 3), (50, 60, 1), (0, 4, 9), (1, 1, 1))):
        monkeypatch.setattr(keyed, "AT_ONCE", block)
        a, b = (np.stack([x, x / 2, 10 + rng.integers(0, 3, k), 10.0 + rng.integers(0, 3, k)], 1) for k, x in ((k, rng.integers(0, most, k).astype(float)) for k in (n, m)))
        of = {}
        for minus, t, i in sorted((-keyed.overlap(x, y), t, i) for t, x in enumerate(a.tolist()) for i, y in enumerate(b.tolist())):
            if -minus > 0.3 and i not in of and t not in of.values():
                of[i] = t
        assert keyed.matched(a, b, 0.3).tolist() == [of.get(i, -1) for i in range(m)]
    monkeypatch.setattr(keyed, "ROUNDS", 0)  # of copies none is left to be sorted
    same = np.tile([[1.0, 1.0, 5.0, 5.0]], (200, 1))
    assert keyed.matched(same, same, 0.3).tolist() == list(range(200))


def test_tables_by_time_hold_few_rows(spark, data, monkeypatch):
    """Files of one range of time each, read in order: nothing is late, and a state holds a few files' rows."""
    queries = ((streams.stream_health, ["detector", "detection_id", "state", "failures", "p95"]), (streams.stream_tracks, ["media_id", "frame", "id", "track", "confidence"]))
    want = [rows(q(spark, data).na.fill(-1), *cols) for q, cols in queries]
    monkeypatch.setattr(keyed, "SLICE", 1_500)
    assert rows(streams.stream_tracks(spark, data).na.fill(-1), *queries[1][1]) == want[1]
    monkeypatch.setattr(keyed, "SLICE", 250)
    monkeypatch.setattr(keyed, "PIECE", 20)  # a key's rows come to a step in pieces
    assert rows(streams.stream_health(spark, data).na.fill(-1), *queries[0][1]) == want[0]
    feed, late = keyed.by_time(spark, f"{data}/events.parquet", ["event_id", "ts", "event_type", "value"], late=streams.LATE)
    done = keyed.drain(keyed.health(streams._runs(feed.rows), late=late), "h")
    table = spark.read.parquet(f"{data}/events.parquet").count()
    assert late == "1 second" and done.late == 0 and table - 600 < done.rows.count() < table  # all but the last files' rows before the feed is closed


def test_tables_that_are_folders(spark, data, tmp_path):
    """Five files, one a batch: the queries of a folder give what those of a file give."""
    tables.table(spark, data, "events").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for query, cols in ((streams.stream_source, ["event_id", "user_id"]), (streams.stream_dedupe, ["user_id", "event_type"]), (streams.stream_stale_runs, ["run_id", "started"]), (streams.stream_outcome_windows, ["window_start", "detector", "runs", "failed"])):
        assert rows(query(spark, str(tmp_path)), *cols) == rows(query(spark, data), *cols) != []


def test_a_stopped_run_writes_each_key_once(spark, tmp_path):
    """A batch fails after it has written, is tried again from the log, and later files repeat keys."""
    from assayer.streaming import windows

    stream = lambda: spark.readStream.schema("id bigint, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    put = lambda k, ids: (spark.createDataFrame([(i, f"file {k}") for i in ids], "id bigint, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"))
    put(0, [1, 2, 2])
    windows.append_once(stream(), f"{tmp_path}/out", ["id"], f"{tmp_path}/log")
    put(1, [2, 3])

    def broken(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/_batch={number}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream().writeStream.foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    put(2, [1, 4])
    for _ in range(2):
        windows.append_once(stream(), f"{tmp_path}/out", ["id"], f"{tmp_path}/log")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "v") == [(1, "file 0"), (2, "file 0"), (3, "file 1"), (4, "file 2")]
