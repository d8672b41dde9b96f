"""Every query beside its DuckDB twin, and invariants of those that have none."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from assayer.plans import evidence  # the entry registers all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    return "" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(evidence.ORACLE))
def test_twin(spark, data, duck, name):
    df = evidence.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cur = duck.execute(evidence.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in places) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_wilson_published(spark):
    """Published counts and their intervals."""
    from pyspark.sql import functions as F

    from assayer.functions.stats import wilson

    rows = spark.createDataFrame([(48, 60, 0.68, 0.88), (5, 60, 0.04, 0.18), (34, 100, 0.25, 0.44), (4, 100, 0.02, 0.10), (783, 1428, 0.52, 0.57)], "k int, n int, low double, high double")
    _, low, high = wilson(F.col("k"), F.col("n"))
    for r in rows.select("low", "high", low.alias("a"), high.alias("b")).collect():
        assert math.isclose(r.low, r.a, abs_tol=0.0051) and math.isclose(r.high, r.b, abs_tol=0.0051)
    none = spark.createDataFrame([(0, 0)], "k int, n int").select(*wilson(F.col("k"), F.col("n"))).first()
    assert tuple(none) == (None, None, None)


def chain(spark, n=6):
    """Two hash chains, linked by their own digests."""
    import hashlib
    import json

    rows = []
    for c in ("a", "b"):
        before = None
        for i in range(1, n + 1):
            own = hashlib.sha256(json.dumps([str(i), f"act{i}", before or ""], separators=(",", ":")).encode()).hexdigest()
            rows.append([c, i, f"act{i}", before, own])
            before = own
    return rows, "chain string, sequence bigint, action string, previous_event_hash string, event_hash string"


def test_chain_is_whole(spark):
    from assayer.operators.records import verify_links

    rows, schema = chain(spark)
    assert {r.chain: (r.checked, r.first_broken) for r in verify_links(spark.createDataFrame(rows, schema), "chain").collect()} == {"a": (6, 0), "b": (6, 0)}


@pytest.mark.parametrize("at", [1, 3, 6])
def test_chain_shows_an_edit(spark, at):
    from assayer.operators.records import verify_links

    rows, schema = chain(spark)
    rows[at - 1][2] = "edited"
    out = {r.chain: r.first_broken for r in verify_links(spark.createDataFrame(rows, schema), "chain").collect()}
    assert out == {"a": at, "b": 0}


def test_hamming_join_is_exact(spark):
    import random

    from assayer.operators.retrieval import hamming_join

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base]
    signed = lambda x: (x & (2**64 - 1)) - (2**64 if x & (1 << 63) else 0)
    a = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(base)], "id bigint, code bigint")
    b = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(near)], "id bigint, code bigint")
    got = {(r.a_id, r.b_id, r.distance) for r in hamming_join(a, b, 3).collect()}
    assert got == {(i, j, (x ^ signed(y) & (2**64 - 1)).bit_count()) for i, x in enumerate(base) for j, y in enumerate(near) if (x ^ y & (2**64 - 1)).bit_count() <= 3}


def test_stream_windows_match_the_table(spark, data, tmp_path):
    from assayer.sources import tables
    from assayer.streaming import windows

    runs = tables.detections(spark, data)
    runs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))
    q = windows.outcome_windows(stream, late="1000 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("window_start", "detector", "runs", "failed", "inconclusive").collect()))
    assert key(spark.table("w")) == key(windows.outcome_windows(runs))


def test_moving_window_reads_a_key_in_batches(spark, monkeypatch):
    """One key of many batches; a frame of the whole key is never asked for."""
    import datetime
    import random

    from pyspark.sql.group import GroupedData

    from assayer.operators.calibration import admitted

    def whole(*_):
        raise AssertionError("a whole key in one frame")

    monkeypatch.setattr(GroupedData, "applyInPandas", whole, raising=False)
    rng, start = random.Random(0), datetime.datetime(2024, 1, 1)
    rows = [(u, start + datetime.timedelta(seconds=rng.randrange(20_000)), i) for i, u in enumerate([1] * 900 + [2] * 40 + [None] * 40)]
    expected, held = {}, {}
    for u, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        own = held[u] = [x for x in held.get(u, []) if x > t - datetime.timedelta(seconds=600)]
        expected[i] = len(own) < 3
        if expected[i]:
            own.append(t)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.id: r.admitted for r in admitted(spark.createDataFrame(rows, "u bigint, ts timestamp, id bigint"), ["u"], 600, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected
