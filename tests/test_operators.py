"""Operators that no SQL expresses, beside brute force, and rules at their edges."""

import datetime
import hashlib
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import stats, text
from assayer.operators import audit, calibration, evaluation, grounding, ranks, sequences, splits
from assayer.plans import streams
from assayer.plans.grounding import tampered
from assayer.sources import longfiles, manifests, scratch, tables


def scored(spark, n=400, seed=0, separable=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % 3 == 0
        s = rng.beta(5, 2) if y else rng.beta(2, 5)
        rows.append((str(i), f"g{i % 40}", "d", float((0.9 if y else 0.1) if separable else s), bool(y)))
    return rows, spark.createDataFrame(rows, "id string, grp string, detector string, score double, target boolean")


def plain_platt(x, y, w):
    """Minimum of the same penalised loss, by many small gradient steps from a fine grid."""
    p, n = (w * y).sum(), (w * (1 - y)).sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    loss = lambda a, b: (w * (np.logaddexp(0, a * x + b) - t * (a * x + b))).sum() + 0.5e-3 * a * a
    best, step = (1.0, 0.0), 1.0
    while step > 1e-9:
        near = [(best[0] + i * step, best[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        new = min(near, key=lambda ab: loss(*ab))
        step, best = (step / 2, best) if new == best else (step, new)
    return best


def test_fit_platt_is_the_minimum(spark):
    rows, df = scored(spark)
    x = np.array([math.log(r[3] / (1 - r[3])) for r in rows])
    a, b = calibration.fit_platt(df, "detector")["d"][0]
    pa_, pb = plain_platt(x, np.array([float(r[4]) for r in rows]), np.ones(len(rows)))
    assert abs(a - pa_) < 1e-5 and abs(b - pb) < 1e-5
    assert calibration.fit_platt(df.where("target"), "detector") == {"d": [None]}
    a, _ = calibration.fit_platt(scored(spark, separable=True)[1], "detector")["d"][0]
    assert 0 < a <= calibration.STEEPEST
    down = df.withColumn("score", 1 - F.col("score"))
    assert calibration.fit_platt(down, "detector") == {"d": [None]}


def test_group_bootstrap_draws_whole_groups(spark):
    """Resamples surround the fit, rows of a group are drawn together, and copies of rows do not narrow the spread."""
    rows, df = scored(spark)
    a, b = calibration.fit_platt(df, "detector")["d"][0]
    fits = [t for t in calibration.fit_platt(df, "detector", 60, "grp")["d"] if t]
    slopes = np.array([t[0] for t in fits])
    assert len(fits) > 50 and np.quantile(slopes, 0.05) < a < np.quantile(slopes, 0.95)
    twice = [t for t in calibration.fit_platt(df.unionByName(df), "detector", 60, "grp")["d"] if t]
    assert abs(np.std([t[0] for t in twice]) / np.std(slopes) - 1) < 0.1
    w = calibration.drawn(np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def plain_auc(pos, neg):
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auc_bootstrap_is_exact(spark, monkeypatch):
    """Each resample's area equals that of the drawn rows, ties and batches included."""
    monkeypatch.setattr(calibration, "AT_ONCE", 7)
    rows, df = scored(spark, 60)
    df = df.withColumn("score", F.round("score", 1))
    key = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    reps = 40
    w = calibration.drawn(np.array([key[r[0]] for r in rows], np.int64).view(np.uint64), reps)
    areas = sorted(plain_auc([round(r[3], 1) for r, k in zip(rows, w[:, j], strict=True) if r[4] for _ in range(k)], [round(r[3], 1) for r, k in zip(rows, w[:, j], strict=True) if not r[4] for _ in range(k)]) for j in range(reps))
    got = calibration.auc_bootstrap(df, "detector", reps).first()
    assert abs(got.low - areas[int(0.025 * reps)]) < 1e-9 and abs(got.high - areas[int(0.975 * reps) - 1]) < 1e-9


def test_percentiles_of_ties_and_single_rows(spark):
    rng = random.Random(0)
    rows = [("a", float(rng.randrange(4))) for _ in range(301)] + [("b", 5.0)] + [("c", x * 1e9) for x in (0.0, 1.0)] + [("d", None)]
    got = {r.g: (r.q, r.h) for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q": 0.3, "h": 0.95}).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g], [30, 95]))
    assert "d" not in got


def test_ranges_hold_like_many_rows(spark):
    """One value far from the others, two thirds of one value, and values that grow by powers: no range but that of the tie is crowded, and order holds."""
    rng = np.random.default_rng(0)
    rows = [("far", float(x)) for x in rng.random(20_000)] + [("far", 1e12)] + [("tie", 7.0)] * 12_000 + [("tie", float(x)) for x in rng.random(8_000) * 20] + [("wide", float(10 ** rng.uniform(-200, 200))) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = ranks.ranged(df, ["g"], "v").groupBy("g", "range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "range").collect()
    for g in ("far", "tie", "wide"):
        own = [r for r in counts if r.g == g]
        assert all(a.high < b.low for a, b in zip(own, own[1:], strict=False)) and all(0 <= r.range < ranks.RANGES for r in own)
        assert all(r.n <= 4 * 20_000 / ranks.RANGES + 4 for r in own if not r.low <= 7.0 <= r.high or g != "tie")
    got = {r.g: (r.q, r.h) for r in ranks.percentiles(df, ["g"], "v", {"q": 0.3, "h": 0.999}).collect()}
    for g in ("far", "tie", "wide"):
        assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g], [30, 99.9]), rtol=1e-9)


def test_pooled_blocks_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(d, float(np.round(s, 3)), bool(rng.random() < p(s))) for d, p in (("a", lambda s: s), ("b", lambda s: 0.3), ("c", lambda s: float(s > 0.5)), ("d", lambda s: 1.0)) for s in rng.random(3000)]
    got = {r.detector: r.cllr_min for r in evaluation.cllr_min(spark.createDataFrame(rows, "detector string, score double, target boolean"), "detector").collect()}
    assert set(got) == {"a", "b", "c"}
    for d in got:
        counts = {}
        for k, s, t in rows:
            if k == d:
                y, n = counts.get(s, (0, 0))
                counts[s] = (y + t, n + 1)
        blocks = []
        for s in sorted(counts):
            blocks.append(list(counts[s]))
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                y, n = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n]
        pos, neg = sum(y for y, _ in blocks), sum(n - y for y, n in blocks)
        odds = [(max(1e-12, min(1 - 1e-12, y / n)), y, n - y) for y, n in blocks]
        cost = sum(y / pos * math.log2(1 + pos / neg * (1 - p) / p) + k / neg * math.log2(1 + neg / pos * p / (1 - p)) for p, y, k in odds) / 2
        assert got[d] == pytest.approx(cost, abs=1e-9)


def test_recalibration_never_costs_more(spark):
    _, df = scored(spark)
    low = evaluation.cllr_min(df, "detector").first().cllr_min
    for k in (2.0, 8.0):
        assert low <= evaluation.cllr(df, k * (F.col("score") - 0.5), "detector").first().cllr + 1e-9


def test_region_match_is_one_by_one(spark):
    rng = random.Random(1)
    box = lambda: [float(rng.randrange(6)), float(rng.randrange(6)), float(rng.randrange(3, 8)), float(rng.randrange(3, 8))]
    a = [(f, t, *box()) for f in range(12) for t in range(6)]
    b = [(f, r, *box()) for f in range(12) for r in range(6)]
    got = {(r.frame, r.track_id, r.region_id) for r in sequences.region_match(spark.createDataFrame(a, "frame int, track_id int, x double, y double, w double, h double"), spark.createDataFrame(b, "frame int, region_id int, x double, y double, w double, h double")).collect()}
    from assayer.streaming.keyed import overlap

    expected = set()
    for f in range(12):
        pairs = sorted((-overlap(list(x[2:]), list(y[2:])), x[1], y[1]) for x in a for y in b if x[0] == y[0] == f)
        left, right = set(), set()
        for minus, t, r in pairs:
            if -minus > 0.3 and t not in left and r not in right:
                left.add(t), right.add(r), expected.add((f, t, r))
    assert got == expected and got


def test_region_match_of_copies_and_short_lists(spark, monkeypatch):
    """Lists of two partners, blocks of three classes and many ties and copies: what a plain loop takes, over fewer listed pairs than there are."""
    monkeypatch.setattr(sequences, "LISTED", 2)
    monkeypatch.setattr(sequences, "CLASSES", 3)
    from assayer.streaming.keyed import overlap

    listed, taken = sequences._listed, sequences._taken
    rng = random.Random(5)
    for _ in range(4):
        box = lambda: (float(rng.randrange(4)), 0.0, 8.0, float(rng.choice((8, 10))))
        a, b = [(i, box()) for i in range(60)], [(i, box() if i % 9 else (0.25 * i, 1.0, 9.0, 9.0)) for i in range(70)]
        classes = lambda rows, side: [{"side": side, "frame": 0, "class": 1000 * side + n, **dict(zip("xywh", x, strict=True)), "ids": [i for i, y in rows if y == x]} for n, x in enumerate(sorted({x for _, x in rows}))]
        kinds = pa.schema({"side": pa.int32(), "frame": pa.int32(), "class": pa.int64(), **dict.fromkeys("xywh", pa.float64()), "ids": pa.list_(pa.int64())})
        rest, got = classes(a, 0) + classes(b, 1), set()
        while rest:
            table = pa.Table.from_pylist(rest, schema=kinds)
            one, two = (table.filter(pa.array([r["side"] == s for r in rest])) for s in (0, 1))
            out = taken(listed(one, two, 0.3), table).to_pylist()
            now = {(r["track_id"], r["region_id"]) for r in out if r["side"] is None}
            assert now, "each round takes a pair"
            got |= now
            rest = [{c: r[c] for c in kinds.names} for r in out if r["side"] is not None]
        left, right, want = set(), set(), set()
        for minus, t, r in sorted((-overlap(list(x), list(y)), t, r) for t, x in a for r, y in b):
            if -minus > 0.3 and t not in left and r not in right:
                left.add(t), right.add(r), want.add((t, r))
        assert got == want
    frame = lambda rows, name: spark.createDataFrame([(0, i, *x) for i, x in rows], f"frame int, {name} int, x double, y double, w double, h double")
    assert {(r.track_id, r.region_id) for r in sequences.region_match(frame(a, "track_id"), frame(b, "region_id")).collect()} == want


def test_mask_areas_are_flood_fills(spark):
    rng = random.Random(2)
    grids = {k: [[rng.random() for _ in range(9)] for _ in range(9)] for k in range(5)}
    rows = [(k, y, x, g[y][x]) for k, g in grids.items() for y in range(9) for x in range(9)]
    got = {r.k: (r.share, r.areas, r.kept_share) for r in sequences.mask_summary(spark.createDataFrame(rows, "k int, y bigint, x bigint, value double"), "k", 0.45, 0.03).collect()}
    for k, g in grids.items():
        todo, areas = {(y, x) for y in range(9) for x in range(9) if g[y][x] >= 0.45}, []
        share = len(todo) / 81
        while todo:
            stack, n = [todo.pop()], 0
            while stack:
                y, x = stack.pop()
                n += 1
                for c in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    if c in todo:
                        todo.remove(c), stack.append(c)
            areas.append(n)
        kept = [n for n in areas if n >= 81 * 0.03]
        assert got[k] == (pytest.approx(share), len(kept), pytest.approx(sum(kept) / 81))


def test_mask_areas_take_no_job_for_each_step(spark):
    """An area that winds through its map is labelled at once: no job for each step along it; a map without values at the threshold has no area."""
    n = 15
    winding = [(1, y, x, float(y % 2 == 0 or x == (n - 1 if y % 4 == 1 else 0))) for y in range(n) for x in range(n)]
    pixels = spark.createDataFrame([*winding, (2, 0, 0, 0.0), (2, 0, 1, None)], "k int, y bigint, x bigint, value double")
    spark.sparkContext.setJobGroup("winding", "")
    got = {r.k: r for r in sequences.mask_summary(pixels, "k", 0.5).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("winding")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    cells = sum(v for _, _, _, v in winding)
    assert (got[1].share, got[1].areas, got[1].kept_share) == (pytest.approx(cells / n**2), 1, pytest.approx(cells / n**2))
    assert (got[2].share, got[2].areas, got[2].kept_share) == (0.0, 0, 0.0)
    assert len(jobs) < 6


def test_quotas_take_the_best_source_each_time(spark):
    rows = [("a", "x", 50, 100), ("a", "y", 5, 100), ("b", "x", 30, 30), ("c", "y", 40, 400), ("d", "z", 99, 1)]
    plan = splits.quota_plan(spark.createDataFrame(rows, "source string, class string, rows bigint, bytes bigint"), {"x": 60, "y": 20}, 40)
    assert plan == [("b", 30), ("a", 35), ("c", 15)]


def test_files_and_locks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one"), (tmp_path / "b.bin").write_bytes(b"")
    assert {(r.name, r.bytes, r.sha256) for r in manifests.digests(spark, str(tmp_path)).collect()} == {("a.bin", 3, hashlib.sha256(b"one").hexdigest())}
    twice = spark.createDataFrame([("1", "real", "s"), ("2", "real", "s")], "id string, label string, sha256 string")
    with pytest.raises(Exception, match="same bytes"):
        manifests.write_lock(twice, scratch.place(spark, "lock"))
    path = scratch.place(spark, "lock")
    manifests.write_lock(twice.limit(1), path, schema=9)
    with pytest.raises(ValueError, match="schema"):
        manifests.read_lock(spark, path)


def test_long_files_are_read_by_steps(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    mark = b"\xef\xbb\xbf"
    files = {"random.bin": rng.randbytes(9_000), "a b%.bin": mark + rng.randbytes(4_000) + b"x", "end.bin": mark + rng.randbytes(4_000) + b"\n", "ends.bin": b"\r\n" * 2_500 + b"\n\n", "none.bin": b"\0" * 7_000, "short.bin": b"s" * 10, "packed.gz": rng.randbytes(900)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    small = {"spark.sql.sources.binaryFile.maxLength": 1_000, "spark.sql.files.maxPartitionBytes": 2_000, "spark.sql.files.openCostInBytes": 1}  # in place of 2 GB and 128 MB
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = {r.name: (r.bytes, r.sha256) for r in manifests.digests(spark, str(tmp_path), whole=500, step=3_000).collect()}
        assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
        lines = spark.read.format("text").option("lineSep", "\n").load(str(tmp_path / "random.bin"))
        listed = lines.select("_metadata.file_path").distinct().select(F.lit("random.bin").alias("path"), F.lit(9_001).cast("bigint").alias("length"), F.col("file_path").alias("file"))
        steps = longfiles.pieces(lines, listed.withColumn("place", F.lit(0)), 3_000).groupBy("step").agg(F.sum("bytes").alias("bytes")).collect()
        line = max(map(len, files["random.bin"].split(b"\n"))) + 1
        assert len(steps) == 3 and max(r.bytes for r in steps) <= 3_000 + 2_000 + line
        assert longfiles.digests(spark, lines, listed.withColumn("length", F.col("length") + 9), 3_000).first().sha256 is None  # fewer bytes are read than the file should have
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10_000)
        monkeypatch.setattr(longfiles, "LINE", dict.fromkeys(longfiles.LINE, 5_000))  # none.bin is one line of 7,000
        assert got == {r.name: (r.bytes, r.sha256) for r in manifests.digests(spark, str(tmp_path), whole=500, step=3_000).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_manifests_refuse_labels_and_take_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a", "label": "real"}, {"file": "b", "label": "ai_generated", "kind": "k", "more": 3}], indent=1))
    got = {r.id: (r.group, r.generator, r.extra) for r in manifests.scan_manifest(spark, str(tmp_path / "m.json"), multiline=True).collect()}
    assert got == {"a": ("a", None, {}), "b": ("b", "k", {"more": "3"})}
    (tmp_path / "bad.jsonl").write_text('{"file": "a", "label": "fake"}\n\n')
    with pytest.raises(Exception, match="label must be one of"):
        manifests.scan_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_claims_at_the_edges(spark):
    """Precision, percentages, separators, other brackets, several lines, and what is no claim."""
    answers = spark.createDataFrame([(1, "<think>5 of 7</think>It weighs 12.4 kg【T1；T2】. About 1,200 files, 37% of all [T1, T9]\nSee https://a.example/x). v2 and T3 stay\n**Heading**\n日本 3 files")], "k int, text string")
    evidence = spark.createDataFrame([(1, "T1", '{"kg": 12.36, "files": 1200, "share": 0.3701}'), (1, "T2", "plain https://a.example/x/")], "k int, id string, text string")
    rows = {r.place: r for r in grounding.grounded(answers, evidence, "k").collect()}
    flags = [(p, f.type, f.value) for p, r in sorted(rows.items()) for f in r.flags]
    assert flags == [(0, "uncited", None), (1, "unknown_citation", "T9"), (2, "uncited", None)] or ("unsupported_number", "12.4") not in [(t, v) for _, t, v in flags]
    assert not any(t.startswith("unsupported") for _, t, _ in flags)
    wrong = spark.createDataFrame([(1, "T1", '{"kg": 12.46, "share": 0.38}')], "k int, id string, text string")
    bad = [(f.type, f.value) for r in grounding.grounded(answers, wrong, "k").collect() for f in r.flags if f.type.startswith("unsupported")]
    assert ("unsupported_number", "12.4") in bad and ("unsupported_number", "37%") in bad and ("unsupported_number", "1,200") in bad and ("unsupported_url", "https://a.example/x") in bad
    none = grounding.grounded(answers, wrong.limit(0), "k")
    assert none.count() == len(rows)


def test_facts_are_never_broadcast(spark):
    """A row of evidence explodes into many facts, which Spark's estimate of its size leaves out."""
    answers = spark.createDataFrame([(1, "It weighs 12 kg [T1].")], "k int, text string")
    evidence = spark.createDataFrame([(1, "T1", '{"kg": 12}')], "k int, id string, text string")
    found = grounding.range_join(spark.createDataFrame([(1, "12")], "k int, token string"), spark.createDataFrame([(1, 12.0)], "k int, n double"), "k")
    for df in (grounding.grounded(answers, evidence, "k"), found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.first().supported


def test_every_single_tampering_is_found(spark):
    events = spark.createDataFrame([("c", i, f"2024-01-0{i}", "me", "act", None, None, f"a{i}", {"k": str(i), "b": "é"}) for i in range(1, 8)], "chain string, sequence bigint, occurred_at string, actor string, action string, case_id string, media_id string, analysis_id string, details map<string,string>")
    good = audit.chained(events)
    assert audit.verify(good).first().asDict() == {"chain": "c", "intact": True, "events_checked": 7, "head_hash": audit.heads(good).first().head_hash, "first_broken_sequence": None, "reason": None}
    for column, value in (("actor", F.lit("you")), ("case_id", F.lit("x")), ("details", F.create_map(F.lit("k"), F.lit("9"))), ("event_hash", F.lit("0" * 64)), ("previous_event_hash", F.lit("0" * 63 + "1"))):
        for at in (1, 4, 7):
            r = audit.verify(good.withColumn(column, F.when(F.col("sequence") == at, value).otherwise(F.col(column)))).first()
            assert not r.intact and r.first_broken_sequence == at and r.events_checked == at - 1
    assert audit.verify(good.where("sequence <> 4")).first().reason == "expected sequence 4, found 5"
    assert audit.verify(good.where("sequence > 1")).first().first_broken_sequence == 2
    assert audit.verify(good.where("sequence < 6")).first().intact  # a cut end cannot be seen


def test_streams_equal_their_batch_forms(spark, data):
    e = tables.table(spark, data, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("id"))
    batch = {r.id: (r.admitted, r.retry_after) for r in calibration.admitted(e, ["user_id", "event_type"], 86_400, 5).collect()}
    assert {r.id: (r.admitted, r.retry_after) for r in streams.stream_rate_limit(spark, data).collect()} == batch
    first = {}
    for r in streams.stream_chain_check(spark, data).orderBy("sequence").collect():
        if not r.ok:
            first.setdefault(r.chain, r.sequence)
    assert first == {r.chain: r.first_broken_sequence for r in audit.verify(tampered(spark, data)).where("not intact").collect()}


def test_tracks_are_one_to_one_and_end(spark, data):
    rows = streams.stream_tracks(spark, data).collect()
    at = {}
    for r in rows:
        if r.track is not None:
            assert (r.media_id, r.frame, r.track) not in at
            at[r.media_id, r.frame, r.track] = r.id
    assert len({r.id for r in rows}) == len(rows) == tables.table(spark, data, "lineitem").count()
    assert all(r.track is not None for r in rows if r.confidence >= 0.4)


def test_windows_of_first_arrivals(spark, tmp_path):
    """A content that comes twice, in two files of a stream."""
    from assayer.streaming import windows

    at = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate(([("a", at), ("b", at), ("a", at)], [("a", at + datetime.timedelta(hours=1)), ("c", at)])):
        spark.createDataFrame(rows, "sha256 string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 2
    stream = spark.readStream.schema("sha256 string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from assayer.streaming.keyed import drained

    assert sorted(r.sha256 for r in drained(windows.first_arrivals(stream, "sha256", "1 day"), "first").collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("distance", range(9))
def test_hamming_join_beside_all_pairs(spark, distance):
    """Codes at 0 to 10 bits from one another, repeated codes, and the sign bit."""
    from assayer.operators import retrieval

    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    near = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(11)))
    sides = [[near(rng.choice(base)) for _ in range(120)] + [base[0]] * 5 for _ in range(2)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    a, b = (spark.createDataFrame([(i, signed(x)) for i, x in enumerate(s)], "id bigint, code bigint") for s in sides)
    got = sorted(map(tuple, retrieval.hamming_join(a, b, distance).collect()))
    assert got == sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if (x ^ y).bit_count() <= distance) != []
    assert sum(len(retrieval._within(r)) for r in retrieval.radii(distance) if r >= 0) <= 188


def test_near_documents_are_all_found(spark):
    """Edited copies about the limit, texts of few words, empty and null ones."""
    from assayer.operators import retrieval

    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "one"), (4, "one  two"), (5, "One two")]
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 30, 120]))] + ["a common line of these texts"] * (i % 3)
        rows.append((100 * i + 100, " ".join(words)))
        for k in range(3):
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(500)}"
            rows.append((100 * i + 101 + k, " ".join(words)))
    runs = lambda t: (lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split())
    one = {}
    for i, t in rows:
        one.setdefault(t or "", i)
    sets = sorted((i, runs(t)) for t, i in one.items())
    expected = {(i, j): len(x & y) / len(x | y) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if len(x & y) >= 0.8 * len(x | y)}
    got = {(r.a_id, r.b_id): r.similarity for r in retrieval.near_documents(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert got == pytest.approx(expected) and len(got) > 20
    codes = dict(map(tuple, retrieval.text_codes(spark.createDataFrame(rows[:3], "id bigint, text string"), "id", "text").collect()))
    assert codes[1] == codes[2] == 0 and codes[3] != 0


def test_near_groups_follow_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    codes = [b ^ (1 << rng.randrange(64)) * (k > 0) ^ (1 << rng.randrange(64)) * (k > 1) for b in base for k in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in codes]
    got = {r.id: r.group for r in splits.near_groups(spark.createDataFrame(list(enumerate(signed)), "id bigint, code bigint"), 3).collect()}
    least = {i: i for i in got}
    for _ in codes:
        for i, x in enumerate(codes):
            for j, y in enumerate(codes):
                if (x ^ y).bit_count() <= 3:
                    least[i] = least[j] = min(least[i], least[j])
    assert got == least


def test_addresses_beside_the_standard_library(spark):
    """Random and chosen literals; what is no literal is null."""
    import ipaddress

    rng = random.Random(4)
    heads = [0x2001 << 112, 0x20010DB8 << 96, 0x2002 << 112, 0x3FFF << 112, 0xFE80 << 112, 0xFC00 << 112, 0xFF02 << 112, 0x0064FF9B << 96, 0x26064700 << 96, 0, 0xFFFF << 32, 0x20010001 << 96, 0x20010003 << 96, 0x200100040112 << 80, 0x20010020 << 96]
    numbers = [h | rng.getrandbits(k) for h in heads for k in (1, 16, 32, 64)] + [(0x20010001 << 96) + 1, (0x20010001 << 96) + 2, 1, 0]
    written = [str(ipaddress.IPv6Address(n)) for n in numbers] + [ipaddress.IPv6Address(n).exploded.upper() for n in numbers]
    written += ["::ffff:8.8.8.8", "::FFFF:10.0.0.1", "2001:4860:0:0:0:0:8.8.8.8", "fe80::1%eth0"]
    none = ["1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1", "1:", "1.2.3.4::", "::1.2.3", "", "example.org", "::ffff:1.2.3.256"]
    got = dict(spark.createDataFrame([(x,) for x in written + none], "a string").select("a", text.ip_is_public(F.col("a"))).collect())
    for x in written:
        a = ipaddress.IPv6Address(x.partition("%")[0])
        a = a.ipv4_mapped or a
        routed = a.version == 4 or a in ipaddress.ip_network("2000::/3")
        blocks = [(ipaddress.ip_network(f"{b}/{p}"), ok) for part, ok in ((text.NOT_PUBLIC_6, False), (text.ROUTED_6, True)) for b, p in part]
        longest = max((b for b in blocks if a.version == 6 and a in b[0]), key=lambda b: b[0].prefixlen, default=(None, True))
        assert got[x] == (a.is_global and not a.is_multicast if a.version == 4 else routed and longest[1]), x
    assert all(got[x] is None for x in none), [x for x in none if got[x] is not None]
    assert [spark.range(1).select(text.url_policy(F.lit(u))).first()[0] for u in ("http://[::1]/a", "http://[fe80::1]/", "http://[fd00::1]:80/x", "http://[2606:4700::1111]/")] == ["not public"] * 3 + ["allowed"]


def test_character_references_beside_the_standard_library(spark):
    import html

    rng = random.Random(7)
    bits = ["&amp;", "&lt;", "&eacute;", "&eacute", "&notit;", "&not", "&copy 2", "&#233;", "&#xE9;", "&#xe9", "&#0;", "&#128;", "&#x9f;", "&#129;", "&#1114112;", "&#99999999999;", "&#xD800;", "&#13;", "&#1;", "&#x1F600;", "&", "&&", "&;", "&#;", "&#x;", "&CounterClockwiseContourIntegral;", "a", "é", " ", "&amp;lt;", "&ampx", "&#64976;", "&#xFFFF;", "&bogus;", "&NotEqualTilde;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(300)] + bits + [None]
    got = dict(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.unescaped(F.col("t"))).collect())
    assert [got[i] for i in range(len(texts))] == [t if t is None else html.unescape(t) for t in texts]


def test_sizes_of_nested_lists(spark):
    import json

    def sizes(x):
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return ([len(x)] if isinstance(x, (dict, list)) else []) + [n for y in inner for n in sizes(y)]

    rng = random.Random(5)
    make = lambda d: rng.choice([1, None, True, "a,[b", 'q"{', "\\", ""]) if d == 0 or rng.random() < 0.3 else [make(d - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {f"k{i},": make(d - 1) for i in range(rng.randrange(4))}
    values = [make(5) for _ in range(200)]
    deep = "[" * 90 + "]" * 90
    rows = [(i, json.dumps(v, indent=rng.choice([None, 2]))) for i, v in enumerate(values)] + [(900, deep), (901, "{oops"), (902, None), (903, json.dumps(["x" * 200_000, "\\" * 50_000]))]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", grounding.json_sizes(F.col("t"))).collect())
    assert all(sorted(got[i]) == sorted(sizes(v)) for i, v in enumerate(values))
    assert sorted(got[900]) == [0] + [1] * 89 and got[901] == [] and not got[902] and got[903] == [2]


def test_scalars_at_the_edges(spark):
    one = spark.range(1)
    ips = {"8.8.8.8": True, "10.0.0.1": False, "::ffff:192.168.1.1": False, "192.0.0.9": True, "100.64.0.1": False, "224.0.0.1": False, "example.org": None, "1.2.3": None, "256.1.1.1": None}
    assert one.select(*[text.ip_is_public(F.lit(k)).alias(f"c{i}") for i, k in enumerate(ips)]).first()[:] == tuple(ips.values())
    r = one.select(text.scrub(F.lit(None).cast("string")).alias("a"), text.scrub(F.lit("x" * 300)).alias("b"), text.stated_date(F.lit("2024:02:30 10:00:00")).alias("c"), text.stated_date(F.lit(None).cast("string")).alias("d"), stats.bits_apart(F.lit("01"), F.lit("0")).alias("e"), stats.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("f")).first()
    assert r.a is None and len(r.b) == 240 and r.b.endswith("…") and tuple(r.c) == tuple(r.d) == (None, None) and r.e == 2 and r.f is None


def test_statements_say_no_more_than_the_record(spark):
    from assayer.operators import fusion

    rows = [
        (1, "manipulation", 2.31, 1.0, "SUPPORTS", "moderate"), (2, "manipulation", 1.5, 1.5, "AGAINST", "moderate"), (3, "ai_generation", -2.0, -1.2, "AGAINST", "moderate"),
        (4, "manipulation", 0.4, 0.2, "LIMITED", "limited"), (5, "manipulation", 1.0, 0.5, "CONFLICTING", "limited"), (6, "ai_generation", None, None, "NOT_ASSESSED", None),
    ]
    got = {r.analysis_id: r.statement for r in fusion.statement(spark.createDataFrame(rows, "analysis_id int, branch string, independent double, dependent double, status string, strength string")).collect()}
    assert got[1] == "What the detectors show is between 10 and 204 times more probable if the file was edited (moderate support)."
    assert "is 31 times more probable if not the file was edited" in got[2]
    assert "between 15 and 100 times more probable if not" in got[3] and got[3].endswith("That does not show that it came from a camera.")
    assert "hardly tell" in got[4] and "opposite directions" in got[5] and got[6] == "No calibrated detector ran on this question."


def test_scrub_makes_its_words_once(spark):
    df = spark.createDataFrame([("ab  " * 100,), ("open /srv/a b/c.bin  now",), (None,), ("",)], "r string").select(text.scrub(F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [("ab " * 80)[:239] + "…", "open <file> now", None, ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_range_join_sorts_tokens_among_evidence(spark):
    """What a plain loop supports, beside edges of blocks too, with two shuffles in all."""
    rng = random.Random(7)
    tokens = ["1,024", "1023.5", "2047.96", "0", "102400%", "7%", "0.5%", *[f"{rng.uniform(0, 3000):.{rng.randrange(3)}f}{rng.choice(('', '%'))}" for _ in range(300)]]
    known = [1024.4, 1023.6, 2048.0, 0.3, 1024.0, 0.071, None, *[rng.uniform(0, 3000) if i % 2 else rng.uniform(0, 30) for i in range(200)]]
    rows = [(k, t) for k in (1, 2) for t in tokens]
    found = grounding.range_join(spark.createDataFrame([*rows, *rows[:9], (3, "4")], "k int, token string"), spark.createDataFrame([(k, n) for k in (1, 2) for n in known[k - 1 :: k]], "k int, n double"), "k")

    def supported(t: str, of: list) -> bool:
        v, slack = float(t.replace(",", "").rstrip("%")), 0.5 * 10.0 ** -len(t.rstrip("%").partition(".")[2]) + 1e-9
        return any(abs(n * s - v) <= slack for n in of if n is not None for s in ((1.0, 100.0) if t.endswith("%") else (1.0,)))

    want = {(k, t): supported(t, known[k - 1 :: k]) for k, t in rows} | {(3, "4"): False}
    got = [((r.k, r.token), r.supported) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want and 0 < sum(want.values()) < len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.rpartition("Initial Plan")[2].count("Exchange") == 2


def test_bootstrap_sums_only_what_has_not_settled(spark):
    """Sums of the resamples that have a theta alone, as a plain sum over rows gives them; a key's draws do not depend on how many rows it has."""
    rng = np.random.default_rng(3)
    x, y, key = rng.normal(size=500), (rng.random(500) < 0.4).astype(float), rng.integers(-(2**62), 2**62, 7)[rng.integers(0, 7, 500)]
    df = spark.createDataFrame([("d", float(a), float(b), int(k)) for a, b, k in zip(x, y, key, strict=True)], "g string, x double, y double, key bigint")
    counts = {k: tuple(v) for k, v in calibration._sums(df, 5, None, None).items()}
    assert set(counts) == {("d", r) for r in range(5)}
    got = calibration._sums(df, 5, {("d", 1): np.array([1.3, -0.2]), ("d", 4): np.array([40.0, 9.0])}, counts)
    assert set(got) == {("d", 1), ("d", 4)}
    for (_, r), (a, b) in {("d", 1): (1.3, -0.2), ("d", 4): (40.0, 9.0)}.items():
        w = np.concatenate([calibration.drawn(np.array([k], np.int64).view(np.uint64), 5)[:, r] for k in key]).astype(float)
        n = counts["d", r]
        assert n == pytest.approx(((w * y).sum(), (w * (1 - y)).sum()))
        t, z = np.where(y > 0, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2)), a * x + b
        p = 0.5 * (1 + np.tanh(z / 2))
        v, e = w * (p * (1 - p) + 1e-12), w * (p - t)
        assert got["d", r] == pytest.approx([(w * (np.logaddexp(0, z) - t * z)).sum(), (e * x).sum(), e.sum(), (v * x * x).sum(), (v * x).sum(), v.sum()], rel=1e-9, abs=1e-9)
