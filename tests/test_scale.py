"""What queries shuffle and how their work grows: each test holds a bound that an earlier form of its query broke."""

import random

from pyspark.sql import functions as F

from assayer.operators import audit, grounding, retrieval, splits
from assayer.sources.scratch import kept


def shuffled(spark, action) -> tuple[int, int]:
    """(rows, bytes) that the stages of an action write to shuffles."""
    gateway = spark.sparkContext._gateway

    def stages() -> list:
        found = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    action()
    new = [s for s in stages() if s.stageId() not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def test_near_documents_shuffle_prefixes_and_one_count_of_runs(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(300)) for _ in range(120)]
    texts += [t + " end" for t in texts[:5]] + ["all texts begin so and go on " + t for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = []
    _, size = shuffled(spark, lambda: found.extend(retrieval.near_documents(df, "id", "text").collect()))
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [runs(t) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {(r.a_id, r.b_id) for r in found} == want
    assert size < 20 * sum(map(len, sets)), size / sum(map(len, sets))


def test_text_codes_shuffle_a_row_for_each_text(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(500))) for i in range(50)], "id bigint, text string")
    rows, _ = shuffled(spark, lambda: retrieval.text_codes(df, "id", "text").collect())
    assert rows <= 50  # a row for each different word of each text before


def test_hamming_join_spreads_crowded_bands(spark):
    """All codes share three bands; what meets is lists, dealt to all tasks, and lists are cut."""
    rng = random.Random(5)
    codes = [rng.randrange(1 << 16) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    lists = retrieval._met(retrieval.once(df), retrieval.once(df), 3)
    assert lists.rdd.getNumPartitions() == 4 and lists.count() < 1_000  # 600 times 600 candidates before
    got = {(r.a_id, r.b_id, r.distance) for r in retrieval.hamming_join(df, df, 3).collect()}
    assert got == {(i, j, (x ^ y).bit_count()) for i, x in enumerate(codes) for j, y in enumerate(codes) if (x ^ y).bit_count() <= 3}


def test_hamming_join_deals_copies_of_one_code(spark):
    """Pairs of rows of one code are listed by many tasks, and by none all of them."""
    df = spark.createDataFrame([(i, 7 if i < 3_000 else i << 20) for i in range(3_200)], "id bigint, code bigint")
    found = retrieval.hamming_join(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_500 * 1_500 == found.distinct().count() and max(sizes) < 0.6 * sum(sizes)  # all in one task before


def test_drop_near_meets_lists_and_takes_the_least_id(spark):
    rng = random.Random(7)
    codes = [rng.randrange(1 << 12) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    items, reference = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    got = {r.id: (r.distance, r.near_duplicate_of) for r in splits.drop_near(items, reference, 4).collect()}
    best = {i: min(((x ^ y).bit_count(), j) for j, y in enumerate(codes) if j % 3 == 0) for i, x in enumerate(codes) if i % 3}
    assert got == {i: b if b[0] <= 4 else (None, None) for i, b in best.items()}
    rows, _ = shuffled(spark, lambda: retrieval.hamming_nearest(retrieval.once(items), retrieval.once(reference), 4).collect())
    assert rows < 12_000  # a row for each pair before


def test_near_groups_hold_fewer_links_than_pairs(spark):
    rng = random.Random(6)
    codes = sorted({sum(1 << b for b in rng.sample(range(16), 2)) for _ in range(400)} | {rng.getrandbits(62) for _ in range(50)})
    df = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    near = [(i, j) for i, x in enumerate(codes) for j, y in enumerate(codes) if i != j and (x ^ y).bit_count() <= 4]
    assert retrieval.hamming_links(df, 4).count() < len(near) / 4
    want = list(range(len(codes)))
    for _ in codes:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert {r.id: r.group for r in splits.near_groups(df, 4).collect()} == dict(enumerate(want))


def test_verify_shuffles_digests_once(spark):
    rows = [(c, i + 1, "actor", "act", "x" * 3_000, c == 3 and i == 4) for c in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "chain bigint, sequence bigint, actor string, action string, analysis_id string, bad boolean")
    df = df.selectExpr("*", "cast(null as string) case_id", "cast(null as string) media_id", "map('k', 'v') details", "'t' occurred_at")
    c = kept(audit.chained(df), "chains").withColumn("action", F.when(F.col("bad"), "edited").otherwise(F.col("action")))
    with_twin = c.unionByName(c.where("chain = 5 and sequence = 7").withColumn("event_hash", F.lit("other")))  # two events of one number
    out = {}
    _, size = shuffled(spark, lambda: out.update({r.chain: r for r in audit.verify(with_twin).collect()}))
    assert [out[k].intact for k in range(6)] == [True, True, True, False, True, False]
    assert (out[3].first_broken_sequence, out[3].events_checked, out[3].reason) == (5, 4, audit.CONTENTS_BROKEN)
    assert (out[5].first_broken_sequence, out[5].events_checked) == (7, 6)
    assert out[0].events_checked == 20 and size < 60_000
    assert "BroadcastHashJoin" not in (plan := audit.verify(with_twin)._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan


def test_grounding_shuffles_texts_once(spark):
    """No token or fact is shuffled: one exchange of the texts of answers and results, whatever follows."""
    n = 300
    answers = spark.createDataFrame([(i, f"Order {i} of {i + 7} weighs {i}.5 kg [T1, T2]. It is {i % 90}% done on 2024-01-0{i % 9 + 1} 10:00 [T3].") for i in range(n)], "k int, text string")
    evidence = spark.createDataFrame([(i, f"T{j}", f'{{"order": {i}, "list": [1, 2, {i + 7}], "at": "2024-01-0{i % 7 + 1}T10:00:00.25Z", "share": {(i % 90) / 100}}}') for i in range(n) for j in (1, 2)], "k int, id string, text string")
    found = grounding.grounded(answers, evidence, "k")
    whole = found.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    got = {}
    records, _ = shuffled(spark, lambda: got.update({r.k: r.text for r in whole.collect()}))
    assert records == 3 * n  # a row for each token, fact and sentence before, several times
    assert got[3] == "Order 3 of 10 weighs [unverified] kg [T1, T2].\nIt is 3% done on 2024-01-04 10:00 ." and "[unverified] ." in got[7]


def test_times_that_stand_in_a_result(spark):
    """Every time of which a result holds the characters, with a blank or a T, and no other."""
    result = "x2024-03-05T10:20:30.123+02:00y 2023-01-02 07:08Z 99991-12-31 2020:01:02 03:04:05 2019-05-06T11:12:13.5 1999-09-09T01:02:3"
    days = ["2024-03-05", "2023-01-02", "9991-12-31", "9999-12-31", "2019-05-06", "1999-09-09"]
    clocks = ["", "T10:20", "T10:20:30", "T10:20:30.1", "T10:20:30.12", "T10:20:30.123", "T10:20:30.123+02:00", "T10:20:30.12+02:00", "T10:20:30+02:00", "T10:20:30.1234", "T10:20+02:00", "T07:08", "T07:08Z", "T07:08:00", "T11:12:13.5", "T11:12:13.5Z", "T11:12:13.", "T01:02", "T01:02:03"]
    times = [day + c for day in days for c in clocks if not c.endswith(".")]
    times += [t.replace("T", " ") for t in times] + ["2020:01:02 03:04:05", "2020:01:02 03:04:06"]
    answers = spark.createDataFrame([(i, f"Taken on {t}, they say.") for i, t in enumerate(times)], "k int, text string")
    evidence = spark.createDataFrame([(i, "T1", result) for i in range(len(times))], "k int, id string, text string")
    for r in grounding.grounded(answers, evidence, "k").where("place = 0").collect():
        stands = times[r.k] in result or times[r.k].replace(" ", "T") in result
        assert ("unsupported_timestamp" not in [f.type for f in r.flags]) == stands, (times[r.k], r.flags)
