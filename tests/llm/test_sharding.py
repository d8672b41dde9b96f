"""Operator 7: balance, order of slots, and how few groups are cut, beside a plain partition."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.llm import common, sharding


def check(rows, n, shards):
    """Sizes at most one apart and slots gapless; gives the shards of each text."""
    by, of = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        of.setdefault(r.text_crc32, Counter())[r.shard] += 1
    counts = [len(by.get(i, [])) for i in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return of


def cut_pairs(of):
    """The share of pairs of equal texts that lie in two shards."""
    every = sum(n * (n - 1) // 2 for n in (c.total() for c in of.values()))
    return 1 - sum(k * (k - 1) // 2 for c in of.values() for k in c.values()) / max(1, every)


@pytest.mark.parametrize(("size", "most"), [(2, 0.05), (20, 0.08), (60, 0.12)])
def test_mostly_copies(spark, size, most):
    """Nine tenths of the rows in groups: few pairs are cut, where a plain partition by id cuts nine of ten; more where a group is a tenth of a shard."""
    n, shards = 6000, 10
    df = spark.createDataFrame([(i, f"copy {i // size}" if i < 0.9 * n else f"own {i}") for i in range(n)], "doc_id bigint, text string")
    of = check(sharding.shard(df, shards).collect(), n, shards)
    assert cut_pairs(of) < most


def test_a_hot_group_keeps_to_few_shards(spark, monkeypatch):
    """A third of all rows is one text: it fills as few shards as parts of four fifths allow, and no join brings it into one task."""
    n = 3000
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 6}") for i in range(n)], "doc_id bigint, text string")
    of = check(sharding.shard(df, 10).collect(), n, 10)
    hot = max(of.values(), key=Counter.total)
    assert hot.total() == 1000 and sum(k for _, k in hot.most_common(5)) >= 950
    monkeypatch.setattr(common, "HEAVY", 20)
    check(sharding.shard(df, 10).collect(), n, 10)


def test_units_move_within_quotas(spark):
    """A round never fills a shard beyond its quota by more than what swaps left behind."""
    units = spark.createDataFrame([(f"g{g}", 0, b, b, 1 + (g + b) % 3) for g in range(200) for b in range(8)], "g string, part int, began int, shard int, n bigint")
    total = units.groupBy().sum("n").first()[0]
    after = sharding.propagate(sharding.wishes(units), total // 8, 0)
    assert after.groupBy().sum("n").first()[0] == total and after.count() == 1600
    apart = lambda u: sharding.wishes(u).where("want <> shard").groupBy().sum("n").first()[0] or 0
    assert apart(sharding.settled(units, total // 8)) < 0.3 * apart(units)


def plain_round(units, quota, hashes, gates):
    """The same round with loops: what moves between two shards is what goes the other way, and a part of the room beyond that."""
    votes, load = {}, Counter()
    for (g, part, began), (shard, n) in units.items():
        votes.setdefault((g, part), Counter())[shard] += n
        load[shard] += n
    want = {k: max(c, key=lambda s: (c[s], hashes[(*k, s)])) for k, c in votes.items()}
    out, by_gate = Counter(), Counter()
    for (g, part, _), (shard, n) in units.items():
        if want[g, part] != shard:
            out[shard, want[g, part]] += n
            by_gate[shard, want[g, part], gates[g, part]] += n
    more = {(a, b): n - min(n, out[b, a]) for (a, b), n in out.items()}
    every = Counter()
    for (_, b), n in more.items():
        every[b] += n
    open_ = set()
    for a, b in out:
        room = max(0, int(sharding.FULL * quota) - load[b])
        allowed = out[a, b] - more[a, b] + (min(more[a, b], int(room * more[a, b] / every[b])) if every[b] else 0)
        before = 0
        for gate in sorted(g for x, y, g in by_gate if (x, y) == (a, b)):
            if before + by_gate[a, b, gate] <= allowed:
                open_.add((a, b, gate))
            before += by_gate[a, b, gate]
    goes = lambda g, part, shard: want[g, part] if (shard, want[g, part], gates[g, part]) in open_ else shard
    return {(g, part, began): (goes(g, part, shard), n) for (g, part, began), (shard, n) in units.items()}


@pytest.mark.parametrize(("shards", "tight"), [(4, 1.0), (8, 1.0), (8, 0.9), (8, 1.5)])
def test_rounds_equal_plain_loops(spark, shards, tight):
    """Three rounds of propagation beside loops over the same units, with little room and with much."""
    rows = [(f"g{g}", g % 2, b, b, 1 + (7 * g + 3 * b) % 5) for g in range(120) for b in range(shards) if (g + b) % 3]
    units = spark.createDataFrame(rows, "g string, part int, began int, shard int, n bigint")
    quota = int(tight * sum(r[4] for r in rows) / shards)
    every = units.select("g", "part").distinct()
    voted = every.crossJoin(spark.range(shards).select(F.col("id").cast("int").alias("shard")))
    hashes = {(r.g, r.part, r.shard): r.h for r in voted.withColumn("h", F.xxhash64("g", "part", "shard")).collect()}
    plain = {r[:3]: r[3:] for r in rows}
    for turn in range(3):
        gates = {(r.g, r.part): r.gate for r in every.withColumn("gate", F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.lit(sharding.GATES))).collect()}
        units = common.stored(sharding.propagate(sharding.wishes(units), quota, turn), "test_units")
        after = plain_round(plain, quota, hashes, gates)
        assert {(r.g, r.part, r.began): (r.shard, r.n) for r in units.collect()} == after
        assert turn or after != plain
        plain = after


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "n"), (None, "n"), (4, "y" * 500_000)]
    names = "doc_id bigint, text string, id int, g int, part int, key int, shard int, slot int, near int, n int, size int"
    df = spark.createDataFrame([(*r, *range(9)) for r in rows], names)
    of = check(sharding.shard(df, 3).collect(), 7, 3)
    assert {r["size"] for r in sharding.shard(df, 3).collect()} == {16, 17, 500_016} and len(of) == 4
    check(sharding.shard(df, 40).collect(), 7, 40)
    assert sharding.shard(df.limit(0), 3).count() == 0
