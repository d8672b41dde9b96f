"""Balanced shards that keep linked rows together: label propagation under capacity quotas, in DataFrame operations.

Rows with equal texts are linked.  A group larger than four fifths of a shard is first cut into parts of that size,
which begin in shards next to one another; all other linked rows begin in a shard by hash of their id.  What moves is a unit, the rows of one part that began in one shard, so a group has no
more units than there are shards, however many rows it has.  In every round each part votes for the shard that most of its rows
are in, and units move there under quotas: between two shards as many rows as want to go the other way, and beyond that as
many as the goal has room for, admitted in the order of a hash that each round draws anew, from counts of BUCKETS hash ranges.
Rounds go on until two in a row no longer lower the rows that are apart from their part's shard by a hundredth, ROUNDS at most.  At the end rows of
linked groups keep their shard within its exact quota; all others, in the order of their group, fill what is left.
The law is `rows`: shard sizes differ by one row at most.  Ranks come from two levels (counts of hash ranges, then a window
within one), so no task sorts a shard, and rows of large groups are spread over ranges of their own, which come first.

Cases: null text counts as empty, with 0 bytes; very long texts count their bytes; null ids are rows like any other; repeated
rows are placed one by one, in any order among themselves; ties of votes are decided by a hash; texts are told apart by a
128-bit digest and their length; other columns, whatever their names, are neither read nor returned; fewer rows than shards leave
the last shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import forget, joined, stored, table

#: Hash ranges of a count, rounds of propagation at most, and bytes that a row counts beside its text.
BUCKETS, ROUNDS, EXTRA = 1024, 8, 16
#: Hash ranges in which the movers from one shard to another are admitted, and the share of a shard that they may fill.
GATES, FULL = 64, 0.98


def _range(of: Column) -> Column:
    """One of BUCKETS equal hash ranges."""
    return F.pmod(of, F.lit(BUCKETS)).cast("int")


def _running(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Counts n in the order of a hash range, with the number before; a row for each shard (or pair of shards) and range."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def wishes(units: DataFrame) -> DataFrame:
    """units (g, part, began, shard, n) with `want`, the shard that most rows of their part are in."""
    votes = units.groupBy("g", "part", "shard").agg(F.sum("n").alias("votes"))
    want = votes.groupBy("g", "part").agg(F.max_by("shard", F.struct("votes", F.xxhash64("g", "part", "shard"))).alias("want"))
    return units.join(want, ["g", "part"])


def propagate(asked: DataFrame, quota: int, turn: int) -> DataFrame:
    """One round: units with the shard that they are in after it."""
    moving = asked.where("want <> shard").withColumn("gate", F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.lit(GATES)).cast("int"))
    counts = stored(moving.groupBy("shard", "want", "gate").agg(F.sum("n").alias("n")), "counts")  # shards * shards * GATES rows at most
    pairs = counts.groupBy("shard", "want").agg(F.sum("n").alias("out"))
    back = pairs.select(F.col("want").alias("shard"), F.col("shard").alias("want"), F.col("out").alias("back"))
    load = asked.groupBy(F.col("shard").alias("want")).agg(F.sum("n").alias("load"))
    swaps = pairs.join(back, ["shard", "want"], "left").withColumn("swap", F.least("out", F.coalesce("back", F.lit(0)))).join(load, "want", "left")
    more, room = F.col("out") - F.col("swap"), F.greatest(F.lit(0), F.lit(int(FULL * quota)) - F.coalesce("load", F.lit(0)))
    allowed = swaps.withColumn("more", more).withColumn("all", F.sum("more").over(W.partitionBy("want")))
    allowed = allowed.select("shard", "want", (F.col("swap") + F.when(F.col("all") > 0, F.least(F.col("more"), F.floor(room * F.col("more") / F.col("all")))).otherwise(0)).alias("allowed"))
    opened = _running(counts, ["shard", "want"], "gate").join(allowed, ["shard", "want"]).where(F.col("before") + F.col("n") <= F.col("allowed"))
    gates = moving.join(F.broadcast(opened.select("shard", "want", "gate", F.lit(True).alias("go"))), ["shard", "want", "gate"], "left")
    moved = gates.select("g", "part", "began", F.when(F.col("go"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "n")
    return moved.unionByName(asked.where("want = shard").select("g", "part", "began", "shard", "n"))


def settled(units: DataFrame, quota: int) -> DataFrame:
    """The units after as many rounds as help."""
    units, best, vain = stored(units, "units"), float("inf"), 0
    for turn in range(ROUNDS + 1):
        asked = wishes(units)
        apart = asked.where("want <> shard").agg(F.sum("n")).first()[0] or 0
        vain = vain + 1 if apart > 0.99 * best else 0
        if not apart or turn == ROUNDS or vain == 2:
            break
        after = stored(propagate(asked, quota, turn), "units")
        forget(units)
        units, best = after, min(best, apart)
    return units


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + EXTRA).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("g"))
    rows = stored(rows.withColumn("g", F.concat("g", F.col("size").cast("string"))).withColumn("key", F.xxhash64("id")), "rows")
    total = rows.count()
    quota, more = total // shards, total % shards
    groups = stored(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") * 1.25 / max(1, quota)).cast("int")), "groups")
    first = rows
    rows = joined(rows, groups, "g", total).drop("n").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod("key", F.col("parts"))).cast("int"))
    own = F.when(F.col("part").isNull(), F.xxhash64("g")).when(F.col("parts") > 1, F.xxhash64("key", F.lit(7))).otherwise(F.xxhash64("g", F.lit(7)))
    start = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("g"), F.lit(shards)) + F.col("part")).otherwise(F.xxhash64("key", F.lit(1)))
    began = F.when(F.col("part").isNotNull(), F.pmod(start, F.lit(shards)).cast("int"))
    rows = stored(rows.withColumn("range", F.when(F.col("parts") > 1, F.pmod(own, F.lit(GATES)).cast("int") - GATES).otherwise(_range(own))).withColumn("began", began).withColumn("unit", F.concat_ws(":", "g", "part", "began")), "rows")
    forget(first)
    linked = rows.where("part is not null")
    units = linked.groupBy("g", "part", "began").agg(F.count("*").alias("n")).withColumn("shard", F.col("began"))
    homes = stored(settled(units, quota).select(F.concat_ws(":", "g", "part", "began").alias("unit"), F.col("shard").alias("near"), "n"), "homes")
    placed = joined(linked, homes, "unit", total).unionByName(rows.where("part is null").withColumns({"near": F.lit(None).cast("int"), "n": F.lit(None).cast("bigint")}))
    quotas = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.expr(f"{quota} + if(id < {more}, 1, 0)").cast("bigint").alias("quota"))
    counts = placed.where("near is not null").groupBy(F.col("near").alias("shard"), "range").agg(F.count("*").alias("n"))
    kept = _running(counts, ["shard"], "range").join(F.broadcast(quotas), "shard").where(F.col("before") + F.col("n") <= F.col("quota"))
    kept = kept.withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("shard").alias("near"), "range", "first")
    placed = stored(placed.select("id", "size", "text_crc32", "g", "part", "near", "range").join(F.broadcast(kept), ["near", "range"], "left"), "placed")
    within = W.partitionBy("near", "range").orderBy("g", "part", "id")
    stay = placed.where("first is not null").select("id", "size", "text_crc32", F.col("near").alias("shard"), (F.col("first") + F.row_number().over(within) - 1).alias("slot"))
    loads = placed.where("first is not null").groupBy(F.col("near").alias("shard")).agg(F.count("*").alias("load"))
    left = quotas.join(F.broadcast(loads), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"), (F.col("quota") - F.coalesce("load", F.lit(0))).alias("n"))
    left = left.withColumn("below", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row for each shard
    filling = left.agg(F.sort_array(F.collect_list(F.struct("shard", "load", "n", "below"))).alias("filling"))
    free = placed.where("first is null")
    free_before = _running(free.groupBy(F.lit(0).alias("all"), "range").agg(F.count("*").alias("n")), ["all"], "range").select("range", F.col("before").alias("start"))
    ranked = free.join(F.broadcast(free_before), "range").withColumn("rank", F.col("start") + F.row_number().over(W.partitionBy("range").orderBy("g", "part", "id")) - 1)
    goes = F.element_at(F.filter("filling", lambda s: (s["below"] <= F.col("rank")) & (F.col("rank") < s["below"] + s["n"])), 1)
    ranked = ranked.crossJoin(F.broadcast(filling)).withColumn("s", goes)  # one row: the shards' free places
    filled = ranked.select("id", "size", "text_crc32", F.col("s.shard").alias("shard"), (F.col("s.load") + F.col("rank") - F.col("s.below")).alias("slot"))
    out = stay.unionByName(filled)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return shard(table(spark, sf_dir, "documents"))
