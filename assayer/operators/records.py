"""Operators on case, media, run and audit records: ownership, latest rows, quotas, health, hash chains and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import polarity


def owner_filter(media: DataFrame, owner: Column) -> DataFrame:
    """A row without owner is visible to no one."""
    return media.where(F.col("owner") == owner)


def latest_per_key(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key."""
    s, i = stored.select(key, *columns).alias("s"), incoming.select(key, *columns, F.lit(True).alias("new")).alias("i")
    return s.join(i, key, "full").select(key, *[F.when(F.col("i.new"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in columns])


def rolling_quota(requests: DataFrame, key: list[str], time: str, seconds: int, limit: int) -> DataFrame:
    """How many requests of a key the window before each one holds, itself included, and whether that is over the limit."""
    w = W.partitionBy(*key).orderBy(F.col(time).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > limit)


def health(runs: DataFrame, key: str, time: str, tie: str, failing_after: int = 3) -> DataFrame:
    """FAILING, DEGRADED or OPERATIONAL by the failures since the last other outcome; skipped runs are neutral."""
    r = runs.where("execution_status <> 'SKIPPED'").withColumn("at", F.struct(time, tie))
    good = r.where("execution_status <> 'FAILED'").groupBy(key).agg(F.max("at").alias("last_good"))
    out = r.join(good, key, "left").groupBy(key).agg(F.count("*").alias("runs"), F.count_if((F.col("execution_status") == "FAILED") & (F.col("last_good").isNull() | (F.col("at") > F.col("last_good")))).alias("failures"))
    return out.withColumn("state", F.when(F.col("failures") >= failing_after, "FAILING").when(F.col("failures") > 0, "DEGRADED").otherwise("OPERATIONAL"))


def recent_p95(runs: DataFrame, key: str, time: str, tie: str, value: str, n: int = 50) -> DataFrame:
    """Nearest-rank 95th percentile of the last n productive runs."""
    last = runs.where("execution_status in ('COMPLETED', 'INCONCLUSIVE')").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))).where(F.col("_r") <= n)
    lists = last.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"))
    return lists.select(key, F.size("v").cast("bigint").alias("n"), F.element_at("v", F.least(F.size("v"), F.floor(F.lit(0.95) * F.size("v")).cast("int") + 1)).alias("p95"))


def observations(detections: DataFrame) -> DataFrame:
    return detections.withColumn("polarity", polarity(F.col("execution_status"), F.col("flagged")))


def coverage(detections: DataFrame) -> DataFrame:
    """What each analysis found, did not find, could not decide and could not run."""
    p = F.col("polarity")
    return observations(detections).groupBy("analysis_id").agg(F.count("*").alias("checks"), F.count_if(p.isNotNull()).alias("ran"), F.count_if(p == "ANOMALY_OBSERVED").alias("found"), F.count_if(p == "NO_ANOMALY_OBSERVED").alias("nothing"), F.count_if(p == "INDETERMINATE").alias("undecided"), F.array_join(F.array_sort(F.collect_list(F.when(p.isNull(), F.col("detector")))), ",").alias("gaps"))


def run_status(detections: DataFrame) -> DataFrame:
    """COMPLETED, PARTIAL or FAILED by the checks that failed."""
    n = detections.groupBy("analysis_id").agg(F.count("*").alias("checks"), F.count_if(F.col("execution_status") == "FAILED").alias("failed"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "COMPLETED").when(F.col("failed") < F.col("checks"), "PARTIAL").otherwise("FAILED"))


def event_hash(*fields: Column) -> Column:
    """Digest of a canonical JSON list of strings."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields])).cast("binary"), 256)


def verify_links(events: DataFrame, chain: str) -> DataFrame:
    """The first broken event of each chain (0: none) and how many were checked; an event joins the one before it by sequence."""
    e, before = events.alias("e"), events.select(chain, (F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected"))
    joined = e.join(before, [chain, "sequence"], "left")
    own = event_hash(F.col("sequence"), F.col("action"), F.col("previous_event_hash"))
    broken = (F.coalesce("previous_event_hash", F.lit("")) != F.coalesce("expected", F.lit(""))) | (own != F.col("event_hash"))
    return joined.groupBy(chain).agg(F.count("*").alias("checked"), F.coalesce(F.min(F.when(broken, F.col("sequence"))), F.lit(0)).alias("first_broken"))
