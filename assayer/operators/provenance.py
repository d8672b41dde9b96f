"""Sources and their order in time, evidence graphs, candidate channels and set operations on evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def earliest_known(sources: DataFrame) -> DataFrame:
    """All sources, the earliest verified and dated one of each analysis flagged."""
    first = sources.where("status = 'VERIFIED_MATCH' and stamp is not null").groupBy("analysis_id").agg(F.min_by("source_id", F.struct("stamp", "source_id")).alias("first"))
    return sources.join(first, "analysis_id", "left").withColumn("earliest", F.coalesce(F.col("source_id") == F.col("first"), F.lit(False))).drop("first")


def timeline(sources: DataFrame) -> DataFrame:
    """Events of each analysis in order, the undated last."""
    event = F.when(F.col("provider") == "archive", "ARCHIVED").when(F.col("provider") == "url_check", "RETRIEVED").otherwise("PUBLISHED")
    w = W.partitionBy("analysis_id").orderBy(F.col("stamp").asc_nulls_last(), "source_id")
    return sources.where("status <> 'NO_MATCH'").withColumn("event", event).withColumn("position", F.row_number().over(w))


def source_outcomes(sources: DataFrame, providers: list[str]) -> DataFrame:
    """Hits of each provider; one that returned nothing is listed as not searched, not as not found."""
    every = sources.select("analysis_id").distinct().select("analysis_id", F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"))
    n = sources.groupBy("analysis_id", "provider").agg(F.count("*").alias("hits"), F.count_if(F.col("status") == "VERIFIED_MATCH").alias("verified"))
    out = every.join(n, ["analysis_id", "provider"], "left")
    state = F.when(F.col("hits").isNull(), "NOT_SEARCHED").when(F.col("verified") > 0, "VERIFIED").otherwise("LEADS_ONLY")
    return out.select("analysis_id", "provider", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("verified", F.lit(0)).alias("verified"), state.alias("outcome"))


def graph_edges(sources: DataFrame) -> DataFrame:
    """(from_node, to_node, relation): only a verified source may be called the same."""
    relation = F.when(F.col("status") == "VERIFIED_MATCH", "same_image_as").otherwise("visually_similar_to")
    return sources.where("status <> 'NO_MATCH'").select(F.concat(F.lit("analysis:"), F.col("analysis_id").cast("string")).alias("from_node"), F.concat(F.lit("source:"), F.col("source_id").cast("string")).alias("to_node"), relation.alias("relation"))


def graph(sources: DataFrame) -> DataFrame:
    """(record, a, b, label): the distinct nodes (b null) and the edges of all evidence graphs."""
    edges = graph_edges(sources)
    node = lambda c: edges.select(F.col(c).alias("a"))
    nodes = node("from_node").unionByName(node("to_node")).distinct().select(F.lit("node").alias("record"), "a", F.lit(None).cast("string").alias("b"), F.substring_index("a", ":", 1).alias("label"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("record"), F.col("from_node").alias("a"), F.col("to_node").alias("b"), F.col("relation").alias("label")))


def first_occurrence(df: DataFrame, key: str, position: str) -> DataFrame:
    """Ordered distinct: each value where it comes first."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(position))).where("_r = 1").drop("_r")


def unambiguous(df: DataFrame, key: str, group: str) -> DataFrame:
    """Rows whose key belongs to one group only."""
    one = df.groupBy(key).agg(F.count_distinct(group).alias("_n")).where("_n = 1").select(key)
    return df.join(one, key, "left_semi")


def candidate_union(exact: DataFrame, near: DataFrame, similar: DataFrame) -> DataFrame:
    """(query_id, id, exact, distance, cosine, channels): a pair that any channel retrieves, once."""
    key = ["query_id", "id"]
    none = F.lit(None)
    rows = exact.select(*key, F.lit(True).alias("exact"), none.cast("int").alias("distance"), none.cast("double").alias("cosine"))
    rows = rows.unionByName(near.select(*key, F.lit(False).alias("exact"), "distance", none.cast("double").alias("cosine"))).unionByName(similar.select(*key, F.lit(False).alias("exact"), none.cast("int").alias("distance"), "cosine"))
    out = rows.groupBy(*key).agg(F.bool_or("exact").alias("exact"), F.min("distance").alias("distance"), F.max("cosine").alias("cosine"))
    named = F.array(F.when(F.col("exact"), "exact"), F.when(F.col("distance").isNotNull(), "hamming"), F.when(F.col("cosine").isNotNull(), "cosine"))
    return out.withColumn("channels", F.array_join(named, ","))


def incremental_index(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """unchanged, refreshed, indexed, or absent from what came in."""
    s, i = stored.select(key, F.col(digest).alias("old")), incoming.select(key, F.col(digest).alias("new"))
    outcome = F.when(F.col("new").isNull(), "absent").when(F.col("old").isNull(), "indexed").when(F.col("old") == F.col("new"), "unchanged").otherwise("refreshed")
    return s.join(i, key, "full").select(key, outcome.alias("outcome"))


def missing_fingerprints(items: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, algorithm) still to compute; a fingerprint of another version counts as missing."""
    every = items.select("id").crossJoin(F.broadcast(wanted))  # wanted: the few algorithms of a deployment
    return every.join(known, ["id", "algorithm", "version"], "left_anti")


def merge_runs(runs: DataFrame) -> DataFrame:
    """One score for each (id, detector): the latest run's."""
    return runs.groupBy("id", "detector").agg(F.max_by("raw_score", "run_no").alias("raw_score"), F.max("run_no").alias("run_no"))


def overlap_chunks(series: DataFrame, key: str, length: str, size: int, overlap: int) -> DataFrame:
    """(key, start, stop) of chunks that cover [0, length) and overlap."""
    last = F.greatest(F.lit(0), F.col(length) - size)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(size - overlap).cast("bigint")), F.array(last.cast("bigint"))))
    return series.select(key, length, F.explode(starts).alias("start")).select(key, "start", F.least(F.col("start") + size, F.col(length)).alias("stop"))


def mask_scores(pixels: DataFrame, key: str) -> DataFrame:
    """IoU and F1 of two masks (p, t) for each item; both empty: 1."""
    n = pixels.groupBy(key).agg(F.count_if(F.col("p") & F.col("t")).alias("both"), F.count_if(F.col("p") | F.col("t")).alias("either"), F.count_if("p").alias("np"), F.count_if("t").alias("nt"))
    return n.select(key, F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")).alias("iou"), F.when(F.col("np") + F.col("nt") == 0, 1.0).otherwise(2 * F.col("both") / (F.col("np") + F.col("nt"))).alias("f1"))


def patch_outliers(pixels: DataFrame, key: str, side: int, k: float) -> DataFrame:
    """Tiles whose mean exceeds the item's mean of tiles by k deviations."""
    tiles = pixels.groupBy(key, F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx")).agg(F.avg("value").alias("mean"))
    stats = tiles.groupBy(key).agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("sd"))
    return tiles.join(stats, key).where(F.col("mean") > F.col("m") + k * F.col("sd")).select(key, "ty", "tx", "mean")
