"""Evidence rows of analyses: what is stated as fact, observed or uncertain, links and limits, archived copies, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import polarity
from assayer.sources.scratch import kept, place

CATEGORIES = ["FACT", "OBSERVATION", "INFERENCE", "UNCERTAINTY"]


def evidence_union(media: DataFrame, detections: DataFrame, segments: DataFrame, each: int = 5) -> DataFrame:
    """(analysis_id, category, stage, detector, description, confidence).

    media: analysis_id, sha256, bytes.  detections: with detector, execution_status, flagged, confidence.  segments: analysis_id,
    detector, start_frame, end_frame, peak_score; the first `each` of a detection count.  A check that did not run is an uncertainty, never a negative.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    facts = media.select("analysis_id", F.lit("FACT").alias("category"), F.lit("fingerprinting").alias("stage"), none.alias("detector"), F.concat(F.lit("SHA-256 is "), "sha256").alias("description"), F.lit(1.0).alias("confidence"))
    sizes = media.select("analysis_id", F.lit("FACT").alias("category"), F.lit("ingestion").alias("stage"), none.alias("detector"), F.concat(F.lit("File size: "), text("bytes"), F.lit(" bytes")).alias("description"), F.lit(1.0).alias("confidence"))
    p = polarity(F.col("execution_status"), F.col("flagged"))
    d = detections.withColumn("p", p)
    said = F.when(F.col("p").isNull(), F.concat("detector", F.lit(" did not produce observations"))).when(F.col("p") == "INDETERMINATE", F.concat("detector", F.lit(" was inconclusive"))).when(F.col("p") == "ANOMALY_OBSERVED", F.concat("detector", F.lit(" reported anomalies"))).otherwise(F.concat("detector", F.lit(" reported no anomalies above its threshold; this is no finding of authenticity")))
    category = F.when(F.col("p").isNull() | (F.col("p") == "INDETERMINATE"), "UNCERTAINTY").otherwise("OBSERVATION")
    checks = d.select("analysis_id", category.alias("category"), F.lit("detection").alias("stage"), "detector", said.alias("description"), "confidence")
    first = segments.withColumn("r", F.row_number().over(W.partitionBy("analysis_id", "detector").orderBy("start_frame"))).where(F.col("r") <= each)
    spans = first.select("analysis_id", F.lit("OBSERVATION").alias("category"), F.lit("video_detection").alias("stage"), "detector", F.concat(F.lit("Frames "), text("start_frame"), F.lit(" to "), text("end_frame"), F.lit(" show an anomaly")).alias("description"), F.col("peak_score").alias("confidence"))
    return facts.unionByName(sizes).unionByName(checks).unionByName(spans)


def classified(items: DataFrame) -> DataFrame:
    """(analysis_id, a column for each category): descriptions by category, in order; an unknown category is an uncertainty."""
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("UNCERTAINTY")
    return items.groupBy("analysis_id").agg(*[F.array_sort(F.collect_list(F.when(known == c, F.col("description")))).alias(c.lower()) for c in CATEGORIES])


def observations(detections: DataFrame) -> DataFrame:
    """(analysis_id, observed, gaps): the ids of checks that observed something or nothing, and of those that did not run."""
    p = polarity(F.col("execution_status"), F.col("flagged"))
    d = detections.withColumn("p", p)
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("detection_id"))))
    return d.groupBy("analysis_id").agg(ids(F.col("p").isNotNull()).alias("observed"), ids(F.col("p").isNull()).alias("gaps"))


def foreign_links(links: DataFrame, observations: DataFrame, relations: list[str]) -> DataFrame:
    """(analysis_id, observation_id, relation, problem): links to observations of another analysis, or of an unknown relation."""
    own = observations.select("analysis_id", "observation_id").distinct().withColumn("own", F.lit(True))
    each = links.join(own, ["analysis_id", "observation_id"], "left")
    problem = F.when(~F.col("relation").isin(*relations), "unknown relation").when(F.col("own").isNull(), "foreign observation")
    return each.withColumn("problem", problem).where("problem is not null").select("analysis_id", "observation_id", "relation", "problem")


def limitations(detections: DataFrame, searches: DataFrame, sources: DataFrame, learned: list[str]) -> DataFrame:
    """(analysis_id, place, limitation): caveats in order, each once: checks without a result, searches that were not made, what was not found, and what did not run."""
    p = polarity(F.col("execution_status"), F.col("flagged"))
    d = detections.withColumn("p", p)
    row = lambda df, rank, order, text: df.select("analysis_id", F.lit(rank).alias("rank"), order.cast("string").alias("order"), text.alias("limitation"))
    checks = row(d.where(F.col("p").isNull() | (F.col("p") == "INDETERMINATE")), 0, F.lpad(F.col("detection_id").cast("string"), 20, "0"), F.concat("detector", F.when(F.col("p").isNull(), ": did not run").otherwise(": inconclusive")))
    unsearched = row(searches.where("status <> 'COMPLETED'"), 1, F.col("provider"), F.concat(F.lit("Source "), "provider", F.lit(" was not searched")))
    searched = searches.groupBy("analysis_id").agg(F.bool_or(F.col("status") == "COMPLETED").alias("any"))
    verified = sources.where("status = 'VERIFIED_MATCH'").select("analysis_id").distinct().withColumn("verified", F.lit(True))
    outcome = detections.select("analysis_id").distinct().join(searched, "analysis_id", "left").join(verified, "analysis_id", "left")
    found = row(outcome.where(~F.coalesce("any", F.lit(False)) | F.col("verified").isNull()), 2, F.lit(""), F.when(F.coalesce("any", F.lit(False)), "No verified source was found in what was searched").otherwise("No source was searched"))
    ran = d.groupBy("analysis_id").agg(F.bool_or(F.col("detector").isin(*learned) & F.col("p").isNotNull()).alias("ran"))
    heuristic = row(ran.where("not ran"), 3, F.lit(""), F.lit("No learned model produced observations"))
    every = checks.unionByName(unsearched).unionByName(found).unionByName(heuristic)
    first = every.groupBy("analysis_id", "limitation").agg(F.min(F.struct("rank", "order")).alias("at"))
    return first.select("analysis_id", F.row_number().over(W.partitionBy("analysis_id").orderBy("at.rank", "at.order", "limitation")).alias("place"), "limitation")


def engine_assessment(detections: DataFrame) -> DataFrame:
    """(analysis_id, assessment, strength, families, contradicted, dominant, missing) of (…, family, execution_status, flagged, confidence, localised).

    Anomalies stand whatever else is missing; absence needs full coverage; families, not detectors, corroborate one another.
    """
    p = polarity(F.col("execution_status"), F.col("flagged"))
    d = detections.withColumn("p", p).withColumn("votes", ~F.col("family").isin("ai_generation", "non_evidential"))
    yes, no = F.col("votes") & (F.col("p") == "ANOMALY_OBSERVED"), F.col("votes") & (F.col("p") == "NO_ANOMALY_OBSERVED")
    n = d.groupBy("analysis_id").agg(
        F.count_if(F.col("votes") & F.col("p").isNotNull()).alias("usable"), F.count_if(yes).alias("positive"), F.count_if(no).alias("negative"), F.count_if(F.col("votes") & F.col("p").isNull()).alias("gone"),
        F.count_distinct(F.when(yes, F.col("family"))).alias("families"), F.coalesce(F.bool_or(yes & F.col("localised")), F.lit(False)).alias("localised"),
        F.max_by(F.when(yes, F.col("detector")), F.when(yes, F.struct("confidence", -F.col("detection_id")))).alias("dominant"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.col("detector")))), ",").alias("missing"),
    )
    against = (F.col("positive") > 0) & (F.col("negative") > 0)
    several = F.col("families") >= 2
    none = F.col("positive") == 0
    assessment = F.when(F.col("usable") == 0, "INCONCLUSIVE").when(~none & several & ~against & F.col("localised"), "LIKELY_MANIPULATED").when(~none, "SUSPICIOUS").when((F.col("gone") > 0) | (F.col("negative") == 0), "INCONCLUSIVE").otherwise("NO_SIGNIFICANT_ANOMALIES_DETECTED")
    strength = F.when(none, "NONE").when(against, "CONTRADICTORY").when(several & F.col("localised"), "STRONG").when(several, "MODERATE").otherwise("WEAK")
    return n.select("analysis_id", assessment.alias("assessment"), strength.alias("strength"), "families", against.alias("contradicted"), "dominant", "missing")


def archive_lookup(hits: DataFrame, captures: DataFrame) -> DataFrame:
    """(url, hit_id, captured, status): each verified URL once, with its first capture of the same bytes (VERIFIED_MATCH), else its first capture (a lead).

    hits: hit_id, url, sha1 (null for pages).  captures: url, stamp (14 digits), digest (hexadecimal SHA-1).
    """
    first = hits.withColumn("r", F.row_number().over(W.partitionBy("url").orderBy("hit_id"))).where("r = 1").drop("r")
    each = first.join(captures, "url")
    same = F.col("sha1").isNotNull() & (F.col("digest") == F.col("sha1"))
    n = each.groupBy("url", "hit_id").agg(F.min(F.when(same, F.col("stamp"))).alias("own"), F.min("stamp").alias("any"))
    return n.select("url", "hit_id", F.coalesce("own", "any").alias("captured"), F.when(F.col("own").isNotNull(), "VERIFIED_MATCH").otherwise("SIMILAR_UNVERIFIED").alias("status"))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The stored rows after the groups that `new` holds are replaced as wholes, by an overwrite of their partitions alone."""
    spark = old.sparkSession
    path = place(spark, "groups")
    old.write.partitionBy(group).parquet(path)
    new.select(*old.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
    return spark.read.schema(old.schema).parquet(path).select(*old.columns)


def reports(detections: DataFrame) -> DataFrame:
    """(analysis_id, document, markdown): each analysis's report as JSON and as text, written by partition and read back."""
    p = polarity(F.col("execution_status"), F.col("flagged"))
    lines = F.array_sort(F.collect_list(F.struct("detection_id", "detector", F.coalesce(p, F.lit("NOT_RUN")).alias("outcome"))))
    each = detections.groupBy("analysis_id").agg(lines.alias("checks"))
    markdown = F.concat(F.lit("# Analysis "), F.col("analysis_id").cast("string"), F.lit("\n"), F.array_join(F.transform("checks", lambda c: F.concat(F.lit("- "), c["detector"], F.lit(": "), c["outcome"])), "\n"))
    return kept(each.select("analysis_id", F.to_json(F.struct("analysis_id", "checks")).alias("document"), markdown.alias("markdown")), "reports")
