"""Verdicts of analyses by named rules: positives stand, absence needs full coverage, detectors of one family count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.stats import polarity


def manipulation_verdict(detections: DataFrame) -> DataFrame:
    """(analysis_id, families, localised, incomplete, negative, rule, category, strength).

    detections: analysis_id, execution_status, flagged, localised, family; families ai_generation and non_evidential take no part.
    """
    d = detections.withColumn("polarity", polarity(F.col("execution_status"), F.col("flagged"))).withColumn("votes", ~F.col("family").isin("ai_generation", "non_evidential"))
    hit = F.col("votes") & (F.col("polarity") == "ANOMALY_OBSERVED")
    n = d.groupBy("analysis_id").agg(
        F.count_distinct(F.when(hit, F.col("family"))).alias("families"), F.coalesce(F.bool_or(hit & F.col("localised")), F.lit(False)).alias("localised"),
        F.count_if(F.col("votes") & F.col("polarity").isNull()).alias("incomplete"), F.count_if(F.col("votes") & (F.col("polarity") == "NO_ANOMALY_OBSERVED")).alias("negative"),
        F.coalesce(F.bool_or((F.col("family") == "non_evidential") & (F.col("polarity") == "ANOMALY_OBSERVED")), F.lit(False)).alias("other"),
    )
    f = F.col("families")
    rule = F.when((f >= 2) & F.col("localised"), "multi_family_localised").when(f >= 2, "multi_family").when(f == 1, "single_family").when(F.col("other"), "non_evidential_only").when(F.col("incomplete") > 0, "incomplete_coverage").when(F.col("negative") == 0, "no_determination").otherwise("full_coverage_no_anomaly")
    category = F.when(F.col("rule") == "multi_family_localised", "LIKELY_MANIPULATED").when(F.col("rule").isin("multi_family", "single_family"), "SUSPICIOUS").when(F.col("rule") == "full_coverage_no_anomaly", "NO_SIGNIFICANT_ANOMALIES_DETECTED").otherwise("INCONCLUSIVE")
    strength = F.when(F.col("rule") == "multi_family_localised", "STRONG").when(F.col("rule") == "multi_family", "MODERATE").when(F.col("rule") == "single_family", "WEAK").otherwise("NONE")
    return n.withColumn("rule", rule).withColumn("category", category).withColumn("strength", strength).drop("other")


def ai_branch(detections: DataFrame, advisory: list[str]) -> DataFrame:
    """Generation detectors of each analysis; advisory ones are listed and never vote."""
    d = detections.where("family = 'ai_generation'").withColumn("polarity", polarity(F.col("execution_status"), F.col("flagged"))).withColumn("votes", ~F.col("detector").isin(*advisory))
    yes, no = F.col("polarity") == "ANOMALY_OBSERVED", F.col("polarity") == "NO_ANOMALY_OBSERVED"
    n = d.groupBy("analysis_id").agg(F.count_if(F.col("votes") & yes).alias("indicated"), F.count_if(F.col("votes") & no).alias("cleared"), F.count_if(~F.col("votes") & yes).alias("advisory"), F.max_by(F.when(F.col("votes") & yes, F.col("detector")), F.when(F.col("votes") & yes, F.col("confidence"))).alias("primary"))
    state = F.when((F.col("indicated") > 0) & (F.col("cleared") > 0), "CONFLICTING").when(F.col("indicated") > 0, "INDICATED").when(F.col("cleared") > 0, "NOT_INDICATED").otherwise("NOT_ASSESSED")
    return n.withColumn("state", state)


def evidence_package(detections: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each analysis: its detections and its sources, each aggregated before the join, as JSON in a fixed order."""
    d = detections.groupBy("analysis_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("detection_id", "detector", "execution_status")))).alias("detections"))
    s = sources.groupBy("analysis_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source_id", "provider", "status")))).alias("sources"))
    return d.join(s, "analysis_id", "left").withColumn("sources", F.coalesce("sources", F.lit("[]")))


def finding_links(detections: DataFrame) -> DataFrame:
    """Observation ids that support and contradict each analysis's finding."""
    p = polarity(F.col("execution_status"), F.col("flagged"))
    ids = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") == x, F.col("detection_id")))), ",")
    return detections.withColumn("p", p).groupBy("analysis_id").agg(ids("ANOMALY_OBSERVED").alias("supports"), ids("NO_ANOMALY_OBSERVED").alias("contradicts"))
