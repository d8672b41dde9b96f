"""Queries on whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import verdicts
from assayer.plans.evidence import query
from assayer.sources import tables

FAMILY = "CASE detector WHEN 'learned_a' THEN 'learned' WHEN 'geometric_a' THEN 'geometric' WHEN 'compression_a' THEN 'compression' WHEN 'face_a' THEN 'non_evidential' ELSE 'ai_generation' END"


def with_family(s, d):
    return tables.detections(s, d).withColumn("family", F.expr(FAMILY))


@query(f"""SELECT analysis_id, families, localised, incomplete, negative, rule, CASE WHEN rule='multi_family_localised' THEN 'LIKELY_MANIPULATED' WHEN rule IN ('multi_family','single_family') THEN 'SUSPICIOUS' WHEN rule='full_coverage_no_anomaly' THEN 'NO_SIGNIFICANT_ANOMALIES_DETECTED' ELSE 'INCONCLUSIVE' END AS category,
CASE rule WHEN 'multi_family_localised' THEN 'STRONG' WHEN 'multi_family' THEN 'MODERATE' WHEN 'single_family' THEN 'WEAK' ELSE 'NONE' END AS strength FROM (SELECT *, CASE WHEN families >= 2 AND localised THEN 'multi_family_localised' WHEN families >= 2 THEN 'multi_family' WHEN families = 1 THEN 'single_family' WHEN other THEN 'non_evidential_only' WHEN incomplete > 0 THEN 'incomplete_coverage' WHEN negative = 0 THEN 'no_determination' ELSE 'full_coverage_no_anomaly' END AS rule
FROM (SELECT analysis_id, count(DISTINCT CASE WHEN votes AND ok AND flagged THEN family END) AS families, bool_or(votes AND ok AND flagged AND localised) AS localised, count(*) FILTER (votes AND execution_status='FAILED') AS incomplete, count(*) FILTER (votes AND ok AND NOT flagged) AS negative, bool_or(family='non_evidential' AND ok AND flagged) AS other
FROM (SELECT *, family NOT IN ('ai_generation','non_evidential') AS votes, execution_status='COMPLETED' AS ok FROM (SELECT *, {FAMILY} AS family FROM v_detections)) GROUP BY 1))""")
def manipulation_verdict(s, d):
    return verdicts.manipulation_verdict(with_family(s, d))


@query("""SELECT analysis_id, indicated, cleared, advisory, CASE WHEN indicated > 0 THEN 'gen_b' END AS "primary", CASE WHEN indicated > 0 AND cleared > 0 THEN 'CONFLICTING' WHEN indicated > 0 THEN 'INDICATED' WHEN cleared > 0 THEN 'NOT_INDICATED' ELSE 'NOT_ASSESSED' END AS state FROM (SELECT analysis_id, count(*) FILTER (detector='gen_b' AND ok AND flagged) AS indicated, count(*) FILTER (detector='gen_b' AND ok AND NOT flagged) AS cleared, count(*) FILTER (detector='gen_a' AND ok AND flagged) AS advisory FROM (SELECT *, execution_status='COMPLETED' AS ok FROM v_detections WHERE detector IN ('gen_a','gen_b')) GROUP BY 1)""")
def ai_branch_verdict(s, d):
    return verdicts.ai_branch(with_family(s, d), ["gen_a"])


@query("""SELECT d.analysis_id, concat('[', string_agg(concat('{"detection_id":', detection_id, ',"detector":"', detector, '","execution_status":"', execution_status, '"}'), ',' ORDER BY detection_id), ']') AS detections, coalesce(any_value(s.sources), '[]') AS sources FROM v_detections d LEFT JOIN (SELECT analysis_id, concat('[', string_agg(concat('{"source_id":', source_id, ',"provider":"', provider, '","status":"', status, '"}'), ',' ORDER BY source_id), ']') AS sources FROM v_sources GROUP BY 1) s ON d.analysis_id = s.analysis_id GROUP BY 1""")
def evidence_package(s, d):
    return verdicts.evidence_package(tables.detections(s, d), tables.sources(s, d))


@query("SELECT analysis_id, coalesce(string_agg(CASE WHEN execution_status='COMPLETED' AND flagged THEN CAST(detection_id AS VARCHAR) END, ',' ORDER BY detection_id), '') AS supports, coalesce(string_agg(CASE WHEN execution_status='COMPLETED' AND NOT flagged THEN CAST(detection_id AS VARCHAR) END, ',' ORDER BY detection_id), '') AS contradicts FROM v_detections GROUP BY 1")
def finding_links(s, d):
    return verdicts.finding_links(tables.detections(s, d))


@query(f"SELECT rule, count(*) AS analyses FROM (SELECT analysis_id, CASE WHEN count(DISTINCT CASE WHEN execution_status='COMPLETED' AND flagged AND family NOT IN ('ai_generation','non_evidential') THEN family END) >= 2 THEN 'several' ELSE 'one or none' END AS rule FROM (SELECT *, {FAMILY} AS family FROM v_detections) GROUP BY 1) GROUP BY 1")
def families_observed(s, d):
    v = verdicts.manipulation_verdict(with_family(s, d))
    return v.groupBy(F.when(F.col("families") >= 2, "several").otherwise("one or none").alias("rule")).agg(F.count("*").alias("analyses"))
