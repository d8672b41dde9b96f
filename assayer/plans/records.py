"""Queries on evidence rows, links, limits, archived copies, reports and batches of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import evidence as E
from assayer.operators import scoring
from assayer.plans.evidence import query, rounded
from assayer.plans.verdicts import FAMILY, with_family
from assayer.sources import tables

_P = "CASE WHEN execution_status IN ('FAILED','SKIPPED') THEN NULL WHEN execution_status <> 'COMPLETED' THEN 'INDETERMINATE' WHEN flagged THEN 'ANOMALY_OBSERVED' ELSE 'NO_ANOMALY_OBSERVED' END"


def _media(s, d):
    return tables.table(s, d, "documents").select(F.col("doc_id").alias("analysis_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def _segments(s, d):
    return tables.table(s, d, "events").select(F.floor(F.col("event_id") / 40).alias("analysis_id"), F.lit("video_a").alias("detector"), F.col("event_id").alias("start_frame"), (F.col("event_id") + 3).alias("end_frame"), (F.col("value") / 100).alias("peak_score"))


_ITEMS = f"""SELECT doc_id AS analysis_id, 'FACT' AS category, 'fingerprinting' AS stage, NULL AS detector, concat('SHA-256 is ', sha256(text)) AS description, 1.0::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'FACT', 'ingestion', NULL, concat('File size: ', strlen(text), ' bytes'), 1.0 FROM documents
UNION ALL SELECT analysis_id, CASE WHEN p IS NULL OR p = 'INDETERMINATE' THEN 'UNCERTAINTY' ELSE 'OBSERVATION' END, 'detection', detector, concat(detector, CASE WHEN p IS NULL THEN ' did not produce observations' WHEN p = 'INDETERMINATE' THEN ' was inconclusive' WHEN p = 'ANOMALY_OBSERVED' THEN ' reported anomalies' ELSE ' reported no anomalies above its threshold; this is no finding of authenticity' END), confidence FROM (SELECT *, {_P} AS p FROM v_detections)
UNION ALL SELECT analysis_id, 'OBSERVATION', 'video_detection', 'video_a', concat('Frames ', event_id, ' to ', event_id + 3, ' show an anomaly'), value / 100 FROM (SELECT *, event_id // 40 AS analysis_id, row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) AS r FROM events) WHERE r <= 5"""


@query(f"SELECT analysis_id, category, stage, detector, description, round(confidence, 6) AS confidence FROM ({_ITEMS})")
def evidence_union(s, d):
    return rounded(E.evidence_union(_media(s, d), tables.detections(s, d), _segments(s, d)))


@query(f"""SELECT analysis_id, {", ".join(f"coalesce(string_agg(description, '|' ORDER BY description) FILTER (category = '{c}'), '') AS {c.lower()}" for c in ("FACT", "OBSERVATION", "INFERENCE"))}, coalesce(string_agg(description, '|' ORDER BY description) FILTER (category NOT IN ('FACT', 'OBSERVATION', 'INFERENCE')), '') AS uncertainty
FROM (SELECT * REPLACE (CASE WHEN detector = 'gen_a' THEN 'GUESS' WHEN detector = 'gen_b' THEN 'INFERENCE' ELSE category END AS category) FROM ({_ITEMS})) GROUP BY 1""")
def classify_evidence(s, d):
    items = E.evidence_union(_media(s, d), tables.detections(s, d), _segments(s, d)).withColumn("category", F.when(F.col("detector") == "gen_a", "GUESS").when(F.col("detector") == "gen_b", "INFERENCE").otherwise(F.col("category")))
    c = E.classified(items)
    return c.select("analysis_id", *[F.array_join(x, "|").alias(x) for x in ("fact", "observation", "inference", "uncertainty")])


@query(f"SELECT analysis_id, coalesce(string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) FILTER (p IS NOT NULL), '') AS observed, coalesce(string_agg(detection_id::VARCHAR, ',' ORDER BY detection_id) FILTER (p IS NULL), '') AS gaps FROM (SELECT *, {_P} AS p FROM v_detections) GROUP BY 1")
def observations(s, d):
    o = E.observations(tables.detections(s, d))
    return o.select("analysis_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("observed", "gaps")])


@query("SELECT detection_id // 6 AS analysis_id, CASE WHEN detection_id % 10 = 0 THEN detection_id + 6 ELSE detection_id END AS observation_id, CASE WHEN detection_id % 7 = 0 THEN 'MENTIONS' ELSE 'SUPPORTS' END AS relation, CASE WHEN detection_id % 7 = 0 THEN 'unknown relation' ELSE 'foreign observation' END AS problem FROM v_detections WHERE detection_id % 7 = 0 OR detection_id % 10 = 0")
def foreign_links(s, d):
    t = tables.detections(s, d)
    links = t.select("analysis_id", F.when(F.col("detection_id") % 10 == 0, F.col("detection_id") + 6).otherwise(F.col("detection_id")).alias("observation_id"), F.when(F.col("detection_id") % 7 == 0, "MENTIONS").otherwise("SUPPORTS").alias("relation"))
    return E.foreign_links(links, t.select("analysis_id", F.col("detection_id").alias("observation_id")), ["SUPPORTS", "CONTRADICTS"])


@query(f"""WITH dd AS (SELECT *, {_P} AS p FROM v_detections), a AS (SELECT DISTINCT analysis_id FROM v_detections), s AS (SELECT analysis_id, provider, CASE WHEN (analysis_id + CASE provider WHEN 'archive' THEN 0 ELSE 1 END) % 3 = 0 THEN 'COMPLETED' ELSE 'UNAVAILABLE' END AS status FROM a, (VALUES ('archive'), ('corpus')) k(provider)),
x AS (SELECT analysis_id, 0 AS k, lpad(detection_id::VARCHAR, 20, '0') AS o, concat(detector, CASE WHEN p IS NULL THEN ': did not run' ELSE ': inconclusive' END) AS limitation FROM dd WHERE p IS NULL OR p = 'INDETERMINATE' UNION ALL SELECT analysis_id, 1, provider, concat('Source ', provider, ' was not searched') FROM s WHERE status <> 'COMPLETED'
UNION ALL SELECT analysis_id, 2, '', CASE WHEN bool_or(status = 'COMPLETED') THEN 'No verified source was found in what was searched' ELSE 'No source was searched' END FROM s GROUP BY 1 HAVING NOT bool_or(status = 'COMPLETED') OR analysis_id NOT IN (SELECT analysis_id FROM v_sources WHERE status = 'VERIFIED_MATCH')
UNION ALL SELECT analysis_id, 3, '', 'No learned model produced observations' FROM dd GROUP BY 1 HAVING NOT bool_or(detector = 'learned_a' AND p IS NOT NULL)), f AS (SELECT analysis_id, limitation, min(k) AS k, min(o) AS o FROM x GROUP BY 1, 2) SELECT analysis_id, limitation, row_number() OVER (PARTITION BY analysis_id ORDER BY k, o, limitation) AS place FROM f""")
def limitations(s, d):
    t = tables.detections(s, d)
    each = t.select("analysis_id").distinct().select("analysis_id", F.explode(F.array(F.lit("archive"), F.lit("corpus"))).alias("provider"))
    searches = each.withColumn("status", F.when((F.col("analysis_id") + F.when(F.col("provider") == "archive", 0).otherwise(1)) % 3 == 0, "COMPLETED").otherwise("UNAVAILABLE"))
    return rounded(E.limitations(t, searches, tables.sources(s, d), ["learned_a"]))


@query(f"""SELECT analysis_id, CASE WHEN usable = 0 THEN 'INCONCLUSIVE' WHEN positive > 0 THEN CASE WHEN families >= 2 AND negative = 0 AND localised THEN 'LIKELY_MANIPULATED' ELSE 'SUSPICIOUS' END WHEN gone > 0 OR negative = 0 THEN 'INCONCLUSIVE' ELSE 'NO_SIGNIFICANT_ANOMALIES_DETECTED' END AS assessment,
CASE WHEN positive = 0 THEN 'NONE' WHEN negative > 0 THEN 'CONTRADICTORY' WHEN families >= 2 AND localised THEN 'STRONG' WHEN families >= 2 THEN 'MODERATE' ELSE 'WEAK' END AS strength, families, positive > 0 AND negative > 0 AS contradicted, dominant, missing
FROM (SELECT analysis_id, count(*) FILTER (v AND p IS NOT NULL) AS usable, count(*) FILTER (v AND p = 'ANOMALY_OBSERVED') AS positive, count(*) FILTER (v AND p = 'NO_ANOMALY_OBSERVED') AS negative, count(*) FILTER (v AND p IS NULL) AS gone, count(DISTINCT family) FILTER (v AND p = 'ANOMALY_OBSERVED') AS families, coalesce(bool_or(localised) FILTER (v AND p = 'ANOMALY_OBSERVED'), false) AS localised,
(list(detector ORDER BY confidence DESC, detection_id) FILTER (v AND p = 'ANOMALY_OBSERVED'))[1] AS dominant, coalesce(string_agg(detector, ',' ORDER BY detector) FILTER (p IS NULL), '') AS missing FROM (SELECT *, {_P} AS p, family NOT IN ('ai_generation', 'non_evidential') AS v FROM (SELECT *, {FAMILY} AS family FROM v_detections)) GROUP BY 1)""")
def engine_assessment(s, d):
    return E.engine_assessment(with_family(s, d))


@query("""WITH h AS (SELECT page_id AS hit_id, split_part(url, '?', 1) AS url, CASE WHEN page_id % 2 = 0 THEN sha1(html) END AS sha FROM pages WHERE page_id % 4 < 3), f AS (SELECT url, min(hit_id) AS hit_id, min_by(sha, hit_id) AS sha, min_by(hit_id, hit_id) AS k FROM h GROUP BY 1), g AS (SELECT h.url, h.hit_id, h.sha FROM h JOIN f ON h.url = f.url AND h.hit_id = f.hit_id),
c AS (SELECT split_part(url, '?', 1) AS url, concat('2024', lpad((page_id % 12 + 1)::VARCHAR, 2, '0'), '01000000') AS stamp, CASE WHEN page_id % 3 = 0 THEN sha1(html) ELSE sha1(url) END AS digest FROM pages), x AS (SELECT g.url, hit_id, min(stamp) FILTER (digest = sha) AS own, min(stamp) AS a FROM g JOIN c ON g.url = c.url GROUP BY 1, 2) SELECT url, hit_id, coalesce(own, a) AS captured, CASE WHEN own IS NULL THEN 'SIMILAR_UNVERIFIED' ELSE 'VERIFIED_MATCH' END AS status FROM x""")
def archive_lookup(s, d):
    p, address, bytes_ = tables.table(s, d, "pages"), F.substring_index("url", "?", 1), F.sha1(F.col("html").cast("binary"))
    hits = p.where("page_id % 4 < 3").select(F.col("page_id").alias("hit_id"), address.alias("url"), F.when(F.col("page_id") % 2 == 0, bytes_).alias("sha1"))
    captures = p.select(address.alias("url"), F.concat(F.lit("2024"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("01000000")).alias("stamp"), F.when(F.col("page_id") % 3 == 0, bytes_).otherwise(F.sha1(F.col("url").cast("binary"))).alias("digest"))
    return E.archive_lookup(hits, captures)


@query("SELECT source_id, analysis_id % 8 AS part, CASE WHEN analysis_id % 8 % 3 = 0 THEN 'new' ELSE status END AS status FROM v_sources WHERE NOT (analysis_id % 8 % 3 = 0 AND source_id % 2 = 1)")
def replace_group(s, d):
    old = tables.sources(s, d).select("source_id", "status", (F.col("analysis_id") % 8).cast("int").alias("part"))
    new = old.where("part % 3 = 0 and source_id % 2 = 0").withColumn("status", F.lit("new"))
    return E.replace_groups(old, new, "part")


@query(f"""SELECT analysis_id, concat('# Analysis ', analysis_id, chr(10), string_agg(concat('- ', detector, ': ', coalesce({_P}, 'NOT_RUN')), chr(10) ORDER BY detection_id)) AS markdown, concat('{{"analysis_id":', analysis_id, ',"checks":[', string_agg(concat('{{"detection_id":', detection_id, ',"detector":"', detector, '","outcome":"', coalesce({_P}, 'NOT_RUN'), '"}}'), ',' ORDER BY detection_id), ']}}') AS document FROM v_detections GROUP BY 1""")
def report_sink(s, d):
    return E.reports(tables.detections(s, d))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'FAILED' WHEN doc_id % 7 = 0 THEN 'FAILED' WHEN doc_id % 5 = 0 THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS outcome, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN NULL ELSE round((doc_id % 100) / 100.0, 6)::DOUBLE END AS score,
CASE WHEN doc_id % 11 = 0 THEN 'ValueError: cannot score this' WHEN doc_id % 7 = 0 THEN 'score is not within 0 and 1' WHEN doc_id % 5 = 0 THEN 'no result' END AS reason, CASE WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 2 ELSE 1 END AS tries FROM documents""")
def score_batch(s, d):
    return rounded(scoring.score_batch(tables.table(s, d, "documents"), "doc_id", ["text"], scoring.example_scorer).select("doc_id", "outcome", "score", "reason", "tries"))
