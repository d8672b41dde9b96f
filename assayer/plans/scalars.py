"""Queries on single records, and fits that only invariants can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import stats, text
from assayer.operators import calibration
from assayer.plans.evidence import QUERIES, _wilson, query, rounded, rows_of
from assayer.plans.oracle import hb
from assayer.sources import tables


#: (detector, positives, negatives, independent positives, independent negatives) that a calibration was fitted on; gen_a counts no originals.
FITTED = [("learned_a", 60, 400, 40, 300), ("geometric_a", 50, 300, 20, 100), ("gen_a", 30, 90, None, None), ("gen_b", 20, 40, 20, 40)]


@query(f"""SELECT id, detector, round(sign(v) * least(abs(v), cap), 6) AS capped_value, abs(v) > cap AS capped FROM (SELECT id, detector, v, log10(1 + CASE WHEN v > 0 THEN coalesce(ine, n) ELSE coalesce(ip, p) END) AS cap FROM (SELECT id, detector, raw_score * 6 - 3 AS v FROM v_scores) JOIN (VALUES {", ".join(str(x).replace("None", "NULL") for x in FITTED)}) f(detector, p, n, ip, ine) USING (detector))""")
def lr_cap(s, d):
    fitted = s.createDataFrame(FITTED, "detector string, p int, n int, ip int, ine int")
    v, p, n = F.col("raw_score") * 6 - 3, F.coalesce("ip", "p"), F.coalesce("ine", "n")
    each = tables.scores(s, d).join(F.broadcast(fitted), "detector")  # a row for each detector
    capped = stats.lr_cap(v, p, n)
    return rounded(each.select("id", "detector", capped.alias("capped_value"), (capped != v).alias("capped")))


@query("SELECT id, detector, round(CASE WHEN lo <= 0 AND hi >= 0 THEN 0.0 WHEN lo > 0 THEN lo ELSE hi END, 6) AS cautious FROM (SELECT id, detector, raw_score - 0.6 AS lo, raw_score - 0.2 AS hi FROM v_scores)")
def conservative_end(s, d):
    return rounded(tables.scores(s, d).select("id", "detector", stats.conservative_end(F.col("raw_score") - 0.6, F.col("raw_score") - 0.2).alias("cautious")))


@query("SELECT id, detector, CASE WHEN v >= 4 THEN 'very strong' WHEN v >= 3 THEN 'strong' WHEN v >= 2 THEN 'moderately strong' WHEN v >= 1 THEN 'moderate' ELSE 'limited' END AS strength FROM (SELECT id, detector, abs(raw_score * 10 - 5) AS v FROM v_scores)")
def verbal_scale(s, d):
    return tables.scores(s, d).select("id", "detector", stats.verbal_scale(F.col("raw_score") * 10 - 5).alias("strength"))


@query(f"SELECT branch, detector, k, n, {_wilson('k', 'n', 'rate')} FROM (SELECT branch, detector, count(*) FILTER (verdict = 'FLAGGED' AND tag <> 'social') AS k, count(*) FILTER (tag <> 'social') AS n FROM v_rows GROUP BY 1, 2)")
def wilson_interval(s, d):
    n = rows_of(s, d).groupBy("branch", "detector").agg(F.count_if((F.col("verdict") == "FLAGGED") & (F.col("tag") != "social")).alias("k"), F.count_if(F.col("tag") != "social").alias("n"))
    rate, low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(n.select("branch", "detector", "k", "n", rate.alias("rate"), low.alias("rate_low"), high.alias("rate_high")))


@query("SELECT id, detector, round(x, 6) AS logit, round(1 / (1 + exp(-(1.7::DOUBLE * x - 0.3::DOUBLE))), 6) AS sigmoid FROM (SELECT id, detector, ln(greatest(1e-6, least(1-1e-6, raw_score)) / (1 - greatest(1e-6, least(1-1e-6, raw_score)))) AS x FROM v_scores)")
def logit_sigmoid(s, d):
    x = stats.logit(F.col("raw_score"))
    return rounded(tables.scores(s, d).select("id", "detector", x.alias("logit"), stats.sigmoid(1.7 * x - 0.3).alias("sigmoid")))


@query("SELECT detection_id, coalesce(family, 'unclassified') AS family, CASE coalesce(family, 'unclassified') WHEN 'ai_generation' THEN 'ai_generation' WHEN 'non_evidential' THEN NULL ELSE 'manipulation' END AS branch FROM v_detections LEFT JOIN (VALUES ('learned_a','learned'), ('geometric_a','geometric'), ('gen_a','ai_generation'), ('gen_b','ai_generation'), ('face_a','non_evidential')) f(detector, family) USING (detector)")
def signal_family(s, d):
    known = s.createDataFrame([*[(x[0], x[2]) for x in tables.DETECTORS], ("face_a", "non_evidential")], "detector string, family string")  # one row a detector
    family = F.coalesce("family", F.lit("unclassified"))
    branch = F.when(family == "ai_generation", "ai_generation").when(family != "non_evidential", "manipulation")
    return tables.detections(s, d).join(F.broadcast(known), "detector", "left").select("detection_id", family.alias("family"), branch.alias("branch"))


@query("SELECT doc_id, length(text) > 200 AS cut, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS short_text FROM documents")
def truncate_text(s, d):
    t = F.col("text")
    return tables.table(s, d, "documents").select("doc_id", (F.length(t) > 200).alias("cut"), text.truncate_text(t, 200).alias("short_text"))


@query("SELECT media_id, frame_index, round(greatest(0.0, least(1.0, 0.5*combined_score + 0.3*least(combined_score*12/8, 1.0) + 0.2*combined_score)), 6) AS score FROM v_frames")
def frame_score(s, d):
    c = F.col("combined_score")
    return rounded(tables.frames(s, d).select("media_id", "frame_index", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * c + 0.3 * F.least(c * 12 / 8, F.lit(1.0)) + 0.2 * c)).alias("score")))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND stale THEN 'FAILED' WHEN event_type = 'view' THEN 'RUNNING' ELSE 'DONE' END AS state FROM (SELECT *, ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS stale FROM events)")
def stale_runs(s, d):
    e = tables.table(s, d, "events")
    last = e.agg(F.max("ts").alias("now"))  # one row
    stale = F.col("ts") < F.col("now") - F.expr("INTERVAL 3 DAYS")
    return e.crossJoin(F.broadcast(last)).select("event_id", F.when((F.col("event_type") == "view") & stale, "FAILED").when(F.col("event_type") == "view", "RUNNING").otherwise("DONE").alias("state"))


@query("SELECT detector, count(DISTINCT version) AS versions, count(DISTINCT version) = 1 AS usable FROM (SELECT detector, CASE WHEN detector = 'gen_a' AND id LIKE '%7' THEN 'v2' ELSE 'v1' END AS version FROM v_scores) GROUP BY 1")
def version_guard(s, d):
    v = F.when((F.col("detector") == "gen_a") & F.col("id").endswith("7"), "v2").otherwise("v1")
    return tables.scores(s, d).withColumn("version", v).groupBy("detector").agg(F.count_distinct("version").alias("versions")).withColumn("usable", F.col("versions") == 1)


@query("SELECT media_id, round(sum(w*s)/sum(w), 6) AS score FROM (SELECT media_id, combined_score AS s, CASE frame_index % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM v_frames) GROUP BY 1")
def weighted_score(s, d):
    w = F.when(F.col("frame_index") % 3 == 0, 2.0).when(F.col("frame_index") % 3 == 1, 0.5).otherwise(1.0)
    return rounded(tables.frames(s, d).groupBy("media_id").agg((F.sum(w * F.col("combined_score")) / F.sum(w)).alias("score")))


@query(f"SELECT id FROM v_items WHERE {hb('id')} >= 0.3 AND grp NOT IN (SELECT grp FROM v_items WHERE {hb('grp')} < 0.1)")
def exclude_known(s, d):
    items = tables.items(s, d)
    known = items.where(stats.hash_bucket("id") < 0.3).select("id")
    groups = items.where(stats.hash_bucket("grp") < 0.1).select("grp").distinct()
    return items.join(known, "id", "left_anti").join(groups, "grp", "left_anti").select("id")


def moving_window_limit(s, d):
    """Which requests of each client and endpoint are admitted: five a day, and refused ones do not count."""
    e = tables.table(s, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("id"))
    return calibration.admitted(e, ["user_id", "event_type"], 86_400, 5)


QUERIES["moving_window_limit"] = moving_window_limit
