"""Queries on calibrations, their records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.operators import calibration, evaluation, fusion, provenance, ranks, splits
from assayer.plans.evidence import QUERIES, _metrics, _wilson, found, query, rounded, rows_of
from assayer.plans.evidence import split_items  # noqa: F401
from assayer.plans.oracle import hb
from assayer.sources import tables

#: (detector, fitted version, method, a, b, threshold, prior); gen_a runs in another version, geometric_a has none.
FITTED = [("learned_a", "v1", "platt_logit", 1.3, 0.1, 0.6, 0.3), ("gen_a", "v0", "platt_logit", 1.1, 0.0, 0.5, 0.4), ("gen_b", "v1", "flag_rate", 0.8, 0.1, 0.5, 0.2)]
_VALUES = ", ".join(f"('{x[0]}','{x[1]}','{x[2]}',{x[3]}::DOUBLE,{x[4]}::DOUBLE,{x[5]}::DOUBLE,{x[6]}::DOUBLE)" for x in FITTED)
_FITTED = f"(VALUES {_VALUES}) f(detector, version, method, a, b, threshold, prior)"
_SCHEMA = "detector string, version string, method string, a double, b double, threshold double, prior double"
_LOGIT = "ln(greatest(1e-6, least(1-1e-6, {0})) / (1 - greatest(1e-6, least(1-1e-6, {0}))))"


@query(f"""SELECT id, detector, coalesce(version = 'v1', false) AS applied, round(p, 6) AS probability, CASE method WHEN 'flag_rate' THEN raw_score >= threshold ELSE p >= threshold END AS flagged, CASE WHEN version IS NULL THEN 'no calibration' WHEN version <> 'v1' THEN concat('fitted for version ', version) END AS reason
FROM (SELECT id, s.detector, raw_score, version, method, threshold, CASE WHEN version <> 'v1' OR version IS NULL THEN NULL WHEN method = 'flag_rate' THEN (CASE WHEN raw_score >= threshold THEN a / b ELSE (1 - a) / (1 - b) END * prior / (1 - prior)) / (1 + CASE WHEN raw_score >= threshold THEN a / b ELSE (1 - a) / (1 - b) END * prior / (1 - prior)) ELSE 1 / (1 + exp(-(a * {_LOGIT.format("raw_score")} + b))) END AS p
FROM v_scores s LEFT JOIN {_FITTED} ON s.detector = f.detector)""")
def apply_calibration(s, d):
    known = s.createDataFrame(FITTED, _SCHEMA)
    return rounded(calibration.apply(tables.scores(s, d).withColumn("version", F.lit("v1")), known).select("id", "detector", "applied", "probability", "flagged", "reason"))


@query(f"""SELECT detector, CASE WHEN f.version IS NULL THEN 'not_in_file' WHEN r.version IS NULL THEN 'not_running' WHEN f.version <> r.version THEN 'version_mismatch' ELSE 'matched' END AS status, false AS consistent FROM (SELECT * FROM {_FITTED} UNION ALL SELECT 'old_a', 'v1', '', 0, 0, 0, 0) f FULL JOIN (SELECT DISTINCT detector, 'v1' AS version FROM v_scores) r USING (detector)""")
def calibration_consistency(s, d):
    fitted = s.createDataFrame([*FITTED, ("old_a", "v1", "", 0.0, 0.0, 0.0, 0.0)], _SCHEMA)
    return calibration.consistency(fitted, tables.scores(s, d).select("detector", F.lit("v1").alias("version")).distinct())


_PAIRS = "unnest([[1.3 + k * 0.02, 0.1 - k * 0.01] FOR k IN range(-10, 11)])"


@query(f"""SELECT id, detector, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM (SELECT id, detector, sign(x) * least(abs(x), log10(1 + CASE WHEN x > 0 THEN 400 ELSE 60 END)) AS v FROM (SELECT id, detector, log10(p / (1 - p)) - log10(0.3::DOUBLE / 0.7) AS x
FROM (SELECT id, detector, 1 / (1 + exp(-((1.3::DOUBLE + k * 0.02::DOUBLE) * {_LOGIT.format("raw_score")} + 0.1::DOUBLE - k * 0.01::DOUBLE))) AS p FROM v_scores, range(-10, 11) t(k)))) GROUP BY 1, 2""")
def lr_interval(s, d):
    pairs = F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda k: F.array(1.3 + k * 0.02, 0.1 - k * 0.01))
    found_ = calibration.interval(F.col("raw_score"), pairs, F.lit(0.3), F.lit(60), F.lit(400))
    return rounded(tables.scores(s, d).select("id", "detector", found_.alias("x")).select("id", "detector", "x.low", "x.high"))


@query(f"""WITH k AS (SELECT detector, target, score, grp, 1 / (1 + exp(-(1.3::DOUBLE * {_LOGIT.format("score")} + 0.1::DOUBLE))) AS p FROM v_rows WHERE score IS NOT NULL),
c AS (SELECT detector, max(p) FILTER (r > allowed) AS cut FROM (SELECT detector, p, row_number() OVER (PARTITION BY detector ORDER BY p DESC) AS r, floor(0.05 * count(*) OVER (PARTITION BY detector)) AS allowed FROM k WHERE NOT target) GROUP BY 1),
e AS (SELECT detector, sum(abs(s - y)) / sum(n) AS raw FROM (SELECT detector, least(floor(score * 10), 9) AS b, count(*) AS n, sum(score) AS s, sum(target::INT) AS y FROM k GROUP BY 1, 2) GROUP BY 1), f AS (SELECT detector, sum(abs(s - y)) / sum(n) AS fit FROM (SELECT detector, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS s, sum(target::INT) AS y FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT detector, round(avg(target::INT), 6) AS prior, round(any_value(cut), 6) AS threshold, round(count(*) FILTER (NOT target AND p > cut) / count(*) FILTER (NOT target)::DOUBLE, 6) AS fpr, round(count(*) FILTER (target AND p > cut) / count(*) FILTER (target)::DOUBLE, 6) AS recall, count(*) FILTER (target) AS positives, count(*) FILTER (NOT target) AS negatives,
count(DISTINCT grp) FILTER (target) AS independent_positives, count(DISTINCT grp) FILTER (NOT target) AS independent_negatives, round(any_value(raw), 6) AS ece_raw, round(any_value(fit), 6) AS ece_calibrated FROM k JOIN c USING (detector) JOIN e USING (detector) JOIN f USING (detector) GROUP BY 1""")
def calibration_record(s, d):
    rows = rows_of(s, d)
    known = s.createDataFrame([(x[0], 1.3, 0.1) for x in tables.DETECTORS], "detector string, a double, b double")
    return rounded(calibration.record(rows, "detector", known, 0.05, "grp"))


def fit_platt(s, d):
    """Slope and intercept of each detector's calibration."""
    fits = calibration.fit_platt(rows_of(s, d), "detector")
    return rounded(s.createDataFrame([(g, *(t[0] or (None, None)), t[0] is not None) for g, t in fits.items()], "detector string, a double, b double, usable boolean"))


def group_bootstrap(s, d):
    """Slope and intercept of each detector's calibration in 200 resamples that draw whole groups; resamples that do not fit are left out."""
    fits = calibration.fit_platt(rows_of(s, d), "detector", 200, "grp")
    return rounded(s.createDataFrame([(g, r, *t) for g, ts in fits.items() for r, t in enumerate(ts) if t], "detector string, rep int, a double, b double"))


def auc_bootstrap_ci(s, d):
    """An interval of each detector's AUC from 1,000 resamples."""
    return rounded(calibration.auc_bootstrap(rows_of(s, d), "detector"))


def cllr_min_pav(s, d):
    """Each detector's cost of likelihood ratios, what the best order-keeping recalibration leaves of it, and the difference."""
    rows = rows_of(s, d)
    cost = evaluation.cllr(rows, 8.0 * (F.col("score") - 0.45), "detector").select("detector", "cllr")
    return rounded(cost.join(evaluation.cllr_min(rows, "detector"), "detector").withColumn("calibration_loss", F.col("cllr") - F.col("cllr_min")))


QUERIES |= {f.__name__: f for f in (fit_platt, group_bootstrap, auc_bootstrap_ci, cllr_min_pav)}


@query("""WITH f AS (SELECT n_chars, strlen(text) + doc_id % 7 * 100 AS other FROM documents), r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0 AS b FROM f) SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(s, d):
    docs = tables.table(s, d, "documents").select("n_chars", (F.octet_length("text") + F.col("doc_id") % 7 * 100).alias("other"))
    return rounded(s.createDataFrame([(evaluation.spearman(docs, "n_chars", "other"),)], "rho double"))


@query(_metrics("branch, detector", "(SELECT * REPLACE (CASE WHEN execution_status <> 'COMPLETED' THEN 'ABSTAINED' WHEN raw_score >= 0.5 THEN 'FLAGGED' ELSE 'CLEARED' END AS verdict) FROM v_rows)"))
def per_detector_metrics(s, d):
    scores = tables.scores(s, d)
    own = F.struct("branch", "execution_status", "raw_score")
    predictions = scores.groupBy("id", "label", "kind").agg(F.map_from_entries(F.collect_list(F.struct(F.col("detector"), own))).alias("detectors"))
    rows = evaluation.per_detector(predictions)
    rows = evaluation.branch_targets(rows).withColumn("target", F.when(F.col("branch") == "manipulation", F.col("manipulation")).otherwise(F.col("ai_generation"))).where("target is not null")
    return rounded(evaluation.binary_metrics(rows, "branch", "detector"))


_SPLIT = f"CASE WHEN {hb("concat('r:', id)")} < 0.5 THEN 'val' ELSE 'test' END"
_OWN = "(SELECT * REPLACE (CASE WHEN execution_status <> 'COMPLETED' THEN 'ABSTAINED' WHEN raw_score >= 0.5 THEN 'FLAGGED' ELSE 'CLEARED' END AS verdict) FROM x)"


def _long(columns: list[str]) -> str:
    return f"LATERAL (VALUES {', '.join(f"('{m}', {m}::DOUBLE)" for m in columns)}) k(name, value)"


def _by_group(rows: str) -> str:
    return f"(SELECT split, branch, detector, target, verdict, concat(key, '=', member) AS g FROM (SELECT *, unnest(['label', 'kind', 'tag']) AS key, unnest([label, kind, tag]) AS member FROM {rows}) WHERE member IS NOT NULL)"


_ALL, _FEW = _long(evaluation._METRICS), _long(["positives", "negatives", *evaluation._RATES])
_LOCAL = f"""(SELECT split, items, mean_iou, mean_f1, good, {_wilson("good", "items", "share")} FROM (SELECT split, count(*) AS items, avg(iou) AS mean_iou, avg(f1) AS mean_f1, count(*) FILTER (iou >= 0.5) AS good FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'val' ELSE 'test' END AS split,
count(*) FILTER (p AND t) / count(*) FILTER (p OR t)::DOUBLE AS iou, 2 * count(*) FILTER (p AND t) / (count(*) FILTER (p) + count(*) FILTER (t))::DOUBLE AS f1 FROM (SELECT vec_id, value > 0 AS p, y < 4 AS t FROM v_pixels) GROUP BY 1, 2) GROUP BY 1))"""


@query(f"""WITH x AS (SELECT *, {_SPLIT} AS split FROM v_rows), m AS ({_metrics("split, branch", "x")}), z AS (SELECT *, {_SPLIT} AS split FROM v_scores), own AS ({_metrics("split, branch, detector", _OWN)}), sub AS ({_metrics("split, branch, g", _by_group("x"))}), osub AS ({_metrics("split, branch, detector, g", _by_group(_OWN))})
SELECT split, 'branch' AS section, concat(branch, '.', k.name) AS name, round(k.value, 6) AS value FROM m, {_ALL} UNION ALL SELECT split, 'subgroup', concat_ws('.', branch, g, k.name), round(k.value, 6) FROM sub, {_FEW}
UNION ALL SELECT split, 'own', concat_ws('.', branch, detector, k.name), round(k.value, 6) FROM own, {_ALL} UNION ALL SELECT split, 'own_subgroup', concat_ws('.', branch, detector, g, k.name), round(k.value, 6) FROM osub, {_FEW}
UNION ALL SELECT p.split, 'detector', concat(p.detector, '.auc'), round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) FROM x p JOIN x n ON p.split = n.split AND p.detector = n.detector AND p.target AND NOT n.target AND p.score IS NOT NULL AND n.score IS NOT NULL GROUP BY p.split, p.detector
UNION ALL SELECT split, 'detector', concat(detector, '.p50_ms'), round(quantile_cont(duration_ms, 0.5), 6) FROM z GROUP BY split, detector UNION ALL SELECT split, 'detector', concat(detector, '.p95_ms'), round(quantile_cont(duration_ms, 0.95), 6) FROM z GROUP BY split, detector
UNION ALL SELECT split, 'detector', concat_ws('.', detector, lower(st)), count(*) FILTER (execution_status = st)::DOUBLE FROM z, (VALUES ('COMPLETED'), ('INCONCLUSIVE'), ('FAILED')) v(st) GROUP BY split, detector, st
UNION ALL SELECT split, 'all', concat(branch, '.silent'), (count(*) FILTER (failed AND NOT flagged AND ran))::DOUBLE FROM (SELECT split, id, branch, bool_or(execution_status='FAILED') AS failed, bool_or(execution_status='COMPLETED' AND raw_score >= 0.5) AS flagged, bool_or(execution_status='COMPLETED') AS ran FROM z GROUP BY 1, 2, 3) GROUP BY split, branch
UNION ALL SELECT split, 'all', 'files', count(DISTINCT id)::DOUBLE FROM z GROUP BY split UNION ALL SELECT split, 'localisation', k.name, round(k.value, 6) FROM {_LOCAL}, {_long(["items", "mean_iou", "mean_f1", "good", "share", "share_low", "share_high"])}""")
def evaluation_report(s, d):
    split = F.when(stats.hash_bucket(F.concat(F.lit("r:"), "id")) < 0.5, "val").otherwise("test")
    scores = tables.scores(s, d).withColumn("split", split)
    masks = tables.pixels(s, d).select("vec_id", (F.col("value") > 0).alias("p"), (F.col("y") < 4).alias("t"))
    overlaps = provenance.mask_scores(masks, "vec_id").withColumn("split", F.when(F.col("vec_id") % 2 == 0, "val").otherwise("test"))
    return rounded(evaluation.report(evaluation.branch_rows(scores), scores, ["label", "kind", "tag"], overlaps))


_MASKS = "SELECT vec_id, value > 0 AS p, y < 4 AS t FROM v_pixels"


@query(f"SELECT items, mean_iou, median_iou, mean_f1, good, {_wilson('good', 'items', 'share')} FROM (SELECT count(*) AS items, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg(f1), 6) AS mean_f1, count(*) FILTER (iou >= 0.35) AS good FROM (SELECT vec_id, count(*) FILTER (p AND t) / count(*) FILTER (p OR t)::DOUBLE AS iou, 2 * count(*) FILTER (p AND t) / (count(*) FILTER (p) + count(*) FILTER (t))::DOUBLE AS f1 FROM ({_MASKS}) GROUP BY 1))")
def localisation_summary(s, d):
    m = tables.pixels(s, d).select("vec_id", (F.col("value") > 0).alias("p"), (F.col("y") < 4).alias("t"))
    each = provenance.mask_scores(m, "vec_id").withColumn("all", F.lit("all"))
    n = each.groupBy("all").agg(F.count("*").alias("items"), F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("iou") >= 0.35).alias("good"))
    rate, low, high = stats.wilson(F.col("good"), F.col("items"))
    return rounded(n.join(ranks.percentiles(each, ["all"], "iou", {"median_iou": 0.5}), "all").drop("all").withColumns({"share": rate, "share_low": low, "share_high": high}))


@query("SELECT split, sha256(string_agg(part, '' ORDER BY r)) AS fingerprint FROM (SELECT split, h[1:4] AS r, sha256(string_agg(h, '' ORDER BY h)) AS part FROM (SELECT label AS split, sha256(concat(id, '|', grp)) AS h FROM v_items) GROUP BY 1, 2) GROUP BY 1")
def dataset_fingerprint(s, d):
    return splits.fingerprint(tables.items(s, d).withColumn("split", F.col("label")), "split", ["id", "grp"])


def fusion_statement(s, d):
    """Each analysis's fused evidence in a sentence."""
    return fusion.statement(fusion.fuse_evidence(found(s, d)))


QUERIES["fusion_statement"] = fusion_statement


@query("SELECT 'edge' AS record, concat('analysis:', analysis_id) AS a, concat('source:', source_id) AS b, CASE WHEN status='VERIFIED_MATCH' THEN 'same_image_as' ELSE 'visually_similar_to' END AS label FROM v_sources WHERE status <> 'NO_MATCH' UNION ALL SELECT 'node', a, NULL, split_part(a, ':', 1) FROM (SELECT DISTINCT concat('analysis:', analysis_id) AS a FROM v_sources WHERE status <> 'NO_MATCH' UNION SELECT concat('source:', source_id) FROM v_sources WHERE status <> 'NO_MATCH')")
def provenance_graph(s, d):
    return provenance.graph(tables.sources(s, d))
