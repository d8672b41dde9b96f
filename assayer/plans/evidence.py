"""Every query by name, each beside the DuckDB text that must give the same rows; doubles are rounded to six places in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import stats, text
from assayer.operators import evaluation, fusion, records, retrieval, sequences, splits
from assayer.plans.oracle import hb, with_views
from assayer.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its name, with its twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, with_views(sql)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}).withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int"})


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _wilson(k: str, n: str, name: str) -> str:
    z = 1.96
    centre, half = f"({k}/({n})::DOUBLE + {z * z}/(2*({n})))", f"{z}*sqrt({k}/({n})::DOUBLE*(1-{k}/({n})::DOUBLE)/({n}) + {z * z}/(4.0*({n})*({n})))"
    d = f"(1 + {z * z}/({n}))"
    return f"""CASE WHEN ({n}) > 0 THEN round({k}/({n})::DOUBLE, 6) END AS {name}, CASE WHEN ({n}) > 0 THEN round(greatest(0.0, ({centre} - {half})/{d}), 6) END AS {name}_low,
  CASE WHEN ({n}) > 0 THEN round(least(1.0, ({centre} + {half})/{d}), 6) END AS {name}_high"""


def _metrics(by: str, rows: str = "v_rows") -> str:
    return f"""SELECT {by}, positives, negatives, tp, fn, fp, tn, {_wilson("tp", "tp+fn", "recall")}, {_wilson("fp", "fp+tn", "fpr")}, {_wilson("tp", "tp+fp", "precision")},
  CASE WHEN tp+fn > 0 AND fp+tn > 0 THEN round(0.5*(tp/(tp+fn)::DOUBLE + 1 - fp/(fp+tn)::DOUBLE), 6) END AS balanced_accuracy,
  CASE WHEN positives > 0 THEN round((positives-tp-fn)/positives::DOUBLE, 6) END AS abstained_positive, CASE WHEN negatives > 0 THEN round((negatives-fp-tn)/negatives::DOUBLE, 6) END AS abstained_negative
  FROM (SELECT {by}, count(*) FILTER (target) AS positives, count(*) FILTER (NOT target) AS negatives, count(*) FILTER (target AND verdict='FLAGGED') AS tp, count(*) FILTER (target AND verdict='CLEARED') AS fn,
  count(*) FILTER (NOT target AND verdict='FLAGGED') AS fp, count(*) FILTER (NOT target AND verdict='CLEARED') AS tn FROM {rows} GROUP BY {by})"""


def rows_of(s: SparkSession, d: str) -> DataFrame:
    return evaluation.branch_rows(tables.scores(s, d))


# --- evaluation


@query(_metrics("branch, detector"))
def binary_metrics(s, d):
    return rounded(evaluation.binary_metrics(rows_of(s, d), "branch", "detector"))


@query("SELECT id, label, CASE label WHEN 'manipulated' THEN true WHEN 'real' THEN false END AS manipulation, CASE WHEN label='ai_generated' THEN true WHEN label='real' THEN false WHEN label='manipulated' AND NOT (kind LIKE '%inpaint%' AND kind NOT LIKE '%opencv%') THEN false END AS ai_generation FROM v_items")
def branch_targets(s, d):
    return evaluation.branch_targets(tables.items(s, d)).select("id", "label", "manipulation", "ai_generation")


@query("SELECT id, detector, target, verdict, round(score, 6) AS score FROM v_rows")
def branch_rows(s, d):
    return rounded(rows_of(s, d).select("id", "detector", "target", "verdict", "score"))


@query("""SELECT p.detector, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
FROM v_rows p JOIN v_rows n ON p.detector = n.detector AND p.target AND NOT n.target AND p.score IS NOT NULL AND n.score IS NOT NULL GROUP BY 1""")
def auc(s, d):
    return rounded(evaluation.auc(rows_of(s, d), "detector"))


@query(_metrics("branch, key, value", """(SELECT branch, target, verdict, unnest(['label','kind','tag']) AS key, unnest([label, kind, tag]) AS value FROM v_rows) WHERE value IS NOT NULL"""))
def subgroup_metrics(s, d):
    return rounded(evaluation.subgroup_metrics(rows_of(s, d), ["label", "kind", "tag"]))


@query("""SELECT detector, count(*) AS runs, count(*) FILTER (execution_status='COMPLETED') AS completed, count(*) FILTER (execution_status='INCONCLUSIVE') AS inconclusive, count(*) FILTER (execution_status='FAILED') AS failed,
round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM v_scores GROUP BY 1""")
def detector_ops(s, d):
    return rounded(evaluation.detector_ops(tables.scores(s, d)))


@query("""SELECT branch, count(*) AS items, count(*) FILTER (failed AND NOT flagged AND ran) AS silent FROM (SELECT id, branch, bool_or(execution_status='FAILED') AS failed, bool_or(execution_status='COMPLETED' AND raw_score >= 0.5) AS flagged, bool_or(execution_status='COMPLETED') AS ran FROM v_scores GROUP BY 1,2) GROUP BY 1""")
def silent_failures(s, d):
    return evaluation.silent_failures(tables.scores(s, d))


@query("""SELECT detector, round(sum(abs(sp-sy))/sum(n), 6) AS ece FROM (SELECT detector, least(floor(score*10), 9) AS bin, count(*) AS n, sum(score) AS sp, sum(target::INT) AS sy FROM v_rows WHERE score IS NOT NULL GROUP BY 1,2) GROUP BY 1""")
def ece(s, d):
    return rounded(evaluation.ece(rows_of(s, d), F.col("score"), "detector"))


@query("""SELECT detector, round(max(score) FILTER (r > allowed), 6) AS exceed, max(allowed)::BIGINT AS allowed FROM (SELECT detector, score, row_number() OVER (PARTITION BY detector ORDER BY score DESC) AS r, floor(0.08 * count(*) OVER (PARTITION BY detector)) AS allowed FROM v_rows WHERE NOT target AND score IS NOT NULL) GROUP BY 1""")
def threshold_for_fpr(s, d):
    return rounded(evaluation.threshold_for_fpr(rows_of(s, d), 0.08, "detector"))


@query("""SELECT detector, round(0.5*(avg(CASE WHEN target THEN log2(1+pow(10.0,-l)) END) + avg(CASE WHEN NOT target THEN log2(1+pow(10.0,l)) END)), 6) AS cllr, round(count(*) FILTER ((target AND l <= -1) OR (NOT target AND l >= 1))/count(*)::DOUBLE, 6) AS misleading
FROM (SELECT detector, target, 8.0*(score-0.45) AS l FROM v_rows WHERE score IS NOT NULL) GROUP BY 1""")
def cllr(s, d):
    return rounded(evaluation.cllr(rows_of(s, d), 8.0 * (F.col("score") - 0.45), "detector"))


@query("""SELECT detector, verdict, p, n, CASE WHEN n > 0 THEN round((p/np::DOUBLE)/(n/nn::DOUBLE), 6) END AS lr FROM (SELECT detector, verdict, count(*) FILTER (target) AS p, count(*) FILTER (NOT target) AS n FROM v_rows GROUP BY 1,2) JOIN (SELECT detector, count(*) FILTER (target) AS np, count(*) FILTER (NOT target) AS nn FROM v_rows GROUP BY 1) USING (detector)""")
def empirical_lr_by_label(s, d):
    return rounded(evaluation.empirical_lr(rows_of(s, d), "detector", "verdict"))


@query("""SELECT detector, round((tp+0.5)/(p+1), 6) AS a, round((fp+0.5)/(n+1), 6) AS b, p AS positives, n AS negatives, (tp+0.5)/(p+1) > (fp+0.5)/(n+1) AS usable FROM (SELECT detector, count(*) FILTER (target AND verdict='FLAGGED') AS tp, count(*) FILTER (NOT target AND verdict='FLAGGED') AS fp,
count(*) FILTER (target AND verdict IN ('FLAGGED','CLEARED')) AS p, count(*) FILTER (NOT target AND verdict IN ('FLAGGED','CLEARED')) AS n FROM v_rows GROUP BY 1)""")
def fit_flag_rate(s, d):
    return rounded(evaluation.flag_rates(rows_of(s, d), "detector"))


@query("""SELECT detector, CAST(floor(quantile_cont(short_side, 0.05)) AS BIGINT) AS floor FROM v_items CROSS JOIN (SELECT unnest(['learned_a','gen_a']) AS detector) GROUP BY 1""")
def coverage_floor(s, d):
    return tables.items(s, d).agg(F.floor(F.expr("percentile(short_side, 0.05)")).cast("bigint").alias("floor")).select(F.explode(F.array(F.lit("learned_a"), F.lit("gen_a"))).alias("detector"), "floor")


@query(f"""WITH b AS ({_metrics("branch, tag")}), c AS (SELECT branch, tag, tp/nullif(tp+fn, 0)::DOUBLE AS candidate FROM (SELECT branch, tag, count(*) FILTER (target AND raw_score >= 0.45) AS tp, count(*) FILTER (target AND raw_score < 0.45) AS fn FROM v_rows WHERE execution_status='COMPLETED' GROUP BY 1,2))
SELECT branch, tag, recall AS base, recall_low AS low, recall_high AS high, round(candidate, 6) AS candidate, round(round(candidate, 6) - recall, 6) AS delta, CASE WHEN round(candidate, 6) > recall_high THEN 'improved' WHEN round(candidate, 6) < recall_low THEN 'regressed' ELSE 'within_noise' END AS change FROM b JOIN c USING (branch, tag)""")
def compare_runs(s, d):
    rows = rows_of(s, d)
    other = rows.where("execution_status = 'COMPLETED'").withColumn("verdict", F.when(F.col("raw_score") >= 0.45, "FLAGGED").otherwise("CLEARED"))
    base, candidate = (rounded(evaluation.binary_metrics(x, "branch", "tag")) for x in (rows, other))
    return rounded(evaluation.compare_runs(base, candidate, ["branch", "tag"], "recall", "recall_low", "recall_high"))


# --- scalars


@query(f"SELECT id, round({hb('id')}, 6) AS bucket FROM v_items")
def hash_bucket(s, d):
    return rounded(tables.items(s, d).select("id", stats.hash_bucket("id").alias("bucket")))


_P = "(0.5*(1+tanh(0.5*(1.2*ln(q/(1-q)) + 0.1))))"


@query(f"""SELECT id, detector, round({_P}, 6) AS probability, round(log10({_P}/(1-{_P})) - log10(0.3/0.7), 6) AS log10_lr,
CASE WHEN abs(log10({_P}/(1-{_P})) - log10(0.3/0.7)) >= 4 THEN 'very strong' WHEN abs(log10({_P}/(1-{_P})) - log10(0.3/0.7)) >= 3 THEN 'strong' WHEN abs(log10({_P}/(1-{_P})) - log10(0.3/0.7)) >= 2 THEN 'moderately strong' WHEN abs(log10({_P}/(1-{_P})) - log10(0.3/0.7)) >= 1 THEN 'moderate' ELSE 'limited' END AS strength FROM (SELECT id, detector, greatest(1e-6, least(1-1e-6, raw_score)) AS q FROM v_scores)""")
def calibrated_probability(s, d):
    p = stats.platt(F.col("raw_score"), F.lit(1.2), F.lit(0.1))
    lr = stats.log10_lr(F.col("probability"), F.lit(0.3))
    return rounded(tables.scores(s, d).withColumn("probability", p).select("id", "detector", "probability", lr.alias("log10_lr"), stats.verbal_scale(lr).alias("strength")))


@query("""SELECT track_id, frame_index, round(CASE WHEN u > 0 THEN i/u ELSE 0 END, 6) AS iou FROM (SELECT track_id, frame_index, i, w*h + pw*ph - i AS u FROM (SELECT *, greatest(0.0, least(x+w, px+pw) - greatest(x, px)) * greatest(0.0, least(y+h, py+ph) - greatest(y, py)) AS i FROM
(SELECT *, lag(x) OVER k AS px, lag(y) OVER k AS py, lag(w) OVER k AS pw, lag(h) OVER k AS ph FROM v_boxes WINDOW k AS (PARTITION BY track_id ORDER BY frame_index)) WHERE px IS NOT NULL))""")
def box_iou(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("track_id").orderBy("frame_index")
    b = tables.boxes(s, d).withColumns({f"p{c}": F.lag(c).over(w) for c in "xywh"}).where("px is not null")
    return rounded(b.select("track_id", "frame_index", stats.box_iou(*[F.col(c) for c in ("x", "y", "w", "h", "px", "py", "pw", "ph")]).alias("iou")))


@query("SELECT analysis_id, detection_id, CASE WHEN execution_status IN ('FAILED','SKIPPED') THEN NULL WHEN execution_status <> 'COMPLETED' THEN 'INDETERMINATE' WHEN flagged THEN 'ANOMALY_OBSERVED' ELSE 'NO_ANOMALY_OBSERVED' END AS polarity FROM v_detections")
def observation_polarity(s, d):
    return records.observations(tables.detections(s, d)).select("analysis_id", "detection_id", "polarity")


@query("""SELECT page_id, CASE WHEN instr(url, '?') = 0 THEN url ELSE concat(split_part(url, '?', 1), CASE WHEN q <> '' THEN concat('?', q) ELSE '' END, regexp_extract(url, '(#.*)$', 1)) END AS clean, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') AS domain
FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: NOT starts_with(p, 'utm_')), '&') AS q FROM pages)""")
def url_clean(s, d):
    return tables.table(s, d, "pages").select("page_id", text.url_clean(F.col("url")).alias("clean"), text.url_domain(F.col("url")).alias("domain"))


@query("""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') || ' Ééé © 2 ¬it; &bogus;', '\\s+', ' ', 'g'))) AS text_sha256 FROM pages""")
def html_to_text(s, d):
    return tables.table(s, d, "pages").select("page_id", F.sha2(text.html_to_text(F.concat("html", F.lit(" &Eacute;&#233;&#xE9; &copy 2 &notit; &bogus;"))).cast("binary"), 256).alias("text_sha256"))


# --- splits


def _split(key: str) -> str:
    u = hb("concat('v1:', " + key + ")")
    return f"CASE WHEN {u} < 0.2 THEN 'val' WHEN {u} < 0.6 THEN 'test' ELSE 'holdout' END"


def split_items(s: SparkSession, d: str, by_generator: bool = False) -> DataFrame:
    key = splits.generator_key() if by_generator else F.col("grp")
    return splits.assign_splits(tables.items(s, d), {"val": 0.2, "test": 0.4, "holdout": 0.4}, "v1", key)


@query(f"SELECT id, grp, {_split('grp')} AS split FROM v_items")
def assign_splits(s, d):
    return split_items(s, d).select("id", "grp", "split")


_GEN = "CASE WHEN label='ai_generated' AND kind IS NOT NULL THEN concat('generator:', kind) ELSE grp END"


@query(f"SELECT id, {_split(_GEN)} AS split FROM v_items")
def assign_splits_by_generator(s, d):
    return split_items(s, d, True).select("id", "split")


@query(f"SELECT grp, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT split) AS n FROM (SELECT grp, {_split(_GEN)} AS split FROM v_items) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(s, d):
    return splits.split_leakage(split_items(s, d, True))


@query(f"SELECT split, label, count(*) AS items FROM (SELECT label, {_split('grp')} AS split FROM v_items) GROUP BY 1, 2")
def split_counts(s, d):
    return split_items(s, d).groupBy("split", "label").agg(F.count("*").alias("items"))


@query("SELECT sha256(text) AS sha, CAST(min(doc_id) AS BIGINT) AS id, count(*) AS copies, count(*) > 1 AS refused FROM documents GROUP BY 1")
def build_lock(s, d):
    return splits.build_lock(tables.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "sha")


_ITEM_SHA = f"SELECT i.id, sha256(d.text) AS sha, {_split('grp')} AS split FROM v_items i JOIN documents d ON i.id = CAST(d.doc_id AS VARCHAR)"


@query(f"WITH t AS ({_ITEM_SHA}), k AS (SELECT DISTINCT sha FROM t WHERE split = 'holdout') SELECT t.id, t.split, 'locked under another split' AS problem FROM t JOIN k USING (sha) WHERE t.split <> 'holdout'")
def check_lock(s, d):
    docs = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    own = split_items(s, d).join(docs, "id")
    return splits.check_lock(own, own.where("split = 'holdout'").select(F.col("sha").alias("sha")).distinct(), "sha")


@query(f"""SELECT id, grp, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, id) AS q FROM (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY u, id) AS r FROM (SELECT id, grp, label, {hb("concat('cap:', id)")} AS u FROM v_items)) WHERE r <= 3) WHERE q <= 40""")
def capped_sample(s, d):
    return splits.capped_sample(tables.items(s, d).select("id", "grp", "label"), "grp", "label", 3, 40, "cap")


def _shingles(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS h FROM (SELECT {key}, w, unnest(range(1, len(w)-3)) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 5)"


@query(f"""WITH a AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}), z AS (SELECT item_id, count(*) AS size FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*)/max(size)::DOUBLE, 6) AS coverage FROM a JOIN b USING (h) JOIN z USING (item_id) GROUP BY 1, 2""")
def contamination(s, d):
    return rounded(splits.contamination(tables.table(s, d, "documents").select("doc_id", "text"), tables.table(s, d, "benchmark").select("item_id", "text")))


# --- sequences


@query("""SELECT media_id, frames, round(proportion, 6) AS proportion, round(peak, 6) AS peak, round(mean, 6) AS mean, round(least(1.0, 0.5*proportion+0.3*peak), 6) AS severity, CASE WHEN proportion >= 0.3 THEN 'SUSPICIOUS' WHEN proportion > 0 THEN 'INCONCLUSIVE' ELSE 'NO_SIGNIFICANT_ANOMALIES_DETECTED' END AS assessment
FROM (SELECT media_id, count(*) AS frames, count(*) FILTER (combined_score >= 0.45)/count(*)::DOUBLE AS proportion, max(combined_score) AS peak, avg(combined_score) AS mean FROM v_frames GROUP BY 1)""")
def frame_aggregate(s, d):
    return rounded(sequences.frame_aggregate(tables.frames(s, d)))


@query("""SELECT media_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, round(max(combined_score), 6) AS peak_score FROM (SELECT *, sum((hot AND NOT was)::INT) OVER (PARTITION BY media_id ORDER BY frame_index) AS run FROM (SELECT *, combined_score >= 0.45 AS hot, coalesce(lag(combined_score >= 0.45) OVER (PARTITION BY media_id ORDER BY frame_index), false) AS was FROM v_frames)) WHERE hot OR was GROUP BY media_id, run""")
def suspicious_segments(s, d):
    return rounded(sequences.suspicious_segments(tables.frames(s, d)))


_CUTS = """d AS (SELECT media_id, frame_index, abs(combined_score - p) AS distance FROM (SELECT *, lag(combined_score) OVER (PARTITION BY media_id ORDER BY frame_index) AS p FROM v_frames) WHERE p IS NOT NULL), m AS (SELECT media_id, quantile_cont(distance, 0.5) AS median FROM d GROUP BY 1),
k AS (SELECT d.media_id, any_value(median) AS median, quantile_cont(abs(distance-median), 0.5) AS mad FROM d JOIN m USING (media_id) GROUP BY 1), c AS (SELECT media_id, frame_index, distance FROM d JOIN k USING (media_id) WHERE distance >= greatest(0.1, median + 1.5 * CASE WHEN mad > 0 THEN mad ELSE 0.001 END))"""


@query(f"WITH {_CUTS} SELECT media_id, frame_index, round(distance, 6) AS distance FROM c, (SELECT count(*) FROM v_frames) x")
def cut_detect(s, d):
    return rounded(sequences.cut_detect(tables.frames(s, d), 0.1, 1.5))


@query(f"""WITH {_CUTS}, t AS (SELECT media_id, max(frame_index)+1 AS total FROM v_frames GROUP BY 1), b AS (SELECT media_id, 0 AS pos FROM t UNION SELECT media_id, frame_index FROM c)
SELECT media_id, pos AS start_frame, nxt - 1 AS end_frame FROM (SELECT media_id, pos, coalesce(lead(pos) OVER (PARTITION BY media_id ORDER BY pos), total) AS nxt FROM b JOIN t USING (media_id)) WHERE nxt > pos""")
def shots(s, d):
    f = tables.frames(s, d)
    return sequences.shots(f, sequences.cut_detect(f, 0.1, 1.5))


@query("""SELECT media_id, frame_index, round(scene, 6) AS scene FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY scene DESC, frame_index) AS r FROM (SELECT media_id, frame_index, coalesce(abs(combined_score - lag(combined_score) OVER (PARTITION BY media_id ORDER BY frame_index)), 1.0) AS scene FROM v_frames) WHERE scene >= 0.3) WHERE r <= 5""")
def keyframe_select(s, d):
    return rounded(sequences.keyframe_select(tables.frames(s, d), 0.3, 5))


@query("SELECT track_id, frame_index, round(avg(confidence) OVER (PARTITION BY track_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS consistency FROM v_boxes")
def track_consistency(s, d):
    return rounded(sequences.track_consistency(tables.boxes(s, d)))


@query("""SELECT *, confidence_change > 0.4 OR jerk > 0.3 OR area_change > 0.5 AS unsteady FROM (SELECT track_id, count(*) AS n, round(avg(dc), 6) AS confidence_change, round(avg(ddx), 6) AS jerk, round(max(da), 6) AS area_change FROM (SELECT *, abs(dx - lag(dx) OVER k) AS ddx, abs(area - lag(area) OVER k)/lag(area) OVER k AS da FROM (SELECT *, abs(confidence - lag(confidence) OVER k) AS dc, x - lag(x) OVER k AS dx, w*h AS area FROM v_boxes WINDOW k AS (PARTITION BY track_id ORDER BY frame_index)) WINDOW k AS (PARTITION BY track_id ORDER BY frame_index)) GROUP BY 1 HAVING count(*) >= 5)""")
def track_anomalies(s, d):
    return rounded(sequences.track_anomalies(tables.boxes(s, d)))


@query("SELECT media_id, round(avg(d*d), 6) AS flux, round(avg(abs(d)), 6) AS change FROM (SELECT media_id, combined_score - lag(combined_score) OVER (PARTITION BY media_id ORDER BY frame_index) AS d FROM v_frames) GROUP BY 1")
def series_flux(s, d):
    return rounded(sequences.series_flux(tables.frames(s, d)))


@query("SELECT media_id, frame_index, round(abs(combined_score-m)/sd, 6) AS z FROM v_frames JOIN (SELECT media_id, avg(combined_score) AS m, stddev_pop(combined_score) AS sd FROM v_frames GROUP BY 1) USING (media_id) WHERE sd > 0 AND abs(combined_score-m)/sd > 1.5")
def zscore_discontinuities(s, d):
    return rounded(sequences.discontinuities(tables.frames(s, d), 1.5))


@query("""WITH m AS (SELECT media_id, quantile_cont(combined_score, 0.5) AS median, stddev_pop(combined_score) AS sd FROM v_frames GROUP BY 1), k AS (SELECT f.media_id, quantile_cont(abs(combined_score-median), 0.5) AS mad FROM v_frames f JOIN m USING (media_id) GROUP BY 1)
SELECT media_id, frame_index, round(CASE WHEN mad > 0 THEN (combined_score-median)/(1.4826*mad) WHEN sd > 0 THEN (combined_score-median)/sd ELSE 0 END, 6) AS z FROM v_frames JOIN m USING (media_id) JOIN k USING (media_id)""")
def robust_z(s, d):
    return rounded(sequences.robust_z(tables.frames(s, d)))


# --- records


@query("SELECT media_id, owner, case_id FROM v_media WHERE owner = 7")
def owner_filter(s, d):
    return records.owner_filter(tables.media(s, d), F.lit(7)).select("media_id", "owner", "case_id")


@query("SELECT case_id, status, count(*) AS items FROM v_media GROUP BY 1, 2")
def count_by_key(s, d):
    return tables.media(s, d).groupBy("case_id", "status").agg(F.count("*").alias("items"))


@query("SELECT c_custkey, c_name, media_id FROM v_media JOIN customer ON owner = c_custkey WHERE status = 'O'")
def owned_join(s, d):
    m = tables.media(s, d).where("status = 'O'")
    return m.join(tables.table(s, d, "customer"), F.col("owner") == F.col("c_custkey")).select("c_custkey", "c_name", "media_id")


@query("SELECT owner, media_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, media_id DESC) AS r FROM v_media WHERE owner IS NOT NULL) WHERE r = 1")
def latest_per_key(s, d):
    return records.latest_per_key(tables.media(s, d).where("owner is not null"), "owner", "created_at", "media_id").select("owner", "media_id")


@query("SELECT media_id, CASE WHEN media_id % 3 = 0 THEN 'X' ELSE status END AS status FROM v_media")
def upsert_by_key(s, d):
    m = tables.media(s, d).select("media_id", "status")
    return records.upsert(m, m.where("media_id % 3 = 0").withColumn("status", F.lit("X")), "media_id", ["status"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT media_id FROM v_media WHERE owner IS NULL)")
def cascade_delete(s, d):
    gone = tables.media(s, d).where("owner is null").select(F.col("media_id").alias("l_orderkey"))
    return tables.table(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT media_id, created_at::VARCHAR AS created_at FROM v_media ORDER BY v_media.created_at DESC, media_id DESC LIMIT 200 OFFSET 100")
def page_newest(s, d):
    return tables.media(s, d).orderBy(F.desc("created_at"), F.desc("media_id")).offset(100).limit(200).select("media_id", F.col("created_at").cast("string").alias("created_at"))


@query("SELECT event_id, count(*) OVER k AS in_window, count(*) OVER k > 3 AS over FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)")
def rolling_quota(s, d):
    return records.rolling_quota(tables.table(s, d, "events"), ["user_id"], "ts", 86_400, 3).select("event_id", "in_window", "over")


@query("""SELECT detector, runs, failures, CASE WHEN failures >= 3 THEN 'FAILING' WHEN failures > 0 THEN 'DEGRADED' ELSE 'OPERATIONAL' END AS state FROM (SELECT detector, count(*) AS runs, count(*) FILTER (execution_status='FAILED' AND NOT EXISTS (SELECT 1 FROM v_detections g WHERE g.detector = v.detector AND g.execution_status <> 'FAILED' AND (g.ts > v.ts OR (g.ts = v.ts AND g.detection_id > v.detection_id)))) AS failures FROM v_detections v GROUP BY 1)""")
def health_state(s, d):
    return records.health(tables.detections(s, d), "detector", "ts", "detection_id")


@query("""SELECT detector, len(v) AS n, round(v[least(len(v), floor(0.95*len(v))::INT + 1)], 6) AS p95 FROM (SELECT detector, list_sort(list(confidence)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY ts DESC, detection_id DESC) AS r FROM v_detections WHERE execution_status IN ('COMPLETED','INCONCLUSIVE')) WHERE r <= 50 GROUP BY 1)""")
def recent_p95(s, d):
    return rounded(records.recent_p95(tables.detections(s, d), "detector", "ts", "detection_id", "confidence"))


@query("""SELECT analysis_id, count(*) AS checks, count(*) FILTER (execution_status <> 'FAILED') AS ran, count(*) FILTER (execution_status='COMPLETED' AND flagged) AS found, count(*) FILTER (execution_status='COMPLETED' AND NOT flagged) AS nothing, count(*) FILTER (execution_status='INCONCLUSIVE') AS undecided,
coalesce(string_agg(CASE WHEN execution_status='FAILED' THEN detector END, ',' ORDER BY detector), '') AS gaps FROM v_detections GROUP BY 1""")
def check_outcomes(s, d):
    return records.coverage(tables.detections(s, d))


@query("SELECT analysis_id, checks, failed, CASE WHEN failed = 0 THEN 'COMPLETED' WHEN failed < checks THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (SELECT analysis_id, count(*) AS checks, count(*) FILTER (execution_status='FAILED') AS failed FROM v_detections GROUP BY 1)")
def run_status(s, d):
    return records.run_status(tables.detections(s, d))


# --- retrieval


@query("SELECT doc_id AS id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def exact_hash_join(s, d):
    return retrieval.exact_classes(tables.table(s, d, "documents"), "doc_id", "text")


_GATES = """SELECT page_id AS query_id, page_id % 11 = 0 AS exact, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 3 = 1 END AS phash_ok, CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 5 < 3 END AS cosine_ok, CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 7 < 4 END AS geometry_ok, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 4 = 1 END AS aligned_ok FROM pages"""


@query(f"""SELECT query_id, CASE WHEN exact OR coalesce(cosine_ok AND geometry_ok AND aligned_ok, false) THEN 'VERIFIED_MATCH' WHEN coalesce(phash_ok, true) OR coalesce(cosine_ok, true) OR coalesce(geometry_ok, true) OR coalesce(CASE WHEN geometry_ok THEN aligned_ok ELSE false END, true) THEN 'SIMILAR_UNVERIFIED' ELSE 'NO_MATCH' END AS status FROM ({_GATES})""")
def verify_gates(s, d):
    p = tables.table(s, d, "pages").selectExpr("page_id AS query_id", "page_id % 11 = 0 AS exact", "CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 3 = 1 END AS phash_ok", "CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 5 < 3 END AS cosine_ok", "CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 7 < 4 END AS geometry_ok", "CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 4 = 1 END AS aligned_ok")
    return retrieval.verify_gates(p).select("query_id", "status")


# --- fusion

#: (detector, branch, family, a, b, prior, positives, negatives, spread); face_a has no calibration.
CALIBRATIONS = [("learned_a", "manipulation", "learned", 2.5, -0.2, 0.3, 60, 400, 0.3), ("geometric_a", "manipulation", "geometric", 1.5, 0.1, 0.3, 50, 300, 0.4), ("compression_a", "manipulation", "compression", 1.1, 0.0, 0.4, 20, 20, 0.2), ("gen_b", "ai_generation", "ai_generation", 3.0, -0.5, 0.2, 500, 900, 0.25)]
BRANCH = "CASE WHEN detector IN ('gen_a', 'gen_b') THEN 'ai_generation' ELSE 'manipulation' END"
_LR = """log10(greatest(1e-12, least(1-1e-12, p))/(1-greatest(1e-12, least(1-1e-12, p)))) - log10(prior/(1-prior))"""
_FOUND = f"""c(detector, family, a, b, prior, positives, negatives, spread) AS (VALUES {", ".join(f"('{x[0]}','{x[2]}',{x[3]}::DOUBLE,{x[4]}::DOUBLE,{x[5]}::DOUBLE,{x[6]},{x[7]},{x[8]}::DOUBLE)" for x in CALIBRATIONS)}),
r AS (SELECT *, {BRANCH} AS branch, 0.5*(1+tanh(0.5*(a*ln(greatest(1e-6, least(1-1e-6, confidence))/(1-greatest(1e-6, least(1-1e-6, confidence)))) + b))) AS p FROM v_detections LEFT JOIN c USING (detector) WHERE execution_status='COMPLETED'),
l AS (SELECT *, {_LR} AS raw FROM r), e AS (SELECT *, raw - spread AS rlow, raw + spread AS rhigh FROM l),
f AS (SELECT analysis_id, detection_id, detector, branch, family, flagged, {", ".join(f"CASE WHEN {x} IS NULL THEN NULL ELSE sign({x})*least(abs({x}), log10(CASE WHEN {x} > 0 THEN negatives ELSE positives END + 1)) END AS {y}" for x, y in (("raw", "value"), ("rlow", "low"), ("rhigh", "high")))} FROM e),
g AS (SELECT *, CASE WHEN value IS NOT NULL AND value <> 0 THEN sign(value) WHEN flagged THEN 1 ELSE -1 END AS direction FROM f)"""


def found(s: SparkSession, d: str) -> DataFrame:
    known = s.createDataFrame([(x[0], x[2], *x[3:]) for x in CALIBRATIONS], "detector string, family string, a double, b double, prior double, positives int, negatives int, spread double")
    return fusion.contributions(tables.detections(s, d).withColumn("branch", F.expr(BRANCH)), known)


@query(f"WITH {_FOUND} SELECT detection_id, {_r('value', 'low', 'high')}, round(direction::DOUBLE, 6) AS direction FROM g")
def log10_lr(s, d):
    return rounded(found(s, d).select("detection_id", "value", "low", "high", "direction"))


def _ce(low: str, high: str) -> str:
    return f"CASE WHEN {low} <= 0 AND {high} >= 0 THEN 0.0 WHEN {low} > 0 THEN {low} ELSE {high} END"


@query(f"""WITH {_FOUND}, best AS (SELECT *, {_ce("low", "high")} AS cautious FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, branch, family ORDER BY abs(value) DESC, detection_id) AS rn FROM g WHERE value IS NOT NULL) WHERE rn = 1),
sums AS (SELECT analysis_id, branch, count(*) AS families, sum(value) AS independent, (list(value ORDER BY abs(value) DESC, detection_id))[1] AS dependent, sum(cautious) AS c_sum, (list(cautious ORDER BY abs(cautious) DESC, detection_id))[1] AS c_max FROM best GROUP BY 1,2),
k AS (SELECT analysis_id, branch, count(*) FILTER (direction > 0) * count(*) FILTER (direction < 0) AS conflicts FROM g WHERE value IS NULL OR abs(value) >= 0.3 GROUP BY 1,2),
o AS (SELECT *, CASE WHEN families > 0 THEN {_ce("least(c_sum, c_max)", "greatest(c_sum, c_max)")} END AS cautious, coalesce(conflicts, 0) AS n FROM (SELECT DISTINCT analysis_id, branch FROM g) LEFT JOIN sums USING (analysis_id, branch) LEFT JOIN k USING (analysis_id, branch))
SELECT analysis_id, branch, families, {_r("independent", "dependent", "cautious")}, n AS conflicts, CASE WHEN families IS NULL THEN 'NOT_ASSESSED' WHEN n > 0 AND abs(cautious) < 1 THEN 'CONFLICTING' WHEN abs(cautious) < 1 THEN 'LIMITED' WHEN cautious > 0 THEN 'SUPPORTS' ELSE 'AGAINST' END AS status,
CASE WHEN families > 0 THEN CASE WHEN abs(cautious) >= 4 THEN 'very strong' WHEN abs(cautious) >= 3 THEN 'strong' WHEN abs(cautious) >= 2 THEN 'moderately strong' WHEN abs(cautious) >= 1 THEN 'moderate' ELSE 'limited' END END AS strength FROM o""")
def fuse_evidence(s, d):
    return rounded(fusion.fuse_evidence(found(s, d)))


@query(f"WITH {_FOUND} SELECT a.analysis_id, a.branch, a.detector AS points_for, b.detector AS points_against FROM g a JOIN g b ON a.analysis_id = b.analysis_id AND a.branch = b.branch AND a.direction > 0 AND b.direction < 0")
def conflict_pairs(s, d):
    return fusion.conflict_pairs(found(s, d))


# --- grounding

