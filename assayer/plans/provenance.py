"""Queries on sources, candidates, masks, sets and status records."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import provenance, retrieval
from assayer.plans.evidence import query, rounded, rows_of
from assayer.plans.oracle import hb
from assayer.sources import tables


@query("SELECT s.source_id, s.analysis_id, coalesce(s.source_id = f.first, false) AS earliest FROM v_sources s LEFT JOIN (SELECT analysis_id, (list(source_id ORDER BY stamp, source_id))[1] AS first FROM v_sources WHERE status = 'VERIFIED_MATCH' AND stamp IS NOT NULL GROUP BY 1) f USING (analysis_id)")
def earliest_known(s, d):
    return provenance.earliest_known(tables.sources(s, d)).select("source_id", "analysis_id", "earliest")


@query("SELECT analysis_id, source_id, CASE provider WHEN 'archive' THEN 'ARCHIVED' WHEN 'url_check' THEN 'RETRIEVED' ELSE 'PUBLISHED' END AS event, row_number() OVER (PARTITION BY analysis_id ORDER BY stamp ASC NULLS LAST, source_id) AS position FROM v_sources WHERE status <> 'NO_MATCH'")
def timeline(s, d):
    return provenance.timeline(tables.sources(s, d)).select("analysis_id", "source_id", "event", "position")


@query("SELECT analysis_id, provider, coalesce(hits, 0) AS hits, coalesce(verified, 0) AS verified, CASE WHEN hits IS NULL THEN 'NOT_SEARCHED' WHEN verified > 0 THEN 'VERIFIED' ELSE 'LEADS_ONLY' END AS outcome FROM (SELECT DISTINCT analysis_id FROM v_sources) CROSS JOIN (SELECT unnest(['corpus','url_check','archive','reverse_image']) AS provider) LEFT JOIN (SELECT analysis_id, provider, count(*) AS hits, count(*) FILTER (status='VERIFIED_MATCH') AS verified FROM v_sources GROUP BY 1,2) USING (analysis_id, provider)")
def source_outcomes(s, d):
    return provenance.source_outcomes(tables.sources(s, d), ["corpus", "url_check", "archive", "reverse_image"])


@query("SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, min(stamp) AS first_stamp, max(stamp) AS last_stamp, count(*) AS captures FROM v_sources GROUP BY 1")
def captures_first_last(s, d):
    return tables.sources(s, d).groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).agg(F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), F.count("*").alias("captures"))


@query("SELECT min(page_id) AS page_id, split_part(url, '?', 1) AS address FROM pages GROUP BY 2")
def ordered_distinct(s, d):
    p = tables.table(s, d, "pages").select("page_id", F.substring_index("url", "?", 1).alias("address"))
    return provenance.first_occurrence(p, "address", "page_id")


@query("SELECT id, tag, label FROM v_items WHERE grp IN (SELECT grp FROM v_items GROUP BY 1 HAVING count(DISTINCT label) = 1)")
def drop_ambiguous(s, d):
    return provenance.unambiguous(tables.items(s, d), "grp", "label").select("id", "tag", "label")


@query("SELECT DISTINCT c_custkey AS owner FROM customer WHERE c_custkey NOT IN (SELECT owner FROM v_media WHERE owner IS NOT NULL)")
def set_difference(s, d):
    return tables.table(s, d, "customer").select(F.col("c_custkey").alias("owner")).distinct().exceptAll(tables.media(s, d).where("owner is not null").select("owner").distinct())


@query("SELECT o_orderkey AS media_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_filter(s, d):
    few = tables.table(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return tables.table(s, d, "orders").join(few, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("media_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'absent' WHEN doc_id % 10 = 2 THEN 'indexed' WHEN doc_id % 10 = 3 THEN 'refreshed' ELSE 'unchanged' END AS outcome FROM documents")
def incremental_index(s, d):
    docs = tables.table(s, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return provenance.incremental_index(docs.where("doc_id % 10 <> 2"), docs.where("doc_id % 10 <> 1").withColumn("sha1", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("sha1"))), "doc_id", "sha1")


@query("SELECT doc_id AS id, algorithm FROM documents CROSS JOIN (VALUES ('sha256', 1), ('simhash', 2)) w(algorithm, version) WHERE NOT (algorithm = 'sha256' OR (algorithm = 'simhash' AND doc_id % 3 = 0))")
def missing_fingerprints(s, d):
    items = tables.table(s, d, "documents").select(F.col("doc_id").alias("id"))
    wanted = s.createDataFrame([("sha256", 1), ("simhash", 2)], "algorithm string, version int")
    known = items.select("id", F.lit("sha256").alias("algorithm"), F.lit(1).alias("version")).unionByName(items.select("id", F.lit("simhash").alias("algorithm"), F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("version")))
    return provenance.missing_fingerprints(items, known, wanted).select("id", "algorithm")


@query(f"SELECT id, detector, round(CASE WHEN {hb('id')} < 0.5 THEN raw_score + 1 ELSE raw_score END, 6) AS raw_score, CASE WHEN {hb('id')} < 0.5 THEN 2 ELSE 1 END AS run_no FROM v_scores")
def merge_runs(s, d):
    from assayer.functions.stats import hash_bucket

    one = tables.scores(s, d).select("id", "detector", "raw_score", F.lit(1).alias("run_no"))
    two = one.where(hash_bucket("id") < 0.5).withColumn("raw_score", F.col("raw_score") + 1).withColumn("run_no", F.lit(2))
    return rounded(provenance.merge_runs(one.unionByName(two)))


@query("""SELECT doc_id, start, least(start + 400, n_chars) AS stop FROM (SELECT doc_id, n_chars, unnest(list_distinct(list_concat(range(0, greatest(0, n_chars - 400) + 1, 300), [greatest(0, n_chars - 400)]))) AS start FROM documents)""")
def overlap_chunks(s, d):
    return provenance.overlap_chunks(tables.table(s, d, "documents"), "doc_id", "n_chars", 400, 100)


_MASK = "SELECT vec_id, value > 0 AS p, y < 4 AS t FROM v_pixels"


@query(f"SELECT vec_id, round(CASE WHEN either = 0 THEN 1.0 ELSE both_n / either::DOUBLE END, 6) AS iou, round(CASE WHEN np + nt = 0 THEN 1.0 ELSE 2 * both_n / (np + nt)::DOUBLE END, 6) AS f1 FROM (SELECT vec_id, count(*) FILTER (p AND t) AS both_n, count(*) FILTER (p OR t) AS either, count(*) FILTER (p) AS np, count(*) FILTER (t) AS nt FROM ({_MASK}) GROUP BY 1)")
def mask_iou_f1(s, d):
    m = tables.pixels(s, d).select("vec_id", (F.col("value") > 0).alias("p"), (F.col("y") < 4).alias("t"))
    return rounded(provenance.mask_scores(m, "vec_id"))


@query("""WITH t AS (SELECT vec_id, CAST(floor(y / 2) AS BIGINT) AS ty, CAST(floor(x / 2) AS BIGINT) AS tx, avg(value) AS mean FROM v_pixels GROUP BY 1,2,3), k AS (SELECT vec_id, avg(mean) AS m, stddev_pop(mean) AS sd FROM t GROUP BY 1)
SELECT vec_id, ty, tx, round(mean, 6) AS mean FROM t JOIN k USING (vec_id) WHERE mean > m + 1.5 * sd""")
def patch_outliers(s, d):
    return rounded(provenance.patch_outliers(tables.pixels(s, d), "vec_id", 2, 1.5))


@query("""WITH e AS (SELECT embedding AS v, vec_id, label % 2 AS version FROM embeddings), p AS (SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(q.v::DOUBLE[], i.v::DOUBLE[]) / (sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])) * sqrt(list_dot_product(i.v::DOUBLE[], i.v::DOUBLE[]))), 6) AS cosine FROM e q JOIN e i USING (version) WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM p) WHERE rank <= 5""")
def cosine_topk_join(s, d):
    e = tables.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("version"))
    return rounded(retrieval.cosine_candidates(e.where("id % 50 = 0"), e, 5))


@query("""WITH x AS (SELECT page_id AS query_id, page_id + 1 AS id, page_id % 5 = 0 AS exact, CASE WHEN page_id % 2 = 0 THEN page_id % 20 END AS distance, CASE WHEN page_id % 3 = 0 THEN 0.5::DOUBLE + (page_id % 7) / 20.0::DOUBLE END AS cosine FROM pages)
SELECT query_id, id, exact, distance, round(cosine, 6) AS cosine, array_to_string(list_filter([CASE WHEN exact THEN 'exact' END, CASE WHEN distance IS NOT NULL THEN 'hamming' END, CASE WHEN cosine IS NOT NULL THEN 'cosine' END], lambda z: z IS NOT NULL), ',') AS channels FROM x WHERE exact OR distance IS NOT NULL OR cosine IS NOT NULL""")
def candidate_union(s, d):
    p = tables.table(s, d, "pages").selectExpr("page_id AS query_id", "page_id + 1 AS id", "page_id % 5 = 0 AS exact", "CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 20 END AS INT) AS distance", "CASE WHEN page_id % 3 = 0 THEN 0.5D + (page_id % 7) / 20.0D END AS cosine")
    return rounded(provenance.candidate_union(p.where("exact").select("query_id", "id"), p.where("distance is not null").select("query_id", "id", "distance"), p.where("cosine is not null").select("query_id", "id", "cosine")))


@query("""SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, coalesce(cosine, -2) DESC, coalesce(distance, 65), id) AS rank FROM (SELECT page_id % 25 AS query_id, page_id AS id, page_id % 11 = 0 AS exact, CASE WHEN page_id % 3 = 0 THEN (page_id % 13) / 13.0::DOUBLE END AS cosine, CASE WHEN page_id % 2 = 0 THEN page_id % 17 END AS distance FROM pages)) WHERE rank <= 5""")
def rank_candidates(s, d):
    p = tables.table(s, d, "pages").selectExpr("page_id % 25 AS query_id", "page_id AS id", "page_id % 11 = 0 AS exact", "CASE WHEN page_id % 3 = 0 THEN (page_id % 13) / 13.0D END AS cosine", "CASE WHEN page_id % 2 = 0 THEN page_id % 17 END AS distance")
    return retrieval.rank_candidates(p, 5).select("query_id", "id", "rank")


@query("SELECT id, min(CASE WHEN execution_status <> 'FAILED' THEN CASE detector WHEN 'learned_a' THEN '1learned_a' WHEN 'gen_b' THEN '2gen_b' WHEN 'geometric_a' THEN '3geometric_a' END END)[2:] AS picked FROM v_scores GROUP BY 1")
def score_detector_pick(s, d):
    order = ["learned_a", "gen_b", "geometric_a"]
    ran = lambda x: F.bool_or((F.col("detector") == x) & (F.col("execution_status") != "FAILED"))
    n = tables.scores(s, d).groupBy("id").agg(*[ran(x).alias(x) for x in order])
    return n.select("id", F.coalesce(*[F.when(F.col(x), x) for x in order]).alias("picked"))


@query("SELECT id, detector, CASE WHEN execution_status = 'COMPLETED' AND raw_score BETWEEN 0 AND 0.9 THEN 'COMPLETED' WHEN execution_status = 'COMPLETED' THEN 'FAILED' ELSE execution_status END AS outcome FROM v_scores")
def validate_score(s, d):
    ok = F.col("raw_score").isNotNull() & ~F.isnan("raw_score") & F.col("raw_score").between(0, 0.9)
    return tables.scores(s, d).select("id", "detector", F.when((F.col("execution_status") == "COMPLETED") & ~ok, "FAILED").otherwise(F.col("execution_status")).alias("outcome"))


@query("SELECT media_id, count(*) AS frames, count(*) FILTER (combined_score >= 0.45) AS flagged, CASE WHEN count(*) = 0 THEN 'FAILED' WHEN count(*) FILTER (combined_score >= 0.45) >= 2 AND count(*) FILTER (combined_score >= 0.45) >= 0.2 * count(*) THEN 'FLAGGED' ELSE 'INCONCLUSIVE' END AS outcome FROM v_frames GROUP BY 1")
def keyframe_rule(s, d):
    hot = F.count_if(F.col("combined_score") >= 0.45)
    n = tables.frames(s, d).groupBy("media_id").agg(F.count("*").alias("frames"), hot.alias("flagged"))
    return n.withColumn("outcome", F.when(F.col("frames") == 0, "FAILED").when((F.col("flagged") >= 2) & (F.col("flagged") >= 0.2 * F.col("frames")), "FLAGGED").otherwise("INCONCLUSIVE"))


@query("SELECT media_id, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM v_frames) WHERE frame_index % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0")
def sample_step(s, d):
    f = tables.frames(s, d)
    n = f.groupBy("media_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 20.0)).alias("step"))
    return f.join(n, "media_id").where("frame_index % step = 0").select("media_id", "frame_index")


@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2")
def token_usage(s, d):
    return tables.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


@query("SELECT branch, detector, verdict, count(*) AS n FROM v_rows GROUP BY GROUPING SETS ((branch, detector, verdict), (branch, verdict), (verdict))")
def verdict_counts(s, d):
    rows = rows_of(s, d)
    key = [F.col(c) for c in ("branch", "detector", "verdict")]
    return rows.groupingSets([key, [key[0], key[2]], [key[2]]], *key).agg(F.count("*").alias("n"))


@query("SELECT media_id, start_frame, end_frame, round(peak_score, 6) AS peak_score FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY peak_score DESC, start_frame) AS r FROM (SELECT media_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, max(combined_score) AS peak_score FROM (SELECT *, sum((hot AND NOT was)::INT) OVER (PARTITION BY media_id ORDER BY frame_index) AS run FROM (SELECT *, combined_score >= 0.45 AS hot, coalesce(lag(combined_score >= 0.45) OVER (PARTITION BY media_id ORDER BY frame_index), false) AS was FROM v_frames)) WHERE hot OR was GROUP BY media_id, run)) WHERE r <= 5")
def slice_lists(s, d):
    from assayer.operators.sequences import suspicious_segments

    from pyspark.sql import Window as W

    w = W.partitionBy("media_id").orderBy(F.desc("peak_score"), "start_frame")
    return rounded(suspicious_segments(tables.frames(s, d)).withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r"))
