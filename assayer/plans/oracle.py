"""DuckDB text of the derived tables, as common table expressions."""

from __future__ import annotations


def hb(key: str) -> str:
    return f"(('0x' || substr(sha256({key}),1,16))::UBIGINT / 18446744073709551616.0::DOUBLE)"


VIEWS = {
    "v_items": """SELECT CAST(d.doc_id AS VARCHAR) AS id,
  CASE WHEN l.quality = 0 THEN 'manipulated' WHEN l.toxic = 1 THEN 'ai_generated' ELSE 'real' END AS label,
  concat(d.source, ':', d.lang) AS grp,
  CASE WHEN l.quality = 0 THEN CASE d.doc_id % 4 WHEN 0 THEN 'splice' WHEN 1 THEN 'copy-move' WHEN 2 THEN 'removal' ELSE 'inpainting (GLIDE)' END
       WHEN l.toxic = 1 THEN concat('gen', CAST(d.doc_id % 5 AS VARCHAR)) END AS kind,
  CASE d.doc_id % 6 WHEN 0 THEN 'original' WHEN 1 THEN 'jpeg_q70' WHEN 2 THEN 'resize_50' WHEN 3 THEN 'crop_80' WHEN 4 THEN 'webp_q75' ELSE 'social' END AS tag,
  d.n_chars AS short_side FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_scores": f"""SELECT i.id, i.label, i.grp, i.kind, i.tag, x.detector, x.branch, x.family,
  {hb("concat('score:', i.id, ':', x.detector)")} * 0.6::DOUBLE + CASE WHEN (x.branch = 'manipulation' AND i.label = 'manipulated') OR (x.branch = 'ai_generation' AND i.label = 'ai_generated') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS raw_score,
  CASE WHEN {hb("concat('st:', i.id, ':', x.detector)")} < 0.05 THEN 'FAILED' WHEN {hb("concat('st:', i.id, ':', x.detector)")} < 0.12 THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS execution_status,
  10 + 990 * {hb("concat('ms:', i.id, ':', x.detector)")} AS duration_ms
  FROM v_items i CROSS JOIN (VALUES ('learned_a','manipulation','learned'), ('geometric_a','manipulation','geometric'), ('gen_a','ai_generation','ai_generation'), ('gen_b','ai_generation','ai_generation')) x(detector, branch, family)""",
    "v_rows": """SELECT *, CASE WHEN execution_status = 'FAILED' THEN 'MISSING' WHEN execution_status = 'INCONCLUSIVE' THEN 'ABSTAINED' WHEN raw_score >= 0.5 THEN 'FLAGGED' ELSE 'CLEARED' END AS verdict,
  CASE WHEN execution_status <> 'FAILED' THEN raw_score END AS score
  FROM (SELECT *, CASE WHEN branch = 'manipulation' THEN CASE label WHEN 'manipulated' THEN true WHEN 'real' THEN false END
    ELSE CASE WHEN label = 'ai_generated' THEN true WHEN label = 'real' THEN false WHEN label = 'manipulated' AND NOT (kind LIKE '%inpaint%' AND kind NOT LIKE '%opencv%') THEN false END END AS target FROM v_scores) WHERE target IS NOT NULL""",
    "v_detections": """SELECT CAST(floor(event_id / 6) AS BIGINT) AS analysis_id, event_id AS detection_id,
  CASE event_id % 6 WHEN 0 THEN 'learned_a' WHEN 1 THEN 'geometric_a' WHEN 2 THEN 'face_a' WHEN 3 THEN 'compression_a' WHEN 4 THEN 'gen_a' ELSE 'gen_b' END AS detector,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS execution_status,
  least(value / 150.0, 1.0) AS confidence, event_type NOT IN ('error', 'view') AND value >= 75.0 AS flagged, event_type = 'purchase' AS localised, ts FROM events""",
    "v_frames": "SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, least(value / 100.0, 1.0) AS combined_score FROM events",
    "v_boxes": f"""SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS frame_index,
  l_quantity::DOUBLE AS x, l_quantity::DOUBLE * l_tax::DOUBLE * 10 AS y, 10.0::DOUBLE + l_tax::DOUBLE * 100 AS w, 10.0::DOUBLE + l_discount::DOUBLE * 100 AS h,
  {hb("concat('c:', CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR))")} AS confidence FROM lineitem""",
    "v_media": "SELECT o_orderkey AS media_id, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS owner, o_orderpriority AS case_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders",
    "v_sources": """SELECT page_id AS source_id, CAST(floor(page_id / 10) AS BIGINT) AS analysis_id, url, CASE page_id % 3 WHEN 0 THEN 'corpus' WHEN 1 THEN 'url_check' ELSE 'archive' END AS provider,
  CASE page_id % 4 WHEN 0 THEN 'VERIFIED_MATCH' WHEN 3 THEN 'NO_MATCH' ELSE 'SIMILAR_UNVERIFIED' END AS status, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 1704067200 + page_id * 3600 END AS stamp FROM pages""",
    "v_pixels": "SELECT vec_id, CAST(floor(i / 8) AS BIGINT) AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)",
    "v_claims": f"""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS true_qty, concat('Order ', CAST(l_orderkey AS VARCHAR), ' shipped ',
  CAST(CAST(l_quantity AS INT) + CASE WHEN {hb("concat('w:', CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR))")} < 0.25 THEN 1000 ELSE 0 END AS VARCHAR), ' units [T1].') AS claim FROM lineitem""",
}
NEEDS = {"v_scores": ["v_items"], "v_rows": ["v_items", "v_scores"]}


def with_views(sql: str) -> str:
    """The query under the derived tables that it names."""
    used = [v for v in VIEWS if v in sql]
    names = [v for v in VIEWS if v in used or any(v in NEEDS.get(u, []) for u in used)]
    if not names:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.lstrip()[15:]}"
    return f"WITH {ctes}, {sql[5:].lstrip()}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes} {sql}"
