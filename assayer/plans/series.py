"""Queries on frames, tracks, maps and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import sequences
from assayer.plans.evidence import _CUTS, query, rounded
from assayer.plans.oracle import hb
from assayer.sources import tables

_FEATURES = "SELECT media_id, frame_index, [combined_score * 255, combined_score * 100, frame_index % 7 * 10.0::DOUBLE] AS f FROM v_frames"


@query(f"""SELECT media_id, frame_index, round(coalesce((abs(f[1] - p[1]) + abs(f[2] - p[2]) + abs(f[3] - p[3])) / 3 / 255, 1.0), 6) AS scene FROM (SELECT *, lag(f) OVER (PARTITION BY media_id ORDER BY frame_index) AS p FROM ({_FEATURES}))""")
def scene_score(s, d):
    f = tables.frames(s, d).withColumn("feature", F.array(F.col("combined_score") * 255, F.col("combined_score") * 100, (F.col("frame_index") % 7 * 10).cast("double")))
    return rounded(sequences.scene_scores(f))


@query(f"""WITH {_CUTS}, t AS (SELECT media_id, max(frame_index) + 1 AS total FROM v_frames GROUP BY 1), b AS (SELECT media_id, 0 AS pos FROM t UNION SELECT media_id, frame_index FROM c),
s AS (SELECT media_id, pos AS a, nxt - 1 AS z FROM (SELECT media_id, pos, coalesce(lead(pos) OVER (PARTITION BY media_id ORDER BY pos), total) AS nxt FROM b JOIN t USING (media_id)) WHERE nxt > pos),
x AS (SELECT media_id, (a + z) // 2 AS f, 0 AS r, 'shot_midpoint' AS why FROM s UNION ALL SELECT media_id, frame_index - 1, 1, 'before_cut' FROM c UNION ALL SELECT media_id, frame_index, 2, 'after_cut' FROM c),
h AS (SELECT media_id, f, min_by(why, r) AS why FROM x GROUP BY 1, 2), few AS (SELECT media_id FROM h GROUP BY 1 HAVING count(*) < 3),
y AS (SELECT * FROM h UNION ALL SELECT * FROM (SELECT DISTINCT media_id, CAST(floor(q.q * (total - 1)) AS BIGINT) AS f, 'uniform' AS why FROM few JOIN t USING (media_id), (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) q(q)) u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = u.media_id AND h.f = u.f)),
ky AS (SELECT *, why IN ('before_cut', 'after_cut') AS cut, count(*) OVER (PARTITION BY media_id) AS n, count(*) FILTER (why IN ('before_cut', 'after_cut')) OVER (PARTITION BY media_id) AS cuts FROM y), gy AS (SELECT *, row_number() OVER (PARTITION BY media_id, cut ORDER BY f) - 1 AS place, count(*) OVER (PARTITION BY media_id, cut) AS kind, least(greatest(0, 24 - cuts), count(*) OVER (PARTITION BY media_id, cut)) AS room FROM ky)
SELECT media_id, f AS frame_index, why FROM gy WHERE n <= 24 OR (cut AND place < 24) OR (NOT cut AND room > 0 AND list_contains([round_even(i * ((kind - 1) / greatest(1, room - 1)::DOUBLE), 0) FOR i IN range(0, room)], place))""")
def shot_keyframes(s, d):
    f = tables.frames(s, d)
    cuts = sequences.cut_detect(f, 0.1, 1.5)
    return sequences.shot_keyframes(f, sequences.shots(f, cuts), cuts)


@query(f"""WITH b AS (SELECT track_id, frame_index, confidence, lead(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) AS nxt FROM v_boxes WHERE {hb("concat('seen:', track_id, ':', frame_index)")} < 0.4), g AS (SELECT *, unnest(range(0, coalesce(nxt - frame_index, 1))) AS gap FROM b)
SELECT track_id, frame_index + gap AS frame_index, round(CASE WHEN gap <= 2 THEN confidence * pow(0.85, gap) END, 6) AS confidence, CASE WHEN gap = 0 THEN 'seen' WHEN gap <= 2 THEN 'fading' ELSE 'inactive' END AS state FROM g""")
def confidence_decay(s, d):
    from assayer.functions.stats import hash_bucket

    seen = tables.boxes(s, d).where(hash_bucket(F.concat_ws("", F.lit("seen:"), "track_id", F.lit(":"), "frame_index")) < 0.4).select("track_id", "frame_index", "confidence")
    return rounded(sequences.confidence_decay(seen, lost=2))


_REGIONS = "SELECT l_suppkey % 20 AS media_id, l_orderkey % 50 AS frame_index, round(((l_orderkey % 50) * 37 % 100) / 100.0, 2) AS frame_score, l_orderkey * 10 + l_linenumber AS region_id FROM lineitem"
_TRACKS = "SELECT track_id % 20 AS media_id, track_id, round(max(confidence), 6) AS confidence FROM v_boxes GROUP BY 1, 2"


@query(f"""SELECT media_id, 'frame' AS kind, (f - 1) * 2 + r AS place, region_id AS id FROM (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY frame_score DESC, frame_index) AS f, row_number() OVER (PARTITION BY media_id, frame_index ORDER BY region_id) AS r FROM ({_REGIONS})) WHERE f <= 5 AND r <= 2
UNION ALL SELECT media_id, 'track', p, track_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, track_id) AS p FROM ({_TRACKS})) WHERE p <= 5""")
def top_regions(s, d):
    regions = tables.table(s, d, "lineitem").selectExpr("l_suppkey % 20 AS media_id", "l_orderkey % 50 AS frame_index", "round(((l_orderkey % 50) * 37 % 100) / 100.0, 2) AS frame_score", "l_orderkey * 10 + l_linenumber AS region_id")
    tracks = tables.boxes(s, d).groupBy((F.col("track_id") % 20).alias("media_id"), "track_id").agg(F.round(F.max("confidence"), 6).alias("confidence"))
    return sequences.top_regions(regions, tracks)


@query("""WITH c AS (SELECT vec_id, s AS start, unnest(range(0, 24)) AS i, s FROM embeddings, (VALUES (0), (20), (40)) t(s)), w AS (SELECT c.vec_id, start + i AS "at", (e.embedding[start + i + 1])::DOUBLE + start AS v, least(CASE WHEN start > 0 AND i < 4 THEN (i + 1) / 5.0 ELSE 1.0 END, CASE WHEN start + 24 < 64 AND 24 - i <= 4 THEN (24 - i) / 5.0 ELSE 1.0 END)::DOUBLE AS w FROM c JOIN embeddings e ON c.vec_id = e.vec_id)
SELECT vec_id, "at", round(sum(w * v) / sum(w), 6) AS value FROM w GROUP BY 1, 2""")
def blend_chunks(s, d):
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.zip_with(F.slice("embedding", a + 1, 24), F.array_repeat(F.lit(a), 24), lambda x, b: x.cast("double") + b).alias("values")) for a in (0, 20, 40)])).alias("x")
    chunks = tables.table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("length"), each).select("vec_id", "length", "x.start", "x.values")
    return rounded(sequences.blend_chunks(chunks, "vec_id", 4))


def region_match(s, d):
    """Tracks and regions of each frame, matched one to one by overlap."""
    b = tables.boxes(s, d).where("frame_index < 40").withColumn("frame", F.col("frame_index"))
    near = [F.col("x") / 5, F.col("y") / 5, F.col("w") * 2, F.col("h") * 2]
    side = lambda name, odd: b.where(F.col("track_id") % 2 == odd).select("frame", F.col("track_id").alias(name), *[c.alias(n) for c, n in zip(near, "xywh", strict=True)])
    return rounded(sequences.region_match(side("track_id", 0), side("region_id", 1)))


def mask_region_summary(s, d):
    """The masked share of each map, and its connected areas."""
    return rounded(sequences.mask_summary(tables.pixels(s, d), "vec_id", 0.0, 0.04))


from assayer.plans.evidence import QUERIES  # noqa: E402

QUERIES |= {"region_match": region_match, "mask_region_summary": mask_region_summary}
