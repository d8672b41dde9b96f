"""The evidence tables that the queries run on, derived from the given star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import hash_bucket

#: (detector, branch, family)
DETECTORS = [("learned_a", "manipulation", "learned"), ("geometric_a", "manipulation", "geometric"), ("gen_a", "ai_generation", "ai_generation"), ("gen_b", "ai_generation", "ai_generation")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f: F.col(f).cast("timestamp") for f, t in df.dtypes if t == "timestamp_ntz"})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation item for each labelled document."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.expr("CASE WHEN quality = 0 THEN 'manipulated' WHEN toxic = 1 THEN 'ai_generated' ELSE 'real' END").alias("label"),
        F.concat("source", F.lit(":"), "lang").alias("grp"),
        F.expr("CASE WHEN quality = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'splice' WHEN 1 THEN 'copy-move' WHEN 2 THEN 'removal' ELSE 'inpainting (GLIDE)' END WHEN toxic = 1 THEN concat('gen', CAST(doc_id % 5 AS STRING)) END").alias("kind"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'original' WHEN 1 THEN 'jpeg_q70' WHEN 2 THEN 'resize_50' WHEN 3 THEN 'crop_80' WHEN 4 THEN 'webp_q75' ELSE 'social' END").alias("tag"),
        F.col("n_chars").alias("short_side"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction for each item and detector."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(b).alias("branch"), F.lit(f).alias("family")) for d, b, f in DETECTORS])).alias("x")
    rows = items(spark, sf_dir).select("id", "label", "grp", "kind", "tag", each).select("id", "label", "grp", "kind", "tag", "x.*")
    key = lambda p: hash_bucket(F.concat(F.lit(p), "id", F.lit(":"), "detector"))
    hit = ((F.col("branch") == "manipulation") & (F.col("label") == "manipulated")) | ((F.col("branch") == "ai_generation") & (F.col("label") == "ai_generated"))
    return rows.withColumn("raw_score", key("score:") * 0.6 + F.when(hit, 0.35).otherwise(0.0)).withColumn("execution_status", F.when(key("st:") < 0.05, "FAILED").when(key("st:") < 0.12, "INCONCLUSIVE").otherwise("COMPLETED")).withColumn("duration_ms", 10 + 990 * key("ms:"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six detections for each analysis."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(floor(event_id / 6) AS BIGINT) AS analysis_id", "event_id AS detection_id",
        "CASE event_id % 6 WHEN 0 THEN 'learned_a' WHEN 1 THEN 'geometric_a' WHEN 2 THEN 'face_a' WHEN 3 THEN 'compression_a' WHEN 4 THEN 'gen_a' ELSE 'gen_b' END AS detector",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS execution_status",
        "least(value / 150.0D, 1.0D) AS confidence", "event_type NOT IN ('error', 'view') AND value >= 75.0D AS flagged", "event_type = 'purchase' AS localised", "ts",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score series for each user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"), F.expr("least(value / 100.0D, 1.0D)").alias("combined_score"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of boxes for each supplier."""
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track_id"), (F.row_number().over(w) - 1).cast("bigint").alias("frame_index"),
        F.expr("CAST(l_quantity AS DOUBLE)").alias("x"), F.expr("CAST(l_quantity AS DOUBLE) * CAST(l_tax AS DOUBLE) * 10").alias("y"),
        F.expr("10.0D + CAST(l_tax AS DOUBLE) * 100").alias("w"), F.expr("10.0D + CAST(l_discount AS DOUBLE) * 100").alias("h"),
        hash_bucket(F.expr("concat('c:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING))")).alias("confidence"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned rows; every 50th customer key has no owner."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS media_id", "CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS owner", "o_orderpriority AS case_id", "o_orderstatus AS status", "o_orderdate AS created_at")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a number, one in four of them wrong."""
    wrong = hash_bucket(F.expr("concat('w:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING))")) < 0.25
    quantity = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quantity.alias("true_qty"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" shipped "), (quantity + F.when(wrong, 1000).otherwise(0)).cast("string"), F.lit(" units [T1].")).alias("claim"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of source searches; a seventh of them undated (stamp: seconds since 1970)."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS source_id", "CAST(floor(page_id / 10) AS BIGINT) AS analysis_id", "url", "CASE page_id % 3 WHEN 0 THEN 'corpus' WHEN 1 THEN 'url_check' ELSE 'archive' END AS provider",
        "CASE page_id % 4 WHEN 0 THEN 'VERIFIED_MATCH' WHEN 3 THEN 'NO_MATCH' ELSE 'SIMILAR_UNVERIFIED' END AS status", "CASE WHEN page_id % 7 = 0 THEN NULL ELSE 1704067200 + page_id * 3600 END AS stamp",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a map of 8 by 8 values."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).selectExpr("vec_id", "CAST(floor(i / 8) AS BIGINT) AS y", "CAST(i % 8 AS BIGINT) AS x", "CAST(v AS DOUBLE) AS value")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines of prose on each order: a heading, three sentences, a list label and a claim; some state what no result says."""
    off = lambda p: hash_bucket(F.concat(F.lit(p), F.col("o_orderkey").cast("string"))) < 0.2
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    buyer = (F.col("o_custkey") + F.when(off("w:"), 100_000).otherwise(0)).cast("string")
    text = F.concat(
        F.lit("## Order "), key, F.lit("\nBuyer "), buyer, F.lit(" ordered on "), F.when(off("d:"), "1901-01-01").otherwise(day), F.when(off("c:"), " [T1, T7]. ").otherwise(" [T1]. "),
        F.lit("The discount was "), (F.col("o_orderkey") % 40 + F.when(off("p:"), 50.5).otherwise(0.5)).cast("string"), F.lit("% 【T2】. See https://shop.example.org/"), F.when(off("u:"), "none").otherwise(key), F.lit(". Thanks\nTotals:\n2) Nobody checked this"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results behind each answer: T1 the order, T2 its discount as a share."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"order": '), key, F.lit(', "buyer": '), F.col("o_custkey").cast("string"), F.lit(', "placed": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00", "page": "https://shop.example.org/'), key, F.lit('/"}'))
    two = F.concat(F.lit('{"discount": '), ((F.col("o_orderkey") % 40 + 0.5) / 100).cast("decimal(6,4)").cast("string"), F.lit(', "steps": [1, [2, 3]]}'))
    return o.select("o_orderkey", F.explode(F.array(F.struct(F.lit("T1").alias("id"), one.alias("text")), F.struct(F.lit("T2").alias("id"), two.alias("text")))).alias("x")).select("o_orderkey", "x.*")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did, numbered in order: the events of audit chains before they are linked."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain"), F.row_number().over(w).cast("bigint").alias("sequence"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), (F.col("event_id") % 10).cast("string"))).alias("case_id"),
        F.lit(None).cast("string").alias("media_id"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("analysis_id"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("details"),
    )
