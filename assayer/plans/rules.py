"""Queries on single values: addresses, dates, reasons, contents, statuses and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import stats, statuses, text
from assayer.plans.evidence import query, rounded
from assayer.plans.oracle import hb
from assayer.sources import tables

_HOST = "CASE WHEN page_id % 11 = 10 THEN CASE page_id % 7 WHEN 0 THEN '[::1]' WHEN 1 THEN '[fe80::1]' WHEN 2 THEN '[fd00::1]:80' WHEN 3 THEN '[2606:4700:4700::1111]:443' WHEN 4 THEN '[::ffff:10.0.0.1]' WHEN 5 THEN '[::FFFF:8.8.8.8]' ELSE '[2001:db8::1]' END ELSE CASE page_id % 9 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN '192.168.0.7:443' WHEN 3 THEN 'user:pw@example.org' WHEN 4 THEN 'example.org:8080' WHEN 5 THEN '' WHEN 6 THEN '172.31.255.255' WHEN 7 THEN '172.32.0.1' ELSE 'example.org' END END"
_SCHEME = "CASE page_id % 5 WHEN 0 THEN 'ftp' WHEN 1 THEN 'HTTP' ELSE 'https' END"


@query(f"""SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'too long or missing' WHEN page_id % 5 = 0 THEN 'scheme' WHEN page_id % 11 = 10 THEN CASE WHEN page_id % 7 IN (3, 5) THEN 'allowed' ELSE 'not public' END WHEN page_id % 9 = 3 THEN 'credentials' WHEN page_id % 9 = 5 THEN 'no host' WHEN page_id % 9 = 4 THEN 'port' WHEN page_id % 9 IN (1, 2, 6) THEN 'not public' ELSE 'allowed' END AS outcome FROM pages""")
def url_policy(s, d):
    url = F.expr(f"CASE WHEN page_id % 26 = 0 THEN NULL WHEN page_id % 13 = 0 THEN concat('https://example.org/', repeat('x', 2048)) ELSE concat({_SCHEME}, '://', {_HOST}, '/a?b') END")
    return tables.table(s, d, "pages").select("page_id", text.url_policy(url).alias("outcome"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 = 5 THEN CASE WHEN six >= 16384 OR six < 8192 THEN false WHEN six = 8193 THEN NOT (b < 2 OR b = 13) ELSE six <> 8194 END ELSE NOT (a = 10 OR a = 0 OR a = 127 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) END AS public
FROM (SELECT event_id, [8193, 8194, 9734, 65152, 64768, 65282, 100, 16382][1 + event_id // 7 % 8] AS six, CASE event_id % 5 WHEN 0 THEN [10, 100, 127, 169, 172, 192, 198, 203][1 + event_id // 5 % 8] ELSE event_id * 7 % 256 END AS a, event_id * 11 % 256 AS b, event_id * 13 % 256 AS c FROM events)""")
def ip_is_public(s, d):
    e = tables.table(s, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN element_at(array(10, 100, 127, 169, 172, 192, 198, 203), int(1 + event_id div 5 % 8)) ELSE event_id * 7 % 256 END AS a", "event_id * 11 % 256 AS b", "event_id * 13 % 256 AS c")
    six = F.expr("concat(element_at(array('2001', '2002', '2606', 'FE80', 'fd00', 'ff02', '64', '3ffe'), int(1 + event_id div 7 % 8)), ':', CASE WHEN b = 13 THEN 'db8' ELSE lower(hex(b * 256 + c)) END, CASE WHEN event_id % 2 = 0 THEN '::1' ELSE ':0:0:1:2:3.4.5.6' END)")
    address = F.when(F.col("event_id") % 7 == 6, "example.org").when(F.col("event_id") % 7 == 5, six).otherwise(F.concat(F.when(F.col("event_id") % 3 == 0, "::ffff:").otherwise(""), F.concat_ws(".", "a", "b", "c", F.lit("77"))))
    return e.select("event_id", text.ip_is_public(address).alias("public"))


@query("SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') AS domain FROM (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN '/relative' ELSE url END AS url FROM pages)")
def url_domain(s, d):
    return tables.table(s, d, "pages").select("page_id", text.url_domain(F.expr("CASE WHEN page_id % 8 = 0 THEN '/relative' ELSE url END")).alias("domain"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat('https://cdn.example.org/', page_id, '.jpg,', base, '/rel/a.png') WHEN page_id % 4 = 1 THEN concat('https:', '//img.example.org/b.gif') WHEN page_id % 4 = 2 THEN concat(base, '/x/one.jpg?k=1,', base, '/two.jpg') ELSE '' END AS links FROM (SELECT page_id, concat('https://host', page_id % 3, '.example.org') AS base FROM pages)""")
def html_image_links(s, d):
    base = F.concat(F.lit("https://host"), (F.col("page_id") % 3).cast("string"), F.lit(".example.org"))
    id_ = F.col("page_id").cast("string")
    html = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<head><META name='x'><meta property=\"og:image\" content=\"https://cdn.example.org/"), id_, F.lit(".jpg?utm_source=a\"></head><img src='/rel/a.png'><img src='data:image/png;base64,AA'>")))
        .when(F.col("page_id") % 4 == 1, F.lit("<link rel='image_src' href='//img.example.org/b.gif'><img alt='none'>"))
        .when(F.col("page_id") % 4 == 2, F.lit("<img data-src=\"one.jpg?utm_medium=m&k=1\"><IMG SRC=\"/two.jpg\"><img src='/two.jpg'><img src='mailto:x'>"))
        .otherwise("<p>none</p>")
    )
    pages = tables.table(s, d, "pages").select("page_id", html.alias("html"), F.concat(base, F.lit("/x/page.html?q=1")).alias("url"))
    return pages.select("page_id", F.array_join(text.image_links(F.col("html"), F.col("url")), ",").alias("links"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('cannot read <file> for job ', event_id) WHEN 1 THEN 'a database error occurred while saving this step' WHEN 2 THEN concat('fetch https://host.example.org/a/b failed, job ', event_id) WHEN 3 THEN concat(repeat('word ', 47), 'word…') ELSE concat('insert failed, job ', event_id) END AS reason FROM events""")
def scrub_text(s, d):
    raw = F.expr(r"""CASE event_id % 5 WHEN 0 THEN concat('cannot read  ', CASE WHEN event_id % 2 = 0 THEN '/srv/app data/x/model.bin' ELSE 'C:\\\\Users\\\\Jane Doe\\\\m.bin' END, '\n for job ', event_id) WHEN 1 THEN concat("(sqlite3.OperationalError) job ", event_id)
    WHEN 2 THEN concat('fetch https://host.example.org/a/b failed, job ', event_id) WHEN 3 THEN repeat('word ', 300) ELSE concat('insert failed, job ', event_id, ' [SQL: INSERT INTO t VALUES (1)]') END""")
    return tables.table(s, d, "events").select("event_id", text.scrub(raw).alias("reason"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso, CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN 'day' ELSE 'second' END AS "precision" FROM events""")
def parse_stated_date(s, d):
    f = lambda layout: F.date_format("ts", layout)
    k = F.col("event_id") % 6
    stated = F.when(k == 0, f("yyyy:MM:dd HH:mm:ss")).when(k == 1, F.concat(F.lit(" "), f("yyyy-MM-dd"))).when(k == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(k == 3, f("yyyy-MM-dd HH:mm")).when(k == 4, F.lit("2024-13-45"))
    return tables.table(s, d, "events").select("event_id", text.stated_date(stated).alias("x")).select("event_id", "x.iso", "x.precision")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS captured FROM events")
def capture_time(s, d):
    stamp = F.when(F.col("event_id") % 10 == 9, "2024").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return tables.table(s, d, "events").select("event_id", F.unix_timestamp(text.capture_time(stamp)).alias("captured"))


#: First bytes and what they tell.
_MAGIC = [("FFD8FFE0", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("49492A00", "image/tiff"), ("524946460000000057454250", "image/webp"), ("524946460000000057415645", "audio/wav"), ("0000001866747970717420", "video/mp4"), ("00000018667479704D344120", "audio/mp4"), ("1A45DFA3", "video/x-matroska"), ("FFF1", "audio/aac"), ("FFFB", "audio/mpeg"), ("494433", "audio/mpeg"), ("3C68746D6C", None)]


@query(f"""SELECT doc_id, CASE doc_id % {len(_MAGIC)} {" ".join(f"WHEN {i} THEN " + (f"'{m}'" if m else "NULL") for i, (_, m) in enumerate(_MAGIC))} END AS media_type FROM documents""")
def sniff_media_type(s, d):
    head = F.expr(f"element_at(array({', '.join(repr(h) for h, _ in _MAGIC)}), int(1 + doc_id % {len(_MAGIC)}))")
    content = F.concat(F.unhex(head), F.lit(b"\x00\x00"), F.col("text").cast("binary"))
    return tables.table(s, d, "documents").select("doc_id", text.media_type(content).alias("media_type"))


@query("""SELECT detection_id, CASE label WHEN 'CLEAN' THEN 'NO_SIGNIFICANT_ANOMALIES_DETECTED' WHEN 'UNAVAILABLE' THEN 'INCONCLUSIVE' ELSE label END AS canonical, label IN ('CLEAN', 'UNAVAILABLE') AS deprecated
FROM (SELECT detection_id, CASE detection_id % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'SUSPICIOUS' ELSE 'INCONCLUSIVE' END AS label FROM v_detections)""")
def canonical_label(s, d):
    label = F.expr("CASE detection_id % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'SUSPICIOUS' ELSE 'INCONCLUSIVE' END")
    return tables.detections(s, d).withColumn("label", label).select("detection_id", statuses.canonical(F.col("label")).alias("canonical"), F.col("label").isin(*statuses.CANONICAL).alias("deprecated"))


_STATED = """SELECT detection_id, flagged, confidence, CASE WHEN detection_id % 3 = 0 THEN CASE WHEN detection_id % 2 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END END AS availability, CASE WHEN detection_id % 5 < 2 THEN execution_status END AS execution_status,
CASE detection_id % 7 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'INCONCLUSIVE' WHEN 2 THEN 'SUSPICIOUS' WHEN 3 THEN 'CLEAN' END AS assessment FROM {}"""


@query(f"""SELECT detection_id, av AS availability, ex AS execution_status, CASE WHEN assessment IS NOT NULL THEN assessment WHEN av = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN ex <> 'COMPLETED' THEN 'INCONCLUSIVE' WHEN flagged THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS assessment,
round(CASE WHEN av = 'AVAILABLE' AND ex IN ('COMPLETED', 'INCONCLUSIVE') THEN confidence ELSE 0.0 END, 6) AS confidence, av = 'AVAILABLE' AND ex IN ('COMPLETED', 'INCONCLUSIVE') AS produced_observations, av = 'AVAILABLE' AND ex = 'COMPLETED' AS supports_determination
FROM (SELECT *, CASE WHEN availability IS NULL AND execution_status IS NULL AND assessment = 'UNAVAILABLE' THEN 'UNAVAILABLE' ELSE coalesce(availability, 'AVAILABLE') END AS av,
CASE WHEN availability IS NULL AND execution_status IS NULL AND assessment = 'UNAVAILABLE' THEN 'SKIPPED' WHEN availability IS NULL AND execution_status IS NULL AND assessment = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' ELSE coalesce(execution_status, 'COMPLETED') END AS ex FROM ({_STATED.format("v_detections")}))""")
def status_reconcile(s, d):
    tables.detections(s, d).createOrReplaceTempView("_stated")
    return rounded(statuses.reconcile(s.sql(_STATED.format("_stated"))).select("detection_id", "availability", "execution_status", "assessment", "confidence", "produced_observations", "supports_determination"))


@query("""SELECT detection_id, CASE WHEN detection_id % 3 = 0 THEN 'AVAILABLE' WHEN label = 'UNAVAILABLE' THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability, CASE WHEN detection_id % 3 = 0 THEN 'FAILED' WHEN label = 'UNAVAILABLE' THEN 'SKIPPED' WHEN label = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' ELSE 'COMPLETED' END AS execution_status,
CASE WHEN detection_id % 3 <> 0 AND label IN ('UNAVAILABLE', 'INCONCLUSIVE') THEN 'inferred from the old label' END AS status_reason FROM (SELECT detection_id, CASE detection_id % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'SUSPICIOUS' ELSE 'INCONCLUSIVE' END AS label FROM v_detections)""")
def status_backfill(s, d):
    old = tables.detections(s, d).selectExpr("detection_id", "CASE detection_id % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'SUSPICIOUS' ELSE 'INCONCLUSIVE' END AS assessment", "CASE WHEN detection_id % 3 = 0 THEN 'AVAILABLE' END AS availability", "CASE WHEN detection_id % 3 = 0 THEN 'FAILED' END AS execution_status", "CAST(NULL AS STRING) AS status_reason")
    return statuses.backfill(old).drop("assessment")


@query("""SELECT page_id, round(CASE WHEN page_id % 11 = 0 THEN 1.0 WHEN page_id % 3 = 0 THEN greatest((page_id % 7) / 5.0 - 0.4, 0) ELSE 1 - (page_id % 20) / 64.0 END, 6)::DOUBLE AS similarity, CASE WHEN page_id % 11 = 0 THEN 'exact' WHEN page_id % 3 = 0 THEN 'embedding' ELSE 'perceptual' END AS "method" FROM pages""")
def match_score(s, d):
    id_ = F.col("page_id")
    found = stats.match_score(id_ % 11 == 0, F.when(id_ % 3 == 0, (id_ % 7) / 5.0 - 0.4), id_ % 20)
    return rounded(tables.table(s, d, "pages").select("page_id", found.alias("x")).select("page_id", "x.similarity", "x.method"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 16 ELSE CAST(bit_count(xor(doc_id * 40503 % 65536, doc_id * 30011 % 65536)) AS BIGINT) END AS distance, round(1 - CASE WHEN doc_id % 10 = 0 THEN 16 ELSE bit_count(xor(doc_id * 40503 % 65536, doc_id * 30011 % 65536)) END / 16.0::DOUBLE, 6) AS similarity FROM documents""")
def hamming_distance(s, d):
    bits = lambda k: F.lpad(F.bin(F.col("doc_id") * k % 65536), 16, "0")
    other = F.when(F.col("doc_id") % 10 == 0, F.concat(bits(30011), F.lit("0"))).otherwise(bits(30011))
    apart = stats.bits_apart(bits(40503), other)
    return rounded(tables.table(s, d, "documents").select("doc_id", apart.cast("bigint").alias("distance"), (1 - apart / 16.0).alias("similarity")))


@query("""SELECT a.vec_id, round(CASE WHEN a.vec_id % 10 = 0 THEN NULL ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) END, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def unit_vector_cosine(s, d):
    e = tables.table(s, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    own = F.when(F.col("vec_id") % 20 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return rounded(e.join(other, "vec_id").select("vec_id", stats.cosine(own, F.col("other")).alias("cosine")))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE least(n_chars, 100 + doc_id % 5000) END AS short_side FROM documents")
def short_side(s, d):
    return tables.table(s, d, "documents").select("doc_id", stats.short_side(F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")), 100 + F.col("doc_id") % 5000).alias("short_side"))


@query("SELECT id, regexp_replace(concat(id, CASE WHEN tag = 'original' THEN '.png' ELSE concat('__', tag, '.jpg') END), CASE WHEN tag = 'original' THEN '[.]png$' ELSE '__[^_].*$' END, '') AS original FROM v_items")
def original_of(s, d):
    i = tables.items(s, d).select("id", F.array("tag").alias("tags"), F.when(F.col("tag") == "original", F.concat("id", F.lit(".png"))).otherwise(F.concat("id", F.lit("__"), "tag", F.lit(".jpg"))).alias("file"))
    return i.select("id", statuses.original_of(F.col("file"), F.col("tags")).alias("original"))


@query("SELECT id, list_has_any(tags, ['jpeg_q70', 'webp_q75', 'social']) AS changed, array_to_string(list_sort(list_intersect(tags, ['jpeg_q70', 'webp_q75', 'social'])), ',') AS which FROM (SELECT id, [tag, grp, CASE WHEN id LIKE '%3' THEN 'social' ELSE 'plain' END] AS tags FROM v_items)")
def tag_intersect(s, d):
    wanted = F.array(F.lit("jpeg_q70"), F.lit("webp_q75"), F.lit("social"))
    i = tables.items(s, d).select("id", F.array("tag", "grp", F.when(F.col("id").endswith("3"), "social").otherwise("plain")).alias("tags"))
    return i.select("id", F.arrays_overlap("tags", wanted).alias("changed"), F.array_join(F.array_sort(F.array_intersect("tags", wanted)), ",").alias("which"))


@query("""SELECT page_id, NOT regexp_matches(lower(title), 'edited|logo|comparison') AND regexp_matches(lower(title), 'alpha[ ._-]?(1|2|pro)') AS usable FROM (SELECT page_id, concat('Image by Alpha', CASE page_id % 4 WHEN 0 THEN ' 1' WHEN 1 THEN '-Pro' WHEN 2 THEN 'bet' ELSE '_2' END, CASE page_id % 5 WHEN 0 THEN ' (Edited)' WHEN 1 THEN ' LOGO' ELSE '' END) AS title FROM pages)""")
def title_rules(s, d):
    title = F.expr("concat('Image by Alpha', CASE page_id % 4 WHEN 0 THEN ' 1' WHEN 1 THEN '-Pro' WHEN 2 THEN 'bet' ELSE '_2' END, CASE page_id % 5 WHEN 0 THEN ' (Edited)' WHEN 1 THEN ' LOGO' ELSE '' END)")
    return tables.table(s, d, "pages").select("page_id", statuses.title_usable(title, ["edited", "logo", "comparison"], [r"alpha[ ._-]?(1|2|pro)"]).alias("usable"))


_FILES = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/gif' ELSE 'image/png' END AS mime, CASE WHEN page_id % 7 > 0 THEN 200 + page_id % 300 END AS width, 300 AS height, CASE WHEN page_id % 6 > 0 THEN url END AS sha1 FROM {}"


@query(f"""SELECT page_id, CASE WHEN mime = 'image/gif' THEN 'type image/gif' WHEN width IS NULL OR least(width, height) < 256 THEN 'smaller than 256 px' WHEN sha1 IS NULL THEN 'no digest' END AS reason FROM ({_FILES.format("pages")})""")
def skip_reason(s, d):
    tables.table(s, d, "pages").createOrReplaceTempView("_files")
    return statuses.skip_reason(s.sql(_FILES.format("_files")), 256).select("page_id", "reason")


@query(f"""WITH f AS ({_FILES.format("pages")}), r AS (SELECT CASE WHEN mime = 'image/gif' THEN 'skipped: type image/gif' WHEN width IS NULL OR least(width, height) < 256 THEN 'skipped: smaller than 256 px' WHEN sha1 IS NULL THEN 'skipped: no digest' WHEN page_id % 4 = 0 THEN 'unchanged' WHEN page_id % 4 = 1 THEN 'refreshed' WHEN page_id % 4 = 2 THEN 'failed' ELSE 'indexed' END AS outcome FROM f) SELECT outcome, count(*) AS n FROM r GROUP BY 1""")
def build_stats(s, d):
    tables.table(s, d, "pages").createOrReplaceTempView("_files")
    done = F.expr("CASE page_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'refreshed' WHEN 2 THEN 'failed' ELSE 'indexed' END")
    files = statuses.skip_reason(s.sql(_FILES.format("_files")), 256)
    return files.groupBy(F.when(F.col("reason").isNotNull(), F.concat(F.lit("skipped: "), "reason")).otherwise(done).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'GPSLatitude,GPSLongitude' WHEN event_id % 3 = 1 THEN 'gpsAltitude' ELSE '' END AS withheld, CASE WHEN event_id % 2 = 0 THEN 'Kind,Value' ELSE 'Kind' END AS kept FROM events""")
def withhold_keys(s, d):
    exif = F.map_concat(F.create_map(F.lit("Value"), F.col("value").cast("string"), F.lit("Kind"), F.col("event_type")), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("GPSLongitude"), F.lit("1"), F.lit("GPSLatitude"), F.lit("2"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("gpsAltitude"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>")))
    e = tables.table(s, d, "events").select("event_id", statuses.withheld(exif, 1 + (F.col("event_id") + 1) % 2).alias("x"))
    return e.select("event_id", F.array_join("x.withheld", ",").alias("withheld"), F.array_join(F.map_keys("x.fields"), ",").alias("kept"))


@query("""SELECT id, detector, CASE WHEN execution_status = 'FAILED' THEN 'none (no observation)' WHEN detector = 'gen_b' THEN concat(CAST(floor(raw_score * 100) AS BIGINT), '% calibrated probability') WHEN detector = 'learned_a' THEN concat(CAST(floor(raw_score * 1000) AS BIGINT), ' thousandths (raw model score, not a probability)') ELSE concat(CAST(floor(raw_score * 1000) AS BIGINT), ' thousandths (heuristic severity, ordinal only)') END AS score_text FROM v_scores""")
def score_text(s, d):
    kind = F.when(F.col("execution_status") == "FAILED", "NOT_APPLICABLE").when(F.col("detector") == "gen_b", "CALIBRATED_PROBABILITY").when(F.col("detector") == "learned_a", "RAW_MODEL_SCORE").otherwise(F.lit(None).cast("string"))
    return tables.scores(s, d).select("id", "detector", statuses.score_text(F.col("raw_score"), kind).alias("score_text"))


@query("SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'WITHHELD' ELSE 'ADVISORY' END AS state FROM events")
def verdict_state(s, d):
    policy = F.expr("CASE user_id % 4 WHEN 0 THEN map('release_state', 'RELEASED') WHEN 1 THEN map('release_state', 'WITHHELD') WHEN 2 THEN map('release_state', 'anything') ELSE map('other', 'x') END")
    return tables.table(s, d, "events").select("user_id").distinct().select("user_id", statuses.release_state(policy, ["RELEASED", "WITHHELD", "ADVISORY"]).alias("state"))


@query("""SELECT analysis_id, CASE WHEN category IN ('SUSPICIOUS', 'LIKELY_MANIPULATED') AND indicated THEN 'both results may describe the same local edit' END AS note FROM (SELECT analysis_id, bool_or(detector = 'gen_b' AND flagged AND execution_status = 'COMPLETED') AS indicated, CASE WHEN count(*) FILTER (detector IN ('learned_a', 'geometric_a') AND flagged AND execution_status = 'COMPLETED') > 0 THEN 'SUSPICIOUS' ELSE 'INCONCLUSIVE' END AS category FROM v_detections GROUP BY 1)""")
def edit_note(s, d):
    ok = F.col("flagged") & (F.col("execution_status") == "COMPLETED")
    a = tables.detections(s, d).groupBy("analysis_id").agg(F.bool_or((F.col("detector") == "gen_b") & ok).alias("indicated"), F.when(F.count_if(F.col("detector").isin("learned_a", "geometric_a") & ok) > 0, "SUSPICIOUS").otherwise("INCONCLUSIVE").alias("category"))
    return a.select("analysis_id", statuses.edit_note(F.col("indicated"), F.col("category")).alias("note"))


@query("SELECT vec_id, CAST(octet_length(from_base64(b)) AS BIGINT) AS bytes, true AS same FROM (SELECT vec_id, to_base64(encode(repeat('xx', len(embedding)))) AS b FROM embeddings)")
def embedding_codec(s, d):
    e = tables.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).select("vec_id", "v", statuses.encoded(F.col("v")).alias("text"))
    back = e.select("vec_id", "v", F.octet_length(F.unbase64("text")).cast("bigint").alias("bytes"), statuses.decoded(F.col("text")).alias("back"))
    near = F.forall(F.zip_with("v", "back", lambda a, b: F.abs(a - b) <= F.abs(a) * 0.001 + 1e-6), lambda x: x)
    return back.select("vec_id", "bytes", ((F.size("v") == F.size("back")) & near).alias("same"))
