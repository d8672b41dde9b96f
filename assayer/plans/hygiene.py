"""Queries on manifests, locks, copies, near duplicates and what may be fitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.stats import hash_bucket
from assayer.operators import retrieval, splits
from assayer.plans.evidence import QUERIES, query, rounded, split_items
from assayer.plans.evidence import _split as split_sql
from assayer.plans.oracle import hb
from assayer.sources import manifests, scratch, tables


def _manifest(s, d):
    """Where the items stand as a manifest: some without id, group or generator, one field of an unknown name."""
    i = tables.items(s, d)
    bare = F.col("id").cast("bigint") % 4
    rows = i.select(F.when(bare != 0, F.col("id")).alias("id"), F.concat(F.lit("files/"), "id", F.lit(".txt")).alias("file"), "label", F.when(bare != 1, F.col("grp")).alias("group"), "kind", F.array_remove(F.array("tag"), "original").alias("tags"), F.col("short_side").alias("side"))
    path = scratch.place(s, "manifest")
    manifests.write_manifest(rows, path)
    return path


@query("""SELECT CASE WHEN k = 0 THEN file ELSE id END AS id, file, label, CASE WHEN k = 1 THEN file ELSE grp END AS "group", kind, CASE WHEN label = 'ai_generated' THEN kind END AS generator, CASE WHEN tag = 'original' THEN '' ELSE tag END AS tags, CAST(short_side AS VARCHAR) AS side FROM (SELECT *, CAST(id AS BIGINT) % 4 AS k, concat('files/', id, '.txt') AS file FROM v_items)""")
def scan_manifest(s, d):
    m = manifests.scan_manifest(s, _manifest(s, d))
    return m.select("id", "file", "label", "group", "kind", "generator", F.array_join("tags", ",").alias("tags"), F.element_at("extra", "side").alias("side"))


@query("""SELECT concat('{', CASE WHEN k = 0 THEN '' ELSE concat('"id":"', id, '",') END, '"file":"files/', id, '.txt","label":"', label, '"', CASE WHEN k = 1 THEN '' ELSE concat(',"group":"', grp, '"') END, CASE WHEN kind IS NULL THEN '' ELSE concat(',"kind":"', kind, '"') END, CASE WHEN tag = 'original' THEN '' ELSE concat(',"tags":["', tag, '"]') END, ',"side":', short_side, '}') AS line FROM (SELECT *, CAST(id AS BIGINT) % 4 AS k FROM v_items)""")
def write_manifest(s, d):
    return s.read.text(_manifest(s, d)).select(F.col("value").alias("line"))


@query("SELECT id, detector, execution_status, round(raw_score, 6) AS raw_score, label = 'manipulated' AS manipulation FROM v_scores")
def scan_predictions(s, d):
    own = F.struct("execution_status", "raw_score", "duration_ms")
    rows = tables.scores(s, d).groupBy("id", "label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("detector"), own))).alias("detectors"))
    path = scratch.place(s, "predictions")
    lines = rows.select(F.to_json(F.struct("id", F.struct((F.col("label") == "manipulated").alias("manipulation")).alias("targets"), "detectors")).alias("value"))
    lines.unionByName(lines.select(F.lit("").alias("value"))).write.text(path)  # as many blank lines
    found = manifests.scan_predictions(s, path)
    return rounded(found.select("id", F.col("targets.manipulation").alias("manipulation"), F.explode("detectors").alias("detector", "x")).select("id", "detector", "x.execution_status", "x.raw_score", "manipulation"))


@query(f"""WITH m AS (SELECT CASE WHEN CAST(id AS BIGINT) % 20 = 0 THEN '0' ELSE id END AS id, grp, concat('files/', id) AS file, CASE WHEN CAST(id AS BIGINT) % 15 = 0 THEN 'train' ELSE {split_sql("grp")} END AS split, CAST(id AS BIGINT) % 10 = 3 AS gone FROM v_items)
SELECT id, 'duplicate id' AS problem FROM m GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, concat('unknown split ', split) FROM m WHERE split = 'train' UNION ALL SELECT id, 'file missing' FROM m WHERE gone UNION ALL SELECT grp, concat('group in several splits: ', string_agg(DISTINCT split, ', ' ORDER BY split)) FROM m GROUP BY grp HAVING count(DISTINCT split) > 1""")
def validate_manifest(s, d):
    n = F.col("id").cast("bigint")
    every = split_items(s, d).select(F.when(n % 20 == 0, "0").otherwise(F.col("id")).alias("id"), F.col("grp").alias("group"), F.concat(F.lit("files/"), "id").alias("file"), F.lit(None).cast("string").alias("mask"), F.when(n % 15 == 0, "train").otherwise(F.col("split")).alias("split"), (n % 10 == 3).alias("gone"))
    return manifests.problems(every.drop("gone"), every.where("not gone").select(F.col("file").alias("path")))


def scan_binary_sha256(s, d):
    """Name, size and digest of every file of the given folder."""
    return manifests.digests(s, d, "*.parquet")


QUERIES["scan_binary_sha256"] = scan_binary_sha256


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999")
def scan_tables(s, d):
    return tables.table(s, d, "orders").where(F.col("o_orderkey").between(1000, 1999)).select("o_orderkey", "o_custkey", "o_totalprice")


_ONCE = f"SELECT min(id) AS id, min(label) AS label, sha FROM (SELECT i.id, i.label, sha256(d.text) AS sha, {split_sql('grp')} AS split FROM v_items i JOIN documents d ON i.id = CAST(d.doc_id AS VARCHAR)) WHERE split = 'holdout' GROUP BY sha"


@query(f"""WITH h AS ({_ONCE}) SELECT id, label, sha AS sha256, (SELECT count(*) FROM h) AS count, (SELECT sha256(string_agg(part, '' ORDER BY r)) FROM (SELECT sha256(sha)[1:4] AS r, sha256(string_agg(sha256(sha), '' ORDER BY sha256(sha))) AS part FROM h GROUP BY 1)) AS holdout_sha256 FROM h""")
def lock_store(s, d):
    docs = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    own = split_items(s, d).where("split = 'holdout'").join(docs, "id").groupBy("sha256").agg(F.min("id").alias("id"), F.min("label").alias("label"))
    path = scratch.place(s, "lock")
    manifests.write_lock(own, path)
    files, header = manifests.read_lock(s, path)
    return files.crossJoin(F.broadcast(header)).select("id", "label", "sha256", "count", "holdout_sha256")  # one header


@query("SELECT concat(detector, '.json') AS name, CASE detector WHEN 'gen_a' THEN 'mismatch' WHEN 'gen_b' THEN 'unlisted' ELSE 'verified' END AS status FROM (SELECT DISTINCT detector FROM v_scores)")
def calibration_store(s, d):
    known = scratch.kept(tables.scores(s, d).groupBy("detector").agg(F.avg("raw_score").alias("prior")), "calibrations")
    path = scratch.place(s, "calibrations")
    known.select(F.col("detector").alias("name"), F.to_json(F.struct("detector", "prior")).alias("value")).write.partitionBy("name").text(path)
    named = s.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    files = named.select(F.concat(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit(".json")).alias("name"), F.sha2("content", 256).alias("sha256"))
    listed = files.where("name <> 'gen_b.json'").select(F.concat(F.when(F.col("name") == "gen_a.json", F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")), F.lit("  "), "name").alias("value"))
    return manifests.checked(files, listed)


@query(f"""WITH k AS ({_ONCE}), r AS (SELECT id FROM v_items WHERE {split_sql('grp')} = 'val' UNION ALL SELECT min(id) FROM k) SELECT 'val' AS split, count(*) AS rows, count(*) FILTER (id IN (SELECT id FROM k)) AS frozen, count(*) FILTER (id IN (SELECT id FROM k)) > 0 AS refused FROM r""")
def fit_guard(s, d):
    docs = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    i = split_items(s, d)
    locked = i.where("split = 'holdout'").join(docs, "id").groupBy("sha256").agg(F.min("id").alias("id"))
    mislabelled = locked.agg(F.min("id").alias("id"))
    return splits.fit_guard(i.where("split = 'val'").select("id").unionByName(mislabelled), locked, "val")


@query("""SELECT id, grp, tag, sha256(CASE tag WHEN 'original' THEN t WHEN 'cut_80' THEN t[1:CAST(floor(length(t) * 0.8) AS BIGINT)] WHEN 'half' THEN array_to_string(list_filter(string_split(t, ' '), lambda w, i: i % 2 = 1), ' ') WHEN 'lower' THEN lower(t) WHEN 'blanks' THEN regexp_replace(t, '\\s+', ' ', 'g') ELSE regexp_replace(t, '[.,;:!?]', '', 'g') END) AS sha
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, source AS grp, text AS t FROM documents), (VALUES ('original'), ('cut_80'), ('half'), ('lower'), ('blanks'), ('bare')) k(tag)""")
def robustness_variants(s, d):
    docs = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("grp"), "text")
    return splits.variants(docs).select("id", "grp", "tag", F.sha2(F.col("copy").cast("binary"), 256).alias("sha"))


def quota_plan(s, d):
    """Which sources to read for so many documents of each language."""
    docs = tables.table(s, d, "documents")
    counts = docs.groupBy("source", F.col("lang").alias("class")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))
    size = docs.groupBy("source").agg(F.sum("n_chars").alias("bytes"))
    plan = splits.quota_plan(counts.join(size, "source"), {"en": 120, "de": 60, "fr": 60}, 40)
    return s.createDataFrame([(i, *p) for i, p in enumerate(plan, 1)], "place int, source string, gain int")


QUERIES["quota_plan"] = quota_plan

_WORDS = "SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents"
_BITS = "SELECT id, n, ('0x' || md5(w)[1:8])::UBIGINT AS h0, ('0x' || md5(w)[9:16])::UBIGINT AS h1 FROM (SELECT id, w, count(*) AS n FROM (" + _WORDS + ") GROUP BY 1, 2)"
_SIGNED = ", ".join(f"sum(CASE WHEN ({h} >> {i}) & 1 = 1 THEN n ELSE -n END) > 0 AS {h}_{i}" for h in ("h0", "h1") for i in range(32))
_CODES = f"SELECT doc_id AS id, coalesce(code, repeat('0', 64)) AS code FROM documents LEFT JOIN (SELECT id, {' || '.join(f"CASE WHEN {h}_{i} THEN '1' ELSE '0' END" for h in ('h0', 'h1') for i in reversed(range(32)))} AS code FROM (SELECT id, {_SIGNED} FROM ({_BITS}) GROUP BY 1)) ON id = doc_id"


def codes(s, d):
    return retrieval.text_codes(tables.table(s, d, "documents"), "doc_id", "text")


@query(f"SELECT id, code FROM ({_CODES})")
def text_simhash(s, d):
    return codes(s, d).select("id", F.lpad(F.bin("code"), 64, "0").alias("code"))


_PAIRS = f"c AS MATERIALIZED (SELECT id, ('0b' || code[1:32])::UBIGINT AS hi, ('0b' || code[33:64])::UBIGINT AS lo FROM ({_CODES}))"


@query(f"WITH {_PAIRS} SELECT a.id AS a_id, b.id AS b_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS distance FROM c a JOIN c b ON a.id % 2 = 0 AND b.id % 2 = 1 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 5")
def hamming_join(s, d):
    c = scratch.kept(codes(s, d), "codes")
    return rounded(retrieval.hamming_join(c.where("id % 2 = 0"), c.where("id % 2 = 1"), 5))


@query(f"""WITH {_PAIRS}, n AS (SELECT a.id, b.id AS other, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS BIGINT) AS distance FROM c a JOIN c b ON a.id % 3 > 0 AND b.id % 3 = 0 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4)
SELECT c.id, x.other AS near_duplicate_of, x.distance FROM c LEFT JOIN (SELECT id, other, distance, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS r FROM n) x ON x.id = c.id AND x.r = 1 WHERE c.id % 3 > 0""")
def dedupe_against(s, d):
    c = scratch.kept(codes(s, d), "codes")
    return rounded(splits.drop_near(c.where("id % 3 > 0"), c.where("id % 3 = 0"), 4))


@query(f"""WITH RECURSIVE {_PAIRS.replace("c AS", "c AS")}, l AS (SELECT a.id, b.id AS other FROM c a JOIN c b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4), r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, l.other FROM r JOIN l ON l.id = r.reach) SELECT id, min(reach) AS "group" FROM r GROUP BY 1""")
def near_dup_groups(s, d):
    return splits.near_groups(scratch.kept(codes(s, d), "codes"), 4)


_RUNS = "r AS MATERIALIZED (SELECT id, CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS runs FROM (SELECT min(doc_id) AS id, list_filter(regexp_split_to_array(lower(any_value(text)), '\\s+'), lambda x: x <> '') AS w FROM documents GROUP BY sha256(text)))"


@query(f"""WITH {_RUNS}, e AS (SELECT id, len(runs) AS n, unnest(runs) AS run FROM r), x AS (SELECT a.id AS a_id, b.id AS b_id, any_value(a.n) AS m, any_value(b.n) AS k, count(*) AS n FROM e a JOIN e b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
SELECT a_id, b_id, round(n / (m + k - n)::DOUBLE, 6) AS similarity FROM x WHERE n / (m + k - n)::DOUBLE >= 0.8""")
def near_dup_docs(s, d):
    return rounded(retrieval.near_documents(tables.table(s, d, "documents"), "doc_id", "text"))
