"""Queries on claims and on audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import audit, grounding
from assayer.plans.evidence import query
from assayer.plans.oracle import hb
from assayer.sources import tables

#: What an answer states wrongly, by order; the twins know it from how answers are made and parse nothing.
_ANSWERS = f"""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, {", ".join(f"{hb(f"concat('{p}:', CAST(o_orderkey AS VARCHAR))")} < 0.2 AS {p}" for p in "wdcpu")},
concat(o_orderkey % 40 + 0, '.5') AS share, concat(o_orderkey % 40 + 50, '.5') AS more FROM orders"""


@query(f"""WITH a AS ({_ANSWERS}) SELECT o_orderkey, 1 AS place, 'unsupported_number' AS "type", CAST(o_custkey + 100000 AS VARCHAR) AS value FROM a WHERE w UNION ALL SELECT o_orderkey, 1, 'unsupported_timestamp', '1901-01-01' FROM a WHERE d UNION ALL SELECT o_orderkey, 1, 'unknown_citation', 'T7' FROM a WHERE c
UNION ALL SELECT o_orderkey, 2, 'unsupported_number', concat(more, '%') FROM a WHERE p UNION ALL SELECT o_orderkey, 3, 'unsupported_url', 'https://shop.example.org/none' FROM a WHERE u UNION ALL SELECT o_orderkey, k.p, 'uncited', NULL FROM a, (VALUES (3), (4), (6)) k(p)""")
def ground_claims(s, d):
    found = grounding.grounded(tables.answers(s, d), tables.results(s, d), "o_orderkey")
    return found.select("o_orderkey", F.col("place").cast("bigint").alias("place"), F.explode("flags").alias("f")).select("o_orderkey", "place", "f.type", "f.value")


@query(f"""SELECT o_orderkey, concat('## Order ', o_orderkey, chr(10), 'Buyer ', CASE WHEN w THEN '[unverified]' ELSE CAST(o_custkey AS VARCHAR) END, ' ordered on ', CASE WHEN d THEN '[unverified]' ELSE CAST(day AS VARCHAR) END, ' [T1].', chr(10), 'The discount was ', CASE WHEN p THEN '[unverified]' ELSE concat(share, '%') END, ' [T2].', chr(10), 'See ', CASE WHEN u THEN '[unverified]' ELSE concat('https://shop.example.org/', o_orderkey) END, '.', chr(10), 'Thanks', chr(10), 'Totals:', chr(10), '2) Nobody checked this') AS text FROM ({_ANSWERS})""")
def redact_unsupported(s, d):
    found = grounding.grounded(tables.answers(s, d), tables.results(s, d), "o_orderkey")
    lines = F.array_sort(F.collect_list(F.struct("place", "text")))
    return found.groupBy("o_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


@query(f"""SELECT o_orderkey, concat('Buyer ', CASE WHEN w THEN '[unverified]' ELSE CAST(o_custkey AS VARCHAR) END, ' ordered on ', CASE WHEN d THEN '[unverified]' ELSE CAST(day AS VARCHAR) END, ' [T1].') AS sentence, 'T1' AS cited FROM ({_ANSWERS})
UNION ALL SELECT o_orderkey, concat('The discount was ', CASE WHEN p THEN '[unverified]' ELSE concat(share, '%') END, ' [T2].'), 'T2' FROM ({_ANSWERS})""")
def citation_table(s, d):
    found = grounding.grounded(tables.answers(s, d), tables.results(s, d), "o_orderkey")
    return found.select("o_orderkey", F.col("text").alias("sentence"), F.explode("cited").alias("cited"))


@query(f"""WITH a AS ({_ANSWERS}) SELECT o_orderkey, 0 AS place, concat('## Order ', o_orderkey) AS sentence FROM a UNION ALL SELECT o_orderkey, 1, concat('Buyer ', o_custkey + CASE WHEN w THEN 100000 ELSE 0 END, ' ordered on ', CASE WHEN d THEN '1901-01-01' ELSE CAST(day AS VARCHAR) END, CASE WHEN c THEN ' [T1, T7].' ELSE ' [T1].' END) FROM a
UNION ALL SELECT o_orderkey, 2, concat('The discount was ', CASE WHEN p THEN more ELSE share END, '% 【T2】.') FROM a UNION ALL SELECT o_orderkey, 3, concat('See https://shop.example.org/', CASE WHEN u THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END, '.') FROM a UNION ALL SELECT o_orderkey, 4, 'Thanks' FROM a UNION ALL SELECT o_orderkey, 5, 'Totals:' FROM a UNION ALL SELECT o_orderkey, 6, '2) Nobody checked this' FROM a""")
def split_sentences(s, d):
    return grounding.sentences(tables.answers(s, d), "o_orderkey").select("o_orderkey", F.col("place").cast("bigint").alias("place"), "sentence")


@query("SELECT o_orderkey, p AS place, p NOT IN (0, 5) AS claim FROM orders, (VALUES (0), (1), (2), (3), (4), (5), (6)) k(p)")
def is_claim(s, d):
    return grounding.sentences(tables.answers(s, d), "o_orderkey").select("o_orderkey", F.col("place").cast("bigint").alias("place"), text.is_claim(F.col("sentence")).alias("claim"))


@query(f"""WITH a AS ({_ANSWERS}) SELECT o_orderkey, CASE WHEN c THEN 'T1,T7,T2' ELSE 'T1,T2' END AS cited, concat('https://shop.example.org/', CASE WHEN u THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END) AS addresses, CASE WHEN d THEN '1901-01-01' ELSE CAST(day AS VARCHAR) END AS times,
concat(o_orderkey, ' ', o_custkey + CASE WHEN w THEN 100000 ELSE 0 END, ' ', CASE WHEN d THEN '1901 01 01' ELSE replace(CAST(day AS VARCHAR), '-', ' ') END, ' ', CASE WHEN p THEN more ELSE share END, '%', CASE WHEN u THEN '' ELSE concat(' ', o_orderkey) END, ' 2') AS numbers FROM a""")
def extract_tokens(s, d):
    t = F.col("text")
    joined = lambda tokens, by: F.array_join(tokens, by)
    return tables.answers(s, d).select("o_orderkey", joined(text.citations(t), ",").alias("cited"), joined(text.addresses(t), ",").alias("addresses"), joined(text.times(t), ",").alias("times"), joined(text.numbers(t), " ").alias("numbers"))


@query(f"""SELECT DISTINCT l_orderkey, l_linenumber, token, token = CAST(l_orderkey AS VARCHAR) OR CAST(token AS BIGINT) = true_qty AS supported FROM (SELECT l_orderkey, l_linenumber, true_qty, unnest([CAST(l_orderkey AS VARCHAR), regexp_extract(claim, 'shipped (\\d+)', 1)]) AS token FROM v_claims)""")
def claim_range_join(s, d):
    c = tables.claims(s, d)
    claimed = c.select("l_orderkey", "l_linenumber", F.explode(text.numbers(F.col("claim"))).alias("token"))
    known = c.select("l_orderkey", "l_linenumber", F.explode(F.array(F.col("l_orderkey").cast("double"), F.col("true_qty") + 0.3)).alias("n"))
    return grounding.range_join(claimed, known, "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN id = 'T1' THEN '4' ELSE '2,2,2' END AS sizes, id FROM orders, (VALUES ('T1'), ('T2')) k(id)")
def json_lengths(s, d):
    return tables.results(s, d).select("o_orderkey", "id", F.array_join(grounding.json_sizes(F.col("text")).cast("array<string>"), ",").alias("sizes"))


# --- audit chains

_EVENTS = "SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS occurred_at, concat('user-', user_id) AS actor, event_type AS action, CASE WHEN event_id % 3 = 0 THEN concat('c', event_id % 10) END AS case_id, concat('a', event_id) AS analysis_id, json_extract_string(props, '$.k') AS k FROM events"
_TEXT = """concat('{{"action":"', action, '","actor":"', actor, '","analysis_id":"', analysis_id, '","case_id":', CASE WHEN case_id IS NULL THEN 'null' ELSE concat('"', case_id, '"') END, ',"details":{{"k":"', k, '"}},"media_id":null,"occurred_at":"', occurred_at, '","previous_event_hash":"', {before}, '","sequence":', {number}, '}}')"""
_GENESIS = "repeat('0', 64)"
_CHAIN = f"""e AS ({_EVENTS}), h AS (SELECT chain, sequence, {_GENESIS} AS previous_event_hash, sha256({_TEXT.format(before=_GENESIS, number="sequence")}) AS event_hash FROM e WHERE sequence = 1
UNION ALL SELECT e.chain, e.sequence, h.event_hash, sha256({_TEXT.format(before="h.event_hash", number="e.sequence")}) FROM h JOIN e ON e.chain = h.chain AND e.sequence = h.sequence + 1)"""


@query(f"SELECT chain, sequence, sha256({_TEXT.format(before=_GENESIS, number='sequence')}) AS hash FROM ({_EVENTS})")
def canonical_event_hash(s, d):
    return tables.audit_events(s, d).select("chain", "sequence", audit.event_hash(F.lit(audit.GENESIS)).alias("hash"))


def tampered(s, d):
    """Chains of which some are edited (an action), cut (a missing event) or linked elsewhere."""
    c = audit.chained(tables.audit_events(s, d))
    kind, at = F.col("chain") % 5, F.col("sequence")
    c = c.withColumn("action", F.when((kind == 1) & (at == 3), "edited").otherwise(F.col("action"))).where(~((kind == 2) & (at == 4)))
    return c.withColumn("previous_event_hash", F.when((kind == 3) & (at == 2), "elsewhere").otherwise(F.col("previous_event_hash")))


@query(f"""WITH RECURSIVE {_CHAIN}, n AS (SELECT chain, max(sequence) AS n FROM h GROUP BY 1), x AS (SELECT chain, n, CASE WHEN chain % 5 = 1 AND n >= 3 THEN 3 WHEN chain % 5 = 2 AND n >= 5 THEN 5 WHEN chain % 5 = 3 AND n >= 2 THEN 2 END AS broken, CASE WHEN chain % 5 = 1 THEN 2 WHEN chain % 5 = 2 THEN 3 WHEN chain % 5 = 3 THEN 1 END AS good FROM n)
SELECT x.chain, broken IS NULL AS intact, CASE WHEN broken IS NULL THEN n - CASE WHEN chain % 5 = 2 AND n = 4 THEN 1 ELSE 0 END ELSE good END AS events_checked, (SELECT event_hash FROM h WHERE h.chain = x.chain AND h.sequence = CASE WHEN broken IS NULL THEN n - CASE WHEN x.chain % 5 = 2 AND n = 4 THEN 1 ELSE 0 END ELSE good END) AS head_hash, broken AS first_broken_sequence,
CASE WHEN broken IS NULL THEN NULL WHEN chain % 5 = 1 THEN 'event contents do not match its recorded hash' WHEN chain % 5 = 2 THEN 'expected sequence 4, found 5' ELSE 'link does not match the preceding event''s hash' END AS reason FROM x""")
def verify_chain(s, d):
    return audit.verify(tampered(s, d))


@query(f"WITH RECURSIVE {_CHAIN} SELECT chain, max(sequence) AS sequence, max_by(event_hash, sequence) AS head_hash, count(*) AS events FROM h GROUP BY 1")
def chain_head(s, d):
    return audit.heads(audit.chained(tables.audit_events(s, d)))


@query(f"SELECT chain, sequence, action, actor FROM ({_EVENTS}) WHERE case_id = 'c3' ORDER BY sequence, chain LIMIT 200 OFFSET 20")
def audit_page(s, d):
    return audit.page(tables.audit_events(s, d), 20, 200, case_id="c3").select("chain", "sequence", "action", "actor")
