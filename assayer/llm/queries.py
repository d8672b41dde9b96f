"""The queries of this folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, decontamination, lexical, media, neighbours, packing, phrases, pii, quality, sharding, simhash, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1,
    "op2_neighbour_quality": quality.op2,
    "op3_media_columns": media.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_toxicity": toxicity.op5,
    "op6_pii_pseudonyms": pii.op6,
    "op7_balanced_shards": sharding.op7,
    "op8_warc_zip": warc.op8,
    "op9_learned_partitions": neighbours.op9,
    "op10_simhash": simhash.op10,
    "op11_phrases": phrases.op11,
    "op12_lexical_search": lexical.op12,
    "op13_decontamination": decontamination.op13,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL for those that it can express; a digest's base 32 is spelled out from its bits.
ORACLE: dict[str, str] = {
    "op8_warc_zip": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last, sha1(payload) AS hex FROM p),
b AS (SELECT *, array_to_string([lpad(bin(('0x' || hex[k])::INT), 4, '0') FOR k IN range(1, 41)], '') AS bits FROM r)
SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ('0b' || bits[5 * i + 1 : 5 * i + 5])::INT] FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b""",
    "op11_phrases": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS ws FROM p), one AS (SELECT lang, unnest(ws) AS phrase FROM w),
many AS (SELECT lang, unnest(flatten([[array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)] FOR k IN [2, 3]])) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM (FROM one UNION ALL FROM many) GROUP BY ALL HAVING count(*) >= 10), n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM f)),
s AS (SELECT c.lang, c.phrase, a, h.f AS l, t.f AS r, k, (1000000::HUGEINT * a * a // (h.f::HUGEINT * t.f))::BIGINT AS score FROM c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase, f FROM f WHERE len(ws) = 3), x AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000""",
    "op12_lexical_search": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
i AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0), f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(many * w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * nn // ll))))::BIGINT AS score FROM i JOIN w USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op13_decontamination": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS d, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, len, array_to_string(w[s : s + len - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - len + 2)) AS s FROM (SELECT *, least(len(w), 10) AS len FROM i WHERE len(w) > 0))),
r AS (SELECT d, len, s, array_to_string(w[s : s + len - 1], ' ') AS run FROM (SELECT d, w, len, unnest(range(1, len(w) - len + 2)) AS s FROM d, (SELECT DISTINCT len FROM x))),
h AS (SELECT d, item_id, s, r.len FROM r JOIN x ON x.run = r.run AND x.len = r.len),
n AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(s, s + len)) AS p FROM h) GROUP BY d), t AS (SELECT d, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT d, item_id FROM h) GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (d) LEFT JOIN t USING (d)""",
}
