"""Operator 8 on repeated ids, nulls and clashing names."""

import base64
import hashlib

from assayer.llm import common, warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def read_back(spark, rows, names="page_id bigint, url string, html string"):
    folder = common.new_path(spark, "warc")
    df = spark.createDataFrame(rows, names).repartition(3)
    return sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to, (r.payload or b"").decode()) for r in warc.read(warc.write(df, folder), folder).collect()), key=lambda r: (r[0] is None, *map(str, r)))


def test_an_id_with_two_payloads(spark):
    got = read_back(spark, [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (2, "u", "b")])
    assert got == sorted([(1, digest("a"), "revisit", 2, ""), (1, digest("b"), "revisit", 2, ""), (2, digest("a"), "response", None, "a"), (2, digest("b"), "response", None, "b")])


def test_nulls_repeats_and_odd_urls(spark):
    rows = [(1, None, None), (2, "a\r\nb", ""), (3, "u", "x"), (3, "u", "x"), (None, "u", "x"), (4, "u", "é" * 100_000)]
    assert read_back(spark, rows) == [(1, digest(""), "revisit", 2, ""), (2, digest(""), "response", None, ""), (3, digest("x"), "response", None, "x"), (3, digest("x"), "response", None, "x"), (4, digest("é" * 100_000), "response", None, "é" * 100_000), (None, digest("x"), "response", None, "x")]


def test_an_empty_table(spark):
    assert read_back(spark, []) == []


def test_clashing_names(spark):
    names = "page_id bigint, url string, html string, id bigint, payload string, digest string, kind string, refers_to bigint, n bigint, last bigint"
    more = (8, "p", "d", "k", 5, 6, 7)
    assert read_back(spark, [(i, "u", "same", *more) for i in range(4)], names) == sorted((i, digest("same"), "response" if i == 3 else "revisit", None if i == 3 else 3, "same" if i == 3 else "") for i in range(4))


def test_a_frequent_payload_is_no_hot_key(spark, monkeypatch):
    """Two thirds of the rows share a payload; the result is the same with and without the broadcast of frequent ones."""
    rows = [(i, "u", "hot" if i % 3 else f"p{i // 2}") for i in range(90)]
    expected = read_back(spark, rows)
    monkeypatch.setattr(common, "HEAVY", 1)
    assert read_back(spark, rows) == expected
    assert [x for x in expected if x[4] == "hot"] == [(89, digest("hot"), "response", None, "hot")]
