"""Operator 6 beside a plain search and plain checks, and its permutations' formats."""

import datetime
import re

import pytest

from assayer.llm import pii


def pseudonyms(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.pseudonyms(rows, key).orderBy("doc_id").collect()]


@pytest.mark.parametrize("layout", ["%Y-%m-%d", "%d.%m.%Y"])
def test_dates_are_permuted_within_their_years(spark, layout):
    """All days of the last year and some of the first: every pseudonym is a day from 1900 to 2099, no two are equal."""
    days = [datetime.date(2099, 1, 1) + datetime.timedelta(days=i) for i in range(365)] + [datetime.date(1900, 1, 1) + datetime.timedelta(days=i) for i in range(100)]
    out = pseudonyms(spark, [d.strftime(layout) for d in days])
    back = [datetime.datetime.strptime(x, layout).date() for x in out]
    assert all(1900 <= d.year <= 2099 for d in back) and len(set(back)) == len(days) and back != days
    assert pseudonyms(spark, ["2099-02-29", "31.02.2024"]) == ["2099-02-29", "31.02.2024"]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def account(text):
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_cards_accounts_and_phones(spark):
    out = pseudonyms(spark, ["3782 822463 10005", "378282246310005", "378282246310006", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00", "(212) 555-0100", "212-555-0100", "112-555-0100"])
    assert re.fullmatch(r"37\d\d \d{6} \d{5}", out[0]) and luhn(out[0].replace(" ", "")) and out[0].replace(" ", "") == out[1] != "378282246310005"
    assert out[2] == "378282246310006" and out[5] == "DE88 3704 0044 0532 0130 00" and out[8] == "112-555-0100"
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", out[3]) and account(out[3]) and out[3] != "DE89 3704 0044 0532 0130 00"
    assert re.fullmatch(r"GB\d\dWEST\d{14}", out[4]) and account(out[4])
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", out[6]) and re.sub(r"\D", "", out[6]) == re.sub(r"\D", "", out[7]) != "2125550100"


def test_the_key_decides(spark):
    text = ["call +1 (212) 555-0100"]
    assert pseudonyms(spark, text, "a") == pseudonyms(spark, text, "a") != pseudonyms(spark, text, "b")
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) == 64
    spark.conf.set(pii.CONF, "own")
    try:
        assert pii.key_of(spark) == "own"
    finally:
        spark.conf.unset(pii.CONF)


def test_what_is_found_beside_a_plain_search(spark, data):
    """Every document: the values that changed are those that Python's own search and checks find."""
    from assayer.llm.common import table

    def valid(v):
        digits = re.sub(r"\D", "", v)
        if "@" in v or re.fullmatch(pii.IP, v) or re.fullmatch(pii.PHONE, v) or re.fullmatch(pii.SSN, v) or re.fullmatch(pii.LOCAL, v):
            return True
        if re.fullmatch(pii.CARD, v) or re.fullmatch(pii.SHORT, v):
            return luhn(digits)
        if re.fullmatch(pii.DATE, v) or re.fullmatch(pii.DOTTED, v):
            return True
        return account(v) if re.fullmatch(pii.IBAN, v) else True

    secret = re.compile(r'\b(?:token|secret|password|api_key|apikey) ?[=:] ?"([A-Za-z0-9+/_-]{16,})(?=")')
    plain = pii.ANY.rpartition("|" + pii.SECRET)[0].replace(r"\2", r"\1").replace(r"\3", r"\2")
    docs = {r.doc_id: r.text or "" for r in table(spark, data, "documents").collect()}
    some = 0
    for r in pii.pseudonyms(table(spark, data, "documents"), "k").collect():
        expected = sum(valid(m.group()) for m in re.finditer(plain, docs[r.doc_id], re.ASCII)) + len(secret.findall(docs[r.doc_id]))
        assert r.n_replaced == expected, docs[r.doc_id][:200]
        some += expected > 0
    assert some > 10


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "1.2.3.4 " * 20_000), (3, "1.2.3.4"), (None, "1.2.3.4")]
    df = spark.createDataFrame([(i, t, "f", "o", 3) for i, t in rows], "doc_id int, text string, found string, out string, n_replaced int")
    out = pii.replace(df, "k").collect()
    assert [(r.found, r.out, r.n_replaced) for r in out] == [("f", "o", 3)] * 5 and out[2].text.split() == [out[3].text] * 20_000 and out[4].text == out[3].text
    assert pii.replace(df.limit(0), "k").count() == 0
