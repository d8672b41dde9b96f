"""Operator 6: values that a failed candidate hides, and words without a break."""

import time

import pytest

from assayer.llm import pii

HIDDEN = [
    "BE68539007547034 EUR",
    "BE68 5390 0754 7034 EUR 500",
    "pay BE68539007547034 NOW please",
    "ES9121000418450200051332 PAID",
    "ref AB12 4111 1111 1111 1111",
    "BE12 4111 1111 1111 1111",
    "1234 4111 1111 1111 1111",
    "DE12 BE68 5390 0754 7034 EUR1 23",
    "see DE00 1234 1234 1234 4111 1111 1111 1111 and more",
]


def pseudonyms(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r.text, r.n_replaced) for r in pii.pseudonyms(rows, key).orderBy("doc_id").collect()]


def test_no_valid_value_stays(spark):
    out = pseudonyms(spark, HIDDEN)
    for text, (new, n) in zip(HIDDEN, out, strict=True):
        assert n == 1 and new != text and len(new) == len(text), (text, new)
        assert "4111 1111 1111 1111" not in new and "7034" not in new.replace(" ", "") and "0005133" not in new
    whole = pseudonyms(spark, ["BE68539007547034", "BE68 5390 0754 7034"])
    assert out[0][0].split()[0] == whole[0][0] and whole[1][0].replace(" ", "") == whole[0][0]
    assert out[7][0].startswith("DE12 " + whole[1][0]) and out[7][0].endswith(" EUR1 23")


def test_what_fails_and_odd_marks_stay(spark):
    kept = ["BE68539007547035 EUR", "1234567890123456", "1234 5678 9012 3456 7890 1234", "12345678901234567", "a\u0001b\u0002c\u0003d\u0004e\u0002a 12", "..@..", "2024-02-31 and 31.02.2024"]
    assert pseudonyms(spark, kept) == [(t, 0) for t in kept]
    mixed = "\u0003\u0004 4111 1111 1111 1111\u0002b ..x.y@a.example"
    (new, n), (alone, _), (mail, _) = pseudonyms(spark, [mixed, "4111 1111 1111 1111", "x.y@a.example"])
    assert n == 2 and new == f"\u0003\u0004 {alone}\u0002b ..{mail}"


@pytest.mark.parametrize("word", ["aB3", "a.", "a@", "4111 ", "DE12 ", "1.", "a@b."])
def test_a_megabyte_without_a_break(spark, word):
    began = time.time()
    text = word * (1_000_000 // len(word))
    [(new, _)] = pseudonyms(spark, [text])
    assert time.time() - began < 60
    if word not in ("4111 ", "a@b."):
        assert new == text
