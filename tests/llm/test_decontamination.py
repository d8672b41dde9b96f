"""Operator 13 beside a plain search for windows."""

import random
import re

import pytest

from assayer.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for run, of in windows.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    own |= of
        out.append((doc, len(w), len(hit), sorted(str(x) for x in own if x is not None), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id bigint, text string, w string, h int, row int").repartition(4)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id bigint, text string, window int")
    return sorted((tuple(r) for r in decontamination.contamination(d, i).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()), key=str)


@pytest.mark.parametrize("block", [5, 500_000])
def test_beside_a_plain_search(spark, monkeypatch, block):
    """Items of 1 to 30 words that share passages, documents with whole, cut, changed, overlapping and repeated passages; several scans, and joins without broadcast."""
    rng = random.Random(block)
    some = [f"w{i}" for i in range(12)] + ["Été", "日本", "A1", "ÉTÉ"]
    text = lambda n: " ".join(rng.choice(some) + rng.choice(["", "", ",", ".\n", " -"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 7, 10, 11, 30]) if i % 4 else 24)) for i in range(24)]
    items += [(100, items[0][1]), (101, items[0][1].upper() + " " + items[4][1]), (102, None), (103, "..."), (None, items[8][1]), (8, items[8][1])]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(3)
            parts += [" ".join(w[a : len(w) - rng.randrange(3)]), text(rng.randrange(4))]
        docs.append((i, " ".join(parts)))
    docs += [(500 + i, items[4][1]) for i in range(60)] + [(900, None), (901, ""), (902, "w1"), (None, items[4][1]), (3, docs[3][1]), (903, (items[4][1] + " ") * 40)]
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "WINDOWS", 3 if block == 5 else 100_000)
    if block == 5:
        items = [x for x in items if x[1] and len(words(x[1])) > 9][:6]
    assert found(spark, docs, items) == plain(docs, items)


def test_long_texts_and_empty_tables(spark):
    item = " ".join(f"i{k}" for k in range(25))
    docs = [(1, "x " * 200_000 + item + " y" * 100), (2, "ΑΣ ΣΑ " + "É" * 5)]
    assert found(spark, docs, [(1, item)]) == plain(docs, [(1, item)])
    assert found(spark, docs, []) == plain(docs, []) and found(spark, [], [(1, item)]) == []


def test_no_python_in_the_plan(spark, data):
    assert not re.search("Python|Pandas|Arrow", decontamination.op13(spark, data)._jdf.queryExecution().toString())
