"""Operator 12 beside all scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from assayer.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [(i, c, c.total()) for i, c in counts if c]
    n_docs, length = len(sizes), sum(n for _, _, n in sizes)
    df = Counter(t for _, c, _ in sizes for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in sizes:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    d = spark.createDataFrame([(*r, 1, "x", 2.0) for r in docs], "doc_id bigint, text string, row int, terms string, norm double").repartition(5)
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id string, text string, item int")
    return sorted((tuple(r) for r in lexical.search(d, i, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("bucket", [3, 1024])
def test_beside_all_scores(spark, monkeypatch, bucket):
    """Rare and frequent words, groups of copies, several blocks of items, small buckets and a small head."""
    rng = random.Random(bucket)
    words = [f"w{i}" for i in range(200)] + ["É", "日本"]
    text = lambda n: " ".join(words[min(len(words) - 1, int(rng.expovariate(0.03)))] + rng.choice(["", "", ".", "-X_9"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)] + [(5000, None), (5001, ""), (5002, "..."), (None, docs[7][1]), (7, docs[7][1])]
    items = [(f"q{i}", text(rng.randrange(1, 40))) for i in range(25)] + [("copy", docs[7][1]), ("none", None), ("marks", "?!"), ("unknown", "zzz"), ("twice", "w0 W0 w3 w3 w3")]
    for name, value in (("BUCKET", bucket), ("ITEMS", 11), ("HEAD", 20), ("RANGE", 60), ("FOCUS", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert found(spark, docs, items) == plain(docs, items, 20)
    assert found(spark, docs[:3], items[:4], 5) == plain(docs[:3], items[:4], 5)


def test_pruning_leaves_buckets_out(spark, monkeypatch):
    """An item of short vectors stops at the bucket whose lengths can't reach its 20th best."""
    import numpy as np
    import pyarrow as pa

    items = lexical.Items([{0: 1}], np.array([10]))
    best = lexical.Best(2, np.array([1]))
    batch = lambda value, ids: pa.RecordBatch.from_pydict({"norm": pa.array([float(value)] * 2), "row": pa.array(ids), "id": pa.array(ids), "terms": pa.array([[0], [0]], pa.list_(pa.int32())), "impacts": pa.array([[value], [value]], pa.list_(pa.int32()))})
    assert items.search(batch(50, [1, 2]), best) and best.least[0] == 500
    assert not items.search(batch(40, [3, 4]), best)
    assert best.held[0][2].tolist() == [1, 2]


def test_long_texts_and_empty_tables(spark):
    docs = [(1, "word " * 300_000), (2, "word"), (3, "other")]
    assert found(spark, docs, [("a", "word"), ("a", "other")]) == plain(docs, [("a", "word"), ("a", "other")], 20)
    assert found(spark, docs, []) == [] == found(spark, [], [("a", "word")]) == found(spark, [(1, None)], [("a", "word")])
