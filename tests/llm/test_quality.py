"""Operator 2 beside a plain vote, and on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import quality
from assayer.llm.common import held_out, table


def test_the_vote_is_a_plain_one(spark, data):
    """Every document's score from cosines with all labelled vectors, one document at a time."""
    docs = table(spark, data, "documents")
    space = quality.learn(docs, table(spark, data, "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.score(docs, space).collect():
        x = np.log1p(1000 * quality.terms(texts[r.doc_id]).astype(np.float64)) * space.weight
        v = (x / max(np.linalg.norm(x), 1e-12)) @ space.axes
        cosine = space.voters @ (v / max(np.linalg.norm(v), 1e-12))
        near = np.sort(np.argsort(-cosine, kind="stable")[: quality.NEAREST])
        w = np.maximum(cosine[near], 0) ** quality.POWER
        assert abs(r.score - ((w * space.labels[near]).sum() / w.sum() if w.sum() > 1e-9 else space.labels.mean())) < 1e-3


def test_frequencies_count_all_documents(spark, data):
    docs = table(spark, data, "documents")
    n, has = quality.frequencies(docs.repartition(5), "text")
    assert n == docs.count() and (has == sum((quality.terms(r.text or "") > 0).astype(int) for r in docs.collect())).all()


def test_letters_count():
    """Texts of one layout and other words differ; spans of a long text add up to the whole."""
    a, b = quality.terms("the cat sat on the mat."), quality.terms("xqz kvw jjj zz qqq www.")
    assert not np.allclose(a, b)


def test_spans_change_nothing(monkeypatch):
    text = "Some words, and MORE words; 123 naïve 日本. " * 50
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "SPAN", 37)
    assert np.allclose(quality.terms(text), whole, atol=1e-5)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "good text here and there " * (1 + i % 5) if i % 2 else "!!! ### " * (3 + i % 7), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    wrong = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - labels["quality"]).otherwise(labels["quality"]))
    one, two = (sorted((r.doc_id, r.score) for r in quality.score(docs, quality.learn(docs, x)).collect()) for x in (labels, wrong))
    assert one == two


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "good words"), (3, "good words"), (None, "good words"), (4, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, "s", "y", 1) for i, t in rows], "doc_id bigint, text string, score string, y string, id int")
    space = quality.learn(df, spark.createDataFrame([(3, 1), (3, 1), (4, 0), (1, None)], "doc_id bigint, quality int"))
    scores = quality.score(df, space).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in scores if r.doc_id in (1, 2)} == {space.labels.mean() if len(space.labels) else 0.5}
    assert set(quality.keep(df, space).columns) == set(df.columns) and quality.keep(df.limit(0), space).count() == 0
