"""Operator 5 beside a plain search, on long texts, and what it learns."""

import random
import time

from assayer.llm import toxicity


def plain_spans(lexicon, text):
    """Every term at every word start, unless a phrase at a word start covers it."""
    flat = toxicity.folded(text)
    starts = [i for i in range(len(text)) if i == 0 or not text[i - 1].isalnum()]
    spared = [(i, i + len(p)) for i in starts for p in map(toxicity.folded, lexicon.exceptions) if flat.startswith(p, i)]
    hits = [(i, i + len(t)) for i in starts for t in map(toxicity.folded, lexicon.weights) if flat.startswith(t, i)]
    return sorted(h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared))


def test_matches_are_a_plain_searches():
    rng = random.Random(0)
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 0.5, "tras": 0.25, "can": 0.1}, ("trash can", "an idiot", "trash can of"))
    parts = ["idiot", "trash", "can", "of", "an", "1d10t", "TRASH", "trashy", "x", "idiotic"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "\n", "-"]) for _ in range(rng.randrange(30)))
        assert sorted((a, b) for a, b, _ in lexicon.spans(text)) == plain_spans(lexicon, text)


def test_long_texts_take_time_in_proportion():
    """Ten megabytes of matches and spared phrases."""
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 1.0})
    text = "trash can idiot word " * 500_000
    began = time.time()
    assert len(lexicon.spans(text)) == 500_000
    assert time.time() - began < 60


def test_exceptions_are_learned(spark):
    """A word that is an insult, but for one phrase that other texts use."""
    rng = random.Random(1)
    fill = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(30))
    rows = [(i, f"{fill()} you grumbold {fill()}", 1) for i in range(60)] + [(100 + i, f"{fill()} pickled grumbold {fill()}" if i < 12 else fill(), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "pickled grumbold" in lexicon.exceptions
    assert lexicon.score("a pickled grumbold here") < 0.5 < lexicon.score("you grumbold you")


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "idiot"), (4, "clean " * 100_000)]
    df = spark.createDataFrame([(i, t, "s", "m", 1) for i, t in rows], "doc_id bigint, text string, score string, matches string, id int")
    lexicon = toxicity.Lexicon({"idiot": 1.0}, curve=(-1.0, 4.0, 1.0))
    out = toxicity.reject(df, lexicon).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 4] and {(r.score, r.matches, r.id) for r in out} == {("s", "m", 1)}
    assert toxicity.reject(df.limit(0), lexicon).count() == 0 and toxicity.score(df, lexicon).count() == 6
    none = toxicity.learn(df, df.selectExpr("doc_id", "cast(null as int) as toxic"))
    assert none.weights.keys() == set(toxicity.SEED)


def test_decomposed_accents_fold():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.SEED, 1.0))
    assert [len(lexicon.spans(toxicity.visible(t))) for t in ("you idi\u00f3t", "you idio\u0301t", "you i\u0307d\u0308iot", "e\u0301te\u0301")] == [1, 1, 1, 0]
