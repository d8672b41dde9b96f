"""Operator 11 beside plain counting, its tries beside a dictionary, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import phrases


def plain(rows, least, top, longest=3):
    """(lang, rank, phrase, a, l, r, n, score) by loops over all words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in kept.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        inside = any(100 * b >= 50 * a for (x, q), b in kept.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang in {x[0] for x in out}:
        for i, (_, score, a, p, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top]):
            ranked.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def found(df, **kw):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **kw).collect())


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (4, 7)])
def test_beside_plain_counting(spark, monkeypatch, longest, top):
    """Many shards, scans and short runs; pieces, blanks and tabs, other scripts, hot words."""
    rng = random.Random(0)
    words = ["The", "of", "a", "É", "naïve", "日本", "x1", "w-w", "😀", *[f"w{i}" for i in range(30)]]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice([4, 39])]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ? ", "\r\n", "\x0b"]) for _ in range(rng.randrange(120)))) for _ in range(60)]
    rows += [("en", "hot hot hot " * 50)] * 20 + [("en", None), (None, ""), ("en", " . "), ("fr", "lone words here")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "lang string, text string, h int, phrase string, f int").repartition(3)
    for name, value in (("SHARD", 40), ("AT_ONCE", 2), ("HELD", 100), ("WORDS", 50), ("BLOCK", 16), ("FAN", 2)):
        monkeypatch.setattr(phrases, name, value)
    assert found(df, longest=longest, least=4, top=top) == plain(rows, 4, top, longest) != []


def test_a_collision_keeps_a_phrase(spark, monkeypatch):
    """With hashes of four bits all phrases collide; the result is the same."""
    own = phrases.mixed
    monkeypatch.setattr(phrases, "mixed", lambda x: own(x) & np.uint64(15))
    rows = [("en", "a b c a b d a b c e f"), ("en", "a b c"), ("de", "a b c a b c")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    words = phrases.Words(["en"], [b"a b c a b d"])
    h = words.phrases(2, None)[1]
    assert len(set(h.tolist())) <= 16 and [words.bytes[words.starts[i] : words.ends[i + 1]].tobytes() for i in words.first(np.arange(5), 2, np.zeros(5, np.int64))] == [b"a b", b"b c", b"c a", b"b d"]
    monkeypatch.undo()
    assert found(df, least=2) == plain(rows, 2, 2000)


def test_tries_beside_a_dictionary():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab \xc3\x00\xff") for _ in range(rng.randint(1, 14))).replace(b"\n", b"") + b"\n" for _ in range(3000)} | {b"a" * 5000 + b"\n", b"a" * 5000 + b"b\n"})
    trie = phrases.DoubleArray.build(keys)
    for i, k in enumerate(keys):
        assert trie.cells[trie.follow(0, k), 0] == -1 - i
    assert trie.follow(0, b"zzz") == -1 and phrases.DoubleArray.build([b"a\n"]).follow(0, b"a\n") > 0


def test_runs_are_cut_where_pieces_end(monkeypatch):
    """The same words, languages and pieces, in runs of a few bytes or in one."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["Ab", "é", "c1"]) + rng.choice([" ", ". ", "\t"]) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, "", "x" * 300]
    batch = pa.RecordBatch.from_pydict({"lang": [rng.choice("ab") for _ in texts], "text": texts})

    def seen():
        return [(w.langs[k], w.bytes[a:b].tobytes(), bool(on)) for run in phrases.runs(batch) for w in [phrases.Words(*run)] for k, a, b, on in zip(w.lang, w.starts, w.ends, w.on, strict=True)]

    whole = seen()
    monkeypatch.setattr(phrases, "RUN", 50)
    assert seen() == whole and len(whole) > 500 and len(list(phrases.runs(batch))) > 20


def test_long_texts_ties_and_empty_tables(spark):
    long = "alpha beta gamma. " * 5000 + "word " * 3000
    rows = [("en", long), ("en", "x y. y x. " * 12), ("en", "A" * 200_000 + " b. " + "a" * 200_000 + " b")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df) == plain(rows, 10, 2000)
    empty = df.limit(0)
    assert found(empty) == [] == found(spark.createDataFrame([("en", "a b")], "lang string, text string"))
