"""Operator 1's bound on what goes up, long texts and clashing names."""

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["large", "small", "mixed"])
def test_what_stays_below_would_not_be_used(spark, monkeypatch, kind):
    """As many sequences with a bound of a few bins as without any, also where most bins are little more than half full."""
    rng = np.random.default_rng(0)
    size = {"large": lambda: rng.integers(1030, 2040), "small": lambda: rng.integers(1, 400), "mixed": lambda: rng.choice([rng.integers(1, 300), rng.integers(1000, 1400)])}[kind]
    docs = spark.createDataFrame([(i, "a " * int(size())) for i in range(1200)], "doc_id bigint, text string").repartition(16)
    bins = []
    for carry in (packing.FAN, 10**9):
        monkeypatch.setattr(packing, "CARRY", carry)
        rows = packing.pack(docs, PATH).collect()
        fill = {}
        for r in sorted(rows, key=lambda r: r.offset):
            assert fill.get(r.sequence_id, 0) == r.offset
            fill[r.sequence_id] = r.offset + r.length
        assert max(fill.values()) <= 2048
        bins.append(len(fill))
    assert bins[0] == bins[1]


def test_one_bin_at_most_is_half_full():
    rng = np.random.default_rng(1)
    for _ in range(50):
        _, _, fill = packing.best_fit(rng.integers(1, 2049, rng.integers(1, 400)), 2048)
        assert sum(f <= 1024 for f in fill) <= 1


def test_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 400_000), (2, None), (None, "x"), (3, "y"), (3, "y")]
    names = "doc_id bigint, text string, id int, bin int, fill int, up int, node int, piece int, offset int, sequence_id int"
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], names).repartition(3)
    out = packing.pack(df, PATH).collect()
    pieces = sorted(r.piece for r in out if r.doc_id == 1)
    assert pieces == list(range(-(-400_001 // 2048))) and sum(r.length for r in out) == 400_001 + 1 + 2 + 2 + 2
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["bin", "shift", "from_bin", "to_bin", "fill", "up", "node"])
def test_the_id_may_have_any_name(spark, name):
    """Names that the rounds use inside, in a table of several tasks."""
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(40)], f"{name} bigint, text string").repartition(3)
    out = packing.pack(df, PATH, id_col=name)
    rows = out.collect()
    assert out.columns[0] == name and sorted(r[0] for r in rows) == list(range(40)) and len({r.sequence_id for r in rows}) == 2


def test_ids_are_the_tokenizers_own():
    """Texts that spell out special tokens, also beside letters, marks and one another."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|><|endoftext|>.b", "<|ENDOFTEXT|> <|endoftext|", "x.<|startoftext|>,É", "<|endoftext|>\n\n", "", "<|endo\u0301ftext|>"]
    ids = [np.frombuffer(b, "<u4").tolist() for b in packing.WordIds.of(PATH).encode(texts)]
    assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in ids[0] and 49407 not in np.frombuffer(packing.WordIds.of(PATH, plain=True).encode(texts[:1])[0], "<u4")
