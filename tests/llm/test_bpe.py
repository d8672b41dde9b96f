"""Operator 4 on long matches and odd rows, beside tiktoken."""

import base64
import random
import time

import numpy as np
import public_tokenizers
import tiktoken

from assayer.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_matches_are_tiktokens():
    """Single matches around the length from which lists hold the tree, of few letters (many ties) and of many."""
    codec, ref, rng = bpe.Codec.of(PATH, PATTERN), reference(), random.Random(0)
    for n in (2, 3, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 2 * bpe.LONG, 5000):
        for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "aé日"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert list(memoryview(codec.merge_long(text.encode())).cast("i")) == ref.encode_ordinary(text), (n, letters)
            assert list(memoryview(codec.encode([text])[0]).cast("i")) == ref.encode_ordinary(text)


def test_a_long_match_takes_seconds():
    codec, rng = bpe.Codec.of(PATH, PATTERN), random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.time()
    ids = codec.encode([text])[0]
    assert codec.decode(np.frombuffer(ids, "<i4")) == text.encode() and time.time() - began < 60


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "no id"), (4, "z" * 20_000 + " end")]
    df = spark.createDataFrame([(i, t, 1, "i") for i, t in rows], "doc_id bigint, text string, id int, ids string")
    ref = reference()
    out = bpe.encode(df, PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in out) == sorted((i or 0, ref.encode_ordinary(t or "")) for i, t in rows)
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
