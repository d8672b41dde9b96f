"""Every stage on what the one before it kept, beside plain versions."""

import random

import numpy as np

import corpus_pipeline
from assayer.llm import nearcopies, pii, quality, toxicity
from assayer.llm.common import stored, table


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, seen = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, before, data), name)
        assert out.columns == columns
        rows, kept = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            lexicon = toxicity.learn(before, table(spark, data, "labels"))
            assert kept.keys() == {i for i, t in rows.items() if lexicon.score(t or "") < 0.5}
        elif name == "quality":
            space = quality.learn(before, table(spark, data, "labels"))
            ids = sorted(rows)
            assert kept.keys() == {i for i, x in zip(ids, space.score([rows[i] or "" for i in ids]), strict=True) if x >= quality.KEEP}
        elif name == "near_dedup":
            runs = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})((t or "").lower().split()) for i, t in rows.items()}
            for i in rows.keys() - kept.keys():
                assert any(j < i and len(runs[i] & runs[j]) / len(runs[i] | runs[j]) > 0.6 for j in rows)
            texts = [rows[i] for i in kept]
            assert len(set(texts)) == len(texts)
        else:
            assert kept.keys() == rows.keys()
            expected = {r.doc_id: r.text for r in pii.pseudonyms(before, pii.key_of(spark)).collect()}
            assert kept == expected
        assert set(kept) <= set(rows)
        before = out
        seen.append(len(kept))
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.select("doc_id").collect()}
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0


def test_near_copies(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(400)] for _ in range(40)]
    rows, of = [], {}
    for i, b in enumerate(base):
        rows.append((10 * i, " ".join(b)))
        rows.append((10 * i + 1, " ".join(b)))
        for k in (2, 3):
            near = list(b)
            for at in rng.sample(range(400), 4):
                near[at] = word()
            rows.append((10 * i + k, " ".join(near)))
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "one two"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()}
    assert all(of[10 * i + k] == 10 * i for i in range(40) for k in range(4))
    assert (of[9000], of[9001], of[9002], of[9003]) == (9000, 9000, 9002, 9002)
    assert {r.doc_id for r in nearcopies.dedupe(df).collect()} == {*range(0, 400, 10), 9000, 9002, None}
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def test_near_copies_in_a_crowd(spark, monkeypatch):
    from assayer.llm import nearcopies as module

    monkeypatch.setattr(module, "CROWD", 8)
    base = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(i, base + f" end{i}") for i in range(60)], "doc_id bigint, text string")
    assert {r.component_id for r in nearcopies.near_copies(df).collect()} == {0}


def edited_families(rng, families, edits, length=200):
    """Texts by id, and the ids of each family: a text and edited versions of it."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, of = {}, []
    for f in range(families):
        base = [word() for _ in range(length)]
        of.append([])
        for k in range(1 + edits):
            own = list(base)
            for at in rng.sample(range(length), rng.randrange(1, 9)) if k else []:
                own[at] = word()
            texts[10_000 + 100 * f + k] = " ".join(own)
            of[-1].append(10_000 + 100 * f + k)
    return texts, of


def by_brute_force(texts, family):
    """The pairs of a family at 0.8 or more, and the least id that each of it reaches by them."""
    runs = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(texts[i].split()) for i in family}
    pairs = [(a, b) for a in family for b in family if a < b and 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])]
    least = {i: i for i in family}
    for _ in family:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return pairs, least


def test_near_copies_are_confirmed(spark):
    """No link below 0.8; of the pairs at 0.8 or more, 98 % at least are found."""
    texts, families = edited_families(random.Random(3), 40, 5)
    crowd, more = edited_families(random.Random(4), 1, 40)
    texts, families = texts | {i - 10_000: t for i, t in crowd.items()}, families + [[i - 10_000 for i in more[0]]]
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()}
    met = total = 0
    for family in families:
        pairs, least = by_brute_force(texts, family)
        assert all(least[i] == least[got[i]] for i in family)
        met, total = met + sum(got[a] == got[b] for a, b in pairs), total + len(pairs)
    assert total > 250 and met >= 0.98 * total


def test_a_repeated_line_makes_no_copies(spark):
    rng = random.Random(5)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100))
    line = "all rights reserved by the owner of this "
    df = spark.createDataFrame([(i, line * 60 + own()) for i in range(30)], "doc_id bigint, text string")
    assert nearcopies.dedupe(df).count() == 30


def test_buckets_are_met_at_any_size():
    """Sets of similarity 0.8 exactly share a bucket in 99.5 % of cases at least; buckets do not depend on the table."""
    rng = np.random.default_rng(0)
    for shared, own in ((80, 10), (8, 1), (4, 0.5), (4000, 500)):
        met, tries = 0, 200 if shared > 1000 else 2000
        for _ in range(tries):
            h = rng.integers(0, 2**64, int(shared + 2 * own), np.uint64)
            a, b = np.sort(h[: int(shared + own)]), np.sort(np.concatenate([h[:shared], h[int(shared + own) :]]))
            met += bool((nearcopies.buckets(a) == nearcopies.buckets(b)).any()) and int(np.bitwise_count(nearcopies.long_fingerprint(a) ^ nearcopies.long_fingerprint(b)).sum()) <= nearcopies.LIMIT
        assert met >= 0.995 * tries, (shared, met)


def test_the_stage_uses_the_gray_order_index(spark, monkeypatch):
    """Operator 10's forest over several words connects what brute force does, and the stage calls it."""
    from assayer.llm import simhash

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (30, 8), np.uint64)
    fps = np.concatenate([base, *[base ^ (rng.integers(0, 2**64, base.shape, np.uint64) & rng.integers(0, 2**64, base.shape, np.uint64) & rng.integers(0, 2**64, base.shape, np.uint64)) for _ in range(9)]])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int64) <= 100
    reach = near.copy()
    for _ in range(9):
        reach = reach @ reach
    found = simhash.forest(fps, 100)
    assert all(near[a, b] for a, b in found)
    assert len(found) == len(fps) - len({tuple(r) for r in reach})
    order = simhash.gray_order(np.array([[a, b] for a in range(4) for b in (0, 1 << 63)], np.uint64))
    whole = [int(f"{a:064b}{b:064b}", 2) for a in range(4) for b in (0, 1 << 63)]
    rank = lambda x: x if not x else x ^ rank(x >> 1)
    assert order.tolist() == sorted(range(8), key=lambda k: rank(whole[k]))
    used = []
    forests = nearcopies.forests
    monkeypatch.setattr(nearcopies, "forests", lambda rows, bits: used.append(bits) or forests(rows, bits))
    nearcopies.near_copies(spark.createDataFrame([(1, "a b"), (2, "a b c")], "doc_id bigint, text string"))
    assert used == [nearcopies.LIMIT]
