"""The numbered operators against brute force, round trips and odd inputs."""

import base64
import hashlib
import io
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import bpe, media, neighbours, packing, pii, quality, sharding, simhash, toxicity, warc
from assayer.llm.common import table

ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "word " * 30000), (5, "naïve 日本 😀\u0001\u0002\t\n"), (None, "no id"), (6, "a" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated rows and a column that operators might use themselves."""
    return spark.createDataFrame([(i, t, 9, "k") for i, t in ODD], "doc_id bigint, text string, score int, bin string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score int")


def texts(spark, data):
    return {r.doc_id: r.text or "" for r in table(spark, data, "documents").select("doc_id", "text").collect()}


def test_op1_is_whole_and_tight(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, docs = packing.op1(spark, data).collect(), texts(spark, data)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for doc, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[doc], key=lambda r: r.piece):
            part = ids[at : at + 2048]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
            at += len(part)
        assert at == len(ids)
        total += len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1.02 * -(-total // 2048) + 1


def test_op1_tree_of_many_tasks(spark, odd):
    many = odd.union(spark.createDataFrame([(100 + i, "ab cd " * (i % 700), 0, "") for i in range(900)], odd.schema)).repartition(20)
    rows = packing.pack(many, public_tokenizers.path("word_bpe_49k.json")).collect()
    one = packing.pack(many.coalesce(1), public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in rows) == sum(r.length for r in one.collect())
    assert len({r.sequence_id for r in rows}) <= 1.03 * one.select("sequence_id").distinct().count() + 1
    fill = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "again " * 3000)], "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.sequences(packing.pack(docs, path), docs, path).collect()
    assert max(len(r.ids) for r in out) <= 2048 and sum(len(r.ids) for r in out) == 3 + 3001


def test_op2_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    scored = quality.op2(spark, data).join(table(spark, data, "labels"), "doc_id").where("held_out").collect()
    right = [(r.predicted == r.quality) for r in scored]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_op3_round_trip(spark, data):
    docs = texts(spark, data)
    rows = media.op3(spark, data).collect()
    assert len(rows) == len(docs)
    same = {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert same.setdefault(docs[r.doc_id], (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)


def test_op4_is_tiktokens(spark, data):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = texts(spark, data)
    for r in bpe.op4(spark, data).collect():
        ids = t.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_op5_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    scored = toxicity.op5(spark, data).join(table(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.93


def test_op5_folds_and_spares():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 1.0})
    spans = lambda t: [toxicity.folded(toxicity.visible(t)[a:b]) for a, b, _ in lexicon.spans(toxicity.visible(t))]
    assert spans("You 1D10T! іdiоt, ídiot ｉｄｉｏｔ id​iot") == ["idiot"] * 5
    assert spans("the trash can of an unidiotic place") == []
    assert spans("trash$$$ TRASH!!") == ["trash", "trash"]
    assert toxicity.Lexicon({}).spans("idiot") == []


def test_op6_permutes_valid_values(spark):
    cards = ["4111 1111 1111 1111", "4111111111111111", "5500000000000004"]
    rows = [(i, f"pay {c} on 2024-02-29 from 10.0.0.255 ssn 123-45-6789 call +1 (212) 555-0100 a.b@c.org ok") for i, c in enumerate(cards)]
    rows += [(8, "no 4111111111111112 1.2.3 999.1.1.1 2024-13-01"), (9, None), (10, ""), (11, "\u0001 4111111111111111 \u0002b")]
    out = {r.doc_id: r for r in pii.pseudonyms(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    pattern = re.compile(r"pay ([\d ]+) on (\d{4}-\d\d-\d\d) from (\S+) ssn (\d{3}-\d\d-\d{4}) call (\+1 \(\d{3}\) \d{3}-\d{4}) (\S+@\S+) ok")
    a, b, c = (pattern.fullmatch(out[i].text).groups() for i in range(3))
    assert a[0].replace(" ", "") == b[0] != c[0] and a[1:] == b[1:] == c[1:] and a[0] != cards[0]
    luhn = lambda s: sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(s))) % 10
    assert luhn(b[0]) == luhn(c[0]) == 0
    assert a[1] != "2024-02-29" and a[2] != "10.0.0.255" and a[3] != "123-45-6789" and a[4] != "+1 (212) 555-0100"
    assert out[8].text == rows[3][1] and out[9].text is None and out[10].text == "" and out[8].n_replaced == 0
    assert out[11].text == f"\u0001 {b[0]} \u0002b" and out[0].n_replaced == 6


def test_op6_is_a_permutation(spark):
    rows = spark.createDataFrame([(i, f"1.2.{i // 256}.{i % 256}") for i in range(2000)], "doc_id bigint, text string")
    assert pii.pseudonyms(rows, "k").select("text").distinct().count() == 2000


def test_op7_is_balanced_and_gapless(spark, data, odd, empty):
    rows = sharding.op7(spark, data).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    counts = [len(sizes.get(i, [])) for i in range(40)]
    assert max(counts) - min(counts) <= 1
    hot = spark.createDataFrame([(i, "same" if i < 400 else f"t{i}") for i in range(1200)], "doc_id bigint, text string")
    out = sharding.shard(hot, 40).collect()
    assert len(out) == 1200 and len({r.shard for r in out if r.doc_id < 400}) <= 24
    assert len(sharding.shard(odd, 3).collect()) == len(ODD) and sharding.shard(empty).count() == 0


def test_op8_round_trip(spark, data):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, data, "pages").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    for r in warc.op8(spark, data).collect():
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[p] == r.page_id else ("revisit", last[p]))


def test_op8_reads_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"hello")
        with z.open("b.txt", "w", force_zip64=True) as f:
            f.write(b"big")

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    file = File(out.getvalue())
    found = warc.members(file)
    assert {n: file.getvalue()[a : a + k] for n, (a, k) in found.items()} == {"a.txt": b"hello", "b.txt": b"big"}


def test_op9_recall_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 16))
    vectors = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.standard_normal((6000, 16))
    vectors[1000:3000] = vectors[1000]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))] + [(7001, None), (7002, [0.0] * 16), (7020, [float("nan")] * 16), (7040, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = vectors.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len({x for x, _ in got[q]} & set(np.lexsort((np.arange(6000), -np.round(s, 9)))[:20].tolist()))
        assert len(got[q]) == 20 and all(abs(sc - v[x] @ v[q]) < 1e-9 for x, sc in got[q])
    assert hits / (300 * 20) >= 0.9 and set(got) == set(range(0, 6000, 20))


def test_op10_against_brute_force(spark, data, odd, empty):
    from xxhash import xxh64_intdigest

    rows, docs = {r.doc_id: r for r in simhash.op10(spark, data).collect()}, texts(spark, data)
    fps = {}
    for doc, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert rows[doc].fingerprint == f"{fps[doc]:016x}"
    ids = sorted(fps)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    assert {i: rows[i].component_id for i in ids} == least
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0


def test_op10_forest_of_a_crowd():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.array([centres[rng.integers(6)] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6)))) for _ in range(900)], np.uint64))
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for _ in range(60):
        label = np.where(near, label[None, :], len(fps)).min(1)
    own = np.arange(len(fps))
    for a, b in simhash.forest(fps, 3):
        old, new = max(own[a], own[b]), min(own[a], own[b])
        assert old != new
        own[own == old] = new
    assert (own == label).all()


@pytest.mark.parametrize("run", [
    lambda df: packing.pack(df, public_tokenizers.path("word_bpe_49k.json")),
    lambda df: bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    lambda df: media.features(media.store(df)),
    lambda df: toxicity.score(df, toxicity.Lexicon({"idiot": 1.0})),
    lambda df: quality.score(df, quality.learn(df, df.selectExpr("doc_id", "1 as quality").limit(0))),
    lambda df: pii.pseudonyms(df, "k"),
])
def test_odd_rows(odd, empty, run):
    out = run(odd)
    assert out.select("doc_id").distinct().count() == 7
    assert run(empty).count() == 0
