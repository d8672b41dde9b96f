"""Retrieve, then verify: exact, Hamming and cosine candidates, their union and ranks, and tri-state gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.operators.joins import with_key
from assayer.sources.scratch import drop, kept


def exact_classes(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, sha256, representative, copies): rows of one content share the least id; pairs are never listed."""
    d = df.select(F.col(id_col).alias("id"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    of = kept(d.groupBy("sha256").agg(F.min("id").alias("representative"), F.count("*").alias("copies")), "classes")
    return with_key(d, of, "sha256", "copies").select("id", "sha256", "representative", "copies")


#: Bands of a 64-bit code, and bits of one.
BANDS, BAND = 4, 16


def radii(distance: int) -> list[int]:
    """How far each band is probed: codes `distance` bits apart have a band within its radius, -1 for none."""
    whole, rest = divmod(distance, BANDS)
    return [whole if i <= rest else whole - 1 for i in range(BANDS)]


def _within(radius: int) -> list[int]:
    """Masks of `radius` or fewer of a band's bits."""
    from itertools import combinations

    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BAND), n)]


#: Codes of one value of a band that a task compares at once with as many others.
CHUNK = 4_096
#: Rows of one code that make a list; two lists are listed as pairs at once.
COPIES = 256


def _met(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(a, b): lists of codes (id, code) that share a probed band, at most CHUNK of each in a row, in order of their ids; rows are dealt evenly.

    Four bands of 16 bits are indexed on one side; the other probes all values within a band's radius, which is 2 at most: of
    distance = 4 r + k the first k + 1 bands take r, the others r - 1.  Codes of like texts crowd in few values, so what meets is kept as
    two lists and never listed as pairs; a crowded value is many rows.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distances are 0 to 8 bits")
    band = lambda i: F.shiftrightunsigned("code", BAND * i).bitwiseAND(F.lit((1 << BAND) - 1))
    probed = [(i, r) for i, r in enumerate(radii(distance)) if r >= 0]
    values = lambda i, r: F.transform(F.array(*map(F.lit, _within(r))), lambda m: F.struct(F.lit(i).alias("band"), band(i).bitwiseXOR(m.cast("bigint")).alias("bits")))
    keys = F.concat(*[values(i, r) for i, r in probed])
    own = F.array(*[F.struct(F.lit(i).alias("band"), band(i).alias("bits")) for i, _ in probed])

    def lists(df: DataFrame, k, name: str) -> DataFrame:
        at = df.select("id", "code", F.explode(k).alias("k")).select("id", "code", "k.*")
        at = at.withColumn(f"{name}_part", F.floor((F.row_number().over(W.partitionBy("band", "bits").orderBy("id")) - 1) / CHUNK))
        return at.groupBy("band", "bits", f"{name}_part").agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias(name)).withColumn(name, F.struct(F.col(f"{name}.id").alias("id"), F.col(f"{name}.code").alias("code")))

    met = lists(a, keys, "a").join(lists(b, own, "b"), ["band", "bits"])
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # lists are small and what they hold is compared pair by pair: Spark would put them in few tasks
    return met.repartition(tasks, "band", "bits", "a_part", "b_part").select("band", "a", "b")


def _compared(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[tuple]:
    """(batch, band, codes of a, codes of b, where b begins, distances) of each row of _met(), so many codes of a at once."""
    for batch in batches:
        sides = []
        for c in (1, 2):
            codes = batch.column(c).field("code")
            sides.append((codes.offsets.to_numpy(), codes.values.to_numpy().view(np.uint64)))
        (at, x), (bt, y) = sides
        for i, band in enumerate(batch.column(0).to_pylist()):
            v = y[bt[i] : bt[i + 1]]
            for u in (x[k : min(k + rows, at[i + 1])] for k in range(at[i], at[i + 1], rows)):
                yield batch, band, u, v, bt[i], np.bitwise_count(u[:, None] ^ v[None, :])


def hamming_pairs(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(a_code, b_code, distance): all pairs of codes (id, code), different on each side, at most `distance` <= 8 bits apart, each once."""
    probed = [(i, r) for i, r in enumerate(radii(distance)) if r >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, v, d = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(d.astype(np.int32))], names=["a_code", "b_code", "distance"])

        for _, band, u, v, _, d in _compared(batches, COPIES):
            i, j = np.nonzero(d <= distance)
            d, u, v = d[i, j], u[i], v[j]
            apart = u ^ v
            new = np.ones(len(u), bool)  # an earlier band that is as near has given the pair
            for k, r in probed:
                if k < band:
                    new &= np.bitwise_count(apart >> np.uint64(BAND * k) & np.uint64((1 << BAND) - 1)) > r
            if new.any():
                held.append((u[new], v[new], d[new]))
                size += int(new.sum())
            if size >= 100_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return _met(a, b, distance).mapInArrow(run, "a_code bigint, b_code bigint, distance int")


def hamming_nearest(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(a_code, distance, b_id): the nearest of b within the distance of each code, ties to the least id; of each two lists a row for each code of a."""
    kind = dict(b.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, u, _, begin, d in _compared(batches):
            j = d.argmin(1)  # the first one has the least id
            least = d[np.arange(len(u)), j]
            good = np.flatnonzero(least <= distance)
            if len(good):
                ids = batch.column(2).field("id").values.take(pa.array(begin + j[good]))
                yield pa.RecordBatch.from_arrays([pa.array(u[good].view(np.int64)), pa.array(least[good].astype(np.int32)), ids], names=["a_code", "distance", "b_id"])

    found = _met(a, b, distance).mapInArrow(run, f"a_code bigint, distance int, b_id {kind}")
    return found.groupBy("a_code").agg(F.min(F.struct("distance", "b_id")).alias("x")).select("a_code", "x.*")


def hamming_links(a: DataFrame, distance: int) -> DataFrame:
    """(code, other): links that join what pairs of codes within the distance join, and no more; of each two lists a link for each code at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, u, v, _, d in _compared(batches):
            near = d <= distance
            i, j = np.nonzero(near)
            if (u[i] == v[j]).all():
                continue
            if len(i) <= len(u) + len(v):
                code, other = u[i], v[j]
            else:
                code, other = np.concatenate([u, v]), _least(near, u, v)
            differ = code != other
            yield pa.RecordBatch.from_arrays([pa.array(code[differ].view(np.int64)), pa.array(other[differ].view(np.int64))], names=["code", "other"])

    found = _met(a, a, distance).mapInArrow(run, "code bigint, other bigint").distinct()
    return found.unionByName(found.select(F.col("other").alias("code"), F.col("code").alias("other"))).distinct()


def _least(near: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of u and v the least one that links lead to."""
    top, x, y = np.uint64(2**64 - 1), u.copy(), v.copy()
    while True:
        to_y = np.minimum(y, np.where(near, x[:, None], top).min(0))
        to_x = np.minimum(x, np.where(near, to_y[None, :], top).min(1))
        if (to_x == x).all() and (to_y == y).all():
            return np.concatenate([x, y])
        x, y = to_x, to_y


def once(df: DataFrame) -> DataFrame:
    """(id, code): each code once, under its least id."""
    return df.groupBy("code").agg(F.min("id").alias("id")).select("id", "code")


def hamming_join(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(a_id, b_id, distance) of rows (id, code) whose codes are at most `distance` <= 8 bits apart.

    Rows of one code are lists of COPIES at most; what meets is dealt evenly as lists, and only then listed as pairs.
    """
    near = hamming_pairs(once(a), once(b), distance)

    def copies(df: DataFrame, name: str) -> DataFrame:
        each = df.select("id", F.col("code").alias(f"{name}_code")).distinct()
        each = each.withColumn(f"{name}_part", F.floor((F.row_number().over(W.partitionBy(f"{name}_code").orderBy("id")) - 1) / COPIES))
        return each.groupBy(f"{name}_code", f"{name}_part").agg(F.collect_list("id").alias(f"{name}_ids"))

    met = near.join(copies(a, "a"), "a_code").join(copies(b, "b"), "b_code")
    met = met.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a_code", "b_code", "a_part", "b_part")
    return met.select("distance", "b_ids", F.explode("a_ids").alias("a_id")).select("a_id", F.explode("b_ids").alias("b_id"), "distance")


def text_codes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, code): 64 signs of the words' summed hashes, a fingerprint in which like texts differ little; each word's bits come from its MD5.  Without words it is 0.

    A text's words are summed in the task that reads it, so one row for each text is shuffled, whatever its length.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("w"))
    half = lambda at: F.conv(F.substring("m", at, 8), 16, 10).cast("bigint")
    hashed = words.select("id", F.md5(F.col("w").cast("binary")).alias("m")).select("id", half(1).alias("h0"), half(9).alias("h1"))
    sign = lambda h, i: F.sum(F.when(F.shiftright(h, i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    signs = hashed.groupBy("id").agg(*[sign(h, i).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)])
    code = F.lit(0).cast("bigint")
    for k, (h, i) in enumerate((h, i) for h in ("h1", "h0") for i in range(32)):
        code = code.bitwiseOR(F.when(F.col(f"{h}_{i}") > 0, F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)))
    return signs.select("id", code.alias("code"))


#: Runs that more texts than RARE share come last in a prefix; at most HOT of them are told apart.
RARE, HOT = 64, 1_000_000
#: Longest bitmap of a text, in bits.
BITS = 1 << 16


def _prefixes(least: float, hot: np.ndarray):
    """(id, n, first, bits) of texts (id, runs): of n hashes those that come first, rare ones before the others, and the parities of all in 64 or more slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, first, bits = batch.column(1), [], []
            ends, every = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            for h in (every[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)):
                low = h.astype(np.uint32)
                late = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low if len(hot) else np.zeros(len(h), bool)
                first.append(h[np.lexsort((h, late))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]].view(np.int64))
                slots = min(BITS, max(64, 1 << (len(h) - 1).bit_length()))
                odd = np.bincount((h >> np.uint64(32)).astype(np.int64) & (slots - 1), minlength=slots) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            n = pa.array(np.diff(ends), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "first", "bits"])

    return run


def _fitting(least: float):
    """Pairs (a_id, a_n, a_bits, b_id, b_n, b_bits) whose parities differ in no more slots than runs may: each run that one text lacks turns one slot."""

    def folded(bits: bytes, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = (batch.column(c).to_numpy().astype(np.float64) for c in ("a_n", "b_n"))
            most = (n + k) * (1 - least) / (1 + least) + 1e-6
            good = np.zeros(len(n), bool)
            for i, (a, b) in enumerate(zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist(), strict=True)):
                size = min(len(a), len(b))
                good[i] = np.bitwise_count(folded(a, size) ^ folded(b, size)).sum() <= most[i]
            yield batch.select(["a_id", "b_id"]).filter(pa.array(good))

    return run


def near_documents(docs: DataFrame, id_col: str, text: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """(a_id, b_id, similarity): all pairs whose distinct runs of words are similar (Jaccard) by `least` or more; equal texts are one, under the least id.

    A prefix join on hashes of runs: in any one order of all runs, two similar texts share one among the first n - ceil(least * n) + 1 of a text's n.
    The order is that of the hashes, frequent ones last, so only the prefixes are shuffled.  Pairs of too unequal lengths, and pairs whose
    parity bitmaps differ in more slots than their runs may, go before any text is read; the texts of the others are compared run by run.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("same", F.sha2(F.col("text").cast("binary"), 256))
    firsts = kept(d.groupBy("same").agg(F.min("id").alias("id")), "firsts")
    one = d.join(firsts, ["id", "same"], "left_semi").select("id", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
    # the run of a shorter text is all of it; what stands in `w` is then read by one expression only
    spans = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - words)), lambda i: F.slice(w, i + 1, words))
    hashed = one.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w")).select("id", F.array_distinct(F.transform(spans("w"), lambda r: F.xxhash64(r))).alias("runs"))
    sets = kept(hashed, "runs")
    total = sets.agg(F.sum(F.size("runs"))).first()[0] or 0
    counts = sets.select(F.explode(F.transform("runs", lambda h: h.bitwiseAND(F.lit((1 << 32) - 1)))).alias("h")).groupBy("h").count()
    often = counts.where(F.col("count") > max(RARE, -(-total // HOT))).select("h").toArrow().column("h").to_numpy()  # HOT at most
    found = kept(sets.mapInArrow(_prefixes(least, np.sort(often.astype(np.uint32))), f"id {dict(d.dtypes)['id']}, n int, first array<bigint>, bits binary"), "prefixes")
    first = found.select("id", "n", F.explode("first").alias("h"))
    side = lambda name: first.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), "h")
    fits = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * least - 1e-9
    pairs = side("a").join(side("b"), "h").where((F.col("a_id") < F.col("b_id")) & fits).select("a_id", "b_id").distinct()
    bits = lambda name: found.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))
    likely = pairs.join(bits("a"), "a_id").join(bits("b"), "b_id")
    of = dict(d.dtypes)["id"]
    likely = kept(likely.mapInArrow(_fitting(least), f"a_id {of}, b_id {of}"), "likely")
    drop(sets)
    runs = F.array_distinct(F.transform(spans("w"), lambda r: F.array_join(r, " ")))
    wanted = kept(likely.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct(), "wanted")
    texts = kept(one.join(wanted, "id", "left_semi").select("id", runs.alias("runs")), "runs")
    both = likely.join(texts.select(F.col("id").alias("a_id"), F.col("runs").alias("a")), "a_id").join(texts.select(F.col("id").alias("b_id"), F.col("runs").alias("b")), "b_id")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("a_id", "b_id", (common / (F.size("a") + F.size("b") - common)).alias("similarity")).where(F.col("similarity") >= least).distinct()


def cosine_candidates(queries: DataFrame, items: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, cosine, rank): the k best cosines, rounded, of each query among the items of its own model version; ties to the smaller id.

    Both sides come in blocks by hash, so no task holds a version; a task multiplies one block with another and keeps k a query.
    """
    def best(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
        if len(q) and len(i):
            unit = lambda vectors: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300))(np.stack(vectors.to_numpy()).astype(np.float64))
            i = i.sort_values("id")
            ids, b = i["id"].to_numpy(), unit(i["vector"])
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                c = np.round(unit(part["asked"]) @ b.T, 6)
                c[part["asking"].to_numpy()[:, None] == ids[None, :]] = -2.0
                order = np.argsort(-c, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(c, order, 1)
                rows, place = np.nonzero(found > -2.0)
                out.append(pd.DataFrame({"query_id": part["asking"].to_numpy()[rows], "id": ids[order[rows, place]], "cosine": found[rows, place]}))
        return pd.concat(out)

    usable = lambda df: df.where(F.exists("vector", lambda x: x != 0)).select(F.col("id").cast("bigint").alias("id"), "vector", "version")
    q, i = usable(queries), usable(items)
    few = lambda df, name: df.groupBy("version").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    shape = few(q, "sides").join(few(i, "blocks"), "version")  # a row for each version
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(shape, "version").withColumn("block", every("blocks")).select(F.col("version").alias("of"), F.col("block").alias("at"), own("sides").alias("part"), F.col("id").alias("asking"), F.col("vector").alias("asked"))
    right = i.join(shape, "version").withColumn("side", every("sides")).select("version", own("blocks").alias("block"), "side", "id", "vector")
    scored = left.groupBy("of", "at", "part").cogroup(right.groupBy("version", "block", "side")).applyInPandas(best, "query_id bigint, id bigint, cosine double")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= k)


def rank_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """Exact ones first, then by cosine (null last), then by distance (null last)."""
    w = W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc(F.coalesce("cosine", F.lit(-2.0))), F.coalesce("distance", F.lit(65)), "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def verify_gates(candidates: DataFrame) -> DataFrame:
    """VERIFIED_MATCH needs the exact digest, or the cosine, geometry and aligned gates; a null gate could not run and is no refusal."""
    gates = F.array("phash_ok", "cosine_ok", "geometry_ok", F.when(F.col("geometry_ok"), F.col("aligned_ok")).otherwise(F.lit(False)))
    passed = F.col("cosine_ok") & F.col("geometry_ok") & F.col("aligned_ok")
    out = F.when(F.col("exact"), "VERIFIED_MATCH").when(F.coalesce(passed, F.lit(False)), "VERIFIED_MATCH").when(F.exists(gates, lambda g: F.coalesce(g, F.lit(True))), "SIMILAR_UNVERIFIED").otherwise("NO_MATCH")
    return candidates.withColumn("status", out)
