"""Near copies by long SimHash fingerprints: texts whose distinct runs of five words are similar by 0.8 or more (Jaccard).

A short fingerprint at a few bits finds only copies that are nearly equal, so texts get WORDS x 64 bits here, all mixed from one
hash of each distinct run.  Candidates meet in BANDS buckets: each is named by the minima of ROWS independent hashes of
the distinct runs, so texts of similarity 0.8 share one but for (1 - 0.8^ROWS)^BANDS = 0.06 % of such pairs, in a table of any size.
In a bucket the Gray-order index of simhash compares the fingerprints; LIMIT or fewer
differing bits make a candidate, no more.  LIMIT stands 5 deviations beyond the mean at similarity 0.8 (2.7 in the worst case, four of five runs).
A bucket yields all its candidates, or a forest of them where it is more than a leaf of the index, and each is confirmed by the exact similarity of the two texts.  Where one fails, the
forest says nothing of the others that it stood for: then the bucket's part is opened, its texts are brought together, and all
its candidates are confirmed there, but for those already connected.  Only confirmed links make components.
Equal texts are one class before that, and crowded buckets are dealt into pairs of parts, as in simhash.  As there, a component
may join texts through others: its ends can be less similar than 0.8.

Cases: as in simhash: null and empty texts are one class and like any other; texts of fewer than five words count as one run;
very long texts are hashed whole; of ties the least id stays; ids are whole numbers; null ids are kept by dedupe() and left out
of the classes; repeated ids stay or go together unless their texts differ, and then they go if one of them does; other
columns, whatever their names, are kept by dedupe(); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import forget, joined, stored, text_batches
from assayer.llm.simhash import CHILDREN, SEED, components, forest, ones

#: 64-bit words of a fingerprint, and the most differing bits of a candidate.
WORDS, LIMIT = 8, 120
#: Rows of an opened bucket, and bytes of their texts, that one task holds in each of two parts, and runs that are counted at once.
OPENED, OPENED_BYTES, AT_ONCE = 256, 16_000_000, 1 << 14
#: Texts of a bucket that one task compares with as many others.
CROWD = 1_024
#: Buckets of a text, and minima that name one.
BANDS, ROWS = 14, 4


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of the same runs."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(text: str, words: int) -> np.ndarray:
    """Hashes of the distinct runs, sorted; a text without words has one empty run."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    n = max(1, len(found) - words + 1)
    starts, stops = np.concatenate([[0], ends[: n - 1]]).tolist(), (ends[-n:] - 1).tolist() or [0]
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def similar(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b members that share `both` have a Jaccard similarity of 0.8 or more."""
    return 5 * both >= 4 * (a + b - both)


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    n, out = len(hashes), np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        own = mixed(hashes, w + 1)
        count = sum(np.unpackbits(own[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, 65536))
        out[w] = np.packbits(2 * count > n, bitorder="little").view("<u8")[0]
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a set of distinct runs."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[i : i + 4096] ^ _TURN[:, None]) * _TIMES[:, None]).min(1))
    name = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        name = mixed(name ^ row, 1)
    return name.view(np.int64)


#: The hashes of buckets(): an odd factor and a mask each.
_TURN = mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 101)
_TIMES = mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 102) | np.uint64(1)


def dealt(places: DataFrame, total: int, crowd: int, most: int | None = None) -> DataFrame:
    """(bucket, i, j, rep, fp) of `total` places (bucket, rep, fp, size): a bucket of more than `crowd` rows, or `most` bytes of text, as pairs of parts; rows that are alone are left out.

    Buckets that many rows share are joined where the rows are.
    """
    parts = F.ceil(F.greatest(F.col("n") / crowd, F.col("bytes") / most if most else F.lit(0.0))).cast("int")
    sizes = stored(places.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1").select("bucket", "n", parts.alias("parts")), "sizes")
    out = joined(places, sizes, "bucket", total, "inner").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    out = out.select("bucket", "rep", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "own")
    return out.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "fp")


def forests(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, i, j, u, v, listed): forests of links between dealt rows, or where `listed` (one leaf of the index) all links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part])
            keys = part[["bucket", "i", "j"]].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            rest = part.iloc[cut[-1] if len(cut) else 0 :]
            if len(cut):
                yield linked(part.iloc[: cut[-1]], cut[:-1])
        if rest is not None:
            yield linked(rest, np.zeros(0, np.int64))

    def linked(part: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        rep = part["rep"].to_numpy(np.int64)
        fps = np.frombuffer(b"".join(part["fp"]), np.uint64).reshape(len(part), -1)
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])
        sizes, pairs = ends - starts, []
        run_of = np.repeat(np.arange(len(starts)), sizes)
        few = sizes <= CHILDREN  # one leaf: all its pairs at once, for all such runs
        for gap in range(1, int(sizes[few].max(initial=0))):
            at = np.flatnonzero((run_of[gap:] == run_of[:-gap]) & few[run_of[gap:]])
            at = at[ones(fps[at] ^ fps[at + gap]) <= bits]
            pairs.append(np.stack([at, at + gap], 1))
        for r in np.flatnonzero(~few).tolist():
            found = np.array(forest(fps[starts[r] : ends[r]], bits), np.int64).reshape(-1, 2) + starts[r]
            pairs.append(found)
        both = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        a, b = rep[both[:, 0]], rep[both[:, 1]]
        keys = part[["bucket", "i", "j"]].iloc[both[:, 0]].reset_index(drop=True)
        return keys.assign(u=np.maximum(a, b), v=np.minimum(a, b), listed=few[run_of[both[:, 0]]])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(run, "bucket bigint, i int, j int, u bigint, v bigint, listed boolean")


def sketches(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, same, size, fp, buckets): `same` tells equal texts, size is their bytes, fp the fingerprint's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                sets = [runs(t, words) for t in texts]
                fps = pa.array([long_fingerprint(x).tobytes() for x in sets], pa.binary())
                found = pa.array([buckets(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), batch.column(3).slice(at, len(texts)), fps, found], names=["id", "same", "size", "fp", "buckets"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("same"), F.octet_length(text).alias("size")).mapInArrow(run, f"id {kind}, same string, size int, fp binary, buckets array<bigint>")


def texts_of(df: DataFrame, classes: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, text) of the classes whose rep is asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col).alias("rep"), text.alias("text"), F.md5(text.cast("binary")).alias("same"))
    wanted = classes.join(reps, "rep", "left_semi").select("rep", "same")
    return keyed.join(wanted, ["rep", "same"]).dropDuplicates(["rep", "same"]).select("rep", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v, ok): whether the two texts of each pair are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            ok, u, v = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(batch.num_rows):
                for i, column in ((u[at], 2), (v[at], 3)):
                    if i not in known:
                        known[i] = runs(batch.column(column)[at].as_py(), words)
                a, b = known[u[at]], known[v[at]]
                ok.append(bool(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    sides = [texts.select(F.col("rep").alias(k), F.col("text").alias(f"{k}_text")) for k in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "u_text", "v_text")
    return both.mapInArrow(run, "u bigint, v bigint, ok boolean").groupBy("u", "v").agg(F.bool_or("ok").alias("ok"))


def opened(rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v): forests of confirmed links between dealt rows, all of whose candidates are confirmed here."""

    def exact(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        rep, fps = part["rep"].to_numpy(np.int64), np.frombuffer(b"".join(part["fp"]), np.uint64).reshape(len(part), -1)
        sets = [runs(t, words) for t in part["text"]]
        size = np.array([len(x) for x in sets], np.int64)
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        row, both = np.repeat(np.arange(len(part)), size), np.zeros((len(part), len(part)), np.int64)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for first in range(0, int(place[-1]) + 1, AT_ONCE):
            a, b = np.searchsorted(place, [first, first + AT_ONCE])
            has = np.zeros((len(part), AT_ONCE), np.float32)
            has[row[a:b], place[a:b] - first] = 1
            both += (has @ has.T).astype(np.int64)
        a, b = np.nonzero(np.triu(similar(both, size[:, None], size[None, :]), 1))
        near = ones(fps[a] ^ fps[b]) <= LIMIT
        a, b, label, out = a[near], b[near], np.arange(len(part)), []
        while len(a):
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            roots, at = np.unique(high, return_index=True)
            out.append(np.stack([rep[a[at]], rep[b[at]]], 1))
            label[roots] = low[at]
            while (label[label] != label).any():
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        found = np.concatenate([np.zeros((0, 2), np.int64), *out])
        return pd.DataFrame({"u": found.max(1, initial=-(2**63)), "v": found.min(1, initial=2**63 - 1)})

    return rows.join(texts, "rep").groupBy("bucket", "i", "j").applyInPandas(exact, "u bigint, v bigint").where("u <> v").distinct()


def near_copies(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row with an id."""
    if dict(df.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids are whole numbers")
    prints = stored(sketches(df, words, id_col, text_col), "prints")
    classes = stored(prints.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first(F.struct("size", "fp", "buckets")).alias("x")).select("same", "rep", "n", "x.*"), "classes")
    count, rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    places = classes.select(F.explode("buckets").alias("bucket"), "rep", "fp", "size")
    found = stored(forests(dealt(places, count * BANDS, CROWD), LIMIT).where("u <> v"), "candidates")
    pairs = found.select("u", "v").distinct()
    texts = stored(texts_of(df, classes, pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), id_col, text_col), "texts")
    tried = stored(confirmed(pairs, texts, words), "tried")
    sure = tried.where("ok").select("u", "v")
    doubtful = stored(found.where("not listed").join(tried.where("not ok"), ["u", "v"], "left_semi").select("bucket").distinct(), "doubtful")
    if not doubtful.isEmpty():
        sure = sure.unionByName(opened(dealt(places.join(doubtful, "bucket", "left_semi"), count * BANDS, OPENED, OPENED_BYTES), texts, words)).distinct()
    merged = components(sure)
    for done in (found, texts, tried, doubtful):
        forget(done)
    of = classes.join(merged, classes["rep"] == merged["node"], "left").select("same", "n", F.coalesce("component", "rep").alias("component_id"))
    return joined(prints.select("id", "same"), stored(of, "components"), "same", rows, "inner").select(F.col("id").alias(id_col), "component_id")  # a frequent text fills no task


def dedupe(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, but for those whose id is not the least of its component."""
    gone = near_copies(df, words, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
