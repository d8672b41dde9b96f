"""Quality by nearest-neighbour voting in a latent space.

A text's terms are hashed: the runs of GRAM bytes that it is made of, letters lowered (its content), the four-character shapes
(letters, capitals, digits, blanks and each punctuation mark told apart: its layout), and how many of its words and lines repeat.
Damped counts are weighed by inverse document frequency, counted over all documents, and a singular value decomposition of a
bounded, balanced set of labelled texts gives the latent space and the labelled vectors.  The space leaves out word order beyond
a run and what no labelled text uses.  Both are small and sent to every task, which multiplies each text's vector with all
labelled vectors in blocks: the cosines are exact.  The nearest vote with their label, weighed by a power of the cosine.

Cases: null and empty texts have the zero vector and get the share of label 1 among all voters (one half when both
labels occur); very long texts are counted whole, SPAN bytes at a time; without any label every text gets 0.5; null labels are
not learned from, and of a text with several the highest counts; of voters at equal cosines any may vote; repeated rows are scored
one by one; other columns, whatever their names, are neither read nor returned (keep() returns them); an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import forget, held_out, stored, table, text_batches

#: Labelled texts of each label in the vote, at most: the first by hash of their ids.
VOTERS = 2_000
#: Hashed shapes and runs of bytes, bytes of a run, latent dimensions, neighbours that vote, and the power of their cosines.
SHAPES, GRAMS, GRAM, LATENT, NEAREST, POWER = 2048, 2048, 5, 64, 15, 8
#: Texts multiplied at once, and bytes of a text that are counted at once.
BLOCK, SPAN = 512, 1 << 20
#: predicted is 1 from this score on.
KEEP = 0.3
REPEATS = 4
_CLASS = np.zeros(256, np.uint64)
for _i, _b in enumerate(b" \n\t.,;:!?'\"-_()[]{}<>/\\|#$%&*+=@^~`"):
    _CLASS[_b] = 3 + _i
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
TERMS = SHAPES + GRAMS + REPEATS


def hashed(code: np.ndarray, run: int, factor: int, size: int) -> np.ndarray:
    """One of `size` (a power of two) numbers for each run of codes."""
    n = len(code) - run + 1
    gram = code[:n].copy()
    for k in range(1, run):
        gram *= np.uint64(factor)
        gram += code[k : k + n]
    return ((gram * _MIX) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def terms(text: str) -> np.ndarray:
    """Shares of each shape and each run of bytes, and of repeated words and lines."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    for at, size, run, table_, factor in ((0, SHAPES, 4, _CLASS, 64), (SHAPES, GRAMS, GRAM, _LOWER, 257)):
        total = len(raw) - run + 1
        for i in range(0, max(0, total), SPAN):
            out[at : at + size] += np.bincount(hashed(table_[raw[i : i + SPAN + run - 1]], run, factor, size), minlength=size) / np.float32(total)
    words, lines = text.split(), text.split("\n")
    if words:
        out[-REPEATS:] = sum(map(eq, words, words[1:])) / len(words), 1 - len(set(words)) / len(words), 1 - len(set(lines)) / len(lines), sum(map(eq, words, words[2:])) / len(words)
    return out


@dataclass
class Space:
    """Weights of the terms, the projection, and the labelled vectors with their labels."""

    weight: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        latent = damped(counts, self.weight) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.voters):
            return np.full(len(texts), 0.5)
        out = []
        for i in range(0, len(texts), BLOCK):
            cosine = self.vectors(np.stack([terms(t) for t in texts[i : i + BLOCK]])) @ self.voters.T
            k = min(NEAREST, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** POWER
            total, voted = weight.sum(1), (weight * self.labels[near]).sum(1)
            out.append(np.where(total > 1e-9, voted / np.maximum(total, 1e-9), self.labels.mean()))
        return np.clip(np.concatenate(out), 0.0, 1.0)


def damped(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    rows = counts * np.float32(1000)
    np.log1p(rows, out=rows)
    rows *= weight
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows


def leading_axes(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The right singular vectors of the largest singular values of the damped counts, by subspace iteration from a fixed start, a block of rows at a time."""
    basis = np.random.default_rng(0).standard_normal((counts.shape[1], LATENT + 16)).astype(np.float32)
    for _ in range(7):
        basis, _ = np.linalg.qr(basis)
        seen, after = [], np.zeros_like(basis)
        for i in range(0, len(counts), BLOCK):
            rows = damped(unpacked(counts[i : i + BLOCK]), weight)
            seen.append(rows @ basis)
            after += rows.T @ seen[-1]
        last, basis = basis, after
    _, _, turn = np.linalg.svd(np.concatenate(seen), full_matrices=False)
    return np.ascontiguousarray((last @ turn.T)[:, :LATENT], np.float32)


def unpacked(counts: np.ndarray) -> np.ndarray:
    """Shares, of thousandths in half precision."""
    return counts.astype(np.float32) / np.float32(1000)


def frequencies(df: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each term: a task sums up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, texts in text_batches(batch.column(0)):
                for t in texts:
                    has += terms(t) > 0
                n += len(texts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(range(-1, TERMS), pa.int32()), "n": pa.array([n, *has.tolist()], pa.int64())})

    counts = {r["term"]: r["n"] for r in df.select(text_col).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(TERMS)], np.float64)


def learn(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Space:
    """The space of at most VOTERS texts of each label, none of them held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(VOTERS) for y in (0, 1)]
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(first[0].unionByName(first[1]), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(1000 * terms(t)).astype(np.float16).tobytes() for _, texts in text_batches(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "y": batch.column(2), "terms": pa.array(rows, pa.binary())})

    rows = stored(texts.mapInArrow(run, "id string, y int, terms binary"), "voters")
    ids, counts, labels_of = [], [], []
    for y in (0, 1):  # half of the voters at a time
        part = rows.where(F.col("y") == y).toPandas()
        ids += part["id"].tolist()
        labels_of += [float(y)] * len(part)
        packed = np.empty((len(part), TERMS), np.float16)
        for i, raw in enumerate(part["terms"]):
            packed[i] = np.frombuffer(raw, np.float16)
        counts.append(packed)
        del part
    forget(rows)
    if not ids:
        none = np.zeros((0, LATENT), np.float32)
        return Space(np.zeros(TERMS, np.float32), np.zeros((TERMS, LATENT), np.float32), none, np.zeros(0))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels_of[i]))
    counts, labels_of = np.concatenate(counts)[order], np.array(labels_of)[order]
    total, has = frequencies(df, text_col)
    weight = np.log((1 + total) / (1 + has)) + 1
    weight[-REPEATS:] *= 2
    weight = weight.astype(np.float32)
    space = Space(weight, leading_axes(counts, weight), np.zeros((0, LATENT), np.float32), labels_of)
    space.voters = np.concatenate([space.vectors(unpacked(counts[i : i + BLOCK])) for i in range(0, len(counts), BLOCK)])
    return space


def scorer(space: Space):
    """The column function that scores whole texts."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [space.score(texts) for _, texts in text_batches(batch)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return run


def score(df: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)."""
    return df.select(F.col(id_col), scorer(space)(F.col(text_col)).alias("score"))


def keep(df: DataFrame, space: Space, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text scores KEEP or more."""
    return df.where(scorer(space)(F.col(text_col)) >= KEEP)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
