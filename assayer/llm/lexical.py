"""Ranked lexical search: the documents of highest summed impact for each item, exactly.

A document is a vector of impacts, an item one of term weights, and a score their inner product.  One scan keeps each document's
count of terms and its counts of the items' terms; the corpus's numbers come from that table, and impacts from those.

Documents are sorted by the length of their impact vectors and cut into buckets.  An item leaves a bucket out if its own length times
the bucket's greatest can't reach the item's 20th best score so far (Cauchy-Schwarz); within a bucket the same bound cuts the tail of
shorter vectors.  For the others the item's few heaviest coordinates are added up exactly and what is left is bounded by the lengths
of both rests; survivors are rescored in 64-bit integers over all coordinates.  Bounds are in doubles, a billionth wider than they need be.
About HEAD of the longest documents give every task its first 20th best scores, so no task starts from nothing.

Items come in blocks of ITEMS, each a pass over the documents; what a task is sent is one block's items, and what it returns the best
of each item.

Cases: null and empty texts have no terms, count in neither N nor L and are found by no item; items without terms get no rows; very long texts are
counted whole; ties go to the smaller id, null ids last; rows of equal ids and items of equal ids each stand for themselves (ranks are unique
for each item row); other columns, whatever their names, are neither read nor returned; empty tables give an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import forget, stored, table, text_batches

#: ASCII letters and digits, letters in lower case, and all else beyond ASCII belong to terms.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Items of a block, documents of a bucket, coordinates added up before the bound, and documents that give first bounds (half a percent, if that is more).
ITEMS, BUCKET, FOCUS, HEAD = 500, 1024, 6, 4096
#: Documents of a range of lengths, which one task reads.
RANGE = 20_000
WIDER = 1 + 1e-9


def terms(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def vectors(df: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, tfs): a row for each document that has terms, with its counts of the vocabulary's, by number."""
    sent = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, row = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                kept, n, known, tfs, ends = [], [], [], [], [0]
                for i, text in enumerate(texts):
                    if found := terms(text):
                        counts = Counter(found)
                        own = sorted((number[t], counts[t]) for t in number.keys() & counts.keys())
                        known += [t for t, _ in own]
                        tfs += [c for _, c in own]
                        kept.append(i)
                        n.append(len(found))
                        ends.append(len(known))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (known, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(kept))), ids.take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), *lists], names=["row", "id", "n", "terms", "tfs"])
                row += len(kept)

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "row bigint, id bigint, n bigint, terms array<int>, tfs array<int>")


def weighed(rows: DataFrame, weights: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """(norm, row, id, terms, impacts) of documents that have a term of some weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            size = np.diff(lists.offsets.to_numpy())
            tf, term = batch.column("tfs").flatten().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            m = 75 + 25 * batch.column("n").to_numpy() * n_docs // length
            of = np.repeat(np.arange(len(size)), size)
            value = np.where(weights[term] > 0, impact(tf, m[of]), 0)
            norm = np.sqrt(np.bincount(of, value.astype(np.float64) ** 2, len(size)))
            impacts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(value.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(norm), batch.column("row"), batch.column("id"), lists, impacts], names=["norm", "row", "id", "terms", "impacts"]).filter(pa.array(norm > 0))

    return rows.mapInArrow(run, "norm double, row bigint, id bigint, terms array<int>, impacts array<int>")


class Best:
    """The k best (score, id, row) so far of each item, and its least score that still counts."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4] * len(least)

    def add(self, item: int, *found: np.ndarray) -> None:
        """Of found (score, whether the id is null, id, row)."""
        score, null, ids, rows = (np.concatenate(x) for x in zip(self.held[item], found, strict=True))
        order = np.lexsort((rows, ids, null, -score))[: self.k]
        self.held[item] = score[order], null[order], ids[order], rows[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])


class Items:
    """A block's items as sparse vectors, heaviest coordinates first."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray):
        self.size, self.terms, self.values = len(weights), [], []
        for c in counts:
            t = np.array(sorted(c), np.int64)
            v = np.array([c[x] for x in t.tolist()], np.int64) * weights[t]
            order = np.argsort(-v, kind="stable")[: np.count_nonzero(v)]
            self.terms.append(t[order])
            self.values.append(v[order])
        self.norms = np.array([math.sqrt(float((v.astype(np.float64) ** 2).sum())) for v in self.values])
        self.rests = np.array([math.sqrt(float((v[FOCUS:].astype(np.float64) ** 2).sum())) for v in self.values])

    def search(self, bucket: pa.RecordBatch, best: Best) -> bool:
        """Adds what a bucket (longest vectors first) holds to the best; False if no item can find anything in it or in shorter ones."""
        norms = bucket.column("norm").to_numpy()
        open_ = np.flatnonzero((self.norms > 0) & (self.norms * norms[0] * WIDER >= best.least))
        if not len(open_):
            return False
        lists, size = bucket.column("terms"), len(norms)
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        term, value = lists.flatten().to_numpy(), bucket.column("impacts").flatten().to_numpy().astype(np.int64)
        by_term = np.argsort(term, kind="stable")
        row = np.repeat(np.arange(size), np.diff(ends))[by_term]
        start = np.searchsorted(term[by_term], np.arange(self.size + 1))
        column = value[by_term].astype(np.float64)
        ids, rows = bucket.column("id"), bucket.column("row").to_numpy()
        null, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
        whole = np.zeros(self.size, np.int64)
        for q in open_.tolist():
            long_enough = np.searchsorted(-norms, -best.least[q] / (self.norms[q] * WIDER), "right")
            dot, square = np.zeros(size), np.zeros(size)
            for t, w in zip(self.terms[q][:FOCUS].tolist(), self.values[q][:FOCUS].tolist(), strict=True):
                at, v = row[start[t] : start[t + 1]], column[start[t] : start[t + 1]]
                dot[at] += w * v
                square[at] += v * v
            bound = dot + self.rests[q] * np.sqrt(np.maximum(0.0, norms * norms * WIDER - square))
            left = np.flatnonzero(bound[:long_enough] * WIDER >= best.least[q])
            if not len(left):
                continue
            whole[self.terms[q]] = self.values[q]
            many = ends[left + 1] - ends[left]
            entry = np.arange(many.sum()) + np.repeat(ends[left] - (np.cumsum(many) - many), many)
            sums = np.concatenate([[0], np.cumsum(whole[term[entry]] * value[entry])])
            score = sums[np.cumsum(many)] - sums[np.cumsum(many) - many]
            whole[self.terms[q]] = 0
            left, score = left[score >= best.least[q]], score[score >= best.least[q]]
            if len(left):
                best.add(q, score, null[left], ids[left], rows[left])
        return True


def found(documents: DataFrame, counts: list[dict[int, int]], weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(item, score, id, row): each task's best of each item, from documents sorted within their partitions, longest vectors first."""
    sent = documents.sparkSession.sparkContext.broadcast((counts, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, least = sent.value
        items, best, more = Items(counts, weights), Best(k, least), True
        for batch in batches:
            for i in range(0, batch.num_rows if more else 0, BUCKET):
                more = more and items.search(batch.slice(i, BUCKET), best)
        for i, (score, null, ids, rows) in enumerate(best.held):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(score), pa.array(ids, mask=null.astype(bool)), pa.array(rows)], names=["item", "score", "id", "row"])

    return documents.mapInArrow(run, "item int, score bigint, id bigint, row bigint")


def block(df: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, rank, id, score) for one block of (item's number, text)."""
    own = [Counter(terms(t or "")) for _, t in items]
    vocabulary = sorted(set().union(*own))
    rows = stored(vectors(df, vocabulary, id_col, text_col), "vectors")
    n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not vocabulary:
        forget(rows)
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = [{number[t]: c for t, c in o.items()} for o in own]
    documents = weighed(rows, weights, n_docs, length)
    share = max(HEAD / n_docs, 0.005)  # more of many documents, so a small sketch is enough
    cut = documents.agg(F.percentile_approx("norm", max(0.0, 1 - share), 1_000)).first()[0]
    longest = documents.where(F.col("norm") >= (cut or 0.0)).sortWithinPartitions(F.desc("norm"), "row")
    first = found(longest, counts, weights, np.ones(len(items), np.int64), k).groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # at most k of each task
    least = np.ones(len(items), np.int64)
    for r in first.select("item", F.get("s", F.lit(k - 1)).alias("least")).where("least IS NOT NULL").collect():  # a row for each item
        least[r["item"]] = r["least"]
    by_length = documents.repartitionByRange(-(-n_docs // RANGE), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    best = found(by_length, counts, weights, least, k)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))).where(F.col("rank") <= k)
    out = stored(ranked, "ranked")
    forget(rows)
    return out.select("item", "rank", "id", "score")


def search(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k best documents of each item, under the names of their id columns."""
    spark = df.sparkSession
    asked = stored(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    blocks, out = -(-asked.count() // ITEMS), None
    for b in range(blocks):
        some = asked.where(F.pmod("number", F.lit(blocks)) == b).orderBy("number").collect()  # about ITEMS rows
        best = block(df, [(r["number"], r["text"]) for r in some], k, id_col, text_col)
        if best is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
            own = best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
            out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` bigint, score bigint")
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
