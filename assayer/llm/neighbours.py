"""Approximate nearest neighbours by inner product, with learned partitions on two levels.

learn() takes a bounded sample of vectors (SAMPLE, the first by hash), links each to its nearest, and halves this
neighbour graph again and again: values spread over the links until neighbours have like ones, and the median parts them, so
that partitions are balanced.  A softmax classifier learns from each sampled vector how its neighbours are
spread over the partitions.  Every vector goes to its most probable partition, and a partition with more vectors than a leaf should have is
split in the same way by a graph and a classifier of its own, learned in a task from a sample of that partition.  A leaf should have DENSITY
vectors times the square root of the table's, so leaves grow in number and in size like that root.  A level has SAMPLE / 16 parts at most, both together
262,144 leaves: enough for four million million vectors.

A query goes to several of the most probable partitions, and to several of the most probable leaves of each; there it
is compared exactly and in double precision, in blocks of both sides.  How many are probed is learned too, for the partitions and for the
leaves of each: as many as find TARGET of the nearest of held-out vectors within the sample.  A sample's nearest lie
further apart than the table's, so more than TARGET squared is found.  Where vectors have
structure they are few; vectors without any (uniform on a sphere of 64 dimensions) need most of them.

The comparison has two passes.  The first takes the FIRST most probable leaves of a query and gives it a bound, the
score of the worst that it would keep; in the others only candidates that reach the bound leave a task, so that the
rows that are merged grow with the queries, not with queries times leaves.

Equal vectors are one class.  Ties go to the smaller id, so of each class only the k + 1 smallest ids can be
among the k nearest of any vector; the others are not compared, and nothing is lost.

Cases: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do null ids; partitions and
leaves are added to a query's until they hold more than k others, so k come back wherever there are as many, and all where there are
fewer; repeated rows count once, and of an id with several vectors the one of least digest counts; other columns, whatever their names, are neither
read nor returned; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import stored, table

#: Sampled vectors, links of each, and what the square root of the number of classes is divided by for the number of partitions.
SAMPLE, LINKS, DENSITY = 8_192, 12, 8
#: Recall that the probes of each level must reach on held-out vectors of its sample, one in EIGHTH of them, and the k of that recall.
TARGET, EIGHTH, NEAR = 0.95, 8, 20
#: Rows of a leaf, and queries, that a task compares; leaves that give a query its bound.
BLOCK, FIRST = 4_096, 2


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


@dataclass
class Router:
    """The classifier's weights: a row for each component, the last for the intercept."""

    weights: np.ndarray

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        """The logarithm of each partition's probability."""
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        logits = unit @ self.weights[:-1] + self.weights[-1]
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def order(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions of each vector, most probable first."""
        return np.argsort(-self.chances(vectors), axis=1, kind="stable")[:, :n]


def neighbour_graph(vectors: np.ndarray) -> np.ndarray:
    """The LINKS nearest of each vector by inner product, itself left out."""
    k = min(LINKS, len(vectors) - 1)
    out = np.zeros((len(vectors), k), np.int64)
    for i in range(0, len(vectors), 256):
        near = vectors[i : i + 256] @ vectors.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        out[i : i + 256] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else out[i : i + 256]
    return out


def halved(graph: np.ndarray, depth: int) -> np.ndarray:
    """A partition number for each node; sizes differ by one for each halving."""
    rng, part = np.random.default_rng(0), np.zeros(len(graph), np.int64)
    for _ in range(depth):
        value = rng.standard_normal(len(graph))
        for _ in range(40):
            same = part[graph] == part[:, None]
            value = 0.5 * value + 0.5 * (value[graph] * same).sum(1) / np.maximum(1, same.sum(1))
            back = np.zeros(len(graph))
            np.add.at(back, graph, value[:, None] * same)
            degree = np.zeros(len(graph))
            np.add.at(degree, graph, same)
            value = 0.5 * value + 0.5 * np.where(degree > 0, back / np.maximum(1, degree), value)
            count = np.bincount(part)
            value = value - (np.bincount(part, value) / np.maximum(1, count))[part]
            value /= np.maximum(1e-12, np.sqrt(np.bincount(part, value**2) / np.maximum(1, count)))[part]
        order = np.lexsort((value, part))
        rank = np.arange(len(graph)) - np.concatenate([[0], np.cumsum(np.bincount(part))])[part[order]]
        upper = rank >= np.bincount(part)[part[order]] / 2
        new = np.zeros(len(graph), np.int64)
        new[order] = 2 * part[order] + upper
        part = new
    return part


def fit(vectors: np.ndarray, parts: int) -> Router:
    graph = neighbour_graph(vectors)
    part = halved(graph, max(0, parts.bit_length() - 1)) if graph.shape[1] else np.zeros(len(vectors), np.int64)
    target = np.zeros((len(vectors), parts))
    np.add.at(target, (np.arange(len(vectors)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(vectors)), graph.shape[1]), part[graph].ravel()), 0.5)
    target /= target.sum(1, keepdims=True)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    x = np.column_stack([unit, np.ones(len(unit))])
    weights, mean, square, rng = np.zeros((x.shape[1], parts)), 0.0, 0.0, np.random.default_rng(1)
    for step in range(1, 601):
        rows = rng.integers(0, len(x), 512)
        logits = x[rows] @ weights
        p = np.exp(logits - logits.max(1, keepdims=True))
        gradient = x[rows].T @ (p / p.sum(1, keepdims=True) - target[rows]) / len(rows) + 1e-5 * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Router(weights)


def probes_for(router: Router, vectors: np.ndarray, queries: np.ndarray) -> int:
    """The fewest probes that find TARGET of the NEAR nearest of some vectors among all."""
    parts = router.weights.shape[1]
    home = router.order(vectors, 1)[:, 0]
    found = np.zeros(parts)
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        near = vectors[q] @ vectors.T
        near[np.arange(len(q)), q] = -np.inf
        k = min(NEAR, len(vectors) - 1)
        at = np.argsort(router.order(vectors[q], parts), axis=1)  # the place of each partition in a query's order
        found += np.bincount(np.take_along_axis(at, home[np.argpartition(-near, k - 1, axis=1)[:, :k]], 1).ravel(), minlength=parts)
    return parts if not found.sum() else int(np.searchsorted(np.cumsum(found) / found.sum(), TARGET)) + 1


def parts_for(size: float, count: int) -> int:
    """Into how many parts one level splits so many vectors of a table."""
    bits = int(np.log2(max(1.0, count**0.5 / DENSITY)))  # of the number of leaves
    return 1 << min((SAMPLE // 16).bit_length() - 1, max(0, round(np.log2(size / count) + bits)))


def learned(vectors: np.ndarray, parts: int) -> tuple[Router, int]:
    """A router to so many partitions (fewer for a small sample), and how many a query probes."""
    parts = min(parts, 1 << max(0, (len(vectors) // 16).bit_length() - 1))
    if parts == 1:  # nothing to choose from
        return Router(np.zeros((vectors.shape[1] + 1, 1))), 1
    out = np.arange(len(vectors)) % EIGHTH == 0
    router = fit(vectors[~out], parts)
    return router, probes_for(router, vectors, np.flatnonzero(out))


def learn(classes: DataFrame, count: int) -> tuple[Router, int]:
    """The router of the upper level, and how many partitions a query probes."""
    rows = classes.select("cid", "vector").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas().sort_values("cid")
    return learned(np.stack(rows["vector"].to_numpy()).astype(np.float64), parts_for(count, count))


def splits_of(homes: DataFrame, sizes: DataFrame, count: int) -> DataFrame:
    """(part, children, probes, weights): the router within each partition, learned in a task from SAMPLE of its vectors at most."""
    wanted = {r["part"]: parts_for(r["size"], count) for r in sizes.collect()}  # a row for each partition
    place = F.xxhash64(F.lit("split"), "cid")
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("size"))  # about twice the sample is shuffled
    drawn = homes.join(F.broadcast(sizes), "part").where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    first = drawn.withColumn("turn", F.row_number().over(W.partitionBy("part").orderBy(place, "cid"))).where(F.col("turn") <= SAMPLE)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        router, probes = learned(np.stack(rows["vector"].to_numpy()).astype(np.float64), wanted[rows["part"].iloc[0]])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "children": router.weights.shape[1], "probes": probes, "weights": [router.weights.ravel()]})

    return first.select("part", "cid", "vector").groupBy("part").applyInPandas(split, "part int, children int, probes int, weights array<double>")


def beside(rows: DataFrame, key: str, splits: DataFrame, work: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """What `work` makes of the rows of each partition, in blocks, and its row of `splits`."""
    blocks = F.broadcast(rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row for each partition
    left = rows.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
    right = splits.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
    both = lambda own, split: work(own, split.iloc[0]) if len(own) else none
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(both, schema)


def within(split: pd.Series, dimensions: int) -> Router:
    return Router(np.asarray(split["weights"]).reshape(dimensions + 1, split["children"]))


def best_of(queries: pd.DataFrame, own: pd.DataFrame, n: int) -> pd.DataFrame:
    """(qid, cid, score): of each query's scores in a block the n best, those that do not reach its bound left out."""
    out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "cid": np.zeros(0, np.int64), "score": np.zeros(0)})]
    if len(queries) and len(own):
        own = own.sort_values("cid")
        ids, b = own["cid"].to_numpy(), np.stack(own["vector"].to_numpy())
        n = min(n, len(ids))
        for i in range(0, len(queries), 256):
            part = queries.iloc[i : i + 256]
            a = np.stack(part["asked"].to_numpy())
            score = a @ b.T
            least = np.maximum(-np.partition(-score, n - 1, axis=1)[:, n - 1], part["bound"].to_numpy())[:, None]
            q, c = np.nonzero(score >= least - 1e-9 * np.abs(least))  # ties at the edge stay
            exact = np.einsum("ij,ij->i", a[q], b[c])
            order = np.lexsort((ids[c], -exact, q))
            q, c, exact = q[order], c[order], exact[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < n
            out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[q[keep]], "cid": ids[c[keep]], "score": exact[keep]}))
    return pd.concat(out)


def compared(probing: DataFrame, index: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(qid, cid, score) of queries (qid, asked, bound, part) with the index rows of their leaves; both sides come in blocks."""
    few = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    asked = probing.groupBy("part").agg(F.count("*").alias("asking"))  # a row for each leaf, as in sizes
    blocks = F.broadcast(sizes.join(asked, "part").select("part", few("size").alias("blocks"), few("asking").alias("sides")))
    block = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = probing.join(blocks, "part").withColumn("block", every("blocks")).select("part", "block", block("qid", "sides").alias("side"), "qid", "asked", "bound")
    right = index.join(blocks, "part").withColumn("side", every("sides")).select("part", block("cid", "blocks").alias("block"), "side", "cid", "vector")
    key = ["part", "block", "side"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda q, own: best_of(q, own, n), "qid bigint, cid bigint, score double")


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("key", F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"), 256))
    ids = rows.groupBy("id").agg(F.min("key").alias("key"))
    first = ids.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    named = first.groupBy("key").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = ids.where(F.col("id") % every == 0).select("key", F.col("id").alias("query_id"))
    wanted = asked.select("key").distinct().withColumn("wanted", F.lit(True))
    vectors = rows.select("id", "vector", F.col("key").alias("own")).join(named, (F.col("own") == F.col("key")) & (F.col("id") == F.col("cid")))
    vectors = vectors.dropDuplicates(["key"]).select("key", "cid", "ids", "vector")
    classes = stored(vectors.join(wanted, "key", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))), "classes")
    count = classes.count()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router, probes = learn(classes, count)
    stride = SAMPLE // 16 + 1  # leaves are numbered partition by partition

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best = router.order(np.stack(batch["vector"].to_numpy()), 1)[:, 0]
                yield pd.DataFrame({"cid": batch["cid"], "vector": batch["vector"], "wanted": batch["wanted"], "part": best.astype(np.int32)})

    homes = stored(classes.select("cid", "vector", "wanted").mapInPandas(routed, "cid bigint, vector array<double>, wanted boolean, part int"), "homes")
    crowds = stored(homes.groupBy("part").agg(F.count("*").alias("size")), "crowds")
    splits = stored(splits_of(homes, crowds, count), "splits")

    def leaved(rows: pd.DataFrame, split: pd.Series) -> pd.DataFrame:
        vectors = np.stack(rows["vector"].to_numpy())
        child = within(split, vectors.shape[1]).order(vectors, 1)[:, 0]
        return pd.DataFrame({"cid": rows["cid"], "vector": rows["vector"], "wanted": rows["wanted"], "part": (split["part"] * stride + child).astype(np.int32)})

    index = stored(beside(homes, "cid", splits, leaved, "cid bigint, vector array<double>, wanted boolean, part int"), "index")
    sizes = stored(index.groupBy("part").agg(F.count("*").alias("size")), "sizes")
    held = np.zeros(router.weights.shape[1], np.int64)
    for r in crowds.collect():  # a row for each partition
        held[r["part"]] = r["size"]
    enough = lambda sizes: 1 + (np.cumsum(sizes, axis=1) < k + 2).sum(1)  # itself and k + 1 others

    def aimed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chances = router.chances(np.stack(batch["vector"].to_numpy()))
                order = np.argsort(-chances, axis=1, kind="stable")
                parts = [[(int(p), float(c[p])) for p in o[:n]] for o, c, n in zip(order, chances, np.maximum(probes, enough(held[order])), strict=True)]
                yield pd.DataFrame({"qid": batch["cid"], "asked": batch["vector"], "parts": [[{"part": p, "chance": c} for p, c in row] for row in parts]})

    def probed(rows: pd.DataFrame, split: pd.Series) -> pd.DataFrame:
        vectors = np.stack(rows["asked"].to_numpy())
        inner = np.zeros(split["children"], np.int64)
        inner[np.asarray(split["leaves"], np.int64) % stride] = split["sizes"]
        chances = within(split, vectors.shape[1]).chances(vectors)
        order = np.argsort(-chances, axis=1, kind="stable")
        n = np.minimum(np.maximum(split["probes"], enough(inner[order])), split["children"])
        row, place = np.nonzero(np.arange(split["children"]) < n[:, None])
        child = order[row, place]
        leaf = pd.DataFrame({"qid": rows["qid"].to_numpy()[row], "part": (split["part"] * stride + child).astype(np.int32), "chance": rows["chance"].to_numpy()[row] + chances[row, child]})
        return leaf[inner[child] > 0]

    aims = stored(homes.where("wanted").select("cid", "vector").mapInPandas(aimed, "qid bigint, asked array<double>, parts array<struct<part: int, chance: double>>"), "aims")
    leaves = sizes.groupBy((F.col("part") / stride).cast("int").alias("part")).agg(F.collect_list(F.struct("part", "size")).alias("of"))  # SAMPLE / 16 a row at most
    inside = splits.join(leaves, "part").select("part", "children", "probes", "weights", F.col("of.part").alias("leaves"), F.col("of.size").alias("sizes"))
    goals = beside(aims.select("qid", "asked", F.inline("parts")), "qid", inside, probed, "qid bigint, part int, chance double")
    ordered = goals.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("chance")).alias("minus"), "part"))).alias("goals"))
    queries = stored(aims.select("qid", "asked").join(ordered, "qid").select("qid", "asked", F.col("goals.part").alias("parts")), "queries")
    near = lambda hits: hits.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("place") <= k + 1)
    probing = lambda q, parts, bound: q.select("qid", "asked", bound.alias("bound"), F.explode(parts).alias("part"))
    lowest = F.lit(float("-inf"))
    one = stored(near(compared(probing(queries, F.slice("parts", 1, FIRST), lowest), index, sizes, k + 1)), "near")
    bounds = one.where(F.col("place") == k + 1).select("qid", F.col("score").alias("worst"))
    more = queries.where(F.size("parts") > FIRST).join(bounds, "qid", "left")
    two = compared(probing(more, F.expr(f"slice(parts, {FIRST + 1}, size(parts))"), F.coalesce("worst", lowest)), index, sizes, k + 1)
    best = near(one.drop("place").unionByName(two))
    hits = best.join(classes.select("cid", "ids"), "cid").select("qid", F.explode("ids").alias("vec_id"), "score")
    lists = hits.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("near"))
    asking = asked.join(classes.where("wanted").select("key", F.col("cid").alias("qid")), "key").join(lists, "qid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asking.select("query_id", F.posexplode(others).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"))
