"""SimHash fingerprints and the components of those that differ in few bits.

fingerprints() hashes every run of `words` words and sets the bits that more than half of the hashes have.

links() finds the pairs of distinct fingerprints at `bits` or fewer differing bits by one hierarchical index in Gray order.
The whole table is sorted by Gray rank, where neighbours share most bits, and cut into nodes of NODE fingerprints.  A node
keeps the bits that all below it share (set, or clear); FAN nodes next to one another make one of the level above.
Pairs of nodes are followed from the root downwards, a join for each level: a pair whose shared bits differ more than
`bits` times is pruned with all below it.  Only the nodes' shared bits take part in that; the fingerprints of two nodes meet
in one task if their pair is left at the lowest level, and the same index goes on within them, down to leaves of CHILDREN
fingerprints.  Every pair of nodes returns a spanning forest of its links, nearest first, never all pairs.  forest() takes
fingerprints of several words too, as the pipeline's are.  Large-star and small-star rounds then make components of the forests.

Cases: null and empty texts have fingerprint 0 and are linked like any other; texts of fewer words than a shingle count as
one; very long texts are hashed whole, with their words and hashes in memory; null ids are left out of components but not of
fingerprints; repeated rows share all values; among ties the least id names a component, so order does not matter; ids may be
of any type that has an order; other columns, whatever their names, are neither read nor returned (dedupe() returns them); an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import forget, joined, stored, table, text_batches

SEED = 42
#: Fingerprints of a node that one task takes, nodes below one of the next level (a power of two), and pairs of nodes that a task takes.
NODE, FAN, PAIRS = 16_384, 16, 4
#: Within a task: children of a node, and node pairs compared at once.
CHILDREN, AT_ONCE = 16, 1 << 19


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in pairs), np.uint64, len(found) - words + 1)
    ones = sum(np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 65536))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fps)], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def gray_order(fps: np.ndarray) -> np.ndarray:
    """The order of fingerprints (one word each, or a row of words, the first leading) in the reflected Gray sequence."""
    rank = (fps if fps.ndim > 1 else fps[:, None]).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for word in range(1, rank.shape[1]):  # after an odd number of ones the sequence runs backwards
        rank[:, word] ^= np.uint64(0) - (rank[:, word - 1] & np.uint64(1))
    return np.lexsort(rank.T[::-1])


def ones(bits: np.ndarray) -> np.ndarray:
    """Bits set in each fingerprint."""
    counts = np.bitwise_count(bits)
    return counts if bits.ndim == 1 else counts.sum(1, dtype=np.int64)


def tree(fps: np.ndarray, height: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask of the bits that all below share) over fingerprints in Gray order, `height` of them at least."""
    levels = [(fps, np.full(fps.shape, ~np.uint64(0)))]
    while len(levels[-1][0]) > CHILDREN or len(levels) < height:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), CHILDREN)
        set_, clear = np.bitwise_and.reduceat(pattern & mask, at), np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((set_, set_ | clear))
    return levels


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what pairs at `bits` or fewer differing bits connect, as places; one fewer than each component has members."""
    order = gray_order(fps)
    return [(int(order[a]), int(order[b])) for a, b in descend(fps[order], None, bits)]


def descend(own: np.ndarray, other: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """A forest of the links within `own`, or between `own` and `other` (whose places follow), both in Gray order."""
    at_once = AT_ONCE // (own[:1].size or 1)
    left = tree(own)
    right = left if other is None else tree(other, len(left))
    left = left if len(left) == len(right) else tree(own, len(right))
    tops = len(left[-1][0]), len(right[-1][0])
    first = np.triu_indices(tops[0]) if other is None else np.divmod(np.arange(tops[0] * tops[1]), tops[1])
    shift = 0 if other is None else len(own)
    work, label = [(len(left) - 1, first[0], first[1])], np.arange(len(own) + (0 if other is None else len(other)))
    links: list[tuple[int, int]] = []
    while work:
        level, a, b = work.pop()
        if len(a) > at_once:
            work += [(level, a[i : i + at_once], b[i : i + at_once]) for i in range(0, len(a), at_once)]
            continue
        if not level:
            apart = label[a] != label[b + shift]
            a, b = a[apart], b[apart]
        differ = ones((left[level][0][a] ^ right[level][0][b]) & left[level][1][a] & right[level][1][b])
        near = differ <= bits
        a, b, differ = a[near], b[near], differ[near]
        if level:
            sizes, child = (len(left[level - 1][0]), len(right[level - 1][0])), np.arange(CHILDREN)
            step = at_once // (CHILDREN * CHILDREN)
            for i in range(0, len(a), step):
                x, y = np.broadcast_arrays((a[i : i + step, None] * CHILDREN + child)[:, :, None], (b[i : i + step, None] * CHILDREN + child)[:, None, :])
                x, y = x.ravel(), y.ravel()
                ok = (x < sizes[0]) & (y < sizes[1])
                if other is None:
                    ok &= x <= y if level > 1 else x < y
                work.append((level - 1, x[ok], y[ok]))
            continue
        nearest = np.argsort(differ, kind="stable")
        a, b = a[nearest], b[nearest] + shift
        while True:  # link what is not yet connected
            new = label[a] != label[b]
            a, b = a[new], b[new]
            if not len(a):
                break
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            roots, at = np.unique(high, return_index=True)
            links += zip(a[at].tolist(), b[at].tolist(), strict=True)
            label[roots] = low[at]
            while (label[label] != label).any():
                label = label[label]
    return links


def gray_rank(fp: str) -> Column:
    """A number in whose order fingerprints are in Gray order."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def nodes(classes: DataFrame) -> DataFrame:
    """(node, fps, reps, set, clear): NODE rows (rep, fp) next to one another in Gray order, and the bits that all have set, or clear."""
    ordered = classes.select("rep", "fp", gray_rank("fp").alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank")
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "placed")
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition, whose number stands above
    counts = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"))
    offsets = counts.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    numbered = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(offsets), "range").withColumn("node", F.floor((F.col("before") + within) / NODE))
    packed = numbered.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "fp", "rep"))).alias("x"), F.bit_and("fp").alias("set"), F.bit_and(F.bitwise_not("fp")).alias("clear"))
    return packed.select("node", F.col("x.fp").alias("fps"), F.col("x.rep").alias("reps"), "set", "clear")


def near_nodes(index: DataFrame, bits: int) -> DataFrame:
    """(a, b): the pairs of nodes, a <= b, that the levels above do not prune."""
    top, step, pairs = index.agg(F.max("node")).first()[0] or 0, FAN.bit_length() - 1, None
    for level in reversed(range(-(-top.bit_length() // step) + 1)):
        at = index.groupBy(F.shiftright("node", level * step).alias("node")).agg(F.bit_and("set").alias("set"), F.bit_and("clear").alias("clear"))
        if pairs is None:
            pairs = at.select(F.col("node").alias("a"), F.col("node").alias("b"))  # the root, with itself
            continue
        side = lambda up, own, at=at: at.select(F.shiftright("node", step).alias(up), F.col("node").alias(own), F.col("set").alias(f"{own}_set"), F.col("clear").alias(f"{own}_clear"))
        differ = F.bit_count(F.col("i_set").bitwiseAND(F.col("j_clear")).bitwiseOR(F.col("i_clear").bitwiseAND(F.col("j_set"))))
        pairs = pairs.join(side("a", "i"), "a").join(side("b", "j"), "b").where((F.col("i") <= F.col("j")) & (differ <= bits)).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return pairs


def links(classes: DataFrame, bits: int) -> DataFrame:
    """(u, v): forests of links between rows (rep, fp); fps are distinct."""
    index = stored(nodes(classes), "nodes")
    pairs = stored(near_nodes(index.select("node", "set", "clear"), bits), "pairs")
    kind = dict(classes.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                own, other = (batch.column(c)[row].values.to_numpy().view(np.uint64) for c in (2, 4))
                reps = batch.column(3)[row].values
                if a == b:
                    found = descend(own, None, bits)
                else:
                    found, reps = descend(own, other, bits), pa.concat_arrays([reps, batch.column(5)[row].values])
                at = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([reps.take(pa.array(at[:, 0])), reps.take(pa.array(at[:, 1]))], names=["u", "v"])

    sides = [index.select(F.col("node").alias(k), F.col("fps").alias(f"{k}_fps"), F.col("reps").alias(f"{k}_reps")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_fps", "a_reps", "b_fps", "b_reps")
    found = stored(both.repartition(max(1, -(-pairs.count() // PAIRS)), "a", "b").mapInArrow(run, f"u {kind}, v {kind}"), "links")
    for done in (index, pairs):
        forget(done)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (u, v) reaches; nodes without an edge are left out."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, total = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = stored(joined(both.where("v > u"), least, "u", 2 * total, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = joined(large, low, "u", total, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "edges")
        for done in (edges, least, large, low):
            forget(done)
        edges, state = after, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, total = state, state[0]


def near_duplicates(df: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row."""
    fps = stored(fingerprints(df, words, id_col, text_col), "fingerprints")
    classes = stored(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n")), "classes")
    merged = components(links(classes, bits))
    of = stored(classes.join(merged, classes["rep"] == merged["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"), "components")
    return joined(fps, of, "fp", fps.count()).select(id_col, "fp", "component_id")


def dedupe(df: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose id is the least of its component; of repeated ids all rows stay."""
    firsts = near_duplicates(df, words, bits, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_first")).distinct()
    return df.join(firsts, df[id_col] == firsts["_first"], "left_semi")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
