"""Benchmark decontamination: the words of documents that stand in a window of a benchmark item, by a prefix-filtered set join.

An item's windows are its runs of `window` words (a shorter item is one).  Windows and documents become shingles of SHINGLE words
(of all words, where a window has fewer).  One scan finds the documents' shingles that some window has; it keeps them with the words around.
Shingles are then ordered by rarity, by their counts in all documents.  A document that contains a window contains all of the window's
shingles, so the necessary prefix has length one: its rarest shingle, and a window of which any shingle occurs nowhere goes at once.
The join on that shingle is bounded by place and length (the window must begin and end within the document), and
what is left is verified word by word.

All of it is DataFrame functions.  A scan is sent BLOCK shingles at most; more of them take further scans over numbered rows.  A text is a row
of words, its shingles are exploded beside a broadcast join, so only what matches leaves the scan.  Frequent passages make a row for each of
their places, in as many tasks as read them.

Cases: null and empty texts have no words; items without words have no windows; an item without an id marks words but is not listed; items of equal
ids count once, rows of equal ids or texts each get a row; very long texts are taken whole, in memory as words and hashes; overlapping
windows mark a word once; other columns, whatever their names, are neither read nor returned; empty tables give an empty one, or rows without hits.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.common import forget, stored, table

#: What stands between words, once A to Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Shingles that a scan is sent, and windows that a join is sent; where there are more windows, they are shuffled.
BLOCK, WINDOWS = 500_000, 100_000


def words(text: Column) -> Column:
    """Words of a text, only A to Z lowered; lower() does that for texts of ASCII alone, and faster."""
    own = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def runs(own: Column, n: Column | int, value: Callable[[Column], Column] = lambda run: run) -> Column:
    """Of each run of n words its value, in order; null if there are fewer words."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: value(F.slice(own, i + 1, n))))


def hashes(own: Column, n: Column | int) -> Column:
    return F.coalesce(runs(own, n, lambda run: F.xxhash64(run)), F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window, item) and (window, len, offset, h): the windows with their items, and with their shingles; a window is its words, joined by blanks."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    every = own.select("item", F.explode(runs(F.col("w"), F.least(F.size("w"), F.lit(window)))).alias("w"))
    uses = stored(every.select(F.array_join("w", " ").alias("window"), "item").distinct(), "windows")
    w = F.split("window", " ")
    pieces = uses.select("window").distinct().select("window", F.size(w).alias("len"), F.posexplode(hashes(w, F.least(F.size(w), F.lit(SHINGLE)))).alias("offset", "h"))
    return uses, stored(pieces, "shingles")


def places(docs: DataFrame, shingles: DataFrame, sizes: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, at, h, begin, around): a row for each document (at null), and one for each place of a shingle with the words from `begin` on."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    distinct = shingles.select("h").distinct()
    blocks = max(1, -(-distinct.count() // BLOCK))
    numbered = stored(numbered, "rows") if blocks > 1 else numbered
    split = numbered.select("row", "id", words(F.col("text")).alias("w")).select("row", "id", "w", F.size("w").alias("n"))
    counts = [F.greatest(F.col("n") - s + 1, F.lit(0)) for s in sizes]
    place, before = F.lit(None).cast("int"), F.lit(1)
    for c in counts:  # the first element stands for the document, those of each size follow
        place, before = F.when(F.col("p") >= before, F.col("p") - before).otherwise(place), before + c
    begin = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = F.when(F.col("at").isNotNull(), F.slice("w", begin + 1, F.col("at") + window - begin))
    out = None
    for b in range(blocks):
        block = distinct.where(F.pmod("h", F.lit(blocks)) == b)
        if b == 0:
            block = block.unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("h"))).distinct()
        each = F.concat(F.array(F.lit(0 if b == 0 else None).cast("bigint")), *[hashes(F.col("w"), s) for s in sizes])
        exploded = split.select("row", "id", "n", "w", F.posexplode(each).alias("p", "h"))
        hit = exploded.join(F.broadcast(block), "h").select("row", "id", "n", "w", "h", place.alias("at")).select("row", "id", "n", "at", "h", begin.alias("begin"), around.alias("around"))
        out = hit if out is None else out.unionByName(hit)
    found = stored(out, "places")
    if blocks > 1:
        forget(numbered)
    return found


def occurrences(found: DataFrame, shingles: DataFrame) -> DataFrame:
    """(row, start, len, window): every occurrence of a window."""
    hits = found.where("at is not null")
    rarity = hits.groupBy("h").agg(F.count("*").alias("f"))
    prefix = shingles.join(rarity, "h", "left").groupBy("window", "len").agg(F.min(F.struct("f", "h", "offset")).alias("rarest"), F.count("f").alias("present"), F.count("*").alias("all"))
    prefix = stored(prefix.where("present = all").select("window", "len", "rarest.h", "rarest.offset"), "prefix")
    small = prefix.count() <= WINDOWS
    near = hits.join(F.broadcast(prefix) if small else prefix, "h").withColumn("start", F.col("at") - F.col("offset"))
    within = near.where("start >= 0 and start + len <= n")
    return within.where(F.array_join(F.slice("around", F.col("start") - F.col("begin") + 1, F.col("len")), " ") == F.col("window")).select("row", "start", "len", "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for each document; items are the ids, as sorted strings, of the items of which windows occur."""
    uses, shingles = item_windows(items, window, item_col, item_text_col)
    sizes = sorted(r[0] for r in shingles.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # SHINGLE numbers at most
    found = places(docs, shingles, sizes, window, id_col, text_col)
    hits = stored(occurrences(found, shingles), "hits")
    end = F.col("start") + F.col("len")
    reach = F.max(end).over(W.partitionBy("row").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(reach, F.lit(0))))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = uses.where("item is not null")
    of_items = hits.select("row", "window").distinct().join(F.broadcast(named) if named.count() <= WINDOWS else named, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    every = found.where("at is null").select("row", "id", F.col("n").cast("bigint").alias("n_words"))
    out = every.join(marked, "row", "left").join(of_items, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark each document holds."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
