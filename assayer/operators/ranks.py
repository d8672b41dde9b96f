"""Ranks and percentiles of few keys with many rows, from two levels: counts of value ranges, then the rows of single ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Value ranges of a key (a square), and the accuracy of the sketch that bounds them.
RANGES, ACCURACY = 1024, 20_000


def ranged(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with a value, with `range`, one of RANGES parts of its key's values in their order, of like many rows, ties aside.

    The parts end at quantiles of a sketch, so no value far from the others leaves them in one part.  A row finds its part by
    every 32nd bound and then by 32 of them.
    """
    rows = rows.where(F.col(value).isNotNull())
    step = int(RANGES**0.5)
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = rows.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), shares, ACCURACY).alias("_bounds"))  # a row for each key
    bounds = bounds.select(*by, F.concat(F.array(F.lit(float("-inf"))), F.col("_bounds")).alias("_bounds"))
    bounds = bounds.withColumn("_tops", F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.get("_bounds", i * step)))
    v = F.col(value).cast("double")
    at_or_below = lambda of: F.size(F.filter(of, lambda x: x <= v)) - 1
    top = rows.join(bounds, by).withColumn("_top", F.greatest(F.lit(0), at_or_below(F.col("_tops"))))
    within = F.slice("_bounds", F.col("_top") * step + 1, F.lit(step))
    return top.withColumn("range", F.col("_top") * step + F.greatest(F.lit(0), at_or_below(within))).drop("_bounds", "_tops", "_top")


def below(counts: DataFrame, by: list[str], n: str, name: str, descending: bool = False) -> DataFrame:
    """counts (by, range, n) with the sum of n over the ranges before each; a key has at most RANGES rows."""
    w = W.partitionBy(*by).orderBy(F.desc("range") if descending else F.asc("range")).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name of shares): percentiles with linear interpolation between order statistics.

    Only the rows of the ranges that hold a wanted order statistic are ranked.
    """
    rows = ranged(df.select(*by, value), by, value)
    counts = below(rows.groupBy(*by, "range").agg(F.count("*").alias("n")), by, "n", "before")
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("share")) for k, p in shares.items()]))
    asked = total.select(*by, "total", each.alias("x")).select(*by, F.col("x.name").alias("name"), (F.col("x.share") * (F.col("total") - 1)).alias("place"))
    asked = asked.select(*by, "name", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    wanted = asked.join(counts, by).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    ranges = wanted.select(*by, "range", "before").distinct()
    ordered = rows.join(ranges, [*by, "range"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*by, "range").orderBy(value)) - 1)
    found = asked.join(ordered.select(*by, "rank", F.col(value).cast("double").alias("v")), [*by, "rank"])
    weight = F.when(F.col("rank") == F.floor("place"), 1 - (F.col("place") - F.floor("place"))).otherwise(F.col("place") - F.floor("place"))
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == k, F.col("v") * weight)).alias(k) for k in shares])
