"""Evaluation of detectors: counts over decided rows with abstention beside them, ranks, bins and likelihood-ratio costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import wilson
from assayer.operators import ranks


def branch_targets(items: DataFrame) -> DataFrame:
    """Truth for both branches; null: not part of the branch."""
    partly = F.coalesce(F.lower("kind"), F.lit("")).contains("inpaint") & ~F.coalesce(F.lower("kind"), F.lit("")).contains("opencv")
    return items.withColumn("manipulation", F.when(F.col("label") == "manipulated", True).when(F.col("label") == "real", False)).withColumn("ai_generation", F.when(F.col("label") == "ai_generated", True).when(F.col("label") == "real", False).when((F.col("label") == "manipulated") & ~partly, False))


def branch_rows(scores: DataFrame) -> DataFrame:
    """(…, target, verdict, score): rows that are part of their detector's branch; a failed run has no verdict and no score."""
    rows = branch_targets(scores).withColumn("target", F.when(F.col("branch") == "manipulation", F.col("manipulation")).otherwise(F.col("ai_generation"))).where("target is not null")
    verdict = F.when(F.col("execution_status") == "FAILED", "MISSING").when(F.col("execution_status") == "INCONCLUSIVE", "ABSTAINED").when(F.col("raw_score") >= 0.5, "FLAGGED").otherwise("CLEARED")
    return rows.withColumn("verdict", verdict).withColumn("score", F.when(F.col("execution_status") != "FAILED", F.col("raw_score")))


def binary_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and Wilson intervals over decided rows; abstentions beside them."""
    n = lambda target, *verdicts: F.count_if((F.col("target") == target) & F.col("verdict").isin(*verdicts))
    counts = rows.groupBy(*by).agg(F.count_if("target").alias("positives"), F.count_if(~F.col("target")).alias("negatives"), n(True, "FLAGGED").alias("tp"), n(True, "CLEARED").alias("fn"), n(False, "FLAGGED").alias("fp"), n(False, "CLEARED").alias("tn"))
    c = F.col
    out = {}
    for name, k, total in (("recall", c("tp"), c("tp") + c("fn")), ("fpr", c("fp"), c("fp") + c("tn")), ("precision", c("tp"), c("tp") + c("fp"))):
        out[name], out[f"{name}_low"], out[f"{name}_high"] = wilson(k, total)
    out["balanced_accuracy"] = 0.5 * (out["recall"] + 1 - out["fpr"])
    out["abstained_positive"] = F.when(c("positives") > 0, (c("positives") - c("tp") - c("fn")) / c("positives"))
    out["abstained_negative"] = F.when(c("negatives") > 0, (c("negatives") - c("fp") - c("tn")) / c("negatives"))
    return counts.withColumns(out)


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Share of (positive, negative) pairs that are ranked right, ties half; from counts by score and by score range, never from pairs."""
    keys = list(by)
    counts = ranks.ranged(rows.select(*keys, "score", "target"), keys, "score").groupBy(*keys, "range", "score").agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("n"))
    ranges = ranks.below(counts.groupBy(*keys, "range").agg(F.sum("n").alias("all")), keys, "all", "before").drop("all")
    within = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = counts.join(ranges, [*keys, "range"]).withColumn("won", F.col("p") * (F.col("before") + within + 0.5 * F.col("n")))
    return won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("pos"), F.sum("n").alias("neg")).select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def subgroup_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same by every value of several keys, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]))
    return binary_metrics(rows.withColumn("g", each).where("g.value is not null").select("branch", "detector", "target", "verdict", F.col("g.key").alias("key"), F.col("g.value").alias("value")), "branch", "key", "value")


def detector_ops(scores: DataFrame) -> DataFrame:
    """Outcomes and run times of each detector."""
    s = F.col("execution_status")
    counts = scores.groupBy("detector").agg(F.count("*").alias("runs"), *[F.count_if(s == x).alias(x.lower()) for x in ("COMPLETED", "INCONCLUSIVE", "FAILED")])
    return counts.join(ranks.percentiles(scores, ["detector"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "detector", "left")


def silent_failures(scores: DataFrame, *by: str) -> DataFrame:
    """Items that a branch cleared while one of its detectors had failed."""
    one = scores.groupBy(*by, "id", "branch").agg(F.bool_or(F.col("execution_status") == "FAILED").alias("failed"), F.bool_or((F.col("execution_status") == "COMPLETED") & (F.col("raw_score") >= 0.5)).alias("flagged"), F.bool_or(F.col("execution_status") == "COMPLETED").alias("ran"))
    return one.groupBy(*by, "branch").agg(F.count("*").alias("items"), F.count_if(F.col("failed") & ~F.col("flagged") & F.col("ran")).alias("silent"))


def ece(rows: DataFrame, probability: Column, *by: str) -> DataFrame:
    """Expected calibration error over ten bins, the last closed."""
    bins = rows.withColumn("p", probability).where("p is not null").withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)))
    each = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum(F.col("target").cast("double")).alias("sy"))
    return each.groupBy(*by).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def threshold_for_fpr(rows: DataFrame, target: float, *by: str) -> DataFrame:
    """The score above which at most floor(target * n) negatives lie; flag what is strictly greater.  Only the range that holds it is sorted."""
    keys = list(by)
    counts = ranks.ranged(rows.where("not target").select(*keys, "score"), keys, "score").groupBy(*keys, "range", "score").agg(F.count("*").alias("n"))
    ranges = ranks.below(counts.groupBy(*keys, "range").agg(F.sum("n").alias("all")), keys, "all", "before", descending=True)
    total = ranges.groupBy(*keys).agg(F.floor(F.lit(target) * F.sum("all")).alias("allowed"))
    hit = ranges.join(total, keys).where((F.col("before") <= F.col("allowed")) & (F.col("allowed") < F.col("before") + F.col("all"))).select(*keys, "range", "before", "allowed")
    above = F.sum("n").over(W.partitionBy(*keys, "range").orderBy(F.desc("score")))
    ranked = counts.join(hit, [*keys, "range"]).withColumn("above", F.col("before") + above).where("above > allowed")
    return ranked.groupBy(*by).agg(F.max("score").alias("exceed"), F.max("allowed").cast("bigint").alias("allowed"))


def cllr(rows: DataFrame, log10_lr: Column, *by: str) -> DataFrame:
    """Cost of likelihood ratios, and the share that misleads by ten times or more."""
    r = rows.withColumn("l", log10_lr).where("l is not null")
    cost = F.when(F.col("target"), F.log2(1 + F.pow(F.lit(10.0), -F.col("l")))).otherwise(F.log2(1 + F.pow(F.lit(10.0), F.col("l"))))
    pos, neg = F.avg(F.when(F.col("target"), cost)), F.avg(F.when(~F.col("target"), cost))
    misled = F.count_if((F.col("target") & (F.col("l") <= -1)) | (~F.col("target") & (F.col("l") >= 1)))
    return r.groupBy(*by).agg((0.5 * (pos + neg)).alias("cllr"), (misled / F.count("*")).alias("misleading"))


def empirical_lr(rows: DataFrame, by: str, mark: str) -> DataFrame:
    """Share of positives with a mark over the share of negatives; null where no negative has it."""
    totals = rows.groupBy(by).agg(F.count_if("target").alias("np"), F.count_if(~F.col("target")).alias("nn"))
    marks = rows.groupBy(by, mark).agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("n"))
    return marks.join(totals, by).select(by, mark, "p", "n", F.when(F.col("n") > 0, (F.col("p") / F.col("np")) / (F.col("n") / F.col("nn"))).alias("lr"))


def compare_runs(base: DataFrame, candidate: DataFrame, keys: list[str], metric: str, low: str, high: str) -> DataFrame:
    """A metric's change, judged by the baseline's interval."""
    b = base.select(*keys, F.col(metric).alias("base"), F.col(low).alias("low"), F.col(high).alias("high"))
    c = candidate.select(*keys, F.col(metric).alias("candidate"))
    change = F.when(F.col("candidate") > F.col("high"), "improved").when(F.col("candidate") < F.col("low"), "regressed").otherwise("within_noise")
    return b.join(c, keys).withColumn("delta", F.col("candidate") - F.col("base")).withColumn("change", change)


def flag_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Smoothed shares of flagged positives and negatives; usable only if the first is larger."""
    c = F.count_if
    flagged = F.col("verdict") == "FLAGGED"
    known = F.col("verdict").isin("FLAGGED", "CLEARED")
    a = (c(F.col("target") & flagged) + 0.5) / (c(F.col("target") & known) + 1)
    b = (c(~F.col("target") & flagged) + 0.5) / (c(~F.col("target") & known) + 1)
    return rows.groupBy(*by).agg(a.alias("a"), b.alias("b"), c(F.col("target") & known).alias("positives"), c(~F.col("target") & known).alias("negatives")).withColumn("usable", F.col("a") > F.col("b"))


def per_detector(predictions: DataFrame) -> DataFrame:
    """predictions (…, detectors: map of detector to its status and score) as binary rows of each detector's own decision."""
    each = predictions.select("*", F.explode("detectors").alias("detector", "own")).drop("detectors")
    own = F.when(F.col("own.execution_status") != "COMPLETED", "ABSTAINED").when(F.col("own.raw_score") >= 0.5, "FLAGGED").otherwise("CLEARED")
    return each.withColumn("verdict", own).withColumn("branch", F.col("own.branch"))


_METRICS = ["positives", "negatives", "tp", "fn", "fp", "tn", *[f"{m}{e}" for m in ("recall", "fpr", "precision") for e in ("", "_low", "_high")], "balanced_accuracy", "abstained_positive", "abstained_negative"]
_RATES = [f"{m}{e}" for m in ("recall", "fpr") for e in ("", "_low", "_high")]


def report(rows: DataFrame, scores: DataFrame, subgroups: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """(split, section, name, value) of every split in one long table; rows, scores and overlaps have a split.

    branch: counts, rates with intervals and abstention by the branch's verdicts.  subgroup: counts and rates by each value of some columns.
    own: each detector by its own decisions, and own_subgroup those by subgroups.  detector: ranks, run times and outcomes.  localisation: overlaps (iou, f1).
    all: files, and what a branch cleared while one of its detectors had failed.
    """
    def long(df: DataFrame, section: str, name: Column, columns: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
        return df.select("split", F.lit(section).alias("section"), name.alias("of"), each.alias("x")).select("split", "section", F.concat_ws(".", "of", "x.metric").alias("name"), "x.value")

    def grouped(df: DataFrame, section: str, *by: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in subgroups]))
        of = df.select("split", "branch", *by, "target", "verdict", each.alias("g")).where("g.value is not null").select("split", "branch", *by, "target", "verdict", F.concat_ws("=", "g.key", "g.value").alias("group"))
        return long(binary_metrics(of, "split", "branch", *by, "group"), section, F.concat_ws(".", "branch", *by, "group"), ["positives", "negatives", *_RATES])

    s = F.col("execution_status")
    own = branch_targets(scores).withColumn("target", F.when(F.col("branch") == "manipulation", F.col("manipulation")).otherwise(F.col("ai_generation"))).where("target is not null")
    own = own.withColumn("verdict", F.when(s != "COMPLETED", "ABSTAINED").when(F.col("raw_score") >= 0.5, "FLAGGED").otherwise("CLEARED"))
    times = ranks.percentiles(scores, ["split", "detector"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    runs = scores.groupBy("split", "detector").agg(*[F.count_if(s == x).alias(x.lower()) for x in ("COMPLETED", "INCONCLUSIVE", "FAILED")])
    files = scores.groupBy("split").agg(F.count_distinct("id").alias("files"))
    parts = [
        long(binary_metrics(rows, "split", "branch"), "branch", F.col("branch"), _METRICS),
        grouped(rows, "subgroup"),
        long(binary_metrics(own, "split", "branch", "detector"), "own", F.concat_ws(".", "branch", "detector"), _METRICS),
        grouped(own, "own_subgroup", "detector"),
        long(auc(rows, "split", "detector"), "detector", F.col("detector"), ["auc"]),
        long(times, "detector", F.col("detector"), ["p50_ms", "p95_ms"]),
        long(runs, "detector", F.col("detector"), ["completed", "inconclusive", "failed"]),
        long(silent_failures(scores, "split"), "all", F.col("branch"), ["silent"]),
        long(files, "all", F.lit(None).cast("string"), ["files"]),
    ]
    if overlaps is not None:
        found = overlaps.groupBy("split").agg(F.count("*").alias("items"), F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("iou") >= 0.5).alias("good"))
        rate, low, high = wilson(F.col("good"), F.col("items"))
        parts.append(long(found.withColumns({"share": rate, "share_low": low, "share_high": high}), "localisation", F.lit(None).cast("string"), ["items", "mean_iou", "mean_f1", "good", "share", "share_low", "share_high"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spearman(rows: DataFrame, a: str, b: str) -> float | None:
    """Rank correlation of two columns, ties at their mean rank; null where one does not vary."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = VectorAssembler(inputCols=[a, b], outputCol="v").transform(known.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)))
    value = float(Correlation.corr(both, "v", "spearman").first()[0].toArray()[0, 1])
    return None if value != value else value


def pooled(counts: DataFrame, by: str) -> DataFrame:
    """(by, score, y, n): adjacent violators pooled over counts (by, score, y, n), so that y / n grows with the score; score is a block's least.

    Pooling what is pooled already gives the same blocks, so ranges of scores are pooled first, then 32 ranges at a time, then each key's blocks,
    of which n rows leave about n^(2/3) at most.  All keys take the same three jobs' stages.
    """
    def pool(part: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        part = part.sort_values("score")
        for score, y, n in zip(part["score"], part["y"], part["n"], strict=True):
            blocks.append([score, y, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, y1, n1 = blocks.pop()
                blocks[-1][1] += y1
                blocks[-1][2] += n1
        out = pd.DataFrame(blocks, columns=["score", "y", "n"])
        return out.assign(**{by: part[by].iloc[0], "range": part["range"].iloc[0]})[[by, "range", "score", "y", "n"]]

    rows = ranks.ranged(counts, [by], "score").select(by, "range", F.col("score").cast("double").alias("score"), F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n"))
    for width in (1, 32, ranks.RANGES):
        rows = rows.withColumn("range", F.floor(F.col("range") / width).cast("int")).groupBy(by, "range").applyInPandas(pool, rows.schema)
    return rows.drop("range")


def cllr_min(rows: DataFrame, by: str) -> DataFrame:
    """(by, cllr_min): the cost that is left when scores are recalibrated as well as any order-keeping map can; keys of one kind of truth have none."""
    counts = rows.where("score is not null and target is not null").groupBy(by, "score").agg(F.sum(F.col("target").cast("bigint")).alias("y"), F.count("*").alias("n"))
    blocks = pooled(counts, by)
    totals = blocks.groupBy(by).agg(F.sum("y").alias("positives"), F.sum(F.col("n") - F.col("y")).alias("negatives")).where("positives > 0 and negatives > 0")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("y") / F.col("n")))
    ratio = p / (1 - p) / (F.col("positives") / F.col("negatives"))
    cost = F.col("y") / F.col("positives") * F.log2(1 + 1 / ratio) + (F.col("n") - F.col("y")) / F.col("negatives") * F.log2(1 + ratio)
    return blocks.join(totals, by).groupBy(by).agg((F.sum(cost) / 2).alias("cllr_min"))
