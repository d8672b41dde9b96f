"""Likelihood ratios of calibrated detectors, fused for each analysis and branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.stats import conservative_end, log10_lr, lr_cap, platt, verbal_scale

#: Weaker contributions do not count as a conflict.
CONFLICT = 0.3


def contributions(detections: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(analysis_id, detector, branch, family, value, low, high, direction): observed detections; value is null without a calibration.

    calibrations: one row for each detector with a, b, prior, positives, negatives and spread, the half width of log10 LR.
    """
    c = detections.where("execution_status = 'COMPLETED'").join(calibrations, "detector", "left")
    capped = lambda x: lr_cap(x, F.col("positives"), F.col("negatives"))
    raw = log10_lr(platt(F.col("confidence"), F.col("a"), F.col("b")), F.col("prior"))
    out = c.withColumn("raw", raw).withColumn("value", capped(F.col("raw"))).withColumn("low", capped(F.col("raw") - F.col("spread"))).withColumn("high", capped(F.col("raw") + F.col("spread")))
    direction = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.signum("value")).otherwise(F.when(F.col("flagged"), 1.0).otherwise(-1.0))
    return out.select("analysis_id", "detection_id", "detector", "branch", "family", "value", "low", "high", direction.alias("direction"))


def fuse_evidence(found: DataFrame) -> DataFrame:
    """The strongest of each family counts; sums (if independent), the strongest (if not), and the same of the cautious ends."""
    key = ["analysis_id", "branch"]
    strong = F.col("value").isNull() | (F.abs("value") >= CONFLICT)
    own = F.struct("value", "detection_id", conservative_end(F.col("low"), F.col("high")).alias("cautious"))
    family = found.groupBy(*key, "family").agg(
        F.max_by(F.when(F.col("value").isNotNull(), own), F.when(F.col("value").isNotNull(), F.struct(F.abs("value"), -F.col("detection_id")))).alias("best"),
        F.count_if(strong & (F.col("direction") > 0)).alias("up"), F.count_if(strong & (F.col("direction") < 0)).alias("down"),
    )
    family = family.select(*key, "up", "down", "best.*")
    widest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.abs(c), -F.col("detection_id"))))
    out = family.groupBy(*key).agg(F.nullif(F.count("value"), F.lit(0)).alias("families"), F.sum("value").alias("independent"), widest("value").alias("dependent"), F.sum("cautious").alias("c_sum"), widest("cautious").alias("c_max"), (F.sum("up") * F.sum("down")).alias("conflicts"))
    low, high = F.least("c_sum", "c_max"), F.greatest("c_sum", "c_max")
    out = out.withColumn("cautious", F.when(F.col("families") > 0, conservative_end(low, high)))
    weak = F.abs("cautious") < 1
    status = F.when(F.col("families").isNull(), "NOT_ASSESSED").when((F.col("conflicts") > 0) & weak, "CONFLICTING").when(weak, "LIMITED").when(F.col("cautious") > 0, "SUPPORTS").otherwise("AGAINST")
    return out.select(*key, "families", "independent", "dependent", "cautious", "conflicts", status.alias("status"), F.when(F.col("families") > 0, verbal_scale(F.col("cautious"))).alias("strength"))


def statement(fused: DataFrame) -> DataFrame:
    """(analysis_id, branch, statement): the fused record in a sentence that says no more than it holds; ratios are rounded down to whole numbers."""
    what = F.when(F.col("branch") == "manipulation", "edited").otherwise("generated by a model")
    low, high = F.least(F.abs("independent"), F.abs("dependent")), F.greatest(F.abs("independent"), F.abs("dependent"))
    times = lambda v: F.floor(F.pow(F.lit(10.0), v) + 1e-9).cast("bigint").cast("string")
    ratio = F.when(times(low) == times(high), times(low)).otherwise(F.concat(F.lit("between "), times(low), F.lit(" and "), times(high)))
    said = F.concat(F.lit("What the detectors show is "), ratio, F.lit(" times more probable "), F.when(F.col("status") == "SUPPORTS", "if").otherwise("if not"), F.lit(" the file was "), what, F.lit(" ("), F.col("strength"), F.lit(" support)."))
    text = F.when(F.col("status") == "NOT_ASSESSED", "No calibrated detector ran on this question.").when(F.col("status") == "CONFLICTING", "Calibrated detectors point in opposite directions; neither answer is favoured.").when(F.col("status") == "LIMITED", "The detectors hardly tell the two answers apart (limited support).").otherwise(said)
    origin = F.when((F.col("branch") == "ai_generation") & (F.col("status") == "AGAINST"), " That does not show that it came from a camera.").otherwise("")
    return fused.select("analysis_id", "branch", F.concat(text, origin).alias("statement"))


def conflict_pairs(found: DataFrame) -> DataFrame:
    """Pairs of one analysis and branch that point opposite ways, each once."""
    key = ["analysis_id", "branch"]
    up = found.where("direction > 0").select(*key, F.col("detector").alias("points_for"))
    down = found.where("direction < 0").select(*key, F.col("detector").alias("points_against"))
    return up.join(down, key)
