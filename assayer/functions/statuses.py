"""Statuses, labels, names and wordings of records, as column expressions and small projections."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Old labels and the categories that they stand for.
CANONICAL = {"CLEAN": "NO_SIGNIFICANT_ANOMALIES_DETECTED", "UNAVAILABLE": "INCONCLUSIVE"}
#: Marks of re-encoded copies.
COPIES = ["jpeg_q70", "resize_50", "crop_80", "webp_q75", "social"]
INFERRED = "inferred from the old label"


def canonical(label: Column) -> Column:
    out = F
    for old, new in CANONICAL.items():
        out = out.when(label == old, new)
    return out.otherwise(label)


def reconcile(rows: DataFrame) -> DataFrame:
    """Availability, execution and assessment fill one another: an old label decides only where both statuses are missing; what did not run has no score."""
    bare = F.col("availability").isNull() & F.col("execution_status").isNull()
    label = F.col("assessment")
    available = F.when(bare & (label == "UNAVAILABLE"), "UNAVAILABLE").otherwise(F.coalesce("availability", F.lit("AVAILABLE")))
    executed = F.when(bare & (label == "UNAVAILABLE"), "SKIPPED").when(bare & (label == "INCONCLUSIVE"), "INCONCLUSIVE").otherwise(F.coalesce("execution_status", F.lit("COMPLETED")))
    rows = rows.withColumns({"availability": available, "execution_status": executed})
    up, ran = F.col("availability") == "AVAILABLE", F.col("execution_status")
    derived = F.when(~up, "UNAVAILABLE").when(ran != "COMPLETED", "INCONCLUSIVE").when(F.col("flagged"), "SUSPICIOUS").otherwise("CLEAN")
    rows = rows.withColumns({"assessment": F.coalesce(label, derived), "produced_observations": up & ran.isin("COMPLETED", "INCONCLUSIVE"), "supports_determination": up & (ran == "COMPLETED")})
    return rows.withColumn("confidence", F.when(F.col("produced_observations"), F.col("confidence")).otherwise(0.0))


def backfill(rows: DataFrame) -> DataFrame:
    """Statuses of rows that only have the old label, with a note that they are inferred; recorded ones stay."""
    missing, label = F.col("availability").isNull() & F.col("execution_status").isNull(), F.col("assessment")
    return rows.withColumns({
        "availability": F.when(missing, F.when(label == "UNAVAILABLE", "UNAVAILABLE").otherwise("AVAILABLE")).otherwise(F.col("availability")),
        "execution_status": F.when(missing, F.when(label == "UNAVAILABLE", "SKIPPED").when(label == "INCONCLUSIVE", "INCONCLUSIVE").otherwise("COMPLETED")).otherwise(F.col("execution_status")),
        "status_reason": F.when(missing & label.isin("UNAVAILABLE", "INCONCLUSIVE"), INFERRED).otherwise(F.col("status_reason")),
    })


def original_of(name: Column, tags: Column) -> Column:
    """The id of what a copy was made from: the name before its mark, or without its ending."""
    return F.when(F.arrays_overlap(tags, F.array(*map(F.lit, COPIES))), F.regexp_replace(name, r"^(.*)__.*$", "$1")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def title_usable(title: Column, exclude: list[str], require: list[str]) -> Column:
    """No excluded word, and one of the required patterns; letter case aside."""
    low = F.lower(title)
    return ~low.rlike("|".join(exclude)) & low.rlike("|".join(require))


def skip_reason(files: DataFrame, least: int, accepted: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp")) -> DataFrame:
    """files with the first rule that each breaks, or null."""
    small = F.col("width").isNull() | F.col("height").isNull() | (F.least("width", "height") < least)
    return files.withColumn("reason", F.when(~F.col("mime").isin(*accepted), F.concat(F.lit("type "), "mime")).when(small, f"smaller than {least} px").when(F.col("sha1").isNull(), "no digest"))


def withheld(fields: Column, most: Column | int = 40) -> Column:
    """struct<withheld, fields>: keys of places are listed but not shown; of the others the first by name."""
    secret = lambda k: F.upper(k).startswith("GPS")
    names = F.slice(F.array_sort(F.filter(F.map_keys(fields), lambda k: ~secret(k))), F.lit(1), F.lit(most) if isinstance(most, int) else most.cast("int"))
    return F.struct(F.array_sort(F.filter(F.map_keys(fields), secret)).alias("withheld"), F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(fields, k))).alias("fields"))


def score_text(score: Column, semantics: Column) -> Column:
    """A score in the words that its kind allows: only a calibrated probability is a percentage."""
    whole = lambda k: F.floor(score * k).cast("bigint").cast("string")
    kind = F.coalesce(semantics, F.lit("HEURISTIC_SEVERITY"))
    raw = F.when(kind == "RAW_MODEL_SCORE", " thousandths (raw model score, not a probability)").otherwise(" thousandths (heuristic severity, ordinal only)")
    return F.when((kind == "NOT_APPLICABLE") | score.isNull(), "none (no observation)").when(kind == "CALIBRATED_PROBABILITY", F.concat(whole(100), F.lit("% calibrated probability"))).otherwise(F.concat(whole(1000), raw))


def release_state(policy: Column, known: list[str], default: str = "ADVISORY") -> Column:
    state = F.try_element_at(policy, F.lit("release_state"))
    return F.when(state.isin(*known), state).otherwise(default)


def edit_note(indicated: Column, category: Column) -> Column:
    """The caution where generation is indicated and editing suspected too."""
    return F.when(indicated & category.isin("SUSPICIOUS", "LIKELY_MANIPULATED"), "both results may describe the same local edit")


def encoded(vector: Column) -> Column:
    """A vector's half-precision numbers, little-endian, in base 64."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([None if v is None else base64.b64encode(np.asarray(v, "<f2").tobytes()).decode() for v in lists.to_pylist()], pa.string())

    return run(vector)


def decoded(text: Column) -> Column:
    """What encoded() wrote."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else np.frombuffer(base64.b64decode(t), "<f2").astype(np.float32).tolist() for t in texts.to_pylist()], pa.list_(pa.float32()))

    return run(text)
