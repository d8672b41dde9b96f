"""Scores of rows by a user's function, each with its outcome; no row fails the job."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_batch(df: DataFrame, id_col: str, columns: list[str], scorer: Callable[[dict, int], float | None]) -> DataFrame:
    """(id, outcome, score, reason, ms, tries): scorer gets a row's id and columns, and how often it was tried.

    None is inconclusive; an exception, or a score that is no number within 0 and 1, is a failure with its reason; where memory
    did not suffice, the row is tried once more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(r, scorer) for r in batch.to_pylist()]
            names = ["outcome", "score", "reason", "ms", "tries"]
            kinds = [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), *columns).mapInArrow(run, f"id {kind}, outcome string, score double, reason string, ms double, tries int")
    return out.withColumnRenamed("id", id_col)


def one(row: dict, scorer: Callable[[dict, int], float | None]) -> tuple[str, float | None, str | None, float, int]:
    began, tries = time.perf_counter(), 0
    while True:
        tries += 1
        try:
            score = scorer(row, tries)
        except MemoryError as e:
            if tries == 1:
                continue
            outcome = "FAILED", None, f"MemoryError: {e}"
        except Exception as e:  # a row's failure is its outcome
            outcome = "FAILED", None, f"{type(e).__name__}: {e}"
        else:
            if score is None:
                outcome = "INCONCLUSIVE", None, "no result"
            elif not (math.isfinite(score) and 0 <= score <= 1):
                outcome = "FAILED", None, "score is not within 0 and 1"
            else:
                outcome = "COMPLETED", float(score), None
        return (*outcome, (time.perf_counter() - began) * 1000, tries)


def example_scorer(row: dict, tries: int) -> float | None:
    """Fails, abstains and runs out of memory by id."""
    n = row["id"]
    if n % 11 == 0:
        raise ValueError("cannot score this")
    if n % 13 == 0 and tries == 1:
        raise MemoryError
    return float("nan") if n % 7 == 0 else None if n % 5 == 0 else n % 100 / 100
