"""Streams of detector outcomes: windows with a watermark, content that arrives twice, and runs that are taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayer.streaming.keyed import timed


def outcome_windows(runs: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcomes of each detector in tumbling windows; works on a stream and on a table alike."""
    rows = timed(runs, late) if runs.isStreaming else runs
    s = F.col("execution_status")
    out = rows.groupBy(F.window("ts", length), "detector").agg(F.count("*").alias("runs"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "INCONCLUSIVE").alias("inconclusive"))
    return out.select(F.col("window.start").alias("window_start"), "detector", "runs", "failed", "inconclusive")


def first_arrivals(arrivals: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each content within the watermark."""
    return timed(arrivals, late).dropDuplicatesWithinWatermark([key])


def append_once(stream: DataFrame, path: str, keys: list[str], log: str) -> None:
    """Append what `path` lacks, each key once, until the source is empty; a run that was stopped is taken up from its log.

    A batch writes a folder of its own, and a batch that is tried again overwrites it, so no try leaves rows twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        done = own.read.schema(kinds).parquet(path).where(F.col("_batch") != number).select(*keys)
        batch.dropDuplicates(keys).join(done, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/_batch={number}")

    kinds = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{path}/_batch=-1")  # a table to read from the first batch on
    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
