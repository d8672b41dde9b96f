"""What the operators of this folder share: shared-folder tables, the training split, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every fifth id, by CRC-32 of its decimal text, is held out of training.
FOLDS = 5
#: Bytes of text that a Python task handles at once.
BATCH_BYTES = 2_000_000
#: A key that more than one in HEAVY of all rows have is joined by broadcast; there are fewer than HEAVY such keys.
HEAVY = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the ids of the held-out fold; a null id belongs to no fold and is false."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: lineage ends here and no row is computed twice."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """rows with the columns of keyed (one row for each key, n: how many rows have it; total: all rows); no frequent key fills a task.

    If there are frequent keys, their rows stay where they are and meet a broadcast of fewer than HEAVY keys; the others are joined by
    key.  keyed is read several times, so it should be a stored table.
    """
    if (keyed.agg(F.max("n")).first()[0] or 0) * HEAVY <= total:
        return rows.join(keyed, key, how)
    often = keyed.where(F.col("n") * HEAVY > total)
    at_home = rows.join(F.broadcast(often), key)
    others = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(keyed.where(F.col("n") * HEAVY <= total), key, how)
    return at_home.unionByName(others)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote, once nothing reads them any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `limit` bytes, with the place of the first; null texts come as empty ones."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


class Remembered:
    """Bytes for each part of a text, in a bounded cache that starts anew when it is full."""

    def __init__(self, entries: int, longest: int):
        self.entries, self.longest, self.known = entries, longest, {}

    def joined(self, parts: list[list[str]], learn) -> list[bytes]:
        """For each list its parts' bytes, joined; learn() makes those of a set of unknown parts, and may add others."""
        unknown: set[str] = set()
        for p in parts:
            unknown |= set(p).difference(self.known)
        self.known.update(new := learn(unknown))
        get = self.known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for k in [k for k in new if len(k) > self.longest]:
            del self.known[k]
        if len(self.known) > self.entries:
            self.known.clear()
        return out
