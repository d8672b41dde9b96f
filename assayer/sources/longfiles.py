"""SHA-256 of files that are too long for one task.

The digest is one chain over a file's bytes, but a task need not see them all: many tasks read the blocks of the files once, and then step
after step adds STEP bytes of each file, one file a task, to the state that the step before left.  Spark reads a file by blocks only as
lines, whose bytes the text source hands on unchanged: with "\\n" as the only separator it drops no byte but the separators themselves
and a byte order mark at the start, and the file's length tells whether there were one and a last separator.  Lines over LINE bytes are
dropped, so that none fills a task; a file of which other bytes came than it has gets no digest here and has to be read whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources import scratch

#: Bytes of a file that a task adds to its state, up to a block and a line more.
STEP = 128 << 20
#: The longest line that the text source hands on, by the option that says so.
LINE = {"mapreduce.input.linerecordreader.line.maxlength": 16 << 20}
#: Files that the text source would unpack.
PACKED = r"(?i)\.(bz2|deflate|gz|gzip|lz4|passthrough|snappy|zst|zstd)$"
_BOM = b"\xef\xbb\xbf"
_PIECE = "place int, start bigint, n bigint, bytes bigint, data binary"
_STATE = "place int, start bigint, path string, length bigint, marked boolean, done bigint, data binary, sha256 string"


class _Sha256:
    """hashlib's own OpenSSL, by the functions whose state is plain bytes (SHA256_CTX): hashlib's objects can't leave their process."""

    SIZE = 112

    def __init__(self, state: bytes | None):
        import _hashlib

        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.at = ctypes.create_string_buffer(state, self.SIZE) if state else ctypes.create_string_buffer(self.SIZE)
        if not state:
            self.lib.SHA256_Init(self.at)

    def update(self, data: pa.Buffer, size: int) -> None:
        self.lib.SHA256_Update(self.at, ctypes.c_void_p(data.address), ctypes.c_size_t(size))

    def digest(self) -> str:
        out, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.at.raw, self.SIZE)
        self.lib.SHA256_Final(out, copy)
        return out.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one block as one piece: in an Arrow column they stand one after another, as in the file."""
    schema, n = pa.schema([("place", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]), 0
    for b in batches:
        place, start, line = b.column("place").to_numpy(), b.column("start").to_numpy(), b.column("line").cast(pa.large_binary())
        ends, data = np.frombuffer(line.buffers()[1], np.int64)[line.offset :], line.buffers()[2]
        edges = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 0)) + 1).tolist(), b.num_rows]
        for i, j in pairwise(edges if b.num_rows else []):
            size = int(ends[j] - ends[i])
            piece = {"place": place[i], "start": start[i], "n": n, "bytes": size, "data": data.slice(int(ends[i]), size).to_pybytes()}
            yield pa.RecordBatch.from_pylist([piece], schema)
            n += 1


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's state (start: -1) and the pieces behind it, in order: the state after them."""
    file = sha = None

    def left() -> pa.RecordBatch:
        whole = file["marked"] is not None and file["done"] == file["length"]
        return pa.RecordBatch.from_pylist([file | {"data": sha.at.raw, "sha256": sha.digest() if whole else None}], schema)

    schema = pa.schema([("place", pa.int32()), ("start", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("marked", pa.bool_()), ("done", pa.int64()), ("data", pa.binary()), ("sha256", pa.string())])
    for b in batches:
        starts, data = b.column("start").to_pylist(), b.column("data")
        for i, start in enumerate(starts):
            if start < 0:
                if file:
                    yield left()
                file, sha = b.select(schema.names).slice(i, 1).to_pylist()[0], _Sha256(data[i].as_py())
                if file["marked"] and not file["done"]:
                    sha.update(pa.py_buffer(_BOM), len(_BOM))
                    file["done"] = len(_BOM)
            else:
                piece = data[i].as_buffer()
                size = min(piece.size, file["length"] - file["done"])
                sha.update(piece, size)
                file["done"] += size
    if file:
        yield left()


def pieces(lines: DataFrame, files: DataFrame, step: int) -> DataFrame:
    """The bytes of files (place, file) from rows of the text source, stored by step: place, start of the block, n (order in a block), bytes, data, step.

    files is broadcast: a row for each long file, less than Spark's own listing of the folder holds on the driver.
    """
    m = F.col("_metadata")
    rows = lines.select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    found = rows.join(F.broadcast(files.select("file", "place")), "file").select("place", "start", "line").mapInArrow(_pieces, _PIECE)
    at = scratch.place(files.sparkSession, "pieces")
    groups = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}  # rows are large; else a step's are one row group, which one task reads
    found.withColumn("step", F.expr(f"start div {step}")).write.options(**groups).partitionBy("step").parquet(at)
    return files.sparkSession.read.schema(f"{_PIECE}, step bigint").parquet(at)


def digests(spark: SparkSession, lines: DataFrame, files: DataFrame, step: int = STEP) -> DataFrame:
    """(path, length, sha256) of files (path, length, file: as _metadata.file_path has it), whose rows by the text source are lines; null if bytes are missing."""
    placed = files.select("path", "length", "file").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    files = scratch.kept(spark.createDataFrame(placed, "path string, length bigint, file string, place int"), "files")
    count, longest = files.agg(F.count("*"), F.max("length")).first()
    parts = pieces(lines, files, step)
    more = F.coalesce("total", F.lit(0)) - F.col("length")  # 1: the last line has no end in the file; 3 less: its mark is missing
    state = files.join(parts.groupBy("place").agg(F.sum("bytes").alias("total")), "place", "left").select(
        "place", F.lit(-1).cast("bigint").alias("start"), "path", "length", F.when(more.isin(0, 1, -3, -2), more < 0).alias("marked"),
        F.lit(0).cast("bigint").alias("done"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("sha256"),
    )
    for i in range(longest // step + 1):
        rows = state.unionByName(parts.where(F.col("step") == i).drop("bytes", "step"), allowMissingColumns=True)
        before, state = state, scratch.kept(rows.repartitionById(count, "place").sortWithinPartitions("place", "start", "n").mapInArrow(_advance, _STATE), "state")
        if i:
            scratch.drop(before)
    scratch.drop(parts)
    return state.select("path", "length", "sha256")
