"""Media columns: bytes kept as 8-bit WAV, read back, and fingerprinted by spectral-peak pairs.

store() writes each text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of UNIT, as the
samples of a one-channel 8-bit WAV, so that the bytes come back exactly.  features() reads a WAV column
with the wave module, takes a short-time Fourier transform (Hann window, FRAME samples, a frame begins every HOP), keeps the
strongest local maxima of each frame and pairs every one with those of the frames after it.  A pair is
coded as (first bin, second bin, frames between) and kept with the time of its first frame, in two arrays
of equal length, by time, then code.

Cases: null text counts as empty (UNIT bytes of 255); silence and constant tones have no maxima and give empty
arrays; of maxima of equal strength the lower bin comes first; very long texts are transformed BLOCK frames at a time (Spark's
limit of 2 GB a value holds); a null WAV gives null features; equal bytes give equal features, as a text is never transformed
together with another, so repeated rows are equal; other columns, whatever their names, are neither read nor returned by store()
(features() keeps them, and replaces one named `features`); an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import table, text_batches

UNIT = 576
RATE = 8000
#: Samples of a frame and between the beginnings of two (UNIT is a multiple of both), peaks kept, and frames ahead with which they are paired.
FRAME, HOP, PEAKS, AHEAD = 192, 96, 2, 2
#: Frames transformed at once.
BLOCK = 4096


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """Bins of the strongest local maxima of each frame, strongest first; 0 where there are fewer."""
    window = np.hanning(FRAME)
    found = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft((frames[i : i + BLOCK].astype(np.float64) - 128.0) * window, axis=1))
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-6), inner, 0.0)
        strength[:, :2] = 0.0  # the mean level and what leaks from it
        bins = np.zeros((len(power), PEAKS), np.int32)
        rows = np.arange(len(power))
        for k in range(PEAKS):
            top = strength.argmax(axis=1)
            bins[:, k] = np.where(strength[rows, top] > 0, top + 1, 0)
            strength[rows, top] = 0.0
        found.append(bins)
    return np.concatenate(found)


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of all pairs of a peak and one at most AHEAD frames later, by time, then code."""
    times, codes = [], []
    for gap in range(1, AHEAD + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                first, second = peaks[:-gap, a], peaks[gap:, b]
                at = np.flatnonzero((first > 0) & (second > 0))
                times.append(at)
                codes.append((first[at] << 14) | (second[at] << 4) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_batches(batch.column(1)):
                raw = [t.encode() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The input with a column `features`: what the stored bytes say, and the fingerprint's time-coded arrays."""

    @F.arrow_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, times array<int>, codes array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        for batch in batches:
            rows, times, codes, valid = [], [], [], batch.is_valid()
            for item in batch:
                media = item.as_py()
                payload = from_wav(media) if media is not None else b""
                t, c = peak_pairs(spectral_peaks(np.frombuffer(payload, np.uint8))) if payload else (np.zeros(0, np.int32),) * 2
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media or b""), hashlib.sha256(media or b"").hexdigest()))
                times.append(t), codes.append(c)
            ends = pa.array(np.cumsum([0, *map(len, times)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (times, codes)]
            columns = [pa.array(x, pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], pa.string() if "sha" in n else pa.int64()) for n in names]
            yield pa.StructArray.from_arrays([*columns, *lists], names=[*names, "times", "codes"], mask=pa.compute.invert(valid))

    return df.withColumn("features", run(F.col(media_col)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a WAV and read back; `feature` sums up the fingerprint's arrays, which come beside it."""
    read = features(store(table(spark, sf_dir, "documents")))
    joined = lambda c: F.array_join(F.col(f"features.{c}").cast("array<string>"), " ")
    feature = F.concat(F.size("features.codes").cast("string"), F.lit(":"), F.sha2(F.concat_ws("|", joined("times"), joined("codes")).cast("binary"), 256))
    return read.select("doc_id", "n_bytes", *[f"features.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")], feature.alias("feature"), "features.times", "features.codes")
