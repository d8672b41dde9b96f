"""Operator 3's fingerprint against one written out with sums of cosines, and odd rows."""

import cmath
import math

import numpy as np

from assayer.llm import media


def plain_fingerprint(payload):
    """Peaks of each frame by a discrete Fourier transform written out, and their pairs."""
    n, peaks = media.FRAME, []
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    for start in range(0, len(payload) - n + 1, media.HOP):
        x = [(payload[start + k] - 128) * window[k] for k in range(n)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * b * k / n) for k, v in enumerate(x))) for b in range(n // 2 + 1)]
        tops = [b for b in range(3, n // 2) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 1e-6]
        peaks.append(sorted(tops, key=lambda b: (-power[b], b))[: media.PEAKS])
    pairs = [(t, a << 14 | b << 4 | gap) for t in range(len(peaks)) for gap in range(1, media.AHEAD + 1) if t + gap < len(peaks) for a in peaks[t] for b in peaks[t + gap]]
    return sorted(pairs)


def test_features_are_the_plain_ones(spark):
    texts = ["the quick brown fox jumps over the lazy dog. " * 30, "x", "naïve 日本 text, " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in media.features(media.store(df)).collect():
        expected = plain_fingerprint(media.padded(texts[r.doc_id].encode()))
        assert list(zip(r.features.times, r.features.codes, strict=True)) == expected


def test_blocks_change_nothing(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, media.UNIT * 50, np.uint8)
    whole = media.spectral_peaks(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.spectral_peaks(samples) == whole).all()


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (None, "no id"), (4, "long " * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "f", "m") for i, t in rows], "doc_id bigint, text string, id int, features string, media string")
    out = media.features(media.store(df)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and by[1].n_bytes == 0 and by[1].features == by[2].features and by[1].features.codes == []
    assert by[4].features.payload_bytes == 1_000_512 and media.store(df.limit(0)).count() == 0
    assert media.features(spark.createDataFrame([(None,)], "media binary")).first().features is None
