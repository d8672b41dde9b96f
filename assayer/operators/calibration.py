"""Calibrations: logistic fits of many detectors and resamples at once, and what is recorded, checked and applied of them."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.stats import flag_rate, hash_bucket, log10_lr, logit, lr_cap, platt
from assayer.operators import ranks
from assayer.sources.scratch import kept

#: The penalty on a slope, and the steepest slope that is still a calibration.
RIDGE, STEEPEST = 1e-3, 25.0
#: Rows that a task weighs at once.
AT_ONCE = 2_048
#: Cumulated chances of 0, 1, 2, … draws of mean one.
_DRAWS = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(12)])


def drawn(keys: np.ndarray, reps: int) -> np.ndarray:
    """How often each key (a 64-bit hash) is drawn in each resample: by hash, so nothing is collected and a key's rows stay together."""
    own, back = np.unique(keys, return_inverse=True)
    if 2 * len(own) < len(keys):  # groups: few keys, many rows
        return drawn(own, reps)[back]
    out = np.empty((len(keys), reps), np.uint8)
    for r in range(reps):
        h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, r] = np.searchsorted(_DRAWS, (h ^ (h >> np.uint64(31))) / 2.0**64, "right")
    return out


def _sums(rows: DataFrame, reps: int, thetas: dict[tuple[str, int], np.ndarray] | None, counts: dict[tuple[str, int], tuple[float, float]] | None) -> dict[tuple[str, int], np.ndarray]:
    """For each (detector, resample): positives and negatives, or at its theta the loss, two gradient and three curvature sums; resamples without a theta are left out."""

    def of(name: str) -> list[int]:
        return [r for r in range(reps) if thetas is None or (name, r) in thetas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            g, x, y = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keys = batch.column(3).to_numpy().view(np.uint64)
            for name in set(g.tolist()):
                own, live = np.flatnonzero(g == name), of(name)
                if not live:
                    continue
                if thetas is not None:
                    a, b = np.array([thetas[name, r] for r in live]).T
                    n = np.array([counts[name, r] for r in live])
                    hit, miss = (n[:, 0] + 1) / (n[:, 0] + 2), 1 / (n[:, 1] + 2)
                for i in range(0, len(own), AT_ONCE):
                    at = own[i : i + AT_ONCE]
                    w = drawn(keys[at], reps)[:, live].astype(np.float64) if reps > 1 else np.ones((len(at), 1))
                    xs, ys = x[at], y[at]
                    if thetas is None:
                        part = np.stack([ys @ w, (1 - ys) @ w])
                    else:
                        z = np.outer(xs, a) + b
                        t = np.where(ys[:, None] > 0, hit, miss)
                        small = np.exp(-np.abs(z))
                        p = np.where(z > 0, 1.0, small) / (1 + small)
                        v, e = w * (p * (1 - p) + 1e-12), w * (p - t)
                        loss = np.einsum("ij,ij->j", w, np.maximum(z, 0) + np.log1p(small) - t * z)
                        part = np.vstack([loss, np.stack([xs, np.ones_like(xs)]) @ e, np.stack([xs * xs, xs, np.ones_like(xs)]) @ v])
                    total[name] = total.get(name, 0) + part
        flat = [(name, r, s[:, j].tolist()) for name, s in total.items() for j, r in enumerate(of(name))]
        yield pa.RecordBatch.from_pydict({"g": pa.array([f[0] for f in flat], pa.string()), "rep": pa.array([f[1] for f in flat], pa.int32()), "s": pa.array([f[2] for f in flat], pa.list_(pa.float64()))})

    n = 2 if thetas is None else 6
    parts = rows.mapInArrow(run, "g string, rep int, s array<double>").groupBy("g", "rep").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(n)])
    return {(r["g"], r["rep"]): np.array([r[f"s{i}"] for i in range(n)]) for r in parts.collect()}  # a few numbers for each detector and resample


def fit_platt(rows: DataFrame, by: str, reps: int = 1, group: str = "id", rounds: int = 100) -> dict[str, list[tuple[float, float] | None]]:
    """(a, b) of sigmoid(a * logit(score) + b) for each detector; with reps > 1 one for each resample, which draws whole groups.

    Newton's method on smoothed targets with a small penalty on the slope; a step that does not lower the loss is halved.  Every
    round is one job for all detectors and resamples.  None: a class is missing, the slope is not in (0, 25], or no convergence.
    """
    x = rows.where(F.col("score").isNotNull() & F.col("target").isNotNull()).select(F.col(by).cast("string").alias("g"), logit(F.col("score")).alias("x"), F.col("target").cast("double").alias("y"), F.xxhash64(group).alias("key"))
    x = kept(x, "platt")
    sizes = _sums(x, reps, None, None)
    counts = {k: (v[0], v[1]) for k, v in sizes.items()}
    live = {k: np.array([1.0, 0.0]) for k, (p, n) in counts.items() if p > 0 and n > 0}
    base: dict[tuple[str, int], tuple[np.ndarray, float, np.ndarray]] = {}  # theta, loss and step of the last point that was taken
    scale = dict.fromkeys(live, 1.0)
    done: dict[tuple[str, int], np.ndarray] = {}
    for _ in range(rounds):
        if not live:
            break
        sums = _sums(x, reps, live, counts)
        for k in list(live):
            loss, ga, gb, aa, ab, bb = sums[k]
            theta = live[k]
            loss += 0.5 * RIDGE * theta[0] ** 2
            if k in base and not loss <= base[k][1] * (1 + 1e-12):  # sums differ by that much in another order
                scale[k] /= 2
                if scale[k] <= 1e-8:
                    done[k] = base[k][0]
                    del live[k]
                else:
                    live[k] = base[k][0] - scale[k] * base[k][2]
                continue
            if k in base and np.abs(theta - base[k][0]).max() < 1e-9:
                done[k] = theta
                del live[k]
                continue
            step = np.linalg.solve(np.array([[aa + RIDGE, ab], [ab, bb]]) + 1e-9 * np.eye(2), np.array([ga + RIDGE * theta[0], gb]))
            base[k], scale[k] = (theta, loss, step), 1.0
            live[k] = theta - step
    good = lambda t: (float(t[0]), float(t[1])) if t is not None and np.isfinite(t).all() and 0 < t[0] <= STEEPEST else None
    return {g: [good(done.get((g, r))) for r in range(reps)] for g in sorted({g for g, _ in counts})}


def auc_bootstrap(rows: DataFrame, by: str, reps: int = 1000, key: str = "id") -> DataFrame:
    """(by, low, high): the 2.5 and 97.5 % order statistics of AUC over resamples.

    A row is drawn by hash of its key.  Each score range of a detector is read in the order of scores, in batches, with only the
    sums of each resample held; ranges are then put together by the negatives below them.
    """
    known = ranks.ranged(rows.where("score is not null and target is not null").select(F.col(by).cast("string").alias("g"), "score", F.col("target").cast("double").alias("y"), F.xxhash64(key).alias("key")), ["g"], "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums, tie = None, None, None  # the range, its (won, p, n), and the score that is not closed yet with its (p, n)

        def close() -> None:
            sums[0] += tie[1] * (sums[2] + 0.5 * tie[2])
            sums[1] += tie[1]
            sums[2] += tie[2]

        def done() -> pa.RecordBatch:
            close()
            return pa.RecordBatch.from_pydict({"g": pa.array([of[0]], pa.string()), "range": pa.array([of[1]], pa.int32()), **{c: pa.array([x.tolist()], pa.list_(pa.float64())) for c, x in zip(("won", "p", "n"), sums, strict=True)}})

        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                w = drawn(part.column(4).to_numpy().view(np.uint64), reps).astype(np.float64)
                y, cells = part.column(3).to_numpy(), list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                starts = np.array([j for j in range(len(cells)) if not j or cells[j] != cells[j - 1]])
                p, n = np.add.reduceat(w * y[:, None], starts), np.add.reduceat(w * (1 - y[:, None]), starts)
                for k, j in enumerate(starts.tolist()):
                    cell, score = cells[j][:2], cells[j][2]
                    if cell == of and score == tie[0]:
                        tie = (score, tie[1] + p[k], tie[2] + n[k])
                        continue
                    if cell == of:
                        close()
                    else:
                        if of is not None:
                            yield done()
                        of, sums = cell, np.zeros((3, reps))
                    tie = (score, p[k], n[k])
        if of is not None:
            yield done()

    ordered = known.select("g", "range", "score", "y", "key").repartition("g", "range").sortWithinPartitions("g", "range", "score")
    flat = ordered.mapInArrow(run, "g string, range int, won array<double>, p array<double>, n array<double>").select("g", "range", F.posexplode(F.arrays_zip("won", "p", "n")).alias("rep", "x")).select("g", "range", "rep", "x.*")
    won = ranks.below(flat, ["g", "rep"], "n", "before").groupBy("g", "rep").agg(F.sum(F.col("won") + F.col("p") * F.col("before")).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    areas = won.where("p > 0 and n > 0").select("g", (F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))
    lists = areas.groupBy("g").agg(F.array_sort(F.collect_list("auc")).alias("v"))
    return lists.select(F.col("g").alias(by), F.element_at("v", int(0.025 * reps) + 1).alias("low"), F.element_at("v", int(0.975 * reps)).alias("high"))


def apply(scores: DataFrame, calibrations: DataFrame) -> DataFrame:
    """scores (detector, version, raw_score, …) with applied, probability, flagged and reason.

    calibrations: a row for each detector with version (as fitted), method, a, b, threshold, prior.  A calibration of another
    version is not applied.  A flag rate's threshold is on the raw score, a logistic one's on the probability.
    """
    c = calibrations.withColumnRenamed("version", "fitted")
    each = scores.join(c, "detector", "left")
    same = F.col("fitted") == F.col("version")
    rate = F.col("method") == "flag_rate"
    p = F.when(rate, flag_rate(F.col("raw_score"), F.col("a"), F.col("b"), F.col("threshold"), F.col("prior"))).otherwise(platt(F.col("raw_score"), F.col("a"), F.col("b")))
    each = each.withColumn("applied", F.coalesce(same, F.lit(False))).withColumn("probability", F.when(F.col("applied"), p))
    reason = F.when(F.col("fitted").isNull(), "no calibration").when(~F.col("applied"), F.concat(F.lit("fitted for version "), "fitted"))
    return each.withColumn("flagged", F.when(F.col("applied"), F.when(rate, F.col("raw_score")).otherwise(F.col("probability")) >= F.col("threshold"))).withColumn("reason", reason)


def consistency(fitted: DataFrame, running: DataFrame) -> DataFrame:
    """(detector, status, consistent) of (detector, version) on both sides; consistent is of the whole: no detector runs in another version."""
    both = fitted.select("detector", F.col("version").alias("fitted")).join(running.select("detector", F.col("version").alias("running")), "detector", "full")
    status = F.when(F.col("fitted").isNull(), "not_in_file").when(F.col("running").isNull(), "not_running").when(F.col("fitted") != F.col("running"), "version_mismatch").otherwise("matched")
    each = both.select("detector", status.alias("status"))
    return each.crossJoin(F.broadcast(each.agg(F.bool_and(F.col("status") != "version_mismatch").alias("consistent"))))  # one row


def interval(score: Column, pairs: Column, prior: Column, positives: Column, negatives: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """struct<low, high>: percentiles of the capped ratio over bootstrap pairs (array of [a, b])."""
    v = F.array_sort(F.transform(pairs, lambda ab: lr_cap(log10_lr(platt(score, ab[0], ab[1]), prior), positives, negatives)))

    def at(share: float) -> Column:
        place = F.lit(share) * (F.size(v) - 1)
        first = F.floor(place).cast("int")
        return F.element_at(v, first + 1) + (F.element_at(v, F.least(first + 2, F.size(v))) - F.element_at(v, first + 1)) * (place - first)

    return F.struct(at(low).alias("low"), at(high).alias("high"))


def record(rows: DataFrame, by: str, calibrations: DataFrame, target_fpr: float, original: str) -> DataFrame:
    """What is kept of each calibration (by, a, b): prior, threshold, rates at it, calibration errors and counts, also of independent originals."""
    from assayer.operators.evaluation import ece, threshold_for_fpr

    known = rows.where("score is not null").join(calibrations, by).withColumn("p", platt(F.col("score"), F.col("a"), F.col("b")))
    cut = threshold_for_fpr(known.select(by, F.col("p").alias("score"), "target"), target_fpr, by)
    flagged = F.col("p") > F.col("exceed")
    share = lambda what, of: F.count_if(what & of) / F.count_if(of)
    t = F.col("target")
    rates = known.join(cut, by).groupBy(by).agg(F.avg(t.cast("double")).alias("prior"), F.max("exceed").alias("threshold"), share(flagged, ~t).alias("fpr"), share(flagged, t).alias("recall"), F.count_if(t).alias("positives"), F.count_if(~t).alias("negatives"), F.count_distinct(F.when(t, F.col(original))).alias("independent_positives"), F.count_distinct(F.when(~t, F.col(original))).alias("independent_negatives"))
    errors = ece(known, F.col("score"), by).withColumnRenamed("ece", "ece_raw").join(ece(known, F.col("p"), by).withColumnRenamed("ece", "ece_calibrated"), by)
    return rates.join(errors, by)


def admitted(requests: DataFrame, key: list[str], seconds: float, limit: int) -> DataFrame:
    """Moving window in which only admitted requests count, for (key, ts, id); a key's ordered run is read in batches, of which only the window is held.  retry_after: seconds until a refused one would be admitted."""
    kinds = dict(requests.dtypes)
    names = [*key, "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, deque()
        for batch in batches:
            out, wait = [], []
            for k, micros in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if k != of:
                    of, held = k, deque()
                t = -(2.0**53) if micros is None else micros / 1e6
                while held and held[0] <= t - seconds:
                    held.popleft()
                out.append(len(held) < limit)
                wait.append(None if out[-1] else max(1, math.ceil(held[0] + seconds - t)))
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.bool_()), pa.array(wait, pa.int64())], names=[*names, "admitted", "retry_after"])

    rows = requests.select(*names, F.to_json(F.struct(*key)).alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_micros"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", F.asc_nulls_last("_micros"), F.asc_nulls_last("id"))
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names) + ", admitted boolean, retry_after bigint")
