"""Streams with a state for each key: health, admission, segments, tracks, chains, lost runs, and what arrives twice.

Keys are dealt into parts, and the keys of a part share a state and its calls, so that many small keys cost little. Rows wait in their
part's state, as Arrow, until the watermark has passed them; then they are taken in the order of time, whatever
files or batches they came in.  So each operator gives what its batch form gives, as long as rows are no later than the
watermark's delay; later ones are dropped and counted (`Drained.late`).  A timer wakes a part when its earliest waiting row is due, and
again when a key has been idle for so long that nothing can follow: then what is open is given and the key is forgotten.

A feed reads a table as a stream, whether it is one file or a folder of files, a number of them a batch.  It can be closed, which moves
the watermark past all rows.  A table whose keys are few and large is laid out by time first (`by_time`), so that a state holds the rows of a few
files and not the table.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import time as clock
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.audit import FIELDS, GENESIS
from assayer.sources.scratch import place

#: When a closed feed ends; no row is as late.
FAR = "9999-01-01 00:00:00"


@dataclass
class Feed:
    """A table's files as a stream, and a folder whose one row closes it."""

    rows: DataFrame
    schema: object
    time: str
    end: str

    def close(self, at: object = FAR) -> None:
        """Let the watermark pass `at`, less its delay."""
        spark = self.rows.sparkSession
        one = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == self.time else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        spark.range(1).select(*one).coalesce(1).write.mode("append").parquet(self.end)


def feed(spark: SparkSession, path: str, time: str = "ts", files: int = 100) -> Feed:
    """`path` is a file or a folder of Parquet files, `files` of them a batch; times without zone are read as UTC, as watermarks need."""
    table, (folder, _, name) = spark.read.parquet(path), path.rstrip("/").rpartition("/")
    read = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    if any(f.rpartition("/")[2] == name for f in table.inputFiles()):  # a file is read from the folder that holds it
        read, path = read.option("pathGlobFilter", name), folder
    read = read.parquet(path)
    rows = read.withColumns({f: F.col(f).cast("timestamp") for f, t in read.dtypes if t == "timestamp_ntz" or f == time})
    end = place(spark, "end")
    spark.createDataFrame([], rows.schema).write.parquet(end)
    return Feed(rows.unionByName(spark.readStream.schema(rows.schema).parquet(end)), rows.schema, time, end)


#: Rows of a file of a table that is laid out by time.
SLICE = 2_000_000


def by_time(spark: SparkSession, path: str, columns: list[str], time: str = "ts", late: str = "4000 days") -> tuple[Feed, str]:
    """A feed of a table's columns at least, and the delay that it needs: `late`, or a second if the rows come in the order of time.

    For that the table is written again to files of one range of time each, which a stream reads one a batch in the order of their times of change.  A
    table that fills one file, or a file system that doesn't keep those times, is fed in any order.
    """
    table = spark.read.parquet(path)
    n = -(-table.count() // SLICE)
    if n < 2:
        return feed(spark, path, time), late
    at = place(spark, "by-time")
    table.select(*columns).repartitionByRange(n, time).write.option("maxRecordsPerFile", 0).parquet(at)
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(spark.read.parquet(at).inputFiles())]  # named by their ranges' numbers
    fs, begin = paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), int(clock.time()) - len(paths)
    for i, p in enumerate(paths):
        fs.setTimes(p, (begin + i) * 1000, -1)
    ordered = all(fs.getFileStatus(p).getModificationTime() == (begin + i) * 1000 for i, p in enumerate(paths))
    return (feed(spark, at, time, 1), "1 second") if ordered else (feed(spark, at, time), late)


@dataclass
class Drained:
    """What a stream gave until its source was empty, and how many rows came behind the watermark."""

    rows: DataFrame
    late: int


def drain(stream: DataFrame, name: str, closed: Feed | None = None, at: object = FAR) -> Drained:
    """Run a stream until its source is empty; with a feed, close that and run on from the same checkpoint."""
    spark, path, log, late = stream.sparkSession, place(stream.sparkSession, name), place(stream.sparkSession, f"{name}-log"), 0

    def run() -> int:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])

    late = run()
    if closed is not None:
        closed.close(at)
        late += run()
    return Drained(spark.read.schema(stream.schema).parquet(path), late)


def drained(stream: DataFrame, name: str, closed: Feed | None = None, at: object = FAR) -> DataFrame:
    return drain(stream, name, closed, at).rows


def timed(rows: DataFrame, late: str) -> DataFrame:
    """The rows with a watermark; the row that closes a feed moves it and goes."""
    return rows.withWatermark("ts", late).where(F.col("ts") < F.lit(FAR).cast("timestamp"))


#: Parts that keys are dealt into by hash: the keys of a part share a state, a timer and the calls of a task.
PARTS = 4096
#: Rows of a key that a step takes at once.
PIECE = 50_000


def _packed(rows: pd.DataFrame) -> bytes | None:
    if not len(rows):
        return None
    out, table = io.BytesIO(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return out.getvalue()


def _unpacked(held: bytes | None) -> list[pd.DataFrame]:
    return [] if held is None else [pa.ipc.open_stream(held).read_pandas()]


def _part(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int").alias("part")


def in_order(rows: DataFrame, key: list[str], order: list[str], fields: str, start: object, step: Callable, late: str, idle: float | None = None, finish: Callable | None = None) -> DataFrame:
    """A stream of `fields` from rows (key…, ts, …), each key's rows by `order`.

    step(key, value, rows) takes rows that the watermark has passed, PIECE at most, and returns the key's new value and rows of output; with `early` among its
    attributes it gets all, also those that wait, and returns the indexes of those that still do; with `whole` it gets all that are due as a table.  finish(key, value)
    gives what is open when a key has had no row for `idle` seconds; it is then forgotten.  Values are lists, numbers and texts, kept as JSON.
    """
    names = ["own", *[c for c in rows.columns if c not in ("ts", *key)], "micros"]
    early, whole_key, begin = getattr(step, "early", False), getattr(step, "whole", False), json.dumps(start)

    def pieces(rows: pd.DataFrame) -> Iterator[tuple]:
        if whole_key:
            yield from rows.groupby("own", sort=False)
        else:
            for own, each in groupby(rows.itertuples(), key=lambda r: r.own):
                while piece := list(islice(each, None if early else PIECE)):
                    yield own, piece

    def given(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns, dtype=object).astype(whole)  # as objects: a part's null keys would make floats of whole ones

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, held = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)  # own: value, latest time
        waiting = _unpacked(held)
        if not state.hasTimedOut:
            waiting += [p[names] for p in parts]
        passed = state.getCurrentWatermarkMs()
        wait = pd.concat(waiting).sort_values(["own", *order], ignore_index=True) if waiting else pd.DataFrame(columns=names)
        for own, latest in wait.groupby("own")["micros"].max().items():
            value, last = known.get(own) or (json.loads(begin), 0)
            known[own] = [value, max(last, int(latest))]
        due = wait["micros"].astype("int64") <= passed * 1000
        kept, out = [] if early else wait.index[~due], []
        for own, piece in pieces(wait if early else wait[due]):
            value, new, *rest = step(tuple(json.loads(own).values()), known[own][0], piece, *([passed * 1000] if early else []))
            known[own][0] = value
            out += new
            if early:
                kept += rest[0]
            if len(out) >= PIECE:
                yield given(out)
                out = []
        wait = wait.loc[kept]
        if idle is not None:
            still = set(wait["own"])
            for own in [k for k, (_, last) in known.items() if k not in still and last + idle * 1e6 <= passed * 1000]:
                out += finish(tuple(json.loads(own).values()), known[own][0]) if finish else []
                del known[own]
            ends = [int(last + idle * 1e6) // 1000 + 1 for k, (_, last) in known.items() if k not in still]
        else:
            ends = []
        if known:
            state.update((json.dumps(known), _packed(wait)))
            ends += [int(wait["micros"].min()) // 1000 + 1] if len(wait) else []
            if ends:
                state.setTimeoutTimestamp(max(passed + 1, min(ends)))
        elif state.exists:
            state.remove()
        if out:
            yield given(out)

    kinds = [f.strip().split(" ") for f in fields.split(",")]
    columns, whole = [k[0] for k in kinds], {k[0]: "float64" if k[1] == "double" else "Int64" for k in kinds if k[1] in ("bigint", "int", "double")}
    own = F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("own")
    ready = timed(rows, late).select(_part(*key), own, "ts", F.unix_micros("ts").alias("micros"), *[c for c in names if c not in ("own", "micros")])
    return ready.groupBy("part").applyInPandasWithState(run, fields, "known string, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def health(runs: DataFrame, failing_after: int = 3, window: int = 50, late: str = "1 hour", idle: float | None = None) -> DataFrame:
    """(detector, detection_id, state, failures, p95): each detector's state after each run (detector, detection_id, ts, execution_status, duration).

    The state holds failures in a row and the last `window` durations of productive runs; skipped runs are neutral.
    """
    def step(key: tuple, value: list, due: pd.DataFrame) -> tuple[list, list]:
        failures, durations = value
        failed, counts = (due["execution_status"] == "FAILED").to_numpy(), (~due["execution_status"].isin(["FAILED", "SKIPPED"])).to_numpy()
        run = np.cumsum(failed) + failures  # failures so far, less those before the latest productive run
        run -= np.maximum.accumulate(np.where(counts, run, 0))
        every = np.concatenate([durations, due["duration"].to_numpy(np.float64)[counts]])
        ends, p95 = np.cumsum(counts) + len(durations), np.full(len(every) + 1, np.nan)
        for n in range(1, min(window, len(every) + 1)):
            p95[n] = np.sort(every[:n])[min(n - 1, int(0.95 * n))]
        for at in range(0, len(every) - window + 1, PIECE):
            spans = np.lib.stride_tricks.sliding_window_view(every[at : at + PIECE + window - 1], window)
            p95[at + window : at + window + len(spans)] = np.sort(spans, 1)[:, min(window - 1, int(0.95 * window))]
        state = np.where(run >= failing_after, "FAILING", np.where(run > 0, "DEGRADED", "OPERATIONAL")).tolist()
        ranked = [p if e else None for p, e in zip(p95[ends].tolist(), ends.tolist(), strict=True)]
        out = list(zip([key[0]] * len(due), due["detection_id"].tolist(), state, run.tolist(), ranked, strict=True))
        return [int(run[-1]), every[-window:].tolist()], out

    step.whole = True
    rows = runs.select("detector", "detection_id", "ts", "execution_status", F.col("duration").cast("double").alias("duration"))
    return in_order(rows, ["detector"], ["micros", "detection_id"], "detector string, detection_id bigint, state string, failures int, p95 double", [0, []], step, late, idle)


def admission(requests: DataFrame, key: list[str], seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """(key…, id, admitted, retry_after): moving window in which only admitted requests count; requests: key…, id, ts.

    A key without requests for the window's length is forgotten, which changes no answer.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in requests.dtypes if k in key)

    def step(own: tuple, held: list, due: list) -> tuple[list, list]:
        out = []
        for r in due:
            t = int(r.micros)
            held = [x for x in held if x > t - seconds * 1_000_000]
            ok = len(held) < limit
            out.append((*own, r.id, ok, None if ok else max(1, math.ceil((held[0] + seconds * 1_000_000 - t) / 1e6))))
            if ok:
                held.append(t)
        return held, out

    return in_order(requests.select(*key, "id", "ts"), key, ["micros", "id"], f"{kinds}, id bigint, admitted boolean, retry_after double", [], step, late, seconds)


def segments(frames: DataFrame, anomaly: float = 0.45, late: str = "1 hour", idle: float = 86_400) -> DataFrame:
    """(media_id, start_frame, end_frame, peak_score): runs of anomalous frames (media_id, ts, id, score), each ended by the first calm frame; a run
    that is open when its medium has been idle for so many seconds ends with the last frame."""
    def step(key: tuple, value: list, due: list) -> tuple[list, list]:
        (at, start, peak), out = value, []
        for r in due:
            if r.score >= anomaly:
                start, peak = (at, r.score) if start < 0 else (start, max(peak, r.score))
            elif start >= 0:
                out.append((key[0], start, at, max(peak, r.score)))
                start = -1
            at += 1
        return [at, start, float(peak)], out

    def finish(key: tuple, value: list) -> list:
        at, start, peak = value
        return [(key[0], start, at - 1, peak)] if start >= 0 else []

    return in_order(frames.select("media_id", "ts", "id", "score"), ["media_id"], ["micros", "id"], "media_id bigint, start_frame bigint, end_frame bigint, peak_score double", [0, -1, 0.0], step, late, idle, finish)


def overlap(a: list[float], b: list[float]) -> float:
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


#: Pairs of boxes that are compared at once.
AT_ONCE = 1 << 17
#: How often pairs are taken that are best for both; what ties leave behind that is sorted.
ROUNDS = 50


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlap() of each box of a with each of b."""
    def side(at: int, size: int) -> np.ndarray:
        common = np.minimum((a[:, at] + a[:, size])[:, None], b[:, at] + b[:, size])
        common -= np.maximum(a[:, at][:, None], b[:, at])
        return np.maximum(common, 0.0, out=common)

    both = side(0, 2)
    both *= side(1, 3)
    union = np.add((a[:, 2] * a[:, 3])[:, None], b[:, 2] * b[:, 3])
    union -= both
    if union.min(initial=1.0) > 0:
        return np.divide(both, union, out=both)
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def _best(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(to, most, back): the box of b that each of a overlaps most and by how much, and that of a for each of b; ties go to the first, and overlaps of `least` or less don't count.

    Both sides are compared in order of x, a block of a with those of b that stand near enough: of two boxes the common width is over least / (1 + least) of both widths.
    """
    to, most, back, top = np.zeros(len(a), int), np.zeros(len(a)), np.zeros(len(b), int), np.zeros(len(b))
    rank, order, share = np.argsort(b[:, 0], kind="stable"), np.argsort(a[:, 0], kind="stable"), least / (1 + least)
    b, n = b[rank], max(1, AT_ONCE // len(b))
    wide, narrow, slack = b[:, 2].max(), b[:, 2].min(), 1e-6 * (1 + np.abs(a).max() + np.abs(b).max())
    for rows in (np.sort(order[k : k + n]) for k in range(0, len(a), n)):
        x, w = a[rows, 0], a[rows, 2]
        i, j = np.searchsorted(b[:, 0], (x.min() + share * w.min() - (1 - share) * wide - slack, x.max() + (1 - share) * w.max() - share * narrow + slack))
        if i < j:
            o, ids = _overlaps(a[rows], b[i:j]), rank[i:j]
            most[rows] = o.max(1)
            to[rows] = np.where(o == most[rows][:, None], ids, len(b)).min(1)
            best, of = o.max(0), rows[o.argmax(0)]
            better = (best > top[ids]) | ((best == top[ids]) & (of < back[ids]))
            top[ids[better]], back[ids[better]] = best[better], of[better]
    return to, np.where(most > least, most, 0.0), back


def _classes(boxes: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The different boxes, and the places of each in order."""
    own, of = np.unique(boxes, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    return own, [c.tolist() for c in np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(own)))[:-1])]


def _matched_classes(a: np.ndarray, in_a: list[list[int]], b: np.ndarray, in_b: list[list[int]], least: float) -> dict[int, int]:
    """matched() of equal boxes as classes: {place in b: place in a}.

    Two classes that are the best of each other, and of no others as well, are paired in order at once.  Where bests are tied, and all that are tied are each other's best, places of a
    take the first free place of b in turn.
    """
    o, of, rows, cols = _overlaps(a, b), {}, np.arange(len(a)), np.arange(len(b))
    o[~(o > least)] = 0.0
    while o.size:
        first, best = o.max(1), o.max(0)
        in_row, in_col = (o == first[:, None]) & (o > 0), (o == best) & (o > 0)
        both = in_row & in_col
        ready, free = (first > 0) & (both.sum(1) == in_row.sum(1)), (best > 0) & (both.sum(0) == in_col.sum(0))
        while (wait := ready & (both & ~free).any(1)).any() or (both[~ready].any(0) & free).any():
            ready &= ~wait
            free &= ~both[~ready].any(0)
        if not ready.any():
            break
        alone, tied = both.sum(0) == 1, []
        for r in np.flatnonzero(ready).tolist():
            near = np.flatnonzero(both[r]).tolist()
            x = in_a[rows[r]]
            if len(near) == 1 and alone[near[0]]:
                y = in_b[cols[near[0]]]
                of.update(zip(y, x))  # the shorter one ends
                n = min(len(x), len(y))
                del x[:n], y[:n]
            else:
                tied += [(t, r, near) for t in x]
        for t, r, near in sorted(tied):
            if found := min(((in_b[cols[c]][0], c) for c in near if in_b[cols[c]]), default=None):
                of[found[0]] = t
                in_b[cols[found[1]]].pop(0)
                in_a[rows[r]].remove(t)
        left, stay = (first > 0) & [bool(in_a[k]) for k in rows], np.array([bool(in_b[k]) for k in cols])
        o, rows, cols = o[np.ix_(left, stay)], rows[left], cols[stay]
    return of


def matched(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which box of a (rows of x, y, w, h) each of b goes to, or -1: pairs that overlap by more than `least`, the best first, one to one; ties go to the first of a, then of b.

    A pair that is the best of both its boxes is taken whatever the others are, so all such pairs are taken at once, and again among the boxes that are left.
    """
    of, rows, cols, rounds = np.full(len(b), -1), np.arange(len(a)), np.arange(len(b)), 0
    if not len(a) or not len(b):
        return of
    (boxes_a, in_a), (boxes_b, in_b) = _classes(a), _classes(b)
    if 4 * len(in_a) * len(in_b) <= len(a) * len(b):
        found = _matched_classes(boxes_a, in_a, boxes_b, in_b, least)
        of[list(found)] = list(found.values())
        return of
    while len(rows) * len(cols) > AT_ONCE and rounds < ROUNDS:
        to, most, back = _best(a[rows], b[cols], least)
        good = (most > 0) & (back[to] == np.arange(len(rows)))
        if not good.any():
            return of
        of[cols[to[good]]] = rows[good]
        rows, cols, rounds = rows[(most > 0) & ~good], np.delete(cols, to[good]), rounds + 1
    if not len(rows) or not len(cols):
        return of
    o = _overlaps(a[rows], b[cols])
    o[~(o > least)] = 0.0
    while o.size and rounds < ROUNDS:
        at, to, back = np.arange(len(o)), o.argmax(1), o.argmax(0)
        good = (o[at, to] > 0) & (back[to] == at)
        if not good.any():
            return of
        of[cols[to[good]]] = rows[good]
        left, stay = (o[at, to] > 0) & ~good, np.delete(np.arange(len(cols)), to[good])
        o, rows, cols, rounds = o[np.ix_(left, stay)], rows[left], cols[stay], rounds + 1
    i, j = np.nonzero(o)
    taken = set()
    for k in np.lexsort((j, i, -o[i, j])).tolist():
        if i[k] not in taken and of[cols[j[k]]] < 0:
            of[cols[j[k]]] = rows[i[k]]
            taken.add(i[k])
    return of


def tracks(regions: DataFrame, least: float = 0.3, sure: float = 0.4, decay: float = 0.85, lost: int = 5, late: str = "1 hour", idle: float | None = None) -> DataFrame:
    """(media_id, frame, id, track, confidence): the track of each region (media_id, ts, frame, id, x, y, w, h, confidence), frame by frame.

    Regions go to the active track that they overlap most, one to one; sure ones without a track begin one, named by its first frame and a
    place there; a track that is not seen fades, and after `lost` frames it is gone.  Overlaps are compared in blocks (`matched`).  The state holds active tracks only; set `idle` to
    the time of `lost` frames or more, and a medium without regions leaves no state.
    """
    def step(key: tuple, value: list, due: pd.DataFrame) -> tuple[list, list]:
        active, out = {int(r[0]): list(r[1:]) for r in value}, []  # track: last frame, box, confidence
        due = due.sort_values("frame", kind="stable")
        frames, ids, boxes, confidence = due["frame"].to_numpy(), due["id"].to_numpy(), due[["x", "y", "w", "h"]].to_numpy(np.float64), due["confidence"].tolist()
        starts = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1)).tolist()
        for begin, end in zip(starts, [*starts[1:], len(frames)], strict=True):
            frame = int(frames[begin])
            for t in [t for t, v in active.items() if frame - v[0] > lost]:
                del active[t]
            named, last = np.unique(ids[begin:end][::-1], return_index=True)  # an id that comes twice has its last box
            order = sorted(active)
            to = matched(np.array([active[t][1:5] for t in order]).reshape(-1, 4), boxes[begin:end][::-1][last], least)
            of = {int(i): order[k] for i, k in zip(named.tolist(), to.tolist(), strict=True) if k >= 0}
            new = 0
            for i, box, sureness in zip(ids[begin:end].tolist(), boxes[begin:end].tolist(), confidence[begin:end], strict=True):
                if i not in of and sureness >= sure:
                    of[i] = frame << 20 | new
                    new += 1
                if i in of:
                    active[of[i]] = [float(frame), *box, sureness]
                out.append((key[0], frame, i, of.get(i), sureness))
            seen = set(of.values())
            for t, v in active.items():
                if t not in seen:
                    v[5] *= decay
        return [[t, *map(float, v)] for t, v in active.items()], out

    step.whole = True
    cols = ["media_id", "ts", "frame", "id", "x", "y", "w", "h", "confidence"]
    return in_order(regions.select(*cols), ["media_id"], ["micros", "frame", "id"], "media_id bigint, frame bigint, id bigint, track bigint, confidence double", [], step, late, idle)


def chain_check(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(chain, sequence, ok, reason): each event (chain, ts, …) held against the digest before it; the state is the last number and digest, and what came early.

    An event waits until the one before it has come, or until the watermark has passed it: only then it leaves a gap, and the chain
    goes on from it.  An event whose place the chain has left is reported as `late` and changes nothing.
    """
    def step(key: tuple, value: list, wait: list, passed: int) -> tuple[list, list, list]:
        (number, last), out, kept = value, [], []
        for r in (r._asdict() for r in wait):
            if r["sequence"] > number + 1 and r["micros"] > passed:
                kept.append(r["Index"])
                continue
            fields = {f: json.loads(r[f]) if f == "details" else None if r[f] is None or r[f] != r[f] else r[f] for f in FIELDS}
            own = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            behind = r["sequence"] <= number
            reason = "late" if behind else "gap" if r["sequence"] != number + 1 else "link" if r["previous_event_hash"] != last else "contents" if own != r["event_hash"] else None
            out.append((key[0], r["sequence"], reason is None, reason))
            number, last = (number, last) if behind else (int(r["sequence"]), r["event_hash"])
        return [number, last], out, kept

    step.early = True
    rows = events.withColumn("details", F.to_json("details")).select("chain", "ts", *FIELDS, "event_hash")
    return in_order(rows, ["chain"], ["sequence"], "chain bigint, sequence bigint, ok boolean, reason string", [0, GENESIS], step, late)


def lost_runs(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(run_id, started): runs (run_id, ts, done) that no event ended within so many seconds, given when the watermark has passed that time; rows without a run are left out."""
    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = _unpacked(state.get[0] if state.exists else None)
        if not state.hasTimedOut:
            runs += [p[["run_id", "micros", "done"]] for p in parts]
        known = pd.concat(runs).groupby("run_id", as_index=False).agg({"micros": "min", "done": "max"})
        passed, ends = state.getCurrentWatermarkMs(), known["micros"] // 1000 + seconds * 1000
        lost, open_ = known[(ends < passed) & ~known["done"]], known[ends >= passed]
        if len(open_):
            state.update((_packed(open_),))
            state.setTimeoutTimestamp(max(passed + 1, int(ends.loc[open_.index].min())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"run_id": lost["run_id"], "started": pd.to_datetime(lost["micros"], unit="us")})

    rows = events.select("run_id", "ts", F.unix_micros("ts").alias("micros"), "done").withWatermark("ts", late).where("run_id IS NOT NULL OR ts < '0001-01-02'")  # with the time in it the rule stays above the watermark
    return rows.withColumn("part", _part("run_id")).groupBy("part").applyInPandasWithState(run, "run_id bigint, started timestamp", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
