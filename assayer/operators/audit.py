"""Hash-linked events: their canonical digest, chains built in order, checked in parallel, and pages of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fields of a digest, and what the first event links to.
FIELDS = ["action", "actor", "analysis_id", "case_id", "details", "media_id", "occurred_at", "previous_event_hash", "sequence"]
GENESIS = "0" * 64
#: How a broken chain is reported.
LINK_BROKEN, CONTENTS_BROKEN, GAP = "link does not match the preceding event's hash", "event contents do not match its recorded hash", ("expected sequence ", ", found ")


def event_hash(previous: Column | str = "previous_event_hash") -> Column:
    """Digest of an event's fields as JSON: keys in order, nulls kept, no blanks; details are a map of strings, in key order."""
    before = F.col(previous) if isinstance(previous, str) else previous
    details = F.map_from_entries(F.array_sort(F.map_entries("details")))
    fields = [details.alias(f) if f == "details" else before.alias(f) if f == "previous_event_hash" else F.col(f) for f in FIELDS]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def chained(events: DataFrame, chain: str = "chain") -> DataFrame:
    """Events with previous_event_hash and event_hash.

    A digest needs the one before it, so a chain is made in order; its sorted run is read in batches, and only the last digest is held.
    """
    names = [c for c in events.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            for row in batch.to_pylist():
                if row[chain] != of:
                    of, last = row[chain], GENESIS
                fields = {f: last if f == "previous_event_hash" else dict(row[f]) if f == "details" else row[f] for f in FIELDS}
                before.append(last)
                last = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*names, "previous_event_hash", "event_hash"])

    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return events.repartition(chain).sortWithinPartitions(chain, "sequence").mapInArrow(run, f"{fields}, previous_event_hash string, event_hash string")


def verify(events: DataFrame, chain: str = "chain") -> DataFrame:
    """(chain, intact, events_checked, head_hash, first_broken_sequence, reason) of each chain.

    An event is held against all whose number precedes its own by one: one sort by chain and number of digests alone, as an event's own
    contents are checked where it is read.  Windows spill, so no task needs a whole chain in memory.
    Before the first broken event numbers run from 1 without a gap, which is how many were checked.
    """
    own = events.select(chain, "sequence", "previous_event_hash", "event_hash", (event_hash() == F.col("event_hash")).alias("_same"))
    order = W.partitionBy(chain).orderBy("sequence")
    before = order.rangeBetween(-1, -1)
    known = F.col("sequence").isNotNull()
    each = own.withColumns({"_low": F.when(known, F.min("event_hash").over(before)), "_high": F.when(known, F.max("event_hash").over(before))})
    expected = lambda c: F.when(F.col("sequence") == 1, F.lit(GENESIS)).otherwise(F.col(c))
    other = (F.col("previous_event_hash") != expected("_low")) | (F.col("previous_event_hash") != expected("_high"))
    fault = F.when(expected("_low").isNull(), "gap").when(other, "link").when(~F.col("_same"), "contents")
    each = each.withColumn("fault", fault)
    reached = F.max(F.col("fault").isNotNull()).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    good = ~F.col("_bad")
    out = each.withColumn("_bad", reached).groupBy(chain).agg(
        F.min(F.when(F.col("fault").isNotNull(), F.struct("sequence", "fault"))).alias("broken"), F.count_if(good).alias("events_checked"), F.max_by(F.when(good, F.col("event_hash")), F.when(good, F.col("sequence"))).alias("head_hash")
    )
    reason = F.when(F.col("broken.fault") == "gap", F.concat(F.lit(GAP[0]), (F.col("events_checked") + 1).cast("string"), F.lit(GAP[1]), F.col("broken.sequence").cast("string"))).when(F.col("broken.fault") == "link", LINK_BROKEN).when(F.col("broken.fault") == "contents", CONTENTS_BROKEN)
    return out.select(chain, F.col("broken").isNull().alias("intact"), "events_checked", "head_hash", F.col("broken.sequence").alias("first_broken_sequence"), reason.alias("reason"))


def heads(events: DataFrame, chain: str = "chain") -> DataFrame:
    """The last event of each chain: its number and digest."""
    return events.groupBy(chain).agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("head_hash"), F.count("*").alias("events"))


def page(events: DataFrame, offset: int, limit: int, **equal: object) -> DataFrame:
    """Events that have the given values, in order, a page of them."""
    for name, value in equal.items():
        events = events.where(F.col(name) == F.lit(value))
    return events.orderBy("sequence", "chain").offset(offset).limit(limit)
