"""Continuous periods over a stream of deliveries: the interval map of voxtile.operators.coverage in keyed state.

State is kept per (recording, time chunk). Every delivery is inserted by binary search;
the key's periods go out anew when they have changed, with a version. A repeated delivery
changes nothing; a late one merges where it belongs. Once the watermark has passed a
chunk's last delivery its state is dropped; the reader of the sink merges what comes later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtile.operators.coverage import CHUNK_MS, IntervalMap
from voxtile.session import finite, whole_ms

OUT = "recording_id string, chunk long, version long, start_ms long, end_ms long"
STATE = "starts array<long>, ends array<long>, version long"


def _update(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    starts, ends, version = state.get if state.exists else ([], [], 0)
    held = IntervalMap(list(starts), list(ends))
    before = (held.starts[:], held.ends[:])
    last = 0
    for pdf in pdfs:
        last = max(last, int(pdf["received"].max().timestamp() * 1000))
        for s, e in zip(pdf["start_ms"], pdf["end_ms"]):
            held.insert(int(s), int(e))
    if (held.starts, held.ends) != before:
        version += 1
        yield pd.DataFrame({"recording_id": key[0], "chunk": key[1], "version": version, "start_ms": held.starts, "end_ms": held.ends})
    state.update((held.starts, held.ends, version))
    # dropped once the watermark has passed the key's last delivery
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)


def period_stream(deliveries: DataFrame, late: str = "7 days", chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(recording_id, chunk, version, start_ms, end_ms): the periods of each chunk, again at each change."""
    d = deliveries.where(F.col("recording_id").isNotNull() & (finite(F.col("duration")) > 0))
    d = d.withColumn("start_ms", whole_ms(F.col("start"))).withColumn("end_ms", whole_ms(F.col("start") + F.col("duration"))).where("start_ms is not null")
    d = d.withColumn("received", F.col("received_at").cast("timestamp")).withWatermark("received", late)
    d = d.select("recording_id", F.floor(F.col("start_ms") / chunk_ms).cast("long").alias("chunk"), "start_ms", "end_ms", "received")
    return d.groupBy("recording_id", "chunk").applyInPandasWithState(_update, OUT, STATE, "update", "EventTimeTimeout")


def latest_periods(written: DataFrame) -> DataFrame:
    """(recording_id, chunk, start_ms, end_ms): the periods of all that a period stream wrote.

    Periods only grow, so all versions of a chunk are merged: what was delivered after the
    chunk's state was dropped, and so counts from a first version again, adds to what was
    known before and replaces nothing.
    """
    keys = ["recording_id", "chunk"]
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    edge = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = written.select(*keys, "start_ms", "end_ms").distinct()
    marked = rows.withColumn("fresh", (edge.isNull() | (F.col("start_ms") > edge)).cast("int"))
    numbered = marked.withColumn("k", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "k").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("k")
