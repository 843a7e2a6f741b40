"""Continuous periods and silences of overlapping, nested and touching intervals (problem 3).

Method: an ordered map of disjoint intervals per entity is kept in keyed state; each
insertion finds its overlaps by binary search, merges them and so updates the gaps.
The same map serves the batch operator and the streaming one (voxtile.streaming.coverage).

Scale: state is keyed by (entity, time chunk), so an entity that holds a third of all
rows is spread over many tasks. What one chunk must know of the chunks before it, the
latest end so far, comes from a per-chunk summary (one row per entity and chunk) and is
joined to the chunk before its state is built.

Defined results: rows with a null entity, an absent or non-finite start, or a duration
that is absent or not above zero take no part; repeated deliveries of one id count once;
equal rows and ties merge; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtile.session import SEGMENT_FIELDS, finite, first_delivery, keyed_stream, rows_to_batch, whole_ms

CHUNK_MS = 600_000
MAX_GAP_MS = 600_000


class IntervalMap:
    """Disjoint intervals in order; those that overlap or touch are one."""

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def segment_spans(supervision: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(recording_id, start_ms, end_ms, id, extra...) of the segments that take part."""
    segs = first_delivery(supervision, SEGMENT_FIELDS, ["recording_id", "start", "duration", *(extra or [])])
    return (
        segs.where(F.col("recording_id").isNotNull() & (finite(F.col("duration")) > 0))
        .withColumn("start_ms", whole_ms(F.col("start")))
        .withColumn("end_ms", whole_ms(F.col("start") + F.col("duration")))
        .where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
        .select("recording_id", "start_ms", "end_ms", "id", *(extra or []))
    )


class _Chunk:
    """State of one (recording, chunk): its interval map and the latest end before it."""

    def __init__(self, key: tuple):
        self.key, self.map, self.carry = key, IntervalMap(), None

    def add(self, row: tuple) -> None:
        _, _, start, end, self.carry = row
        self.map.insert(start, end)

    def finish(self) -> list[tuple]:
        rec, chunk = self.key
        rows, edge = [], self.carry
        for s, e in zip(self.map.starts, self.map.ends):
            fresh = edge is None or s > edge
            rows.append((rec, chunk, s, e, fresh, edge if fresh else None))
            edge = e if edge is None else max(edge, e)
        return rows


_PIECES = pa.schema(
    [
        ("recording_id", pa.string()),
        ("chunk", pa.int64()),
        ("start_ms", pa.int64()),
        ("end_ms", pa.int64()),
        ("fresh", pa.bool_()),
        ("edge_ms", pa.int64()),
    ]
)


def chunk_pieces(spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Disjoint intervals per (recording, chunk); ``fresh`` ones open a period, ``edge_ms`` is the end before the gap."""
    spans = spans.select(
        "recording_id", F.floor(F.col("start_ms") / chunk_ms).cast("long").alias("chunk"), "start_ms", "end_ms"
    )
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        spans.groupBy("recording_id", "chunk")
        .agg(F.max("end_ms").alias("chunk_end"))
        .select("recording_id", "chunk", F.max("chunk_end").over(before).alias("carry"))
    )
    work = spans.join(carry, ["recording_id", "chunk"]).select("recording_id", "chunk", "start_ms", "end_ms", "carry")
    # after the join, so that no plan of the join can part a chunk
    work = work.repartition("recording_id", "chunk").sortWithinPartitions("recording_id", "chunk", "start_ms")
    run = keyed_stream(["recording_id", "chunk"], _Chunk, lambda rows: rows_to_batch(rows, _PIECES))
    return work.mapInArrow(
        run, "recording_id string, chunk long, start_ms long, end_ms long, fresh boolean, edge_ms long"
    )


def silences(spans: DataFrame, min_ms: int = 1, max_ms: int | None = MAX_GAP_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(recording_id, gap_start_ms, gap_end_ms): longest stretches between first start and last end without a segment."""
    gaps = chunk_pieces(spans, chunk_ms).where("fresh and edge_ms is not null")
    gaps = gaps.select("recording_id", F.col("edge_ms").alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
    length = F.col("gap_end_ms") - F.col("gap_start_ms")
    gaps = gaps.where(length >= min_ms)
    return gaps if max_ms is None else gaps.where(length <= max_ms)


def periods(spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(recording_id, start_ms, end_ms): continuous periods; those that span chunks are put together."""
    pieces = chunk_pieces(spans, chunk_ms)
    fresh = pieces.where("fresh").select("recording_id", "start_ms", "end_ms")
    # One row per recording and chunk: what opened last in it, and how far it extends the period opened before it.
    summary = pieces.groupBy("recording_id", "chunk").agg(
        F.max(F.when(F.col("fresh"), F.col("start_ms"))).alias("opened"),
        F.max(F.when(~F.col("fresh"), F.col("end_ms"))).alias("extends_to"),
    )
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    extended = summary.select(
        "recording_id", F.last("opened", ignorenulls=True).over(before).alias("start_ms"), F.col("extends_to").alias("end_ms")
    ).where("end_ms is not null")
    return fresh.unionByName(extended).groupBy("recording_id", "start_ms").agg(F.max("end_ms").alias("end_ms"))


def coverage_report(spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Per recording: number of periods, covered ms, silent ms between them."""
    p = periods(spans, chunk_ms).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"),
        F.min("start_ms").alias("first_ms"),
        F.max("end_ms").alias("last_ms"),
    )
    return p.withColumn("silent_ms", F.col("last_ms") - F.col("first_ms") - F.col("covered_ms"))
