"""Sorted runs: cutting into key ranges, and the external k-way merge of the runs of each range.

A run is a stretch of rows whose keys do not fall, as they come from one partition: a
sorted file, or a partition that was sorted by itself. Runs are cut into small blocks, and
only blocks travel: a block is one row, with its range, its first key and its rows. The
blocks of a range come to one task in the order of their first keys, and a block is opened
when the merge reaches its first key, so the task holds at any time only the blocks that
overlap the current key, one of each run, whatever the length of the range.

Ranges are cut where the running weight of all blocks, in the order of their first keys,
passes the size of a range; their number is the weight divided by that size. A key is a
list of string columns; null counts as the empty string in the order and stays null in the
rows. Equal keys are all kept and never parted.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.operators.dataset import running_sum, with_position

BLOCK = 256


def _keys_of(batch: pa.RecordBatch, width: int) -> list[tuple]:
    """The keys of a batch whose first columns are the key."""
    return list(zip(*[["" if x is None else x for x in batch.column(i).to_pylist()] for i in range(width)]))


def _stretches(keys: list[tuple], cuts: list[tuple], block: int) -> Iterator[tuple[int, int, int, bool]]:
    """(begin, end, range, new run) of the blocks of a batch."""
    at = 0
    while at < len(keys):
        number = bisect_right(cuts, keys[at])
        above = cuts[number] if number < len(cuts) else None
        end, fell = at + 1, at > 0 and keys[at] < keys[at - 1]
        while end < len(keys) and end - at < block and keys[end] >= keys[end - 1] and (above is None or keys[end] < above):
            end += 1
        yield at, end, number, fell
        at = end


def _prepared(df: DataFrame, key: list[str], weight: Column | str, *columns: str) -> DataFrame:
    """The key, the weight and the named columns."""
    w = F.col(weight) if isinstance(weight, str) else weight
    keys = [F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(key)]
    return df.select(*keys, F.coalesce(w.cast("double"), F.lit(0.0)).alias("__w"), *columns)


def cut_points(df: DataFrame, key: list[str], weight: Column | str, size: float, block: int = BLOCK) -> list[tuple]:
    """The first keys of all ranges but the first: where the running weight of the blocks passes a multiple of ``size``."""
    width = len(key)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, weights = _keys_of(b, width), b.column(width).to_pylist()
            got = [(list(keys[i]), sum(weights[i:j])) for i, j, _, _ in _stretches(keys, [], block)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.list_(pa.string())), pa.array([w for _, w in got], pa.float64())], names=["first", "w"])

    first = _prepared(df, key, weight).mapInArrow(heads, "first array<string>, w double")
    placed = running_sum(with_position(first, "first", "w"), "w")
    ranges = placed.groupBy(F.floor(F.col("_cum") / size).alias("r")).agg(F.min("first").alias("first")).where("r > 0")
    return sorted({tuple(r["first"]) for r in ranges.collect()})


def range_weights(df: DataFrame, key: list[str], weight: Column | str, cuts: list[tuple], block: int = BLOCK) -> dict[int, float]:
    """The weight of each range, one row a range."""
    width = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, weights = _keys_of(b, width), b.column(width).to_pylist()
            got: dict[int, float] = {}
            for i, j, number, _ in _stretches(keys, cuts, block):
                got[number] = got.get(number, 0.0) + sum(weights[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.float64())], names=["range", "w"])

    rows = _prepared(df, key, weight).mapInArrow(run, "range int, w double").groupBy("range").agg(F.sum("w").alias("w"))
    return {r["range"]: r["w"] for r in rows.collect()}


def _blocks(width: int, cuts: list[tuple], block: int):
    """Rows, the key first, into blocks: one row of (range, first, run, seq, rows) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seq, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = _keys_of(b, width)
            if last is not None and keys[0] < last:
                number += 1
            last = keys[-1]
            found, runs = list(_stretches(keys, cuts, block)), []
            for *_, fell in found:
                number += fell
                runs.append(number)
            rows = pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
            lists = pa.ListArray.from_arrays(pa.array([i for i, *_ in found] + [len(keys)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for _, _, r, _ in found], pa.int32()), pa.array([list(keys[i]) for i, *_ in found], pa.list_(pa.string())),
                 pa.array(runs, pa.int64()), pa.array(range(seq, seq + len(found)), pa.int64()), lists],
                names=["range", "first", "run", "seq", "rows"],
            )
            seq += len(found)

    return run


class _Rolled:
    """Rows taken in merged order, gathered into batches with their range and output."""

    def __init__(self, target: float, least: float, totals: dict[int, float]):
        self.target, self.least, self.totals = target, least, totals
        self.blocks: list[pa.StructArray] = []
        self.taken: list[tuple[int, int]] = []
        self.ranges: list[int] = []
        self.outputs: list[int] = []
        self.number: int | None = None
        self.output, self.held, self.seen = 0, 0.0, 0.0

    def add(self, number: int, place: tuple[int, int], weight: float) -> None:
        if number != self.number:
            self.number, self.output, self.held, self.seen = number, 0, 0.0, 0.0
        left = self.totals.get(number, 0.0) - self.seen
        # a new output opens before the row that exceeds the target, if this one and what is left are large enough
        if self.held and self.held + weight > self.target and self.held >= self.least and left >= self.least:
            self.output, self.held = self.output + 1, 0.0
        self.held, self.seen = self.held + weight, self.seen + weight
        self.taken.append(place)
        self.ranges.append(number)
        self.outputs.append(self.output)


def _merge(width: int, roll: _Rolled, names: list[str], batch_rows: int = 4096):
    """The k-way merge over blocks that come in the order of (range, first key)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, pa.StructArray]]:
        for b in batches:
            rows = b.column(4)
            for j, (number, first) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                yield number, tuple(first), rows[j].values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = opened(batches)
        coming = next(source, None)
        heap: list[tuple] = []
        held: dict[int, list] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            used = sorted({n for n, _ in roll.taken})
            starts, total = {}, 0
            for n in used:
                starts[n] = total
                total += len(held[n][0])
            joined = pa.concat_arrays([held[n][0] for n in used]).take(pa.array([starts[n] + i for n, i in roll.taken], pa.int64()))
            out = pa.RecordBatch.from_arrays(
                [*joined.flatten(), pa.array(roll.ranges, pa.int32()), pa.array(roll.outputs, pa.int32())], names=[*names, "range", "output"]
            )
            for n in used:
                if held[n][3]:
                    del held[n]
            roll.taken, roll.ranges, roll.outputs = [], [], []
            return out

        while coming is not None or heap:
            number = coming[0] if not heap else heap[0][3]
            while coming is not None and coming[0] == number and (not heap or coming[1] <= heap[0][0]):
                rows = coming[2]
                columns = rows.flatten()
                keys = list(zip(*[["" if x is None else x for x in columns[i].to_pylist()] for i in range(width)]))
                held[count] = [rows, keys, columns[width].to_pylist(), False]
                heapq.heappush(heap, (keys[0], count, 0, number))
                count += 1
                coming = next(source, None)
            key, n, i, _ = heap[0]
            block = held[n]
            roll.add(number, (n, i), block[2][i])
            if i + 1 < len(block[1]):
                heapq.heapreplace(heap, (block[1][i + 1], n, i + 1, number))
            else:
                heapq.heappop(heap)
                block[3] = True
            if len(roll.taken) >= batch_rows:
                yield flush()
        if roll.taken:
            yield flush()

    return run


def merged(
    df: DataFrame, key: list[str], weight: Column | str, target: float, least: float = 0.0, per_range: int = 64, ranges: int | None = None, part_at: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of all runs in the order of the key, with ``range`` and ``output``; outputs roll at about ``target`` of weight.

    A range holds about ``per_range`` outputs. An output is closed before the row that would
    exceed the target unless it, or what is left of its range, holds less than ``least``.
    Rows that agree in the first ``part_at`` columns of the key stay in one range.
    The frame is read three times, twice of these the key and weight only: give it written.
    """
    size = target * per_range
    if ranges is not None:
        total = _prepared(df, key, weight).agg(F.sum("__w").alias("w")).first()["w"] or 0.0
        size = max(total / max(1, ranges), 1e-9)
    cuts = sorted({c[:part_at] for c in cut_points(df, key, weight, size, block)})
    totals = range_weights(df, key, weight, cuts, block)
    keyed = _prepared(df, key, weight, *df.columns)
    packed = T.StructType().add("range", T.IntegerType()).add("first", T.ArrayType(T.StringType())).add("run", T.LongType()).add("seq", T.LongType()).add("rows", T.ArrayType(keyed.schema))
    blocks = keyed.mapInArrow(_blocks(len(key), cuts, block), packed)
    work = blocks.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "first", "run", "seq")
    names = keyed.columns
    out = T.StructType(list(keyed.schema.fields)).add("range", T.IntegerType()).add("output", T.IntegerType())
    done = work.mapInArrow(_merge(len(key), _Rolled(target, least, totals), names), out)
    return done.select(*df.columns, "range", "output")
