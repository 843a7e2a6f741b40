"""Construction of mini-batches: constraints, buckets, greedy batching, distribution to ranks, packing.

A greedy batch depends on the items before only by where it starts. The items of a stratum
are cut into ranges of their order. A batch that comes into a range from before ends there no
later than one that starts with the range would, as it already holds more; so a range tells,
for each start within its own first batch, which open batch it ends with and how many it
closes. One pass over these few rows finds what each range is handed, and all ranges are then
numbered at once. The number of Spark jobs does not depend on the number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtile.functions.timeops import hash_int, to_us
from voxtile.operators.dataset import running_sum, with_position
from voxtile.session import checkpointed, keyed_stream, rows_to_batch


@dataclass(frozen=True)
class Constraint:
    """Bounds of a batch. ``measure`` is seconds or tokens; padded size is count times longest unless items are concatenated."""

    max_total: float | None = None
    max_items: int | None = None
    quadratic: float | None = None
    concatenate: bool = False

    @property
    def needs_order(self) -> bool:
        """Whether sizes below 0 or no numbers, if there are any, may let a batch that holds more end later."""
        return self.concatenate and self.max_total is not None

    def size(self, measure: float) -> float:
        return measure if self.quadratic is None else measure + measure * measure / self.quadratic

    def exceeded(self, n: int, longest: float, total: float) -> bool:
        if self.max_items is not None and n > self.max_items:
            return True
        return self.max_total is not None and (total if self.concatenate else n * longest) > self.max_total

    def close_to_exceeding(self, n: int, longest: float, total: float) -> bool:
        if self.max_items is not None and n >= self.max_items:
            return True
        if self.max_total is None:
            return False
        return total > self.max_total if self.concatenate else (n + 1) * longest > self.max_total


class Greedy:
    """One open batch. ``simple`` closes before the item that would exceed; ``dynamic`` closes after one that nearly exceeds.

    ``state`` is (items, longest, total) of the open batch; a batch can go on from it.
    """

    EMPTY = (0.0, 0.0, 0.0)

    def __init__(self, constraint: Constraint, mode: str, state: tuple[float, ...] = EMPTY):
        if mode not in ("simple", "dynamic"):
            raise ValueError("mode is simple or dynamic")
        self.c, self.simple, self.batch = constraint, mode == "simple", 0
        self.n, self.longest, self.total = int(state[0]), state[1], state[2]

    @property
    def state(self) -> tuple[float, ...]:
        return (float(self.n), self.longest, self.total)

    @property
    def constraints(self) -> list[Constraint]:
        return [self.c]

    def sizes(self, measure: np.ndarray) -> list[np.ndarray]:
        return [self.c.size(measure)]

    def closes(self, n: int, longest: list, total: list):
        """Whether a batch that comes to this is closed: before its last item if ``simple``, else after it."""
        return (self.c.exceeded if self.simple else self.c.close_to_exceeding)(n, longest[0], total[0])

    def _open(self) -> None:
        self.n, self.longest, self.total = 0, 0.0, 0.0

    def add(self, measure: float) -> int:
        size = self.c.size(measure)
        if self.simple and self.n and self.c.exceeded(self.n + 1, max(self.longest, size), self.total + size):
            self.batch += 1
            self._open()
        self.n, self.longest, self.total = self.n + 1, max(self.longest, size), self.total + size
        number = self.batch
        if not self.simple and self.c.close_to_exceeding(self.n, self.longest, self.total):
            self.batch += 1
            self._open()
        return number


class GreedyPairs:
    """One open batch of pairs under two constraints; a pair that would break either opens the next."""

    EMPTY = (0.0, 0.0, 0.0, 0.0, 0.0)
    simple = True

    def __init__(self, source: Constraint, target: Constraint, state: tuple[float, ...] = EMPTY):
        self.source, self.target, self.batch = source, target, 0
        self.n, self.long, self.sums = int(state[0]), list(state[1:3]), list(state[3:5])

    @property
    def state(self) -> tuple[float, ...]:
        return (float(self.n), *self.long, *self.sums)

    @property
    def constraints(self) -> list[Constraint]:
        return [self.source, self.target]

    def sizes(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [self.source.size(a), self.target.size(b)]

    def closes(self, n: int, longest: list, total: list):
        return np.logical_or(self.source.exceeded(n, longest[0], total[0]), self.target.exceeded(n, longest[1], total[1]))

    def add(self, a: float, b: float) -> int:
        sizes = [self.source.size(a), self.target.size(b)]
        longest = [max(x, y) for x, y in zip(self.long, sizes)]
        sums = [x + y for x, y in zip(self.sums, sizes)]
        if self.n and (self.source.exceeded(self.n + 1, longest[0], sums[0]) or self.target.exceeded(self.n + 1, longest[1], sums[1])):
            self.batch, self.n, longest, sums = self.batch + 1, 0, sizes, sizes
        self.n, self.long, self.sums = self.n + 1, longest, sums
        return self.batch


RANGE = 65_536
#: Where batches have more items than this, a range's items are followed one by one instead of from each start.
WIDE = 1_024


def _ends_of_range(machine: Greedy | GreedyPairs, measures: list[np.ndarray]) -> tuple[list[tuple], list[int]] | None:
    """For each start within the first batch of a range: the state that the range ends with, and the batches it closes.

    All starts take their k-th item at once. None where sizes are below 0 or no numbers, as a
    batch that holds more need not end earlier then, or where batches are wide.
    """
    sizes, n = machine.sizes(*measures), len(measures[0])
    if not all((s >= 0).all() for s in sizes):
        return None
    after = np.full(n, -1)  # start of the next batch; -1: open at the end
    left: dict[int, tuple] = {n: machine.EMPTY}
    at, longest, total, k = np.arange(n), sizes, sizes, 1
    while at.size:
        if k > WIDE:
            return None
        if not machine.simple:
            shut = np.broadcast_to(machine.closes(k, longest, total), at.shape)
            after[at[shut]] = at[shut] + k
            at, longest, total = at[~shut], [x[~shut] for x in longest], [x[~shut] for x in total]
        if at.size and at[-1] + k == n:
            left[int(at[-1])] = (float(k), *[float(x[-1]) for x in longest], *[float(x[-1]) for x in total])
            at, longest, total = at[:-1], [x[:-1] for x in longest], [x[:-1] for x in total]
        item = [s[at + k] for s in sizes]
        longest, total = [np.maximum(x, y) for x, y in zip(longest, item)], [x + y for x, y in zip(total, item)]
        if machine.simple:
            shut = np.broadcast_to(machine.closes(k + 1, longest, total), at.shape)
            after[at[shut]] = at[shut] + k
            at, longest, total = at[~shut], [x[~shut] for x in longest], [x[~shut] for x in total]
        k += 1
    following = after.tolist()
    last, closed = [n] * (n + 1), [0] * (n + 1)
    for p in range(n - 1, -1, -1):
        if (q := following[p]) < 0:
            last[p] = p
        else:
            last[p], closed[p] = last[q], closed[q] + 1
    head = min(following[0] + 1, n) if following[0] >= 0 else n
    return [left[q] for q in last[:head]], closed[:head]


def _keyed_tables(keys: list[str], work: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function for input that is hash-partitioned and sorted by whole-number keys whose rows fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).min
        current, kept, ready = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).fill_null(none).to_numpy() for k in keys]
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *turns.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(None if c[a] == none else int(c[a]) for c in cols)
                if kept and key != current:
                    ready.append(work(current, pa.Table.from_batches(kept)))
                    kept = []
                    if sum(t.num_rows for t in ready) >= 20_000 or len(ready) >= 1_000:
                        yield from pa.concat_tables(ready).combine_chunks().to_batches()
                        ready = []
                current = key
                kept.append(batch.slice(a, b - a))
        if kept:
            ready.append(work(current, pa.Table.from_batches(kept)))
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return run


def _in_order(rows: DataFrame, measures: list[str], start: Callable[[tuple], Greedy | GreedyPairs], empty: tuple, size: int = RANGE) -> DataFrame:
    """(stratum, id, measures, batch) of rows (stratum, id, measures, __o): each stratum batched in the order of __o and id."""
    keys = ["stratum", "range"]
    placed = with_position(rows, "stratum", "__o", "id").withColumn("range", F.floor(F.col("_pos") / size).cast("long"))
    placed = placed.select(*keys, "_pos", "id", *measures)
    width = len(measures)
    summed = [(m, c) for m, c in zip(measures, start(empty).constraints) if c.needs_order]
    odd = any((c.quadratic or 0) < 0 or placed.where((F.col(m) < 0) | F.isnan(m)).head(1) for m, c in summed)
    numbers = [pa.field(m, pa.float64()) for m in measures]
    spelt = "".join(f"{m} double, " for m in measures)
    told = pa.schema([("stratum", pa.int64()), ("range", pa.int64()), ("_pos", pa.int64()), *numbers, ("end", pa.list_(pa.float64())), ("closed", pa.int64())])

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        """The first rows of a range with what it ends with if a batch starts there; all rows without it where that is not known."""
        found = None if odd else _ends_of_range(start(empty), [table[m].to_numpy() for m in measures])
        if found is not None:
            table = table.slice(0, len(found[1]))
        n = table.num_rows
        ends, closed = found or ([None] * n, [None] * n)
        cols = [table["stratum"], table["range"], table["_pos"], *[table[m] for m in measures], pa.array([None if e is None else list(e) for e in ends], told.field("end").type), pa.array(closed, pa.int64())]
        return pa.Table.from_arrays(cols, schema=told)

    handed = pa.schema([("stratum", pa.int64()), ("range", pa.int64()), ("entry", pa.list_(pa.float64())), ("base", pa.int64())])

    class Followed:
        """The batches of a stratum from range to range: item by item until one starts, from there to the range's end."""

        def __init__(self, key: tuple):
            self.key, self.machine, self.range, self.through, self.out = key[0], start(empty), None, False, []

        def add(self, row: tuple) -> None:
            if row[1] != self.range:
                self.range, self.through = row[1], False
                self.out.append((self.key, self.range, list(self.machine.state), self.machine.batch))
            if self.through:
                return
            end, closed = row[-2:]
            starts = self.machine.n == 0
            if not starts or end is None:
                self.machine.add(*row[3 : 3 + width])
                starts = self.machine.n == 1
            if starts and end is not None:
                batch = self.machine.batch + closed
                self.machine, self.through = start(tuple(end)), True
                self.machine.batch = batch

        def finish(self) -> list[tuple]:
            return self.out

    schema = pa.schema([("stratum", pa.int64()), ("id", pa.string()), *numbers, ("batch", pa.int64())])

    def number(key: tuple, table: pa.Table) -> pa.Table:
        machine, base = start(tuple(table["entry"][0].as_py())), table["base"][0].as_py()
        table = table.slice(1)
        batch = [base + machine.add(*x) for x in zip(*[table[m].to_numpy().tolist() for m in measures])]
        return pa.Table.from_arrays([table["stratum"], table["id"].cast(pa.string()), *[table[m] for m in measures], pa.array(batch, pa.int64())], schema=schema)

    work = placed.select(*keys, "_pos", *measures).repartition(*keys).sortWithinPartitions(*keys, "_pos")
    ends = work.mapInArrow(_keyed_tables(keys, tell), f"stratum long, range long, _pos long, {spelt}end array<double>, closed long")
    ends = ends.repartition("stratum").sortWithinPartitions("stratum", "range", "_pos")
    entries = ends.mapInArrow(keyed_stream(["stratum"], Followed, lambda out: rows_to_batch(out, handed)), "stratum long, range long, entry array<double>, base long")
    first = entries.select(*keys, F.lit(-1).cast("long").alias("_pos"), F.lit(None).cast("string").alias("id"), *[F.lit(0.0).alias(m) for m in measures], "entry", "base")
    work = first.unionByName(placed.withColumns({"entry": F.lit(None).cast("array<double>"), "base": F.lit(None).cast("long")}))
    work = work.repartition(*keys).sortWithinPartitions(*keys, "_pos")
    return work.mapInArrow(_keyed_tables(keys, number), f"stratum long, id string, {spelt}batch long")


def greedy_batches(df: DataFrame, constraint: Constraint, measure: str = "duration", mode: str = "dynamic", stratum: str | None = None, order: tuple[str, ...] = ("id",), size: int = RANGE) -> DataFrame:
    """(stratum, id, measure, batch): greedy batches of each stratum in the given order, or of the whole set."""
    Greedy(constraint, mode)
    cols = df.select(
        (F.col(stratum).cast("long") if stratum else F.lit(0).cast("long")).alias("stratum"),
        F.col("id").cast("string").alias("id"), F.col(measure).cast("double").alias("measure"),
        F.struct(*order).alias("__o"),
    ).where("measure is not null")
    return _in_order(cols, ["measure"], lambda state: Greedy(constraint, mode, state), Greedy.EMPTY, size)


def bucket_of(length: Column, bounds: list[float]) -> Column:
    """The bucket of a length; a length equal to a bound goes to the lower one."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(length > b, 1).otherwise(0)
    return out


def duration_bins(df: DataFrame, buckets: int, measure: str = "duration") -> list[float]:
    """Bounds of buckets of about equal mass: over sorted lengths a bound is set where the running sum already exceeds the share, and the sum starts anew.

    Lengths are summed in whole microseconds, so the result does not depend on the order
    of addition. One small aggregation per bound finds it in the sums before each position.
    """
    if buckets < 2:
        raise ValueError("at least two buckets")
    rows = df.where(F.col(measure).isNotNull()).select(F.col(measure).cast("double").alias("m"), to_us(measure).alias("us"))
    placed = checkpointed(running_sum(with_position(rows, "m"), "us"))  # read once for each bound
    total = placed.agg(F.sum("us").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"] or total["n"] < buckets:
        raise ValueError("fewer items than buckets")
    share, base, bounds = total["t"] / buckets, 0, []
    while True:
        hit = placed.where(F.col("_cum") - base > share).agg(F.min(F.struct("_pos", "m", "_cum")).alias("h")).first()["h"]
        if hit is None or len(bounds) > buckets:
            return bounds
        bounds.append(hit["m"])
        base = hit["_cum"]


def equal_mass_buckets(df: DataFrame, buckets: int, measure: str = "duration") -> DataFrame:
    """Adds ``bucket``: runs of sorted lengths with about equal sums, by the running sum before each row."""
    placed = running_sum(with_position(df.withColumn("__us", to_us(measure)), "__us", "id"), "__us")
    total = placed.agg(F.sum("__us").alias("t")).first()["t"] or 1
    return placed.withColumn("bucket", F.least(F.floor(F.col("_cum") * buckets / total), F.lit(buckets - 1)).cast("int")).drop("__us", "_pos", "_cum")


def fixed_size_batches(df: DataFrame, bounds: list[float], sizes: list[int], measure: str = "duration", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, bucket, batch): batches of a fixed number of items per length bucket; lengths above the last bound are an error.

    Positions within a bucket come from the global position less the bucket's first, so
    no bucket is gathered in one task.
    """
    if len(bounds) != len(sizes):
        raise ValueError("a size for each bound")
    bucket = bucket_of(F.col(measure), bounds)
    b = df.where(F.col(measure).isNotNull()).withColumn("bucket", F.when(bucket >= len(bounds), F.raise_error("an item is longer than the last bucket").cast("int")).otherwise(bucket))
    placed = with_position(b, "bucket", *order)
    firsts = {r["bucket"]: r["p"] for r in placed.groupBy("bucket").agg(F.min("_pos").alias("p")).collect()}  # one row a bucket
    pairs = [F.lit(x).cast("long") for k in sorted(firsts) for x in (k, firsts[k])] or [F.lit(0).cast("long"), F.lit(0).cast("long")]
    start = F.create_map(*pairs)[F.col("bucket").cast("long")]
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("bucket") + 1)
    return placed.select("id", "bucket", F.floor((F.col("_pos") - start) / size).cast("long").alias("batch"))


def rank_batches(batches: DataFrame, world: int, batch: str = "batch") -> DataFrame:
    """Adds ``rank`` and ``step``: batch i goes to rank i mod world at step i div world."""
    return batches.withColumn("rank", F.pmod(F.col(batch), F.lit(world)).cast("int")).withColumn("step", F.floor(F.col(batch) / world).cast("long"))


def spread_tail(batches: DataFrame, world: int, batch: str = "batch", drop_last: bool = False) -> DataFrame:
    """The last, incomplete round of batches: its items are dealt over all ranks, or dropped."""
    ranked = rank_batches(batches, world, batch)
    last = batches.agg(F.max(batch).alias("m")).first()["m"]
    if last is None or (last + 1) % world == 0:
        return ranked
    step = last // world
    if drop_last:
        return ranked.where(F.col("step") < step)
    tail = ranked.where(F.col("step") == step)  # fewer than world batches
    dealt = with_position(tail, batch, "id").withColumn("rank", F.pmod(F.col("_pos"), F.lit(world)).cast("int")).drop("_pos")
    return ranked.where(F.col("step") < step).unionByName(dealt)


def round_robin(samplers: list[DataFrame], batch: str = "batch") -> DataFrame:
    """Batches of several samplers in turn: adds ``sampler`` and ``turn``; one that has run out is passed over."""
    out = None
    for i, s in enumerate(samplers):
        s = s.withColumn("sampler", F.lit(i)).withColumn("turn", F.col(batch) * len(samplers) + i)
        out = s if out is None else out.unionByName(s)
    return out


def zip_batches(samplers: list[DataFrame], batch: str = "batch") -> DataFrame:
    """Batches of several samplers with one number together, up to the shortest: (batch, sampler, ...)."""
    out = round_robin(samplers, batch).drop("turn")
    last = min((s.agg(F.max(batch).alias("m")).first()["m"] if s.head(1) else -1) for s in samplers)
    return out.where(F.col(batch) <= last)


def concat_in_batches(batches: DataFrame, gap: float = 1.0, max_duration: float | None = None, duration: str = "duration") -> DataFrame:
    """(batch, row, id, offset): the items of each batch put one after another with a silence, the shortest into the first row that has room.

    A batch fits a task by its constraint.
    """
    schema = pa.schema([("batch", pa.int64()), ("row", pa.int64()), ("id", pa.string()), ("offset", pa.float64())])

    class State:
        def __init__(self, key):
            self.key, self.items = key[0], []

        def add(self, row):
            self.items.append((row[2], row[1]))

        def finish(self):
            items = sorted(self.items, key=lambda x: (-x[0], x[1]))
            limit = max_duration if max_duration is not None else (items[0][0] if items else 0.0)
            rows, out = [], []
            for d, i in items:
                at = next((k for k, end in enumerate(rows) if end + gap + d <= limit + 1e-9), None)
                if at is None:
                    rows.append(d)
                    out.append((self.key, len(rows) - 1, i, 0.0))
                else:
                    out.append((self.key, at, i, round(rows[at] + gap, 8)))
                    rows[at] += gap + d
            return out

    work = batches.select(F.col("batch").cast("long").alias("batch"), F.col("id").cast("string").alias("id"), F.col(duration).cast("double").alias("d"))
    work = work.repartition("batch").sortWithinPartitions("batch")
    return work.mapInArrow(keyed_stream(["batch"], State, lambda rows: rows_to_batch(rows, schema)), "batch long, row long, id string, offset double")


def bucketed_batches(df: DataFrame, bounds: list[float], constraint: Constraint, shards: int = 8, measure: str = "duration", seed: int = 0, epoch: int = 0) -> DataFrame:
    """Length buckets, batches within (bucket, shard), and a seeded order of batches: (bucket, shard, id, measure, batch, place)."""
    shard = F.pmod(hash_int("id", seed + 1), F.lit(shards))
    b = df.withColumn("__bucket", bucket_of(F.col(measure), bounds)).withColumn("__stratum", F.col("__bucket") * shards + shard)
    b = b.withColumn("__h", hash_int("id", seed * 1_000_003 + epoch))
    g = greedy_batches(b, constraint, measure, "dynamic", "__stratum", ("__h", "id"))
    return g.select(
        F.floor(F.col("stratum") / shards).cast("int").alias("bucket"), F.pmod("stratum", F.lit(shards)).cast("int").alias("shard"), "id", "measure", "batch",
        hash_int(F.concat_ws("/", F.col("stratum").cast("string"), F.col("batch").cast("string")), seed * 1_000_003 + epoch).alias("place"),
    )


def collated(batches: DataFrame, batch: str, values: str, pad_value: float = 0.0, direction: str = "right") -> DataFrame:
    """Arrays of each batch padded to its longest: adds ``length`` and replaces ``values``."""
    longest = batches.groupBy(batch).agg(F.max(F.size(values)).alias("__n"))
    wide = batches.join(longest, batch).withColumn("length", F.size(values))
    kind = batches.schema[values].dataType.elementType
    fill = F.array_repeat(F.lit(pad_value).cast(kind), F.col("__n") - F.size(values))
    return wide.withColumn(values, F.concat(values, fill) if direction == "right" else F.concat(fill, values)).drop("__n")


def paired_batches(df: DataFrame, source: Constraint, target: Constraint, source_measure: str, target_measure: str, stratum: str | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(stratum, id, batch): batches of pairs under two constraints at once; a pair that would break either opens the next batch."""
    cols = df.select(
        (F.col(stratum).cast("long") if stratum else F.lit(0).cast("long")).alias("stratum"), F.col("id").cast("string").alias("id"),
        F.col(source_measure).cast("double").alias("a"), F.col(target_measure).cast("double").alias("b"), F.struct(*order).alias("__o"),
    ).where("a is not null and b is not null")
    return _in_order(cols, ["a", "b"], lambda state: GreedyPairs(source, target, state), GreedyPairs.EMPTY).select("stratum", "id", "batch")


def resumed(batches: DataFrame, position: int, batch: str = "batch") -> DataFrame:
    """The batches from a saved position on. Batches depend on seed and epoch alone, so the position is the whole state."""
    return batches.where(F.col(batch) >= position)
