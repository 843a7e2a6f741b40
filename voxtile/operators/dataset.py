"""Dataset algebra: order, positions, subsets, splits, slices, samples, permutations, unions, interleaving, repetition.

Order is explicit: an operator that depends on it names its order columns. Global
positions come from a range-partitioned sort whose partition sizes are added up, never
from a window over the whole set in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.functions.timeops import hash_int, uniform
from voxtile.session import checkpointed

_ROW_BITS = 33


def with_position(df: DataFrame, *order: str | Column, name: str = "_pos") -> DataFrame:
    """Adds the position of each row, from 0, in the given (total) order.

    The sorted rows are checkpointed, so positions are stable under lost executors. The
    driver sees one number per partition.
    """
    s = checkpointed(df.orderBy(*order)).withColumn("__m", F.monotonically_increasing_id())
    s = s.withColumn("__p", F.shiftright("__m", _ROW_BITS)).withColumn("__r", F.col("__m").bitwiseAND((1 << _ROW_BITS) - 1))
    sizes = {r["__p"]: r["n"] for r in s.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    if not offsets:
        return s.withColumn(name, F.lit(0).cast("long")).drop("__m", "__p", "__r")
    starts = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair]) if len(offsets) <= 500 else None
    if starts is not None:
        out = s.withColumn(name, starts[F.col("__p")] + F.col("__r"))
    else:
        table = df.sparkSession.createDataFrame(offsets, "__p long, __at long")
        out = s.join(F.broadcast(table), "__p").withColumn(name, F.col("__at") + F.col("__r")).drop("__at")
    return out.drop("__m", "__p", "__r")


def running_sum(df: DataFrame, value: str, pos: str = "_pos", keys: list[str] | None = None, name: str = "_cum", block: int = 65_536) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the key (positions count within it or over all).

    Two levels: sums within blocks of positions, and a summary with one row per block.
    """
    keys = keys or []
    df = df.withColumn("__b", F.floor(F.col(pos) / block))
    sums = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__w", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(base, [*keys, "__b"])
        .withColumn(name, F.col("__base") + F.col("__w"))
        .drop("__b", "__w", "__base")
    )


def sort_by_duration(df: DataFrame, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col("duration").asc() if ascending else F.col("duration").desc(), "id")


def sort_like(df: DataFrame, other: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The rows in the order of another set with the same keys."""
    return df.join(other.select(key, F.col(order).alias("__o")), key).orderBy("__o").drop("__o")


def subset(df: DataFrame, *order: str | Column, first: int | None = None, last: int | None = None) -> DataFrame:
    """The first or last rows; exactly one of the two; more than there are gives all."""
    if (first is None) == (last is None):
        raise ValueError("give first or last")
    if first is not None:
        return df.orderBy(*order).limit(first)
    flipped = [F.col(c).desc() if isinstance(c, str) else c.desc() for c in order]
    return df.orderBy(*flipped).limit(last)


def subset_ids(df: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """The rows of a list of keys with the place of each in the list (``_ord``)."""
    wanted = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} string, _ord long")
    return df.join(wanted, key)


def split(df: DataFrame, n: int, *order: str | Column, drop_last: bool = False) -> DataFrame:
    """Adds ``part``: n runs of neighbours whose sizes differ by at most one, larger ones first; or equal ones, dropping the rest."""
    placed = with_position(df, *order)
    total = placed.count()
    if n > total:
        raise ValueError(f"cannot split {total} rows into {n} parts")
    q, r = divmod(total, n)
    pos = F.col("_pos")
    if drop_last:
        return placed.where(pos < q * n).withColumn("part", F.floor(pos / q).cast("int")).drop("_pos")
    part = F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(F.floor((pos - r) / q))
    return placed.withColumn("part", part.cast("int")).drop("_pos")


def split_chunks(df: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """Adds ``chunk``: runs of ``size`` neighbours."""
    return with_position(df, *order).withColumn("chunk", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


def slice_k_of_n(df: DataFrame, k: int, n: int, *order: str | Column) -> DataFrame:
    """Every n-th row from the k-th."""
    return with_position(df, *order).where(F.pmod(F.col("_pos"), F.lit(n)) == k).drop("_pos")


def partition_rank(df: DataFrame, rank: int, world: int, *order: str | Column) -> DataFrame:
    """The share of one of several readers: a stride over positions; all shares together are the whole, without overlap."""
    return slice_k_of_n(df, rank, world, *order)


def sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, by the hash of key and seed."""
    return df.orderBy(hash_int(key, seed), key).limit(n)


def weighted_sample(df: DataFrame, n: int, weight: str, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight: the least exponential arrival times win."""
    arrival = -F.log(uniform(key, seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).orderBy(arrival, key).limit(n)


def shuffle(df: DataFrame, key: str = "id", seed: int = 0, epoch: int = 0) -> DataFrame:
    """A full permutation that depends on seed, epoch and key alone."""
    return df.orderBy(hash_int(key, seed * 1_000_003 + epoch), key)


def buffered_shuffle(df: DataFrame, buffer: int, *order: str | Column, key: str = "id", seed: int = 0) -> DataFrame:
    """A shuffle in which a row moves about ``buffer`` places at most."""
    placed = with_position(df, *order)
    return placed.orderBy(F.col("_pos") + uniform(key, seed) * buffer, "_pos").drop("_pos")


def combine(*sets: DataFrame) -> DataFrame:
    """UNION ALL by name, with the number of the source in ``_src``."""
    out = None
    for i, s in enumerate(sets):
        s = s.withColumn("_src", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def mux(sets: list[DataFrame], weights: list[float] | None = None, order: str = "id", seed: int = 0, stop_early: bool = False) -> DataFrame:
    """Weighted random interleave that keeps each source's own order: adds ``_src`` and ``_at``, the time to sort by.

    Each source's rows arrive as a Poisson stream whose rate is its weight, so whatever
    source has not run out is next with a chance in proportion to its weight.
    ``stop_early`` ends at the first source that runs out.
    """
    weights = weights or [1.0] * len(sets)
    streams = []
    for i, (s, w) in enumerate(zip(sets, weights)):
        placed = with_position(s, order).withColumn("__g", -F.log(uniform(F.concat_ws("/", F.lit(str(i)), F.col(order).cast("string")), seed)) / w)
        placed = running_sum(placed, "__g", name="__before").withColumn("_at", F.col("__before") + F.col("__g")).drop("__before", "__g", "_pos")
        streams.append(placed.withColumn("_src", F.lit(i)))
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    if stop_early:
        ends = [r["e"] for r in out.groupBy("_src").agg(F.max("_at").alias("e")).collect()]
        out = out.where(F.col("_at") <= (min(ends) if len(ends) == len(sets) else -1.0))
    return out.orderBy("_at", "_src")


def repeat(df: DataFrame, times: int, preserve_id: bool = False, key: str = "id") -> DataFrame:
    """The set several times over; ids get ``_repeat{i}``. Endless repetition belongs to a stream."""
    wide = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_rep", F.lit(0))
    return wide if preserve_id else wide.withColumn(key, F.concat(key, F.lit("_repeat"), F.col("_rep").cast("string")))


def duplicates_marked(df: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """Ids of repeated rows get ``_dup{i}`` from the second on."""
    w = Window.partitionBy(key).orderBy(*(order or (key,)))
    return df.withColumn("__n", F.row_number().over(w) - 1).withColumn(key, F.when(F.col("__n") > 0, F.concat(key, F.lit("_dup"), F.col("__n").cast("string"))).otherwise(F.col(key))).drop("__n")


# The multipliers and shifts of the round function; they decide the permutation.
KNUTH, MIXER, SHIFTS, ROUNDS = 2654435761, 0xBF58476D1CE4E5B9, (17, 31), 6


def feistel(n: int, seed: int = 0):
    """A function on numpy arrays that permutes [0, n): a balanced network of six rounds with cycle walking."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    rng = np.random.RandomState(seed & 0xFFFFFFFF)
    round_keys = [np.uint64(rng.randint(0, 2**63)) for _ in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = (x >> half) & mask, x & mask
        for k in round_keys:
            h = (right ^ k) * np.uint64(KNUTH)
            h ^= h >> np.uint64(SHIFTS[0])
            h *= np.uint64(MIXER)
            h ^= h >> np.uint64(SHIFTS[1])
            left, right = right, left ^ (h & mask)
        return (left << half) | right

    def permute(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = once(x.astype(np.uint64))
            while (beyond := out >= n).any():
                out[beyond] = once(out[beyond])
        return out.astype(np.int64)

    return permute


def permuted(df: DataFrame, n: int, seed: int = 0, pos: str = "_pos") -> DataFrame:
    """Adds ``_perm``: where the seeded permutation of [0, n) sends each position; constant time per row, any row by itself."""
    @F.pandas_udf(T.LongType())
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(n, seed)(x.to_numpy()))

    return df.withColumn("_perm", apply(F.col(pos)))


def draw_with_replacement(df: DataFrame, n: int, key: str = "id", seed: int = 0, first: int = 0) -> DataFrame:
    """n independent draws with ids ``{id}_it{k}``; draw k depends on the seed and k alone, so any stretch of the endless sequence can be had."""
    placed = with_position(df, key)
    size = placed.count()
    draws = df.sparkSession.range(first, first + n).withColumnRenamed("id", "_draw")
    draws = draws.withColumn("_pos", F.pmod(hash_int("_draw", seed), F.lit(max(size, 1))))
    return draws.join(placed, "_pos").withColumn(key, F.concat(key, F.lit("_it"), F.col("_draw").cast("string"))).drop("_pos")


def kept_and_dropped(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: how many rows a predicate keeps and drops (null counts as dropped)."""
    return df.agg(F.count_if(predicate).alias("kept"), (F.count(F.lit(1)) - F.count_if(predicate)).alias("dropped"))
