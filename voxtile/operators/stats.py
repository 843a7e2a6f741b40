"""Statistics of manifests: durations, speech, custom keys, features, padding, pauses.

All of it aggregates before the shuffle. Exact percentiles pick rows by global position,
so no aggregation buffer grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtile.functions.timeops import to_us
from voxtile.operators.cuts import spans_with_count, trimmed_supervisions
from voxtile.operators.dataset import with_position
from voxtile.operators.joins import neighbours

PERCENTILES = (25.0, 50.0, 75.0, 99.0, 99.5, 99.9)


def exact_percentiles(df: DataFrame, column: str, points: tuple[float, ...] = PERCENTILES) -> dict[float, float]:
    """Percentiles by linear interpolation between neighbouring ranks."""
    placed = with_position(df.where(F.col(column).isNotNull()).select(column), column)
    n = placed.count()
    if not n:
        return {}
    need = sorted({f((n - 1) * p / 100.0) for p in points for f in (math.floor, math.ceil)})
    at = {r["_pos"]: r[column] for r in placed.where(F.col("_pos").isin(need)).collect()}  # two rows a point
    out = {}
    for p in points:
        h = (n - 1) * p / 100.0
        lo, hi = at[math.floor(h)], at[math.ceil(h)]
        out[p] = lo + (hi - lo) * (h - math.floor(h))
    return out


def describe_durations(df: DataFrame, column: str = "duration") -> DataFrame:
    """One row: count, total, mean, population deviation, least, percentiles, most."""
    pct = exact_percentiles(df, column)
    out = df.agg(
        F.count(column).alias("n"), (F.sum(to_us(column)) / 1e6).alias("total"), F.round(F.avg(column), 6).alias("mean"),
        F.round(F.stddev_pop(column), 6).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
    )
    return out.select("*", *[F.lit(round(v, 6)).alias(f"p{str(p).replace('.', '_').removesuffix('_0')}") for p, v in pct.items()])


def speech_durations(cuts: DataFrame, full: bool = False) -> DataFrame:
    """Per cut, in microseconds: speaking time (summed), speech (at least one), and in full single, overlapped and by number."""
    us = lambda spans: F.aggregate(F.transform(spans, lambda s: F.round((s["end"] - s["start"]) * 1e6).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    speaking = F.aggregate(F.transform(trimmed_supervisions(), lambda s: F.round(s["duration"] * 1e6).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    cols = [F.col("id"), to_us("duration").alias("duration_us"), speaking.alias("speaking_us"), us(spans_with_count(cuts, 1)).alias("speech_us")]
    if full:
        cols += [us(spans_with_count(cuts, 1, 1)).alias("single_us"), us(spans_with_count(cuts, 2)).alias("overlap_us")]
        cols += [us(spans_with_count(cuts, k, k)).alias(f"speakers_{k}_us") for k in (2, 3, 4)]
    return cuts.select(*cols)


def describe_speech(cuts: DataFrame) -> DataFrame:
    """One row: totals over the set and the share of speech."""
    d = speech_durations(cuts, full=True)
    total = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in d.columns if c != "id"])
    return total.withColumn("silence_us", F.col("duration_us") - F.col("speech_us")).withColumn("speech_share", F.round(F.col("speech_us") / F.col("duration_us"), 6))


def availability(cuts: DataFrame) -> DataFrame:
    """One row: how many cuts have a recording, features and segments."""
    return cuts.agg(
        F.count(F.lit(1)).alias("cuts"), F.count("recording").alias("recordings"), F.count("features").alias("features"),
        F.sum(F.greatest(F.size("supervisions"), F.lit(0))).alias("supervisions"),
    )


def custom_keys(df: DataFrame, column: str = "custom") -> DataFrame:
    """(key, n) of the custom attributes."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def feature_stats(df: DataFrame, column: str) -> DataFrame:
    """(bin, mean, std): per dimension, population deviation; merged from partial moments."""
    return df.select(F.posexplode(column).alias("bin", "v")).groupBy("bin").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))


def normalise(df: DataFrame, column: str, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """(x - mean) / std per dimension. The statistics have one row per dimension and travel as two arrays."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("bin", "mean", "std"))).alias("s")).select(
        F.transform("s", lambda x: x["mean"]).alias("__m"), F.transform("s", lambda x: F.when(x["std"] > 0, x["std"]).otherwise(F.lit(1.0))).alias("__d")
    )
    # one row of bounded size: the number of dimensions
    wide = df.crossJoin(F.broadcast(one))
    x = F.transform(column, lambda v: v.cast("double"))
    if inverse:
        out = F.zip_with(F.zip_with(x, "__d", lambda v, d: v * d), "__m", lambda v, m: v + m)
    else:
        out = F.zip_with(F.zip_with(x, "__m", lambda v, m: v - m), "__d", lambda v, d: v / d)
    return wide.withColumn(column, out).drop("__m", "__d")


def padding_report(batches: DataFrame, duration: str = "duration", batch: str = "batch") -> DataFrame:
    """Per batch: size, longest, padded share and relative spread of durations."""
    g = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(to_us(duration)).alias("longest_us"), F.min(to_us(duration)).alias("shortest_us"), F.sum(to_us(duration)).alias("sum_us"))
    return g.withColumn("padding", F.round(1 - F.col("sum_us") / (F.col("n") * F.col("longest_us")), 6)).withColumn("spread", F.round((F.col("longest_us") - F.col("shortest_us")) / F.col("longest_us"), 6))


def pessimistic_batches(batches: DataFrame, duration: str = "duration", batch: str = "batch") -> DataFrame:
    """(criterion, batch, value): the batch that is largest by each criterion; the first wins ties."""
    g = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(to_us(duration)).alias("longest"), F.sum(to_us(duration)).alias("total"))
    g = g.withColumn("padded", F.col("n") * F.col("longest"))
    crit = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(c).cast("long").alias("value")) for k, c in (("most_items", "n"), ("longest_item", "longest"), ("largest_sum", "total"), ("largest_padded", "padded"))]))
    wide = g.select(batch, crit.alias("c")).select(batch, "c.criterion", "c.value")
    best = wide.groupBy("criterion").agg(F.max(F.struct("value", (-F.col(batch)).alias("b"))).alias("m"))
    return best.select("criterion", (-F.col("m.b")).alias(batch), F.col("m.value").alias("value"))


def pause_classes(pairs: DataFrame) -> DataFrame:
    """(kind, n, mean_us): gaps between neighbours: pauses of one speaker, of two, overlaps of two. Input as joins.neighbours gives it."""
    gap = to_us("start") - to_us("prev_end")
    same = F.col("speaker").eqNullSafe(F.col("prev_speaker"))
    kind = F.when(same, "same_pause").when(gap >= 0, "diff_pause").otherwise("diff_overlap")
    p = pairs.where("prev_end is not null").select(kind.alias("kind"), F.when(same, F.greatest(gap, F.lit(0))).otherwise(F.abs(gap)).alias("gap"))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap") / F.count(F.lit(1)), 3).alias("mean_us"))


def pause_fit(supervisions: DataFrame) -> DataFrame:
    """One row: the shifted exponential of gaps between a speaker's consecutive segments: loc = least, scale = mean - least."""
    pairs = neighbours(supervisions, ("recording_id", "speaker")).where("prev_end is not null")
    gap = F.greatest(to_us("start") - to_us("prev_end"), F.lit(0))
    return pairs.select(gap.alias("g")).agg(F.min("g").alias("loc_us"), F.round(F.sum("g") / F.count("g") - F.min("g"), 3).alias("scale_us"), F.count("g").alias("n"))


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.select(F.floor(value / width).cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
