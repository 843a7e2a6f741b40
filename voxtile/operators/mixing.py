"""Mixing sets of cuts: noise added at random, sets overlaid by position, padding batches, extra silence.

Random choices come from hashes of ids and seeds. A noise is found by an equi-join on its
position, so neither set is held in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtile.functions.timeops import hash_int, r8, uniform
from voxtile.operators.cuts import as_track, mixed_duration
from voxtile.operators.dataset import with_position
from voxtile.session import checkpointed


def snr_of(key: Column | str, snr: float | tuple[float, float] | None, seed: int) -> Column:
    """A fixed ratio, or one drawn evenly from a range."""
    if snr is None:
        return F.lit(None).cast("double")
    if isinstance(snr, tuple):
        low, high = snr
        return F.lit(low) + uniform(key, seed) * (high - low)
    return F.lit(float(snr))


def mix_noise(cuts: DataFrame, noise: DataFrame, snr: float | tuple[float, float] | None = 20.0, mix_prob: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, duration, tracks): each cut with noises one after another over its whole length, with a chance of ``mix_prob``.

    The last noise is cut where the cut ends. Noises are drawn in rounds: each offers a cut
    about as many as the mean noise needs to reach its end, and cuts whose end is not
    reached are offered more.
    """
    placed = with_position(noise.where("duration > 0").select("id", "start", "duration", "channel", "supervisions"), "id")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean")).first()
    tracks = F.array(as_track())
    if not size["n"]:
        return cuts.select("id", "duration", tracks.alias("tracks"))
    chosen = uniform("id", seed) < mix_prob
    open_cuts = cuts.where(chosen & (F.col("duration") > 0)).select(
        F.col("id").alias("cut_id"), F.col("duration").alias("cut_duration"), F.lit(0).cast("long").alias("drawn"), F.lit(0.0).alias("at")
    ).distinct()
    rounds, before = [], Window.partitionBy("cut_id", "cut_duration").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        offers = F.ceil((F.col("cut_duration") - F.col("at")) / F.lit(size["mean"])).cast("long") + 2
        wide = open_cuts.withColumn("k", F.explode(F.sequence(F.col("drawn") + 1, F.col("drawn") + offers)))
        wide = wide.withColumn("_pos", F.pmod(hash_int(F.concat_ws("/", "cut_id", F.col("k").cast("string")), seed + 1), F.lit(size["n"])))
        drawn = wide.join(placed, "_pos").withColumn("offset", r8(F.col("at") + F.coalesce(F.sum("duration").over(before), F.lit(0.0))))
        drawn = checkpointed(drawn)
        rounds.append(drawn.where("offset < cut_duration"))
        ends = drawn.groupBy("cut_id", "cut_duration").agg(F.max("k").alias("drawn"), F.max(F.col("offset") + F.col("duration")).alias("at"))
        open_cuts = checkpointed(ends.where("at < cut_duration"))
        if open_cuts.isEmpty():
            break
    found = reduce(DataFrame.unionByName, rounds)
    length = F.least("duration", r8(F.col("cut_duration") - F.col("offset")))
    cut = F.struct("id", "start", length.alias("duration"), "channel", "supervisions")
    track = F.struct("offset", snr_of("cut_id", snr, seed + 2).alias("snr"), F.lit("noise").alias("tag"), cut.alias("cut"))
    per = found.groupBy("cut_id", "cut_duration").agg(F.array_sort(F.collect_list(F.struct("k", track.alias("track")))).alias("c"))
    per = per.select(F.col("cut_id").alias("id"), F.transform("c", lambda x: x["track"]).alias("noises"))
    out = cuts.join(per, "id", "left")
    return out.select("id", "duration", F.when(F.col("noises").isNotNull(), F.concat(tracks, "noises")).otherwise(tracks).alias("tracks"))


def mix_by_position(sets: list[DataFrame], order: str = "id") -> DataFrame:
    """(position, ids, duration, tracks): the n-th cuts of several sets overlaid; the shortest set decides how many."""
    out = None
    for i, s in enumerate(sets):
        p = with_position(s, order).select("_pos", F.col("id").alias(f"i{i}"), as_track().alias(f"t{i}"))
        out = p if out is None else out.join(p, "_pos")
    n = range(len(sets))
    out = out.select(F.col("_pos").alias("position"), F.array(*[f"i{i}" for i in n]).alias("ids"), F.array(*[f"t{i}" for i in n]).alias("tracks"))
    return out.withColumn("duration", mixed_duration(F.col("tracks")))


def extra_padding(df: DataFrame, seconds: float, key: str = "id", seed: int = 0, randomised: bool = False) -> DataFrame:
    """Adds up to ``seconds`` of silence: ``pad_left``, ``pad_right`` and the longer duration."""
    total = F.lit(seconds) * (uniform(key, seed) if randomised else F.lit(1.0))
    left = total * uniform(key, seed + 1) if randomised else total / 2
    df = df.withColumn("pad_left", r8(left)).withColumn("pad_right", r8(total - F.col("pad_left")))
    return df.withColumn("duration", r8(F.col("duration") + F.col("pad_left") + F.col("pad_right")))
