"""Metadata effects on recordings and on segments in long form: speed, tempo, volume, rate, appended transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtile.functions.timeops import num_samples, perturbed_samples


def _tagged(c: Column, tag: str, on: bool) -> Column:
    return F.concat(c, F.lit(tag)) if on else c


def _with_transform(df: DataFrame, name: str, args: dict) -> Column:
    """The list of transforms with one more; rows without any have a null list."""
    one = F.create_map(F.lit("name"), F.lit(name), *[F.lit(str(x)) for kv in args.items() for x in kv])
    have = F.coalesce("transforms", F.expr("cast(array() as array<map<string,string>>)")) if "transforms" in df.columns else F.expr("cast(array() as array<map<string,string>>)")
    return F.concat(have, F.array(one))


def perturb_recordings(df: DataFrame, factor: float, kind: str = "speed", affix_id: bool = True) -> DataFrame:
    """Speed or tempo: fewer or more samples on the grid; volume: ids only."""
    tag = {"speed": "_sp", "tempo": "_tp", "volume": "_vp"}[kind] + f"{factor:g}"
    out = df.withColumn("transforms", _with_transform(df, kind, {"factor": factor}))
    if kind != "volume":
        n = perturbed_samples(F.col("num_samples"), factor)
        out = out.withColumn("num_samples", n).withColumn("duration", F.col("num_samples") / F.col("sampling_rate"))
    return out.withColumn("id", _tagged(F.col("id"), tag, affix_id))


def resample_recordings(df: DataFrame, sampling_rate: int) -> DataFrame:
    """Another rate; a recording that has it already is left as it is."""
    same = F.col("sampling_rate") == sampling_rate
    n = num_samples(F.col("duration"), F.lit(sampling_rate))
    out = df.withColumn("transforms", F.when(same, F.col("transforms") if "transforms" in df.columns else F.lit(None)).otherwise(_with_transform(df, "resample", {"sampling_rate": sampling_rate})))
    return out.withColumn("num_samples", F.when(same, F.col("num_samples")).otherwise(n)).withColumn("sampling_rate", F.lit(sampling_rate))


def transformed(df: DataFrame, name: str, tag: str, **args) -> DataFrame:
    """Any other transform: noted in the list, ids with a suffix."""
    return df.withColumn("transforms", _with_transform(df, name, args)).withColumn("id", F.concat("id", F.lit(tag)))


def perturb_segments(df: DataFrame, rates: DataFrame, factor: float, kind: str = "sp", affix_id: bool = True) -> DataFrame:
    """Segments of recordings (recording_id, sampling_rate) with times and alignments rescaled on the sample grid."""
    sr = F.col("sampling_rate")
    scaled = lambda t: perturbed_samples(num_samples(t, sr), factor) / sr
    out = df.join(rates.select("recording_id", "sampling_rate"), "recording_id")
    tag = f"_{kind}{factor:g}"
    if "alignment" in df.columns:
        item = lambda x: x.withField("start", scaled(x["start"])).withField("duration", scaled(x["duration"]))
        out = out.withColumn("alignment", F.transform_values("alignment", lambda k, v: F.transform(v, item)))
    out = out.withColumn("start", scaled(F.col("start"))).withColumn("duration", scaled(F.col("duration")))
    return out.withColumn("id", _tagged(F.col("id"), tag, affix_id)).withColumn("recording_id", _tagged(F.col("recording_id"), tag, affix_id)).drop("sampling_rate")
