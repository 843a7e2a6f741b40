"""Validators: each gives its violations as rows (id, rule), so that checks run distributed and can be counted.

A rule that is null for a row, because a field is absent, is no violation unless the field
is required.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtile.functions.timeops import end_of, num_frames

TOLERANCE = 1e-3


def violations(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(id, rule) where a rule's condition holds."""
    told = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("id"), F.explode(told).alias("rule"))


def check_recordings(df: DataFrame) -> DataFrame:
    expected = F.col("num_samples") / F.col("sampling_rate")
    return violations(df, {
        "no id": F.col("id").isNull(),
        "duration not above 0": F.col("duration").isNull() | (F.col("duration") <= 0),
        "no samples": F.col("num_samples").isNull() | (F.col("num_samples") <= 0),
        "rate not above 0": F.col("sampling_rate").isNull() | (F.col("sampling_rate") <= 0),
        "duration contradicts samples": F.abs(F.col("duration") - expected) > TOLERANCE,
        "no sources": F.col("sources").isNull() | (F.size("sources") <= 0),
        "empty source": F.exists("sources", lambda s: s["source"].isNull() | (F.trim(s["source"]) == "")),
    })


def check_supervisions(df: DataFrame) -> DataFrame:
    return violations(df, {
        "no id": F.col("id").isNull(),
        "no recording": F.col("recording_id").isNull(),
        "no start": F.col("start").isNull(),
        "start below 0": F.col("start") < 0,
        "duration not above 0": F.col("duration").isNull() | (F.col("duration") <= 0),
        "no channel": F.col("channel").isNull(),
    })


def check_features(df: DataFrame) -> DataFrame:
    frames = F.round(F.col("duration") / F.col("frame_shift"), 0)
    hop = F.col("frame_shift") * F.col("sampling_rate")
    return violations(df, {
        "no recording": F.col("recording_id").isNull(),
        "frames not above 0": F.col("num_frames") <= 0,
        "frames contradict duration": F.abs(frames - F.col("num_frames")) > 1,
        "shift off the sample grid": F.abs(hop - F.round(hop, 0)) > 1e-6,
        "no channels": F.col("channels").isNull(),
    }, "storage_key")


def check_cuts(df: DataFrame) -> DataFrame:
    frames = num_frames(F.col("duration"), F.col("features.frame_shift"), F.coalesce("recording.sampling_rate", F.lit(16000)))
    return violations(df, {
        "start below 0": F.col("start") < 0,
        "duration not above 0": F.col("duration") <= 0,
        "beyond the recording": end_of("start", "duration") > F.col("recording.duration") + TOLERANCE,
        "neither recording nor features": F.col("recording").isNull() & F.col("features").isNull(),
        "too few frames": frames > F.col("features.num_frames") + 1,
        "segment without duration": F.exists("supervisions", lambda s: s["duration"].isNull() | (s["duration"] <= 0)),
        "repeated segment": F.size(F.array_distinct(F.transform("supervisions", lambda s: s["id"]))) < F.size("supervisions"),
    })


def check_for_recognition(df: DataFrame, tolerance: float = 2e-3) -> DataFrame:
    """Cuts for recognition: every segment has a text and lies inside the cut."""
    return violations(df, {
        "no segment": F.size("supervisions") <= 0,
        "segment without text": F.exists("supervisions", lambda s: s["text"].isNull()),
        "segment before the cut": F.exists("supervisions", lambda s: s["start"] < -tolerance),
        "segment beyond the cut": F.exists("supervisions", lambda s: s["start"] + s["duration"] > F.col("duration") + tolerance),
    })


def check_for_synthesis(df: DataFrame) -> DataFrame:
    return violations(df, {"not exactly one segment": F.size("supervisions") != 1})


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_pairs(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """(id, rule) across recordings and segments: unmatched ones, and spans beyond the recording."""
    ends = recordings.where("id is not null").groupBy(F.col("id").alias("recording_id")).agg(F.max("duration").alias("__end"), F.first(F.lit(True)).alias("__has"))
    joined = supervisions.where("recording_id is not null").join(ends, "recording_id", "left")
    named = supervisions.select(F.col("recording_id").alias("id")).where("id is not null").distinct()
    lonely = recordings.where("id is not null").select("id").distinct().join(named, "id", "left_anti").select("id", F.lit("recording without segments").alias("rule"))
    spans = violations(joined, {
        "segment of no recording": F.col("__has").isNull(),
        "starts before the recording": F.col("start") < -TOLERANCE,
        "ends beyond the recording": end_of("start", "duration") > F.col("__end") + TOLERANCE,
        "ends before it starts": F.col("duration") < 0,
    })
    return spans.unionByName(lonely)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
