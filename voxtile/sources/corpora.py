"""Adapters of common corpus layouts: recordings and segments by scans and joins, repaired and checked.

A corpus becomes (recordings, segments): transcripts are read by Spark with their place,
audio files are probed by tasks, both meet in an equi-join, and ``fix_manifests`` keeps
what is present on both sides. ``prepared`` checks the pair and writes it once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtile.operators import joins, qa
from voxtile.sources.audio import recordings_from_dir
from voxtile.sources.manifests import write_manifest


def _segments(texts: DataFrame, recordings: DataFrame) -> DataFrame:
    """Texts (id, text, language, speaker, gender) as segments over the whole of their recordings."""
    ends = recordings.select("id", F.col("duration").alias("duration"))
    return texts.join(ends, "id").select(
        "id", F.col("id").alias("recording_id"), F.lit(0.0).alias("start"), "duration", F.array(F.lit(0)).alias("channel"), "text", "language", "speaker", "gender"
    )


def chapters(spark: SparkSession, folder: str, extension: str = "flac", language: str = "English", lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read speech by speaker and chapter: ``*.trans.txt`` with a line ``{speaker}-{chapter}-{number} TEXT`` for each audio file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(folder).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+", 2)
    text = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    texts = lines.select(
        parts[0].alias("id"), (F.lower(text) if lower else text).alias("text"), F.lit(language).alias("language"),
        F.split(parts[0], "-")[0].alias("speaker"), F.lit(None).cast("string").alias("gender"),
    )
    recordings = recordings_from_dir(spark, folder, f"*.{extension}")
    return joins.fix_manifests(recordings, _segments(texts, recordings))


def clips(spark: SparkSession, table: str, folder: str, durations: str, language: str, sampling_rate: int = 48000) -> tuple[DataFrame, DataFrame]:
    """Crowd-sourced clips: a tab-separated table (client_id, path, sentence, gender, ...) and one of (clip, duration in ms).

    Durations come from their table, so no clip is opened. A clip that it lacks is left out.
    """
    read = lambda p: spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(p)
    lengths = read(durations).toDF("path", "ms").select("path", (F.col("ms").cast("double") / 1000).alias("duration"))
    rows = read(table).join(lengths, "path").withColumn("id", F.regexp_replace("path", r"\.[^.]+$", ""))
    source = F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("source"))
    recordings = rows.select("id", F.array(source).alias("sources"), F.lit(sampling_rate).alias("sampling_rate"), F.round(F.col("duration") * sampling_rate).cast("long").alias("num_samples"), "duration")
    texts = rows.select("id", F.trim("sentence").alias("text"), F.lit(language).alias("language"), F.col("client_id").alias("speaker"), "gender")
    return joins.fix_manifests(recordings, _segments(texts, recordings))


def marked_meetings(spark: SparkSession, folder: str, rttm: DataFrame, extension: str = "wav") -> tuple[DataFrame, DataFrame]:
    """Meetings as one file each with speaker spans (RTTM rows): segments without text, clipped to their recordings."""
    recordings = recordings_from_dir(spark, folder, f"*.{extension}")
    none = F.lit(None).cast("string")
    return joins.fix_manifests(recordings, rttm.withColumns({"text": none, "language": none, "gender": none}))


def prepared(recordings: DataFrame, segments: DataFrame, out_dir: str, name: str) -> DataFrame:
    """Writes ``{name}_recordings`` and ``{name}_supervisions`` unless they are there; gives the rules that the pair breaks, with their counts."""
    spark = recordings.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    for kind, df in (("recordings", recordings), ("supervisions", segments)):
        to = os.path.join(out_dir, f"{name}_{kind}")
        done = path(to, "_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            write_manifest(df, to, "gzip")
    found = qa.union_all([qa.check_recordings(recordings), qa.check_supervisions(segments), qa.check_pairs(recordings, segments)])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
