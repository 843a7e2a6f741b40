"""Manifest files: JSON lines, JSON, YAML, RTTM, CTM, data directories of key-value text, tabular export.

Readers give typed DataFrames by fixed schemas, so no pass infers them. Formats whose rows
depend on their line number are read as streams, a file per task.
"""

from __future__ import annotations

import gzip
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.session import tasks_for

_SUP = "id string, recording_id string, start double, duration double, channel array<int>, text string, language string, speaker string, gender string, custom map<string,string>, alignment map<string,array<struct<symbol:string,start:double,duration:double,score:double>>>"
SCHEMAS = {
    "recording": "id string, sources array<struct<type:string,channels:array<int>,source:string>>, sampling_rate int, num_samples long, duration double, channel_ids array<int>, transforms array<map<string,string>>",
    "supervision": _SUP,
    "features": "type string, num_frames int, num_features int, frame_shift double, sampling_rate int, start double, duration double, storage_type string, storage_path string, storage_key string, recording_id string, channels array<int>",
    "cut": "id string, start double, duration double, channel int, type string, supervisions array<struct<id:string,recording_id:string,start:double,duration:double,channel:array<int>,text:string,speaker:string>>, features struct<type:string,num_frames:int,num_features:int,frame_shift:double,storage_key:string>, recording struct<id:string,sampling_rate:int,duration:double>, custom map<string,string>",
    "array": "storage_type string, storage_path string, storage_key string, shape array<int>",
    "image": "storage_type string, storage_path string, storage_key string, width int, height int",
    "text": "text string, custom map<string,string>",
}


def kind_of(row: dict) -> str:
    """What a row is, by its keys."""
    if "width" in row:
        return "image"
    if "shape" in row or "array" in row:
        return "array"
    if "sources" in row:
        return "recording"
    if "num_features" in row:
        return "features"
    if "type" not in row:
        return "text" if set(row) <= {"text", "custom", "tokens"} else "supervision"
    return "cut"


def _first(path: str) -> dict | None:
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8") as f:
        if ".jsonl" in path:
            for line in f:
                if line.strip():
                    return json.loads(line)
            return None
        data = json.load(f)
        return data[0] if isinstance(data, list) and data else data or None


def _listed(value, field: T.DataType):
    """Scalars where the schema has arrays become arrays, as channels do."""
    if isinstance(field, T.ArrayType) and value is not None and not isinstance(value, list):
        return [value]
    return value


def read_manifest(spark: SparkSession, path: str, kind: str | None = None, permissive: bool = False) -> DataFrame:
    """A manifest by extension: .jsonl, .json, .yaml, each with .gz; a folder, as ``write_manifest`` leaves it, holds JSON lines.

    None-valued and unknown keys are ignored.

    ``permissive`` keeps malformed lines out instead of failing.
    """
    base = path.removesuffix(".gz")
    if base.endswith((".yaml", ".yml")):
        return _read_yaml(spark, path, kind)
    if kind is None:
        folder = not base.endswith((".jsonl", ".json"))
        row = next((json.loads(r["value"]) for r in spark.read.text(path).where("value <> ''").head(1)), None) if folder or os.path.isdir(path) else _first(path)
        if row is None:
            raise ValueError(f"{path} is empty; give its kind")
        kind = kind_of(row)
    schema = T._parse_datatype_string(SCHEMAS[kind])
    # channels may be written as numbers: they are read as text and parsed by what they are
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("channel", "channels") and isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema])
    if permissive:
        loose = loose.add("_corrupt_record", "string")
    df = spark.read.schema(loose).option("multiLine", base.endswith(".json") and not os.path.isdir(path)).option("mode", "PERMISSIVE" if permissive else "FAILFAST").json(path)
    if permissive:
        df = df.cache().where("_corrupt_record is null").drop("_corrupt_record")
    for f in schema:
        if isinstance(loose[f.name].dataType, T.StringType) and isinstance(f.dataType, T.ArrayType):
            text = F.when(F.col(f.name).startswith("["), F.col(f.name)).otherwise(F.concat(F.lit("["), F.col(f.name), F.lit("]")))
            df = df.withColumn(f.name, F.from_json(text, f.dataType))
    return df


def _read_yaml(spark: SparkSession, path: str, kind: str | None) -> DataFrame:
    """YAML has no row structure to split; manifests in it are small by nature and read on the driver."""
    import yaml

    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8") as f:
        rows = yaml.safe_load(f) or []
    kind = kind or kind_of(rows[0])
    schema = T._parse_datatype_string(SCHEMAS[kind])
    return spark.createDataFrame([tuple(_listed(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)


def write_manifest(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines (a directory of parts) without null fields, or Parquet by extension."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", "true").option("compression", compression).json(path)


def append_missing(df: DataFrame, path: str, key: str = "id", kind: str = "cut") -> int:
    """Appends the rows whose key the manifest lacks, so that an interrupted job can go on; gives their number."""
    spark = df.sparkSession
    if os.path.isdir(path) and any(f.endswith((".json", ".json.gz")) for f in os.listdir(path)):
        done = spark.read.schema(f"{key} string").json(path).select(key)
        df = df.join(done, key, "left_anti")
    n = df.count()
    if n:
        df.write.mode("append").option("ignoreNullFields", "true").json(path)
    return n


def read_text_examples(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text without white space of any kind around them."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("text"))


# ---- formats with line numbers ----------------------------------------------------------------------------------

_LINES = pa.schema([("path", pa.string()), ("line", pa.int64()), ("value", pa.string())])


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, value) of text files, plain or gzipped; lines count from 0. A file streams through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                opener = gzip.open if p.endswith(".gz") else open
                held: list[tuple] = []
                with opener(p, "rt", encoding="utf-8") as f:
                    for i, line in enumerate(f):
                        held.append((p, i, line.rstrip("\r\n")))
                        if len(held) == 10_000:
                            yield _batch(held)
                            held = []
                yield _batch(held)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_for(spark, len(paths)))
    return listed.mapInArrow(run, "path string, line long, value string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, _LINES)], schema=_LINES)


def read_rttm(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segments of RTTM files; ids are ``{recording}-{line:06d}`` with lines counted before zero-length ones are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, paths).where(F.trim("value") != "").withColumn("p", p)
    rows = rows.withColumn("n", F.when(F.size("p") == 10, 10).otherwise(F.raise_error(F.concat(F.lit("not ten fields: "), "value")).cast("int"))).where("n = 10")
    null = lambda c: F.when(c != "<NA>", c)
    return rows.where(F.col("p")[4].cast("double") > 0).select(
        F.format_string("%s-%06d", F.col("p")[1], F.col("line")).alias("id"), F.col("p")[1].alias("recording_id"),
        F.col("p")[3].cast("double").alias("start"), F.col("p")[4].cast("double").alias("duration"),
        F.array(F.col("p")[2].cast("int")).alias("channel"), null(F.col("p")[7]).alias("speaker"),
    )


def format_rttm(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("SPEAKER %s %d %.3f %.3f <NA> <NA> %s <NA> <NA>", "recording_id", F.coalesce(F.try_element_at("channel", F.lit(1)), F.lit(0)), F.col("start"), F.col("duration"), F.coalesce("speaker", F.lit("<NA>"))).alias("value"))


def read_ctm(spark: SparkSession, path: str) -> DataFrame:
    """Words of a CTM file: recording, channel, start, duration, symbol, score."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    return rows.select(
        F.col("p")[0].alias("recording_id"), F.col("p")[1].cast("int").alias("channel"), F.col("p")[2].cast("double").alias("w_start"),
        F.col("p")[3].cast("double").alias("w_duration"), F.col("p")[4].alias("symbol"), F.try_element_at("p", F.lit(6)).cast("double").alias("score"),
    )


def format_ctm(supervisions: DataFrame, kind: str = "word") -> DataFrame:
    """CTM lines of one kind of alignment, two decimals, by recording and start."""
    a = supervisions.where("alignment is not null").select("recording_id", F.coalesce(F.try_element_at("channel", F.lit(1)), F.lit(0)).alias("ch"), F.explode(F.try_element_at("alignment", F.lit(kind))).alias("w"))
    line = F.format_string("%s %d %.2f %.2f %s", "recording_id", "ch", F.col("w.start"), F.col("w.duration"), F.col("w.symbol"))
    scored = F.when(F.col("w.score").isNotNull(), F.concat(line, F.format_string(" %.2f", F.col("w.score")))).otherwise(line)
    return a.select(scored.alias("value"))


# ---- data directories -------------------------------------------------------------------------------------------


def read_pairs(spark: SparkSession, path: str, value: str = "value", cast: str = "string") -> DataFrame:
    """A two-column text file: key, rest of the line; separators may repeat and values may have spaces around them."""
    p = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("key"), F.trim(F.try_element_at(p, F.lit(2))).cast(cast).alias(value))


def read_kaldi_dir(spark: SparkSession, folder: str, sampling_rate: int, frame_shift: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Recordings, segments and features of a data directory, by equi-joins of its key-value files.

    A segment that ends at -1 ends with its recording; without a segments file every
    recording is one segment. Durations are floored to milliseconds.
    """
    have = lambda n: os.path.exists(os.path.join(folder, n))
    pairs = lambda n, v, c="string": read_pairs(spark, os.path.join(folder, n), v, c)
    rec = pairs("wav.scp", "source")
    if have("reco2dur"):
        rec = rec.join(pairs("reco2dur", "duration", "double"), "key", "left")
    else:
        rec = rec.withColumn("duration", F.lit(None).cast("double"))
    rec = rec.withColumn("duration", F.floor(F.col("duration") * 1000) / 1000)
    kind = F.when(F.trim("source").endswith("|"), "command").otherwise("file")
    source = F.trim(F.regexp_replace("source", r"\|\s*$", ""))
    recordings = rec.select(
        F.col("key").alias("id"), F.array(F.struct(kind.alias("type"), F.array(F.lit(0)).alias("channels"), source.alias("source"))).alias("sources"),
        F.lit(sampling_rate).alias("sampling_rate"), F.round(F.col("duration") * sampling_rate).cast("long").alias("num_samples"), "duration",
    )
    if have("segments"):
        p = F.split(F.trim("value"), r"\s+")
        seg = spark.read.text(os.path.join(folder, "segments")).where(F.trim("value") != "").select(p[0].alias("key"), p[1].alias("recording_id"), p[2].cast("double").alias("start"), p[3].cast("double").alias("end"))
    else:
        seg = recordings.select(F.col("id").alias("key"), F.col("id").alias("recording_id"), F.lit(0.0).alias("start"), F.lit(-1.0).alias("end"))
    seg = seg.join(recordings.select(F.col("id").alias("recording_id"), F.col("duration").alias("__d")), "recording_id", "left")
    seg = seg.withColumn("duration", F.round(F.when(F.col("end") == -1, F.col("__d")).otherwise(F.col("end")) - F.col("start"), 8)).drop("__d", "end")
    for name, column in (("text", "text"), ("utt2spk", "speaker"), ("utt2lang", "language")):
        seg = seg.join(pairs(name, column), "key", "left") if have(name) else seg.withColumn(column, F.lit(None).cast("string"))
    if have("spk2gender"):
        seg = seg.join(pairs("spk2gender", "gender").withColumnRenamed("key", "speaker"), "speaker", "left")
    else:
        seg = seg.withColumn("gender", F.lit(None).cast("string"))
    seg = seg.select(F.col("key").alias("id"), "recording_id", "start", "duration", F.array(F.lit(0)).alias("channel"), "text", "language", "speaker", "gender")
    feats = None
    if have("feats.scp") and frame_shift:
        frames = pairs("utt2num_frames", "num_frames", "int") if have("utt2num_frames") else None
        feats = pairs("feats.scp", "storage_key")
        feats = feats.join(frames, "key", "left") if frames is not None else feats.withColumn("num_frames", F.lit(None).cast("int"))
        feats = feats.join(seg.select(F.col("id").alias("key"), "recording_id", "start", "duration"), "key").withColumn("frame_shift", F.lit(frame_shift))
    return recordings, seg, feats


def write_kaldi_dir(recordings: DataFrame, supervisions: DataFrame, folder: str, prefix_speaker: bool = False) -> None:
    """The inverse: sorted key-value files, one directory of parts each; recordings of several channels become ``{id}_{channel}``."""
    src = recordings.select("id", "duration", F.explode("sources").alias("s")).select("id", "duration", F.explode(F.col("s.channels")).alias("ch"), F.col("s.type").alias("type"), F.col("s.source").alias("source"))
    many = src.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("many"))
    src = src.join(many, "id").withColumn("key", F.when(F.col("many"), F.concat_ws("_", "id", F.col("ch").cast("string"))).otherwise(F.col("id")))
    wav = F.when(F.col("type") == "command", F.concat("source", F.lit(" |"))).otherwise(F.col("source"))
    seg = supervisions.where("start is not null and duration > 0")
    seg = seg.join(many.withColumnRenamed("id", "recording_id"), "recording_id").withColumn("rec", F.when(F.col("many"), F.concat_ws("_", "recording_id", F.coalesce(F.try_element_at("channel", F.lit(1)), F.lit(0)).cast("string"))).otherwise(F.col("recording_id")))
    utt = F.concat_ws("-", "speaker", "id") if prefix_speaker else F.col("id")
    seg = seg.withColumn("key", utt)
    files = {
        "wav.scp": src.select("key", wav.alias("v")), "reco2dur": src.select("key", F.format_string("%.3f", "duration").alias("v")),
        "segments": seg.select("key", F.format_string("%s %.3f %.3f", "rec", F.col("start"), F.col("start") + F.col("duration")).alias("v")),
        "text": seg.where("text is not null").select("key", F.regexp_replace("text", r"\s+", " ").alias("v")),
        "utt2spk": seg.select("key", F.coalesce("speaker", "id").alias("v")),
        "utt2dur": seg.select("key", F.format_string("%.3f", "duration").alias("v")),
    }
    for name, df in files.items():
        df.select(F.concat_ws(" ", "key", "v").alias("value"), "key").orderBy("key").select("value").write.mode("overwrite").text(os.path.join(folder, name))


# ---- tabular export ---------------------------------------------------------------------------------------------


def flat_table(cuts: DataFrame) -> DataFrame:
    """One row per cut: with one segment its fields, else the segments as a nested column."""
    one = F.size("supervisions") == 1
    s = F.col("supervisions")[0]
    return cuts.select(
        "id", F.col("recording.id").alias("recording_id"), F.col("recording.sampling_rate").alias("sampling_rate"), "duration",
        F.when(one, s["text"]).alias("text"), F.when(one, s["speaker"]).alias("speaker"), F.when(~one, F.col("supervisions")).alias("segments"),
    )


def cuts_from_table(df: DataFrame, audio: str = "audio", text: str = "sentence", language: str = "language", gender: str = "gender", duration: str = "duration", key: str = "id") -> DataFrame:
    """Rows with audio, text, language and gender columns as cuts of one segment."""
    lit = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    seg = F.struct(F.col(key).alias("id"), F.col(key).alias("recording_id"), F.lit(0.0).alias("start"), F.col(duration).cast("double").alias("duration"), F.array(F.lit(0)).alias("channel"), lit(text).alias("text"), lit(language).alias("language"), lit(gender).alias("gender"))
    return df.select(F.col(key).alias("id"), F.lit(0.0).alias("start"), F.col(duration).cast("double").alias("duration"), F.array(seg).alias("supervisions"), lit(audio).alias("audio"))


def rows_as_lists(df: DataFrame, group: Column | None = None) -> DataFrame:
    """Rows to one row of lists per group; a group must fit a row."""
    return df.groupBy((group if group is not None else F.lit(0)).alias("group")).agg(*[F.collect_list(c).alias(c) for c in df.columns])


_POINTER = re.compile(r"^(?P<path>.*)\?o=(?P<offset>\d+)&e=(?P<end>\d+)$")


def pointer(path: Column, offset: Column, end: Column) -> Column:
    """``<archive>?o=<offset>&e=<end>``."""
    return F.concat(path, F.lit("?o="), offset.cast("string"), F.lit("&e="), end.cast("string"))


def parse_pointer(text: str) -> tuple[str, int, int]:
    m = _POINTER.match(text)
    if not m:
        raise ValueError(f"not a pointer: {text}")
    return m["path"], int(m["offset"]), int(m["end"])
