"""Queries that write the driver's tables in each format, read them back and give what must agree with SQL.

Files lie in the shared checkpoint folder, under a new name for each call.
"""

from __future__ import annotations

import glob
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.functions.timeops import to_us as us
from voxtile.plans.catalogue import CUTS, _unique, audio, cuts, feats, query, sup, us_sql
from voxtile.plans.catalogue import ORACLES as _ALL_SQL
from voxtile.plans.catalogue import QUERIES as _ALL
from voxtile.session import shared_folder, table
from voxtile.sources import archives, arrays, corpora, manifests
from voxtile.sources import audio as wav

_BEFORE = set(_ALL)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder as a path that readers of single files can open."""
    path = re.sub(r"^file:/+", "/", shared_folder(spark, name))
    os.makedirs(path, exist_ok=True)
    return path


def _again(spark: SparkSession, df: DataFrame, kind: str, **options) -> DataFrame:
    folder = shared_folder(spark, "manifest")
    manifests.write_manifest(df, folder, **options)
    return manifests.read_manifest(spark, folder, kind)


# ---- manifests ---------------------------------------------------------------------------------------------------

_SEGMENT = "id, recording_id, {start} AS start_us, {duration} AS duration_us, text, language, speaker, gender, CASE WHEN channel IS NULL THEN NULL ELSE len(channel) END AS channels, CASE WHEN custom IS NULL THEN NULL ELSE cardinality(custom) END AS customs, CASE WHEN alignment IS NULL THEN NULL ELSE cardinality(alignment) END AS kinds"
_SEGMENT_SQL = f"SELECT {_SEGMENT.format(start=us_sql('start'), duration=us_sql('duration'))} FROM supervision"


def _segment_rows(df: DataFrame) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return df.select(
        "id", "recording_id", us("start").alias("start_us"), us("duration").alias("duration_us"), "text", "language", "speaker", "gender",
        size("channel").alias("channels"), size("custom").alias("customs"), size("alignment").alias("kinds"),
    )


@query(_SEGMENT_SQL.replace("len(channel)", "CAST(len(channel) AS BIGINT)"))
def segments_as_json_lines(spark, d):
    return _segment_rows(_again(spark, sup(spark, d).drop("received_at"), "supervision"))


@query(_SEGMENT_SQL)
def segments_as_gzipped_lines(spark, d):
    return _segment_rows(_again(spark, sup(spark, d).drop("received_at"), "supervision", compression="gzip"))


@query(f"""SELECT id, sampling_rate, num_samples, {us_sql('duration')} AS duration_us, len(sources) AS n_sources,
array_to_string(list_transform(sources, lambda s: coalesce(s.type, '') || '=' || coalesce(s.source, '')), '|') AS sources FROM audio""")
def recordings_as_json_lines(spark, d):
    r = _again(spark, audio(spark, d).drop("received_at"), "recording")
    named = F.array_join(F.transform("sources", lambda s: F.concat(F.coalesce(s["type"], F.lit("")), F.lit("="), F.coalesce(s["source"], F.lit("")))), "|")
    return r.select("id", "sampling_rate", "num_samples", us("duration").alias("duration_us"), F.when(F.col("sources").isNotNull(), F.size("sources")).cast("long").alias("n_sources"), named.alias("sources"))


@query(f"SELECT recording_id, storage_key, num_frames, num_features, {us_sql('start')} AS start_us, {us_sql('duration')} AS duration_us, array_to_string(channels, ',') AS channels FROM features")
def features_as_json_lines(spark, d):
    f = _again(spark, feats(spark, d), "features")
    channels = F.array_join(F.transform("channels", lambda c: c.cast("string")), ",")
    return f.select("recording_id", "storage_key", "num_frames", "num_features", us("start").alias("start_us"), us("duration").alias("duration_us"), channels.alias("channels"))


_CUT_SQL = f"SELECT id, {us_sql('start')} AS start_us, {us_sql('duration')} AS duration_us, channel, recording.id AS rec, features.storage_key AS features, CAST(coalesce(len(supervisions), 0) AS BIGINT) AS n FROM cuts"


def _nested_cuts(c: DataFrame) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("supervisions"), F.lit(0)), F.lit(0)).cast("long")
    return c.select("id", us("start").alias("start_us"), us("duration").alias("duration_us"), "channel", F.col("recording.id").alias("rec"), F.col("features.storage_key").alias("features"), n.alias("n"))


@query(_CUT_SQL)
def cuts_as_json_lines(spark, d):
    return _nested_cuts(_again(spark, cuts(spark, d), "cut"))


@query(_CUT_SQL)
def cuts_as_parquet(spark, d):
    folder = shared_folder(spark, "cuts") + ".parquet"
    manifests.write_manifest(cuts(spark, d), folder)
    return _nested_cuts(spark.read.parquet(folder))


@query(_CUT_SQL)
def cuts_through_a_set(spark, d):
    from voxtile.plans.sets import CutSet

    folder = shared_folder(spark, "set")
    CutSet(cuts(spark, d)).to_file(folder)
    return _nested_cuts(manifests.read_manifest(spark, folder, "cut"))


@query("SELECT id, CAST(1 AS BIGINT) AS n FROM cuts GROUP BY id")
def append_missing_rows(spark, d):
    """A job that was interrupted half-way goes on: each id is written once."""
    folder = local_folder(spark, "append")
    c = _unique(cuts(spark, d)).select("id", "start", "duration")
    manifests.append_missing(c.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), folder)
    manifests.append_missing(c, folder)
    manifests.append_missing(c, folder)
    return spark.read.schema("id string").json(folder).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM cuts")
def malformed_lines_left_out(spark, d):
    folder = shared_folder(spark, "broken")
    lines = cuts(spark, d).select(F.to_json(F.struct("id", "start", "duration")).alias("value"))
    lines.unionByName(lines.select(F.expr("substring(value, 1, 9)").alias("value"))).write.text(folder)
    read = manifests.read_manifest(spark, folder, "cut", permissive=True)
    return read.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query(r"SELECT regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, count(*) AS n FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%' || chr(10) || '%' AND text NOT LIKE '%' || chr(13) || '%' GROUP BY 1")
def text_examples(spark, d):
    folder = shared_folder(spark, "texts")
    one_line = table(spark, d, "documents").where("text is not null").where(~F.col("text").contains("\n") & ~F.col("text").contains("\r"))
    one_line.select("text").write.text(folder)
    return manifests.read_text_examples(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


# ---- RTTM, CTM, data directories -----------------------------------------------------------------------------------


def _files(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "part-*")))


@query("""SELECT recording_id, coalesce(channel[1], 0) AS channel, CAST(round(start * 1000) AS BIGINT) AS start_ms, count(*) AS n
FROM supervision WHERE recording_id IS NOT NULL AND start IS NOT NULL AND duration >= 0.001 GROUP BY ALL""")
def rttm_round_trip(spark, d):
    folder = local_folder(spark, "rttm") + "/all"
    s = sup(spark, d).where("recording_id is not null and start is not null and duration >= 0.001").withColumn("speaker", F.regexp_replace(F.trim("speaker"), r"[\s ]+", "_"))
    s = s.withColumn("speaker", F.when(F.col("speaker") != "", F.col("speaker")))
    manifests.format_rttm(s).write.text(folder)
    back = manifests.read_rttm(spark, _files(folder))
    return back.groupBy("recording_id", F.col("channel")[0].alias("channel"), F.round(F.col("start") * 1000).cast("long").alias("start_ms")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT recording_id, coalesce(channel[1], 0) AS channel, unnest(alignment['word']) AS w FROM supervision WHERE alignment IS NOT NULL AND recording_id IS NOT NULL)
SELECT recording_id, channel, w.symbol AS symbol, count(*) AS n, count(w.score) AS scored FROM w GROUP BY ALL""")
def ctm_round_trip(spark, d):
    folder = shared_folder(spark, "ctm")
    manifests.format_ctm(sup(spark, d).where("recording_id is not null")).write.text(folder)
    return manifests.read_ctm(spark, folder).groupBy("recording_id", "channel", "symbol").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


_WORD_TEXT = r"regexp_replace(text, '[\s\x{0b}]+', ' ', 'g')"


@query("""WITH r AS (SELECT DISTINCT recording_id FROM supervision WHERE recording_id IS NOT NULL), s AS (SELECT id, min(recording_id) AS rec, min(start) AS a, min(duration) AS b FROM supervision
WHERE id IS NOT NULL AND recording_id IS NOT NULL AND start IS NOT NULL AND duration > 0 GROUP BY id HAVING count(*) = 1)
SELECT rec AS recording_id, count(*) AS n FROM s GROUP BY rec""")
def data_directory_segments(spark, d):
    """Segments through a data directory; those of several deliveries have no single line there and are counted apart."""
    folder = local_folder(spark, "kaldi")
    s = sup(spark, d).where("id is not null and recording_id is not null and start is not null and duration > 0")
    once = s.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")
    s = s.join(once, "id").withColumn("speaker", F.when(F.trim("speaker") != "", F.regexp_replace("speaker", r"[\s ]+", "_")))
    rec = s.select(F.col("recording_id").alias("id")).distinct().select("id", F.lit(3600.0).alias("duration"), F.array(F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.concat(F.lit("/a/"), "id").alias("source"))).alias("sources"))
    manifests.write_kaldi_dir(rec, s, folder)
    _, back, _ = manifests.read_kaldi_dir(spark, folder, 16000)
    return back.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, 'file' AS type, CAST(floor(duration * 1000) AS BIGINT) AS duration_ms FROM (SELECT id, max(round(duration, 3)) AS duration FROM audio WHERE id IS NOT NULL AND duration IS NOT NULL AND duration < 1e9 GROUP BY id)""")
def data_directory_recordings(spark, d):
    folder = local_folder(spark, "kaldi")
    a = audio(spark, d).where("id is not null and duration < 1e9").groupBy("id").agg(F.max(F.round("duration", 3)).alias("duration"))
    a = a.withColumn("sources", F.array(F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.concat(F.lit("/a/"), "id").alias("source"))))
    s = a.select(F.col("id"), F.col("id").alias("recording_id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("duration"), F.array(F.lit(0)).alias("channel"), F.lit("t").alias("text"), F.lit("s").alias("speaker"))
    manifests.write_kaldi_dir(a, s, folder)
    back, _, _ = manifests.read_kaldi_dir(spark, folder, 16000)
    return back.select("id", F.col("sources")[0]["type"].alias("type"), F.round(F.col("duration") * 1000).cast("long").alias("duration_ms"))


@query("SELECT id AS key, source AS value FROM (SELECT id, min(recording_id) AS source FROM supervision WHERE recording_id IS NOT NULL GROUP BY id)")
def key_value_files(spark, d):
    folder = shared_folder(spark, "pairs")
    s = sup(spark, d).where("recording_id is not null").groupBy("id").agg(F.min("recording_id").alias("v"))
    s.select(F.concat(F.lit("  "), "id", F.lit(" \t "), "v", F.lit("  ")).alias("value")).write.text(folder)
    return manifests.read_pairs(spark, folder)


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS places, CAST(0 AS BIGINT) AS least FROM stored_files WHERE path IS NOT NULL")
def numbered_text_lines(spark, d):
    folder = local_folder(spark, "lines") + "/all"
    table(spark, d, "stored_files").where("path is not null").select("path").repartition(1).write.text(folder)
    lines = manifests.numbered_lines(spark, _files(folder))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("places"), F.min("line").alias("least"))


# ---- shards, bundles, indexes --------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as rows with a packed payload."""
    e = table(spark, d, "embeddings").select(F.format_string("v%08d", "vec_id").alias("id"), "label", F.array("embedding").alias("m"))
    return arrays.packed_column(e, "m").select("id", "label", "payload")


_SUM = "SELECT printf('v%08d', vec_id) AS id, label, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings"


def _totals(df: DataFrame) -> DataFrame:
    v = F.col("features")[0]
    return df.select("id", "label", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(_SUM)
def packed_arrays(spark, d):
    return _totals(arrays.unpacked_column(_payloads(spark, d), "payload"))


@query(_SUM)
def shards_with_payloads(spark, d):
    folder = local_folder(spark, "shards")
    archives.write_shards(_payloads(spark, d), folder, ["payload"], 500).collect()  # one row a shard
    return _totals(arrays.unpacked_column(archives.read_shards(spark, folder, ["payload"], "id string, label int"), "payload"))


@query(_SUM)
def bundles_with_payloads(spark, d):
    folder = local_folder(spark, "bundles")
    archives.write_bundles(_payloads(spark, d), folder, "payload", 500).collect()  # one row a shard
    return _totals(arrays.unpacked_column(archives.read_bundles(spark, folder, "id string, label int"), "payload"))


@query(_SUM)
def payload_files(spark, d):
    e = _payloads(spark, d)
    where = arrays.write_files(e, "payload", local_folder(spark, "files")).withColumn("path", F.concat(F.lit("file:"), "path"))
    paths = [r["path"] for r in where.select(F.regexp_replace("path", "[^/]+$", "").alias("path")).distinct().collect()]  # the one folder
    read = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("id"), F.col("content").alias("payload"))
    return _totals(arrays.unpacked_column(e.select("id", "label").join(read, "id"), "payload"))


@query("SELECT (row_number() OVER (ORDER BY id) - 1) // 300 AS shard, count(*) AS n FROM (SELECT DISTINCT id FROM cuts) GROUP BY ALL".replace("SELECT (row_number", "SELECT shard, count(*) AS n FROM (SELECT (row_number").replace(" AS shard, count(*) AS n FROM (SELECT DISTINCT id FROM cuts) GROUP BY ALL", " AS shard FROM (SELECT DISTINCT id FROM cuts)) GROUP BY shard"))
def shard_sizes(spark, d):
    return archives.write_shards(_unique(cuts(spark, d)).select("id", "start", "duration"), local_folder(spark, "shards"), [], 300)


@query("SELECT printf('v%08d.bin', vec_id) AS name, CAST(128 + 4 * len(embedding) AS BIGINT) AS size FROM embeddings")
def tar_members(spark, d):
    folder = local_folder(spark, "bundles")
    archives.write_bundles(_payloads(spark, d), folder, "payload", 500).collect()
    archives.register(spark)
    members = spark.read.format("tar").option("path", folder).option("payload", "false").load()
    return members.where("name like '%.bin'").select("name", "size")


@query(_SUM)
def tar_pointers(spark, d):
    """Each payload by one ranged read through a pointer into its archive."""
    folder = local_folder(spark, "bundles")
    e = _payloads(spark, d)
    archives.write_bundles(e, folder, "payload", 500).collect()
    archives.register(spark)
    members = spark.read.format("tar").option("path", folder).option("payload", "false").load().where("name like '%.bin'")
    pointed = members.select(F.regexp_replace("name", r"\.bin$", "").alias("id"), manifests.pointer(F.col("archive"), F.col("offset"), F.col("offset") + F.col("size")).alias("p"))

    @F.pandas_udf(T.BinaryType())
    def fetch(p: pd.Series) -> pd.Series:
        return p.map(archives.read_pointer)

    read = pointed.select("id", fetch("p").alias("payload"))
    return _totals(arrays.unpacked_column(e.select("id", "label").join(read, "id"), "payload"))


def _indexed_lines(spark: SparkSession, d: str) -> list[str]:
    folder = local_folder(spark, "indexed") + "/all"
    c = _unique(cuts(spark, d)).select("id", "duration")
    manifests.write_manifest(c.repartitionByRange(4, "id").sortWithinPartitions("id"), folder)
    paths = [p for p in _files(folder) if os.path.getsize(p)]
    archives.write_line_index(spark, paths).collect()
    return paths


@query("SELECT CAST(count(DISTINCT id) AS BIGINT) AS n, true AS fresh FROM cuts")
def line_index_rows(spark, d):
    paths = _indexed_lines(spark, d)
    made = archives.catalogue_of(spark, "cuts", paths)
    return made.agg(F.sum("n").alias("n"), F.lit(all(map(archives.index_is_fresh, paths))).alias("fresh"))


@query(f"SELECT id, {us_sql('max(duration)')} AS duration_us FROM cuts GROUP BY id")
def rows_by_index(spark, d):
    """Every row by its number, one seek each."""
    made = archives.catalogue_of(spark, "cuts", _indexed_lines(spark, d))
    wanted = made.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row")).repartition(8)
    lines = archives.read_indexed(spark, wanted)
    return lines.select(F.from_json("line", "id string, duration double").alias("c")).select("c.id", us("c.duration").alias("duration_us"))


@query("SELECT CAST(2 * count(*) AS BIGINT) AS n FROM embeddings")
def tar_index_members(spark, d):
    folder = local_folder(spark, "bundles")
    archives.write_bundles(_payloads(spark, d), folder, "payload", 500).collect()
    return archives.write_tar_index(spark, archives.expand(folder)).agg(F.sum("n").alias("n"))


# ---- signals -------------------------------------------------------------------------------------------------------


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as short signals of whole 16-bit steps."""
    step = F.transform("embedding", lambda x: (F.round(F.greatest(F.least(x, F.lit(0.9)), F.lit(-0.9)) * 1000) / 1024).cast("float"))
    return table(spark, d, "embeddings").select(F.format_string("v%08d", "vec_id").alias("id"), step.alias("samples"), F.lit(8000).alias("rate"))


_STEPS = "list_transform(embedding, lambda x: round(greatest(least(CAST(x AS DOUBLE), 0.9), -0.9) * 1000))"


@query(f"SELECT printf('v%08d', vec_id) AS id, CAST(len(embedding) AS BIGINT) AS n, CAST(list_sum(list_transform({_STEPS}, lambda x: x * x)) AS BIGINT) AS energy FROM embeddings")
def wav_round_trip(spark, d):
    made = wav.save_audio(_signals(spark, d), local_folder(spark, "wav"))
    read = wav.load_audio(made.select("id", "path", F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("duration")))
    steps = F.transform("samples", lambda x: F.round(x * 1024).cast("long"))
    return read.select("id", F.size("samples").cast("long").alias("n"), F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x * x).alias("energy"))


@query("SELECT printf('v%08d', vec_id) AS id, 8000 AS sampling_rate, CAST(len(embedding) AS BIGINT) AS num_samples FROM embeddings")
def recordings_of_a_folder(spark, d):
    folder = local_folder(spark, "wav")
    wav.save_audio(_signals(spark, d), folder).write.format("noop").mode("overwrite").save()
    return wav.recordings_from_dir(spark, folder).select("id", "sampling_rate", "num_samples")


@query("SELECT printf('v%08d', vec_id) AS id, true AS near FROM embeddings")
def lossy_arrays(spark, d):
    """Arrays through the lossy codec come back within a step."""
    e = table(spark, d, "embeddings").select(F.format_string("v%08d", "vec_id").alias("id"), "embedding", F.array("embedding").alias("m"))
    back = arrays.unpacked_column(arrays.packed_column(e, "m", "lossy"), "payload", "lossy")
    worst = F.array_max(F.zip_with("embedding", F.col("features")[0], lambda a, b: F.abs(a - b)))
    return back.select("id", (worst <= 2.0**-5).alias("near"))


# ---- corpora ---------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT id, max(CAST(round(duration * 1000) AS BIGINT)) AS ms FROM audio WHERE id IS NOT NULL AND duration > 0.001 AND duration < 1e9 GROUP BY id)
SELECT id, 'c ' || id AS text, ms FROM a""")
def clips_of_a_table(spark, d):
    """Recordings as clips: a tab-separated table and one of durations."""
    folder = shared_folder(spark, "clips")
    a = audio(spark, d).where("id is not null and duration > 0.001 and duration < 1e9").groupBy("id").agg(F.max(F.round(F.col("duration") * 1000).cast("long")).alias("ms"))
    tsv = lambda df, name: df.write.option("sep", "\t").option("header", "true").csv(f"{folder}/{name}")
    tsv(a.select(F.lit("who").alias("client_id"), F.concat("id", F.lit(".mp3")).alias("path"), F.concat(F.lit("c "), "id").alias("sentence"), F.lit("x").alias("gender")), "train")
    tsv(a.select(F.concat("id", F.lit(".mp3")).alias("clip"), F.col("ms").alias("duration[ms]")), "durations")
    segments = corpora.clips(spark, f"{folder}/train", "/clips", f"{folder}/durations", "en")[1]
    return segments.select("id", "text", F.round(F.col("duration") * 1000).cast("long").alias("ms"))


@query("SELECT printf('7-%d-%04d', label, vec_id) AS id, CAST(len(embedding) AS BIGINT) AS n, '7' AS speaker, 'WORD ' || vec_id AS text FROM embeddings")
def chapters_of_a_corpus(spark, d):
    """Signals with transcripts as read speech by chapter."""
    folder = local_folder(spark, "corpus")
    e = table(spark, d, "embeddings").select(F.format_string("7-%d-%04d", "label", "vec_id").alias("id"), "vec_id", "embedding")
    wav.save_audio(e.select("id", F.transform("embedding", lambda x: x / 1000).alias("samples"), F.lit(8000).alias("rate")), folder).write.format("noop").mode("overwrite").save()
    e.select(F.concat("id", F.lit(" WORD "), F.col("vec_id").cast("string")).alias("value")).write.text(f"{folder}/lines")
    for i, path in enumerate(_files(f"{folder}/lines")):
        os.rename(path, f"{folder}/{i}.trans.txt")
    recordings, segments = corpora.chapters(spark, folder, "wav")
    return segments.join(recordings.select("id", "num_samples"), "id").select("id", F.col("num_samples").alias("n"), "speaker", "text")


QUERIES = {k: f for k, f in _ALL.items() if k not in _BEFORE}
ORACLES = {k: s for k, s in _ALL_SQL.items() if k in QUERIES}
