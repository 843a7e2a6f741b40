"""Queries of the problems on training data over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtile.llm import packing, pieces, sentences, splits, tokens, turns
from voxtile.llm.turns import CODES
from voxtile.plans.problems import settings
from voxtile.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_openers(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "speakers"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "speakers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = splits.record_entities(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "speakers"))
    return splits.linked_pairs(splits.connected_groups(edges))


def _shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    s = settings(spark, sf_dir)
    return {"train": s["split_train"], "valid": s["split_valid"], "test": s["split_test"]}


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _shares(spark, sf_dir)
    return splits.assign_splits(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "speakers"), shares)


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("id", "recording_id", "split")


def p4_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, n, n_splits): the segments of each recording and in how many splits they are."""
    return _assigned(spark, sf_dir).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("n_splits"))


def p4_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(language, n, within): the languages of 1,000 segments or more, and whether all splits are within a point of their share."""
    d = splits.split_deviation(_assigned(spark, sf_dir), _shares(spark, sf_dir))
    return d.where("total >= 1000").groupBy("language").agg(F.max("total").alias("n"), (F.max(F.abs("points")) <= 1.0).alias("within"))


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    s = settings(spark, sf_dir)
    most, overlap = round(s["piece_max"] * 1000), round(s["piece_overlap"] * 1000)
    return pieces.pieces(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "audio"), most, overlap), most


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.uncuttable(*_pieces(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)[0]


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, from_ms, to_ms, too_long, wrong_overlap): what the pieces of each recording cover, and how many break a rule."""
    s = settings(spark, sf_dir)
    most, overlap = round(s["piece_max"] * 1000), round(s["piece_overlap"] * 1000)
    cut = pieces.pieces(table(spark, sf_dir, "supervision"), table(spark, sf_dir, "audio"), most, overlap)
    w = Window.partitionBy("recording_id", "section").orderBy("start_ms")
    cut = cut.withColumn("shared", F.lag("end_ms").over(w) - F.col("start_ms"))
    return cut.groupBy("recording_id").agg(
        F.min("start_ms").cast("long").alias("from_ms"), F.round(F.max("end_ms")).cast("long").alias("to_ms"),
        F.count_if(F.col("end_ms") - F.col("start_ms") > most).alias("too_long"), F.count_if(F.abs(F.col("shared") - overlap) > 1e-6).alias("wrong_overlap"),
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = int(settings(spark, sf_dir)["container_capacity"])
    return packing.pack(table(spark, sf_dir, "documents"), capacity), capacity


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized(_packed(spark, sf_dir)[0])


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_char")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first_char, end_char, gaps): where the sentences of each document begin and end, and how many leave something out."""
    s = sentences.sentences(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("number")
    s = s.withColumn("gap", (F.lag("next_char").over(w) != F.col("start_char")).cast("int"))
    return s.groupBy("doc_id").agg(
        F.min("start_char").alias("first_char"), F.max("next_char").alias("end_char"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("gaps")
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_turns, p4_found, p4_splits, p4_recordings, p4_deviation, p5_found, p5_pieces, p5_limits, p6_ids, p7_found, p7_containers, p7_fill, p8_found, p8_sentences, p8_cover)
}

_FIRST = """
WITH ranked AS (SELECT *, CAST(recording_id IS NULL AS INT) + CAST("start" IS NULL AS INT) + CAST(duration IS NULL AS INT)
                          + CAST(text IS NULL AS INT) + CAST(language IS NULL AS INT) + CAST(speaker IS NULL AS INT) AS nulls FROM supervision),
first AS (SELECT id, min((nulls, received_at, recording_id, "start", duration)) AS r FROM ranked WHERE id IS NOT NULL GROUP BY id),
spans AS (SELECT r[3] AS recording_id, CAST(round(r[4] * 1000) AS BIGINT) AS s,
                 CAST(round((r[4] + r[5]) * 1000) AS BIGINT) AS e
          FROM first WHERE r[3] IS NOT NULL AND r[4] IS NOT NULL AND r[5] > 0),
marked AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM spans),
numbered AS (SELECT *, sum(CASE WHEN edge IS NULL OR s > edge THEN 1 ELSE 0 END)
                       OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM marked),
periods AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY recording_id, n),
heard AS (SELECT id, min((CAST(sampling_rate IS NULL AS INT) + CAST(num_samples IS NULL AS INT) + CAST(duration IS NULL AS INT)
                         + CAST(sources IS NULL AS INT), received_at, sampling_rate, num_samples, duration)) AS r
          FROM audio WHERE id IS NOT NULL GROUP BY id),
ends AS (SELECT id, coalesce(CASE WHEN r[3] > 0 THEN r[4] * 1000.0 / r[3] END, r[5] * 1000) AS stop FROM heard)
"""

_CASES = " ".join(f"WHEN '{name}' THEN '{of}'" for name, of in CODES.items())
_CHOSEN = _FIRST[: _FIRST.index("spans AS")].replace('"start", duration)) AS r', 'language)) AS r') + "x AS (SELECT id, r[3] AS recording_id, r[4] AS language FROM first WHERE r[3] IS NOT NULL)"

ORACLES = {
    "p4_recordings": _CHOSEN + " SELECT recording_id, count(*) AS n, CAST(1 AS BIGINT) AS n_splits FROM x GROUP BY recording_id",
    "p4_deviation": _CHOSEN
    + f""", l AS (SELECT coalesce(CASE split_part(replace(lower(trim(language)), '_', '-'), '-', 1) {_CASES} END, '?') AS language FROM x)
         SELECT language, count(*) AS n, true AS within FROM l GROUP BY language HAVING count(*) >= 1000""",
    "p5_found": _FIRST
    + """SELECT recording_id, s AS stretch_start_ms FROM periods JOIN ends ON ends.id = periods.recording_id
         WHERE least(e, stop) - s > (SELECT amount * 1000 FROM job_settings WHERE name = 'piece_max')""",
    "p5_limits": _FIRST
    + """SELECT id AS recording_id, CAST(0 AS BIGINT) AS from_ms, CAST(round(stop) AS BIGINT) AS to_ms, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlap
         FROM ends WHERE stop > 0""",
    # every document with a visible character is covered from its first such character to its end
    "p8_cover": r"""SELECT doc_id, length(regexp_extract(text, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*')) AS first_char, length(text) AS end_char, CAST(0 AS BIGINT) AS gaps
        FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\p{C}]')""",
}
