"""Queries of the general problems (2 and 3) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtile.operators import consolidate, coverage
from voxtile.session import shared_folder, table


def settings(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """job_settings holds eight fixed rows."""
    return {r["name"]: r["amount"] for r in table(spark, sf_dir, "job_settings").collect()}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.shared_files(table(spark, sf_dir, "audio"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settings(spark, sf_dir)
    return consolidate.shard_plan(
        table(spark, sf_dir, "audio"), table(spark, sf_dir, "stored_files"), int(s["shard_target"]), int(s["shard_min"])
    )


def p2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


def p2_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.range_metadata(_plan(spark, sf_dir))


def p2_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n): how often each recording lies in the outputs."""
    return _plan(spark, sf_dir).where("kind = 'recording'").groupBy(F.col("name").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n_rows, n_samples): the rows of the recordings after many small sorted files of them were merged into few."""
    small, large = shared_folder(spark, "small"), shared_folder(spark, "merged")
    audio = table(spark, sf_dir, "audio").select("id", "sampling_rate", "num_samples", "duration")
    audio.repartition(64).sortWithinPartitions("id").write.option("maxRecordsPerFile", 100).parquet(small)
    consolidate.consolidate_files(spark, small, "id", large, 256_000)
    merged = spark.read.schema(audio.schema).option("recursiveFileLookup", "true").parquet(large)
    return merged.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("num_samples").alias("n_samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.silences(coverage.segment_spans(table(spark, sf_dir, "supervision")))


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.periods(coverage.segment_spans(table(spark, sf_dir, "supervision")))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_report(coverage.segment_spans(table(spark, sf_dir, "supervision")))


QUERIES = {f.__name__: f for f in (p2_found, p2_shards, p2_ranges, p2_recordings, p2_merged, p3_found, p3_periods, p3_coverage)}

_SPANS = """
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
periods AS (SELECT recording_id, min(s) AS start_ms, max(e) AS end_ms FROM numbered GROUP BY recording_id, n)
"""

ORACLES = {
    "p2_recordings": "SELECT id, CAST(1 AS BIGINT) AS n FROM audio WHERE id IS NOT NULL GROUP BY id",
    "p2_merged": "SELECT id, count(*) AS n_rows, CAST(sum(num_samples) AS BIGINT) AS n_samples FROM audio GROUP BY id",
    "p3_found": _SPANS
    + """SELECT recording_id, edge AS gap_start_ms, s AS gap_end_ms FROM marked
         WHERE edge IS NOT NULL AND s - edge BETWEEN 1 AND 600000""",
    "p3_periods": _SPANS + "SELECT recording_id, start_ms, end_ms FROM periods",
    "p3_coverage": _SPANS
    + """SELECT recording_id, count(*) AS n_periods, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms,
                min(start_ms) AS first_ms, max(end_ms) AS last_ms,
                CAST(max(end_ms) - min(start_ms) - sum(end_ms - start_ms) AS BIGINT) AS silent_ms
         FROM periods GROUP BY recording_id""",
}
