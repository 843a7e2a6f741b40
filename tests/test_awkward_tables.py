"""Clashing extra columns, nulls anywhere, repeated rows and empty tables, for the general problems' operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtile.operators import consolidate, coverage

T0 = datetime(2031, 1, 1)
CLASH = ["chunk", "key", "path", "kind", "name", "carry", "edge_ms", "fresh", "start_ms", "end_ms", "range", "output", "shard", "n", "source", "type"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.mark.parametrize("empty", [False, True])
def test_coverage(spark, empty):
    full = ("a", "r", 0.0, 1.0, T0)
    rows = [full, full, ("b", "r", 3.0, 1.0, T0), *[tuple(None if i == j else v for j, v in enumerate(full[:-1])) + (T0,) for i in range(4)], ("c", "s", float("nan"), 1.0, T0)]
    df = clashing(spark.createDataFrame(rows, "id string, recording_id string, start double, duration double, received_at timestamp"))
    spans = coverage.segment_spans(df.limit(0) if empty else df)
    assert [tuple(r) for r in coverage.silences(spans).collect()] == ([] if empty else [("r", 1000, 3000)])
    assert coverage.periods(spans).count() == (0 if empty else 2)
    assert coverage.coverage_report(spans).count() == (0 if empty else 1)


@pytest.mark.parametrize("empty", [False, True])
def test_consolidation(spark, empty):
    src = lambda p: [("file", None, p)]
    audio = spark.createDataFrame([("a", src("/s/1")), ("b", src("/s//1")), ("b", src("/s//1")), (None, src("/s/1")), ("c", None), ("d", src(None)), ("e", [(None, None, "/s/2")])], "id string, sources array<struct<type:string,channels:array<int>,source:string>>")
    stored = spark.createDataFrame([("/s/1", 5), (None, 3), ("/s/3", None)], "path string, n_bytes long")
    audio, stored = clashing(audio), clashing(stored.withColumn("id", F.lit("x")))
    if empty:
        audio, stored = audio.limit(0), stored.limit(0)
    assert [tuple(r) for r in consolidate.shared_files(audio).collect()] == ([] if empty else [("a", "b")])
    names = sorted((r.kind, r.name) for r in consolidate.shard_plan(audio, stored, 100, 10).collect())
    assert names == ([] if empty else [("file", "/s/1"), ("file", "/s/2"), *[("recording", x) for x in "abcde"]])
