import os
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from voxtile.operators import consolidate, coverage

T0 = datetime(2031, 1, 1)
SUP = "id string, recording_id string, start double, duration double, received_at timestamp, note string"
AUDIO = "id string, sources array<struct<type string, channels array<int>, source string>>"


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40))
def test_interval_map_against_points(spans):
    m = coverage.IntervalMap()
    for s, n in spans:
        m.insert(s, s + n)
    points = {p for s, n in spans for p in range(s, s + n)}
    assert {p for a, b in zip(m.starts, m.ends) for p in range(a, b)} == points
    assert all(a < b for a, b in m.gaps())


def brute(spans):
    out, edge = [], {}
    for r, s, e in sorted(spans):
        if r in edge and s > edge[r]:
            out.append((r, edge[r], s))
        edge[r] = max(edge.get(r, e), e)
    return set(out)


def test_silences_by_brute_force_and_chunk_size(spark):
    spans = [(f"r{k % 3}" if k % 2 else "hot", (k * 7919) % 50_000, (k * 7919) % 50_000 + (k * 31) % 400 + 1) for k in range(500)]
    df = spark.createDataFrame(spans, "recording_id string, start_ms long, end_ms long")
    exp = brute(spans)
    for chunk in (10**9, 3_000, 97):
        assert {tuple(r) for r in coverage.silences(df, max_ms=None, chunk_ms=chunk).collect()} == exp
    a, b = ({tuple(r) for r in coverage.periods(df, c).collect()} for c in (10**9, 97))
    assert a == b and len(a) == len(exp) + 4


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "r", 0.0, 1.0, T0, ""), ("a", "r", 0.0, 1.0, T0, "x"), ("b", "r", None, 1.0, T0, ""), ("c", "r", 3.0, 0.0, T0, ""), ("d", "r", 3.0, -2.0, T0, ""), ("e", None, 3.0, 1.0, T0, ""), (None, "r", 5.0, 1.0, T0, ""), ("f", "r", nan, 1.0, T0, ""), ("g", "r", 4.0, inf, T0, ""), ("h", "r", 9.0, 1.0, T0, "")]
    spans = coverage.segment_spans(spark.createDataFrame(rows, SUP))
    assert [tuple(r) for r in coverage.silences(spans).collect()] == [("r", 1000, 9000)]
    assert coverage.silences(spans.limit(0)).count() == 0


@pytest.mark.parametrize(
    "kind, source, path",
    [
        ("file", "/s/a/x.wav", "/s/a/x.wav"), ("file", " /s/a/./b/../x.wav\n", "/s/a/x.wav"), ("file", "//s//a//x.wav", "/s/a/x.wav"),
        ("file", "\\s\\a\\x.wav", "/s/a/x.wav"), ("url", "file:///s/caf%C3%A9/x%20y.wav", "/s/café/x y.wav"), ("url", "file://localhost/s/x.wav", "/s/x.wav"),
        ("url", "file:/s/x.wav", "/s/x.wav"), ("command", "sox /s/x.wav -r 16000 -t wav - |", "/s/x.wav"), ("command", "cat '/s/L 2/x y.wav' |", "/s/L 2/x y.wav"),
        ("command", "ffmpeg -nostdin -i \"/s/x.wav\" -f wav pipe:1 |", "/s/x.wav"), ("command", "cd '/s/L 2' && cat 'x y.wav' | head -c 99", "/s/L 2/x y.wav"),
        ("file", "", None), ("file", None, None), ("command", "echo |", None), ("file", "/s/A.WAV", "/s/A.WAV"),
    ],
)
def test_stored_path(kind, source, path):
    assert consolidate.stored_path(kind, source) == path


def test_consolidation_keeps_everything_once(spark):
    src = lambda *p: [("file", [0], x) for x in p]
    audio = spark.createDataFrame([("a", src("/s/1", "/s/2")), ("b", src("//s/1")), ("b", src("//s/1")), ("c", None), ("d", src("")), (None, src("/s/3")), ("e", src("/s/3"))], AUDIO)
    stored = spark.createDataFrame([("/s/1", 60, T0), ("/s/2", None, T0), ("/s/3", 500, T0), ("/s/9", 5, T0)], "path string, n_bytes long, modified_at timestamp")
    assert [tuple(r) for r in consolidate.shared_files(audio).collect()] == [("a", "b")]
    plan = consolidate.shard_plan(audio, stored, 100, 10)
    assert sorted((r.kind, r.name) for r in plan.collect()) == [("file", "/s/1"), ("file", "/s/2"), ("file", "/s/3"), ("recording", "a"), ("recording", "b"), ("recording", "c"), ("recording", "d"), ("recording", "e")]
    meta = {r.shard: r for r in consolidate.range_metadata(plan).collect()}
    assert sum(r.n_bytes for r in meta.values()) == 560 and sum(r.n_entries for r in meta.values()) == 8
    assert consolidate.shard_plan(audio.limit(0), stored, 100, 10).count() == 0


def test_files_on_disk_are_merged(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(f"k{(i * 37) % 50:03d}", i) for i in range(300)]
    paths = []
    for f in range(20):
        part = sorted(rows[f::20])
        paths.append(str(tmp_path / f"in{f}.parquet"))
        pq.write_table(pa.table({"key": [k for k, _ in part], "n": [n for _, n in part]}), paths[-1])
    meta = consolidate.consolidate_files(spark, paths, "key", str(tmp_path / "out"), 3000, ranges=3).collect()
    got = [(r["key"], r["n"]) for m in sorted(meta, key=lambda m: m.file) for r in pq.read_table(m.file).to_pylist()]
    assert sorted(got) == sorted(rows) and [k for k, _ in got] == sorted(k for k, _ in rows)
    assert len(meta) < 20 and all(os.path.getsize(m.file) == m.n_bytes for m in meta)


def test_null_keys_and_absent_statistics_lose_nothing(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = [[f"k{(i * 7 + f) % 60:03d}" for i in range(f, 60, 3)] for f in range(6)]
    keys[1] = [k for k in keys[1] if k > "k040"]
    rows, paths = [], []
    for f, ks in enumerate(keys):
        first, last = (2 if f in (1, 3) else 0), (3 if f in (2, 5) else 0)
        part = [None] * first + sorted(ks) + [None] * last
        number = [f * 1000 + i for i in range(len(part))]
        rows += zip(part, number)
        paths.append(str(tmp_path / f"in{f}.parquet"))
        # a struct before the key: its leaves come first in the file
        note = pa.array([{"a": "z", "b": i} for i in number], pa.struct([("a", pa.string()), ("b", pa.int64())]))
        pq.write_table(pa.table({"note": note, "key": pa.array(part, pa.string()), "n": number}), paths[-1], row_group_size=7, write_statistics=f not in (4, 5))
    paths.append(str(tmp_path / "nulls.parquet"))
    pq.write_table(pa.table({"note": pa.array([{"a": "z", "b": 1}], note.type), "key": pa.array([None], pa.string()), "n": [9000]}), paths[-1])
    rows.append((None, 9000))
    meta = consolidate.consolidate_files(spark, paths, "key", str(tmp_path / "out"), 1500, ranges=3).collect()
    got = [(r["key"], r["n"]) for m in sorted(meta, key=lambda m: m.file) for r in pq.read_table(m.file).to_pylist()]
    order = lambda k: (k is not None, k or "")
    assert sorted(got, key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])
    assert [k for k, _ in got] == sorted((k for k, _ in rows), key=order) and len(meta) > 3


def test_what_comes_after_a_timeout_adds_to_what_was_known(spark):
    from voxtile.streaming.coverage import latest_periods

    wrote = [("r", 0, 1, 0, 100), ("r", 0, 2, 0, 100), ("r", 0, 2, 200, 300), ("r", 0, 3, 0, 100), ("r", 0, 3, 200, 350), ("r", 0, 1, 90, 120), ("r", 0, 1, 500, 600), ("r", 1, 1, 650, 700)]
    df = spark.createDataFrame(wrote, "recording_id string, chunk long, version long, start_ms long, end_ms long")
    got = sorted(tuple(r) for r in latest_periods(df).select("chunk", "start_ms", "end_ms").collect())
    assert got == [(0, 0, 120), (0, 200, 350), (0, 500, 600), (1, 650, 700)]


def test_stream_loses_nothing_after_a_timeout(spark, tmp_path):
    from datetime import timedelta

    from voxtile.streaming.coverage import OUT, latest_periods, period_stream
    from voxtile.streaming.sessions import settled

    schema = "recording_id string, start double, duration double, received_at timestamp"
    rounds = [[("r", 0.0, 1.0, T0)], [("q", 5.0, 1.0, T0 + timedelta(days=30))], [("q", 6.0, 2.0, T0 + timedelta(days=60))], [("r", 3.0, 1.0, T0 + timedelta(days=61)), ("r", 0.5, 1.0, T0 + timedelta(days=61))]]
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        for f in (tmp_path / f"in/part={i}").glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    wrote = settled(period_stream(stream, late="1 day"), OUT, "update").cache()
    assert wrote.where("recording_id = 'r' and version = 1").select("_batch").distinct().count() == 2  # its state was dropped between
    got = sorted(tuple(r) for r in latest_periods(wrote).select("recording_id", "start_ms", "end_ms").collect())
    assert got == [("q", 5000, 8000), ("r", 0, 1500), ("r", 3000, 4000)]
