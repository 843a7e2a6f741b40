"""The k-way merge of sorted runs against a plain sort."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtile.operators import joins, runs


def batches(rows, size):
    for i in range(0, max(1, len(rows)), size):
        part = rows[i : i + size]
        k = pa.array([None if r[0] is None else r[0] for r in part], pa.string())
        yield pa.RecordBatch.from_arrays([k, pa.array([r[1] for r in part], pa.float64()), pa.array([r[2] for r in part], pa.int64())], names=["k", "w", "n"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b", "ba", "c", "d", None]), max_size=30), max_size=6), st.lists(st.sampled_from(["a", "b", "c"]), max_size=2, unique=True), st.integers(1, 5), st.integers(1, 7))
def test_merge_is_a_stable_sort(lists, cuts, block, size):
    class Here:
        @staticmethod
        def get():
            return Here

        partitionId = staticmethod(lambda: 0)

    kept, runs.TaskContext = runs.TaskContext, Here
    try:
        rows = [(k, 1.0, 100 * r + i) for r, run in enumerate(lists) for i, k in enumerate(sorted(run, key=lambda k: k or ""))]
        cut = sorted((c,) for c in cuts)
        blocks = [x for b in runs._blocks(1, cut, block)(batches(rows, size)) for x in zip(*[c.to_pylist() for c in b.columns[:4]], [b.column(4)[j] for j in range(b.num_rows)])]
    finally:
        runs.TaskContext = kept
    blocks.sort(key=lambda x: x[:4])
    listed = [x[4].values for x in blocks]
    lists_of = pa.ListArray.from_arrays(pa.array([0, *[sum(map(len, listed[: i + 1])) for i in range(len(listed))]], pa.int32()), pa.concat_arrays(listed)) if listed else None
    source = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.list_(pa.string())), pa.array([x[2] for x in blocks]), pa.array([x[3] for x in blocks]), lists_of], names=["range", "first", "run", "seq", "rows"])] if listed else []
    merge = runs._merge(1, runs._Rolled(3.0, 0.0, {i: 1e9 for i in range(4)}), ["k", "w", "n"], batch_rows=3)
    got = [r for b in merge(iter(source)) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert [r[0] or "" for r in got] == sorted(r[0] or "" for r in rows)
    assert sorted(r[2] for r in got) == sorted(r[2] for r in rows)
    assert [r[3] for r in got] == sorted(r[3] for r in got)
    filled = {}
    for r in got:
        filled[r[3], r[4]] = filled.get((r[3], r[4]), 0) + r[1]
    assert all(v <= 3 for v in filled.values())


@pytest.mark.parametrize("ranges", [1, 3, 20])
def test_merged_keeps_copies_and_order(spark, ranges):
    rows = [(f"k{(i * 37) % 91:03d}" if i % 9 else None, i, float(i % 5)) for i in range(900)] + [("hot", i, 1.0) for i in range(900, 1300)]
    df = spark.createDataFrame(rows, "key string, n int, w double").repartition(7, "n").sortWithinPartitions("key")
    out = runs.merged(df, ["key"], "w", 50.0, 10.0, ranges=ranges, block=8).collect()
    assert sorted(r.n for r in out) == list(range(1300))
    by = {}
    for r in out:
        by.setdefault((r.range, r.output), []).append(r)
    order = [r.key or "" for k in sorted(by) for r in by[k]]
    assert order == sorted(order)
    assert len({r.range for r in out if r.key == "hot"}) == 1
    assert all(sum(r.w for r in v) <= 50 + 10 for v in by.values())


def test_pairs_of_a_large_key_come_block_by_block(spark):
    df = spark.range(60).select(F.when(F.col("id") < 45, "hot").otherwise("few").alias("k"), F.when(F.col("id") < 45, F.col("id")).otherwise(F.col("id") - 45).alias("p"), F.col("id").alias("m"))
    got = {(r.left, r.right) for r in joins.block_pairs(df, "k", "p", "m", block=7).collect()}
    assert got == {(i, j) for lo, hi in ((0, 45), (45, 60)) for i in range(lo, hi) for j in range(i + 1, hi)}
    assert joins.block_pairs(df, "k", "p", "m", block=7).count() == len(got)
