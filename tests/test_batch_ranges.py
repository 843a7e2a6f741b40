"""Batches over many ranges whose open batches never fall into step: the right numbers, in as many Spark jobs as over few ranges."""

import random

import pytest
from tests.test_batching import one_pass

from voxtile.operators import batching as B


def jobs(spark, make):
    """Rows of a query and how many jobs they took."""
    group = f"g{random.getrandbits(64)}"
    spark.sparkContext.setJobGroup(group, group)
    rows = make().collect()
    spark.sparkContext.setJobGroup("none", "none")
    return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def in_ranges(monkeypatch, size):
    for f in (B._in_order, B.greedy_batches):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], size))


def both(spark, rows, schema, make):
    """The rows over all of them, after a look at the jobs over the first third."""
    few, n = jobs(spark, lambda: make(spark.createDataFrame(rows[: len(rows) // 3], schema).repartition(3)))
    all_rows, m = jobs(spark, lambda: make(spark.createDataFrame(rows, schema).repartition(3)))
    assert m <= n + 4 and len(few) == len(rows) // 3  # adaptive plans differ by a few jobs
    return all_rows


def test_simple_batches_of_many_ranges(spark, monkeypatch):
    in_ranges(monkeypatch, 20)
    rows, c = [(k % 2, f"i{k:04d}", 1.0) for k in range(540)], B.Constraint(max_total=60.0, max_items=9)
    got = both(spark, rows, "s int, id string, duration double", lambda df: B.greedy_batches(df, c, mode="simple", stratum="s"))
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.Greedy(c, "simple")) and len(got) == 540


@pytest.mark.parametrize("mode", ["simple", "dynamic"])
@pytest.mark.parametrize("concatenate", [False, True])
def test_odd_sizes_are_followed_in_order(spark, monkeypatch, mode, concatenate):
    rnd = random.Random(5)
    rows = [(0, f"i{k:04d}", rnd.choice([2.0, 5.0, 9.0]) if k > 25 else rnd.choice([2.0, -8.0, -1.0])) for k in range(200)]
    rows[12] = (0, "i0012", 0.0)
    c = B.Constraint(max_total=40.0, concatenate=concatenate)
    in_ranges(monkeypatch, 15)
    got = B.greedy_batches(spark.createDataFrame(rows, "s int, id string, duration double"), c, mode=mode, stratum="s").collect()
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.Greedy(c, mode))


def test_wide_batches_and_null_strata(spark, monkeypatch):
    monkeypatch.setattr(B, "WIDE", 4)
    rows = [(k % 2 or None, f"i{k:04d}", float(1 + k % 3)) for k in range(120)]
    c = B.Constraint(max_total=40.0)
    got = B.greedy_batches(spark.createDataFrame(rows, "s int, id string, duration double"), c, stratum="s", size=17).collect()
    assert {(r.stratum or 0, r.id): r.batch for r in got} == one_pass([(s or 0, *x) for s, *x in rows], lambda: B.Greedy(c, "dynamic")) and len(got) == 120


def test_batches_of_one_order_of_many_ranges(spark, monkeypatch):
    in_ranges(monkeypatch, 20)
    rows, c = [(0, f"i{k:04d}", 1.0) for k in range(540)], B.Constraint(max_total=7.0)
    got = both(spark, rows, "s int, id string, duration double", lambda df: B.greedy_batches(df, c))
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.Greedy(c, "dynamic")) and len(got) == 540


def test_dynamic_batches_of_many_ranges(spark, monkeypatch):
    in_ranges(monkeypatch, 20)
    rows, c = [(k % 3, f"i{k:04d}", 1.0 + (k % 2) / 4) for k in range(540)], B.Constraint(max_total=14.0)
    got = both(spark, rows, "s int, id string, duration double", lambda df: B.greedy_batches(df, c, stratum="s"))
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.Greedy(c, "dynamic")) and len(got) == 540


def test_bucketed_batches_of_many_ranges(spark, monkeypatch):
    in_ranges(monkeypatch, 20)
    rows, c = [(f"i{k:04d}", float(1 + 4 * (k % 2))) for k in range(540)], B.Constraint(max_total=35.0)
    got = both(spark, rows, "id string, duration double", lambda df: B.bucketed_batches(df, [2.0], c, shards=1))
    kept = {}
    for r in got:
        kept.setdefault((r.bucket, r.batch), set()).add(r.id)
    sizes = {b: [len(v) for (x, _), v in sorted(kept.items()) if x == b] for b in (0, 1)}
    assert sizes == {0: [35] * 7 + [25], 1: [7] * 38 + [4]} and len(got) == 540


def test_paired_batches_of_many_ranges(spark, monkeypatch):
    in_ranges(monkeypatch, 20)
    rows = [(0, f"i{k:04d}", 1.0, 10.0) for k in range(540)]
    a, b = B.Constraint(max_total=9.0), B.Constraint(max_total=110.0)
    got = both(spark, rows, "s int, id string, a double, b double", lambda df: B.paired_batches(df, a, b, "a", "b"))
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.GreedyPairs(a, b)) and len(got) == 540
