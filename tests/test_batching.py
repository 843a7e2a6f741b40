"""Batches over ranges that are guessed and verified agree with one pass."""

import random

import pytest

from voxtile.operators import batching as B


def one_pass(rows, machine):
    out, state = {}, {}
    for s, i, *m in sorted(rows):
        out[s, i] = state.setdefault(s, machine()).add(*m)
    return out


@pytest.mark.parametrize("mode", ["simple", "dynamic"])
@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_ranges_change_no_batch(spark, mode, size):
    rnd = random.Random(3)
    rows = [(0 if k < 500 else k % 3, f"i{k:04d}", rnd.choice([0.5, 1.0, 3.0, 9.0, 30.0])) for k in range(700)]
    c = B.Constraint(max_total=60.0, max_items=9)
    got = B.greedy_batches(spark.createDataFrame(rows, "s int, id string, duration double"), c, mode=mode, stratum="s", size=size).collect()
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.Greedy(c, mode)) and len(got) == 700


def test_pairs_under_two_constraints(spark):
    rnd = random.Random(4)
    rows = [(0, f"i{k:04d}", rnd.uniform(1, 20), float(rnd.randint(5, 300))) for k in range(300)]
    a, b = B.Constraint(max_total=100.0), B.Constraint(max_total=900.0, concatenate=True)
    got = B.paired_batches(spark.createDataFrame(rows, "s int, id string, a double, b double"), a, b, "a", "b").collect()
    assert {(r.stratum, r.id): r.batch for r in got} == one_pass(rows, lambda: B.GreedyPairs(a, b))


def test_empty(spark):
    df = spark.createDataFrame([], "id string, duration double")
    assert B.greedy_batches(df, B.Constraint(max_total=1.0)).count() == 0
