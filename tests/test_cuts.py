import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtile.operators import batching, cuts, dataset, joins, meetings, stats, task_batches

SUP = "struct<id:string,recording_id:string,start:double,duration:double,channel:array<int>,text:string,speaker:string>"
CUT = f"id string, start double, duration double, channel int, supervisions array<{SUP}>, features struct<frame_shift:double,num_frames:int>, recording struct<id:string,sampling_rate:int,duration:double>, custom map<string,string>"


def seg(i, s, d, text="t", who="a"):
    return (i, "r", s, d, [0], text, who)


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        ("c1", 5.0, 10.0, 0, [seg("s1", 0.0, 3.37), seg("s2", 3.0, 1.0, "u", "b"), seg("s3", 5.5, 2.0)], (0.01, 1000), ("r", 16000, 16.0), {"k": "v"}),
        ("c2", 0.0, 95.0, 0, [], None, ("q", 16000, 95.0), None),
        ("c3", 0.0, 4.0, 1, [seg("s4", 3.5, 2.0)], None, None, None),
    ]
    return spark.createDataFrame(rows, CUT)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_truncate_rebases_and_clips(some):
    got = by_id(cuts.truncate(some, 3.0, 100.0, preserve_id=True))
    assert (got["c1"].start, got["c1"].duration) == (8.0, 7.0)
    assert [(s.id, s.start) for s in got["c1"].supervisions] == [("s1", -3.0), ("s2", 0.0), ("s3", 2.5)]
    kept = by_id(cuts.truncate(some, 3.0, 100.0, keep_excessive=False, preserve_id=True))
    assert [s.id for s in kept["c1"].supervisions] == ["s2", "s3"]
    assert "c3" in got and got["c3"].duration == 1.0


def test_windows_cover_the_cut(some):
    got = [r for r in cuts.cut_into_windows(some, 3.0).orderBy("start").collect() if r.id.startswith("c1-")]
    assert [r.duration for r in got] == [3.0, 3.0, 3.0, 1.0] and sum(r.duration for r in got) == 10.0
    wide = [(r.start, r.start + r.duration) for r in cuts.cut_into_windows_balanced(some.where("id = 'c2'"), 30, 40, 1.0).orderBy("start").collect()]
    assert wide == [(0.0, 33.0), (32.0, 65.0), (64.0, 95.0)]


def test_groups_and_gaps(some):
    got = [r for r in cuts.trim_to_supervision_groups(some, 0.1).collect() if r.id.startswith("c1-")]
    assert sorted(r.duration for r in got) == [2.0, 4.0]
    assert len([r for r in cuts.trim_to_supervision_groups(some, 1.5).collect() if r.id.startswith("c1-")]) == 1
    gaps = sorted((r.start, r.duration) for r in cuts.trim_to_unsupervised(some).collect() if r.id.startswith("c1"))
    assert gaps == [(9.0, 1.5), (12.5, 2.5)]


def test_trim_takes_the_segment_id(some):
    got = by_id(cuts.trim_to_supervisions(some, keep_overlapping=False))
    assert set(got) == {"s1", "s2", "s3", "s4"} and got["s4"].duration == 0.5
    wide = by_id(cuts.trim_to_supervisions(some.where("id = 'c1'"), False, min_duration=4.0))
    assert (wide["s3"].start, wide["s3"].duration) == (9.5, 4.0)
    assert (wide["s1"].start, round(wide["s1"].duration, 3)) == (5.0, 3.685)


def test_speaker_counts_sum_to_the_span(some):
    r = by_id(stats.speech_durations(some, full=True))["c1"]
    assert (r.speech_us, r.overlap_us, r.single_us) == (6_000_000, 370_000, 5_630_000)
    total = stats.describe_speech(some).first()
    assert total.silence_us + total.speech_us == total.duration_us


def test_merge_fill_extend_pad(some):
    m = by_id(cuts.merge_supervisions(some))["c1"].supervisions
    assert len(m) == 1 and m[0].id == "cat#s1#s2#s3" and m[0].text == "t u t" and m[0].duration == 7.5
    with pytest.raises(Exception, match="several segments"):
        cuts.fill_supervisions(some.where("id = 'c1'")).collect()
    with pytest.raises(Exception, match="would shrink"):
        cuts.fill_supervisions(some.where("id = 'c3'")).collect()
    assert by_id(cuts.fill_supervisions(some.where("id <> 'c1'"), shrink_ok=True))["c2"].supervisions[0].duration == 95.0
    e = by_id(cuts.extend_by(some, 6.0))["c1"]
    assert (e.start, e.duration, e.pad_left, e.pad_right) == (0.0, 16.0, 1.0, 5.0) and e.supervisions[0].start == 5.0
    p = by_id(cuts.pad(some, 12.0, "both"))["c1"]
    assert (p.duration, p.pad_left, p.pad_right, p.supervisions[0].start) == (12.0, 1.0, 1.0, 1.0)


def test_perturbation_and_ids(some):
    r = by_id(cuts.perturb_speed(some, 1.1))["c1_sp1.1"]
    assert r.recording.id == "r_sp1.1" and r.features is None and abs(r.duration - 10 / 1.1) < 1e-4
    assert by_id(cuts.affixed(some, "_rvb"))["c1_rvb"].supervisions[0].id == "s1_rvb"
    assert by_id(cuts.with_custom(some, "k", None))["c1"].custom == {}
    assert by_id(cuts.with_custom(some, "n", F.lit(3)))["c2"].custom == {"n": "3"}


def test_mix_append_unmix(some):
    m = cuts.mix(some.where("id = 'c1'").withColumn("k", F.lit(1)), some.where("id = 'c3'").withColumn("k", F.lit(1)), "k", 8.0, 10.0)
    r = m.select("duration", cuts.mixed_supervisions(F.col("tracks")).alias("s")).first()
    assert r.duration == 12.0 and [x.start for x in r.s] == [0.0, 3.0, 5.5, 11.5]
    a = cuts.append_all(some.withColumn("g", F.lit(0)), "g", "id").first()
    assert a.duration == 109.0 and [t.offset for t in a.tracks] == [0.0, 10.0, 105.0]
    assert cuts.unmix(m).count() == 2
    f = cuts.perturb_mixed(m, 2.0, 16000).first()
    assert f.duration == 6.0 and f.id.endswith("_sp2") and [t.offset for t in f.tracks] == [0.0, 4.0] and f.tracks[1].cut.supervisions[0].start == 1.75
    g = cuts.map_mixed_supervisions(m, lambda s: s.withField("text", F.upper(s["text"]))).first()
    assert g.tracks[0].cut.supervisions[0].text == "T"
    assert cuts.filter_mixed_supervisions(m, lambda s: s["speaker"] == "b").select(F.size(cuts.mixed_supervisions(F.col("tracks")))).first()[0] == 1


def test_frames(some):
    m = by_id(some.select("id", cuts.frame_mask(some, 0.01).alias("m")))
    assert sum(m["c1"].m) == 600 and len(m["c1"].m) == 1000
    f = {r.sup_id: (r.first_frame, r.n_frames) for r in cuts.supervision_frames(some, 0.01).collect()}
    assert f["s2"] == (300, 100)


def test_alignment_groups(spark):
    items = [("a", 0.0, 0.4), ("", 0.4, 0.1), ("b", 0.6, 0.3), ("c", 3.0, 0.2)]
    df = spark.createDataFrame([([dict(symbol=s, start=a, duration=d) for s, a, d in items],)], "items array<struct<symbol:string,start:double,duration:double>>")
    got = df.select(cuts.alignment_groups(F.col("items"), 0.5, 10.0).alias("g")).first().g
    assert [(g.start, g.end, list(g.symbols)) for g in got] == [(0.0, 0.9, ["a", "b"]), (3.0, 3.2, ["c"])]


# ---- dataset, batches, joins -------------------------------------------------------------------------------------


def test_positions_and_running_sums(spark):
    rows = [(f"i{k:04d}", k % 7) for k in random.Random(2).sample(range(3000), 3000)]
    df = dataset.with_position(spark.createDataFrame(rows, "id string, v int").repartition(5), "id")
    got = dataset.running_sum(df, "v", block=100).orderBy("_pos").collect()
    total = 0
    for p, r in enumerate(got):
        assert r._pos == p and r._cum == total and r.id == f"i{p:04d}"
        total += r.v
    assert dataset.with_position(df.limit(0).drop("_pos"), "id").count() == 0


def test_splits_differ_by_one(spark):
    df = spark.range(23).withColumn("id", F.format_string("%03d", "id"))
    sizes = [r["count"] for r in dataset.split(df, 4, "id").groupBy("part").count().orderBy("part").collect()]
    assert sizes == [6, 6, 6, 5]
    assert dataset.split(df, 4, "id", drop_last=True).count() == 20
    with pytest.raises(ValueError):
        dataset.split(df, 24, "id")
    shares = [{r.id for r in dataset.partition_rank(df, k, 3, "id").collect()} for k in range(3)]
    assert len(set.union(*shares)) == 23 == sum(map(len, shares))


@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_permutation_is_a_bijection(n, seed):
    import numpy as np

    assert sorted(dataset.feistel(n, seed)(np.arange(n)).tolist()) == list(range(n))


def test_mux_keeps_order_and_weights(spark):
    a, b = (spark.range(400).select(F.format_string(f"{c}%04d", "id").alias("id")) for c in "ab")
    got = [r.id for r in dataset.mux([a, b], [0.8, 0.2], seed=3).collect()]
    assert [x for x in got if x[0] == "a"] == sorted(x for x in got if x[0] == "a") and len(got) == 800
    first = got[:200]
    assert 0.65 < sum(x[0] == "a" for x in first) / 200 < 0.95
    assert len(dataset.mux([a, b], [0.8, 0.2], seed=3, stop_early=True).collect()) < 800


def test_bins_and_buckets(spark):
    rows = lambda xs: spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(xs)], "id string, duration double")
    assert batching.duration_bins(rows([1] * 5 + [2] * 5), 2) == [2.0]
    assert batching.duration_bins(rows([x for x in (1, 2, 3, 4) for _ in range(5)]), 4) == [2.0, 3.0, 4.0]
    b = rows([1, 2, 3, 4, 5]).select(batching.bucket_of(F.col("duration"), [2, 4]).alias("b")).collect()
    assert [r.b for r in b] == [0, 0, 1, 1, 2]
    f = batching.fixed_size_batches(rows([1, 1, 1, 3, 3]), [2.0, 4.0], [2, 1]).orderBy("id").collect()
    assert [(r.bucket, r.batch) for r in f] == [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(Exception, match="longer than the last"):
        batching.fixed_size_batches(rows([9]), [2.0], [1]).collect()


def fold(sizes, limit, mode):
    out, batch, cur = [], 0, []
    for s in sizes:
        if mode == "simple" and cur and (len(cur) + 1) * max(*cur, s) > limit:
            batch, cur = batch + 1, []
        cur.append(s)
        out.append(batch)
        if mode == "dynamic" and (len(cur) + 1) * max(cur) > limit:
            batch, cur = batch + 1, []
    return out


@pytest.mark.parametrize("mode", ["simple", "dynamic"])
def test_greedy_against_a_fold(spark, mode):
    sizes = [random.Random(4).randint(1, 30) + 0.5 for _ in range(1)] + [(k * 37) % 29 + 1.0 for k in range(500)]
    df = spark.createDataFrame([(f"{i:05d}", s) for i, s in enumerate(sizes)], "id string, duration double")
    got = [r.batch for r in batching.greedy_batches(df, batching.Constraint(max_total=100.0), mode=mode).orderBy("id").collect()]
    assert got == fold(sizes, 100.0, mode)
    c = batching.Constraint(max_total=100.0, quadratic=10.0)
    assert c.size(10.0) == 20.0


def test_ranks_and_tail(spark):
    df = spark.createDataFrame([(f"{i:03d}", i // 4) for i in range(38)], "id string, batch long")
    got = batching.spread_tail(df, 4)
    assert got.count() == 38 and {r["rank"] for r in got.where("step = 2").collect()} == {0, 1, 2, 3}
    assert batching.spread_tail(df, 4, drop_last=True).count() == 32
    assert batching.zip_batches([df, df.where("batch < 3")]).where("batch > 2").count() == 0


def test_packing_into_rows(spark):
    df = spark.createDataFrame([(0, "a", 10.0), (0, "b", 4.0), (0, "c", 4.0), (0, "d", 9.5)], "batch long, id string, duration double")
    got = {r.id: (r.row, r.offset) for r in batching.concat_in_batches(df, 1.0).collect()}
    assert got == {"a": (0, 0.0), "d": (1, 0.0), "b": (2, 0.0), "c": (2, 5.0)}


def test_range_joins_by_brute_force(spark):
    g = random.Random(8)
    a = [(f"a{k}", "r" if k % 3 else "q", (s := g.uniform(0, 300)), s + g.uniform(0, 90)) for k in range(120)]
    b = [(f"b{k}", "r" if k % 2 else "q", (s := g.uniform(0, 300)), s + g.uniform(0, 200)) for k in range(120)]
    left = spark.createDataFrame(a, "x string, k string, l_start double, l_end double")
    right = spark.createDataFrame(b, "y string, k string, r_start double, r_end double")
    got = [(r.x, r.y) for r in joins.overlap_join(left, right, ["k"], 20.0).collect()]
    assert sorted(got) == sorted((x, y) for x, k, s, e in a for y, k2, s2, e2 in b if k == k2 and s < e2 and s2 < e)
    inner = left.toDF("x", "k", "i_start", "i_end")
    outer = right.toDF("y", "k", "o_start", "o_end")
    held = [(r.x, r.y) for r in joins.containment_join(inner, outer, ["k"], 0.001, 20.0).collect()]
    assert sorted(held) == sorted((x, y) for x, k, s, e in a for y, k2, s2, e2 in b if k == k2 and s >= s2 - 0.001 and e <= e2 + 0.001)


def test_percentiles(spark):
    import numpy as np

    xs = [float((k * 7919) % 1000) / 7 for k in range(777)]
    got = stats.exact_percentiles(spark.createDataFrame([(x,) for x in xs], "v double"), "v")
    for p, v in got.items():
        assert abs(v - np.percentile(xs, p)) < 1e-9
    assert stats.exact_percentiles(spark.createDataFrame([], "v double"), "v") == {}


def test_meetings(spark):
    rows = [(f"u{k:03d}", f"s{k % 12}", 1.0 + k % 5) for k in range(200)]
    chosen = meetings.sampled(spark.createDataFrame(rows, "id string, speaker string, duration double"), 4, 2, 15.0)
    per = {}
    for r in chosen.collect():
        per.setdefault(r.meeting, {}).setdefault(r.speaker, 0.0)
        per[r.meeting][r.speaker] += r.duration
    assert all(len(v) <= 2 and max(v.values()) <= 15.0 for v in per.values())
    for out in (meetings.independent(chosen), meetings.conversational(chosen)):
        spans = {}
        for r in out.collect():
            spans.setdefault((r.meeting, r.speaker), []).append((r.start, r.start + r.duration))
        for v in spans.values():
            v.sort()
            assert all(x[1] <= y[0] + 1e-3 for x, y in zip(v, v[1:]))


def test_task_batches(some, spark):
    b = spark.createDataFrame([("c1", 0), ("c3", 0), ("c2", 1)], "id string, batch long")
    r = {x.batch: x for x in task_batches.recognition(some, b).collect()}
    assert r[0].cut_ids == ["c1", "c3"] and list(r[0].texts) == ["t", "u", "t", "t"] and r[0].intervals[3].sequence == 1
    assert task_batches.voice_activity(some, b).count() == 2 and task_batches.unsupervised(some, b).count() == 2
    assert {x.batch: x.speakers for x in task_batches.diarisation(some, b).collect()}[0] == [["a", "b"], ["a"]]
    assert task_batches.synthesis(some, b).first().cut_ids == ["c3"]
    assert task_batches.tagging(some, b, "k").where("batch = 0").first().tags == ["v", None]


def test_no_segments_stay_none_when_ends_are_clipped(spark):
    from voxtile.operators import cuts as C

    schema = "id string, supervisions array<struct<id:string,start:double,duration:double>>"
    df = spark.createDataFrame([("a", []), ("b", [("x", 0.0, 5.0), ("y", 2.0, 1.0)]), ("c", None)], schema)
    got = {r.id: None if r.s is None else [(x.id, x.duration) for x in r.s] for r in df.select("id", C.next_start_clipped().alias("s")).collect()}
    assert got == {"a": [], "b": [("x", 2.0), ("y", 1.0)], "c": None}
