from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtile.llm import pieces, splits

T0 = datetime(2031, 1, 1)
EDGES = "record string, entity string"
SUP = "id string, recording_id string, start double, duration double, text string, speaker string, language string, received_at timestamp"
AUDIO = "id string, sampling_rate int, num_samples long, duration double, received_at timestamp"


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        a, b = find(("r", r)), find(("e", e))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for r, _ in edges:
        groups.setdefault(find(("r", r)), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_long_chain_and_hub(spark):
    edges = [(f"r{k:03d}", f"p{j}") for k in range(60) for j in (k, k + 1)] + [(f"s{k:03d}", "hub") for k in range(40)] + [("lone", "x")]
    got = {r.record: r.label for r in splits.connected_groups(spark.createDataFrame(edges, EDGES)).collect()}
    assert got == components(edges)


def test_empty_graph(spark):
    assert splits.connected_groups(spark.createDataFrame([], EDGES)).count() == 0


def test_split_is_one_per_group(spark):
    people = spark.createDataFrame([(f"spk{k:08d}", f"First{k} Last{k}", None) for k in range(100, 400)], "speaker_id string, name string, gender string")
    rows = [(f"i{k}", f"r{k // 4}", 0.0, 1.0, "t", f"spk{100 + k // 7:08d}" if k % 3 else None, "en" if k % 2 else "de", T0) for k in range(1200)]
    sup = spark.createDataFrame(rows + rows[:50], SUP)
    out = splits.assign_splits(sup, people, {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()
    assert len(out) == 1200
    by_person = {}
    for r in out:
        by_person.setdefault(r.recording_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by_person.values())


def test_roles_and_nobody_link_nothing(spark):
    people = spark.createDataFrame([("spk00010001", "Risen Muporont", None)], "speaker_id string, name string, gender string")
    rows = [("a", "r1", 0.0, 1.0, "", "Agent", None, T0), ("b", "r2", 0.0, 1.0, "", "agent", None, T0), ("c", "r3", 0.0, 1.0, "", "?", None, T0), ("d", "r4", 0.0, 1.0, "", "?", None, T0), ("e", "r5", 0.0, 1.0, "", "R. Muporont", None, T0), ("f", "r6", 0.0, 1.0, "", "s#10001", None, T0)]
    edges = splits.record_entities(spark.createDataFrame(rows, SUP), people)
    pairs = splits.linked_pairs(splits.connected_groups(edges)).collect()
    assert [tuple(r) for r in pairs] == [("r5", "r6")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(1, 40_000)), max_size=40), st.integers(1, 260_000))
def test_pieces_cover_and_obey_the_limit(spans, end):
    segs = sorted((s, min(s + d, end)) for s, d in spans if s < end)
    covered = pieces.IntervalMap()
    for s, e in segs:
        covered.insert(s, e)
    edges = [(0, covered.starts[0]), *covered.gaps(), (covered.ends[-1], end)] if segs else [(0, end)]
    silent = [(a, b, (a % 7) / 7 if a % 3 else None) for a, b in edges if a < b]
    bounds = (covered.starts[0], covered.ends[-1]) if segs else (None, None)
    got, following = pieces.cut_section(0, end, end, silent, 30_000, 2_000, *bounds)
    assert following is None
    assert got[0][0] == 0 and got[-1][1] == end
    for a, b in zip(got, got[1:]):
        assert b[0] == a[1] - 2_000
    for s, e, how, *_ in got:
        assert 0 < e - s <= 30_000
        inside = any(x < e < y for x, y in zip(covered.starts, covered.ends))
        assert how == "end" or inside == (how == "speech")
        if how == "speech":  # no silence of the window was passed over
            free = covered.gaps() + [(0, covered.starts[0]), (covered.ends[-1], end)]
            assert not any(b > s + 2_000 and a <= s + 30_000 and b > a for a, b in free)


def test_stretches_are_told(spark):
    rows = [("a", "r", 0.0, 45.0, "x", None, None, T0), ("b", "r", 60.0, 5.0, "y", None, None, T0), ("c", "q", 0.0, 45.0, "x", None, None, T0), ("d", "z", 0.0, 99.0, "x", None, None, T0), ("e", "r", 44.0, -1.0, "", None, None, T0)]
    audio = [("r", 1000, 80_000, None, T0), ("q", 1000, 30_000, 99.0, T0), ("n", 1000, None, None, T0), ("o", 1000, 10_000, None, T0)]
    cut = pieces.pieces(spark.createDataFrame(rows * 2, SUP), spark.createDataFrame(audio, AUDIO), 30_000, 2_000)
    assert [tuple(r) for r in pieces.uncuttable(cut, 30_000).collect()] == [("r", 0)]
    assert {r.recording_id for r in cut.collect()} == {"r", "q", "o"}


def test_sections_change_no_piece(spark):
    rows = [(f"i{k}", "r", k * 11.0 % 5000, 7.0 + (k % 5) * 2, f"word{k % 11} word{k * k % 13}", None, None, T0) for k in range(400)]
    rows += [(f"j{k}", "q", 900.0 + 40 * k, 39.999 if k % 7 else 20.0, "x", None, None, T0) for k in range(60)]
    sup = spark.createDataFrame(rows, SUP)
    audio = spark.createDataFrame([("r", 1000, 5_100_000, None, T0), ("q", 1000, 3_400_500, None, T0), ("z", 1000, 90_000, None, T0)], AUDIO)
    of = lambda s: sorted(tuple(r)[:1] + tuple(r)[2:] for r in pieces.pieces(sup, audio, 30_000, 2_000, s).collect())
    a, b = of(3_600_000), of(200_000)
    assert a == b and len(a) > 300
    # as one pass over each recording gives them
    spans = pieces.segment_spans(sup, ["text"])
    gaps = {}
    for g in pieces.similar_silences(pieces.placed_spans(spans)).collect():
        gaps.setdefault(g.recording_id, []).append((g.gap_start, g.gap_end, g.similar))
    bounds = {r.recording_id: (r.a, r.b) for r in spans.groupBy("recording_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).collect()}
    for rec, end in (("r", 5_100_000.0), ("q", 3_400_500.0)):
        lo, hi = bounds[rec]
        silent = sorted(x for x in [(0, lo, None), *gaps[rec], (hi, end, None)] if x[0] < min(x[1], end))
        got, _ = pieces.cut_section(0.0, end, end, [(s, min(e, end), v) for s, e, v in silent], 30_000, 2_000, lo, hi)
        assert [x[1:3] for x in a if x[0] == rec] == [x[:2] for x in got]


def test_unbroken_speech_takes_few_rounds(spark, monkeypatch):
    made = []

    def counted(df, plain=pieces.checkpointed):
        made.append(df)
        assert len(made) <= 14, "the rounds grow with the number of sections"
        return plain(df)

    monkeypatch.setattr(pieces, "checkpointed", counted)
    # 40 sections each: unbroken speech, no segment, speech with silences in the middle only, and silences after both
    spans = {"a": [(0, 2400)], "b": [], "c": [(0, 900)] + [(900 + 11 * k, 7 + k % 3) for k in range(60)] + [(1600, 800)], "d": [(40, 700), (1500, 300)] + [(2000 + 13 * k, 9) for k in range(20)]}
    rows = [(f"{r}{k}", r, float(s), float(d), f"word{k % 5} word{k % 7}", None, None, T0) for r, x in spans.items() for k, (s, d) in enumerate(x)]
    end = 2_399_500.0
    cut = pieces.pieces(spark.createDataFrame(rows, SUP), spark.createDataFrame([(r, 1000, int(end), None, T0) for r in spans], AUDIO), 30_000, 2_000, 60_000)
    got = {}
    for p in cut.collect():
        got.setdefault(p.recording_id, []).append((p.start_ms, p.end_ms, p.how, p.stretch_start_ms, p.stretch_ms))
    gaps = {}
    for g in pieces.similar_silences(pieces.placed_spans(pieces.segment_spans(spark.createDataFrame(rows, SUP), ["text"]))).collect():
        gaps.setdefault(g.recording_id, []).append((float(g.gap_start), float(g.gap_end), g.similar))
    for r, x in spans.items():
        lo, hi = (1000.0 * min(s for s, _ in x), 1000.0 * max(s + d for s, d in x)) if x else (None, None)
        edges = [(0.0, lo, None), (hi, end, None)] if x else [(0.0, end, None)]
        silent = sorted((s, min(e, end), v) for s, e, v in [*edges, *gaps.get(r, [])] if s < min(e, end))
        want, _ = pieces.cut_section(0.0, end, end, silent, 30_000, 2_000, lo, hi)
        assert sorted(got[r]) == [(s, e, how, a, n) for s, e, how, _, a, n in want]


def test_chunks_change_no_similarity(spark):
    rows = [(f"i{k:03d}", f"r{k % 2}", k * 7.3 % 900, 1.0 + k % 3, f"word{k % 5} word{k % 7}" if k % 6 else None, None, None, T0) for k in range(200)]
    spans = pieces.segment_spans(spark.createDataFrame(rows, SUP), ["text"])
    one, many = (sorted((r.recording_id, r.gap_start, r.gap_end, -1 if r.similar is None else round(r.similar, 9)) for r in pieces.similar_silences(pieces.placed_spans(spans, c)).collect()) for c in (10**9, 9_000))
    assert one == many and len(one) > 100


def test_no_words_are_no_valley():
    assert pieces._similarity([frozenset()], [frozenset(["a"])]) is None
    assert pieces.valley_depths([0.5, None, 0.5]) == [0.0, 0.0, 0.0]
    assert pieces.valley_depths([0.9, None, 0.1, 0.5]) == pytest.approx([0.0, 0.0, 1.2, 0.0])
    # among like neighbours the stretch that nobody transcribed does not win
    gaps = [(float(t), t + 100.0, None if t == 20_000 else 0.4 if t != 24_000 else 0.1) for t in range(16_000, 30_000, 2_000)]
    assert pieces.cut_section(0.0, 1.0, 90_000.0, gaps, 30_000, 2_000)[0][0][1] == 24_100.0


def test_shares_hold_for_every_language(spark):
    people = spark.createDataFrame([(f"spk{k:08d}", f"First{k} Last{k}", None) for k in range(100, 500)], "speaker_id string, name string, gender string")
    codes = ["en", "EN-us", "eng", "de", "deu", "klingon", None]
    rows = [(f"i{k}", f"r{k // 3}", 0.0, 1.0, "t", f"spk{100 + (k * k) % 397:08d}" if k % 40 == 0 else None, codes[(k // 3) % 7], T0) for k in range(6000)]
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    out = splits.assign_splits(spark.createDataFrame(rows, SUP), people, shares)
    worst = {r.language: r.w for r in splits.split_deviation(out, shares).groupBy("language").agg(F.max(F.abs("points")).alias("w")).collect()}
    assert set(worst) == {"en", "de", "?"} and max(worst.values()) <= 1.0


def test_pairs_of_a_group_come_block_by_block(spark):
    groups = spark.createDataFrame([(f"r{k:02d}", "r00" if k < 30 else f"r{30 + (k - 30) // 2 * 2:02d}") for k in range(40)], "record string, label string")
    got = [tuple(r) for r in splits.linked_pairs(groups, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"r{i:02d}", f"r{j:02d}") for i in range(40) for j in range(i + 1, 40) if j < 30 or (i >= 30 and (i - 30) // 2 == (j - 30) // 2)}


def test_a_superseded_delivery_links_nothing(spark):
    people = spark.createDataFrame([("spk00010001", "Risen Muporont", None)], "speaker_id string, name string, gender string")
    rows = [("a", "r1", 0.0, 1.0, "t", "spk00010001", "en", T0), ("b", "r2", 0.0, 1.0, "t", "Agent", "en", T0), ("b", "r2", None, 1.0, None, "spk00010001", "en", T0)]
    edges = splits.record_entities(spark.createDataFrame(rows, SUP), people)
    assert [tuple(r) for r in edges.collect()] == [("r1", "spk00010001")]
