"""Clashing extra columns, nulls anywhere, repeated rows and empty tables, for every problem's operator."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtile.llm import packing, pieces, sentences, splits, tokens, turns

T0 = datetime(2031, 1, 1)
CLASH = ["chunk", "key", "path", "hour", "person", "label", "k", "n", "part", "start_ms", "end_ms", "said", "head", "words", "opens", "section_ms", "shard", "size", "record", "entity", "carry", "doc", "number"]
SUP = "id string, recording_id string, start double, duration double, channel array<int>, text string, language string, speaker string, gender string, received_at timestamp"


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module")
def tables(spark):
    full = ("a", "r", 0.0, 40.0, [0], "hello there", "en", "spk00010001", "f", T0)
    rows = [full, full, ("b", "q", 1.0, 2.0, [0], "[agent] word", "en", None, None, T0), ("c", "r", 50.0, 1.0, None, "more", None, "Speaker 10001", None, T0)]
    rows += [tuple(None if i == j else v for j, v in enumerate(full[:-1])) + (T0,) for i in range(9)]  # each column null once
    rows += [("z", "r", float("nan"), float("inf"), [], "", "", "", "", T0)]
    sup = spark.createDataFrame(rows, SUP)
    people = spark.createDataFrame([("spk00010001", "Risen Muporont", "f"), ("spk00010002", None, None), (None, "Nobody Known", None)], "speaker_id string, name string, gender string")
    audio = spark.createDataFrame([("r", 1000, 60_000, 60.0, None, T0), ("q", None, None, 9.0, [], T0), (None, 1, 1, 1.0, None, T0), ("w", 8000, None, None, None, T0)], "id string, sampling_rate int, num_samples long, duration double, sources array<struct<type:string,channels:array<int>,source:string>>, received_at timestamp")
    docs = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, "x " * 5000), (None, "Three.")], "doc_id long, text string")
    return {"sup": sup, "people": people, "audio": audio, "docs": docs}


@pytest.fixture(params=["clash", "empty"])
def given(tables, request):
    return {k: clashing(v if request.param == "clash" else v.limit(0)) for k, v in tables.items()}, request.param == "empty"


def test_turns(given):
    t, empty = given
    got = {(r.recording_id, r.id) for r in turns.turn_openers(t["sup"], t["people"]).collect()}
    assert got == (set() if empty else {("r", "a"), ("q", "b")})
    assert turns.turns(t["sup"], t["people"]).count() == (0 if empty else 2)


def test_groups_and_splits(given):
    t, empty = given
    groups = splits.connected_groups(splits.record_entities(t["sup"], t["people"]))
    assert splits.linked_pairs(groups).count() == 0
    out = splits.assign_splits(t["sup"], t["people"], {"train": 0.8, "valid": 0.1, "test": 0.1})
    assert {r.id for r in out.collect()} == (set() if empty else {"a", "b", "c", "z"})


def test_pieces(given):
    t, empty = given
    cut = pieces.pieces(t["sup"], t["audio"], 30_000, 2_000)
    assert {tuple(r) for r in pieces.uncuttable(cut, 30_000).collect()} == (set() if empty else {("r", 0)})


def test_texts(given):
    t, empty = given
    starts = sorted(tuple(r) for r in sentences.sentences(t["docs"]).where("doc_id = 1").select("doc_id", "start_char").collect())
    assert starts == ([] if empty else [(1, 0), (1, 0), (1, 5), (1, 5)])
    assert tokens.encode(t["docs"]).count() == (0 if empty else 6)
    packed = packing.pack(t["docs"], 2048)
    assert packed.select("doc_id").distinct().count() == (0 if empty else 5)
    assert {r.doc_id for r in packing.oversized(packed).collect()} == (set() if empty else {4})
