from datetime import datetime

import pytest

from voxtile.llm import turns
from voxtile.llm.people import label_key

SUP = "id string, recording_id string, start double, text string, speaker string, language string, received_at timestamp, extra int"


def rows(*items):
    return [(i, r, s, t, p, "en", datetime(2031, 1, 1), 1) for i, r, s, t, p in items]


@pytest.fixture(scope="module")
def speakers(spark):
    return spark.createDataFrame([("spk00010001", "Risen Muporont", None), ("spk00010002", "Vanik Klemebrám", "male")], "speaker_id string, name string, gender string")


def test_spellings_have_one_key():
    assert {label_key(x) for x in ("spk00010001", "SPK 00010001 (ch1)", "Speaker 10001", "s#10001", "spk０００１０００１", " spk-10001:\t", "[S10001]")} == {"#10001"}
    assert {label_key(x) for x in ("Vanik Klemebrám", "KLEMEBRÁM, Vanik", "klemebram_vanik", "Dr. Vanik Klemebrám")} == {"n:vanik klemebram"}
    assert label_key("V. Klemebrám") == label_key("Klemebrám, V.") == "i:v klemebram"
    assert [label_key(x) for x in (None, "", " ", "n/a", "<unk>", "?", "crowd", "-")] == [None] * 8
    assert label_key("SPEAKER_00") == label_key("speaker_00 ") == "role:0"
    assert label_key("Agent:") == "role:agent"


def test_words_beside_notes_and_fillers():
    spoken = lambda t: turns.has_spoken_word(turns.clean(t))
    for t in ("uh... [laughter]", "Uhm,, (coughs)", "♪ humming ♪ *sighs*", "00:23:34,757 --> er", "えっと… 【笑】", "", "  ", "— @01:13", "((applause))"):
        assert not spoken(t), t
    for t in ("Okay (coughs) then.", "はいそうです", "(and so on)", "42", "э-э да"):
        assert spoken(t), t


def test_open_rules(spark, speakers):
    df = spark.createDataFrame(
        rows(
            ("a", "r", 1.0, "hello", None), ("b", "r", 2.0, "yes", "spk00010001"), ("c", "r", 3.0, "uh", "spk00010002"),
            ("d", "r", 4.0, "one", "unknown"), ("e", "r", 5.0, "[Speaker 10001] two", "?"), ("f", "r", 6.0, ">> V. Klemebrám: [00:01] three", None),
            ("g", "r", 7.0, "Note: four", None), ("h", "r", 7.0, "five", "Klemebrám, Vanik"), ("i", None, 1.0, "x", "a"), ("j", "r", None, "x", "a"),
            ("k", "q", 1.0, "agent words", "Agent"), ("l", "q", 2.0, "more words", "agent "), ("m", "r", 8.0, None, "spk00010001"),
        ),
        SUP,
    )
    got = {(r.recording_id, r.id) for r in turns.turn_openers(df.unionByName(df), speakers).collect()}
    assert got == {("r", "a"), ("r", "b"), ("r", "f"), ("q", "k")}


def test_chunks_change_nothing(spark, speakers):
    people = ["spk00010001", None, "spk00010002", "?"]
    df = spark.createDataFrame(rows(*[(f"i{k:03d}", f"r{k % 3}", float((k * 37) % 100), "word", people[(k * k) % 4]) for k in range(120)]), SUP)
    segs = turns.labelled_segments(df, speakers)
    one, many = ({(r.recording_id, r.id) for r in turns.mark_turns(segs, c).where("opens").collect()} for c in (10**9, 5_000))
    last, exp = {}, set()
    for r in sorted(segs.collect(), key=lambda r: (r.recording_id, r.start_ms, r.id)):
        if r.recording_id not in last or (r.person is not None and r.person != last[r.recording_id]):
            exp.add((r.recording_id, r.id))
        last[r.recording_id] = r.person if r.person is not None else last.get(r.recording_id)
    assert one == many == exp


def test_turn_text(spark, speakers):
    df = spark.createDataFrame(rows(("a", "r", 1.0, "spk00010001: Okay uh then.", None), ("b", "r", 2.0, "[laughter] more", None), ("c", "r", 3.0, "no", "V. Klemebrám")), SUP)
    got = [(r.person, r.text) for r in turns.turns(df, speakers).orderBy("start_ms").collect()]
    assert got == [("spk00010001", "Okay then. more"), ("spk00010002", "no")]


def test_empty(spark, speakers):
    assert turns.turn_openers(spark.createDataFrame([], SUP), speakers).count() == 0


def test_chunks_change_no_turn(spark, speakers):
    people = ["spk00010001", None, "spk00010002", None, None, None, "?"]
    said = [(f"i{k:03d}", f"r{k % 2}", float((k * 37) % 90), f"word{k}", people[(k * k) % 7] if k % 5 else None) for k in range(90)]
    df = spark.createDataFrame(rows(*said), SUP)
    exp = {}
    for i, r, start, text, p in sorted(said, key=lambda x: (x[1], x[2], x[0])):
        p = None if p == "?" else p
        of = exp.setdefault(r, [])
        if not of or (p is not None and p != of[-1][2]):
            of.append([int(start * 1000), i, p, 0, ""])
        of[-1][3:] = [of[-1][3] + 1, f"{of[-1][4]} {text}".strip()]
    exp = sorted((r, *turn) for r, of in exp.items() for turn in of)
    for chunk in (10**9, 20_000, 3_000):
        assert sorted(tuple(x) for x in turns.turns(df, speakers, chunk).collect()) == exp, chunk


def _layouts(df, speakers):
    return turns.told_layouts(turns.mine_layouts(df.withColumn("said", turns.label_key_udf("speaker")), turns.registry_keys(speakers)))


def test_layouts_are_mined_from_the_values(spark, speakers):
    said = [(f"a{k}", "r", float(k), f"Vanik Klemebrám | so it went on {k}", None) for k in range(6)]
    said += [(f"b{k}", "r", 60.0 + k, f"00:01:{k:02d} Risen Muporont: hello again", None) for k in range(6)]
    said += [(f"c{k}", "r", 100.0 + k, f"[Static hum] words {k}", "spk00010001") for k in range(6)]
    said += [(f"d{k}", "r", 200.0 + k, f"it took {k}.25 seconds", "spk00010001") for k in range(6)]
    kinds = _layouts(spark.createDataFrame(rows(*said), SUP), speakers).kinds
    assert kinds["none|word|2||"] == "speaker" and kinds["none|word|2|:"] == "speaker"
    assert kinds["|#:#:#|"] == "time" and kinds["|#.#|"] == "text" and kinds["[|word|2|]"] == "text"


def test_a_layout_takes_labels_that_the_registry_lacks(spark, speakers):
    said = [(f"a{k}", "r", float(k), "00:00:0%d Vanik Klemebrám: yes" % k, None) for k in range(8)]
    said += [("u", "r", 8.0, "00:00:08 Bob Jones: well then 00:00:09 Vanik Klemebrám: no", None), ("v", "r", 9.0, "Note: it ends", None), ("w", "r", 10.0, "[Static hum] more", None)]
    df = spark.createDataFrame(rows(*said), SUP)
    got = [(r.id, r.person, r.text) for r in turns.turns(df, speakers).orderBy("start_ms").collect()]
    assert got == [("a0", "spk00010002", " ".join(["yes"] * 8)), ("u", "n:bob jones", "well then no Note: it ends more")]


def test_what_the_leaves_hold_decides(spark, speakers):
    said = [("a", "r", 1.0, "Vanik Klemebrám: yes", None), ("b", "r", 2.0, "Risen Muporont: no", None), ("c", "r", 3.0, "[Green Hall] more", None), ("d", "r", 4.0, "Vanik Klemebrám: yes", None)]
    df = spark.createDataFrame(rows(*said), SUP)
    mined = _layouts(df, speakers)
    found = {}
    for kind in (None, "speaker", "text", "time"):
        forced = mined if kind is None else turns.Layouts({path: kind for path in mined.kinds})
        found[kind] = {r.id for r in turns.mark_turns(turns.labelled_segments(df, speakers, False, forced)).where("opens").collect()}
    assert found == {None: {"a", "b", "d"}, "speaker": {"a", "b", "c", "d"}, "text": {"a"}, "time": {"a"}}
