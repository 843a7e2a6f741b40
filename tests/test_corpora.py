"""Headers of other formats, and adapters of corpus layouts."""

import numpy as np

from voxtile.sources import audio, corpora, manifests


def flac(rate, samples, channels):
    bits = rate << 44 | (channels - 1) << 41 | 15 << 36 | samples
    return b"fLaC\x00\x00\x00\x22" + b"\x10\x00\x10\x00" + b"\x00" * 6 + bits.to_bytes(8, "big") + b"\x00" * 16


def sphere(x, rate, coding="pcm", width=2, order="01"):
    fields = f"sample_count -i {x.shape[1]}\nsample_rate -i {rate}\nchannel_count -i {x.shape[0]}\nsample_n_bytes -i {width}\nsample_byte_format -s{len(order)} {order}\nsample_coding -s{len(coding)} {coding}\nend_head\n"
    return ("NIST_1A\n   1024\n" + fields).encode().ljust(1024) + x.T.tobytes()


def test_headers():
    assert audio.probe(flac(16000, 123_456_789, 2)) == (16000, 123_456_789, 2)
    assert audio.probe(flac(44100, 5, 1)) == (44100, 5, 1)
    assert audio.probe(sphere(np.zeros((2, 30), "<i2"), 8000)) == (8000, 30, 2)
    assert audio.probe(audio.wav_bytes(np.zeros((1, 7)), 11025)) == (11025, 7, 1)


def test_sphere_samples():
    x = np.arange(-40, 40, dtype=np.int16).reshape(2, 40) * 100
    for order, kind in (("01", "<i2"), ("10", ">i2")):
        got, rate = audio.read_samples(sphere(x.astype(kind), 1000, order=order), 0.005, 0.01, [1])
        assert rate == 1000 and np.array_equal(got[0] * 32768, x[1, 5:15])
    coded = np.array([[0xFF, 0x7F, 0x80, 0x00, 0xF0]], dtype=np.uint8)
    got, _ = audio.read_samples(sphere(coded, 8000, "ulaw", 1))
    assert (got[0] * 32768).tolist() == [0, 0, 32124, -32124, 120]


def test_chapters(spark, tmp_path):
    folder = tmp_path / "part" / "12" / "34"
    folder.mkdir(parents=True)
    (folder / "12-34.trans.txt").write_text("12-34-0000 A FIRST LINE\n12-34-0001 THE SECOND\n12-34-0002 NO AUDIO\n")
    for k, n in enumerate((16000, 24000)):
        (folder / f"12-34-000{k}.flac").write_bytes(flac(16000, n, 1))
    (folder / "12-34-0009.flac").write_bytes(flac(16000, 10, 1))
    rec, seg = corpora.chapters(spark, str(tmp_path / "part"))
    assert sorted((r.id, r.num_samples, r.duration) for r in rec.collect()) == [("12-34-0000", 16000, 1.0), ("12-34-0001", 24000, 1.5)]
    assert sorted((r.id, r.speaker, r.text, r.duration) for r in seg.collect()) == [("12-34-0000", "12", "A FIRST LINE", 1.0), ("12-34-0001", "12", "THE SECOND", 1.5)]
    for _ in range(2):  # the second time it is there already
        assert corpora.prepared(rec, seg, str(tmp_path / "out"), "part").count() == 0
    assert manifests.read_manifest(spark, str(tmp_path / "out" / "part_supervisions"), "supervision").count() == 2


def test_clips(spark, tmp_path):
    (tmp_path / "train.tsv").write_text("client_id\tpath\tsentence\tgender\nc1\ta.mp3\tSay \"it\" \tmale\nc2\tb.mp3\tYes\t\nc3\tlost.mp3\tNo\t\n")
    (tmp_path / "clip_durations.tsv").write_text("clip\tduration[ms]\na.mp3\t1500\nb.mp3\t2000\n")
    rec, seg = corpora.clips(spark, str(tmp_path / "train.tsv"), "/clips", str(tmp_path / "clip_durations.tsv"), "en")
    assert sorted((r.id, r.sources[0].source, r.num_samples) for r in rec.collect()) == [("a", "/clips/a.mp3", 72000), ("b", "/clips/b.mp3", 96000)]
    assert sorted((r.id, r.text, r.speaker, r.gender, r.duration) for r in seg.collect()) == [("a", 'Say "it"', "c1", "male", 1.5), ("b", "Yes", "c2", None, 2.0)]


def test_meetings(spark, tmp_path):
    (tmp_path / "m1.wav").write_bytes(audio.wav_bytes(np.zeros((1, 16000)), 8000))
    (tmp_path / "m1.rttm").write_text("SPEAKER m1 0 0.500 1.000 <NA> <NA> anna <NA> <NA>\nSPEAKER m1 0 1.500 9.000 <NA> <NA> ben <NA> <NA>\nSPEAKER m2 0 0.5 1.0 <NA> <NA> x <NA> <NA>\n")
    _, seg = corpora.marked_meetings(spark, str(tmp_path), manifests.read_rttm(spark, [str(tmp_path / "m1.rttm")]))
    assert sorted((r.speaker, r.start, r.duration) for r in seg.collect()) == [("anna", 0.5, 1.0), ("ben", 1.5, 0.5)]
