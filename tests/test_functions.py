import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtile.functions import signal as S
from voxtile.functions import text as T
from voxtile.functions import timeops as O


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# Windows of a signal for (length, window, hop).
WINDOWS = [((1, 6.1, 3), 1), ((3, 1, 6.1), 1), ((3, 6.1, 1), 1), ((5.9, 1, 3), 2), ((5.9, 3, 1), 4), ((6.1, 1, 3), 3), ((6.1, 3, 1), 5), ((5.9, 3, 3), 2), ((6.1, 3, 3), 3), ((0, 3, 3), 0)]


def test_window_counts(spark):
    got = spark.createDataFrame([tuple(float(x) for x in w) for w, _ in WINDOWS], "a double, b double, c double").select(O.window_count("a", "b", "c").alias("n")).collect()
    assert [r.n for r in got] == [n for _, n in WINDOWS]


def test_samples_and_frames(spark):
    assert value(spark, O.num_samples(0.5 + 1 / 32000, 16000)) == 8001
    assert value(spark, O.perturbed_samples(F.lit(1000), 1.1)) == 909
    assert value(spark, O.num_frames(16.04, 0.01, 16000)) == 1604
    assert value(spark, O.frames_of_samples(F.lit(256640), 0.01, 16000)) == 1604
    assert abs(value(spark, O.added_durations(F.lit(16000), F.lit(7.06), F.lit(-0.94))) - 6.12) < 1e-12
    assert value(spark, O.temporal_frames(1.0, 0.1, 9)) == 9
    assert value(spark, O.hms_to_seconds(F.lit("01:02:03.5"))) == 3723.5
    assert value(spark, O.time_diff_frames(1.0, 0.025, 0.01)) == math.ceil((1.0 - 0.025) / 0.01)


def test_spans(spark):
    assert value(spark, O.overlaps(0.0, 1.0, 1.0, 2.0)) is False
    assert value(spark, O.overlaps(0.0, 1.1, 1.0, 2.0)) is True
    assert value(spark, O.overspans(0.0, 1.0, -0.0005, 1.0005)) is True
    a, d = O.extended_span(F.lit(1.0), F.lit(2.0), F.lit(6.0))
    assert (value(spark, a), value(spark, d)) == (0.0, 5.0)
    a, d = O.extended_span(F.lit(5.0), F.lit(2.0), F.lit(6.0), "right")
    assert (value(spark, a), value(spark, d)) == (5.0, 6.0)
    with pytest.raises(ValueError):
        O.extended_span(F.lit(1.0), F.lit(2.0), F.lit(6.0), "up")


def test_hashes(spark):
    import hashlib

    assert value(spark, O.hash_str_to_int(F.lit("abc"), 1000003)) == int(hashlib.sha1(b"abc").hexdigest(), 16) % 1000003
    assert 0 < value(spark, O.uniform(F.lit("x"), 4)) < 1


def test_normalisers(spark):
    assert value(spark, T.ami(F.lit("Mm-hmm, o k; don't"), "kaldi")) == "MM-HMM OK DON'T"
    assert value(spark, T.alimeeting(F.lit("<sil>你好，abＡ。"))) == "你好ABA"
    assert value(spark, T.chime6(F.lit("Hello, [inaudible 1:2] - mm-hm!"), "kaldi")) == "hello [inaudible] mmhm"
    assert value(spark, T.chime6(F.lit("x [redacted] y"), "kaldi")) == ""
    assert value(spark, T.tedlium(F.lit("[NOISE] they 're <unk>in ' cause"), "kaldi")) == "they're in 'cause"
    assert value(spark, T.merged_with_delimiter(F.array(F.lit("a"), F.lit("b")))) == "cat#a#b"
    assert value(spark, T.merged_with_delimiter(F.array(F.lit("a")))) == "a"


def test_features_of_a_tone():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    o = S.FrameOptions()
    m = S.fbank(x, o)
    assert m.shape == (100, 80)
    centre = np.linspace(S.mel(20), S.mel(7600), 82)[1:-1]
    assert abs(centre[int(m.mean(axis=0).argmax())] - S.mel(1000)) < 40
    assert S.mfcc(x).shape == (100, 13)
    assert S.spectrogram(x).shape == (100, 257)
    assert S.frames_of(x, S.FrameOptions(snip_edges=True)).shape == (98, 400)
    assert S.fbank(np.zeros(0)).shape[0] == 0


def test_mixing_reaches_the_snr():
    g = np.random.default_rng(1)
    a, b = g.normal(size=8000), 3 * g.normal(size=4000)
    mixed = S.mix_signals([a, b], [0, 2000], [None, 10.0])
    added = mixed[2000:6000] - a[2000:6000]
    assert abs(10 * np.log10(np.mean(a**2) / np.mean(added**2)) - 10) < 1e-6
    f = S.mix_features(np.zeros((4, 2)), np.zeros((3, 2)), 2, 0.0)
    assert f.shape == (5, 2) and f[0, 0] == 0.0 and f[2, 0] > 0


def test_transforms_keep_their_promises():
    x = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)
    assert len(S.speed(x, 1.1)) == round(8000 / 1.1)
    assert abs(np.abs(np.fft.rfft(S.speed(x, 2.0))).argmax() - 200) <= 1
    assert len(S.tempo(x, 0.9)) == round(8000 / 0.9)
    assert np.abs(S.clipped(x, 20, hard=True)).max() <= 1
    assert np.abs(S.narrowband(x) - x).max() < 0.05
    assert np.abs(S.lowpass_by_resampling(x, 0.5)[500:-500] - x[500:-500]).max() < 0.02
    assert abs(np.sqrt(np.mean(S.loudness_normalised(x, -20.0) ** 2)) - 0.1) < 1e-9
    y = S.reverberated(x, S.random_impulse("k", 1, 8000, 0.1))
    assert len(y) == len(x) and abs(np.mean(y**2) - np.mean(x**2)) < 1e-6


def test_masks_are_bounded_and_repeatable(spark):
    m = np.random.default_rng(0).normal(size=(300, 40)).astype(np.float32)
    a, b = (S.spec_masked(m, S.rng_for("k", 3), time_size=20, warp=None) for _ in range(2))
    assert np.array_equal(a, b) and a.shape == m.shape
    assert (np.abs(a - m).max(axis=1) > 0).sum() <= 300
    df = spark.createDataFrame([("a", [1.0, -1.0] * 200)], "id string, samples array<float>")
    row = S.transform(S.extract(df, "samples", "mfcc"), "samples", "volume", factor=0.5).first()
    assert row.samples[0] == 0.5 and len(row.features[0]) == 13
    assert S.spec_augment(S.extract(df, "samples"), "features", warp=None).first().features is not None
    assert len(S.mix_rows(df.withColumn("b", F.col("samples")), "samples", "b", 10, 5.0).first().mixed) == 410


def test_schedule_and_masks(spark):
    assert value(spark, S.scheduled(F.lit(5), {0: 0.1, 4: 0.2, 9: 0.3})) == 0.2
    assert value(spark, S.length_mask(F.lit(2), F.lit(3))) == [True, True, False]
    assert value(spark, F.size(S.padded(F.array(F.lit(1.0).cast("float")), F.lit(4)))) == 4
    assert value(spark, S.sliced(F.array(*[F.lit(float(i)) for i in range(10)]), F.lit(0.2), 0.1, F.lit(0.3))) == [2.0, 3.0, 4.0]


def test_characters_of_repeated_and_null_keys(spark):
    rows = [("a", "aba"), ("a", "aba"), ("a", "bc"), (None, "cab"), ("b", ""), ("c", None), ("d", "axa")]
    df = spark.createDataFrame(rows, "id string, text string")
    vocab = T.vocabulary(spark.createDataFrame([("abc",)], "text string"), "text")
    got = sorted(((r.id, r.ids) for r in T.encoded_characters(df, "text", vocab).collect()), key=repr)
    of = {"a": 4, "b": 5, "c": 6}
    assert got == sorted(((i, [2, *[of.get(c, 1) for c in t], 3]) for i, t in rows if t is not None), key=repr)
