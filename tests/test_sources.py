import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtile import cli
from voxtile.operators import qa
from voxtile.plans.sets import CutSet, RecordingSet, SupervisionSet
from voxtile.sources import archives, audio, manifests
from voxtile.streaming import batches, coverage, sessions


def jsonl(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return str(path)


def test_manifest_round_trip(spark, tmp_path):
    rows = [{"id": "a", "recording_id": "r", "start": 0.1, "duration": 0.3, "channel": 0, "text": "x", "unknown": 1}, {"id": "b", "recording_id": "r", "start": 0.5, "duration": 0.4, "channel": [0, 1]}]
    df = manifests.read_manifest(spark, jsonl(tmp_path / "s.jsonl", rows))
    assert [(r.id, list(r.channel)) for r in df.orderBy("id").collect()] == [("a", [0]), ("b", [0, 1])]
    with open(tmp_path / "s.json", "w") as f:
        json.dump(rows, f)
    assert manifests.read_manifest(spark, str(tmp_path / "s.json")).count() == 2
    with open(tmp_path / "s.yaml", "w") as f:
        f.write("- {id: a, recording_id: r, start: 0.0, duration: 1.0, channel: 0}\n")
    assert manifests.read_manifest(spark, str(tmp_path / "s.yaml")).first().channel == [0]
    out = str(tmp_path / "out")
    manifests.write_manifest(df, out)
    assert manifests.append_missing(df.withColumn("id", F.concat("id", F.lit("2"))).unionByName(df), out) == 2
    assert spark.read.json(out).count() == 4
    assert manifests.kind_of({"sources": []}) == "recording" and manifests.kind_of({"type": "MonoCut"}) == "cut"


def test_malformed_lines(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"id": "a", "recording_id": "r", "start": 0, "duration": 1}\n{broken\n')
    assert manifests.read_manifest(spark, str(p), "supervision", permissive=True).count() == 1


def test_rttm_and_ctm(spark, tmp_path):
    p = tmp_path / "x.rttm"
    p.write_text("SPEAKER r 1 0.0 0.0 <NA> <NA> a <NA> <NA>\nSPEAKER r 1 1.5 2.0 <NA> <NA> a <NA> <NA>\n")
    df = manifests.read_rttm(spark, [str(p)])
    assert [(r.id, r.start, r.speaker) for r in df.collect()] == [("r-000001", 1.5, "a")]
    assert manifests.format_rttm(df).first().value == "SPEAKER r 1 1.500 2.000 <NA> <NA> a <NA> <NA>"
    c = tmp_path / "x.ctm"
    c.write_text("r 0 1.60 0.20 hello\nr 0 3.40 0.20 out 0.9\n")
    words = manifests.read_ctm(spark, str(c))
    sup = SupervisionSet(df.withColumn("channel", F.array(F.lit(0))).withColumn("duration", F.lit(1.0))).with_alignment(words)
    assert [w.symbol for w in sup.df.first().alignment["word"]] == ["hello"]
    assert manifests.format_ctm(sup.df).first().value == "r 0 1.60 0.20 hello"


def test_data_directory(spark, tmp_path):
    for name, text in {"wav.scp": "r1 /a b.wav\nr2 sph2pipe /c.sph |\n", "reco2dur": "r1 10.00049\nr2 5\n", "segments": "u1 r1 1.0 2.5\nu2  r2 0 -1\n", "text": "u1 hello  world \n", "utt2spk": "u1 s\nu2 s\n", "spk2gender": "s f\n"}.items():
        (tmp_path / name).write_text(text)
    rec, sup, _ = manifests.read_kaldi_dir(spark, str(tmp_path), 16000)
    assert {r.id: (r.duration, r.sources[0].type) for r in rec.collect()} == {"r1": (10.0, "file"), "r2": (5.0, "command")}
    got = {r.id: r for r in sup.collect()}
    assert got["u2"].duration == 5.0 and got["u1"].text == "hello  world" and got["u1"].gender == "f"
    manifests.write_kaldi_dir(rec, sup, str(tmp_path / "out"))
    back, seg, _ = manifests.read_kaldi_dir(spark, str(tmp_path / "out"), 16000)
    assert back.count() == 2 and {r.id: r.duration for r in seg.collect()} == {"u1": 1.5, "u2": 5.0}


def test_shards(spark, tmp_path):
    rows = [(f"c{k:03d}", 3.0, 1.0, bytes([k]) * k if k % 5 else None) for k in range(25)]
    df = spark.createDataFrame(rows, "id string, start double, duration double, audio binary")
    assert sorted((r.shard, r.n) for r in archives.write_shards(df, str(tmp_path), ["audio"], 10).collect()) == [(0, 10), (1, 10), (2, 5)]
    back = {r.id: r for r in archives.read_shards(spark, str(tmp_path), ["audio"], "id string, start double, duration double").collect()}
    assert len(back) == 25 and back["c007"].audio == bytes([7]) * 7 and back["c005"].audio is None and back["c007"].start == 0.0
    assert archives.read_shards(spark, str(tmp_path), ["audio"], "id string", shards=[1]).count() == 10
    archives.register(spark)
    members = spark.read.format("tar").option("path", str(tmp_path)).load()
    assert members.count() == 50
    assert archives.members_as_pairs(members).where("key = 'c007'").first().payload == bytes([7]) * 7
    m = members.where("name = 'c007.bin'").first()
    where = spark.read.format("tar").option("path", str(tmp_path)).option("payload", "false").load().where("name = 'c007.bin'").select(manifests.pointer(F.col("archive"), F.col("offset"), F.col("offset") + F.col("size")).alias("p")).first().p
    assert archives.read_pointer(where) == bytes(m.data)


def test_indexes(spark, tmp_path):
    p = jsonl(tmp_path / "x.jsonl", [{"id": str(k)} for k in range(7)])
    assert archives.write_line_index(spark, [p]).first().n == 7
    assert archives.index_is_fresh(p)
    got = archives.read_indexed(spark, spark.createDataFrame([(p, 3), (p, 6)], "path string, row long")).collect()
    assert [json.loads(r.line)["id"] for r in got] == ["3", "6"]
    assert archives.catalogue_of(spark, "cuts", [p, p]).agg(F.max("first_row")).first()[0] == 7
    with open(p, "a") as f:
        f.write("{}\n")
    assert not archives.index_is_fresh(p)


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(8000) / 10) * 0.5
    for k in range(3):
        with open(tmp_path / f"w{k}.wav", "wb") as f:
            f.write(audio.wav_bytes(np.stack([x, -x]), 8000))
    rec = audio.recordings_from_dir(spark, str(tmp_path), exclude="w2")
    assert {(r.id, r.num_samples, len(r.channel_ids)) for r in rec.collect()} == {("w0", 8000, 2), ("w1", 8000, 2)}
    cuts = rec.select("id", F.lit(0.25).alias("start"), F.lit(0.5).alias("duration"), F.col("sources")[0]["source"].alias("path"))
    out = audio.load_audio(cuts)
    assert all(np.abs(np.array(r.samples) - x[2000:6000]).max() < 1e-4 for r in out.collect())
    assert audio.load_audio(cuts.withColumn("path", F.lit("/nowhere")), fault_tolerant=True).count() == 0
    saved = audio.save_audio(out, str(tmp_path / "o")).collect()
    assert audio.probe(saved[0].path) == (8000, 4000, 1)
    assert audio.expect_samples(np.zeros(9), 10).shape == (10,)
    with pytest.raises(ValueError):
        audio.expect_samples(np.zeros(5), 10)


def test_sets_and_commands(spark, tmp_path):
    seg = {"id": "s", "recording_id": "r", "start": 0.0, "duration": 2.0, "channel": [0], "text": "x", "speaker": "a"}
    p = jsonl(tmp_path / "cuts.jsonl", [{"id": f"c{k}", "start": 0.0, "duration": 4.0 + k, "channel": 0, "type": "MonoCut", "supervisions": [seg], "recording": {"id": "r", "sampling_rate": 16000, "duration": 20.0}} for k in range(6)])
    c = CutSet.from_file(spark, p)
    assert c.count() == 6 and c.filter("duration > 6").count() == 3 and (c + c).count() == 12
    assert [s.count() for s in c.split(4)] == [2, 2, 1, 1] and c.subset(first=2).count() == 2 and c.repeat(3).count() == 18
    assert c.map(lambda df: df.withColumn("duration", F.lit(1.0)), F.col("duration") > 6).filter("duration = 1").count() == 3
    assert [r.speaker for r in c.speakers().collect()] == ["a"] and c.decompose()[1].count() == 1
    assert c.cut_into_windows(2.0).count() == sum(-(-(4 + k) // 2) for k in range(6))
    assert c.validate().count() == 0 and c.describe().first().n == 6
    cli.main(["filter", "duration >= 7", p, str(tmp_path / "f")])
    assert spark.read.json(str(tmp_path / "f")).count() == 3
    cli.main(["windows", p, str(tmp_path / "w"), "--duration", "2"])
    assert spark.read.json(str(tmp_path / "w")).count() == c.cut_into_windows(2.0).count()
    with pytest.raises(ValueError):
        cli.predicate("duration > x")
    assert manifests.flat_table(c.df).where("text = 'x'").count() == 6
    table = spark.createDataFrame([("u", "hi", "en", 2.0)], "id string, sentence string, language string, duration double")
    assert manifests.cuts_from_table(table).first().supervisions[0].text == "hi"
    rec = RecordingSet.from_dicts(spark, [{"id": "r", "sources": [{"type": "file", "channels": [0], "source": "a.wav"}], "sampling_rate": 8000, "num_samples": 8000, "duration": 1.0}])
    assert rec.with_path_prefix("/x").df.first().sources[0].source == "/x/a.wav" and rec.to_cuts().count() == 1


def test_violations(spark):
    rec = spark.createDataFrame([("r", 8000, 8000, 2.0, [("file", [0], "a")]), ("q", 8000, None, 1.0, None)], "id string, sampling_rate int, num_samples long, duration double, sources array<struct<type:string,channels:array<int>,source:string>>")
    assert {(r.id, r.rule) for r in qa.check_recordings(rec).collect()} == {("r", "duration contradicts samples"), ("q", "no samples"), ("q", "no sources")}


def test_streams(spark, tmp_path):
    t0 = datetime(2031, 1, 1)
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "id string, recording_id string, start double, duration double, received_at timestamp"

    def feed(rows):
        spark.createDataFrame([(i, "r", s, d, t0 + timedelta(minutes=m)) for i, s, d, m in rows], schema).coalesce(1).write.mode("append").parquet(src)

    def run(kind):
        stream = spark.readStream.schema(schema).parquet(src)
        if kind == "periods":
            out, mode = coverage.period_stream(stream), "update"
        else:
            from voxtile.operators.batching import Constraint

            out, mode = batches.batch_stream(stream.withColumn("s", F.lit(0)), Constraint(max_items=2), "s"), "append"
        held = []
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{ck}-{kind}").foreachBatch(lambda df, n: held.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return held

    feed([("a", 0.0, 1.0, 0), ("b", 5.0, 1.0, 1), ("x", 1.0, -1.0, 1)])
    first = run("periods")
    assert sorted((r.start_ms, r.end_ms) for r in first) == [(0, 1000), (5000, 6000)]
    b1 = run("batches")
    feed([("c", 0.5, 4.6, 2), ("a", 0.0, 1.0, 3)])
    again = run("periods")
    assert [(r.start_ms, r.end_ms, r.version) for r in again] == [(0, 6000, 2)]
    b2 = run("batches")  # restarted from its checkpoint: the open batch went on
    sizes = {}
    for r in b1 + b2:
        sizes.setdefault(r.batch, []).append(r.id)
    assert all(len(v) == 2 for v in sizes.values()) and len(b1 + b2) == 4


def test_sessions(spark):
    rows = [(1, 0, 10), (1, 5, 7), (1, 30, 31), (2, 0, 1), (1, 12, 20)]
    df = spark.createDataFrame(rows, "user_id long, start_us long, end_us long")
    for chunk in (10**9, 6):
        assert {tuple(r) for r in sessions.islands(df, "user_id", 5, chunk).collect()} == {(1, 0, 20, 3), (1, 30, 31, 1), (2, 0, 1, 1)}


def test_recordings_and_payloads(spark, tmp_path):
    from voxtile.operators import cuts, mixing, recordings
    from voxtile.sources import arrays

    rec = spark.createDataFrame([("r", 8000, 8000, 1.0)], "id string, sampling_rate int, num_samples long, duration double")
    fast = recordings.perturb_recordings(rec, 1.1).first()
    assert (fast.id, fast.num_samples, fast.transforms[0]["name"]) == ("r_sp1.1", 7273, "speed")
    assert recordings.perturb_recordings(rec, 2.0, "volume").first().num_samples == 8000
    assert recordings.resample_recordings(rec, 16000).first().num_samples == 16000
    assert recordings.transformed(rec, "reverb", "_rvb").first().id == "r_rvb"
    sup = spark.createDataFrame([("s", "r", 0.5, 0.25, {"word": [("a", 0.5, 0.1, None)]})], "id string, recording_id string, start double, duration double, alignment map<string,array<struct<symbol:string,start:double,duration:double,score:double>>>")
    p = recordings.perturb_segments(sup, rec.select(F.col("id").alias("recording_id"), "sampling_rate"), 2.0).first()
    assert (p.id, p.start, p.duration, p.alignment["word"][0].start) == ("s_sp2", 0.25, 0.125, 0.25)

    x = np.sin(np.arange(8000) / 10) * 0.5
    for k in "ab":
        with open(tmp_path / f"{k}.wav", "wb") as f:
            f.write(audio.wav_bytes(x, 8000))
    seg = "struct<id:string,recording_id:string,start:double,duration:double,channel:array<int>,text:string,speaker:string>"
    c = spark.createDataFrame([(k, 0.0, 0.5, 0, []) for k in "ab"], f"id string, start double, duration double, channel int, supervisions array<{seg}>")
    paths = spark.createDataFrame([(k, str(tmp_path / f"{k}.wav")) for k in "ab"], "recording_id string, path string")
    both = cuts.mix(c.where("id = 'a'").withColumn("k", F.lit(1)), c.where("id = 'b'").withColumn("k", F.lit(1)), "k", 0.25, 10.0)
    got = audio.load_mixed(both, paths).first()
    assert len(got.samples) == 6000 and abs(got.samples[10] - x[10]) < 1e-3
    noisy = mixing.mix_noise(c, c.where("id = 'b'").withColumn("duration", F.lit(0.2)), 10.0).where("id = 'a'").first()
    assert [t.offset for t in noisy.tracks] == [0.0, 0.0, 0.2, 0.4] and noisy.tracks[3].cut.duration == 0.1
    assert mixing.mix_by_position([c, c]).count() == 2

    signals = spark.createDataFrame([("a", x.tolist()), ("b", x.tolist())], "id string, samples array<float>")
    store = str(tmp_path / "feats")
    assert audio.extract_and_store(signals.where("id = 'a'"), store) == 1 and audio.extract_and_store(signals, store) == 1
    assert len(arrays.unpacked_column(spark.read.parquet(store), "payload").first().features[0]) == 80
    m = np.random.default_rng(0).normal(size=(50, 8))
    assert np.array_equal(arrays.unpack(arrays.pack(m)), m) and np.abs(arrays.unpack_lossy(arrays.pack_lossy(m, -6)) - m).max() <= 2.0**-7 + 1e-6
    kept = arrays.copy_files(paths, "path", str(tmp_path / "copies")).collect()
    assert all(os.path.exists(r.path) and "copies" in r.path for r in kept)
    assert arrays.open_any("pipe:echo hi", "r").read() == "hi\n"
    with pytest.raises(ValueError):
        arrays.open_any("s3://x/y")


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:02d}", 1.5, b"x" * i if i else None) for i in range(12)], "id string, duration double, payload binary")
    assert archives.write_bundles(df, str(tmp_path), "payload", 5).agg(F.sum("n")).first()[0] == 12
    back = {r.id: r for r in archives.read_bundles(spark, str(tmp_path), "id string, duration double").collect()}
    assert len(back) == 12 and back["k03"].payload == b"xxx" and back["k00"].payload is None
    tars = archives.expand(str(tmp_path))
    assert archives.write_tar_index(spark, tars).agg(F.sum("n")).first()[0] == 23 and all(archives.index_is_fresh(t) for t in tars)
    parts = [archives.shard_order(10, 3, 1, r, 3) for r in range(3)]
    assert sorted(sum(parts, [])) == list(range(10))


def test_noise_reaches_the_end_of_a_long_cut(spark):
    from voxtile.operators import mixing

    c = spark.createDataFrame([("a", 0.0, 11.0, 0, []), ("b", 0.0, 0.001, 0, [])], "id string, start double, duration double, channel int, supervisions array<struct<id:string>>")
    last = mixing.mix_noise(c, c.where("id = 'b'"), 10.0).where("id = 'a'").first().tracks[-1]
    assert round(last.offset + last.cut.duration, 8) == 11.0
