"""Queries of the fluent sets, and of operators on tracks, custom attributes, samplers' state, masks and arrays, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.functions import signal
from voxtile.functions import timeops as O
from voxtile.functions.timeops import to_us as us
from voxtile.operators import batching as B
from voxtile.operators import cuts as C
from voxtile.operators import dataset as D
from voxtile.operators import joins as J
from voxtile.operators import qa as Q
from voxtile.operators import recordings as R
from voxtile.operators import task_batches as TB
from voxtile.plans.catalogue import _FIXED, _LENGTH_SQL, CUTS, _fixed, _greedy_sql, _hash_sql, _lengths, _strata_sql, _unique, _words, audio, cuts, feats, query, sup, us_sql
from voxtile.plans.catalogue import ORACLES as _ALL_SQL
from voxtile.plans.catalogue import QUERIES as _ALL
from voxtile.plans.sets import CutSet, RecordingSet, SupervisionSet
from voxtile.session import table

_BEFORE = set(_ALL)

# ---- sets --------------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN duration > 5 THEN replace(text, 'e', 'E') ELSE text END AS text FROM supervision")
def set_map_some(spark, d):
    """A transformation of some rows; the rest pass."""
    s = SupervisionSet(sup(spark, d).select("id", "duration", "text"))
    return s.map(lambda df: df.withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), F.col("duration") > 5).df.select("id", "text")


@query("SELECT id FROM supervision WHERE speaker IS NOT NULL AND start >= 10")
def set_filter(spark, d):
    return SupervisionSet(sup(spark, d)).filter(F.col("speaker").isNotNull()).filter("start >= 10").ids()


@query("SELECT id, count(*) AS n FROM (SELECT id FROM audio UNION ALL SELECT id FROM audio) GROUP BY id")
def set_combined(spark, d):
    r = RecordingSet(audio(spark, d).select("id", "duration"))
    return (r + r).ids().groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, {us_sql('duration')} AS duration_us, CAST(0 AS BIGINT) AS start_us, sampling_rate FROM audio")
def recordings_to_cuts(spark, d):
    c = RecordingSet(audio(spark, d)).to_cuts().df
    return c.select("id", us("duration").alias("duration_us"), us("start").alias("start_us"), F.col("recording.sampling_rate").alias("sampling_rate"))


@query("SELECT id, array_to_string(list_transform(sources, lambda s: '/mnt/' || s.source), '|') AS sources FROM audio WHERE sources IS NOT NULL AND len(list_filter(sources, lambda s: s.source IS NULL)) = 0")
def recordings_path_prefix(spark, d):
    whole = audio(spark, d).where("sources is not null").where(~F.exists("sources", lambda s: s["source"].isNull()))
    return RecordingSet(whole).with_path_prefix("/mnt/").df.select("id", F.array_join(F.transform("sources", lambda s: s["source"]), "|").alias("sources"))


@query("SELECT id, CASE WHEN features IS NULL THEN NULL ELSE '/mnt/' || features.storage_key END AS key FROM cuts WHERE features IS NULL OR features.storage_key IS NOT NULL")
def features_path_prefix(spark, d):
    c = cuts(spark, d).where("features is null or features.storage_key is not null")
    return C.with_path_prefix(c, "features", "storage_key", "/mnt").select("id", F.col("features.storage_key").alias("key"))


@query("SELECT id, 0 AS features, CASE WHEN recording IS NULL THEN 0 ELSE 1 END AS recordings, CAST(len(supervisions) AS BIGINT) AS n FROM cuts")
def dropped_features(spark, d):
    return CutSet(cuts(spark, d)).drop_features().df.select("id", F.col("features").isNotNull().cast("int").alias("features"), F.col("recording").isNotNull().cast("int").alias("recordings"), F.size("supervisions").cast("long").alias("n"))


@query("SELECT id, 0 AS recordings, CAST(0 AS BIGINT) AS n FROM cuts WHERE supervisions IS NOT NULL")
def dropped_recordings_and_segments(spark, d):
    c = CutSet(cuts(spark, d).where("supervisions is not null")).drop_recordings().drop_supervisions().df
    return c.select("id", F.col("recording").isNotNull().cast("int").alias("recordings"), F.size("supervisions").cast("long").alias("n"))


@query("SELECT DISTINCT s.speaker AS speaker FROM (SELECT unnest(supervisions) AS s FROM cuts) WHERE s.speaker IS NOT NULL")
def set_speakers(spark, d):
    return CutSet(cuts(spark, d)).speakers()


@query(f"SELECT id, {us_sql('round(start - 5.0, 8)')} AS start_us FROM supervision WHERE recording_id = 'live-00000001' AND start >= 4.999 AND round(start + duration, 8) <= 300.001")
def set_find(spark, d):
    return SupervisionSet(sup(spark, d)).find("live-00000001", start_after=5.0, end_before=300.0, adjust_offset=True).df.select("id", us("start").alias("start_us"))


@query("""SELECT id, array_to_string(list_transform(alignment['word'], lambda w: '<' || w.symbol || '>'), ' ') AS words FROM supervision WHERE alignment['word'] IS NOT NULL AND len(list_filter(alignment['word'], lambda w: w.symbol IS NULL)) = 0""")
def set_alignment_mapped(spark, d):
    s = SupervisionSet(sup(spark, d).where("alignment is not null")).transform_alignment(lambda x: F.concat(F.lit("<"), x, F.lit(">"))).df
    w = s.select("id", F.try_element_at("alignment", F.lit("word")).alias("w")).where("w is not null").where(~F.exists("w", lambda x: x["symbol"].isNull()))
    return w.select("id", F.array_join(F.transform("w", lambda x: x["symbol"]), " ").alias("words"))


@query("""WITH s AS (SELECT id, min(recording_id) AS recording_id, min(start) AS a, min(duration) AS du FROM supervision WHERE recording_id IS NOT NULL GROUP BY id HAVING count(*) = 1),
w AS (SELECT recording_id, unnest(flatten(map_values(alignment))) AS w FROM supervision WHERE alignment IS NOT NULL AND recording_id IS NOT NULL)
SELECT s.id, count(w.w) AS n FROM s LEFT JOIN w ON s.recording_id = w.recording_id AND w.w.start >= s.a - 0.001 AND round(w.w.start + w.w.duration, 8) <= round(s.a + s.du, 8) + 0.001 AND round(s.a + s.du, 8) >= s.a GROUP BY s.id""")
def set_with_alignment(spark, d):
    """Words joined into the segments of one delivery that hold them; none gives an empty list."""
    s = sup(spark, d).where("recording_id is not null")
    once = s.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")
    out = SupervisionSet(s.join(once, "id").drop("alignment")).with_alignment(_words(sup(spark, d))).df
    return out.select("id", F.size(F.col("alignment")["word"]).cast("long").alias("n"))


@query("SELECT id, '7' AS take, CAST(coalesce(cardinality(custom), 0) + CASE WHEN custom['take'] IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS n FROM cuts")
def custom_set(spark, d):
    c = C.with_custom(cuts(spark, d), "take", F.lit("7"))
    return c.select("id", F.try_element_at("custom", F.lit("take")).alias("take"), F.size("custom").cast("long").alias("n"))


@query(f"SELECT id || '_nb_mulaw' AS id, {us_sql('duration')} AS duration_us, coalesce(array_to_string(list_transform(supervisions, lambda s: s.id || '_nb_mulaw'), ','), '') AS sups FROM cuts")
def narrowband_ids(spark, d):
    c = CutSet(cuts(spark, d)).narrowband("mulaw").df
    return c.select("id", us("duration").alias("duration_us"), F.coalesce(F.array_join(F.transform("supervisions", lambda s: s["id"]), ","), F.lit("")).alias("sups"))


@query("SELECT id || '_rvb' AS id FROM cuts")
def reverberated_ids(spark, d):
    return CutSet(cuts(spark, d)).reverb().ids()


# ---- joins and repair ----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT id, max(duration) AS e FROM audio WHERE id IS NOT NULL AND duration IS NOT NULL GROUP BY id)
SELECT s.id, CAST(round(least(s.duration, round(e.e - s.start, 8)) * 1000000.0) AS BIGINT) AS duration_us FROM supervision s JOIN e ON e.id = s.recording_id WHERE s.start < e.e""")
def fixed_manifests(spark, d):
    return J.fix_manifests(audio(spark, d), sup(spark, d))[1].select("id", us("duration").alias("duration_us"))


@query("SELECT DISTINCT id FROM audio WHERE id IN (SELECT recording_id FROM supervision)")
def fixed_recordings(spark, d):
    return J.fix_manifests(audio(spark, d), sup(spark, d))[0].select("id").distinct()


@query("SELECT x.id, row_number() OVER (ORDER BY x.m DESC, x.id) - 1 AS place FROM (SELECT id, max(duration) AS m FROM cuts GROUP BY id) x")
def sorted_like_another(spark, d):
    c = cuts(spark, d).groupBy("id").agg(F.max("duration").alias("m"))
    order = D.with_position(c, F.col("m").desc(), "id", name="o")
    like = D.sort_like(c.select("id"), order, "o")
    return D.with_position(like.join(order.select("id", "o"), "id"), "o", name="place").select("id", "place")


@query("SELECT id, count(DISTINCT s) AS n FROM (SELECT id, unnest(supervisions) AS s FROM cuts) WHERE s.id IN (SELECT id FROM supervision WHERE duration > 3) GROUP BY id")
def cuts_of_chosen_segments(spark, d):
    chosen = sup(spark, d).where("duration > 3").select("id").distinct()
    c = J.subset_by_segments(cuts(spark, d), chosen)
    return c.groupBy("id").agg(F.sum(F.size("supervisions")).alias("n"))


# ---- tracks --------------------------------------------------------------------------------------------------------


def _mixed(spark, d) -> DataFrame:
    c = _unique(cuts(spark, d).where("recording is not null")).withColumn("rec", F.col("recording.id"))
    return C.append_all(c, "rec", "id")


_APPENDED = """WITH u AS (SELECT id, min(recording.id) AS rec, min(duration) AS duration FROM cuts WHERE recording IS NOT NULL GROUP BY id),
o AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY rec ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM u)"""


@query(_APPENDED + f" SELECT rec, id, {us_sql('off')} AS offset_us FROM o")
def track_offsets(spark, d):
    return _mixed(spark, d).select("rec", F.explode("tracks").alias("t")).select("rec", F.col("t.cut.id").alias("id"), us("t.offset").alias("offset_us"))


@query(_APPENDED + f" SELECT id, {us_sql('duration')} AS duration_us FROM o")
def unmixed_tracks(spark, d):
    return C.unmix(_mixed(spark, d)).select("id", us("duration").alias("duration_us"))


@query("""SELECT recording.id AS rec, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, any_value(recording) AS recording, max(len(supervisions)) AS n FROM cuts WHERE recording IS NOT NULL GROUP BY id) GROUP BY 1""")
def mixed_segments(spark, d):
    return _mixed(spark, d).select("rec", F.size(C.mixed_supervisions(F.col("tracks"))).cast("long").alias("n"))


@query("""SELECT rec, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, any_value(recording.id) AS rec, max(len(list_filter(supervisions, lambda s: coalesce(s.duration > 2, false)))) AS n FROM cuts WHERE recording IS NOT NULL GROUP BY id) GROUP BY 1""")
def mixed_segments_filtered(spark, d):
    kept = C.filter_mixed_supervisions(_mixed(spark, d), lambda s: F.coalesce(s["duration"] > 2, F.lit(False)))
    return kept.select("rec", F.size(C.mixed_supervisions(F.col("tracks"))).cast("long").alias("n"))


@query("SELECT id, c AS channel FROM (SELECT id, unnest(channel) AS c FROM supervision)")
def one_row_per_channel(spark, d):
    return C.to_mono(sup(spark, d).select("id", "channel"))


# ---- perturbed recordings and segments -----------------------------------------------------------------------------


@query("SELECT id || '_sp1.1' AS id, CAST(round(round(num_samples / 1.1, 8)) AS BIGINT) AS num_samples FROM audio WHERE num_samples IS NOT NULL")
def recordings_at_another_speed(spark, d):
    return R.perturb_recordings(audio(spark, d).where("num_samples is not null"), 1.1).select("id", "num_samples")


@query("SELECT id || '_vp0.5' AS id, num_samples FROM audio")
def recordings_at_another_volume(spark, d):
    return R.perturb_recordings(audio(spark, d), 0.5, "volume").select("id", "num_samples")


@query("SELECT id || '_nb_mulaw' AS id, 'narrowband' AS name FROM audio")
def recordings_narrowband(spark, d):
    return R.transformed(audio(spark, d), "narrowband", "_nb_mulaw", codec="mulaw").select("id", F.element_at("transforms", -1)["name"].alias("name"))


@query("SELECT id, 8000 AS sampling_rate FROM audio")
def recordings_resampled(spark, d):
    return R.resample_recordings(audio(spark, d).withColumn("transforms", F.lit(None).cast("array<map<string,string>>")), 8000).select("id", "sampling_rate")


@query("""WITH r AS (SELECT id, min(sampling_rate) AS sr FROM audio WHERE sampling_rate IS NOT NULL GROUP BY id)
SELECT s.id || '_sp0.9' AS id, s.recording_id || '_sp0.9' AS recording_id, CAST(ceil(round(round(round(s.start * r.sr, 8)) / 0.9, 8) - 0.5) AS BIGINT) AS start_samples FROM supervision s JOIN r ON r.id = s.recording_id WHERE s.start >= 0 AND s.start < 1e6""")
def segments_at_another_speed(spark, d):
    rates = audio(spark, d).where("sampling_rate is not null").groupBy(F.col("id").alias("recording_id")).agg(F.min("sampling_rate").alias("sampling_rate"))
    s = sup(spark, d).where("start >= 0 and start < 1e6")
    out = R.perturb_segments(s, rates, 0.9)
    sr = rates.select(F.concat("recording_id", F.lit("_sp0.9")).alias("recording_id"), F.col("sampling_rate").alias("sr"))
    return out.join(sr, "recording_id").select("id", "recording_id", F.round(F.col("start") * F.col("sr")).cast("long").alias("start_samples"))


# ---- samplers --------------------------------------------------------------------------------------------------------


@query(f"SELECT id, batch FROM {_FIXED} WHERE batch >= 10")
def resumed_batches(spark, d):
    """A sampler that goes on from a saved position gives what was left."""
    return B.resumed(_fixed(spark, d), 10).select("id", "batch")


@query(f"SELECT id, batch FROM {_FIXED} WHERE batch % 3 = 1")
def batches_of_one_rank(spark, d):
    return B.rank_batches(_fixed(spark, d), 3).where("rank = 1").select("id", "batch")


@query("""SELECT batch, string_agg(id, ',' ORDER BY duration DESC, id) AS cut_ids
FROM (SELECT id, duration, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM (SELECT id, min(duration) AS duration FROM cuts GROUP BY id)) GROUP BY batch""")
def unsupervised_batches(spark, d):
    c = _unique(cuts(spark, d))
    b = D.split_chunks(c.select("id", "duration"), 16, "id").withColumnRenamed("chunk", "batch")
    return TB.unsupervised(c, b).select("batch", F.array_join("cut_ids", ",").alias("cut_ids"))


_ALL_SQL["recognition_batches"] = _greedy_sql("SELECT 0 AS s, id, m, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT id, min(duration) AS m FROM cuts GROUP BY id)", 120.0, False).replace(
    "SELECT s AS stratum, id, m AS measure, batch FROM g",
    """SELECT batch, CAST(count(*) AS INTEGER) AS n_cuts, CAST(sum(t.n) AS INTEGER) AS n_texts FROM g JOIN (SELECT id, max(len(supervisions)) AS n FROM cuts GROUP BY id) t USING (id) GROUP BY batch""",
)


@query(f"SELECT count(*) AS n, CAST(max(k) AS BIGINT) AS longest FROM (SELECT batch, count(*) AS k FROM ({_greedy_sql(_strata_sql(_LENGTH_SQL).replace('% 16', '% 1'), 120.0, False)}) GROUP BY batch)")
def batches_of_the_whole_order(spark, d):
    """One stratum: the exact order of a sampler without strata."""
    b = B.greedy_batches(_lengths(spark, d), B.Constraint(max_total=120.0))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("longest"))


@query(f"SELECT id, {_hash_sql('id', 5)} % 3 AS shard FROM (SELECT DISTINCT id FROM supervision)")
def readers_by_hash(spark, d):
    return sup(spark, d).select("id").distinct().select("id", F.pmod(O.hash_int("id", 5), F.lit(3)).alias("shard"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(['not exactly one segment']) AS rule FROM cuts WHERE len(supervisions) <> 1) GROUP BY rule")
def synthesis_violations(spark, d):
    return Q.check_for_synthesis(cuts(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# ---- arrays and masks ------------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(40 - len(embedding) AS BIGINT) AS rest FROM embeddings WHERE len(embedding) <= 40 UNION ALL SELECT vec_id, len(embedding), 0 FROM embeddings WHERE len(embedding) > 40")
def length_masks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"))
    m = e.withColumn("mask", signal.length_mask(F.col("n"), F.greatest(F.col("n"), F.lit(40))))
    return m.select("vec_id", F.size(F.filter("mask", lambda x: x)).cast("long").alias("n"), F.size(F.filter("mask", lambda x: ~x)).cast("long").alias("rest"))


@query("SELECT vec_id, CAST(greatest(len(embedding), 100) AS BIGINT) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def padded_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", signal.padded(F.col("embedding"), F.lit(100)).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[3:7], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def sliced_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", signal.sliced(F.col("embedding"), F.lit(0.02), 0.01, F.lit(0.05)).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding), 6) AS energy FROM embeddings")
def signal_energy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(signal.energy(F.col("embedding")), 6).alias("energy"))


@query("SELECT id, num_samples, CAST(floor((num_samples + floor(round_even(0.01 * sampling_rate, 0) / 2)) / round_even(0.01 * sampling_rate, 0)) AS BIGINT) AS frames FROM audio WHERE num_samples > 0 AND sampling_rate > 0")
def frames_from_samples(spark, d):
    a = audio(spark, d).where("num_samples > 0 and sampling_rate > 0")
    return a.select("id", "num_samples", O.frames_of_samples(F.col("num_samples"), 0.01, F.col("sampling_rate")).cast("long").alias("frames"))


@query("SELECT recording_id, storage_key, CAST(ceil((duration - 0.025) / 0.01) AS BIGINT) AS frames FROM features WHERE duration IS NOT NULL")
def frames_from_durations(spark, d):
    return feats(spark, d).where("duration is not null").select("recording_id", "storage_key", O.time_diff_frames(F.col("duration"), 0.025, 0.01).alias("frames"))


@query(f"""{CUTS} SELECT sid AS id, CAST(count(*) AS BIGINT) AS n FROM seg WHERE channel IS NOT NULL GROUP BY sid""")
def segments_with_channels(spark, d):
    s = cuts(spark, d).select(F.explode("supervisions").alias("s")).where("s.channel is not null")
    return s.groupBy(F.col("s.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in _ALL.items() if k not in _BEFORE}
ORACLES = {k: s for k, s in _ALL_SQL.items() if k in QUERIES}
