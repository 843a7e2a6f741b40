"""Joins of manifests: attaching, finding, containment and overlap ranges, best fit, repair.

Range joins never pair all rows of a recording: both sides are cut into time buckets and
joined on (recording, bucket), so a recording with a third of all rows spreads over many
tasks. A pair is kept only in the bucket where the later of the two starts, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtile.functions.timeops import end_of, r8

BUCKET_S = 60.0
TOLERANCE = 1e-3
LEEWAY = 0.05


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float = BUCKET_S) -> DataFrame:
    """Rows of two sets with equal keys whose spans (l_start, l_end) and (r_start, r_end) overlap strictly."""
    spread = lambda a, b: F.explode(F.sequence(_bucket(F.col(a), width), F.greatest(_bucket(F.col(a), width), _bucket(F.col(b), width))))
    a = left.where("l_start is not null and l_end > l_start").withColumn("__b", spread("l_start", "l_end"))
    b = right.where("r_start is not null and r_end > r_start").withColumn("__b", spread("r_start", "r_end"))
    pairs = a.join(b, [*keys, "__b"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    return pairs.where(F.col("__b") == F.greatest(_bucket(F.col("l_start"), width), _bucket(F.col("r_start"), width))).drop("__b")


def containment_join(inner: DataFrame, outer: DataFrame, keys: list[str], tolerance: float = TOLERANCE, width: float = BUCKET_S) -> DataFrame:
    """Rows (i_start, i_end) that lie within rows (o_start, o_end) up to a tolerance; an inner row may lie in several."""
    i = inner.where("i_start is not null and i_end is not null").withColumn("__b", _bucket(F.col("i_start"), width))
    lo, hi = _bucket(F.col("o_start") - tolerance, width), _bucket(F.col("o_end") + tolerance, width)
    o = outer.where("o_start is not null and o_end >= o_start").withColumn("__b", F.explode(F.sequence(lo, hi)))
    return i.join(o, [*keys, "__b"]).where((F.col("i_start") >= F.col("o_start") - tolerance) & (F.col("i_end") <= F.col("o_end") + tolerance)).drop("__b")


def block_pairs(df: DataFrame, key: str, place: str, member: str, block: int = 1000) -> DataFrame:
    """(key, left, right): all pairs of the members of a key, whose places count from 0 within it; each pair once, the lower place left.

    A member meets one block of earlier ones at a time, so a key with very many members is
    spread over as many tasks as it has blocks.
    """
    number = F.floor(F.col(place) / block).cast("long")
    low = df.select(key, number.alias("__b"), F.col(place).alias("__l"), F.col(member).alias("left"))
    high = df.select(key, F.explode(F.sequence(F.lit(0).cast("long"), number)).alias("__b"), F.col(place).alias("__h"), F.col(member).alias("right"))
    return low.join(high, [key, "__b"]).where("__l < __h").select(key, "left", "right")


def attach_segments(recordings: DataFrame, supervisions: DataFrame, check_ends: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """Segments of each recording in long form: (cut_id, cut_duration, sup columns). Recordings without segments stay with nulls.

    ``check_ends`` also drops segments that end beyond their recording.
    """
    rec = recordings.select(F.col("id").alias("cut_id"), F.col("duration").alias("cut_duration"))
    sup = supervisions.withColumnRenamed("id", "sup_id")
    on = rec["cut_id"] == sup["recording_id"]
    if check_ends:
        on = on & (sup["start"] + sup["duration"] <= rec["cut_duration"] + tolerance)
    return rec.join(sup, on, "left")


def cuts_from_manifests(recordings: DataFrame, supervisions: DataFrame, part_s: float | None = None) -> DataFrame:
    """One cut per recording with its segments nested in order of start, then id.

    ``part_s`` gives one cut per so many seconds of recording instead, by the segments'
    starts, so that a recording of any size fits its rows.
    """
    sup = supervisions.where("recording_id is not null").withColumn("__s", F.struct("start", "id", *[c for c in supervisions.columns if c not in ("start", "id")]))
    part = F.coalesce(F.floor(F.col("start") / part_s), F.lit(0)).cast("long") if part_s else F.lit(0).cast("long")
    nested = sup.groupBy("recording_id", part.alias("part")).agg(F.array_sort(F.collect_list("__s")).alias("supervisions"))
    rec = recordings.select(F.col("id").alias("recording_id"), F.struct("id", "sampling_rate", "duration").alias("recording"), F.col("duration"))
    out = rec.join(nested, "recording_id", "left")
    return out.select(F.concat_ws("-", "recording_id", F.coalesce("part", F.lit(0)).cast("string")).alias("id"), F.lit(0.0).alias("start"), "duration", "recording", "supervisions")


def find_segments(supervisions: DataFrame, recording_id: str, channel: int | None = None, start_after: float = 0.0, end_before: float | None = None, adjust_offset: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """Segments of one recording within a span, optionally of one channel and re-based to the span's start."""
    out = supervisions.where((F.col("recording_id") == recording_id) & (F.col("start") >= start_after - tolerance))
    if channel is not None:
        out = out.where(F.array_contains("channel", channel))
    if end_before is not None:
        out = out.where(end_of("start", "duration") <= end_before + tolerance)
    return out.withColumn("start", r8(F.col("start") - start_after)) if adjust_offset else out


def best_features(requests: DataFrame, features: DataFrame, leeway: float = LEEWAY, width: float = BUCKET_S) -> DataFrame:
    """For requests (request_id, recording_id, channel, q_start, q_end): the feature span of the recording and channel that fits best.

    Candidates start by the request's start and end after its end, up to a leeway; the
    least squared error of the two bounds wins, ties by storage key. Requests without a
    candidate are left out.
    """
    f = features.where("recording_id is not null and channels is not null").select(
        "recording_id", F.explode("channels").alias("channel"), F.col("start").alias("f_start"), end_of("start", "duration").alias("f_end"), "storage_key"
    ).distinct()
    # candidates meet in the time bucket of the request's start
    lo, hi = _bucket(F.col("f_start") - leeway, width), _bucket(F.col("f_end") + leeway, width)
    f = f.where("f_end >= f_start").withColumn("__b", F.explode(F.sequence(lo, hi)))
    both = requests.withColumn("__b", _bucket(F.col("q_start"), width)).join(f, ["recording_id", "channel", "__b"])
    fits = (F.col("f_start") - leeway <= F.col("q_start")) & (F.col("q_start") < F.col("f_end") + leeway) & (F.col("f_end") >= F.col("q_end") - leeway)
    err = F.pow(F.col("q_start") - F.col("f_start"), 2) + F.pow(F.col("q_end") - F.col("f_end"), 2)
    best = F.min(F.struct(F.round(err, 6).alias("err"), "storage_key", "f_start", "f_end"))
    return both.where(fits).groupBy("request_id").agg(best.alias("b")).select("request_id", "b.storage_key", "b.f_start", "b.f_end")


def words_in_segments(supervisions: DataFrame, words: DataFrame, match_channel: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """Words (recording_id, channel, w_start, w_duration, symbol) joined to the segments that hold them: (sup_id, symbol, w_start, w_duration)."""
    inner = words.select("recording_id", F.col("channel").alias("w_channel"), F.col("w_start").alias("i_start"), end_of("w_start", "w_duration").alias("i_end"), "symbol", "w_duration")
    outer = supervisions.where("recording_id is not null").select("recording_id", F.col("id").alias("sup_id"), F.col("start").alias("o_start"), end_of("start", "duration").alias("o_end"), F.col("channel").alias("s_channel"))
    pairs = containment_join(inner, outer, ["recording_id"], tolerance)
    if match_channel:
        pairs = pairs.where(F.expr("array_contains(s_channel, w_channel)"))
    return pairs.select("recording_id", "sup_id", "symbol", F.col("i_start").alias("w_start"), "w_duration")


def present_on_both_sides(recordings: DataFrame, supervisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings with segments and segments with recordings."""
    ids = recordings.where("id is not null").select(F.col("id").alias("recording_id")).distinct()
    kept = supervisions.join(ids, "recording_id", "left_semi")
    named = kept.select(F.col("recording_id").alias("id")).distinct()
    return recordings.join(named, "id", "left_semi"), kept


def trim_to_recordings(recordings: DataFrame, supervisions: DataFrame) -> DataFrame:
    """Segments that begin within their recording, ends clipped to it."""
    ends = recordings.where("id is not null and duration is not null").groupBy(F.col("id").alias("recording_id")).agg(F.max("duration").alias("__end"))
    joined = supervisions.join(ends, "recording_id").where("start < __end")
    clipped = F.least(F.col("duration"), r8(F.col("__end") - F.col("start")))
    return joined.withColumn("duration", clipped).drop("__end")


def fix_manifests(recordings: DataFrame, supervisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    rec, sup = present_on_both_sides(recordings, supervisions)
    return rec, trim_to_recordings(rec, sup)


def within_spans(segments: DataFrame, spans: DataFrame, whole: bool = False) -> DataFrame:
    """Segments cut to the scoring spans (recording_id, r_start, r_end) that they overlap; ``whole`` keeps them uncut."""
    left = segments.select("recording_id", "id", F.col("start").alias("l_start"), end_of("start", "duration").alias("l_end"))
    pairs = overlap_join(left, spans, ["recording_id"])
    if whole:
        return pairs.select("recording_id", "id", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct()
    return pairs.select("recording_id", "id", F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end"))


def decompose(cuts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings (once each), segments with the cut's offset restored (once each) and features of a set of cuts."""
    rec = cuts.where("recording is not null").select("recording.*").dropDuplicates(["id"])
    sup = cuts.select(F.col("start").alias("__o"), F.explode("supervisions").alias("s")).select(F.col("s").withField("start", r8(F.col("s.start") + F.col("__o"))).alias("s"))
    first = sup.groupBy(F.col("s.id").alias("id")).agg(F.min_by("s", F.struct(F.col("s.start"), F.col("s.duration"))).alias("s")).select("s.*")
    return rec, first, cuts.where("features is not null").select("features.*")


def subset_by_segments(cuts: DataFrame, ids: DataFrame) -> DataFrame:
    """Cuts that hold one of the segments in ``ids`` (column id), with those segments only."""
    wide = cuts.select("*", F.explode("supervisions").alias("__s")).join(ids.select(F.col("id").alias("__id")).distinct(), F.col("__s.id") == F.col("__id"), "left_semi")
    rest = [c for c in cuts.columns if c not in ("supervisions", "id")]
    return wide.groupBy("id").agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_set("__s")).alias("supervisions"))


def combine_channels(cuts: DataFrame) -> DataFrame:
    """Cuts with the same recording and span as one multi-channel cut: channels sorted, segments together."""
    key = [F.col("recording.id").alias("recording_id"), "start", "duration"]
    return cuts.where("recording is not null").groupBy(*key).agg(
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("supervisions", lambda s: s["id"]))))).alias("sup_ids"),
        F.min("id").alias("id"),
    )


def neighbours(supervisions: DataFrame, keys: tuple[str, ...] = ("recording_id",), chunk_s: float = 600.0) -> DataFrame:
    """Adds prev_end and prev_speaker: those of the segment before with the same keys, by start and id.

    The neighbour of a chunk's first row is the last row of the chunk before, carried by a
    summary with one row per key and chunk.
    """
    keys = list(keys)
    s = supervisions.where("start is not null and duration > 0")
    for k in keys:
        s = s.where(F.col(k).isNotNull())
    s = s.withColumn("__c", F.floor(F.col("start") / chunk_s))
    row = F.struct("start", "id", end_of("start", "duration").alias("e"), F.col("speaker").alias("who"))
    last = s.groupBy(*keys, "__c").agg(F.max(row).alias("l"))
    carried = last.select(*keys, "__c", F.lag("l").over(Window.partitionBy(*keys).orderBy("__c")).alias("l"))
    own = s.withColumn("__p", F.lag(row).over(Window.partitionBy(*keys, "__c").orderBy("start", "id")))
    p = F.coalesce("__p", "l")
    return own.join(carried, [*keys, "__c"]).withColumn("prev_end", p["e"]).withColumn("prev_speaker", p["who"]).drop("__c", "__p", "l")
