"""Operators on cuts: rows of (id, start, duration, channel, supervisions, recording, features, custom).

Everything here is a projection or an explode over one row with higher-order functions,
so nothing is shuffled; supervisions are relative to the cut's start, as in manifests.
Derived ids come from the parent's id and the operation, never at random, so a repeated
task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtile.functions.text import merged_with_delimiter
from voxtile.functions.timeops import _c, extended_span, num_frames, num_samples, perturbed_samples, r8, uniform, window_count

SUPS = "supervisions"


def sup_end(s: Column) -> Column:
    return r8(s["start"] + s["duration"])


def shifted(s: Column, offset) -> Column:
    return s.withField("start", r8(s["start"] + _c(offset)))


def sorted_by_start(sups: Column) -> Column:
    """Segments in order of start, then id."""
    return F.transform(
        F.array_sort(F.transform(sups, lambda s: F.struct(s["start"].alias("a"), s["id"].alias("b"), s.alias("s")))), lambda x: x["s"]
    )


def _span_overlaps(start: Column, end: Column, s: Column) -> Column:
    return F.coalesce((s["start"] < end) & (sup_end(s) > start), F.lit(False))


def _span_holds(start: Column, end: Column, s: Column, tolerance: float = 1e-3) -> Column:
    return F.coalesce((s["start"] >= start - tolerance) & (sup_end(s) <= end + tolerance), F.lit(False))


def truncate(
    df: DataFrame, offset=0.0, duration=None, keep_excessive: bool = True, preserve_id: bool = False, suffix: Column | None = None
) -> DataFrame:
    """The span [offset, offset + duration) of each cut, clipped at its end.

    Segments that overlap it (or only those it holds) are kept whole and re-based. A cut
    that starts at or beyond its end after truncation is dropped.
    """
    off = _c(offset)
    room = F.col("duration") - off
    dur = r8(room if duration is None else F.least(_c(duration), room))
    zero = F.lit(0.0)
    # evaluate the new span once: the segments' predicate refers to it row by row
    df = df.withColumn("__off", off).withColumn("__dur", dur).where("__dur > 0")
    keep = (lambda s: _span_overlaps(zero, F.col("__dur"), s)) if keep_excessive else (lambda s: _span_holds(zero, F.col("__dur"), s))
    sups = sorted_by_start(F.filter(F.transform(F.col(SUPS), lambda s: shifted(s, -F.col("__off"))), keep))
    new_id = F.col("id") if preserve_id else F.concat("id", suffix if suffix is not None else F.format_string("-t%d", F.round(F.col("__off") * 1000).cast("long")))
    return (
        df.withColumn(SUPS, sups)
        .withColumn("id", new_id)
        .withColumn("start", r8(F.col("start") + F.col("__off")))
        .withColumn("duration", F.col("__dur"))
        .drop("__off", "__dur")
    )


def truncate_to(df: DataFrame, max_duration: float, offset_type: str = "start", keep_excessive: bool = True, seed: int = 0) -> DataFrame:
    """Longer cuts become ``max_duration`` long, from the start, the end or a random place; others stay."""
    spare = F.col("duration") - max_duration
    off = {"start": F.lit(0.0), "end": spare, "random": spare * uniform("id", seed)}[offset_type]
    long = truncate(df.where(F.col("duration") > max_duration), r8(off), max_duration, keep_excessive, preserve_id=True)
    return long.unionByName(df.where(F.col("duration") <= max_duration))


def cut_into_windows(df: DataFrame, duration: float, hop: float | None = None, keep_excessive: bool = True) -> DataFrame:
    """Tumbling or sliding windows of each cut, ids ``{id}-{i}``; the last may be shorter."""
    hop = duration if hop is None else hop
    n = window_count("duration", duration, hop)
    wide = df.where("duration > 0").withColumn("__i", F.explode(F.sequence(F.lit(0), n - 1)))
    out = truncate(wide, r8(F.col("__i") * hop), duration, keep_excessive, suffix=F.concat(F.lit("-"), F.col("__i").cast("string")))
    return out.drop("__i")


def balanced_window(duration: Column, low: int, high: int, overlap: float = 0.0) -> Column:
    """The whole number of seconds in [low, high] that makes the last window longest; the first such."""
    def last_len(w: Column) -> Column:
        hop = w - overlap
        n = window_count(duration, w, hop)
        return r8(duration - (n - 1) * hop)

    scored = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda w: F.struct((-last_len(w)).alias("k"), w.alias("w")))
    return F.array_min(scored)["w"]


def cut_into_windows_balanced(df: DataFrame, low: int, high: int, overlap: float = 0.0, keep_excessive: bool = True) -> DataFrame:
    """Windows of one whole length in [low, high] per cut, chosen so that the last is as long as can be; cuts up to ``high`` pass."""
    long = df.where(F.col("duration") > high).withColumn("__w", balanced_window(F.col("duration"), low, high, overlap))
    hop = F.col("__w") - overlap
    long = long.withColumn("__i", F.explode(F.sequence(F.lit(0), window_count("duration", F.col("__w"), hop) - 1)))
    out = truncate(long, r8(F.col("__i") * hop), F.col("__w").cast("double"), keep_excessive, suffix=F.concat(F.lit("-"), F.col("__i").cast("string")))
    return out.drop("__w", "__i").unionByName(df.where(F.col("duration") <= high))


def split_at(df: DataFrame, timestamp) -> DataFrame:
    """Two cuts of each, before and after a time inside it."""
    t = _c(timestamp)
    inside = df.where((t > 0) & (t < F.col("duration")))
    return truncate(inside, 0.0, t, suffix=F.lit("-left")).unionByName(truncate(inside, t, None, suffix=F.lit("-right")))


def trim_to_supervisions(
    df: DataFrame, keep_overlapping: bool = True, min_duration: float | None = None, direction: str = "center", keep_all_channels: bool = False, seed: int = 0
) -> DataFrame:
    """A cut per segment, with context up to ``min_duration``; with one segment left the cut takes its id.

    Segments without a start or without a positive duration give no cut.
    """
    wide = df.select("*", F.posexplode(SUPS).alias("__k", "__s")).where("__s.start is not null and __s.duration > 0")
    if min_duration is None:
        start, dur = F.col("__s.start"), F.col("__s.duration")
    else:
        start, dur = extended_span(F.col("__s.start"), F.col("__s.duration"), min_duration, direction, seed, F.col("__s.id"))
    if not keep_overlapping:
        wide = wide.withColumn(SUPS, F.array("__s"))
    clip = F.greatest(start, F.lit(0.0))
    out = truncate(wide, clip, dur - (clip - start), True, suffix=F.concat(F.lit("-"), F.col("__k").cast("string")))
    out = out.withColumn("id", F.when(F.size(SUPS) == 1, F.col(SUPS)[0]["id"]).otherwise(F.col("id")))
    if not keep_all_channels:
        out = out.withColumn("channel", F.coalesce(F.try_element_at(F.col("__s.channel"), F.lit(1)), F.col("channel")))
    return out.drop("__k", "__s")


def pause_groups(sups: Column, max_pause: float) -> Column:
    """Groups of segments in order: a new one opens where the start is more than ``max_pause`` after all earlier ends."""
    empty = F.expr("cast(array() as array<struct<start:double,end:double>>)")

    def step(groups: Column, s: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joins = last.isNotNull() & (s["start"] - last["end"] <= max_pause)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], sup_end(s)).alias("end"))
        fresh = F.struct(s["start"].cast("double").alias("start"), sup_end(s).alias("end"))
        return F.when(joins, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(grown))).otherwise(F.concat(groups, F.array(fresh)))

    valid = F.filter(sups, lambda s: s["start"].isNotNull() & s["duration"].isNotNull())
    return F.aggregate(sorted_by_start(valid), empty, step)


def trim_to_supervision_groups(df: DataFrame, max_pause: float = 0.0) -> DataFrame:
    """A cut per group of segments with pauses up to ``max_pause``; cuts without segments stay."""
    grouped = df.withColumn("__g", pause_groups(F.col(SUPS), max_pause))
    none = grouped.where(F.size("__g") <= 0).drop("__g")
    wide = grouped.select("*", F.posexplode("__g").alias("__k", "__span")).where("__span.end > __span.start")
    start = F.greatest(F.col("__span.start"), F.lit(0.0))
    suffix = F.concat(F.lit(f"-{max_pause:g}-"), F.col("__k").cast("string"))
    out = truncate(wide, start, F.col("__span.end") - start, True, suffix=suffix)
    return out.drop("__g", "__k", "__span").unionByName(none)


def _sweep(sups: Column, duration: Column) -> Column:
    """Pieces of [0, duration) between neighbouring boundaries with the number of segments in each."""
    clipped = F.filter(
        F.transform(sups, lambda s: F.struct(F.greatest(s["start"], F.lit(0.0)).alias("a"), F.least(sup_end(s), duration).alias("b"))), lambda x: x["a"] < x["b"]
    )
    edges = F.array_sort(F.array_distinct(F.flatten(F.array(F.array(F.lit(0.0), duration), F.transform(clipped, lambda x: x["a"]), F.transform(clipped, lambda x: x["b"])))))
    spans = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.size(F.filter(clipped, lambda x: (x["a"] < p["end"]) & (x["b"] > p["start"]))).alias("n")))


def spans_with_count(df: DataFrame, low: int = 0, high: int | None = None) -> Column:
    """Array of (start, end): merged stretches of a cut in which low to high segments are active. Segments are clipped to the cut first."""
    pieces = F.filter(_sweep(F.col(SUPS), F.col("duration")), lambda p: (p["n"] >= low) & (p["n"] <= (high if high is not None else 2**31 - 1)))
    empty = F.expr("cast(array() as array<struct<start:double,end:double>>)")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array(F.struct(last["start"].alias("start"), p["end"].alias("end")))
        fresh = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end")))
        return F.when(last.isNotNull() & (last["end"] == p["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.concat(acc, fresh))

    return F.aggregate(pieces, empty, step)


def trim_to_unsupervised(df: DataFrame) -> DataFrame:
    """A cut per stretch without any segment."""
    wide = df.withColumn("__u", spans_with_count(df, 0, 0)).select("*", F.posexplode("__u").alias("__k", "__span"))
    out = truncate(wide, F.col("__span.start"), F.col("__span.end") - F.col("__span.start"), True, suffix=F.concat(F.lit("-u"), F.col("__k").cast("string")))
    return out.withColumn(SUPS, F.filter(SUPS, lambda s: F.lit(False))).drop("__u", "__k", "__span")


def alignment_groups(items: Column, max_pause: float, max_duration: float) -> Column:
    """Alignment items in order, merged while the pause and the merged span stay within bounds; blank symbols are skipped but for the first."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("start"), r8(x["start"] + x["duration"]).alias("end"), x["symbol"].alias("symbol"))))
    empty = F.expr("cast(array() as array<struct<start:double,end:double,symbols:array<string>>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (x["start"] - last["end"] <= max_pause) & (x["end"] - last["start"] <= max_duration)
        grown = F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"), F.concat(last["symbols"], F.array(x["symbol"])).alias("symbols")))
        fresh = F.array(F.struct(x["start"].cast("double").alias("start"), x["end"].alias("end"), F.array(x["symbol"]).alias("symbols")))
        blank = last.isNotNull() & (F.trim(F.coalesce(x["symbol"], F.lit(""))) == "")
        return F.when(blank, acc).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.concat(acc, fresh))

    return F.aggregate(ordered, empty, step)


def has_overlapping_supervisions() -> Column:
    """Whether two neighbours in order of start overlap."""
    ordered = sorted_by_start(F.col(SUPS))
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.size(ordered)), lambda a, b: sup_end(a) > b["start"])
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def trimmed_supervisions() -> Column:
    """Segments clipped to the cut; those left without a length are dropped."""
    def clip(s: Column) -> Column:
        a, b = F.greatest(s["start"], F.lit(0.0)), F.least(sup_end(s), F.col("duration"))
        return s.withField("start", a).withField("duration", r8(b - a))

    return F.filter(F.transform(SUPS, clip), lambda s: s["duration"] > 0)


def next_start_clipped() -> Column:
    """Segments whose end is clipped to the next one's start."""
    ordered = sorted_by_start(F.col(SUPS))
    following = F.slice(F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(F.lit(None))), 1, F.greatest(F.size(ordered), F.lit(0)))
    following = F.transform(following, lambda s: s["start"])
    return F.zip_with(ordered, following, lambda s, nxt: s.withField("duration", F.when(nxt.isNotNull() & (sup_end(s) > nxt), r8(nxt - s["start"])).otherwise(s["duration"])))


def extend_by(df: DataFrame, seconds: float, direction: str = "both") -> DataFrame:
    """Wider cuts within the bounds of their recording; segments are re-based. What a bound cuts off is told in pad_left and pad_right."""
    left, right = direction in ("left", "both"), direction in ("right", "both")
    end = F.col("start") + F.col("duration")
    limit = F.coalesce("recording.duration", end)
    start = F.greatest(F.col("start") - seconds, F.lit(0.0)) if left else F.col("start")
    stop = F.greatest(end, F.least(end + seconds, limit)) if right else end
    df = df.withColumn("__a", r8(start)).withColumn("__b", r8(stop))
    df = df.withColumn("pad_left", r8(F.lit(seconds) - (F.col("start") - F.col("__a"))) if left else F.lit(0.0))
    df = df.withColumn("pad_right", r8(F.lit(seconds) - (F.col("__b") - end)) if right else F.lit(0.0))
    return (
        df.withColumn(SUPS, F.transform(SUPS, lambda s: shifted(s, F.col("start") - F.col("__a"))))
        .withColumn("start", F.col("__a"))
        .withColumn("duration", r8(F.col("__b") - F.col("__a")))
        .drop("__a", "__b")
    )


def perturb_speed(df: DataFrame, factor: float, affix_id: bool = True, kind: str = "sp") -> DataFrame:
    """Metadata of a speed (``sp``) or tempo (``tp``) change: times rescaled on the sample grid, ids affixed, features dropped."""
    sr = F.col("recording.sampling_rate")
    rescale = lambda t: perturbed_samples(num_samples(t, sr), factor) / sr
    tag = F.lit(f"_{kind}{factor:g}")
    named = lambda c: F.concat(c, tag) if affix_id else c
    sups = F.transform(
        SUPS, lambda s: s.withField("start", rescale(s["start"])).withField("duration", rescale(s["duration"])).withField("id", named(s["id"])).withField("recording_id", named(s["recording_id"]))
    )
    rec = F.col("recording").withField("duration", rescale(F.col("recording.duration"))).withField("id", named(F.col("recording.id")))
    out = df.where(sr.isNotNull()).withColumn("__start", rescale(F.col("start"))).withColumn("__dur", rescale(F.col("duration")))
    out = out.withColumn(SUPS, sups).withColumn("recording", rec).withColumn("start", F.col("__start")).withColumn("duration", F.col("__dur"))
    out = out.drop("__start", "__dur")
    if "features" in out.columns:
        out = out.withColumn("features", F.lit(None).cast(df.schema["features"].dataType))
    return out.withColumn("id", named(F.col("id")))


def perturb_volume(df: DataFrame, factor: float, affix_id: bool = True) -> DataFrame:
    """Only ids change: ``_vp{factor}``."""
    tag = F.lit(f"_vp{factor:g}")
    if not affix_id:
        return df
    sups = F.transform(SUPS, lambda s: s.withField("id", F.concat(s["id"], tag)).withField("recording_id", F.concat(s["recording_id"], tag)))
    return df.withColumn(SUPS, sups).withColumn("id", F.concat("id", tag))


def affixed(df: DataFrame, tag: str) -> DataFrame:
    """Ids of cuts and segments with a suffix, as narrowband (``_nb_x``), reverberation (``_rvb``) and the like give them."""
    sups = F.transform(SUPS, lambda s: s.withField("id", F.concat(s["id"], F.lit(tag))))
    return df.withColumn(SUPS, sups).withColumn("id", F.concat("id", F.lit(tag)))


def resample(df: DataFrame, sampling_rate: int) -> DataFrame:
    """The recording at another rate; features are dropped; times stay."""
    out = df.withColumn("recording", F.when(F.col("recording").isNotNull(), F.col("recording").withField("sampling_rate", F.lit(sampling_rate))))
    return out.withColumn("features", F.lit(None).cast(df.schema["features"].dataType)) if "features" in out.columns else out


def merge_supervisions(df: DataFrame, policy: str = "delimiter", span: str = "last") -> DataFrame:
    """At most one segment per cut: ids and speakers joined (or the first kept), texts joined by spaces.

    ``span='last'``: it ends with the last-starting segment; ``'max'``: with the latest end.
    """
    ordered = sorted_by_start(F.col(SUPS))
    first, last = ordered[0], F.element_at(ordered, -1)
    end = sup_end(last) if span == "last" else F.array_max(F.transform(ordered, sup_end))
    only = policy != "delimiter"
    merged = first
    for name in ("id", "recording_id", "speaker", "language", "gender"):
        if name in _fields(df):
            values = F.transform(ordered, _getter(name))
            merged = merged.withField(name, first[name] if name == "recording_id" else merged_with_delimiter(values, first_only=only))
    merged = merged.withField("text", F.nullif(F.array_join(F.transform(ordered, lambda s: s["text"]), " "), F.lit("")))
    merged = merged.withField("duration", r8(end - first["start"]))
    return df.withColumn(SUPS, F.when(F.size(SUPS) > 1, F.array(merged)).otherwise(F.col(SUPS)))


def _getter(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]


def _fields(df: DataFrame) -> list[str]:
    return df.schema[SUPS].dataType.elementType.fieldNames()


def filter_supervisions(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Keeps the segments that satisfy the predicate; cuts stay even without any."""
    return df.withColumn(SUPS, F.filter(SUPS, predicate))


def map_supervisions(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(SUPS, F.transform(SUPS, fn))


def transform_text(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return map_supervisions(df, lambda s: s.withField("text", fn(s["text"])))


def modify_ids(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("id", fn(F.col("id")))


def fill_supervisions(df: DataFrame, add_empty: bool = True, shrink_ok: bool = False) -> DataFrame:
    """One segment over the whole cut: stretched where there is one, empty where there is none; several are an error."""
    kind = df.schema[SUPS].dataType.elementType
    blank = F.struct(*[
        {"id": F.col("id"), "recording_id": F.col("recording.id"), "start": F.lit(0.0), "duration": F.col("duration")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in kind
    ])
    one = F.col(SUPS)[0]
    shrinks = (one["start"] < 0) | (sup_end(one) > F.col("duration"))
    stretched = F.array(one.withField("start", F.lit(0.0)).withField("duration", F.col("duration")))
    if not shrink_ok:
        stretched = F.when(shrinks, F.raise_error(F.concat(F.lit("a segment would shrink in "), "id"))).otherwise(stretched)
    n = F.size(SUPS)
    return df.withColumn(SUPS, F.when(n > 1, F.raise_error(F.concat(F.lit("several segments in "), "id"))).when(n == 1, stretched).otherwise(F.array(blank) if add_empty else F.col(SUPS)))


def drop_parts(df: DataFrame, *parts: str) -> DataFrame:
    """Nulls features or recording, or empties supervisions."""
    for p in parts:
        df = df.withColumn(p, F.filter(p, lambda s: F.lit(False)) if p == SUPS else F.lit(None).cast(df.schema[p].dataType))
    return df


def with_path_prefix(df: DataFrame, column: str, field: str, prefix: str) -> DataFrame:
    """A storage path inside a struct column, or inside an array of structs, under a prefix."""
    join = lambda c: F.concat_ws("/", F.lit(prefix.rstrip("/")), c)
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumn(column, F.transform(column, lambda s: s.withField(field, join(s[field]))))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column).withField(field, join(F.col(column)[field]))))


def with_custom(df: DataFrame, name: str, value: Column | None) -> DataFrame:
    """Sets (or with None removes) one custom attribute."""
    base = F.coalesce(F.col("custom"), F.expr("cast(map() as map<string,string>)"))
    without = F.map_filter(base, lambda k, v: k != name)
    return df.withColumn("custom", without if value is None else F.map_concat(without, F.create_map(F.lit(name), value.cast("string"))))


def supervision_frames(df: DataFrame, frame_shift: float) -> DataFrame:
    """(cut_id, sup_id, first_frame, n_frames): segments on the frame grid, clipped to the cut's frames."""
    sr = F.col("recording.sampling_rate")
    wide = df.where(sr.isNotNull()).select("id", "duration", "recording", F.explode(SUPS).alias("s")).where("s.start is not null and s.duration is not null")
    total = num_frames(F.col("duration"), frame_shift, sr)
    start = F.greatest(F.when(F.col("s.start") > 0, num_frames(F.col("s.start"), frame_shift, sr)).otherwise(F.lit(0)), F.lit(0))
    n = num_frames(F.col("s.duration"), frame_shift, sr)
    return wide.select(F.col("id").alias("cut_id"), F.col("s.id").alias("sup_id"), start.cast("long").alias("first_frame"), F.greatest(F.least(n, total - start), F.lit(0)).cast("long").alias("n_frames"))


def frame_mask(df: DataFrame, frame_shift: float) -> Column:
    """array<int> per cut: 1 for frames that a segment covers; bounds round half to even."""
    sr = F.coalesce("recording.sampling_rate", F.lit(16000))
    total = num_frames(F.col("duration"), frame_shift, sr)
    spans = F.transform(trimmed_supervisions(), lambda s: F.struct(F.rint(s["start"] / frame_shift).cast("long").alias("a"), F.rint(sup_end(s) / frame_shift).cast("long").alias("b")))
    return F.transform(F.sequence(F.lit(0).cast("long"), total - 1), lambda i: F.exists(spans, lambda x: (x["a"] <= i) & (i < x["b"])).cast("int"))


# ---- mixed cuts: tracks of (offset, snr, cut) --------------------------------------------------------------------


def as_track(offset=0.0, snr=None, tag: str | None = None) -> Column:
    """A cut as a track of a mixed cut."""
    cut = F.struct("id", "start", "duration", "channel", SUPS)
    return F.struct(_c(offset).cast("double").alias("offset"), F.lit(snr).cast("double").alias("snr"), F.lit(tag).cast("string").alias("tag"), cut.alias("cut"))


def mixed_duration(tracks: Column) -> Column:
    return r8(F.array_max(F.transform(tracks, lambda t: t["offset"] + t["cut"]["duration"])))


def mixed_supervisions(tracks: Column) -> Column:
    """Segments of all tracks, shifted by the track's offset."""
    return F.flatten(F.transform(tracks, lambda t: F.transform(t["cut"][SUPS], lambda s: shifted(s, t["offset"]))))


def mix(left: DataFrame, right: DataFrame, key: str, offset: float = 0.0, snr: float | None = None, allow_padding: bool = False) -> DataFrame:
    """Cuts of two sets with one key overlaid: (id, duration, tracks). An offset beyond the first's end needs padding."""
    a = left.select(F.col(key).alias("__k"), F.col("id").alias("a_id"), F.col("duration").alias("a_dur"), as_track().alias("a"))
    b = right.select(F.col(key).alias("__k"), F.col("id").alias("b_id"), as_track(offset, snr).alias("b"))
    both = a.join(b, "__k")
    if not allow_padding:
        both = both.where(F.col("a_dur") >= offset)
    return both.select(F.concat("a_id", F.lit("+"), "b_id").alias("id"), F.array("a", "b").alias("tracks")).withColumn("duration", mixed_duration(F.col("tracks")))


def append_all(df: DataFrame, by: str, order: str) -> DataFrame:
    """The cuts of each group one after another as one mixed cut: (group, duration, tracks).

    Offsets are running sums of durations. A group must fit a row, like any mixed cut.
    """
    tracks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id").alias("i"), as_track().alias("t"))))
    grouped = df.groupBy(by).agg(F.transform(tracks, lambda x: x["t"]).alias("__t"))
    zero = F.expr("cast(array() as array<double>)")
    offsets = F.aggregate("__t", F.struct(zero.alias("o"), F.lit(0.0).alias("at")), lambda acc, t: F.struct(F.concat(acc["o"], F.array(acc["at"])).alias("o"), r8(acc["at"] + t["cut"]["duration"]).alias("at")), lambda acc: acc["o"])
    placed = F.zip_with("__t", offsets, lambda t, o: t.withField("offset", o))
    return grouped.select(by, placed.alias("tracks")).withColumn("duration", mixed_duration(F.col("tracks")))


def pad(df: DataFrame, duration: float | Column, direction: str = "right") -> DataFrame:
    """Cuts with silence up to a duration: pad_left, pad_right, segments shifted; longer ones stay."""
    lack = r8(F.greatest(_c(duration) - F.col("duration"), F.lit(0.0)))
    left = {"right": F.lit(0.0), "left": lack, "both": r8(lack / 2)}[direction]
    df = df.withColumn("__l", left).withColumn("__all", lack)
    return (
        df.withColumn(SUPS, F.transform(SUPS, lambda s: shifted(s, F.col("__l"))))
        .withColumn("duration", r8(F.col("duration") + F.col("__all")))
        .withColumn("pad_left", F.col("__l"))
        .withColumn("pad_right", r8(F.col("__all") - F.col("__l")))
        .drop("__l", "__all")
    )


def unmix(df: DataFrame) -> DataFrame:
    """The tracks of mixed cuts as cuts again."""
    return df.select(F.explode("tracks").alias("t")).select("t.cut.*")


def to_mono(df: DataFrame) -> DataFrame:
    """Multi-channel segments or cuts, one row per channel."""
    return df.withColumn("channel", F.explode("channel")) if df.schema["channel"].dataType.typeName() == "array" else df


def trim_to_alignments(supervisions: DataFrame, kind: str = "word", max_pause: float = 0.0, max_duration: float = 1e9, delimiter: str = " ") -> DataFrame:
    """(id, recording_id, start, duration, text): spans of alignment items merged over short pauses, ids ``{id}-{i}``."""
    items = F.try_element_at("alignment", F.lit(kind))
    wide = supervisions.where(items.isNotNull()).select("id", "recording_id", F.posexplode(alignment_groups(items, max_pause, max_duration)).alias("i", "g"))
    return wide.select(
        F.concat_ws("-", "id", F.col("i").cast("string")).alias("id"), "recording_id", F.col("g.start").alias("start"),
        r8(F.col("g.end") - F.col("g.start")).alias("duration"), F.array_join("g.symbols", delimiter).alias("text"),
    )


def speaker_masks(df: DataFrame, frame_shift: float) -> DataFrame:
    """(id, speaker, mask): frames in which each speaker of a cut is active, speakers in code point order."""
    sr = F.coalesce("recording.sampling_rate", F.lit(16000))
    total = num_frames(F.col("duration"), frame_shift, sr)
    clipped = F.filter(trimmed_supervisions(), lambda s: s["speaker"].isNotNull())
    who = F.array_sort(F.array_distinct(F.transform(clipped, lambda s: s["speaker"])))
    wide = df.withColumn("__c", clipped).select("*", F.explode(who).alias("speaker"))
    spans = F.transform(F.filter("__c", lambda s: s["speaker"] == F.col("speaker")), lambda s: F.struct(F.rint(s["start"] / frame_shift).cast("long").alias("a"), F.rint(sup_end(s) / frame_shift).cast("long").alias("b")))
    mask = F.transform(F.sequence(F.lit(0).cast("long"), total - 1), lambda i: F.exists(spans, lambda x: (x["a"] <= i) & (i < x["b"])).cast("int"))
    return wide.select("id", "speaker", mask.alias("mask"))


def perturb_mixed(df: DataFrame, factor: float, sampling_rate: int, kind: str = "sp") -> DataFrame:
    """Mixed cuts (id, tracks, duration) at another speed or tempo: offsets, spans and segments of all tracks rescaled, ids affixed."""
    scaled = lambda t: perturbed_samples(num_samples(t, F.lit(sampling_rate)), factor) / sampling_rate
    tag = F.lit(f"_{kind}{factor:g}")

    def seg(s: Column) -> Column:
        return s.withField("start", scaled(s["start"])).withField("duration", scaled(s["duration"])).withField("id", F.concat(s["id"], tag))

    def track(t: Column) -> Column:
        cut = t["cut"].withField("start", scaled(t["cut"]["start"])).withField("duration", scaled(t["cut"]["duration"])).withField("id", F.concat(t["cut"]["id"], tag))
        return t.withField("offset", scaled(t["offset"])).withField("cut", cut.withField(SUPS, F.transform(t["cut"][SUPS], seg)))

    out = df.withColumn("tracks", F.transform("tracks", track)).withColumn("id", F.concat("id", tag))
    return out.withColumn("duration", mixed_duration(F.col("tracks")))


def map_mixed_supervisions(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """The segments of all tracks mapped."""
    return df.withColumn("tracks", F.transform("tracks", lambda t: t.withField("cut", t["cut"].withField(SUPS, F.transform(t["cut"][SUPS], fn)))))


def filter_mixed_supervisions(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("tracks", F.transform("tracks", lambda t: t.withField("cut", t["cut"].withField(SUPS, F.filter(t["cut"][SUPS], predicate)))))
