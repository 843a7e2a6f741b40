"""Queries of the manifest operators over the driver's tables, each with the SQL that must agree.

Times go out as whole microseconds, sums as 64-bit integers, averages rounded to 6 digits.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtile.functions import text as T
from voxtile.functions import timeops as O
from voxtile.operators import batching as B
from voxtile.operators import cuts as C
from voxtile.operators import dataset as D
from voxtile.operators import joins as J
from voxtile.operators import qa as Q
from voxtile.operators import stats as S
from voxtile.session import SEGMENT_FIELDS, first_delivery, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


sup, audio, cuts, feats, docs = (_t(n) for n in ("supervision", "audio", "cuts", "features", "documents"))
us = O.to_us


def us_sql(x: str) -> str:
    return f"CAST(round(({x}) * 1000000.0) AS BIGINT)"


def _unique(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of each key: of rows that differ the least by its text, the same in every run."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.to_json(F.struct(*df.columns))).alias("__r")).select("__r.*")


def _cut_rows(df: DataFrame) -> DataFrame:
    """(id, start_us, duration_us, n_sups, sup_ids, first_us) of cuts."""
    return df.select(
        "id", us("start").alias("start_us"), us("duration").alias("duration_us"), F.greatest(F.size("supervisions"), F.lit(0)).cast("long").alias("n_sups"),
        F.array_join(F.transform("supervisions", lambda s: s["id"]), ",").alias("sup_ids"),
    )


#: Cuts with a row number, and their segments; spans are rounded to 8 digits as in the operators.
CUTS = """WITH c AS (SELECT row_number() OVER () AS rid, * FROM cuts),
s AS (SELECT rid, unnest(supervisions) AS s FROM c),
seg AS (SELECT rid, s.id AS sid, s.start AS st, s.duration AS du, round(s.start + s.duration, 8) AS en, s.speaker AS speaker, s.text AS text, s.channel AS channel FROM s)"""


def _spans_sql(spans: str, offset_col: str = "off", keep: str = "round(g.st - p.off, 8) < p.dur AND round(round(g.st - p.off, 8) + g.du, 8) > 0") -> str:
    """Segments of spans p(rid, nid, off, dur): the SQL of truncation."""
    return f"""{CUTS}, p AS ({spans}),
k AS (SELECT p.rid, p.nid, p.off, p.dur, g.sid, round(g.st - p.off, 8) AS st FROM p LEFT JOIN seg g ON g.rid = p.rid AND {keep})
SELECT k.nid AS id, {us_sql('round(c.start + k.off, 8)')} AS start_us, {us_sql('k.dur')} AS duration_us, count(k.sid) AS n_sups,
       coalesce(string_agg(k.sid, ',' ORDER BY k.st, k.sid), '') AS sup_ids
FROM k JOIN c ON c.rid = k.rid GROUP BY k.rid, k.nid, k.off, k.dur, c.start"""


# ---- projection, filter, text ------------------------------------------------------------------------------------


@query(f"SELECT id, {us_sql('duration')} AS duration_us FROM supervision WHERE duration > 5 AND text IS NOT NULL")
def manifest_filter(spark, d):
    return sup(spark, d).where("duration > 5 and text is not null").select("id", us("duration").alias("duration_us"))


@query("SELECT 'x-' || id AS id, len(supervisions) AS n FROM cuts")
def manifest_map_ids(spark, d):
    return C.modify_ids(cuts(spark, d), lambda c: F.concat(F.lit("x-"), c)).select("id", F.size("supervisions").cast("long").alias("n"))


@query("SELECT id, coalesce(len(list_filter(supervisions, lambda s: s.duration > 2.0)), 0) AS n FROM cuts")
def nested_filter_segments(spark, d):
    return C.filter_supervisions(cuts(spark, d), lambda s: F.coalesce(s["duration"] > 2.0, F.lit(False))).select("id", F.size("supervisions").cast("long").alias("n"))


@query("""SELECT id, unnest(list_transform(supervisions, lambda s: replace(coalesce(lower(s.text), '?'), 'ς', 'σ'))) AS text FROM cuts""")
def nested_map_text(spark, d):
    return C.transform_text(cuts(spark, d), F.lower).select("id", F.explode(F.transform("supervisions", lambda s: F.translate(F.coalesce(s["text"], F.lit("?")), "ς", "σ"))).alias("text"))  # engines differ on the last sigma


_AMI = "trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9'']+', ' ', 'g'))"


@query(f"""SELECT id, trim(regexp_replace(replace(replace({_AMI}, 'MM HMM', 'MM-HMM'), 'UH HUH', 'UH-HUH'), '\\bO[ _]K\\b', 'OK', 'g')) AS text
FROM supervision WHERE text IS NOT NULL""")
def text_ami_kaldi(spark, d):
    return sup(spark, d).where("text is not null").select("id", T.ami(F.col("text"), "kaldi").alias("text"))


_ALI = "text"
for _token in T.MEETING_TOKENS:
    _ALI = f"replace({_ALI}, '{_token}', '')"
_ALI = f"translate({_ALI}, '`&,', '')"


@query(f"""WITH x AS (SELECT id, {_ALI} AS t FROM supervision WHERE text IS NOT NULL)
SELECT id, translate(CASE WHEN regexp_matches(t, '[a-zA-Z]') THEN upper(replace(t, 'ß', 'SS')) ELSE t END, 'Ａａｂｃｋｔ，丶。、？', 'AABCKT') AS text FROM x""")
def text_alimeeting(spark, d):
    return sup(spark, d).where("text is not null").select("id", T.alimeeting(F.col("text")).alias("text"))


@query(r"""SELECT id, CASE WHEN text LIKE '%[redacted]%' THEN '' ELSE
replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[.?,:;!]', '', 'g'), '\s+', ' ', 'g'), '\[inaudible[- 0-9]*\]', '[inaudible]', 'g'), ' - ', ' '), 'mm-', 'mm'), 'ς', 'σ') END AS text
FROM supervision WHERE text IS NOT NULL""")
def text_chime6_kaldi(spark, d):
    return sup(spark, d).where("text is not null").select("id", F.translate(T.chime6(F.col("text"), "kaldi"), "ς", "σ").alias("text"))  # engines differ on the last sigma


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '\[[^\]]+\]', '', 'g'), '<unk>', ''), '(\w+) ''(\w+)', '\1''\2', 'g'), ''' (\w+)', '''\1', 'g')) AS text
FROM supervision WHERE text IS NOT NULL""")
def text_tedlium_kaldi(spark, d):
    return sup(spark, d).where("text is not null").select("id", T.tedlium(F.col("text"), "kaldi").alias("text"))


@query("""WITH x AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM supervision WHERE text IS NOT NULL)
SELECT token, 3 + row_number() OVER (ORDER BY token) AS token_id FROM x WHERE token <> ''
UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<bos>', 2), ('<eos>', 3)) v(token, token_id)""")
def character_vocabulary(spark, d):
    return T.vocabulary(sup(spark, d), "text")


@query("""SELECT id, {'a': 1}.a AS one, coalesce(custom['take'], 'x') AS take, coalesce(cardinality(map_keys(custom)), 0) AS n FROM supervision""".replace("{'a': 1}.a", "1"))
def custom_attributes(spark, d):
    s = sup(spark, d)
    return s.select("id", F.lit(1).alias("one"), F.coalesce(F.try_element_at("custom", F.lit("take")), F.lit("x")).alias("take"), F.coalesce(F.when(F.col("custom").isNotNull(), F.size("custom")), F.lit(0)).cast("long").alias("n"))


@query(f"""{CUTS}, n AS (SELECT rid, count(*) AS n, min(sid) AS only_id FROM seg GROUP BY rid)
SELECT c.id, coalesce(n.n, 0) AS n_before, CASE WHEN n.n = 1 THEN {us_sql('c.duration')} END AS filled_us FROM c LEFT JOIN n ON n.rid = c.rid""")
def fill_segments(spark, d):
    c = cuts(spark, d).withColumn("n_before", F.size("supervisions").cast("long"))
    filled = C.fill_supervisions(c.where("n_before <= 1"), add_empty=False, shrink_ok=True).select("id", "n_before", us(F.col("supervisions")[0]["duration"]).alias("filled_us"))
    return filled.unionByName(c.where("n_before > 1").select("id", "n_before", F.lit(None).cast("long").alias("filled_us")))


# ---- windows and spans -------------------------------------------------------------------------------------------


def _windows_sql(size: float, hop: float) -> str:
    n = f"CASE WHEN duration <= 0 THEN 0 ELSE ceil(greatest(duration - {size}, 0) / {hop}) + CASE WHEN duration - ceil(greatest(duration - {size}, 0) / {hop}) * {hop} > 0 THEN 1 ELSE 0 END END"
    return f"""SELECT rid, id || '-' || i AS nid, round(i * {hop}, 8) AS off, round(least({size}, duration - round(i * {hop}, 8)), 8) AS dur
    FROM (SELECT rid, id, duration, unnest(range(0, CAST({n} AS BIGINT))) AS i FROM c) WHERE round(least({size}, duration - round(i * {hop}, 8)), 8) > 0"""


@query(_spans_sql(_windows_sql(5.0, 5.0)))
def windows_tumbling(spark, d):
    return _cut_rows(C.cut_into_windows(cuts(spark, d), 5.0))


@query(_spans_sql(_windows_sql(5.0, 2.5)))
def windows_sliding(spark, d):
    return _cut_rows(C.cut_into_windows(cuts(spark, d), 5.0, 2.5))


@query(_spans_sql(_windows_sql(5.0, 5.0), keep="round(g.st - p.off, 8) >= -0.001 AND round(round(g.st - p.off, 8) + g.du, 8) <= p.dur + 0.001"))
def windows_contained(spark, d):
    return _cut_rows(C.cut_into_windows(cuts(spark, d), 5.0, keep_excessive=False))


@query(_spans_sql("SELECT rid, id || '-t1000' AS nid, 1.0 AS off, round(least(4.0, duration - 1.0), 8) AS dur FROM c WHERE duration > 1"))
def truncate_span(spark, d):
    return _cut_rows(C.truncate(cuts(spark, d), 1.0, 4.0))


@query(_spans_sql("SELECT rid, id AS nid, round(CASE WHEN duration > 6 THEN duration - 6.0 ELSE 0.0 END, 8) AS off, CASE WHEN duration > 6 THEN 6.0 ELSE duration END AS dur FROM c", keep="(c2.duration <= 6 OR (round(g.st - p.off, 8) < p.dur AND round(round(g.st - p.off, 8) + g.du, 8) > 0))").replace("LEFT JOIN seg g ON g.rid = p.rid AND", "LEFT JOIN c c2 ON c2.rid = p.rid LEFT JOIN seg g ON g.rid = p.rid AND").replace("string_agg(k.sid, ',' ORDER BY k.st, k.sid)", "string_agg(k.sid, ',' ORDER BY k.sid)"))
def truncate_end(spark, d):
    out = C.truncate_to(cuts(spark, d), 6.0, "end")
    return _cut_rows(out.withColumn("supervisions", F.array_sort(F.transform("supervisions", lambda s: F.struct(s["id"].alias("id"))))))


@query()
def windows_balanced(spark, d):
    return _cut_rows(C.cut_into_windows_balanced(cuts(spark, d), 8, 12, 1.0))


@query(f"""{CUTS}, g AS (SELECT rid, sid, st, du, en, row_number() OVER (PARTITION BY rid) AS k FROM seg),
p AS (SELECT c.rid, g.sid, g.k AS gk, greatest(g.st, 0.0) AS off, round(least(round(g.du - (greatest(g.st, 0.0) - g.st), 18), c.duration - greatest(g.st, 0.0)), 8) AS dur, c.start AS cs
      FROM c JOIN g ON g.rid = c.rid WHERE g.st IS NOT NULL AND g.du > 0),
k AS (SELECT p.*, h.sid AS hid FROM p LEFT JOIN seg h ON h.rid = p.rid AND round(h.st - p.off, 8) < p.dur AND round(round(h.st - p.off, 8) + h.du, 8) > 0 WHERE p.dur > 0)
SELECT sid, {us_sql('round(cs + off, 8)')} AS start_us, {us_sql('dur')} AS duration_us, count(hid) AS n_sups FROM k GROUP BY rid, sid, gk, off, dur, cs""")
def trim_to_segments(spark, d):
    wide = cuts(spark, d).withColumn("custom", F.lit(None).cast("map<string,string>"))
    c = wide.withColumn("__all", F.col("supervisions"))
    out = c.select("*", F.explode("__all").alias("own")).withColumn("supervisions", F.col("__all"))
    # the segment that made each cut stays known by its own column
    trimmed = C.truncate(out.where("own.start is not null and own.duration > 0"), F.greatest(F.col("own.start"), F.lit(0.0)), F.col("own.duration") - (F.greatest(F.col("own.start"), F.lit(0.0)) - F.col("own.start")), True, suffix=F.lit(""))
    return trimmed.select(F.col("own.id").alias("sid"), us("start").alias("start_us"), us("duration").alias("duration_us"), F.size("supervisions").cast("long").alias("n_sups"))


@query(f"""{CUTS}, g AS (SELECT rid, sid, greatest(st, 0.0) AS off, du, c_dur FROM (SELECT seg.*, c.duration AS c_dur FROM seg JOIN c ON c.rid = seg.rid) WHERE st IS NOT NULL AND du > 0)
SELECT sid AS id, {us_sql('round(least(du, c_dur - off), 8)')} AS duration_us FROM g WHERE round(least(du, c_dur - off), 8) > 0""")
def trim_to_own_segments(spark, d):
    out = C.trim_to_supervisions(cuts(spark, d), keep_overlapping=False, keep_all_channels=True)
    return out.select("id", us("duration").alias("duration_us"))


_GROUPS = f"""{CUTS}, ok AS (SELECT rid, sid, st, en FROM seg WHERE st IS NOT NULL AND du IS NOT NULL),
m AS (SELECT *, max(en) OVER (PARTITION BY rid ORDER BY st, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM ok)"""


@query(f"""{_GROUPS}, n AS (SELECT *, sum(CASE WHEN edge IS NULL OR st - edge > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY st, sid ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT c.id, {us_sql('min(n.st)')} AS start_us, {us_sql('max(n.en)')} AS end_us FROM n JOIN c ON c.rid = n.rid GROUP BY c.rid, c.id, n.k""")
def pause_groups(spark, d):
    c = cuts(spark, d).select("id", F.explode(C.pause_groups(F.col("supervisions"), 0.5)).alias("g"))
    return c.select("id", us("g.start").alias("start_us"), us("g.end").alias("end_us"))


_SWEEP = f"""{CUTS}, cl AS (SELECT seg.rid, greatest(st, 0.0) AS a, least(en, c.duration) AS b FROM seg JOIN c ON c.rid = seg.rid WHERE greatest(st, 0.0) < least(en, c.duration)),
e AS (SELECT rid, 0.0 AS t FROM c UNION SELECT rid, duration FROM c UNION SELECT rid, a FROM cl UNION SELECT rid, b FROM cl),
q AS (SELECT rid, t AS a, lead(t) OVER (PARTITION BY rid ORDER BY t) AS b FROM e),
w AS (SELECT q.rid, q.a, q.b, count(cl.a) AS n FROM q LEFT JOIN cl ON cl.rid = q.rid AND cl.a < q.b AND cl.b > q.a WHERE q.b IS NOT NULL GROUP BY q.rid, q.a, q.b)"""


@query(f"""{_SWEEP}, u AS (SELECT *, lag(b) OVER (PARTITION BY rid ORDER BY a) AS pb FROM w WHERE n >= 2),
v AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> a THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM u)
SELECT c.id, {us_sql('min(v.a)')} AS start_us, {us_sql('max(v.b)')} AS end_us FROM v JOIN c ON c.rid = v.rid GROUP BY c.rid, c.id, v.k""")
def overlapped_spans(spark, d):
    c = cuts(spark, d)
    return c.select("id", F.explode(C.spans_with_count(c, 2)).alias("g")).select("id", us("g.start").alias("start_us"), us("g.end").alias("end_us"))


@query(f"""{_SWEEP}, u AS (SELECT *, lag(b) OVER (PARTITION BY rid ORDER BY a) AS pb FROM w WHERE n = 0),
v AS (SELECT *, sum(CASE WHEN pb IS NULL OR pb <> a THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM u)
SELECT {us_sql('round(c.start + min(v.a), 8)')} AS start_us, {us_sql('round(max(v.b) - min(v.a), 8)')} AS duration_us FROM v JOIN c ON c.rid = v.rid GROUP BY c.rid, c.start, v.k
HAVING round(max(v.b) - min(v.a), 8) > 0""")
def unsegmented_spans(spark, d):
    return C.trim_to_unsupervised(cuts(spark, d)).select(us("start").alias("start_us"), us("duration").alias("duration_us"))


@query(f"""{CUTS}, n AS (SELECT *, lead(st) OVER (PARTITION BY rid ORDER BY st, sid) AS nx FROM seg WHERE st IS NOT NULL AND du IS NOT NULL)
SELECT c.id, n.sid, {us_sql('CASE WHEN nx IS NOT NULL AND en > nx THEN round(nx - st, 8) ELSE du END')} AS duration_us FROM n JOIN c ON c.rid = n.rid""")
def next_start_clip(spark, d):
    c = C.filter_supervisions(cuts(spark, d), lambda s: s["start"].isNotNull() & s["duration"].isNotNull())
    return c.select("id", F.explode(C.next_start_clipped()).alias("s")).select("id", F.col("s.id").alias("sid"), us("s.duration").alias("duration_us"))


@query(f"""{CUTS}, n AS (SELECT rid, en, lead(st) OVER (PARTITION BY rid ORDER BY st, sid) AS nx FROM seg)
SELECT c.id, coalesce(bool_or(n.en > n.nx), false) AS overlapping FROM c LEFT JOIN n ON n.rid = c.rid GROUP BY c.rid, c.id""")
def overlapping_flag(spark, d):
    return cuts(spark, d).select("id", C.has_overlapping_supervisions().alias("overlapping"))


@query(f"""SELECT id, {us_sql('round(greatest(start - 1.5, 0.0), 8)')} AS start_us,
{us_sql('round(round(greatest(start + duration, least(start + duration + 1.5, coalesce(recording.duration, start + duration))), 8) - round(greatest(start - 1.5, 0.0), 8), 8)')} AS duration_us FROM cuts""")
def extend_both(spark, d):
    return C.extend_by(cuts(spark, d), 1.5).select("id", us("start").alias("start_us"), us("duration").alias("duration_us"))


@query(f"SELECT id, {us_sql('round(duration + round(greatest(20.0 - duration, 0.0), 8), 8)')} AS duration_us, {us_sql('round(greatest(20.0 - duration, 0.0), 8)')} AS pad_us FROM cuts")
def pad_to_length(spark, d):
    return C.pad(cuts(spark, d), 20.0, "left").select("id", us("duration").alias("duration_us"), us("pad_left").alias("pad_us"))


_PERT = "CAST(round(round(round(round({t} * recording.sampling_rate, 8)) / 1.1, 8)) AS BIGINT)"


@query(f"""SELECT id || '_sp1.1' AS id, {_PERT.format(t='start')} AS start_samples, {_PERT.format(t='duration')} AS duration_samples, {_PERT.format(t='recording.duration')} AS rec_samples
FROM cuts WHERE recording.sampling_rate IS NOT NULL""")
def perturb_speed(spark, d):
    sr = F.col("recording.sampling_rate")
    out = C.perturb_speed(cuts(spark, d), 1.1)
    return out.select("id", *[F.round(F.col(c) * sr).cast("long").alias(n) for c, n in (("start", "start_samples"), ("duration", "duration_samples"), ("recording.duration", "rec_samples"))])


@query("""SELECT id, recording.id AS rec, CASE WHEN recording IS NULL THEN NULL ELSE 8000 END AS sampling_rate FROM cuts""")
def resample_meta(spark, d):
    return C.resample(cuts(spark, d), 8000).select("id", F.col("recording.id").alias("rec"), F.col("recording.sampling_rate").alias("sampling_rate"))


@query("SELECT id || '_vp2' AS id, coalesce(list_transform(supervisions, lambda s: s.id || '_vp2')[1], '') AS first_sup FROM cuts")
def perturb_volume(spark, d):
    return C.perturb_volume(cuts(spark, d), 2.0).select("id", F.coalesce(F.try_element_at(F.transform("supervisions", lambda s: s["id"]), F.lit(1)), F.lit("")).alias("first_sup"))


@query(f"""{CUTS}, o AS (SELECT rid, count(*) AS n, first(sid ORDER BY st, sid) AS a, last(sid ORDER BY st, sid) AS z, first(st ORDER BY st, sid) AS st, last(en ORDER BY st, sid) AS en,
 'cat#' || string_agg(sid, '#' ORDER BY st, sid) AS ids, string_agg(text, ' ' ORDER BY st, sid) AS text FROM seg GROUP BY rid)
SELECT c.id, CASE WHEN o.n > 1 THEN o.ids ELSE o.a END AS sup_id, {us_sql('CASE WHEN o.n > 1 THEN round(o.en - o.st, 8) ELSE (SELECT max(du) FROM seg WHERE seg.rid = c.rid) END')} AS duration_us, coalesce(o.text, '') AS text
FROM c JOIN o ON o.rid = c.rid""")
def merge_segments(spark, d):
    s = C.merge_supervisions(cuts(spark, d)).select("id", F.col("supervisions")[0].alias("s"))
    return s.where("s is not null").select("id", F.col("s.id").alias("sup_id"), us("s.duration").alias("duration_us"), F.coalesce("s.text", F.lit("")).alias("text"))


_FRAMES = "CAST(floor((round_even({t} * c.recording.sampling_rate, 0) + floor(round_even(0.01 * c.recording.sampling_rate, 0) / 2)) / round_even(0.01 * c.recording.sampling_rate, 0)) AS BIGINT)"


@query(f"""{CUTS} SELECT c.id AS cut_id, sid AS sup_id, CASE WHEN st > 0 THEN {_FRAMES.format(t='st')} ELSE 0 END AS first_frame,
greatest(least({_FRAMES.format(t='du')}, {_FRAMES.format(t='c.duration')} - CASE WHEN st > 0 THEN {_FRAMES.format(t='st')} ELSE 0 END), 0) AS n_frames
FROM seg JOIN c ON c.rid = seg.rid WHERE c.recording.sampling_rate IS NOT NULL AND st IS NOT NULL AND du IS NOT NULL""")
def segment_frames(spark, d):
    return C.supervision_frames(cuts(spark, d), 0.01)


@query()
def frame_masks(spark, d):
    c = cuts(spark, d)
    return c.select("id", F.aggregate(C.frame_mask(c, 0.01), F.lit(0), lambda a, x: a + x).alias("active"))


@query(f"""SELECT id || '-left' AS id, 2000000 AS duration_us, {us_sql('start')} AS start_us FROM cuts WHERE duration > 2
UNION ALL SELECT id || '-right', {us_sql('round(duration - 2.0, 8)')}, {us_sql('round(start + 2.0, 8)')} FROM cuts WHERE duration > 2""")
def split_in_two(spark, d):
    return C.split_at(cuts(spark, d), 2.0).select("id", us("duration").alias("duration_us"), us("start").alias("start_us"))


@query(f"""WITH c AS (SELECT DISTINCT id, recording.id AS rec, duration FROM cuts WHERE recording IS NOT NULL)
SELECT rec, {us_sql('sum(duration)')} AS duration_us, count(*) AS n_tracks FROM c GROUP BY rec""")
def append_by_recording(spark, d):
    c = _unique(cuts(spark, d).where("recording is not null")).withColumn("rec", F.col("recording.id"))
    out = C.append_all(c, "rec", "id")
    return out.select("rec", us("duration").alias("duration_us"), F.size("tracks").cast("long").alias("n_tracks"))


@query(f"""WITH a AS (SELECT DISTINCT id, recording.id AS rec, duration FROM cuts WHERE recording IS NOT NULL)
SELECT x.id || '+' || y.id AS id, {us_sql('greatest(x.duration, round(1.0 + y.duration, 8))')} AS duration_us FROM a x JOIN a y ON x.rec = y.rec WHERE x.duration >= 1.0""")
def mix_by_recording(spark, d):
    c = _unique(cuts(spark, d).where("recording is not null")).withColumn("rec", F.col("recording.id"))
    return C.mix(c, c, "rec", 1.0, 10.0).select("id", us("duration").alias("duration_us"))


# ---- joins and repair --------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT DISTINCT id, max(duration) OVER (PARTITION BY id) AS duration FROM audio)
SELECT r.id AS cut_id, s.id AS sup_id, {us_sql('s.start')} AS start_us FROM r LEFT JOIN supervision s ON s.recording_id = r.id AND s.start + s.duration <= r.duration + 0.001""")
def attach_segments(spark, d):
    rec = audio(spark, d).groupBy("id").agg(F.max("duration").alias("duration"))
    return J.attach_segments(rec, sup(spark, d).select("id", "recording_id", "start", "duration"), check_ends=True).select("cut_id", "sup_id", us("start").alias("start_us"))


@query("""WITH r AS (SELECT DISTINCT id FROM audio) SELECT r.id AS rec, count(s.recording_id) AS n
FROM r LEFT JOIN supervision s ON s.recording_id = r.id GROUP BY r.id""")
def cuts_from_manifests(spark, d):
    rec = _unique(audio(spark, d).select("id", "sampling_rate", "duration"))
    nested = J.cuts_from_manifests(rec, sup(spark, d).select("id", "recording_id", "start", "duration", "speaker"), part_s=600.0)
    return nested.groupBy(F.col("recording.id").alias("rec")).agg(F.sum(F.greatest(F.size("supervisions"), F.lit(0))).cast("long").alias("n"))


def _words(s: DataFrame) -> DataFrame:
    w = s.where("alignment is not null and recording_id is not null").select("recording_id", "channel", F.explode(F.map_values("alignment")).alias("items"))
    w = w.select("recording_id", F.try_element_at("channel", F.lit(1)).alias("channel"), F.explode("items").alias("w"))
    return w.select("recording_id", "channel", F.col("w.start").alias("w_start"), F.col("w.duration").alias("w_duration"), F.col("w.symbol").alias("symbol"))


@query(f"""WITH w AS (SELECT recording_id, unnest(flatten(map_values(alignment))) AS w FROM supervision WHERE alignment IS NOT NULL AND recording_id IS NOT NULL)
SELECT s.id AS sup_id, w.w.symbol AS symbol, {us_sql('w.w.start')} AS start_us FROM w JOIN supervision s ON s.recording_id = w.recording_id
AND w.w.start >= s.start - 0.001 AND round(w.w.start + w.w.duration, 8) <= round(s.start + s.duration, 8) + 0.001 AND round(s.start + s.duration, 8) >= s.start""")
def words_in_segments(spark, d):
    s = sup(spark, d)
    return J.words_in_segments(s, _words(s)).select("sup_id", "symbol", us("w_start").alias("start_us"))


@query(f"""WITH s AS (SELECT DISTINCT id, recording_id, {us_sql('start')} AS a, {us_sql('start + duration')} AS b FROM supervision WHERE recording_id IS NOT NULL AND duration > 0 AND start IS NOT NULL)
SELECT x.id AS id_a, y.id AS id_b, least(x.b, y.b) - greatest(x.a, y.a) AS shared_us FROM s x JOIN s y ON x.recording_id = y.recording_id AND x.id < y.id AND x.a < y.b AND y.a < x.b""")
def overlap_pairs(spark, d):
    s = sup(spark, d).where("recording_id is not null and duration > 0").select("recording_id", F.col("id").alias("id_a"), us("start").alias("l_start"), us(F.col("start") + F.col("duration")).alias("l_end")).distinct()
    right = s.select("recording_id", F.col("id_a").alias("id_b"), F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"))
    pairs = J.overlap_join(s, right, ["recording_id"], width=60_000_000).where("id_a < id_b")
    return pairs.select("id_a", "id_b", (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("shared_us"))


@query(f"""WITH f AS (SELECT DISTINCT recording_id, unnest(channels) AS channel, start AS fs, round(start + duration, 8) AS fe, storage_key FROM features WHERE recording_id IS NOT NULL AND channels IS NOT NULL),
q AS (SELECT DISTINCT id AS request_id, recording_id, channel[1] AS channel, start AS a, round(start + duration, 8) AS b FROM supervision WHERE start IS NOT NULL AND duration > 0 AND recording_id IS NOT NULL),
m AS (SELECT request_id, f.*, row_number() OVER (PARTITION BY request_id ORDER BY round(pow(a - fs, 2) + pow(b - fe, 2), 6), storage_key, fs, fe) AS k FROM q JOIN f ON f.recording_id = q.recording_id AND f.channel = q.channel
 WHERE fs - 0.05 <= a AND a < fe + 0.05 AND fe >= b - 0.05)
SELECT request_id, storage_key, {us_sql('fs')} AS start_us FROM m WHERE k = 1""")
def best_features(spark, d):
    s = sup(spark, d).where("start is not null and duration > 0 and recording_id is not null")
    req = s.select(F.col("id").alias("request_id"), "recording_id", F.try_element_at("channel", F.lit(1)).alias("channel"), F.col("start").alias("q_start"), O.end_of("start", "duration").alias("q_end")).distinct()
    return J.best_features(req, feats(spark, d)).select("request_id", "storage_key", us("f_start").alias("start_us"))


@query("SELECT id FROM supervision WHERE recording_id IN (SELECT id FROM audio)")
def semi_repair(spark, d):
    return J.present_on_both_sides(audio(spark, d), sup(spark, d))[1].select("id")


@query(f"""WITH r AS (SELECT id, max(duration) AS e FROM audio WHERE duration IS NOT NULL GROUP BY id)
SELECT s.id, {us_sql('least(s.duration, round(r.e - s.start, 8))')} AS duration_us FROM supervision s JOIN r ON r.id = s.recording_id WHERE s.start < r.e""")
def trim_to_recording(spark, d):
    # the least of a null duration and the recording's end is that end in both engines
    return J.trim_to_recordings(audio(spark, d), sup(spark, d)).select("id", us("duration").alias("duration_us"))


@query(f"""WITH u AS (SELECT DISTINCT id AS recording_id, 1.0 AS a, 20.0 AS b FROM audio)
SELECT s.id, {us_sql('greatest(s.start, u.a)')} AS start_us, {us_sql('least(round(s.start + s.duration, 8), u.b)')} AS end_us FROM supervision s JOIN u ON u.recording_id = s.recording_id
WHERE s.start < u.b AND round(s.start + s.duration, 8) > u.a AND round(s.start + s.duration, 8) > s.start""")
def scored_spans(spark, d):
    spans = audio(spark, d).select(F.col("id").alias("recording_id")).distinct().select("recording_id", F.lit(1.0).alias("r_start"), F.lit(20.0).alias("r_end"))
    return J.within_spans(sup(spark, d), spans).select("id", us("start").alias("start_us"), us("end").alias("end_us"))


@query("""SELECT recording.id AS recording_id, start, duration, list_sort(list_distinct(list(channel))) AS channels FROM cuts WHERE recording IS NOT NULL GROUP BY ALL""".replace("start, duration,", f"{us_sql('start')} AS start_us, {us_sql('duration')} AS duration_us,").replace("GROUP BY ALL", "GROUP BY recording.id, start, duration"))
def combine_channels(spark, d):
    return J.combine_channels(cuts(spark, d)).select("recording_id", us("start").alias("start_us"), us("duration").alias("duration_us"), "channels")


@query(f"""{CUTS}, r AS (SELECT sid, round(st + c.start, 8) AS st, du FROM seg JOIN c ON c.rid = seg.rid), x AS (SELECT sid, st, row_number() OVER (PARTITION BY sid ORDER BY st, du NULLS FIRST) AS k FROM r)
SELECT sid AS id, {us_sql('st')} AS start_us FROM x WHERE k = 1""")
def decompose_segments(spark, d):
    return J.decompose(cuts(spark, d))[1].select("id", us("start").alias("start_us"))


@query("""WITH s AS (SELECT row_number() OVER () AS r, id, recording_id, start, round(start + duration, 8) AS e, speaker FROM supervision WHERE recording_id IS NOT NULL AND start IS NOT NULL AND duration > 0),
n AS (SELECT *, lag(e) OVER w AS pe, lag(speaker) OVER w AS ps FROM (SELECT DISTINCT id, recording_id, start, e, speaker FROM s) WINDOW w AS (PARTITION BY recording_id ORDER BY start, id, speaker)),
g AS (SELECT CASE WHEN speaker IS NOT DISTINCT FROM ps THEN 'same_pause' WHEN x >= 0 THEN 'diff_pause' ELSE 'diff_overlap' END AS kind, CASE WHEN speaker IS NOT DISTINCT FROM ps THEN greatest(x, 0) ELSE abs(x) END AS gap
 FROM (SELECT *, CAST(round(start * 1000000.0) AS BIGINT) - CAST(round(pe * 1000000.0) AS BIGINT) AS x FROM n WHERE pe IS NOT NULL))
SELECT kind, count(*) AS n, round(sum(gap) / count(*), 3) AS mean_us FROM g GROUP BY kind""")
def pause_classes(spark, d):
    s = sup(spark, d).select("id", "recording_id", "start", "duration", "speaker").distinct()
    # of deliveries that spell the speaker differently the neighbour is the one before in code point order
    s = s.withColumn("id", F.concat_ws("\x00", "id", F.coalesce("speaker", F.lit("\U0010ffff"))))
    return S.pause_classes(J.neighbours(s))


# ---- statistics --------------------------------------------------------------------------------------------------


@query(f"""SELECT count(duration) AS n, sum({us_sql('duration')}) / 1e6 AS total, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, min(duration) AS min, max(duration) AS max,
round(quantile_cont(duration, 0.25), 6) AS p25, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.75), 6) AS p75,
round(quantile_cont(duration, 0.99), 6) AS p99, round(quantile_cont(duration, 0.995), 6) AS p99_5, round(quantile_cont(duration, 0.999), 6) AS p99_9 FROM supervision""")
def describe_durations(spark, d):
    return S.describe_durations(sup(spark, d))


@query(f"""{_SWEEP}, l AS (SELECT rid, sum(CASE WHEN n >= 1 THEN {us_sql('round(b - a, 15)')} ELSE 0 END) AS speech, sum(CASE WHEN n >= 2 THEN {us_sql('round(b - a, 15)')} ELSE 0 END) AS over FROM w GROUP BY rid),
sp AS (SELECT rid, sum({us_sql('round(b - a, 8)')}) AS speaking FROM cl GROUP BY rid)
SELECT c.id, {us_sql('c.duration')} AS duration_us, CAST(coalesce(sp.speaking, 0) AS BIGINT) AS speaking_us, CAST(l.speech AS BIGINT) AS speech_us FROM c JOIN l ON l.rid = c.rid LEFT JOIN sp ON sp.rid = c.rid""")
def speech_durations(spark, d):
    return S.speech_durations(cuts(spark, d))


@query()
def describe_speech(spark, d):
    return S.describe_speech(cuts(spark, d))


@query("SELECT count(*) AS cuts, count(recording) AS recordings, count(features) AS features, CAST(sum(len(supervisions)) AS BIGINT) AS supervisions FROM cuts")
def availability(spark, d):
    return S.availability(cuts(spark, d))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(map_keys(custom)) AS key FROM supervision) GROUP BY key")
def custom_keys(spark, d):
    return S.custom_keys(sup(spark, d))


@query("""WITH e AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS std FROM e GROUP BY bin""")
def feature_stats(spark, d):
    return S.feature_stats(table(spark, d, "embeddings"), "embedding").select("bin", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS bin FROM embeddings),
m AS (SELECT bin, avg(CAST(v AS DOUBLE)) AS mu, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM e GROUP BY bin)
SELECT vec_id, round(sum((CAST(v AS DOUBLE) - mu) / sd), 5) AS total FROM e JOIN m ON m.bin = e.bin GROUP BY vec_id""")
def feature_normalised(spark, d):
    e = table(spark, d, "embeddings")
    out = S.normalise(e, "embedding", S.feature_stats(e, "embedding"))
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH s AS (SELECT recording_id, speaker, start, id, round(start + duration, 8) AS e FROM (SELECT DISTINCT id, recording_id, start, duration, speaker FROM supervision) WHERE recording_id IS NOT NULL AND speaker IS NOT NULL AND start IS NOT NULL AND duration > 0),
g AS (SELECT greatest({us_sql('start')} - {us_sql('pe')}, 0) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY recording_id, speaker ORDER BY start, id) AS pe FROM s) WHERE pe IS NOT NULL)
SELECT min(g) AS loc_us, round(sum(g) / count(*) - min(g), 3) AS scale_us, count(*) AS n FROM g""")
def pause_fit(spark, d):
    return S.pause_fit(sup(spark, d).select("id", "recording_id", "start", "duration", "speaker").distinct())


@query("SELECT CAST(floor(duration / 0.5) AS BIGINT) AS bin, count(*) AS n FROM supervision WHERE duration IS NOT NULL GROUP BY 1")
def duration_histogram(spark, d):
    return S.histogram(sup(spark, d), F.col("duration"), 0.5)


# ---- dataset algebra ---------------------------------------------------------------------------------------------


@query("SELECT id, 0 AS _src FROM cuts UNION ALL SELECT id, 1 FROM audio")
def combine_union(spark, d):
    return D.combine(cuts(spark, d).select("id"), audio(spark, d).select("id"))


@query("SELECT part, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, CAST(ntile(7) OVER (ORDER BY id) - 1 AS INTEGER) AS part FROM (SELECT DISTINCT id FROM supervision)) GROUP BY part")
def split_parts(spark, d):
    out = D.split(sup(spark, d).select("id").distinct(), 7, "id")
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT chunk, count(*) AS n, min(id) AS first_id FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 500 AS chunk FROM (SELECT DISTINCT id FROM supervision)) GROUP BY chunk")
def split_chunks(spark, d):
    return D.split_chunks(sup(spark, d).select("id").distinct(), 500, "id").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT DISTINCT id FROM supervision)) WHERE p % 5 = 2")
def slice_k_of_n(spark, d):
    return D.slice_k_of_n(sup(spark, d).select("id").distinct(), 2, 5, "id")


@query("SELECT id FROM (SELECT DISTINCT id FROM supervision) ORDER BY id LIMIT 100")
def subset_first(spark, d):
    return D.subset(sup(spark, d).select("id").distinct(), "id", first=100)


@query("SELECT id FROM (SELECT DISTINCT id FROM supervision) ORDER BY id DESC LIMIT 100")
def subset_last(spark, d):
    return D.subset(sup(spark, d).select("id").distinct(), "id", last=100)


@query("SELECT id, 0 AS _ord FROM audio WHERE id = 'live-00000001' UNION ALL SELECT id, 1 FROM audio WHERE id = 'lec-00001001'")
def subset_ids(spark, d):
    return D.subset_ids(audio(spark, d).select("id"), ["live-00000001", "lec-00001001", "absent"])


@query("SELECT id, row_number() OVER (ORDER BY duration DESC, id) - 1 AS place FROM (SELECT DISTINCT id, duration FROM cuts)")
def sort_by_duration(spark, d):
    return D.with_position(cuts(spark, d).select("id", "duration").distinct(), F.col("duration").desc(), "id", name="place").select("id", "place")


@query("SELECT id || '_repeat' || r AS id FROM cuts, range(3) t(r)")
def repeat_ids(spark, d):
    return D.repeat(cuts(spark, d).select("id"), 3).select("id")


_HASH = "CAST(('0x' || substr(md5({c} || '|{seed}'), 1, 8)) AS BIGINT)"


@query(f"SELECT id FROM (SELECT DISTINCT id FROM supervision) ORDER BY {_HASH.format(c='id', seed=3)}, id LIMIT 50")
def sample_rows(spark, d):
    return D.sample(sup(spark, d).select("id").distinct(), 50, seed=3)


@query(f"SELECT id, row_number() OVER (ORDER BY {_HASH.format(c='id', seed=7000021)}, id) - 1 AS place FROM (SELECT DISTINCT id FROM audio)")
def shuffled_order(spark, d):
    return D.with_position(audio(spark, d).select("id").distinct(), O.hash_int("id", 7 * 1_000_003), "id", name="place")


@query("SELECT sum(duration_us) AS total, count(*) AS n, max(cum) AS last_cum FROM (SELECT duration_us, sum(duration_us) OVER (ORDER BY id) - duration_us AS cum FROM (SELECT DISTINCT id, CAST(round(duration * 1000000.0) AS BIGINT) AS duration_us FROM cuts))".replace("sum(duration_us) AS total", "CAST(sum(duration_us) AS BIGINT) AS total").replace("max(cum) AS last_cum", "CAST(max(cum) AS BIGINT) AS last_cum"))
def running_totals(spark, d):
    c = D.with_position(cuts(spark, d).select("id", us("duration").alias("duration_us")).distinct(), "id")
    return D.running_sum(c, "duration_us", block=64).agg(F.sum("duration_us").alias("total"), F.count(F.lit(1)).alias("n"), F.max("_cum").alias("last_cum"))


@query()
def permuted_positions(spark, d):
    ids = D.with_position(audio(spark, d).select("id").distinct(), "id")
    return D.permuted(ids, ids.count(), 42).select("id", "_perm")


@query()
def mux_weighted(spark, d):
    a, b = audio(spark, d).select("id").distinct(), cuts(spark, d).select("id").distinct()
    return D.mux([a, b], [0.7, 0.3], seed=5).select("id", "_src")


@query()
def weighted_sample(spark, d):
    return D.weighted_sample(cuts(spark, d).select("id", "duration").distinct(), 100, "duration", seed=1).select("id")


# ---- batches -----------------------------------------------------------------------------------------------------

_BINS = [2.0, 4.0, 6.0, 9.0, 60.0]


def _lengths(spark, d) -> DataFrame:
    return sup(spark, d).where("duration > 0").select("id", "duration").distinct()


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN duration <= 2 THEN 0 WHEN duration <= 4 THEN 1 WHEN duration <= 6 THEN 2 WHEN duration <= 9 THEN 3 ELSE 4 END AS bucket FROM (SELECT DISTINCT id, duration FROM supervision WHERE duration > 0)) GROUP BY bucket")
def bucket_select(spark, d):
    return _lengths(spark, d).groupBy(B.bucket_of(F.col("duration"), _BINS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT id, CASE WHEN duration <= 2 THEN 0 WHEN duration <= 4 THEN 1 WHEN duration <= 6 THEN 2 WHEN duration <= 9 THEN 3 ELSE 4 END AS bucket FROM (SELECT DISTINCT id, duration FROM supervision WHERE duration > 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) - 1 AS p FROM x)
SELECT id, bucket, p // [32, 24, 16, 12, 8][bucket + 1] AS batch FROM n""")
def fixed_bucket_batches(spark, d):
    return B.fixed_size_batches(_lengths(spark, d), _BINS, [32, 24, 16, 12, 8])


@query()
def duration_bins(spark, d):
    bins = B.duration_bins(_lengths(spark, d), 8)
    return spark.createDataFrame([(i, b) for i, b in enumerate(bins)], "i int, bound double")


@query("""WITH x AS (SELECT id, CAST(round(duration * 1000000.0) AS BIGINT) AS u, duration FROM (SELECT DISTINCT id, duration FROM supervision WHERE duration > 0)),
c AS (SELECT u, sum(u) OVER (ORDER BY u, id) - u AS before, sum(u) OVER () AS total FROM x)
SELECT bucket, count(*) AS n FROM (SELECT CAST(least(floor(before * 6 / total), 5) AS INTEGER) AS bucket FROM c) GROUP BY bucket""")
def equal_mass_buckets(spark, d):
    return B.equal_mass_buckets(_lengths(spark, d), 6).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_dynamic(spark, d):
    return B.greedy_batches(_lengths(spark, d).withColumn("s", F.pmod(O.hash_int("id"), F.lit(16))), B.Constraint(max_total=120.0), stratum="s")


@query()
def greedy_simple(spark, d):
    return B.greedy_batches(_lengths(spark, d).withColumn("s", F.pmod(O.hash_int("id"), F.lit(16))), B.Constraint(max_total=120.0, max_items=20), mode="simple", stratum="s")


@query()
def greedy_tokens(spark, d):
    words = docs(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"))
    return B.greedy_batches(words.withColumn("s", F.pmod(O.hash_int("id"), F.lit(16))), B.Constraint(max_total=4096.0), "n_words", stratum="s")


@query()
def bucketed_sampler(spark, d):
    return B.bucketed_batches(_lengths(spark, d), _BINS, B.Constraint(max_total=200.0), seed=3, epoch=1)


_FIXED = "(SELECT id, duration, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM (SELECT DISTINCT id, duration FROM supervision WHERE duration > 0))"


def _fixed(spark, d) -> DataFrame:
    return D.split_chunks(_lengths(spark, d), 16, "id").withColumnRenamed("chunk", "batch")


_FIXED_CUTS = "(SELECT id, duration, (row_number() OVER (ORDER BY id, duration) - 1) // 16 AS batch FROM (SELECT DISTINCT id, duration FROM cuts))"


def _fixed_cuts(spark, d) -> DataFrame:
    """Batches of another whole table, shorter than the segments."""
    c = cuts(spark, d).select("id", "duration").distinct()
    return D.split_chunks(c, 16, "id", "duration").withColumnRenamed("chunk", "batch")


@query(f"SELECT id, batch, CAST(batch % 4 AS INTEGER) AS rank, batch // 4 AS step FROM {_FIXED}")
def rank_partition(spark, d):
    return B.rank_batches(_fixed(spark, d), 4).select("id", "batch", "rank", "step")


@query(f"""SELECT batch, n, round(1 - s / (n * m), 6) AS padding, round((m - l) / m, 6) AS spread FROM
(SELECT batch, count(*) AS n, max({us_sql('duration')}) AS m, min({us_sql('duration')}) AS l, sum({us_sql('duration')}) AS s FROM {_FIXED} GROUP BY batch)""")
def padding_report(spark, d):
    return S.padding_report(_fixed(spark, d)).select("batch", "n", "padding", "spread")


@query(f"""WITH g AS (SELECT batch, count(*) AS n, max({us_sql('duration')}) AS m, CAST(sum({us_sql('duration')}) AS BIGINT) AS s FROM {_FIXED} GROUP BY batch),
w AS (SELECT batch, 'most_items' AS criterion, n AS value FROM g UNION ALL SELECT batch, 'longest_item', m FROM g UNION ALL SELECT batch, 'largest_sum', s FROM g UNION ALL SELECT batch, 'largest_padded', n * m FROM g)
SELECT criterion, batch, value FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY value DESC, batch) AS k FROM w) WHERE k = 1""")
def pessimistic_batches(spark, d):
    return S.pessimistic_batches(_fixed(spark, d))


@query(f"""SELECT sampler, batch, batch * 2 + sampler AS turn, count(*) AS n FROM (SELECT 0 AS sampler, batch FROM {_FIXED} UNION ALL SELECT 1, batch FROM {_FIXED_CUTS}) GROUP BY ALL""")
def round_robin(spark, d):
    return B.round_robin([_fixed(spark, d), _fixed_cuts(spark, d)]).groupBy("sampler", "batch", "turn").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT batch, sampler, count(*) AS n FROM (SELECT 0 AS sampler, batch FROM {_FIXED} UNION ALL SELECT 1, batch FROM {_FIXED_CUTS})
WHERE batch <= least((SELECT max(batch) FROM {_FIXED}), (SELECT max(batch) FROM {_FIXED_CUTS})) GROUP BY ALL""")
def zip_batches(spark, d):
    return B.zip_batches([_fixed(spark, d), _fixed_cuts(spark, d)]).groupBy("batch", "sampler").agg(F.count(F.lit(1)).alias("n"))


@query()
def concat_packing(spark, d):
    return B.concat_in_batches(_fixed(spark, d), 0.5)


@query("""WITH l AS (SELECT label, max(len(embedding)) AS m FROM embeddings GROUP BY label) SELECT e.vec_id, len(embedding) AS length, l.m AS padded FROM embeddings e JOIN l ON l.label = e.label""")
def collate_padded(spark, d):
    out = B.collated(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("vec_id", F.col("length").cast("long").alias("length"), F.size("embedding").cast("long").alias("padded"))


# ---- validation --------------------------------------------------------------------------------------------------


@query("""SELECT rule, count(*) AS n FROM (
SELECT unnest(list_filter([CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN duration IS NULL OR duration <= 0 THEN 'duration not above 0' END, CASE WHEN num_samples IS NULL OR num_samples <= 0 THEN 'no samples' END,
CASE WHEN sampling_rate IS NULL OR sampling_rate <= 0 THEN 'rate not above 0' END, CASE WHEN abs(duration - num_samples / sampling_rate) > 0.001 THEN 'duration contradicts samples' END,
CASE WHEN sources IS NULL OR len(sources) = 0 THEN 'no sources' END, CASE WHEN len(list_filter(sources, lambda s: s.source IS NULL OR trim(s.source) = '')) > 0 THEN 'empty source' END], lambda x: x IS NOT NULL)) AS rule FROM audio) GROUP BY rule""")
def recording_violations(spark, d):
    return Q.check_recordings(audio(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rule, count(*) AS n FROM (
SELECT unnest(list_filter([CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN recording_id IS NULL THEN 'no recording' END, CASE WHEN start IS NULL THEN 'no start' END, CASE WHEN start < 0 THEN 'start below 0' END,
CASE WHEN duration IS NULL OR duration <= 0 THEN 'duration not above 0' END, CASE WHEN channel IS NULL THEN 'no channel' END], lambda x: x IS NOT NULL)) AS rule FROM supervision) GROUP BY rule""")
def segment_violations(spark, d):
    return Q.check_supervisions(sup(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT id, max(duration) AS e, true AS has FROM audio WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT s.id, s.start, s.duration, r.e, r.has FROM supervision s LEFT JOIN r ON r.id = s.recording_id WHERE s.recording_id IS NOT NULL)
SELECT 'segment of no recording' AS rule, count(*) AS n FROM s WHERE has IS NULL HAVING count(*) > 0 UNION ALL SELECT 'starts before the recording', count(*) FROM s WHERE start < -0.001 HAVING count(*) > 0
UNION ALL SELECT 'ends beyond the recording', count(*) FROM s WHERE round(start + duration, 8) > e + 0.001 HAVING count(*) > 0 UNION ALL SELECT 'ends before it starts', count(*) FROM s WHERE duration < 0 HAVING count(*) > 0
UNION ALL SELECT 'recording without segments', count(DISTINCT id) FROM audio WHERE id IS NOT NULL AND id NOT IN (SELECT recording_id FROM supervision WHERE recording_id IS NOT NULL) HAVING count(*) > 0""")
def pair_violations(spark, d):
    return Q.check_pairs(audio(spark, d), sup(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, count(*) AS n FROM supervision GROUP BY id HAVING count(*) > 1")
def repeated_ids(spark, d):
    return Q.repeated_ids(sup(spark, d))


@query()
def cut_violations(spark, d):
    c = cuts(spark, d)
    return Q.union_all([Q.check_cuts(c), Q.check_for_recognition(c), Q.check_for_synthesis(c)]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rule, count(*) AS n FROM (
SELECT unnest(list_filter([CASE WHEN recording_id IS NULL THEN 'no recording' END, CASE WHEN num_frames <= 0 THEN 'frames not above 0' END, CASE WHEN abs(round(duration / frame_shift) - num_frames) > 1 THEN 'frames contradict duration' END,
CASE WHEN abs(frame_shift * sampling_rate - round(frame_shift * sampling_rate)) > 1e-6 THEN 'shift off the sample grid' END, CASE WHEN channels IS NULL THEN 'no channels' END], lambda x: x IS NOT NULL)) AS rule FROM features) GROUP BY rule""")
def feature_violations(spark, d):
    return Q.check_features(feats(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# ---- events: pauses and windows by event time --------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) + CAST(round(value * 600000000) AS BIGINT) AS u FROM events),
m AS (SELECT *, max(u) OVER (PARTITION BY user_id ORDER BY t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM e),
n AS (SELECT *, sum(CASE WHEN edge IS NULL OR t - edge > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, u ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(t) AS start_us, max(u) AS end_us, count(*) AS n FROM n GROUP BY user_id, k""")
def islands_of_events(spark, d):
    from voxtile.streaming.sessions import islands

    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), F.round(F.col("value") * 600_000_000).cast("long").alias("len"))
    return islands(e.withColumn("end_us", F.col("start_us") + F.col("len")), "user_id", 60_000_000)


# ---- mixing, alignments, masks, characters -----------------------------------------------------------------------


@query()
def alignment_spans(spark, d):
    return C.trim_to_alignments(sup(spark, d), "word", 0.05, 5.0).select("id", us("start").alias("start_us"), us("duration").alias("duration_us"), "text")


@query()
def speaker_frames(spark, d):
    return C.speaker_masks(cuts(spark, d), 0.1).select("id", "speaker", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("active"))


@query()
def noise_mixed(spark, d):
    from voxtile.operators.mixing import mix_noise

    c = _unique(cuts(spark, d))
    return mix_noise(c, c.where("channel = 1"), (5.0, 15.0), 0.8, seed=4).select("id", us("duration").alias("duration_us"), F.size("tracks").alias("n_tracks"))


@query("""SELECT CAST(p AS BIGINT) AS position, CAST(round(greatest(x.duration, y.duration) * 1000000.0) AS BIGINT) AS duration_us FROM
(SELECT row_number() OVER (ORDER BY id) - 1 AS p, duration FROM (SELECT DISTINCT id, duration FROM cuts)) x JOIN
(SELECT row_number() OVER (ORDER BY id) - 1 AS p, duration FROM (SELECT DISTINCT id, duration FROM cuts WHERE channel = 0)) y USING (p)""")
def mixed_by_position(spark, d):
    from voxtile.operators.mixing import mix_by_position

    c = _unique(cuts(spark, d))
    return mix_by_position([c, c.where("channel = 0")]).select("position", us("duration").alias("duration_us"))


@query(f"SELECT id, {us_sql('duration + 1.0')} AS duration_us FROM cuts")
def extra_padding(spark, d):
    from voxtile.operators.mixing import extra_padding as pad_more

    return pad_more(cuts(spark, d), 1.0).select("id", us("duration").alias("duration_us"))


@query("""WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT id FROM audio)), a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT DISTINCT id FROM audio))
SELECT a.id || '_it' || k AS id FROM range(200) t(k), n JOIN a ON a.p = CAST(('0x' || substr(md5(k || '|9'), 1, 8)) AS BIGINT) % n.n""")
def drawn_with_replacement(spark, d):
    return D.draw_with_replacement(audio(spark, d).select("id").distinct(), 200, seed=9).select("id")


@query("SELECT count(*) FILTER (duration > 5) AS kept, count(*) - count(*) FILTER (duration > 5) AS dropped FROM supervision")
def filter_counts(spark, d):
    return D.kept_and_dropped(sup(spark, d), F.col("duration") > 5)


_RANKED = """r AS (SELECT *, CAST(recording_id IS NULL AS INT) + CAST("start" IS NULL AS INT) + CAST(duration IS NULL AS INT)
 + CAST(text IS NULL AS INT) + CAST(language IS NULL AS INT) + CAST(speaker IS NULL AS INT) AS nulls FROM supervision)"""


@query(f"""WITH {_RANKED}, t AS (SELECT id, min((nulls, received_at, text))[3] AS text FROM r GROUP BY id),
v AS (SELECT token, 3 + row_number() OVER (ORDER BY token) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM t WHERE text IS NOT NULL) WHERE token <> ''),
c AS (SELECT id, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS k FROM t WHERE text <> '')
SELECT t.id, '2,' || coalesce(x.ids || ',', '') || '3' AS ids FROM t LEFT JOIN (SELECT id, string_agg(v.n, ',' ORDER BY k) AS ids FROM c JOIN v USING (token) GROUP BY id) x ON x.id = t.id WHERE t.text IS NOT NULL""")
def encoded_characters(spark, d):
    s = first_delivery(sup(spark, d), SEGMENT_FIELDS, ["text"]).where("text is not null")
    return T.encoded_characters(s, "text", T.vocabulary(s, "text")).select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def paired_batches(spark, d):
    pairs = sup(spark, d).where("duration > 0 and text is not null").select("id", "duration", F.length("text").alias("chars"))
    pairs = _unique(pairs)
    return B.paired_batches(pairs.withColumn("s", F.pmod(O.hash_int("id"), F.lit(16))), B.Constraint(max_total=120.0), B.Constraint(max_total=2000.0), "duration", "chars", "s")


@query()
def simulated_meetings(spark, d):
    from voxtile.operators import meetings

    chosen = meetings.sampled(_unique(sup(spark, d).where("duration > 0")), 50, 3, 30.0, seed=2)
    return meetings.conversational(chosen, seed=2)


@query()
def recognition_batches(spark, d):
    from voxtile.operators import task_batches

    c = _unique(cuts(spark, d))
    out = task_batches.recognition(c, B.greedy_batches(c, B.Constraint(max_total=120.0)))
    return out.select("batch", F.size("cut_ids").alias("n_cuts"), F.size("texts").alias("n_texts"))


@query("""SELECT recording_id, speaker, count(*) AS n, CAST(sum(CAST(round(duration * 1000000.0) AS BIGINT)) AS BIGINT) AS total_us FROM supervision
WHERE duration > 0 GROUP BY GROUPING SETS ((recording_id, speaker), (recording_id), ())""")
def speaking_time_rollup(spark, d):
    return sup(spark, d).where("duration > 0").rollup("recording_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(us("duration")).alias("total_us"))


# ---- streams -----------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files: its folder, or the one file of that name among the tables."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, d, name).schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS n FROM n GROUP BY user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY 1")
def hourly_windows(spark, d):
    from voxtile.streaming.sessions import windowed_counts

    return windowed_counts(table(spark, d, "events"), size="1 hour").select(F.unix_micros("start").alias("start_us"), "n")


@query()
def session_stream(spark, d):
    from voxtile.streaming.sessions import session_stream as sessions
    from voxtile.streaming.sessions import settled

    stream = _stream(spark, d, "events")
    out = settled(sessions(stream, gap="2 hours"), "user_id long, start timestamp, end timestamp, n long")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH first AS (SELECT id, min((received_at, recording_id, "start", duration)) AS r FROM supervision WHERE id IS NOT NULL GROUP BY id),
spans AS (SELECT r[2] AS recording_id, CAST(round(r[3] * 1000) AS BIGINT) AS s, CAST(round((r[3] + r[4]) * 1000) AS BIGINT) AS e FROM first WHERE r[2] IS NOT NULL AND r[3] IS NOT NULL AND r[4] > 0),
m AS (SELECT *, s // 600000 AS chunk, max(e) OVER (PARTITION BY recording_id, s // 600000 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM spans),
n AS (SELECT *, sum(CASE WHEN edge IS NULL OR s > edge THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT recording_id, chunk, min(s) AS start_ms, max(e) AS end_ms FROM n GROUP BY recording_id, chunk, k""")
def coverage_stream(spark, d):
    from voxtile.streaming.coverage import OUT, latest_periods, period_stream
    from voxtile.streaming.sessions import settled

    stream = _stream(spark, d, "supervision")
    return latest_periods(settled(period_stream(stream), OUT, "update"))


@query()
def coverage_stream_batches(spark, d):
    """The same over several micro-batches, one file each."""
    from voxtile.session import shared_folder
    from voxtile.streaming.coverage import OUT, latest_periods, period_stream
    from voxtile.streaming.sessions import settled

    folder = shared_folder(spark, "deliveries")
    s = sup(spark, d)
    s.repartitionByRange(4, "received_at").write.parquet(folder)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return latest_periods(settled(period_stream(stream, late="3650 days"), OUT, "update"))


ORACLES["coverage_stream_batches"] = ORACLES["coverage_stream"]


# ---- interchange formats -----------------------------------------------------------------------------------------


@query("""SELECT printf('SPEAKER %s %d %.3f %.3f <NA> <NA> %s <NA> <NA>', recording_id, coalesce(channel[1], 0), start, duration, coalesce(speaker, '<NA>')) AS value
FROM supervision WHERE recording_id IS NOT NULL AND start IS NOT NULL AND duration > 0""")
def rttm_lines(spark, d):
    from voxtile.sources.manifests import format_rttm

    return format_rttm(sup(spark, d).where("recording_id is not null and start is not null and duration > 0"))


@query("""WITH w AS (SELECT recording_id, coalesce(channel[1], 0) AS ch, unnest(alignment['word']) AS w FROM supervision WHERE alignment IS NOT NULL)
SELECT coalesce(recording_id, 'null') AS rec, ch, w.symbol AS symbol, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL""")
def ctm_words(spark, d):
    from voxtile.sources.manifests import format_ctm

    p = F.split("value", " ")
    lines = format_ctm(sup(spark, d))
    # the times are rounded by the engine's own rule, so the comparison is on what the lines name
    return lines.groupBy(p[0].alias("rec"), p[1].cast("int").alias("ch"), p[4].alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, recording.id AS recording_id, CASE WHEN len(supervisions) = 1 THEN supervisions[1].text END AS text, CASE WHEN len(supervisions) <> 1 THEN len(supervisions) END AS n_segments FROM cuts""")
def flat_rows(spark, d):
    from voxtile.sources.manifests import flat_table

    return flat_table(cuts(spark, d)).select("id", "recording_id", "text", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("long").alias("n_segments"))


@query(f"SELECT id || '_tp0.9' AS id, {_PERT.format(t='duration').replace('1.1', '0.9').replace('CAST(round(', 'CAST(ceil(').replace(', 8)) AS BIGINT)', ', 8) - 0.5) AS BIGINT)')} AS duration_samples FROM cuts WHERE recording.sampling_rate IS NOT NULL")
def perturb_tempo(spark, d):
    out = C.perturb_speed(cuts(spark, d), 0.9, kind="tp")
    return out.select("id", F.round(F.col("duration") * F.col("recording.sampling_rate")).cast("long").alias("duration_samples"))


@query()
def signal_mixes(spark, d):
    from voxtile.functions import signal

    e = table(spark, d, "embeddings").withColumn("noise", F.reverse("embedding"))
    return signal.mix_rows(e, "embedding", "noise", 8, 10.0).select("vec_id", F.size("mixed").alias("n"), F.round(signal.energy(F.col("mixed")), 4).alias("energy"))


@query()
def augmented_features(spark, d):
    from voxtile.functions import signal

    e = table(spark, d, "embeddings").select("vec_id", F.array_repeat("embedding", 20).alias("m"))
    return signal.spec_augment(e, "m", "vec_id", seed=1, warp=None).select("vec_id", F.size("m").alias("frames"))


@query()
def cepstra(spark, d):
    from voxtile.functions import signal

    e = table(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 20)).alias("samples"))
    return signal.extract(e, "samples", "mfcc").select("vec_id", F.size("features").alias("frames"), F.size(F.col("features")[0]).alias("bins"))


# ---- SQL of sequential operators: one recursive step per place within a stratum ----------------------------------


def _greedy_sql(source: str, limit: float, simple: bool, items: int | None = None) -> str:
    """Recursion over places: state is the open batch; ``simple`` closes before an item that exceeds, else after one that nearly does."""
    longest = "greatest(g.longest, x.m)"
    over = f"(g.n + 1) * {longest} > {limit}" + (f" OR g.n + 1 > {items}" if items else "")
    close = f"(g.n + 1) * g.longest > {limit}" + (f" OR g.n >= {items}" if items else "")
    opens = f"({over})" if simple else f"({close})"
    return f"""WITH RECURSIVE x AS ({source}),
g AS (SELECT s, p, id, m, CAST(0 AS BIGINT) AS batch, 1 AS n, m AS longest FROM x WHERE p = 0
UNION ALL SELECT x.s, x.p, x.id, x.m, g.batch + CASE WHEN {opens} THEN 1 ELSE 0 END, CASE WHEN {opens} THEN 1 ELSE g.n + 1 END, CASE WHEN {opens} THEN x.m ELSE {longest} END
FROM g JOIN x ON x.s = g.s AND x.p = g.p + 1)
SELECT s AS stratum, id, m AS measure, batch FROM g"""


def _strata_sql(rows: str) -> str:
    return f"SELECT s, id, m, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS p FROM (SELECT id, m, CAST(('0x' || substr(md5(id || '|0'), 1, 8)) AS BIGINT) % 16 AS s FROM ({rows}))"


_LENGTH_SQL = "SELECT DISTINCT id, duration AS m FROM supervision WHERE duration > 0"
ORACLES["greedy_dynamic"] = _greedy_sql(_strata_sql(_LENGTH_SQL), 120.0, False)
ORACLES["greedy_simple"] = _greedy_sql(_strata_sql(_LENGTH_SQL), 120.0, True, 20)
ORACLES["windows_balanced"] = f"""{CUTS}, cand AS (SELECT rid, w, round(duration - (nw - 1) * (w - 1.0), 8) AS last, nw FROM (
  SELECT rid, duration, w, ceil(greatest(duration - w, 0) / (w - 1.0)) + CASE WHEN duration - ceil(greatest(duration - w, 0) / (w - 1.0)) * (w - 1.0) > 0 THEN 1 ELSE 0 END AS nw
  FROM c, (SELECT unnest([8, 9, 10, 11, 12]) AS w) WHERE duration > 12)),
best AS (SELECT rid, w, nw FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY last DESC, w) AS k FROM cand) WHERE k = 1),
p AS (SELECT c.rid, c.id || '-' || i AS nid, round(i * (w - 1.0), 8) AS off, round(least(CAST(w AS DOUBLE), c.duration - round(i * (w - 1.0), 8)), 8) AS dur FROM (SELECT rid, w, unnest(range(0, CAST(nw AS BIGINT))) AS i FROM best) b JOIN c ON c.rid = b.rid),
k AS (SELECT p.rid, p.nid, p.off, p.dur, g.sid, round(g.st - p.off, 8) AS st FROM p LEFT JOIN seg g ON g.rid = p.rid AND round(g.st - p.off, 8) < p.dur AND round(round(g.st - p.off, 8) + g.du, 8) > 0 WHERE p.dur > 0)
SELECT k.nid AS id, {us_sql('round(c.start + k.off, 8)')} AS start_us, {us_sql('k.dur')} AS duration_us, count(k.sid) AS n_sups, coalesce(string_agg(k.sid, ',' ORDER BY k.st, k.sid), '') AS sup_ids
FROM k JOIN c ON c.rid = k.rid GROUP BY k.rid, k.nid, k.off, k.dur, c.start
UNION ALL SELECT id, {us_sql('start')}, {us_sql('duration')}, len(supervisions), array_to_string(list_transform(supervisions, lambda s: s.id), ',') FROM c WHERE duration <= 12"""
_TOTAL_FRAMES = "CAST(floor((round_even(c.duration * coalesce(c.recording.sampling_rate, 16000), 0) + floor(round_even({f} * coalesce(c.recording.sampling_rate, 16000), 0) / 2)) / round_even({f} * coalesce(c.recording.sampling_rate, 16000), 0)) AS BIGINT)"


def _mask_sql(shift: float, by: str) -> str:
    return f"""{CUTS}, cl AS (SELECT seg.rid, seg.speaker, greatest(st, 0.0) AS a, round(greatest(st, 0.0) + round(least(en, c.duration) - greatest(st, 0.0), 8), 8) AS b, {_TOTAL_FRAMES.format(f=shift)} AS n
FROM seg JOIN c ON c.rid = seg.rid WHERE round(least(en, c.duration) - greatest(st, 0.0), 8) > 0),
fr AS (SELECT DISTINCT rid{by}, unnest(range(CAST(round_even(a / {shift}, 0) AS BIGINT), least(CAST(round_even(b / {shift}, 0) AS BIGINT), n))) AS i FROM cl),
cn AS (SELECT rid{by}, count(*) AS k FROM fr GROUP BY rid{by})"""


ORACLES["frame_masks"] = _mask_sql(0.01, "") + " SELECT c.id, CAST(coalesce(cn.k, 0) AS INTEGER) AS active FROM c LEFT JOIN cn ON cn.rid = c.rid"
ORACLES["speaker_frames"] = _mask_sql(0.1, ", speaker") + ", w AS (SELECT DISTINCT rid, speaker FROM cl WHERE speaker IS NOT NULL) SELECT c.id, w.speaker, CAST(coalesce(cn.k, 0) AS INTEGER) AS active FROM w JOIN c ON c.rid = w.rid LEFT JOIN cn ON cn.rid = w.rid AND cn.speaker = w.speaker"
ORACLES["describe_speech"] = f"""{_SWEEP}, l AS (SELECT rid, n, sum({us_sql('round(b - a, 15)')}) AS t FROM w GROUP BY rid, n),
x AS (SELECT coalesce(sum(t) FILTER (n >= 1), 0) AS sp, coalesce(sum(t) FILTER (n = 1), 0) AS si, coalesce(sum(t) FILTER (n >= 2), 0) AS ov, coalesce(sum(t) FILTER (n = 2), 0) AS s2, coalesce(sum(t) FILTER (n = 3), 0) AS s3, coalesce(sum(t) FILTER (n = 4), 0) AS s4 FROM l),
y AS (SELECT count(*) AS n, sum({us_sql('duration')}) AS d FROM c), z AS (SELECT sum({us_sql('round(b - a, 8)')}) AS k FROM cl)
SELECT n, CAST(d AS BIGINT) AS duration_us, CAST(k AS BIGINT) AS speaking_us, CAST(sp AS BIGINT) AS speech_us, CAST(si AS BIGINT) AS single_us, CAST(ov AS BIGINT) AS overlap_us, CAST(s2 AS BIGINT) AS speakers_2_us,
CAST(s3 AS BIGINT) AS speakers_3_us, CAST(s4 AS BIGINT) AS speakers_4_us, CAST(d - sp AS BIGINT) AS silence_us, round(sp / d, 6) AS speech_share FROM x, y, z"""


# ---- SQL of batches over other strata, orders and measures --------------------------------------------------------

_WORDS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(len(regexp_split_to_array(trim(text), '[ \\t\\n\\x0b\\f\\r]+')) AS DOUBLE) AS m FROM documents WHERE text IS NOT NULL"
ORACLES["greedy_tokens"] = _greedy_sql(_strata_sql(_WORDS_SQL), 4096.0, False)


def _hash_sql(text: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5({text} || '|{seed}'), 1, 8)) AS BIGINT)"


_BUCKETED = f"""SELECT s, id, m, row_number() OVER (PARTITION BY s ORDER BY {_hash_sql('id', 3 * 1_000_003 + 1)}, id) - 1 AS p FROM
(SELECT id, m, (CASE WHEN m <= 2 THEN 0 WHEN m <= 4 THEN 1 WHEN m <= 6 THEN 2 WHEN m <= 9 THEN 3 WHEN m <= 60 THEN 4 ELSE 5 END) * 8 + {_hash_sql('id', 4)} % 8 AS s FROM ({_LENGTH_SQL}))"""
ORACLES["bucketed_sampler"] = _greedy_sql(_BUCKETED, 200.0, False).replace(
    "SELECT s AS stratum, id, m AS measure, batch FROM g",
    f"SELECT CAST(s // 8 AS INTEGER) AS bucket, CAST(s % 8 AS INTEGER) AS shard, id, m AS measure, batch, {_hash_sql("(s || '/' || batch)", 3 * 1_000_003 + 1)} AS place FROM g",
)
_PAIR_OVER = "((g.n + 1) * greatest(g.la, x.m) > 120.0 OR (g.n + 1) * greatest(g.lb, x.c) > 2000.0)"
ORACLES["paired_batches"] = f"""WITH RECURSIVE u AS (SELECT id, duration AS m, CAST(length(text) AS DOUBLE) AS c, CAST(('0x' || substr(md5(id || '|0'), 1, 8)) AS BIGINT) % 16 AS s FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY '{{"id":"' || id || '","duration":' || duration || ',"chars":' || length(text) || '}}') AS k FROM supervision WHERE duration > 0 AND text IS NOT NULL) WHERE k = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS p FROM u),
g AS (SELECT s, p, id, CAST(0 AS BIGINT) AS batch, 1 AS n, m AS la, c AS lb FROM x WHERE p = 0
UNION ALL SELECT x.s, x.p, x.id, g.batch + CASE WHEN {_PAIR_OVER} THEN 1 ELSE 0 END, CASE WHEN {_PAIR_OVER} THEN 1 ELSE g.n + 1 END,
 CASE WHEN {_PAIR_OVER} THEN x.m ELSE greatest(g.la, x.m) END, CASE WHEN {_PAIR_OVER} THEN x.c ELSE greatest(g.lb, x.c) END FROM g JOIN x ON x.s = g.s AND x.p = g.p + 1)
SELECT s AS stratum, id, batch FROM g"""
ORACLES["duration_bins"] = f"""WITH RECURSIVE u AS (SELECT m, CAST(round(m * 1000000.0) AS BIGINT) AS w FROM ({_LENGTH_SQL})),
x AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS p, sum(w) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) - w AS cum, sum(w) OVER () / 8.0 AS share FROM u),
g AS (SELECT p, m, CAST(0 AS DOUBLE) AS base, false AS hit FROM x WHERE p = 0
UNION ALL SELECT x.p, x.m, CASE WHEN x.cum - g.base > x.share THEN x.cum ELSE g.base END, x.cum - g.base > x.share FROM g JOIN x ON x.p = g.p + 1)
SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS i, m AS bound FROM g WHERE hit"""

# sessions that the last watermark, an hour before the last event, has passed
ORACLES["session_stream"] = ORACLES["session_windows"] + " HAVING max(t) + 7200000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"
ORACLES["weighted_sample"] = f"""SELECT id FROM (SELECT DISTINCT id, duration FROM cuts) WHERE duration > 0
ORDER BY -ln(({_hash_sql('id', 1)} + 0.5) / 4294967296.0) / duration, id LIMIT 100"""
ORACLES["mux_weighted"] = "SELECT DISTINCT id, 0 AS _src FROM audio UNION ALL SELECT DISTINCT id, 1 AS _src FROM cuts"
_NF = "floor((round_even(duration * coalesce(recording.sampling_rate, 16000), 0) + floor(round_even(features.frame_shift * coalesce(recording.sampling_rate, 16000), 0) / 2)) / round_even(features.frame_shift * coalesce(recording.sampling_rate, 16000), 0))"
_SOME = "len(list_filter(supervisions, lambda s: {c})) > 0"
ORACLES["cut_violations"] = f"""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([
CASE WHEN start < 0 THEN 'start below 0' END, CASE WHEN duration <= 0 THEN 'duration not above 0' END,
CASE WHEN round(start + duration, 8) > recording.duration + 0.001 THEN 'beyond the recording' END, CASE WHEN recording IS NULL AND features IS NULL THEN 'neither recording nor features' END,
CASE WHEN {_NF} > features.num_frames + 1 THEN 'too few frames' END, CASE WHEN {_SOME.format(c='s.duration IS NULL OR s.duration <= 0')} THEN 'segment without duration' END,
CASE WHEN len(list_distinct(list_transform(supervisions, lambda s: s.id))) < len(supervisions) THEN 'repeated segment' END,
CASE WHEN len(supervisions) <= 0 THEN 'no segment' END, CASE WHEN {_SOME.format(c='s.text IS NULL')} THEN 'segment without text' END,
CASE WHEN {_SOME.format(c='s.start < -0.002')} THEN 'segment before the cut' END, CASE WHEN {_SOME.format(c='s.start + s.duration > duration + 0.002')} THEN 'segment beyond the cut' END,
CASE WHEN len(supervisions) <> 1 THEN 'not exactly one segment' END], lambda x: x IS NOT NULL)) AS rule FROM cuts) GROUP BY rule"""
ORACLES["signal_mixes"] = """WITH e AS (SELECT vec_id, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
t AS (SELECT vec_id, k AS i, v AS x FROM e UNION ALL SELECT vec_id, n - k + 9, sqrt(0.1) * v FROM e), m AS (SELECT vec_id, i, sum(x) AS x FROM t GROUP BY vec_id, i)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(x * x) / count(*), 4) AS energy FROM m GROUP BY vec_id"""
ORACLES["augmented_features"] = "SELECT vec_id, 20 AS frames FROM embeddings"
