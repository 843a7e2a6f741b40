"""Oversized recordings into pieces under a limit, cut at natural boundaries, with overlap (problem 5).

Method: lexical-cohesion segmentation. At every silence the words of the block of segments
before it are compared with those of the block after it. Within each size window a low
similarity between higher neighbours is a valley, its depth how far its neighbours rise
above it, and the silence with the deepest valley ends the piece; the next piece starts the
overlap before that end. Where the window has no silence the piece is cut in speech at the
limit, and the stretch of speech around the cut is told.

Scale: similarities come per (recording, chunk of time), with the four segments before and
after the chunk given to it; silences come from the interval map of
voxtile.operators.coverage. A piece depends on the one before, so a recording is cut in
sections that are guessed and verified: each section is cut from a guessed first piece, the
piece that its forerunner hands on then replaces the guess, and only sections whose first
piece changes are cut again. What two rounds leave (hours of unbroken speech or of silence
have nothing at which two sequences of pieces meet) is followed in order, one section at a
time, so the rounds do not grow with the length of a recording. The pieces are those of one
pass from the recording's start, whatever the section's length. A task holds the silences of
one section or the segments of one chunk; a recording with a third of all rows is many of both.

Defined results: a recording without a length, or not in audio, gives no piece; one that
is no longer than the limit gives one piece; a block without words (null, empty and blank
texts) is no evidence: its silence has no valley; segments that start beyond the
recording's end are ignored, and those that reach beyond it end there; repeated rows and
deliveries count once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtile.operators.coverage import CHUNK_MS, IntervalMap, segment_spans
from voxtile.session import RECORDING_FIELDS, checkpointed, finite, first_delivery, keyed_stream, rows_to_batch, salted_join

SECTION_MS = 3_600_000
#: How often all sections with another first piece are cut at once, before those left are followed in order.
ROUNDS = 2
BLOCK = 4
_WORDS = re.compile(r"\w+")
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿]{2,}")


def words(text: str | None) -> frozenset[str]:
    """Lower-case words; of scripts without spaces the pairs of neighbouring characters."""
    if not text:
        return frozenset()
    out = set()
    for w in _WORDS.findall(text.lower()):
        if _UNSPACED.search(w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        elif len(w) > 2:
            out.add(w)
    return frozenset(out)


def _similarity(a: list[frozenset], b: list[frozenset]) -> float | None:
    """The share of common words of two blocks; None where one of them has no words."""
    left, right = frozenset().union(*a), frozenset().union(*b)
    if not left or not right:
        return None
    return len(left & right) / (len(left) * len(right)) ** 0.5


def valley_depths(similarities: list[float | None]) -> list[float]:
    """How far the nearest peaks on both sides rise above each value; 0 where there is no value."""
    known = [(i, s) for i, s in enumerate(similarities) if s is not None]
    depths = [0.0] * len(similarities)
    left, right = [s for _, s in known], [s for _, s in known]
    for i in range(1, len(known)):
        if left[i] <= known[i - 1][1]:
            left[i] = left[i - 1]
    for i in range(len(known) - 2, -1, -1):
        if right[i] <= known[i + 1][1]:
            right[i] = right[i + 1]
    for (i, s), a, b in zip(known, left, right):
        depths[i] = a + b - 2 * s
    return depths


def cut_section(
    at: float, stop: float, end: float, gaps: list[tuple], piece_max: int, overlap: int, before: float | None = None, after: float | None = None
) -> tuple[list[tuple], float | None]:
    """The pieces (start, end, how, depth, stretch_start, stretch_ms) that start from ``at`` on and before ``stop``, and the start of the next.

    ``gaps`` are the silences (start, end, similarity) in order; ``before`` and ``after``
    bound the speech where no silence of these does.
    """
    gap_starts, gap_ends = [g[0] for g in gaps], [g[1] for g in gaps]
    out = []
    while at < stop:
        if end - at <= piece_max:
            out.append((at, end, "end", 0.0, None, None))
            return out, None
        limit, least = at + piece_max, at + overlap
        # silences that begin by the limit and end after the overlap
        lo, hi = bisect_right(gap_ends, least), bisect_right(gap_starts, limit)
        # the size window: the later half of the piece, or where that has no silence all of it
        late = max(lo, bisect_right(gap_ends, at + piece_max // 2))
        first = late if late < hi else lo
        if first < hi:
            depths = valley_depths([g[2] for g in gaps[first:hi]])
            depth, best = max((d, i) for i, d in enumerate(depths, first))
            cut = min(gap_ends[best], limit)
            out.append((at, cut, "silence", depth, None, None))
        else:
            cut = limit
            s = gap_ends[lo - 1] if lo else before
            e = gap_starts[hi] if hi < len(gaps) else after
            s, e = at if s is None else s, end if e is None else e
            out.append((at, cut, "speech", 0.0, s, min(e, end) - s))
        at = cut - overlap
    return out, at


class _Similar:
    """State of one (recording, chunk): its silences and the similarity of the blocks around each."""

    def __init__(self, key: tuple):
        self.key, self.segs, self.before, self.after, self.carry = key, [], [], [], None

    def add(self, row: tuple) -> None:
        _, _, start, end, text, self.carry, before, after = row
        self.segs.append((start, end, text))
        self.before, self.after = self.before or before or [], self.after or after or []

    def finish(self) -> list[tuple]:
        covered = IntervalMap()
        for s, e, _ in self.segs:
            covered.insert(s, e)
        texts = [*self.before, *(t for *_, t in self.segs), *self.after]
        starts, skip = [s for s, *_ in self.segs], len(self.before)
        known: dict[int, frozenset] = {}

        def block(i: int, j: int) -> list[frozenset]:
            for k in range(max(0, i), min(j, len(texts))):
                if k not in known:
                    known[k] = words(texts[k])
            return [known[k] for k in range(max(0, i), min(j, len(texts)))]

        rows, edge = [], self.carry
        for s, e in zip(covered.starts, covered.ends):
            if edge is not None and s > edge:
                i = skip + bisect_left(starts, s)
                rows.append((self.key[0], edge, s, _similarity(block(i - BLOCK, i), block(i, i + BLOCK))))
            edge = e if edge is None else max(edge, e)
        return rows


_GAPS = pa.schema([("recording_id", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("similar", pa.float64())])


def placed_spans(spans: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Adds the chunk, the place in it (``row`` of ``n``), how many segments lie before the chunk (``base``) and their latest end (``carry``)."""
    keys = ["recording_id", "chunk"]
    spans = spans.withColumn("chunk", F.floor(F.col("start_ms") / chunk_ms).cast("long")).repartition(*keys)
    within = Window.partitionBy(*keys).orderBy("start_ms", "id")
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per recording and chunk: the latest end and the number of segments before it
    summary = spans.groupBy(*keys).agg(F.max("end_ms").alias("e"), F.count(F.lit(1)).alias("n"))
    summary = summary.select(*keys, "n", F.max("e").over(before).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # read four times below, and by the caller: written once
    return checkpointed(spans.withColumn("row", F.row_number().over(within)).join(summary, keys))


def similar_silences(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(recording_id, gap_start, gap_end, similar): the silences between segments, with the similarity of the blocks of segments around each."""
    keys = ["recording_id", "chunk"]
    summary = placed.where("row = 1").select(*keys, "n", "base")
    # a segment goes to the chunks that begin among the next segments, or that end among those before it
    edge = placed.where((F.col("row") <= block) | (F.col("row") > F.col("n") - block)).withColumn("pos", F.col("base") + F.col("row") - 1)
    near = F.sequence(F.lit(1), F.lit(block))
    following = edge.select("recording_id", "pos", "text", F.explode(F.transform(near, lambda d: F.col("pos") + d)).alias("at"))
    leading = edge.select("recording_id", "pos", "text", F.explode(F.transform(near, lambda d: F.col("pos") - d + 1)).alias("at"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    context = following.join(summary.select("recording_id", "chunk", F.col("base").alias("at")), ["recording_id", "at"]).groupBy(*keys).agg(lists.alias("earlier"))
    later = leading.join(summary.select("recording_id", "chunk", (F.col("base") + F.col("n")).alias("at")), ["recording_id", "at"]).groupBy(*keys).agg(lists.alias("later"))
    full = placed.join(context, keys, "left").join(later, keys, "left")
    only = lambda c: F.when(F.col("row") == 1, F.col(c)).alias(c)
    work = full.select(*keys, "start_ms", "end_ms", "text", "carry", only("earlier"), only("later"), "id").repartition(*keys)
    work = work.sortWithinPartitions(*keys, "start_ms", "id").drop("id")
    run = keyed_stream(keys, _Similar, lambda rows: rows_to_batch(rows, _GAPS))
    return work.mapInArrow(run, "recording_id string, gap_start long, gap_end long, similar double")


def recording_ends(audio: DataFrame) -> DataFrame:
    """(recording_id, end_ms): num_samples / sampling_rate or, where that is absent, the duration; above zero."""
    a = first_delivery(audio, RECORDING_FIELDS, ["sampling_rate", "num_samples", "duration"])
    by_samples = F.when((F.col("sampling_rate") > 0) & F.col("num_samples").isNotNull(), F.col("num_samples") * 1000.0 / F.col("sampling_rate"))
    end = F.coalesce(by_samples, finite(F.col("duration")) * 1000.0)
    return a.select(F.col("id").alias("recording_id"), end.alias("rec_end")).where("rec_end > 0")


_PIECE = "array<struct<start_ms:double,end_ms:double,how:string,depth:double,stretch_start_ms:long,stretch_ms:double>>"


def _sections(placed: DataFrame, ends: DataFrame, piece_max: int, section: int) -> DataFrame:
    """(recording_id, section, rec_end, gaps, before, after): each section of each recording with the silences that its pieces can meet."""
    around = placed.groupBy("recording_id").agg(F.min("start_ms").alias("from_ms"), F.max("end_ms").alias("to_ms"))
    known = ends.join(around, "recording_id", "left")
    edges = known.select(
        "recording_id", "rec_end",
        F.explode(F.when(F.col("from_ms").isNull(), F.array(F.struct(F.lit(0.0).alias("s"), F.col("rec_end").alias("e")))).otherwise(
            F.array(F.struct(F.lit(0.0).alias("s"), F.col("from_ms").cast("double").alias("e")), F.struct(F.col("to_ms").cast("double").alias("s"), F.col("rec_end").alias("e"))))).alias("g"),
    ).select("recording_id", "rec_end", F.col("g.s").alias("s"), F.col("g.e").alias("e"), F.lit(None).cast("double").alias("similar"))
    inner = similar_silences(placed).select("recording_id", F.col("gap_start").cast("double").alias("s"), F.col("gap_end").cast("double").alias("e"), "similar")
    gaps = salted_join(inner, ends, "recording_id", "s").select("recording_id", "rec_end", "s", "e", "similar").unionByName(edges)
    gaps = gaps.withColumn("e", F.least("e", "rec_end")).withColumn("s", F.greatest("s", F.lit(0.0))).where("s < e")
    number = lambda c: F.floor(c / section).cast("long")
    gaps = gaps.withColumn("a", F.greatest(number(F.col("s") - piece_max), F.lit(0))).withColumn("b", F.least(number(F.col("e")), number(F.col("rec_end"))))
    gaps = checkpointed(gaps)  # read three times below
    placed = gaps.select("recording_id", F.explode(F.sequence("a", F.greatest("a", "b"))).alias("section"), "s", "e", "similar")
    lists = placed.groupBy("recording_id", "section").agg(F.array_sort(F.collect_list(F.struct("s", "e", "similar"))).alias("gaps"))
    by_end = gaps.groupBy("recording_id", F.col("b").alias("section")).agg(F.max("e").alias("last_end"))
    by_start = gaps.groupBy("recording_id", F.col("a").alias("section")).agg(F.min("s").alias("first_start"))
    every = known.select("recording_id", "rec_end", "from_ms", "to_ms", F.explode(F.sequence(F.lit(0).cast("long"), number(F.col("rec_end")))).alias("section"))
    for part in (lists, by_end, by_start):
        every = every.join(part, ["recording_id", "section"], "left")
    order = Window.partitionBy("recording_id").orderBy("section")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    return every.select(
        "recording_id", "section", "rec_end", "gaps",
        F.coalesce(F.max("last_end").over(earlier), F.col("from_ms").cast("double")).alias("before"),
        F.coalesce(F.min("first_start").over(later), F.col("to_ms").cast("double")).alias("after"),
    )


_CUT = pa.schema([("recording_id", pa.string()), ("section", pa.int64()), ("entry", pa.float64()), ("next", pa.float64()), ("pieces", pa.list_(pa.struct(
    [("start_ms", pa.float64()), ("end_ms", pa.float64()), ("how", pa.string()), ("depth", pa.float64()), ("stretch_start_ms", pa.int64()), ("stretch_ms", pa.float64())])))])
_PIECE_FIELDS = [f.name for f in _CUT.field("pieces").type.value_type]
_CUT_SQL = f"recording_id string, section long, entry double, next double, pieces {_PIECE}"


def _cut_row(x: dict, entry: float, piece_max: int, overlap: int, section: int) -> tuple:
    """The row of one section, cut from ``entry`` on; an entry below 0 gives no piece."""
    found, following = [], None
    if entry >= 0:
        gaps = [(g["s"], g["e"], g["similar"]) for g in x["gaps"] or ()]
        found, following = cut_section(entry, (x["section"] + 1) * section, x["rec_end"], gaps, piece_max, overlap, x["before"], x["after"])
    made = [dict(zip(_PIECE_FIELDS, (float(p), float(q), how, d, None if s is None else int(s), None if n is None else float(n)))) for p, q, how, d, s, n in found]
    return x["recording_id"], x["section"], entry, following, made


def _cut(sections: DataFrame, piece_max: int, overlap: int, section: int) -> DataFrame:
    """(recording_id, section, entry, next, pieces): sections cut from their entry on."""
    names = sections.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(names, r)) for r in zip(*[c.to_pylist() for c in b.columns])]
            yield rows_to_batch([_cut_row(x, x["entry"], piece_max, overlap, section) for x in rows], _CUT)

    return sections.mapInArrow(run, _CUT_SQL)


def _followed(sections: DataFrame, done: DataFrame, wrong: DataFrame, piece_max: int, overlap: int, section: int) -> DataFrame:
    """The rows of ``_cut`` that change when each recording of ``wrong`` is followed in order from its first wrong section on.

    A section that was cut from the entry which its forerunner hands on stays as it is; one row is held at a time.
    """
    keys = ["recording_id", "section"]
    first = wrong.groupBy("recording_id").agg(F.min(F.struct("section", F.col("entry").alias("given"))).alias("f"))
    rest = sections.join(first, "recording_id").where("section >= f.section").select(sections["*"], F.col("f.given").alias("given"))
    rest = rest.join(done.select(*keys, "entry", F.coalesce("next", F.lit(-1.0)).alias("next")), keys)
    # after the joins, so that no plan of a join can part a recording
    rest = rest.repartition("recording_id").sortWithinPartitions(*keys)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entry = None, None
        for b in batches:
            rows = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                x = dict(zip(names, r))
                if x["recording_id"] != current:
                    current, entry = x["recording_id"], x["given"]
                if entry == x["entry"]:
                    entry = x["next"]
                    continue
                rows.append(_cut_row(x, entry, piece_max, overlap, section))
                entry = -1.0 if rows[-1][3] is None else rows[-1][3]
            yield rows_to_batch(rows, _CUT)

    return rest.mapInArrow(run, _CUT_SQL)


def pieces(supervision: DataFrame, audio: DataFrame, piece_max: int, overlap: int, section_ms: int = SECTION_MS) -> DataFrame:
    """(recording_id, section, start_ms, end_ms, how, depth, stretch_start_ms, stretch_ms).

    ``how``: the piece ends in a silence, in speech, or at the end of the recording; for
    those that end in speech, the stretch of speech that was cut and its length up to the
    end of the recording. ``section`` is where the piece was made and tells nothing.
    """
    if not 0 <= overlap < piece_max:
        raise ValueError("overlap must lie below piece_max")
    section = max(section_ms, 2 * piece_max)
    keys = ["recording_id", "section"]
    sections = checkpointed(_sections(placed_spans(segment_spans(supervision, ["text"])), checkpointed(recording_ends(audio)), piece_max, section))
    # the first guess: a piece starts where the section does; that is true of the first section
    done = checkpointed(_cut(sections.withColumn("entry", F.col("section").cast("double") * section), piece_max, overlap, section))
    for turn in count():
        handed = done.select("recording_id", (F.col("section") + 1).alias("section"), F.coalesce("next", F.lit(-1.0)).alias("given"))
        wrong = checkpointed(done.select(*keys, "entry").join(handed, keys).where("entry <> given").select(*keys, F.col("given").alias("entry")))
        if wrong.isEmpty():
            break
        if turn < ROUNDS:
            again, changed = _cut(sections.join(wrong, keys), piece_max, overlap, section), wrong
        else:
            again = changed = checkpointed(_followed(sections, done, wrong, piece_max, overlap, section))
        done = checkpointed(done.join(changed.select(*keys), keys, "left_anti").unionByName(again))
    return done.select(*keys, F.explode("pieces").alias("p")).select(*keys, "p.*")


def uncuttable(cut: DataFrame, piece_max: int) -> DataFrame:
    """(recording_id, stretch_start_ms): stretches longer than a piece that had to be cut in speech."""
    forced = cut.where((F.col("how") == "speech") & (F.col("stretch_ms") > piece_max))
    return forced.select("recording_id", "stretch_start_ms").distinct()
