"""Simulated meetings: utterances of several speakers placed on one time line by fitted or given pauses.

Utterances are dealt to meetings by hash, so meetings build in parallel; a meeting's
utterances fit a task by the bounds on speakers and duration.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.functions.signal import rng_for
from voxtile.functions.timeops import hash_int
from voxtile.session import keyed_stream, rows_to_batch

_OUT = pa.schema([("meeting", pa.int64()), ("id", pa.string()), ("speaker", pa.string()), ("start", pa.float64()), ("duration", pa.float64())])
_DDL = "meeting long, id string, speaker string, start double, duration double"


def sampled(utterances: DataFrame, meetings: int, speakers: int = 2, max_per_speaker: float = 20.0, seed: int = 0) -> DataFrame:
    """(meeting, speaker, id, duration): each speaker joins one meeting; a speaker's utterances stop at ``max_per_speaker`` seconds.

    Of a speaker's utterances the first by hash are taken, up to the bound.
    """
    u = utterances.where("speaker is not null and duration > 0").select("id", "speaker", "duration")
    u = u.withColumn("meeting", F.pmod(hash_int("speaker", seed), F.lit(meetings)))
    schema = pa.schema([("meeting", pa.int64()), ("speaker", pa.string()), ("id", pa.string()), ("duration", pa.float64())])

    class State:
        def __init__(self, key):
            self.key, self.held, self.out, self.seen = key[0], 0.0, [], {}

        def add(self, row):
            _, _, speaker, ident, d = row
            if speaker not in self.seen:
                if len(self.seen) == speakers:
                    return
                self.seen[speaker] = 0.0
            if self.seen[speaker] + d <= max_per_speaker or not self.seen[speaker]:
                self.seen[speaker] += d
                self.out.append((self.key, speaker, ident, d))

        def finish(self):
            return self.out

    work = u.withColumn("h", hash_int("id", seed + 1)).select("meeting", "h", "speaker", "id", "duration")
    work = work.repartition("meeting").sortWithinPartitions("meeting", hash_int("speaker", seed + 2), "speaker", "h", "id")
    return work.mapInArrow(keyed_stream(["meeting"], State, lambda rows: rows_to_batch(rows, schema)), "meeting long, speaker string, id string, duration double")


def independent(chosen: DataFrame, loc: float = 0.0, scale: float = 2.0, seed: int = 0) -> DataFrame:
    """(meeting, id, speaker, start, duration): each speaker's utterances after exponential silences, speakers independent of each other."""

    class State:
        def __init__(self, key):
            self.key, self.at, self.out = key, 0.0, []

        def add(self, row):
            _, speaker, ident, d = row
            pause = loc + rng_for(f"{self.key[0]}/{ident}", seed).exponential(scale)
            self.out.append((self.key[0], ident, speaker, round(self.at + pause, 3), d))
            self.at += pause + d

        def finish(self):
            return self.out

    work = chosen.select("meeting", "speaker", "id", "duration").repartition("meeting", "speaker").sortWithinPartitions("meeting", "speaker", hash_int("id", seed), "id")
    return work.mapInArrow(keyed_stream(["meeting", "speaker"], State, lambda rows: rows_to_batch(rows, _OUT)), _DDL)


def conversational(chosen: DataFrame, same_pause: float = 1.0, diff_pause: float = 1.0, overlap: float = 2.0, p_overlap: float = 0.5, seed: int = 0) -> DataFrame:
    """(meeting, id, speaker, start, duration): utterances in turn with pauses within and between speakers and overlaps of at most two at once."""

    class State:
        def __init__(self, key):
            self.key, self.out, self.ends, self.last, self.own = key, [], [0.0, 0.0], None, {}

        def add(self, row):
            _, speaker, ident, d = row
            g = rng_for(f"{self.key[0]}/{ident}", seed)
            latest, second = max(self.ends), min(self.ends)
            own = self.own.get(speaker, 0.0)
            if self.last is None:
                start = 0.0
            elif speaker == self.last:
                start = latest + g.exponential(same_pause)
            elif g.random() < p_overlap:
                start = latest - min(g.exponential(overlap), math.inf)
            else:
                start = latest + g.exponential(diff_pause)
            # no third voice, and nobody over oneself
            start = round(max(start, second, own, 0.0), 3)
            self.out.append((self.key[0], ident, speaker, start, d))
            self.own[speaker] = max(own, start + d)
            self.ends = sorted([latest, start + d])
            self.last = speaker

        def finish(self):
            return self.out

    work = chosen.select("meeting", "speaker", "id", "duration").repartition("meeting").sortWithinPartitions("meeting", hash_int("id", seed), "id")
    return work.mapInArrow(keyed_stream(["meeting"], State, lambda rows: rows_to_batch(rows, _OUT)), _DDL)
