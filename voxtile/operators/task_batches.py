"""Batches as training tasks want them: one row per batch with aligned lists. A batch fits a row by its constraint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtile.functions.timeops import num_frames
from voxtile.operators.cuts import SUPS, frame_mask


def _placed(cuts: DataFrame, batches: DataFrame) -> DataFrame:
    return cuts.join(batches.select("id", "batch"), "id")


def recognition(cuts: DataFrame, batches: DataFrame, frame_shift: float = 0.01) -> DataFrame:
    """(batch, cut_ids, texts, intervals): texts of all segments and (place in the batch, first frame, frames) of each."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("duration")).alias("k"), "id", SUPS, F.coalesce("recording.sampling_rate", F.lit(16000)).alias("sr"))))
    b = _placed(cuts, batches).groupBy("batch").agg(ordered.alias("c"))
    spans = F.flatten(F.transform("c", lambda c, i: F.transform(c[SUPS], lambda s: F.struct(i.alias("sequence"), num_frames(F.greatest(s["start"], F.lit(0.0)), frame_shift, c["sr"]).alias("start"), num_frames(s["duration"], frame_shift, c["sr"]).alias("n"), s["text"].alias("text")))))
    return b.select("batch", F.transform("c", lambda c: c["id"]).alias("cut_ids"), F.transform(spans, lambda x: x["text"]).alias("texts"), F.transform(spans, lambda x: x.dropFields("text")).alias("intervals"))


def voice_activity(cuts: DataFrame, batches: DataFrame, frame_shift: float = 0.01) -> DataFrame:
    """(batch, cut_ids, masks): a 0/1 mask of frames per cut."""
    m = _placed(cuts, batches).select("batch", "id", frame_mask(cuts, frame_shift).alias("mask"))
    b = m.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "mask"))).alias("c"))
    return b.select("batch", F.transform("c", lambda c: c["id"]).alias("cut_ids"), F.transform("c", lambda c: c["mask"]).alias("masks"))


def diarisation(cuts: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, cut_ids, speakers): the sorted speakers of each cut."""
    who = F.array_sort(F.array_distinct(F.filter(F.transform(SUPS, lambda s: s["speaker"]), lambda x: x.isNotNull())))
    b = _placed(cuts, batches).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", who.alias("who")))).alias("c"))
    return b.select("batch", F.transform("c", lambda c: c["id"]).alias("cut_ids"), F.transform("c", lambda c: c["who"]).alias("speakers"))


def synthesis(cuts: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, cut_ids, texts, speakers) of cuts with exactly one segment."""
    one = _placed(cuts, batches).where(F.size(SUPS) == 1)
    b = one.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", F.col(SUPS)[0]["text"].alias("text"), F.col(SUPS)[0]["speaker"].alias("speaker")))).alias("c"))
    return b.select("batch", *[F.transform("c", lambda c: c["id"]).alias("cut_ids"), F.transform("c", lambda c: c["text"]).alias("texts"), F.transform("c", lambda c: c["speaker"]).alias("speakers")])


def tagging(cuts: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """(batch, cut_ids, tags): one custom attribute per cut."""
    b = _placed(cuts, batches).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", F.try_element_at("custom", F.lit(key)).alias("tag")))).alias("c"))
    return b.select("batch", F.transform("c", lambda c: c["id"]).alias("cut_ids"), F.transform("c", lambda c: c["tag"]).alias("tags"))


def unsupervised(cuts: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, cut_ids) by falling duration."""
    b = _placed(cuts, batches).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct((-F.col("duration")).alias("k"), "id"))).alias("c"))
    return b.select("batch", F.transform("c", lambda c: c["id"]).alias("cut_ids"))
