"""Fluent sets over DataFrames: recordings, segments, features, cuts. Every method gives a new, lazy set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtile.operators import batching, cuts, dataset, joins, qa, stats
from voxtile.sources import manifests


class Dataset:
    """A set of rows with ids. ``order`` names the columns that decide what comes first."""

    kind = "cut"
    order: tuple[str, ...] = ("id",)

    def __init__(self, df: DataFrame):
        self.df = df

    def _new(self, df: DataFrame):
        return type(self)(df)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, permissive: bool = False):
        if path.endswith(".parquet"):
            return cls(spark.read.parquet(path))
        return cls(manifests.read_manifest(spark, path, cls.kind, permissive))

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str]):
        first, *rest = (cls.from_file(spark, p) for p in paths)
        return first.combine(*rest) if rest else first

    @classmethod
    def from_dicts(cls, spark: SparkSession, rows: list[dict]):
        return cls(spark.createDataFrame(rows, manifests.SCHEMAS[cls.kind]))

    def to_file(self, path: str, compression: str = "none") -> None:
        manifests.write_manifest(self.df, path, compression)

    def append_to(self, path: str) -> int:
        return manifests.append_missing(self.df, path)

    def filter(self, predicate: Column | str):
        return self._new(self.df.where(predicate))

    def map(self, fn: Callable[[DataFrame], DataFrame], apply_to: Column | None = None):
        """A transformation of the rows; with ``apply_to`` only of those rows, the rest pass."""
        if apply_to is None:
            return self._new(fn(self.df))
        gate = F.coalesce(apply_to, F.lit(False))
        return self._new(fn(self.df.where(gate)).unionByName(self.df.where(~gate), allowMissingColumns=True))

    def combine(self, *others):
        out = self.df
        for o in others:
            out = out.unionByName(o.df, allowMissingColumns=True)
        return self._new(out)

    __add__ = combine

    def ids(self) -> DataFrame:
        return self.df.select("id")

    def modify_ids(self, fn: Callable[[Column], Column]):
        return self._new(self.df.withColumn("id", fn(F.col("id"))))

    def subset(self, first: int | None = None, last: int | None = None):
        return self._new(dataset.subset(self.df, *self.order, first=first, last=last))

    def split(self, n: int, drop_last: bool = False):
        """n sets; the parts share one pass over the data."""
        parts = dataset.split(self.df, n, *self.order, drop_last=drop_last)
        return [self._new(parts.where(F.col("part") == i).drop("part")) for i in range(n)]

    def split_chunks(self, size: int) -> DataFrame:
        return dataset.split_chunks(self.df, size, *self.order)

    def shuffle(self, seed: int = 0, epoch: int = 0):
        return self._new(dataset.shuffle(self.df, "id", seed, epoch))

    def sample(self, n: int, seed: int = 0):
        return self._new(dataset.sample(self.df, n, "id", seed))

    def repeat(self, times: int, preserve_id: bool = False):
        return self._new(dataset.repeat(self.df, times, preserve_id).drop("_rep"))

    def mux(self, *others, weights: list[float] | None = None, seed: int = 0, stop_early: bool = False):
        return self._new(dataset.mux([self.df, *(o.df for o in others)], weights, seed=seed, stop_early=stop_early))

    def partition(self, rank: int, world: int):
        return self._new(dataset.partition_rank(self.df, rank, world, *self.order))

    def count(self) -> int:
        return self.df.count()


class RecordingSet(Dataset):
    kind = "recording"

    def validate(self) -> DataFrame:
        return qa.check_recordings(self.df)

    def with_path_prefix(self, prefix: str):
        return self._new(cuts.with_path_prefix(self.df, "sources", "source", prefix))

    def to_cuts(self) -> "CutSet":
        return CutSet(self.df.select("id", F.lit(0.0).alias("start"), "duration", F.lit(0).alias("channel"), F.lit("MonoCut").alias("type"), F.expr("cast(array() as array<struct<id:string,recording_id:string,start:double,duration:double,channel:array<int>,text:string,speaker:string>>)").alias("supervisions"), F.struct("id", "sampling_rate", "duration").alias("recording")))


class SupervisionSet(Dataset):
    kind = "supervision"
    order = ("recording_id", "start", "id")

    def validate(self) -> DataFrame:
        return qa.check_supervisions(self.df)

    def find(self, recording_id: str, **kw):
        return self._new(joins.find_segments(self.df, recording_id, **kw))

    def transform_text(self, fn: Callable[[Column], Column]):
        return self._new(self.df.withColumn("text", fn(F.col("text"))))

    def transform_alignment(self, fn: Callable[[Column], Column], kind: str = "word"):
        return self._new(self.df.withColumn("alignment", F.transform_values("alignment", lambda k, v: F.when(k == kind, F.transform(v, lambda x: x.withField("symbol", fn(x["symbol"])))).otherwise(v))))

    def with_alignment(self, words: DataFrame, kind: str = "word", match_channel: bool = False):
        """Words joined into the segments that hold them; segments without any get an empty list."""
        hits = joins.words_in_segments(self.df, words, match_channel)
        item = F.struct(F.col("symbol"), F.col("w_start").alias("start"), F.col("w_duration").alias("duration"), F.lit(None).cast("double").alias("score"))
        per = hits.groupBy(F.col("sup_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w_start", "symbol", item.alias("i")))), lambda x: x["i"]).alias("__w"))
        out = self.df.join(per, "id", "left")
        empty = F.expr("cast(array() as array<struct<symbol:string,start:double,duration:double,score:double>>)")
        return self._new(out.withColumn("alignment", F.create_map(F.lit(kind), F.coalesce("__w", empty))).drop("__w"))


class FeatureSet(Dataset):
    kind = "features"
    order = ("storage_key",)

    def validate(self) -> DataFrame:
        return qa.check_features(self.df)

    def best_for(self, requests: DataFrame, leeway: float = joins.LEEWAY) -> DataFrame:
        return joins.best_features(requests, self.df, leeway)


class CutSet(Dataset):
    kind = "cut"

    @classmethod
    def from_manifests(cls, recordings: RecordingSet, supervisions: SupervisionSet, part_s: float | None = None):
        return cls(joins.cuts_from_manifests(recordings.df, supervisions.df, part_s))

    def truncate(self, max_duration: float, offset_type: str = "start", keep_excessive_supervisions: bool = True, seed: int = 0):
        return self._new(cuts.truncate_to(self.df, max_duration, offset_type, keep_excessive_supervisions, seed))

    def cut_into_windows(self, duration: float, hop: float | None = None, keep_excessive_supervisions: bool = True):
        return self._new(cuts.cut_into_windows(self.df, duration, hop, keep_excessive_supervisions))

    def cut_into_windows_balanced(self, low: int, high: int, overlap: float = 0.0):
        return self._new(cuts.cut_into_windows_balanced(self.df, low, high, overlap))

    def trim_to_supervisions(self, keep_overlapping: bool = True, min_duration: float | None = None, context_direction: str = "center", keep_all_channels: bool = False):
        return self._new(cuts.trim_to_supervisions(self.df, keep_overlapping, min_duration, context_direction, keep_all_channels))

    def trim_to_supervision_groups(self, max_pause: float = 0.0):
        return self._new(cuts.trim_to_supervision_groups(self.df, max_pause))

    def trim_to_unsupervised_segments(self):
        return self._new(cuts.trim_to_unsupervised(self.df))

    def extend_by(self, duration: float, direction: str = "both"):
        return self._new(cuts.extend_by(self.df, duration, direction))

    def pad(self, duration: float, direction: str = "right"):
        return self._new(cuts.pad(self.df, duration, direction))

    def filter_supervisions(self, predicate: Callable[[Column], Column]):
        return self._new(cuts.filter_supervisions(self.df, predicate))

    def map_supervisions(self, fn: Callable[[Column], Column]):
        return self._new(cuts.map_supervisions(self.df, fn))

    def transform_text(self, fn: Callable[[Column], Column]):
        return self._new(cuts.transform_text(self.df, fn))

    def merge_supervisions(self, policy: str = "delimiter", span: str = "last"):
        return self._new(cuts.merge_supervisions(self.df, policy, span))

    def fill_supervisions(self, add_empty: bool = True, shrink_ok: bool = False):
        return self._new(cuts.fill_supervisions(self.df, add_empty, shrink_ok))

    def perturb_speed(self, factor: float, affix_id: bool = True):
        return self._new(cuts.perturb_speed(self.df, factor, affix_id))

    def perturb_tempo(self, factor: float, affix_id: bool = True):
        return self._new(cuts.perturb_speed(self.df, factor, affix_id, "tp"))

    def perturb_volume(self, factor: float, affix_id: bool = True):
        return self._new(cuts.perturb_volume(self.df, factor, affix_id))

    def resample(self, sampling_rate: int):
        return self._new(cuts.resample(self.df, sampling_rate))

    def narrowband(self, codec: str):
        return self._new(cuts.affixed(self.df, f"_nb_{codec}"))

    def reverb(self):
        return self._new(cuts.affixed(self.df, "_rvb"))

    def drop_features(self):
        return self._new(cuts.drop_parts(self.df, "features"))

    def drop_recordings(self):
        return self._new(cuts.drop_parts(self.df, "recording"))

    def drop_supervisions(self):
        return self._new(cuts.drop_parts(self.df, "supervisions"))

    def sort_by_duration(self, ascending: bool = False):
        return self._new(dataset.sort_by_duration(self.df, ascending))

    def sort_by_recording_id(self):
        return self._new(self.df.orderBy(F.col("recording.id"), "id"))

    def speakers(self) -> DataFrame:
        return self.df.select(F.explode("supervisions").alias("s")).select("s.speaker").where("speaker is not null").distinct().orderBy("speaker")

    def decompose(self) -> tuple[RecordingSet, SupervisionSet, FeatureSet]:
        rec, sup, feats = joins.decompose(self.df)
        return RecordingSet(rec), SupervisionSet(sup), FeatureSet(feats)

    def describe(self) -> DataFrame:
        return stats.describe_durations(self.df)

    def describe_speech(self) -> DataFrame:
        return stats.describe_speech(self.df)

    def validate(self) -> DataFrame:
        return qa.check_cuts(self.df)

    def batches(self, constraint: batching.Constraint, mode: str = "dynamic", stratum: str | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
        return batching.greedy_batches(self.df, constraint, "duration", mode, stratum, order)

    def bucketed_batches(self, bounds: list[float], constraint: batching.Constraint, seed: int = 0, epoch: int = 0) -> DataFrame:
        return batching.bucketed_batches(self.df, bounds, constraint, seed=seed, epoch=epoch)
