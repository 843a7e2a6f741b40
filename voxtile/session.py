"""Session helpers: table loading, the shared checkpoint folder, batch-keyed Arrow streams."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take spark.checkpoint.dir; make a folder of our own only where it is unset and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxtile-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, files: int) -> int:
    """How many partitions a listing of files gets: four for each core, at most one for each file."""
    return max(1, min(files, 4 * spark.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many partitions as there are cores, for work that is heavy per row.

    A large table has more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: The fields whose nulls tell how complete a delivery is; one list for all callers, so that all choose the same one.
SEGMENT_FIELDS = ("recording_id", "start", "duration", "text", "language", "speaker")
RECORDING_FIELDS = ("sampling_rate", "num_samples", "duration", "sources")


def delivered(df: DataFrame, fields: tuple[str, ...], order: str = "received_at") -> DataFrame:
    """Adds ``__rank``: fewest nulls in the fields that the table has, then the earliest, then a hash of the fields."""
    have = [c for c in fields if c in df.columns]
    nulls = sum((F.col(c).isNull().cast("int") for c in have), F.lit(0))
    return df.withColumn("__rank", F.struct(nulls.alias("nulls"), F.col(order).alias("order"), F.xxhash64(*have).alias("hash")))


def first_of(ranked: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key: the one of least ``__rank`` (ties: the smallest row). Rows with a null key are dropped.

    The minimum of a struct is aggregated before the shuffle, so a key with very many
    deliveries costs one row per input partition.
    """
    picked = ranked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("__rank", *cols)).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in cols])


def first_delivery(df: DataFrame, fields: tuple[str, ...], cols: list[str], key: str = "id") -> DataFrame:
    """One row per key: of repeated deliveries the most complete, then the earliest."""
    return first_of(delivered(df, fields), key, cols)


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", salts: int = 4) -> DataFrame:
    """A join with a table of one row per key in which a key of very many rows is split into parts by the hash of ``by``."""
    parts = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return rows.join(parts, [key, "__part"], how).drop("__part")


def finite(c: Column) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    return F.when(F.abs(c) < F.lit(9.0e14), c)


def whole_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds: times 1,000, rounded half away from zero."""
    return F.round(finite(seconds) * 1000.0).cast("long")


def keyed_stream(
    keys: list[str], start: Callable[[tuple], object], batch_out: Callable[[list], pa.RecordBatch]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function for input that is hash-partitioned and sorted by ``keys``.

    ``start(key)`` makes the state of one key; the state has ``add(row_tuple)`` and
    ``finish() -> list of output tuples``, and may put rows that are ready into ``out``. One key's state is held at a time, and a
    key may span any number of Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            names = batch.schema.names
            at = [names.index(k) for k in keys]
            for row in zip(*cols):
                key = tuple(row[i] for i in at)
                if key != current:
                    if state is not None:
                        out.extend(state.finish())
                        if len(out) >= 20_000:
                            yield batch_out(out)
                            out = []
                    current, state = key, start(key)
                state.add(row)
                if len(out) + len(getattr(state, "out", ())) >= 20_000:  # rows that are ready do not wait for the key's end
                    out.extend(getattr(state, "out", ()))
                    if hasattr(state, "out"):
                        state.out = []
                    yield batch_out(out)
                    out = []
        if state is not None:
            out.extend(state.finish())
        if out:
            yield batch_out(out)

    return run


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
