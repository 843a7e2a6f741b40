"""Tar shards as a Spark data source and sink, byte-offset indexes, sharded sets of cuts with payload fields.

Reading: ``spark.read.format("tar").option("path", ...)`` after ``register(spark)``; one
partition per archive, members stream. Writing: shards of a fixed number of rows, one
archive per field, names by shard number, so a repeated task writes the same files.
"""

from __future__ import annotations

import glob as globbing
import io
import json
import os
import struct
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxtile.operators.dataset import split_chunks
from voxtile.session import rows_to_batch, tasks_for
from voxtile.sources.manifests import parse_pointer

_MEMBERS = "archive string, name string, offset long, size long, data binary"


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, options: dict, payload: bool):
        self.paths = expand(options["path"])
        self.payload = payload

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        if not isinstance(partition, _Archive):
            return
        with tarfile.open(partition.path, "r|*" if self.payload else "r:*") as tar:
            for m in tar:
                if m.isfile():
                    data = tar.extractfile(m).read() if self.payload else None
                    yield (partition.path, m.name, m.offset_data, m.size, data)


class TarSource(DataSource):
    """Members of tar archives: archive, name, offset, size, data (null with payload=false)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema):
        return TarReader(dict(self.options), str(self.options.get("payload", "true")).lower() != "false")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)


def expand(path: str) -> list[str]:
    """Comma-separated paths, folders and patterns to a sorted list of files."""
    out = []
    for p in path.split(","):
        p = p.strip()
        if os.path.isdir(p):
            out += globbing.glob(os.path.join(p, "*.tar*"))
        else:
            out += globbing.glob(p)
    return sorted(f for f in out if not f.endswith(".idx"))


_PAIRED = pa.schema([("archive", pa.string()), ("key", pa.string()), ("payload", pa.binary()), ("meta", pa.string())])


def members_as_pairs(members: DataFrame) -> DataFrame:
    """(archive, key, payload, meta): the data and the JSON of each key in one row.

    Members of one key are neighbours in their archive, so they are paired as they stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = []
            for archive, name, data in zip(*[c.to_pylist() for c in b.columns]):
                key, _, ext = name.rpartition(".") if "." in name else (name, "", "")
                if held is None or held[:2] != [archive, key]:
                    if held is not None:
                        rows.append(tuple(held))
                    held = [archive, key, None, None]
                if ext == "json":
                    held[3] = data.decode()
                else:
                    held[2] = data
            yield rows_to_batch(rows, _PAIRED)
        if held is not None:
            yield rows_to_batch([tuple(held)], _PAIRED)

    return members.select("archive", "name", "data").mapInArrow(run, "archive string, key string, payload binary, meta string")


# ---- writing and reading shards ---------------------------------------------------------------------------------


def _numbered(df: DataFrame, size: int, order: str) -> DataFrame:
    """Adds ``chunk``: shards of ``size`` keys in order. Only keys are sorted, payloads are not; rows of one key stay together."""
    keys = split_chunks(df.select(F.col(order).alias("__id")).distinct(), size, "__id")
    return df.join(keys, F.col(order).eqNullSafe(F.col("__id"))).drop("__id")


def _add(tar: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def write_shards(df: DataFrame, out_dir: str, fields: list[str], shard_size: int = 1000, order: str = "id") -> DataFrame:
    """Shards of ``shard_size`` rows: cuts.{shard}.jsonl and {field}.{shard}.tar per binary field; gives (shard, n).

    Rows without a payload get an empty member, so that fields stay aligned. The cut's own
    start becomes 0, for its payload begins there.
    """
    os.makedirs(out_dir, exist_ok=True)
    meta_cols = [c for c in df.columns if c not in fields]
    start = {"start": F.lit(0.0)} if "start" in df.columns else {}
    rows = _numbered(df, shard_size, order)
    rows = rows.select("chunk", F.col(order).cast("string").alias("__k"), F.to_json(F.struct(*[(start.get(c, F.col(c))).alias(c) for c in meta_cols])).alias("__meta"), *fields)
    work = rows.repartition("chunk").sortWithinPartitions("chunk", "__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, text, tars, n, done = None, None, [], 0, []

        def close():
            if shard is not None:
                for t in (text, *tars):
                    t.close()
                done.append((shard, n))

        for b in batches:
            for chunk, key, meta, *payloads in zip(*(c.to_pylist() for c in b.columns)):
                if chunk != shard:
                    close()
                    shard, n = chunk, 0
                    text = open(os.path.join(out_dir, f"cuts.{shard:06d}.jsonl"), "w", encoding="utf-8")
                    tars = [tarfile.open(os.path.join(out_dir, f"{f}.{shard:06d}.tar"), "w") for f in fields]
                text.write(meta + "\n")
                for t, p in zip(tars, payloads):
                    _add(t, f"{key}.bin", p or b"")
                    _add(t, f"{key}.json", json.dumps({"id": key, "missing": p is None}).encode())
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array([k for _, k in done], pa.int64())], names=["shard", "n"])

    return work.mapInArrow(run, "shard long, n long")


def read_shards(spark: SparkSession, in_dir: str, fields: list[str], schema: str, shards: list[int] | None = None) -> DataFrame:
    """Cuts with their payload fields and ``shard``; a cut and a payload that do not belong together are an error."""
    numbers = sorted(int(f.split(".")[1]) for f in os.listdir(in_dir) if f.startswith("cuts.") and f.endswith(".jsonl"))
    listed = spark.createDataFrame([(n,) for n in (numbers if shards is None else shards)], "shard long").repartition(tasks_for(spark, len(numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                tars = [tarfile.open(os.path.join(in_dir, f"{f}.{n:06d}.tar"), "r|") for f in fields]
                streams = [_pairs(t) for t in tars]
                held: list[tuple] = []
                with open(os.path.join(in_dir, f"cuts.{n:06d}.jsonl"), encoding="utf-8") as lines:
                    for line in lines:
                        ident, payloads = json.loads(line)["id"], []
                        for s in streams:
                            key, data, missing = next(s)
                            if key != ident:
                                raise ValueError(f"shard {n}: cut {ident} meets the payload of {key}")
                            payloads.append(None if missing else data)
                        held.append((n, line, *payloads))
                        if len(held) == 500:
                            yield _rows(held, fields)
                            held = []
                yield _rows(held, fields)

    raw = listed.mapInArrow(run, "shard long, __line string" + "".join(f", {f} binary" for f in fields))
    return raw.select("shard", F.from_json("__line", schema).alias("c"), *fields).select("shard", "c.*", *fields)


def _rows(held: list[tuple], fields: list[str]) -> pa.RecordBatch:
    cols = list(zip(*held)) if held else [[] for _ in range(2 + len(fields))]
    kinds = [pa.int64(), pa.string(), *[pa.binary()] * len(fields)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], names=["shard", "__line", *fields])


def _pairs(tar: tarfile.TarFile) -> Iterator[tuple[str, bytes, bool]]:
    members = iter(tar)
    for m in members:
        data = tar.extractfile(m).read()
        meta = json.loads(tar.extractfile(next(members)).read())
        yield meta["id"], data, meta["missing"]


# ---- indexes ----------------------------------------------------------------------------------------------------


def write_line_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Beside each JSON-lines file an ``.idx`` of little-endian 64-bit offsets and the file's size; gives (path, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, counts = b.column(0).to_pylist(), []
            for p in paths:
                at, n = 0, 0
                with open(p, "rb") as f, open(p + ".idx", "wb") as out:
                    for line in f:
                        if line.strip():
                            out.write(struct.pack("<Q", at))
                            n += 1
                        at += len(line)
                    out.write(struct.pack("<Q", at))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_for(spark, len(paths))).mapInArrow(run, "path string, n long")


def write_tar_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Beside each archive an ``.idx`` of the offsets of its members' headers and the end of the last; gives (path, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, counts = b.column(0).to_pylist(), []
            for p in paths:
                with tarfile.open(p) as tar, open(p + ".idx", "wb") as out:
                    members = [m for m in tar if m.isfile()]
                    for m in members:
                        out.write(struct.pack("<Q", m.offset))
                    out.write(struct.pack("<Q", os.path.getsize(p)))
                counts.append(len(members))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_for(spark, len(paths))).mapInArrow(run, "path string, n long")


def index_is_fresh(path: str) -> bool:
    """Whether an index exists and its last entry is the file's size."""
    if not os.path.exists(path + ".idx"):
        return False
    with open(path + ".idx", "rb") as f:
        f.seek(-8, os.SEEK_END)
        return struct.unpack("<Q", f.read(8))[0] == os.path.getsize(path)


def read_indexed(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(path, row, line) for requests (path, row): one seek and one read each, through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, rows, lines = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for p, r in zip(paths, rows):
                with open(p + ".idx", "rb") as x:
                    x.seek(8 * r)
                    begin, end = struct.unpack("<QQ", x.read(16))
                with open(p, "rb") as f:
                    f.seek(begin)
                    lines.append(f.read(end - begin).decode().strip())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(lines, pa.string())], names=["path", "row", "line"])

    return requests.select("path", F.col("row").cast("long")).mapInArrow(run, "path string, row long, line string")


def catalogue_of(spark: SparkSession, role: str, paths: list[str]) -> DataFrame:
    """One table for many indexes: (collection, role, path, shard, first_row, n), rows numbered over all shards.

    The collection's key is the hash of its role and paths. One row per shard.
    """
    sizes, at = [], 0
    for i, p in enumerate(paths):
        if not index_is_fresh(p):
            raise ValueError(f"no fresh index for {p}")
        n = os.path.getsize(p + ".idx") // 8 - 1
        sizes.append((role, p, i, at, n))
        at += n
    df = spark.createDataFrame(sizes, "role string, path string, shard int, first_row long, n long")
    return df.withColumn("collection", F.sha1(F.lit(role + "|" + "|".join(paths))))


def read_pointer(text: str) -> bytes:
    """The bytes that a pointer names, by one ranged read."""
    path, offset, end = parse_pointer(text)
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read(end - offset)


def write_bundles(df: DataFrame, out_dir: str, payload: str, shard_size: int = 1000, key: str = "id") -> DataFrame:
    """Archives of ``shard_size`` rows, each row as ``{key}.json`` and ``{key}.bin`` side by side; gives (shard, n)."""
    os.makedirs(out_dir, exist_ok=True)
    rows = _numbered(df, shard_size, key)
    meta = F.to_json(F.struct(*[c for c in df.columns if c != payload]))
    work = rows.select("chunk", F.col(key).cast("string").alias("k"), meta.alias("m"), payload).repartition("chunk").sortWithinPartitions("chunk", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tar, n, done = None, None, 0, []
        for b in batches:
            for chunk, k, m, p in zip(*(c.to_pylist() for c in b.columns)):
                if chunk != shard:
                    if tar is not None:
                        tar.close()
                        done.append((shard, n))
                    shard, n = chunk, 0
                    tar = tarfile.open(os.path.join(out_dir, f"bundle.{shard:06d}.tar"), "w")
                _add(tar, f"{k}.json", m.encode())
                if p is not None:
                    _add(tar, f"{k}.bin", p)
                n += 1
        if tar is not None:
            tar.close()
            done.append((shard, n))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array([k for _, k in done], pa.int64())], names=["shard", "n"])

    return work.mapInArrow(run, "shard long, n long")


def read_bundles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such archives with ``payload``; an archive streams through one task."""
    register(spark)
    pairs = members_as_pairs(spark.read.format("tar").option("path", path).load())
    return pairs.select(F.from_json("meta", schema).alias("c"), "payload").select("c.*", "payload")


def shard_order(n: int, seed: int = 0, epoch: int = 0, rank: int = 0, world: int = 1) -> list[int]:
    """The shards of one reader in a seeded order that all readers share."""
    import random

    order = list(range(n))
    random.Random(f"{seed}/{epoch}").shuffle(order)
    return order[rank::world]
