"""Consolidation of very many small files into few well-sized ones (problem 2).

Method: sorted-run consolidation. Sorted runs (files, or partitions sorted where they are)
are cut into key ranges; the runs of a range are merged k ways (voxtile.operators.runs),
duplicates are kept, outputs roll by bytes, and the range metadata (first key, last key,
entries, bytes) follows from each output.

``registrations`` names the stored file behind every source: a path as it is, a file URL,
a path with doubled or backward slashes or dot steps, or the file that a shell command
reads. Paths are case-sensitive.

Scale: ranges are cut by the running bytes of all runs, so no task holds more than its
share; a range's rows stream through the merge, which holds one small block of each run
that overlaps the current key. A file that very many recordings name is numbered in one
stream and paired block by block over many tasks.

Defined results: null ids, null or blank sources and null source lists register no file;
such a recording still gets a place in the outputs. Null sizes count as 0 bytes. Repeated
deliveries of a recording are one recording; a file registered often is stored once.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import posixpath
import re
import shlex
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.operators.joins import block_pairs
from voxtile.operators.runs import merged
from voxtile.session import checkpointed, rows_to_batch

_FILE_URL = re.compile(r"file:(?://(?:localhost)?)?(?=/)", re.IGNORECASE)


def stored_path(kind: str | None, source: str | None) -> str | None:
    """The stored file that a source names: absolute, without dot steps, doubled slashes or escapes; else None."""
    if source is None or not (s := source.strip()):
        return None
    if m := _FILE_URL.match(s):
        path = unquote(s[m.end():])
    elif kind == "command" or s.endswith("|"):
        path = _read_by(s)
    elif s.startswith("\\"):
        path = s.replace("\\", "/")
    else:
        path = s
    if not path:
        return None
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return path
    return unicodedata.normalize("NFC", posixpath.normpath("/" + path.lstrip("/")))


def _read_by(command: str) -> str | None:
    """The first file that a shell command reads; relative names start at the last cd."""
    lexer = shlex.shlex(command, posix=True, punctuation_chars="|&;<>")
    lexer.whitespace_split = True
    try:
        words = list(lexer)
    except ValueError:
        words = command.split()
    folder, after_cd, operands = "", False, []
    for w in words:
        if set(w) <= set("|&;<>"):
            if operands:
                break
            operands, after_cd = [], False
        elif after_cd:
            folder, after_cd = posixpath.join(folder, w), False
        elif w == "cd":
            after_cd = True
        elif w.startswith("/"):
            return w
        elif folder and "." in w and not w.startswith("-") and not re.fullmatch(r"[\d.]+", w):
            operands.append(w)
    return posixpath.join(folder, operands[0]) if operands else None


@F.pandas_udf(T.StringType())
def _stored_path_udf(kind: pd.Series, source: pd.Series) -> pd.Series:
    known: dict[tuple, str | None] = {}
    out = []
    for key in zip(kind, source):
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = stored_path(*key)
        out.append(known[key])
    return pd.Series(out, dtype=object)


def _registered(audio: DataFrame) -> DataFrame:
    """(path, id): the stored files that each recording names, as often as it names them."""
    src = audio.where(F.col("id").isNotNull()).select("id", F.explode("sources").alias("__s"))
    src = src.select("id", F.col("__s.type").alias("type"), F.col("__s.source").alias("source")).where("source is not null")
    return src.withColumn("path", _stored_path_udf("type", "source")).where("path is not null").select("path", "id")


def registrations(audio: DataFrame) -> DataFrame:
    """(path, id): the stored files that each recording names, once each."""
    return _registered(audio).distinct()


def entries(audio: DataFrame, stored_files: DataFrame) -> DataFrame:
    """(key, kind, name, n_bytes): every recording once and every stored file that one names once.

    A recording's key is its first file's, so both come to lie side by side.
    """
    reg = registrations(audio)
    sizes = stored_files.groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))
    files = (
        reg.select("path").distinct().join(sizes, "path", "left")
        .select(F.concat(F.lit("f"), "path").alias("key"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))
    )
    first = reg.groupBy("id").agg(F.min("path").alias("path"))
    recordings = (
        audio.where(F.col("id").isNotNull()).select("id").distinct().join(first, "id", "left")
        .select(F.coalesce(F.concat(F.lit("f"), "path"), F.concat(F.lit("r"), "id")).alias("key"), F.lit("recording").alias("kind"), F.col("id").alias("name"), F.lit(0).cast("long").alias("n_bytes"))
    )
    return files.unionByName(recordings)


def shard_plan(audio: DataFrame, stored_files: DataFrame, target: int, least: int, ranges: int | None = None) -> DataFrame:
    """(shard, key, kind, name, n_bytes): every entry once, in key order, in outputs of about ``target`` bytes.

    Each partition of the entries is sorted by itself into a run; the runs of each key range
    are merged k ways. A stored file above the target fills an output alone. An output is
    closed before the entry that would exceed the target, unless it, or what is left of its
    range, holds fewer than ``least`` bytes.
    """
    # The entries are names and sizes, little beside the files: the runs are written once.
    runs = checkpointed(entries(audio, stored_files).sortWithinPartitions("key", "kind", "name"))
    done = merged(runs, ["key", "kind", "name"], "n_bytes", target, least, ranges=ranges)
    return done.select(F.format_string("%06d-%06d", "range", "output").alias("shard"), "key", "kind", "name", "n_bytes")


def range_metadata(plan: DataFrame) -> DataFrame:
    """(shard, first_key, last_key, n_entries, n_bytes) of each output."""
    return plan.groupBy("shard").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.count(F.lit(1)).alias("n_entries"), F.sum("n_bytes").alias("n_bytes"),
    )


_NUMBERED = pa.schema([("path", pa.string()), ("id", pa.string()), ("place", pa.int64())])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over merged registrations: each different one of a path with its place, if the path has more than one. Holds one row at a time."""
    last, place = None, 0
    for b in batches:
        rows = []
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if last is None or row[0] != last[0]:
                place = 0
            elif row != last:
                if not place:
                    rows.append((*last, 0))
                place += 1
                rows.append((*row, place))
            last = row
        yield rows_to_batch(rows, _NUMBERED)


def shared_files(audio: DataFrame, ranges: int | None = None, block: int = 1000) -> DataFrame:
    """(id_a, id_b): different recordings that name the same stored file.

    The registrations are sorted into runs where they are read. The merge of each key range
    puts equal paths side by side, drops equal registrations and numbers the rest of each
    path; these are paired block by block.
    """
    runs = checkpointed(_registered(audio).sortWithinPartitions("path", "id"))
    # a range of about a million registrations; a path is never parted, and its rows stream
    done = merged(runs, ["path", "id"], F.lit(1.0), 1e6, per_range=1, ranges=ranges, part_at=1)
    again = done.select("path", "id").mapInArrow(_numbered, "path string, id string, place long")
    pairs = block_pairs(again, "path", "place", "id", block)
    return pairs.select(F.least("left", "right").alias("id_a"), F.greatest("left", "right").alias("id_b")).distinct()


# ---- files on disk ---------------------------------------------------------------------------------------------


def consolidate_files(spark: SparkSession, paths: list[str] | str, key: str, out_dir: str, target: int, ranges: int | None = None) -> DataFrame:
    """Merge small Parquet files, each sorted by ``key`` (a string column), into files of about ``target`` bytes.

    ``paths`` are files, folders or patterns of any file system that Spark reads. A file is
    a run as it lies there; one that is not sorted is several. The runs of each key range
    are merged k ways, and outputs roll by bytes, a row's share of the inputs' bytes counting
    for the row. Gives the range metadata: (file, first_key, last_key, n_rows, n_bytes).
    Duplicates are kept; rows with a null key come first. Files are written through Spark's
    committer, so a repeated task leaves no second copy, and the rows in the outputs are
    counted against those of the inputs.
    """
    source = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    files = source.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
    sums = files.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    each = (sums["size"] or 0) / max(1, sums["n"] or 0)
    done = merged(source, [key], F.lit(each), target, ranges=ranges)
    shard = F.format_string("%06d-%06d", "range", "output")
    done.withColumn("__shard", shard).drop("range", "output").write.partitionBy("__shard").mode("overwrite").parquet(out_dir)
    written = spark.read.schema(source.schema).option("recursiveFileLookup", "true").parquet(out_dir)
    local = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    out = checkpointed(
        written.select(local.alias("file"), F.col(key).alias("k"), F.col("_metadata.file_size").alias("b")).groupBy("file")
        .agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.count(F.lit(1)).alias("n_rows"), F.max("b").alias("n_bytes"))
    )
    n = out.agg(F.sum("n_rows")).first()[0] or 0
    if n != (sums["n"] or 0):
        raise ValueError(f"{n} rows were written of {sums['n']}")
    return out
