"""Array payloads in rows or files: exact and quantised codecs, pluggable openers, relocation of files."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import subprocess
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(x: np.ndarray) -> bytes:
    """An array as .npy bytes."""
    out = io.BytesIO()
    np.save(out, np.asarray(x), allow_pickle=False)
    return out.getvalue()


def unpack(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def pack_lossy(x: np.ndarray, tick_power: int = -5) -> bytes:
    """Values to the nearest multiple of 2**tick_power, differences along time deflated; the error is at most half a tick."""
    x = np.atleast_2d(np.asarray(x, dtype=np.float64))
    ticks = np.rint(x / 2.0**tick_power).astype(np.int32)
    diff = np.diff(ticks, axis=0, prepend=np.zeros((1, ticks.shape[1]), dtype=np.int32))
    head = np.array([tick_power, *ticks.shape], dtype=np.int32).tobytes()
    return head + zlib.compress(diff.tobytes())


def unpack_lossy(data: bytes) -> np.ndarray:
    power, n, bins = np.frombuffer(data[:12], dtype=np.int32)
    diff = np.frombuffer(zlib.decompress(data[12:]), dtype=np.int32).reshape(n, bins)
    return (np.cumsum(diff, axis=0) * 2.0 ** float(power)).astype(np.float32)


CODECS = {"npy": (pack, unpack), "lossy": (pack_lossy, unpack_lossy)}


def packed_column(df: DataFrame, matrix: str, codec: str = "npy", out: str = "payload") -> DataFrame:
    """A matrix column as bytes in the row."""
    fn = CODECS[codec][0]

    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(np.array([np.asarray(r) for r in v], dtype=np.float32)) for v in x])

    return df.withColumn(out, run(F.col(matrix)))


def unpacked_column(df: DataFrame, payload: str, codec: str = "npy", out: str = "features") -> DataFrame:
    fn = CODECS[codec][1]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(bytes(v)).astype(np.float32).tolist() for v in x])

    return df.withColumn(out, run(F.col(payload)))


def write_files(df: DataFrame, payload: str, folder: str, key: str = "id") -> DataFrame:
    """Payloads to one file each; gives (id, path)."""
    os.makedirs(folder, exist_ok=True)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            paths = [os.path.join(folder, f"{k}.bin") for k in pdf[key]]
            for p, data in zip(paths, pdf[payload]):
                with open(p, "wb") as f:
                    f.write(bytes(data))
            yield pd.DataFrame({"id": pdf[key], "path": paths})

    return df.select(F.col(key).alias(key), payload).mapInPandas(run, "id string, path string")


def copy_files(df: DataFrame, path: str, folder: str) -> DataFrame:
    """Copies the files that a column names and points the column to the copies. Files of one name from several folders stay apart."""
    os.makedirs(folder, exist_ok=True)
    schema = df.schema

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for p in pdf[path]:
                if p is None:
                    out.append(None)
                    continue
                to = os.path.join(folder, f"{zlib.crc32(os.path.dirname(p).encode()):08x}-{os.path.basename(p)}")
                shutil.copyfile(p, to)
                out.append(to)
            yield pdf.assign(**{path: out})

    return df.mapInPandas(run, schema)


def open_any(path: str, mode: str = "rb"):
    """A plain or gzipped file, ``-`` for the standard streams, ``pipe:command`` for what a command prints; gzip by ``.gz``."""
    if path == "-":
        stream = sys.stdin if "r" in mode else sys.stdout
        return stream.buffer if "b" in mode else stream
    if path.startswith("pipe:"):
        if "r" not in mode:
            raise ValueError("pipes can only be read")
        data = subprocess.run(["/bin/sh", "-c", path[5:]], check=True, capture_output=True).stdout
        return io.BytesIO(data) if "b" in mode else io.StringIO(data.decode())
    if path.endswith(".gz"):
        return gzip.open(path, mode)
    if "://" in path:
        raise ValueError(f"no opener for {path}: read it through Spark's own file systems")
    return open(path, mode)
