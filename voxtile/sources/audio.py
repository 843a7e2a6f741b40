"""WAV files: probing headers, reading spans, writing. Other codecs need decoders that are not part of this package."""

from __future__ import annotations

import glob as globbing
import io
import os
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtile.session import tasks_for
from voxtile.sources.manifests import SCHEMAS


def _head(source: str | bytes, n: int = 65_536) -> bytes:
    if isinstance(source, bytes):
        return source[:n]
    with open(source, "rb") as f:
        return f.read(n)


def _sphere_header(head: bytes) -> dict[str, str]:
    """The fields of a SPHERE header, and ``header_bytes``."""
    lines = head.decode("latin-1").split("\n")
    out = {"header_bytes": lines[1].strip()}
    for line in lines[2:]:
        if line.strip() == "end_head":
            break
        parts = line.split(None, 2)
        if len(parts) == 3:
            out[parts[0]] = parts[2]
    return out


def probe(source: str | bytes) -> tuple[int, int, int]:
    """(rate, samples, channels) from the header of a WAV, FLAC or SPHERE file, by its first bytes."""
    head = _head(source)
    if head[:4] == b"fLaC":
        # the first block describes the stream: rate in 20 bits, channels in 3, sample width in 5, samples in 36
        bits = int.from_bytes(head[18:26], "big")
        return bits >> 44, bits & ((1 << 36) - 1), (bits >> 41 & 7) + 1
    if head[:7] == b"NIST_1A":
        h = _sphere_header(head)
        return int(h["sample_rate"]), int(h["sample_count"]), int(h.get("channel_count", "1"))
    with wave.open(source if isinstance(source, str) else io.BytesIO(source), "rb") as w:
        return w.getframerate(), w.getnframes(), w.getnchannels()


def _mu_law(x: np.ndarray) -> np.ndarray:
    """Companded bytes to 16-bit steps."""
    u = ~x.astype(np.uint8)
    size = ((((u & 0x0F).astype(np.int32) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size)


def _read_sphere(source: str | bytes, offset: float, duration: float | None) -> tuple[np.ndarray, int]:
    h = _sphere_header(_head(source))
    rate, n, c = int(h["sample_rate"]), int(h["sample_count"]), int(h.get("channel_count", "1"))
    coding = h.get("sample_coding", "pcm").split(",")
    if len(coding) > 1 or coding[0] not in ("pcm", "ulaw", "mu-law"):
        raise ValueError(f"cannot read samples coded as {h['sample_coding']}")
    width = int(h.get("sample_n_bytes", "1" if coding[0] != "pcm" else "2"))
    first = min(max(0, int(round(offset * rate))), n)
    count = n - first if duration is None else min(n - first, int(round(duration * rate)))
    begin, size = int(h["header_bytes"]) + first * c * width, count * c * width
    if isinstance(source, bytes):
        raw = source[begin : begin + size]
    else:
        with open(source, "rb") as f:
            f.seek(begin)
            raw = f.read(size)
    if coding[0] != "pcm":
        steps = _mu_law(np.frombuffer(raw, dtype=np.uint8))
    elif width == 2:
        steps = np.frombuffer(raw, dtype=">i2" if h.get("sample_byte_format", "01") == "10" else "<i2")
    else:
        raise ValueError("only 16-bit PCM is supported")
    return steps.reshape(-1, c).T / 32768.0, rate


def read_samples(source: str | bytes, offset: float = 0.0, duration: float | None = None, channels: list[int] | None = None) -> tuple[np.ndarray, int]:
    """((channels, samples) in [-1, 1), rate) of a span of a 16-bit WAV, or a SPHERE file of PCM or mu-law samples."""
    if _head(source, 7) == b"NIST_1A":
        data, rate = _read_sphere(source, offset, duration)
        return (data if channels is None else data[channels]), rate
    with wave.open(source if isinstance(source, str) else io.BytesIO(source), "rb") as w:
        rate, n, c = w.getframerate(), w.getnframes(), w.getnchannels()
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is supported")
        first = int(round(offset * rate))
        w.setpos(min(first, n))
        count = n - first if duration is None else int(round(duration * rate))
        data = np.frombuffer(w.readframes(max(0, count)), dtype="<i2").reshape(-1, c).T / 32768.0
    return (data if channels is None else data[channels]), rate


def expect_samples(x: np.ndarray, n: int, tolerance: int = 1) -> np.ndarray:
    """A signal of n samples: one off by up to the tolerance is cut or its last sample repeated; more is an error."""
    have = x.shape[-1]
    if abs(have - n) > tolerance:
        raise ValueError(f"expected {n} samples, got {have}")
    return x[..., :n] if have >= n else np.concatenate([x, np.repeat(x[..., -1:], n - have, axis=-1)], axis=-1)


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    x = np.atleast_2d(np.asarray(x))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(x.T * 32768.0), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def recordings_from_dir(spark: SparkSession, folder: str, pattern: str = "*.wav", exclude: str | None = None) -> DataFrame:
    """A recording per file found in a folder and below it, probed by tasks; ids are file names without extension."""
    paths = [p for p in sorted(globbing.glob(os.path.join(folder, "**", pattern), recursive=True)) if not (exclude and re.search(exclude, p))]
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks_for(spark, len(paths)))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for p in pdf["path"]:
                rate, n, c = probe(p)
                ids = list(range(c))
                rows.append((os.path.splitext(os.path.basename(p))[0], [{"type": "file", "channels": ids, "source": p}], rate, n, n / rate, ids, None))
            yield pd.DataFrame(rows, columns=["id", "sources", "sampling_rate", "num_samples", "duration", "channel_ids", "transforms"])

    return listed.mapInPandas(run, SCHEMAS["recording"])


def load_audio(cuts: DataFrame, path: str = "path", fault_tolerant: bool = False) -> DataFrame:
    """Adds ``samples`` (first channel) and ``rate``: the span [start, start + duration) of each cut's file.

    ``fault_tolerant`` drops rows whose file cannot be read instead of failing.
    """
    schema = T.StructType([*cuts.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("rate", T.IntegerType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            samples, rates = [], []
            for p, a, d in zip(pdf[path], pdf["start"], pdf["duration"]):
                try:
                    x, r = read_samples(p, a, None if pd.isna(d) else d, [0])
                    samples.append(x[0].astype(np.float32).tolist())
                    rates.append(r)
                except (OSError, EOFError, wave.Error, ValueError):
                    if not fault_tolerant:
                        raise
                    samples.append(None)
                    rates.append(None)
            out = pdf.assign(samples=samples, rate=pd.array(rates, dtype="Int32"))
            yield out[out["samples"].notna()]

    return cuts.mapInPandas(run, schema)


def save_audio(df: DataFrame, out_dir: str, samples: str = "samples", rate: str = "rate", key: str = "id") -> DataFrame:
    """Writes each row's signal to ``{id}.wav``; gives (id, path). A repeated task writes the same file."""
    os.makedirs(out_dir, exist_ok=True)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            paths = []
            for k, x, r in zip(pdf[key], pdf[samples], pdf[rate]):
                paths.append(os.path.join(out_dir, f"{k}.wav"))
                with open(paths[-1], "wb") as f:
                    f.write(wav_bytes(np.asarray(x), int(r)))
            yield pd.DataFrame({"id": pdf[key], "path": paths})

    return df.select(F.col(key).alias(key), samples, rate).mapInPandas(run, "id string, path string")


def load_mixed(mixed: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, samples, rate) of mixed cuts (id, tracks): each track's span read, scaled by its ratio to the first track, and summed.

    ``paths`` (recording_id, path) says where the recordings lie; a track's recording is its
    first segment's, or the cut's id where it has none.
    """
    from voxtile.functions.signal import mix_signals

    t = mixed.select("id", F.posexplode("tracks").alias("k", "t"))
    rec = F.coalesce(F.try_element_at(F.col("t.cut.supervisions"), F.lit(1))["recording_id"], F.col("t.cut.id"))
    t = t.withColumn("recording_id", rec).join(paths, "recording_id")
    one = F.struct("k", "path", F.col("t.offset").alias("offset"), F.col("t.snr").alias("snr"), F.col("t.cut.start").alias("start"), F.col("t.cut.duration").alias("duration"))
    rows = t.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("tracks"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            samples, rates = [], []
            for tracks in pdf["tracks"]:
                read = [read_samples(x["path"], x["start"], x["duration"], [0]) for x in tracks]
                rate = read[0][1]
                offsets = [int(round(x["offset"] * rate)) for x in tracks]
                snrs = [None if x["snr"] is None or np.isnan(x["snr"]) else float(x["snr"]) for x in tracks]
                samples.append(mix_signals([a[0] for a, _ in read], offsets, snrs).astype(np.float32).tolist())
                rates.append(rate)
            yield pd.DataFrame({"id": pdf["id"], "samples": samples, "rate": rates})

    return rows.mapInPandas(run, "id string, samples array<float>, rate int")


def extract_and_store(signals: DataFrame, path: str, kind: str = "fbank", codec: str = "npy", samples: str = "samples", key: str = "id") -> int:
    """Features of each row's signal, packed, appended to a Parquet table; rows already there are skipped. Gives how many were new."""
    from voxtile.functions.signal import extract
    from voxtile.sources.arrays import packed_column

    spark = signals.sparkSession
    todo = signals
    if os.path.isdir(path):
        todo = signals.join(spark.read.parquet(path).select(key), key, "left_anti")
    out = packed_column(extract(todo.select(key, samples), samples, kind), "features", codec)
    before = spark.read.parquet(path).count() if os.path.isdir(path) else 0
    out.select(key, F.size("features").alias("num_frames"), F.lit(kind).alias("type"), F.lit(codec).alias("storage_type"), "payload").write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
