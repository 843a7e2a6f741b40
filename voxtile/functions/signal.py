"""Signals as numpy kernels, and the Arrow functions that run them per row: features, energies, mixing, masks, transforms.

A row holds one signal (array<float>, optionally with its rate); kernels are vectorised
within the row and results go back as arrays. Everything random takes a seed and the
row's key, so a repeated task gives the same values.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_FLOOR = 1e-10
MATRIX = T.ArrayType(T.ArrayType(T.FloatType()))
SIGNAL = T.ArrayType(T.FloatType())


def rng_for(key, seed: int) -> np.random.Generator:
    """A generator for one row."""
    return np.random.default_rng(int.from_bytes(hashlib.sha1(f"{seed}|{key}".encode()).digest()[:8], "little"))


# ---- framing, spectra, filter banks ------------------------------------------------------------------------------


# The defaults of frames, mel banks and cepstra.
@dataclass(frozen=True)
class FrameOptions:
    sampling_rate: int = 16000
    frame_length: float = 0.025
    frame_shift: float = 0.01
    preemphasis: float = 0.97
    remove_offset: bool = True
    window: str = "povey"
    snip_edges: bool = False
    num_mels: int = 80
    low_freq: float = 20.0
    high_freq: float = -400.0
    num_ceps: int = 13
    lifter: int = 22


def window_of(kind: str, n: int) -> np.ndarray:
    i = np.arange(n)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))
    if kind == "povey":
        return hann**0.85
    if kind in ("hanning", "hann"):
        return hann
    if kind == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1))
    if kind == "rectangular":
        return np.ones(n)
    raise ValueError(f"unknown window {kind}")


def frames_of(x: np.ndarray, o: FrameOptions) -> np.ndarray:
    """Windowed frames: centred with mirrored edges, or only whole ones with ``snip_edges``."""
    size, hop = round(o.sampling_rate * o.frame_length), round(o.sampling_rate * o.frame_shift)
    x = np.asarray(x, dtype=np.float64)
    if o.snip_edges:
        if len(x) < size:
            return np.empty((0, size))
        n = 1 + (len(x) - size) // hop
    else:
        n = (len(x) + hop // 2) // hop
        if n <= 0:
            return np.empty((0, size))
        left = (size - hop) // 2
        right = max(0, (n - 1) * hop + size - len(x) - left)
        x = np.pad(x, (left, right), mode="symmetric") if len(x) > 1 else np.pad(x, (left, right))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: hop][:n].copy()
    if o.remove_offset:
        frames -= frames.mean(axis=1, keepdims=True)
    if o.preemphasis:
        before = np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
        frames -= o.preemphasis * before
    return frames * window_of(o.window, size)


def power_spectrum(x: np.ndarray, o: FrameOptions) -> np.ndarray:
    frames = frames_of(x, o)
    n = 1 << (frames.shape[1] - 1).bit_length()
    return np.abs(np.fft.rfft(frames, n=n, axis=1)) ** 2


def mel(freq):
    return 1127.0 * np.log(1.0 + np.asarray(freq) / 700.0)


def mel_banks(o: FrameOptions, bins: int) -> np.ndarray:
    """Triangular filters, even on the mel scale: (bins, mels)."""
    nyquist = o.sampling_rate / 2
    high = o.high_freq if o.high_freq > 0 else nyquist + o.high_freq
    edges = np.linspace(mel(o.low_freq), mel(high), o.num_mels + 2)
    at = mel(np.arange(bins) * nyquist / (bins - 1))[:, None]
    up = (at - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(up, down))


def fbank(x: np.ndarray, o: FrameOptions = FrameOptions()) -> np.ndarray:
    p = power_spectrum(x, o)
    return np.log(np.maximum(p @ mel_banks(o, p.shape[1]), LOG_FLOOR))


def mfcc(x: np.ndarray, o: FrameOptions = FrameOptions(num_mels=23)) -> np.ndarray:
    logs = fbank(x, o)
    k, n = np.arange(o.num_ceps)[:, None], np.arange(o.num_mels)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * o.num_mels)) * math.sqrt(2.0 / o.num_mels)
    basis[0] = math.sqrt(1.0 / o.num_mels)
    lift = 1.0 + 0.5 * o.lifter * np.sin(np.pi * np.arange(o.num_ceps) / o.lifter) if o.lifter else 1.0
    return (logs @ basis.T) * lift


def spectrogram(x: np.ndarray, o: FrameOptions = FrameOptions()) -> np.ndarray:
    return power_spectrum(x, o)


def log_spectrogram(x: np.ndarray, o: FrameOptions = FrameOptions()) -> np.ndarray:
    return np.log(np.maximum(power_spectrum(x, o), LOG_FLOOR))


EXTRACTORS: dict[str, Callable[[np.ndarray, FrameOptions], np.ndarray]] = {"fbank": fbank, "mfcc": mfcc, "spectrogram": spectrogram, "log-spectrogram": log_spectrogram}


def extract(df: DataFrame, samples: str, kind: str = "fbank", options: FrameOptions | None = None, out: str = "features") -> DataFrame:
    """Adds a frames x bins matrix of features per row."""
    fn, o = EXTRACTORS[kind], options or FrameOptions(num_mels=23 if kind == "mfcc" else 80)

    @F.pandas_udf(MATRIX)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(np.asarray(v), o).astype(np.float32).tolist() for v in x])

    return df.withColumn(out, run(F.col(samples)))


# ---- energy, gain, mixing ----------------------------------------------------------------------------------------


def energy(samples: Column) -> Column:
    """Mean square of a signal, in the JVM."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return total / F.greatest(F.size(samples), F.lit(1))


def snr_gain(reference: float, added: float, snr: float) -> float:
    """Gain of the added signal for an SNR in decibels."""
    return math.sqrt(reference * 10.0 ** (-snr / 10.0) / added) if added > 0 and reference > 0 else 1.0


def mix_signals(tracks: list[np.ndarray], offsets: list[int], snrs: list[float | None], reference: int = 0) -> np.ndarray:
    """Tracks summed at their offsets; a track with an SNR is scaled against the reference track's energy."""
    size = max((o + len(t) for t, o in zip(tracks, offsets)), default=0)
    out = np.zeros(size)
    ref = float(np.mean(np.square(tracks[reference]))) if tracks and len(tracks[reference]) else 0.0
    for t, o, snr in zip(tracks, offsets, snrs):
        gain = 1.0 if snr is None or not len(t) else snr_gain(ref, float(np.mean(np.square(t))), snr)
        out[o : o + len(t)] += gain * np.asarray(t, dtype=np.float64)
    return out


def mix_features(reference: np.ndarray, added: np.ndarray, offset: int, snr: float | None, padding: float = -1000.0) -> np.ndarray:
    """Log energies added in the linear domain, the second at a frame offset and an SNR."""
    size = max(len(reference), offset + len(added))
    a = np.full((size, reference.shape[1]), padding)
    b = a.copy()
    a[: len(reference)], b[offset : offset + len(added)] = reference, added
    gain = 1.0
    if snr is not None:
        ea, eb = float(np.exp(reference).sum()), float(np.exp(added).sum())
        gain = ea * 10.0 ** (-snr / 10.0) / eb if eb > 0 else 1.0
    return np.log(np.maximum(LOG_FLOOR, np.exp(a) + gain * np.exp(b)))


def mix_rows(df: DataFrame, a: str, b: str, offset: str | int = 0, snr: float | None = None, out: str = "mixed") -> DataFrame:
    """Adds the mix of two signal columns."""
    @F.pandas_udf(SIGNAL)
    def run(x: pd.Series, y: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([mix_signals([np.asarray(p), np.asarray(q)], [0, int(k)], [None, snr]).astype(np.float32).tolist() for p, q, k in zip(x, y, o)])

    return df.withColumn(out, run(F.col(a), F.col(b), F.col(offset) if isinstance(offset, str) else F.lit(offset)))


# ---- transforms --------------------------------------------------------------------------------------------------


def resampled(x: np.ndarray, ratio: float, taps: int = 24) -> np.ndarray:
    """Band-limited interpolation at ``ratio`` times the rate with a windowed sinc."""
    x = np.asarray(x, dtype=np.float64)
    n = int(round(len(x) * ratio))
    if n == 0 or ratio == 1.0:
        return x[:n].copy()
    at = np.arange(n) / ratio
    cut = min(1.0, ratio)
    base = np.floor(at).astype(np.int64)
    out = np.zeros(n)
    for k in range(-taps + 1, taps + 1):
        i = base + k
        d = at - i
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) < taps, 0.5 + 0.5 * np.cos(np.pi * d / taps), 0.0)
        out += w * np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, len(x) - 1)], 0.0)
    return out


def speed(x: np.ndarray, factor: float) -> np.ndarray:
    return resampled(x, 1.0 / factor)


def tempo(x: np.ndarray, factor: float, frame: int = 512) -> np.ndarray:
    """Overlap-add of frames taken at another hop: another pace at the same pitch."""
    x = np.asarray(x, dtype=np.float64)
    n, hop = int(round(len(x) / factor)), frame // 2
    out, weight, w = np.zeros(n + frame), np.zeros(n + frame), np.hanning(frame)
    for at in range(0, max(n, 1), hop):
        part = x[int(at * factor) : int(at * factor) + frame]
        out[at : at + len(part)] += part * w[: len(part)]
        weight[at : at + len(part)] += w[: len(part)]
    return (out / np.maximum(weight, 1e-3))[:n]


def volume(x: np.ndarray, factor: float) -> np.ndarray:
    return np.asarray(x) * factor


def clipped(x: np.ndarray, gain_db: float, hard: bool = False, oversampling: int = 2) -> np.ndarray:
    """Saturation at full scale after a gain: hard, or by a tangent at a higher rate."""
    y = np.asarray(x) * 10.0 ** (gain_db / 20.0)
    if hard:
        return np.clip(y, -1.0, 1.0)
    return resampled(np.tanh(resampled(y, oversampling)), 1.0 / oversampling)[: len(y)]


def narrowband(x: np.ndarray, mu: int = 255) -> np.ndarray:
    """Mu-law quantisation to 8 bits and back."""
    y = np.clip(np.asarray(x, dtype=np.float64), -1.0, 1.0)
    q = np.round((np.sign(y) * np.log1p(mu * np.abs(y)) / np.log1p(mu) + 1) / 2 * mu)
    z = 2 * q / mu - 1
    return np.sign(z) * np.expm1(np.abs(z) * np.log1p(mu)) / mu


def lowpass_by_resampling(x: np.ndarray, ratio: float) -> np.ndarray:
    y = resampled(resampled(x, ratio), 1.0 / ratio)
    return np.pad(y, (0, max(0, len(x) - len(y))))[: len(x)]


def reverberated(x: np.ndarray, impulse: np.ndarray, normalise: bool = True) -> np.ndarray:
    """Convolution with an impulse response, aligned to its peak, of the signal's length and energy."""
    h = np.asarray(impulse, dtype=np.float64)
    if normalise:
        h = h / (np.sqrt(np.square(h).sum()) or 1.0)
    n = len(x) + len(h) - 1
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)
    peak = int(np.argmax(np.abs(h)))
    y = y[peak : peak + len(x)]
    e = float(np.mean(np.square(y))) if len(y) else 0.0
    return y * math.sqrt(float(np.mean(np.square(x))) / e) if normalise and e > 0 else y


def random_impulse(key, seed: int, sampling_rate: int = 16000, rt60: float = 0.4) -> np.ndarray:
    """Exponentially decaying noise after a direct path: a stand-in for a room."""
    n = int(sampling_rate * rt60)
    g = rng_for(key, seed)
    h = g.standard_normal(n) * np.exp(-6.9 * np.arange(n) / n) * 0.1
    h[0] = 1.0
    return h


def loudness_normalised(x: np.ndarray, target_db: float) -> np.ndarray:
    rms = math.sqrt(float(np.mean(np.square(x)))) if len(x) else 0.0
    return np.asarray(x) * (10.0 ** (target_db / 20.0) / rms) if rms > 0 else np.asarray(x)


TRANSFORMS: dict[str, Callable] = {
    "speed": speed, "tempo": tempo, "volume": volume, "clip": clipped, "narrowband": narrowband, "lowpass": lowpass_by_resampling, "loudness": loudness_normalised,
}


def transform(df: DataFrame, samples: str, name: str, **args) -> DataFrame:
    """Applies one named transform to a signal column."""
    fn = TRANSFORMS[name]

    @F.pandas_udf(SIGNAL)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(fn(np.asarray(v), **args), dtype=np.float32).tolist() for v in x])

    return df.withColumn(samples, run(F.col(samples)))


def probably(df: DataFrame, samples: str, name: str, p: float, key: str = "id", seed: int = 0, **args) -> DataFrame:
    """Applies a transform to rows with probability p, by the hash of key and seed."""
    from voxtile.functions.timeops import uniform

    done = transform(df.withColumn("__s", F.col(samples)), "__s", name, **args)
    return done.withColumn(samples, F.when(uniform(key, seed) < p, F.col("__s")).otherwise(F.col(samples))).drop("__s")


# ---- masks on features -------------------------------------------------------------------------------------------


# The defaults of numbers and sizes of masks.
def spec_masked(m: np.ndarray, g: np.random.Generator, freq_masks: int = 2, freq_size: int = 27, time_masks: int = 10, time_size: int = 100, max_fraction: float = 0.15, warp: int | None = 80) -> np.ndarray:
    """Time warping and masks of random widths, filled with the mean; masked frames stay within a fraction of the whole."""
    m = np.array(m, dtype=np.float32)
    n, bins = m.shape
    if warp is not None and n > 2 * warp:
        centre = int(g.integers(warp + 1, n - warp))
        moved = int(g.integers(centre - warp, centre + warp)) + 1
        left = np.linspace(0, centre - 1, moved)
        right = np.linspace(centre, n - 1, n - moved)
        at = np.concatenate([left, right])
        lo, hi = np.floor(at).astype(int), np.minimum(np.ceil(at).astype(int), n - 1)
        m = m[lo] + (at - lo)[:, None].astype(np.float32) * (m[hi] - m[lo])
    fill = m.mean()
    for _ in range(freq_masks):
        w = int(g.integers(0, min(freq_size, bins) + 1))
        a = int(g.integers(0, bins - w + 1))
        m[:, a : a + w] = fill
    budget = int(max_fraction * n)
    count = min(time_masks, math.ceil(budget / time_size)) if budget else 0
    for _ in range(count):
        w = int(g.integers(0, min(time_size, budget // count) + 1))
        a = int(g.integers(0, n - w + 1))
        m[a : a + w] = fill
    return m


def spec_augment(df: DataFrame, features: str, key: str = "id", seed: int = 0, p: float = 0.9, **args) -> DataFrame:
    @F.pandas_udf(MATRIX)
    def run(keys: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(keys, x):
            g = rng_for(k, seed)
            out.append(v if v is None or g.random() > p else spec_masked(np.array([np.asarray(r) for r in v]), g, **args).tolist())
        return pd.Series(out)

    return df.withColumn(features, run(F.col(key).cast("string"), F.col(features)))


def smoothed(df: DataFrame, samples: str, sigma: float = 0.1, key: str = "id", seed: int = 0, p: float = 0.3) -> DataFrame:
    """Gaussian noise on some rows."""
    @F.pandas_udf(SIGNAL)
    def run(keys: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(keys, x):
            g = rng_for(k, seed)
            out.append(v if v is None or g.random() > p else (np.asarray(v) + g.normal(0, sigma * g.random(), len(v))).astype(np.float32).tolist())
        return pd.Series(out)

    return df.withColumn(samples, run(F.col(key).cast("string"), F.col(samples)))


def scheduled(step: Column, milestones: dict[int, float]) -> Column:
    """The value of the last milestone up to a step."""
    out = F.lit(None).cast("double")
    for at in sorted(milestones):
        out = F.when(step >= at, F.lit(float(milestones[at]))).otherwise(out)
    return out


# ---- frames and arrays in the JVM --------------------------------------------------------------------------------


def length_mask(lengths: Column, longest: Column) -> Column:
    """True for positions within a length."""
    return F.transform(F.sequence(F.lit(1), longest), lambda i: i <= lengths)


def padded(values: Column, size: Column, value: float = 0.0, kind: str = "float") -> Column:
    return F.concat(values, F.array_repeat(F.lit(value).cast(kind), F.greatest(size - F.size(values), F.lit(0))))


def sliced(values: Column, start: Column, frame_shift: float, duration: Column) -> Column:
    """The frames of a temporal array within a span."""
    first = F.round(start / frame_shift).cast("int")
    n = F.round(F.round(duration / frame_shift, 8)).cast("int")
    return F.slice(values, first + 1, F.greatest(F.least(n, F.size(values) - first), F.lit(0)))


def run_over(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Any function on batches of rows."""
    return df.mapInPandas(fn, schema)
