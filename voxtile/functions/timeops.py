"""Time arithmetic as Catalyst expressions: seconds, samples, frames, windows.

All of these stay inside whole-stage code generation. Times are float seconds at the
surface, as in manifests; counts are integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def r8(x: Column) -> Column:
    """Rounded to 8 digits, which removes the noise of float sums."""
    return F.round(x, 8)


def end_of(start, duration) -> Column:
    return r8(_c(start) + _c(duration))


def to_us(seconds) -> Column:
    """Seconds to whole microseconds."""
    return F.round(_c(seconds) * 1_000_000.0).cast("long")


def num_samples(duration, sampling_rate) -> Column:
    """Samples of a duration, halves rounded up."""
    return F.round(F.round(_c(duration) * _c(sampling_rate), 8), 0).cast("long")


def perturbed_samples(n, factor: float) -> Column:
    """Samples after a change of speed: halves go up for factors from 1, else down."""
    q = F.round(_c(n) / F.lit(float(factor)), 8)
    return (F.round(q, 0) if factor >= 1 else F.ceil(q - 0.5)).cast("long")


def num_frames(duration, frame_shift, sampling_rate) -> Column:
    """Frames of a duration: samples plus half a hop, over the hop; halves round to even."""
    hop = F.rint(_c(frame_shift) * _c(sampling_rate))
    return F.floor((F.rint(_c(duration) * _c(sampling_rate)) + F.floor(hop / 2)) / hop).cast("long")


def frames_of_samples(samples, frame_shift, sampling_rate) -> Column:
    hop = F.rint(_c(frame_shift) * _c(sampling_rate))
    return F.floor((_c(samples) + F.floor(hop / 2)) / hop).cast("long")


def added_durations(sampling_rate, *parts) -> Column:
    """A sum of durations taken in samples, so that it is exact on the sample grid."""
    total = sum((num_samples(p, sampling_rate) for p in parts[1:]), num_samples(parts[0], sampling_rate))
    return total / _c(sampling_rate)


def window_count(length, window, hop) -> Column:
    """How many windows of a signal; the last may be shorter, an empty signal has none."""
    length, window, hop = _c(length), _c(window), _c(hop)
    n = F.ceil(F.greatest(length - window, F.lit(0)) / hop)
    return F.when(length <= 0, F.lit(0)).otherwise(n + F.when(length - n * hop > 0, 1).otherwise(0)).cast("int")


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Strict overlap of half-open spans; touching ends do not overlap."""
    return (_c(a_start) < _c(b_end)) & (_c(b_start) < _c(a_end))


def overspans(a_start, a_end, b_start, b_end, tolerance: float = 1e-3) -> Column:
    """Whether span a holds span b, up to a tolerance in seconds."""
    return (_c(b_start) >= _c(a_start) - tolerance) & (_c(b_end) <= _c(a_end) + tolerance)


def overlap_ratio(a_start, a_end, b_start, b_end) -> Column:
    """(end of the earlier - start of the later) over the shorter duration; not clipped for nested spans."""
    first_is_a = (_c(a_start) < _c(b_start)) | ((_c(a_start) == _c(b_start)) & (_c(a_end) <= _c(b_end)))
    over = F.when(first_is_a, _c(a_end) - _c(b_start)).otherwise(_c(b_end) - _c(a_start))
    return over / F.least(_c(a_end) - _c(a_start), _c(b_end) - _c(b_start))


def extended_span(start, duration, new_duration, direction: str = "center", seed: int = 0, key=None) -> tuple[Column, Column]:
    """(start, duration) of a span grown to ``new_duration``; a start below 0 is cut off, which shortens it."""
    start, duration, new = _c(start), _c(duration), _c(new_duration)
    grow = F.greatest(new - duration, F.lit(0.0))
    share = {"center": F.lit(0.5), "left": F.lit(1.0), "right": F.lit(0.0)}.get(direction)
    if share is None:
        if direction != "random" or key is None:
            raise ValueError("direction is center, left, right or random (with a key)")
        share = uniform(key, seed)
    moved = start - grow * share
    clipped = F.greatest(moved, F.lit(0.0))
    return r8(clipped), r8(F.greatest(duration, new) - (clipped - moved))


def uniform(key, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    return (hash_int(key, seed) + F.lit(0.5)) / F.lit(float(1 << 32))


def hash_int(key, seed: int = 0) -> Column:
    """32 bits of MD5 as an integer; other engines compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", _c(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def hash_str_to_int(text, modulus: int) -> Column:
    """The SHA-1 of a string modulo ``modulus`` (below 2**30): ten groups of 16 bits, reduced one after another."""
    if modulus >= 1 << 30:
        raise ValueError("the modulus must lie below 2**30")
    digest = F.sha1(_c(text))
    out = F.lit(0).cast("long")
    for i in range(10):
        part = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")
        out = F.pmod(out * 65536 + part, F.lit(modulus).cast("long"))
    return out


def time_diff_frames(diff, frame_length, frame_shift) -> Column:
    return F.ceil((_c(diff) - _c(frame_length)) / _c(frame_shift)).cast("long")


def temporal_frames(duration, frame_shift, cap) -> Column:
    """Frames of a temporal array: halves rounded up, at most ``cap``."""
    return F.least(F.round(F.round(_c(duration) / _c(frame_shift), 8), 0).cast("long"), _c(cap).cast("long"))


def hms_to_seconds(text) -> Column:
    p = F.split(_c(text), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")
