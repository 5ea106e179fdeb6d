"""Confidentiality rules as column functions.

Randomness is a hash of a seed, so a result depends on its seed alone: not on
partitions, retries or the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Graduated rounding: from |x|, base; thresholds count within their band.
BANDS = ((0, 3), (19, 2), (20, 5), (100, 10), (1000, 100))
#: Threshold bounds of each band, both included.
BAND_THRESHOLDS = ((0, 21), (19, 20), (20, 100), (100, 1000), (1000, float("inf")))


def uniform(seed: Column) -> Column:
    """In [0, 1): the first twelve digits of the seed's md5."""
    head = F.substring(F.md5(seed.cast("string").cast("binary")), 1, 12)
    return F.conv(head, 16, 10).cast("bigint").cast("double") / float(1 << 48)


def check_thresholds(base: float, thresholds: Sequence[float]) -> list[float]:
    got = sorted(set(thresholds))
    if any(b - a < base for a, b in zip(got, got[1:], strict=False)):
        raise ValueError(f"thresholds {got} are closer than the base {base}")
    return got


def random_rounding(x: Column, seed: Column, base: int = 3, thresholds: Sequence[float] = ()) -> Column:
    """To a neighbouring multiple of ``base``, the nearer the likelier; on the same side of every threshold as ``x``."""
    thresholds = check_thresholds(base, thresholds)
    rest = F.pmod(x, F.lit(base))
    down = uniform(F.coalesce(seed.cast("string"), F.lit("0"))) < (F.lit(float(base)) - rest) / float(base)
    out = x - rest + F.when(down | (rest == 0), F.lit(0)).otherwise(F.lit(base))
    for t in thresholds:
        out = F.when((x >= t) & (out < t), out + base).when((x < t) & (out >= t), out - base).otherwise(out)
    return out


def graduated_random_rounding(x: Column, seed: Column, thresholds: Sequence[float] = ()) -> Column:
    """Random rounding with a base that grows with the size; the sign stays."""
    size, out = F.abs(x), None
    for (low, base), (least, most) in zip(BANDS, BAND_THRESHOLDS, strict=True):
        band = random_rounding(size, seed, base, [t for t in thresholds if least <= t <= most])
        out = band if out is None else F.when(size >= low, band).otherwise(out)
    return F.when(x < 0, -out).otherwise(out)


def conventional_rounding(x: Column, base: int) -> Column:
    """To the nearest multiple; halves to the even one."""
    return (F.rint(x.cast("double") / float(base)) * float(base)).cast("double")


def suppress_small(x: Column, by: Column, threshold: float, missing_as: float = 0) -> Column:
    """``x`` where ``by`` reaches the threshold, else missing."""
    return F.when(F.coalesce(by, F.lit(missing_as)) >= threshold, x)


def stable_seeds(x: Column, row_key: Column, stable_above: float = 30, salt: int = 0) -> Column:
    """Equal values from ``stable_above`` on share a seed; below, each row has its own."""
    value = F.coalesce(x.cast("double"), F.lit(0.0))
    shared = F.concat(F.lit(f"{salt}|v|"), value.cast("string"))
    own = F.concat(F.lit(f"{salt}|r|"), row_key.cast("string"))
    return F.when(value >= stable_above, shared).otherwise(own)
