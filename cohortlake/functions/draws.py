"""Random draws from hashes of keys: the same key gives the same number on every retry and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**32)


def _digest(*keys: Column) -> Column:
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))


def _unit(digest: Column, part: int) -> Column:
    word = F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint")
    return (word + 0.5) / _SPAN


def uniform(*keys: Column) -> Column:
    """Uniform on (0, 1)."""
    return _unit(_digest(*keys), 0)


def between(lo: float, hi: float, *keys: Column) -> Column:
    return F.lit(float(lo)) + uniform(*keys) * float(hi - lo)


def normal(*keys: Column) -> Column:
    """Standard normal, by the Box-Muller formula on two words of one digest."""
    d = _digest(*keys)
    return F.sqrt(-2.0 * F.log(_unit(d, 0))) * F.cos(2 * math.pi * _unit(d, 1))
