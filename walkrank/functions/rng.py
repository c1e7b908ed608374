"""Counter-based random numbers: a draw depends on what it is for, so retries and other engines repeat it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(*parts) -> Column:
    """An integer from 0 to 2^32 - 1."""
    text = F.concat_ws("|", *(_column(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """From 0 up to, without, 1. Columns and plain values tell the draw apart from others."""
    return draw(*parts) / F.lit(4294967296.0)


def race(weight, *parts) -> Column:
    """When a candidate arrives in an exponential race: the first of several is each with a chance in proportion to its weight. ``parts`` tell the draw apart and name the candidate; null without a positive weight."""
    u = (draw(*parts) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.when(_column(weight) > 0, -F.ln(u) / _column(weight))


def uniform_py(*parts) -> float:
    """The same draw in Python."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0
