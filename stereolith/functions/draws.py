"""Seeded draws: numbers that depend on a seed, a key and the draw's number alone, in any layout of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hex digits of the digest that a double holds exactly


def uniform(seed: int, key: Column, draw: Column | int = 0, *, low: float = 0.0, high: float = 1.0) -> Column:
    """A number from ``low`` up to, not including, ``high``: a digest of seed, key and draw. Null for a null key."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(draw).cast("string"))
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("double")
    return F.when(key.isNotNull(), low + whole / float(16**_DIGITS) * (high - low))


def pick(seed: int, key: Column, n: Column, draw: Column | int = 0) -> Column:
    """A whole number from 0 up to, not including, ``n``."""
    return F.floor(uniform(seed, key, draw) * n).cast("long")
