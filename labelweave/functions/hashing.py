"""Seeded pseudo-random values that depend on row keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int, parts: tuple) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])


def shuffle_key(seed: int, *parts: Column | str) -> Column:
    """Sorting by this key is a seeded shuffle."""
    return F.md5(_key(seed, parts))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A double in [0, 1)."""
    digits = F.substring(F.md5(_key(seed, parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def text_key(col: Column) -> Column:
    """A short grouping key for long texts; NULL stays NULL."""
    return F.unhex(F.md5(col))
