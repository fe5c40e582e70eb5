"""Reproducible choices that don't depend on the order or place of rows.

Shuffles order by md5 of seed and key, and draws take the first eight of its
hex digits. Any engine with md5 makes the same choices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def draw(seed: int | str, *key: Column) -> Column:
    """A long in [0, 2**32)."""
    return F.conv(F.substring(shuffle_key(seed, *key), 1, 8), 16, 10).cast("long")


def between(low: Column, high: Column, seed: int | str, *key: Column) -> Column:
    """A whole number from low to high, both included; null if low is above high."""
    return F.when(low <= high, low + draw(seed, *key) % F.greatest(high - low + 1, F.lit(1)))


def uniform(seed: int | str, *key: Column) -> Column:
    """A double in [0, 1)."""
    return draw(seed, *key) / F.lit(4294967296.0)
