"""Draws from keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, iteration: int, *keys: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of keys: the same for any partitioning, and in any SQL."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(iteration)), *keys).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
