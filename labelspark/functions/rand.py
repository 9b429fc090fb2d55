"""Deterministic randomness (F-21, B-8 keys, H-5..H-9 keys).

Every draw is a hash of stable row keys and a seed, so results do not
depend on partitioning, task retries or executor loss, and the same value
can be computed by any SQL engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_key(*parts) -> Column:
    """md5 hex of the '|' joined parts: a uniform, stable sort key."""
    return F.md5(_key(*parts))


def hash_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of md5(parts)."""
    h = F.substring(hash_key(*parts), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_int(n, *parts) -> Column:
    """Uniform long in [0, n) (n may be a column)."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.floor(hash_uniform(*parts) * n).cast("long")
