"""A seeded uniform number for each key, the same on every engine and for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coin(seed: int, key: Column) -> Column:
    """In (0, 1): the first 32 bits of md5(seed:key), centred."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def coin_sql(seed: int, key: str) -> str:
    """The same number in DuckDB's SQL."""
    return f"((('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::UBIGINT)::DOUBLE + 0.5) / 4294967296.0"
