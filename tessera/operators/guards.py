"""Join guards and the null-safe join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("outer", "full_outer", "full"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in keys})
    return joined.drop(*[f"_right_{k}" for k in keys])


def require_unique(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Raise ValueError where a key (nulls count as equal) stands more than once."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError(message)
    return df


def require_same_count(before: DataFrame, after: DataFrame, message: str) -> DataFrame:
    if before.count() != after.count():
        raise ValueError(message)
    return after
