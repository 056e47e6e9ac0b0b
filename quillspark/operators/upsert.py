"""Keyed writes on immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the greatest version of each key; a struct maximum combines map-side, which a window cannot."""
    rest = [version] + [c for c in df.columns if c not in keys and c != version]
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
