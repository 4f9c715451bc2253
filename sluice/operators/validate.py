"""Checks of a batch before it is merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKeys, NullKey, UnprocessedKeys


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their ``count``; partial counts run before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def unprocessed_keys(df: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``processed``."""
    return df.join(processed.select(*keys), list(keys), "left_anti")


def null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    wrong = F.lit(False)
    for k in keys:
        wrong = wrong | F.col(f"`{k}`").isNull()
    return df.where(wrong)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).dropDuplicates()


def check_batch(df: DataFrame, keys: Sequence[str], processed: DataFrame | None = None) -> None:
    """Raise for null keys, keys that occur twice, and keys outside ``processed``."""
    if not null_keys(df, keys).isEmpty():
        raise NullKey(", ".join(keys))
    if twice := duplicate_keys(df, keys).take(1):
        raise DuplicateKeys(str(twice[0].asDict()))
    if processed is not None and (other := unprocessed_keys(df, processed, keys).take(1)):
        raise UnprocessedKeys(str({k: other[0][k] for k in keys}))
