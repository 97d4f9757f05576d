"""Vocabularies and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(value, id): distinct values with dense ids from 0 in sorted order; a vocabulary, bounded by its nature."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    # one sorted array of the distinct values instead of a window over all of them
    return values.agg(F.array_sort(F.collect_list("value")).alias("all")).select(F.posexplode("all").alias("id", "value")).select("value", "id")


def unique_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the sorted distinct values of each column, nulls left out: partial sets per task, merged."""
    return df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def list_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, max, min) of numeric columns, in one scan."""
    rows = [F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.max(F.col(c).cast("double")).alias("max"), F.min(F.col(c).cast("double")).alias("min")) for c in columns]
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n) of the k most frequent values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
