"""Split filters, chunks, gathers and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_filter(df: DataFrame, split: str, name: str) -> DataFrame:
    """Rows of a split, as stored; an empty split stands for test."""
    return df.where(F.col(split).isin("test", "") if name == "test" else F.col(split) == name)


def seeded_rank(key: str, seed: int) -> Column:
    """A key's place in a seeded order: the same on every engine, whatever the partitions."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def dense_index(df: DataFrame, key: str, block: int = 1 << 20) -> DataFrame:
    """``df`` with ``idx``, the position by an integer key from 0.

    Counts per block of keys run over blocks, positions over the rows of one block: no task sees more than one block.
    """
    keyed = df.withColumn("_block", F.floor(F.col(key) / block))
    sums = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sums.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return keyed.withColumn("_within", within).join(before, "_block").withColumn("idx", F.col("_within") + F.col("_before")).drop("_block", "_within", "_before")


def chunk_of(index: Column, total: int, chunks: int) -> Column:
    """Contiguous chunk of a position; the last chunk takes the remainder."""
    return F.least(F.floor(index / F.lit(max(1, total // chunks))), F.lit(chunks - 1)).cast("int")


def gather(df: DataFrame, key: str, ids: DataFrame, id_col: str, at: str) -> DataFrame:
    """Rows of ``df`` for a list of ids, with the list's order in ``at`` and its repeats."""
    return ids.select(F.col(id_col).alias(key), at).join(df, key)


def checked_gather(df: DataFrame, index: str, ids: DataFrame, id_col: str, at: str, strict: bool = True) -> DataFrame:
    """``gather`` by position; raises where the list is empty, longer than the table, or names a position outside of it.

    Without ``strict`` such a list is taken as it is, and positions outside of the table give no row.
    """
    if not strict:
        return gather(df, index, ids, id_col, at)
    total = df.count()
    seen = ids.agg(F.count("*").alias("n"), F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    if not seen.n:
        raise ValueError("the list of positions is empty")
    if seen.n > total:
        raise ValueError(f"{seen.n} positions for {total} rows")
    if seen.low < 0 or seen.high >= total:
        raise ValueError(f"positions {seen.low} to {seen.high} for {total} rows")
    return gather(df, index, ids, id_col, at)


def kept_keys(df: DataFrame, key: str, dropped: str) -> DataFrame:
    """Rows whose key does not match a pattern; a null key is kept."""
    return df.where(~F.coalesce(F.col(key).rlike(dropped), F.lit(False)))


def sweep_grid(spark, variances: Sequence[int], sigmas: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    """(variance, sigma, alpha): the settings of a sweep, noise levels at alpha 1 and then alphas without noise."""
    rows = [(v, s, 1.0) for v in variances for s in sigmas] + [(v, 0.0, a) for v in variances for a in alphas]
    return spark.createDataFrame(rows, "variance int, sigma double, alpha double")


def first_by_seed(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, uniform without replacement; all rows where there are fewer."""
    return df.orderBy(seeded_rank(key, seed), key).limit(n)


def quota_sample(df: DataFrame, key: str, labels: Sequence[str], size: int, least: int, seed: int) -> DataFrame:
    """``size`` rows of which each label has at least ``least`` positives, then filled uniformly.

    Raises where a label has too few positives or the quotas need more than ``size`` rows. Returns the keys.
    """
    picks = [first_by_seed(df.where(F.col(c) == 1).select(key), key, least, seed) for c in labels]
    short = [c for c, p in zip(labels, picks) if p.count() < least]
    if short:
        raise ValueError(f"fewer than {least} positives in {', '.join(short)}")
    chosen = reduce(DataFrame.unionAll, picks).distinct()
    room = size - chosen.count()
    if room < 0:
        raise ValueError(f"the quotas need more than {size} rows")
    return chosen.unionAll(first_by_seed(df.select(key).join(chosen, key, "left_anti"), key, room, seed))


def balanced_sample(df: DataFrame, key: str, label: str, per_class: int, seed: int) -> DataFrame:
    """Up to ``per_class`` rows of label 0 and as many of label 1."""
    return first_by_seed(df.where(F.col(label) == 0), key, per_class, seed).unionAll(first_by_seed(df.where(F.col(label) == 1), key, per_class, seed))
