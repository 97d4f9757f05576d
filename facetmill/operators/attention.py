"""Attention diagnostics over the long table (g, head, i, j, a, d): weight a of key j for query i at recoded distance d."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
NEAR, FAR = 8, 16


def entropy(attention: DataFrame) -> DataFrame:
    """(head, entropy, n): mean over queries of the entropy of their weights, over the log of the number of other keys.

    Weights below 1e-12 count as that, and the query itself adds to the entropy but not to the number of keys; a query with at most one other key gives 0.
    """
    a = F.greatest(F.col("a"), F.lit(EPS))
    rows = attention.groupBy("g", "head", "i").agg(F.sum(-a * F.ln(a)).alias("h"), F.count_if(F.col("i") != F.col("j")).alias("k"))
    normed = F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0)
    return rows.groupBy("head").agg(F.avg(normed).alias("entropy"), F.count("*").alias("n"))


def by_distance(attention: DataFrame) -> DataFrame:
    """(head, d, mean, n) of the weights at each distance, unreachable pairs left out."""
    return attention.where("d >= 0").groupBy("head", "d").agg(F.avg("a").alias("mean"), F.count("*").alias("n"))


def long_range(attention: DataFrame) -> DataFrame:
    """(head, share_8, share_16): weight at distance 8 and 16 or more, over the weight at any distance above 0."""
    mass = lambda least: F.sum(F.when(F.col("d") >= least, F.col("a")).otherwise(0.0))
    whole = F.greatest(mass(1), F.lit(EPS))
    return attention.groupBy("head").agg((mass(NEAR) / whole).alias("share_8"), (mass(FAR) / whole).alias("share_16"))


def distance_correlation(attention: DataFrame) -> DataFrame:
    """(head, r): correlation of weight and distance over reachable pairs of different cells; 0 where it has no value."""
    rows = attention.where("d >= 0 and i <> j")
    heads = attention.select("head").distinct()
    r = rows.groupBy("head").agg(F.corr("a", "d").alias("r"))
    return heads.join(r, "head", "left").select("head", F.when(F.isnan("r"), 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"))


def layer_means(stats: DataFrame, layer: str, head: str, value: str) -> DataFrame:
    """(layer, mean, n): batches averaged within a head, heads averaged within a layer."""
    return stats.groupBy(layer, head).agg(F.avg(value).alias("m")).groupBy(layer).agg(F.avg("m").alias("mean"), F.count("*").alias("n"))
