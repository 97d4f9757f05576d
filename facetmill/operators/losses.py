"""Losses as column expressions over logits and labels, and the centre losses as aggregates.

A null label drops out. ``sentinel_as_positive`` counts the missing mark 255 as a positive, as a
plain cast to boolean does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.functions.columns import sigmoid


def label(c: Column, sentinel_as_positive: bool = False) -> Column:
    return F.when(c == 255, 1.0 if sentinel_as_positive else None).otherwise(c.cast("double"))


def weighted_bce(z: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy on logits in its stable form, positives weighted."""
    soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    return (1 - y) * z + (1 + (pos_weight - 1) * y) * soft


def focal(z: Column, y: Column, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    p = sigmoid(z)
    hit = F.when(y == 1, p).otherwise(1 - p)
    return F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - hit, gamma) * weighted_bce(z, y)


def asymmetric(z: Column, y: Column, gamma_pos: float = 0.0, gamma_neg: float = 4.0, margin: float = 0.05, eps: float = 1e-6) -> Column:
    """Focal powers apart for both classes; probabilities of negatives are shifted down by a margin."""
    p = F.least(F.greatest(sigmoid(z), F.lit(eps)), F.lit(1 - eps))
    shifted = F.least(F.greatest(p - margin, F.lit(0.0)), F.lit(1 - eps))
    return F.when(y == 1, F.pow(1 - p, gamma_pos) * -F.ln(p)).otherwise(F.pow(shifted, gamma_neg) * -F.log1p(-shifted))


def class_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centre): element-wise mean of the vectors of each class."""
    cells = df.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).getField("m").alias("centre"))


def _gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x)


def svdd(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(key, loss, n): mean of 2 - 2 cos between each vector and the centre of its class, both at length one."""
    from facetmill.operators.messages import dot

    a, c = F.col(vector), F.col("centre")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(c, c))
    rows = df.join(centres, key)
    return rows.groupBy(key).agg(F.avg(2 - 2 * F.when(norm > 0, dot(a, c) / norm).otherwise(0.0)).alias("loss"), F.count("*").alias("n"))


def centre_loss(df: DataFrame, key: str, vector: str, centres: DataFrame) -> DataFrame:
    """(loss, n): half the squared distance of each vector to its class centre, over the number of rows."""
    rows = df.join(centres, key)
    return rows.agg((F.sum(_gap(F.col(vector), F.col("centre"))) / 2 / F.count("*")).alias("loss"), F.count("*").alias("n"))


def moved_centres(df: DataFrame, key: str, vector: str, centres: DataFrame, rate: float = 0.2) -> DataFrame:
    """(key, centre): centres moved towards the means of their rows by ``rate``; classes without rows stay."""
    own = class_means(df, key, vector).withColumnRenamed("centre", "mean")
    step = F.zip_with("centre", "mean", lambda c, m: c + rate * (m - c))
    return centres.join(own, key, "left").select(key, F.when(F.col("mean").isNotNull(), step).otherwise(F.col("centre")).alias("centre"))


def loss_table(df: DataFrame, z: str, y: str, losses: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Means of several losses over the rows with a label, in one scan."""
    return df.where(F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(*keys).agg(*(F.avg(c).alias(n) for n, c in losses.items()), F.count("*").alias("n"))
