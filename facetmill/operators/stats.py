"""Sweep roll-ups: first-wins and pooled statistics, element-wise array statistics, nearest keys, run deltas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions.columns import close, hashed_normal, missing, quadrature


def std_or_zero(c) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def elementwise(df: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """(keys.., pos, mean, std, n): statistics of each array position, NaN and null left out."""
    rows = df.select(*keys, F.posexplode(array).alias("pos", "x")).withColumn("x", missing(F.col("x")))
    return rows.groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), std_or_zero("x").alias("std"), F.count("x").alias("n"))


def sigma_rows(df: DataFrame, order: str) -> DataFrame:
    """Rows of the sigma sweep, alpha 1: of a setting logged twice the first counts."""
    rows = df.where(F.col("model_score").isNotNull() & close(F.col("alpha"), F.lit(1.0)))
    return first_wins(rows, ["variance", "sigma"], order)


def alpha_rows(df: DataFrame) -> DataFrame:
    """Rows of the alpha sweep, sigma 0: all of a setting are pooled."""
    return df.where(F.col("model_score").isNotNull() & close(F.col("sigma"), F.lit(0.0)))


def setting_stats(rows: DataFrame, key: str) -> DataFrame:
    """(variance, key, mean, std) of the scores of each setting."""
    return rows.groupBy("variance", key).agg(F.avg("model_score").alias("mean"), std_or_zero("model_score").alias("std"))


def over_variances(stats: DataFrame, key: str) -> DataFrame:
    """(key, mean_of_means, std_of_means, n): settings pooled over the runs."""
    return stats.groupBy(key).agg(F.avg("mean").alias("mean_of_means"), std_or_zero("mean").alias("std_of_means"), F.count("*").alias("n"))


def nan_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys.., mean, std, n): NaN skipped; a single value has no deviation."""
    x = missing(F.col(value))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))


def closest(df: DataFrame, keys: Sequence[str], value: str, target: float, order: str) -> DataFrame:
    """The row of each key whose ``value`` lies nearest to the target; the first by ``order`` on a tie."""
    whole = F.struct(*df.columns)
    best = F.min_by(whole, F.struct(F.abs(F.col(value) - target), F.col(order))).alias("_row")
    rows = df.where(F.col(value).isNotNull())
    return (rows.groupBy(*keys).agg(best) if keys else rows.agg(best).where("_row is not null")).select("_row.*")


def deltas(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., delta, error): aligned on keys, errors added in quadrature; positions in one side only are cut."""
    b = base.select(*keys, F.col("mean").alias("bm"), F.col("std").alias("bs"))
    return other.select(*keys, "mean", "std").join(b, list(keys)).select(*keys, (F.col("mean") - F.col("bm")).alias("delta"), quadrature(F.col("std"), F.col("bs")).alias("error"))


def early_stopping(log: DataFrame, run: str, epoch: str, loss: str, patience: int, warmup: int = 0, min_delta: float = 1e-6) -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch): the epoch at which training of each run would stop.

    The best loss falls by at least ``min_delta``; epochs of the warm-up set it anew; ``patience`` epochs without
    a better one stop the run. stop_epoch is null for a run that goes on. One run's log is folded in order.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("e"), F.col(loss).cast("double").alias("l"))))
    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def fold(a: Column, s: Column) -> Column:
        warm = s["e"] < warmup
        better = a["best"].isNull() | warm | (s["l"] < a["best"] - min_delta)
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        nxt = F.struct(F.when(better, s["e"]).otherwise(a["at"]).alias("at"), F.when(better, s["l"]).otherwise(a["best"]).alias("best"), bad.alias("bad"), F.when(bad >= patience, s["e"]).alias("stop"))
        return F.when(a["stop"].isNotNull(), a).otherwise(nxt)

    out = log.groupBy(run).agg(F.aggregate(steps, start, fold).alias("f"))
    return out.select(run, F.col("f.at").alias("best_epoch"), F.col("f.best").alias("best_loss"), F.col("f.stop").alias("stop_epoch"))


def first_non_finite(df: DataFrame, keys: Sequence[str], values: Sequence[str], most: int = 5) -> DataFrame:
    """(keys.., name, value): the first ``most`` values, by keys and name, that are NaN or infinite."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values))).alias("x")).select(*keys, "x.*")
    bad = long.where(F.isnan("value") | (F.abs("value") == float("inf")))
    return bad.distinct().orderBy(*keys, "name").limit(most)


def require_finite(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` itself; raises with the first offenders where a value is NaN or infinite."""
    bad = first_non_finite(df, keys, values).collect()
    if bad:
        raise ValueError("not finite: " + "; ".join(str(r.asDict()) for r in bad))
    return df


def epoch_means(log: DataFrame, epoch: str, batch: str, loss: str) -> DataFrame:
    """(epoch, loss, n_batches): the mean over batches of each batch's mean loss."""
    each = log.groupBy(epoch, batch).agg(F.avg(loss).alias("_m"))
    return each.groupBy(epoch).agg(F.avg("_m").alias("loss"), F.count("*").alias("n_batches"))


def noisy(df: DataFrame, key: str, value: str, sigma: float, seed: int) -> DataFrame:
    """``df`` with ``sigma`` standard deviations of seeded normal noise added to a value; no noise at sigma 0."""
    if sigma <= 0:
        return df
    spread = df.agg(F.greatest(F.stddev_samp(value), F.lit(1e-8)).alias("_s"))
    # one row, by the aggregate
    return df.join(F.broadcast(spread)).withColumn(value, F.col(value) + sigma * F.col("_s") * hashed_normal(F.col(key), seed)).drop("_s")


def parameter_count(shapes: DataFrame, shape: str) -> DataFrame:
    """(n_parameters): the sum over arrays of the product of their sizes; an empty shape is one number."""
    return shapes.agg(F.coalesce(F.sum(F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, b: a * b)), F.lit(0)).cast("bigint").alias("n_parameters"))


def ridge_r2(df: DataFrame, inputs: Sequence[str], target: str, alpha: float = 1e-3) -> DataFrame:
    """(r2, n): how much of the target a ridge regression on the standardised inputs explains; rows with a null or NaN take no part.

    One aggregate gives all moments; the equations of a few inputs are solved from them.
    """
    names = [*inputs, target]
    rows = df.select(*(missing(F.col(c).cast("double")).alias(c) for c in names)).dropna()
    moments = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)).first()
    k, n = len(inputs), moments["n"]
    if not n:
        return df.sparkSession.createDataFrame([(None, 0)], "r2 double, n bigint")
    cov = np.array([[moments[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.diag(cov)[:k])
    scale[scale == 0] = 1
    xx, xy, yy = cov[:k, :k] / scale[:, None] / scale[None], cov[:k, k] / scale, cov[k, k]
    w = np.linalg.solve(xx + alpha / n * np.eye(k), xy)
    left = yy - 2 * w @ xy + w @ xx @ w
    return df.sparkSession.createDataFrame([(float(1 - left / yy) if yy > 0 else 0.0, n)], "r2 double, n bigint")
