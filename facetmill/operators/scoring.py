"""Class weights, label counts and grouped average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions.columns import missing, without_sentinel

#: Scores are cut into stretches of this width, so that a running count never needs a whole cell in one task.
STRETCH = 1 / 1024


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(target, n_rows, n_pos, n_neg, n_missing) of label columns with NaN or null as missing; one scan."""
    sums = []
    for c in columns:
        y = missing(F.col(c).cast("double"))
        sums.append(F.struct(F.lit(c).alias("target"), F.count("*").alias("n_rows"), F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"), F.count_if(y.isNull()).alias("n_missing")))
    return df.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def class_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(target, pos_weight): zeros over ones of each label column; 1 where there is no one."""
    counts = label_counts(df, columns)
    return counts.select("target", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0).alias("pos_weight"))


def weights_by_key(df: DataFrame, key: Column, label: str) -> DataFrame:
    """(key, n_pos, n_neg, n_rows): label sums by key, ordered use left to the caller."""
    y = F.col(label)
    return df.where(y.isin(0, 1)).groupBy(key.alias("key")).agg(F.sum(y).cast("bigint").alias("n_pos"), (F.count("*") - F.sum(y)).cast("bigint").alias("n_neg"), F.count("*").alias("n_rows"))


def long_scores(df: DataFrame, keys: Sequence[str], targets: Sequence[str], score: str = "pred_{}", truth: str = "truth_{}") -> DataFrame:
    """(keys.., target, y, score): one row for each target with a label and a score."""
    rows = F.array(*(F.struct(F.lit(t).alias("target"), without_sentinel(F.col(truth.format(t))).alias("y"), missing(F.col(score.format(t))).alias("score")) for t in targets))
    return df.select(*keys, F.inline(rows)).where("y is not null and score is not null")


def average_precision(scored: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(cell.., ap, n, n_pos): average precision of y by descending score; equal scores are one threshold; no positive gives 0.

    Counts run over stretches of scores first and within a stretch then, so a cell may hold any number of rows.
    """
    cell = list(cell)
    at = [*cell, "score"]
    ties = scored.groupBy(*at).agg(F.sum("y").alias("p"), F.count("*").alias("k")).withColumn("stretch", F.floor(F.col("score") / STRETCH))
    sums = ties.groupBy(*cell, "stretch").agg(F.sum("p").alias("sp"), F.sum("k").alias("sk"))
    above = Window.partitionBy(*cell).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*cell, "stretch", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("sk").over(above), F.lit(0)).alias("bk"))
    within = Window.partitionBy(*cell, "stretch").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.select(*cell, "stretch", "p", "k", F.sum("p").over(within).alias("wp"), F.sum("k").over(within).alias("wk")).join(before, [*cell, "stretch"])
    precision = (F.col("wp") + F.col("bp")) / (F.col("wk") + F.col("bk"))
    found = ranked.groupBy(*cell).agg(F.sum(F.col("p") * precision).alias("s"), F.sum("p").alias("n_pos"), F.sum("k").alias("n"))
    return found.select(*cell, F.when(F.col("n_pos") > 0, F.col("s") / F.col("n_pos")).otherwise(0.0).alias("ap"), "n", F.col("n_pos").cast("bigint").alias("n_pos"))


def mean_average_precision(scored: DataFrame, run: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """(run.., map, n_cells): mean over the cells that have rows; empty cells do not count."""
    return average_precision(scored, [*run, *cell]).groupBy(*run).agg(F.avg("ap").alias("map"), F.count("*").alias("n_cells"))
