"""Message passing as joins and sums: scatter, leave-one-out means, pools, segment softmax, cosines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter_sums(edges: DataFrame, nodes: DataFrame, edge_value: str, node_value: str) -> DataFrame:
    """(g, u, in_edge, in_node, out_edge, out_node): sums over incoming and outgoing edges of the edge's and the far node's value.

    edges is (g, u, v, edge_value), nodes is (g, u, node_value); a node without edges gets 0 everywhere.
    """
    of = lambda end: nodes.select("g", F.col("u").alias(end), F.col(node_value).alias(f"x_{end}"))
    both = edges.select("g", "u", "v", F.col(edge_value).alias("e")).join(of("u"), ["g", "u"]).join(of("v"), ["g", "v"])
    ends = both.select("g", F.inline(F.array(
        F.struct(F.col("v").alias("at"), F.col("e").alias("ie"), F.col("x_u").alias("ix"), F.lit(0.0).alias("oe"), F.lit(0.0).alias("ox")),
        F.struct(F.col("u").alias("at"), F.lit(0.0).alias("ie"), F.lit(0.0).alias("ix"), F.col("e").alias("oe"), F.col("x_v").alias("ox")),
    )))
    sums = ends.groupBy("g", F.col("at").alias("u")).agg(*(F.sum(a).alias(b) for a, b in (("ie", "in_edge"), ("ix", "in_node"), ("oe", "out_edge"), ("ox", "out_node"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return nodes.select("g", "u").join(sums, ["g", "u"], "left").select("g", "u", *map(zero, ("in_edge", "in_node", "out_edge", "out_node")))


def coface_means(incidence: DataFrame, value: str, alpha: float = 1.0) -> DataFrame:
    """(g, edge, coface): alpha times the sum over an edge's faces of the mean of the other edges of the face.

    incidence is (g, face, edge, value), one row for each edge of a face. An edge alone in a face gets 0 from it. Sums are aggregated
    per face first and joined back, so a face with many edges is never held by one task.
    """
    face = incidence.groupBy("g", "face").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    other = (F.col("s") - F.col(value)) / F.greatest(F.col("n") - 1, F.lit(1))
    return incidence.join(face, ["g", "face"]).groupBy("g", "edge").agg((F.sum(other) * alpha).alias("coface"))


def pool(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group.., mean_pool, sum_pool, n)."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean_pool"), F.sum(value).alias("sum_pool"), F.count(value).alias("n"))


def softmax_pool(df: DataFrame, group: Sequence[str], score: str, value: str) -> DataFrame:
    """(group.., pooled): values weighted by the softmax of the scores within the group, shifted by the group's largest score."""
    top = df.groupBy(*group).agg(F.max(score).alias("_top"))
    w = F.exp(F.col(score) - F.col("_top"))
    return df.join(top, list(group)).groupBy(*group).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("pooled"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length one; the zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def mean_pairwise_cosine(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """(group.., cosine, n): mean cosine over the pairs of different rows of a group, 1 for a single row.

    The sum over all pairs is the squared length of the sum of the unit vectors, less the n pairs of a row with
    itself, halved: one aggregate instead of a self-join, exact at any group size.
    """
    parts = df.select(*group, F.posexplode(unit(F.col(vector))).alias("at", "x"))
    sums = parts.groupBy(*group, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    total = sums.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return total.select(*group, F.when(F.col("n") > 1, (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("cosine"), "n")
