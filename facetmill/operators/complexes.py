"""Cell complexes as tables: nodes, edges, faces and their incidence, and the barycentric skeleton.

A collection of graphs is one set of tables keyed by graph id: edges (g, u, v) in one or both
directions, incidence (g, face, u, v). Every operator is a join or aggregate on those keys, so
one huge graph and billions of small ones take the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected_edges(edges: DataFrame) -> DataFrame:
    """(g, u, v) with u < v, each once; loops and nulls left out."""
    return edges.where("u <> v").select("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    one = undirected_edges(edges)
    return one.unionAll(one.select("g", F.col("v").alias("u"), F.col("u").alias("v")))


def bary_skeleton(edges: DataFrame, faces: DataFrame | None = None, node_to_face: bool = True) -> DataFrame:
    """(g, a, b): links of the barycentric 1-skeleton, cells named ``n:u``, ``e:u-v`` and ``f:face``, each link once.

    Links join a node and its edges, an edge and its faces, and with ``node_to_face`` a node and the faces around it. faces is
    (g, face, u, v), one row for each edge of a face in either direction.
    """
    node = lambda c: F.concat(F.lit("n:"), F.col(c).cast("string"))
    edge = F.concat(F.lit("e:"), F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"))
    one = undirected_edges(edges)
    links = one.select("g", F.explode(F.array(node("u"), node("v"))).alias("a"), edge.alias("b"))
    if faces is None:
        return links
    around = faces.where("u <> v").select("g", "face", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    face = F.concat(F.lit("f:"), F.col("face").cast("string"))
    # an edge that only a face names is no edge of the graph
    around = around.join(one, ["g", "u", "v"], "left_semi")
    links = links.unionAll(around.select("g", edge.alias("a"), face.alias("b")))
    if node_to_face:
        links = links.unionAll(around.select("g", F.explode(F.array(node("u"), node("v"))).alias("a"), face.alias("b")).distinct())
    return links


def degrees(edges: DataFrame, nodes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(g, u, degree): outgoing edges of each node, capped at ``most``; with ``nodes`` (g, u) isolated ones get 0."""
    d = edges.groupBy("g", "u").agg(F.count("*").alias("degree"))
    if nodes is not None:
        d = nodes.join(d, ["g", "u"], "left").select("g", "u", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    return d.withColumn("degree", F.least("degree", F.lit(most).cast("bigint"))) if most is not None else d


def normalised_laplacian(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(g, u, v, w): non-zero entries of the symmetric normalised Laplacian; an isolated node has the identity row.

    Degrees are counted once per (g, u); each edge looks up its far end's by one join.
    """
    d = degrees(both_directions(edges))
    one = undirected_edges(edges)
    of = lambda end, name: d.select("g", F.col("u").alias(end), F.col("degree").alias(name))
    half = one.join(of("u", "du"), ["g", "u"]).join(of("v", "dv"), ["g", "v"]).select("g", "u", "v", (-1 / F.sqrt(F.col("du") * F.col("dv"))).alias("w"))
    off = half.select("g", F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))
    ends = nodes.select("g", "u").distinct() if nodes is not None else d.select("g", "u")
    return off.unionAll(ends.select("g", "u", F.col("u").alias("v"), F.lit(1.0).alias("w")))


def member_stats(members: DataFrame, value: str, flag: str) -> DataFrame:
    """(g, face, n, mean, all_set, any_set, n_set) over the members of each face."""
    f = F.col(flag)
    return members.groupBy("g", "face").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.bool_and(f).alias("all_set"), F.bool_or(f).alias("any_set"), F.count_if(f).alias("n_set"))


def membership_counts(members: DataFrame) -> DataFrame:
    """(g, u, v, n_faces): in how many faces each edge lies."""
    return members.groupBy("g", "u", "v").agg(F.countDistinct("face").alias("n_faces"))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """(g, edge, u, v): both directions of each edge under 2b and 2b + 1, b its position by (u, v) within its graph.

    The order is taken within one graph; a graph is one task's work here, as everywhere a dense id is asked for.
    """
    from pyspark.sql import Window

    b = (F.row_number().over(Window.partitionBy("g").orderBy("u", "v")) - 1).cast("bigint")
    one = undirected_edges(edges).withColumn("b", b)
    return one.select("g", (F.col("b") * 2).alias("edge"), "u", "v").unionAll(one.select("g", (F.col("b") * 2 + 1).alias("edge"), F.col("v").alias("u"), F.col("u").alias("v")))


def face_graph(incidence: DataFrame, face: str, position: str, graph: str) -> DataFrame:
    """(face, graph): the graph of a face, that of its first edge by position."""
    return incidence.groupBy(face).agg(F.min_by(graph, position).alias(graph))


def padded_pairs(hops: DataFrame, width: int, fill: int = -1) -> DataFrame:
    """(g, i, j, d, real): the pairs of each graph on a square of ``width`` places, places without a node filled.

    hops is (g, u, v, d) with nodes from 0 on; nodes at or beyond ``width`` are left out.
    """
    side = F.sequence(F.lit(0), F.lit(width - 1))
    square = hops.select("g").distinct().withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).select("g", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    own = hops.select("g", F.col("u").alias("i"), F.col("v").alias("j"), F.col("d").cast("bigint").alias("d"))
    return square.join(own, ["g", "i", "j"], "left").select("g", "i", "j", F.coalesce("d", F.lit(fill).cast("bigint")).alias("d"), F.col("d").isNotNull().alias("real"))
