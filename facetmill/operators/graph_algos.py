"""Hop distances, random-walk returns and Laplacian spectra.

Two plans: one large graph is walked with joins, a frontier at a time; many small graphs go whole
to Arrow tasks, where numpy does the linear algebra of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.sources.scratch import Scratch, one_thread_a_task


def hops_by_frontier(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(g, u, v, d): hops along the edges as given, for all reachable pairs of different nodes, or those up to ``most`` hops.

    Each round joins the newest pairs with the edges and keeps pairs not seen; pairs are written, so lineage stays short.
    """
    scratch = Scratch(edges.sparkSession, "hops")
    step = scratch.write(edges.where("u <> v").select("g", "u", "v").distinct(), "edges")
    found = step.withColumn("d", F.lit(1))
    front, onward = step, step.select("g", F.col("u").alias("v"), F.col("v").alias("w"))
    d = 1
    while most is None or d < most:
        d += 1
        reached = front.join(onward, ["g", "v"]).select("g", "u", F.col("w").alias("v")).where("u <> v").distinct()
        front = scratch.write(reached.join(found, ["g", "u", "v"], "left_anti"), f"front{d}")
        if front.limit(1).count() == 0:
            break
        found = found.unionAll(front.withColumn("d", F.lit(d)))
    return found


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of one graph in order, and its adjacency; rows with a null v only name a node."""
    nodes = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].dropna().to_numpy()])).astype(np.int64)
    a = np.zeros((len(nodes), len(nodes)))
    linked = pdf["v"].notna().to_numpy()
    np.add.at(a, (np.searchsorted(nodes, pdf["u"][linked]), np.searchsorted(nodes, pdf["v"][linked])), 1.0)
    return nodes, a


def hops_by_graph(edges: DataFrame) -> DataFrame:
    """(g, u, v, d): hops of all ordered pairs of each small graph, 0 to itself, -1 where there is no way."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _dense(pdf)
        n = len(nodes)
        d = np.full((n, n), -1, np.int64)
        np.fill_diagonal(d, 0)
        front, k = np.eye(n, dtype=bool), 0
        links = (a > 0).astype(np.float32)
        while front.any():
            k += 1
            front = ((front.astype(np.float32) @ links) > 0) & (d < 0)
            d[front] = k
        i, j = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "u": nodes[i], "v": nodes[j], "d": d.ravel()})

    return one_thread_a_task(edges).select("g", "u", "v").groupBy("g").applyInPandas(run, "g bigint, u bigint, v bigint, d bigint")


def returns_by_join(edges: DataFrame, steps: int = 3, space_dim: int = 0) -> DataFrame:
    """(g, u, k, p): the chance of a walk from u to be back after k steps, scaled by k ** (space_dim / 2); joins only.

    Repeated edges weigh as often as they come. A node that no edge leaves keeps the walk, p 1.
    """
    out = edges.groupBy("g", "u", "v").agg(F.count("*").alias("w"))
    total = Window.partitionBy("g", "u")
    step = out.withColumn("p", F.col("w") / F.sum("w").over(total)).select("g", "u", "v", "p")
    ends = out.select("g", F.explode(F.array("u", "v")).alias("u")).distinct()
    stay = ends.join(out.select("g", "u").distinct(), ["g", "u"], "left_anti").select("g", "u", F.col("u").alias("v"), F.lit(1.0).alias("p"))
    step = Scratch(edges.sparkSession, "walk").write(step.unionAll(stay), "step")
    onward = step.select("g", F.col("u").alias("v"), F.col("v").alias("w"), F.col("p").alias("q"))
    walk, found = step, None
    for k in range(1, steps + 1):
        back = walk.where("u = v").select("g", "u", (F.col("p") * F.lit(float(k) ** (space_dim / 2))).alias("p"))
        own = ends.join(back, ["g", "u"], "left").select("g", "u", F.lit(k).alias("k"), F.coalesce("p", F.lit(0.0)).alias("p"))
        found = own if found is None else found.unionAll(own)
        walk = walk.join(onward, ["g", "v"]).groupBy("g", "u", F.col("w").alias("v")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return found


def skeleton_hops(links: DataFrame, cells: str = "n:") -> DataFrame:
    """(g, u, v, d): hops between cells of one kind, nodes unless said otherwise, along the barycentric skeleton; "" takes all cells."""
    two = links.select("g", F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("g", F.col("b").alias("u"), F.col("a").alias("v")))
    return hops_by_frontier(two).where(F.col("u").startswith(cells) & F.col("v").startswith(cells))


def skeleton_returns(links: DataFrame, steps: int = 3, space_dim: int = 0) -> DataFrame:
    """(g, cell, k, p): the chance of a walk along the skeleton from each cell to be back after k steps; every cell of a link has a way on."""
    two = links.select("g", F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("g", F.col("b").alias("u"), F.col("a").alias("v")))
    return returns_by_join(two, steps, space_dim).withColumnRenamed("u", "cell")


def returns_by_graph(edges: DataFrame, steps: int = 16, space_dim: int = 0, dangling_stays: bool = True) -> DataFrame:
    """(g, u, p): array of the chances to be back after 1 to ``steps`` steps, for small graphs.

    dangling_stays: a node that no edge leaves keeps the walk; else its row is empty.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _dense(pdf)
        total = a.sum(1, keepdims=True)
        p = np.divide(a, total, out=np.zeros_like(a), where=total > 0)
        if dangling_stays:
            lone = np.flatnonzero(total[:, 0] == 0)
            p[lone, lone] = 1.0
        power, back = np.eye(len(nodes)), []
        for k in range(1, steps + 1):
            power = power @ p
            back.append(np.diag(power) * k ** (space_dim / 2))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "u": nodes, "p": [*np.stack(back, 1)]})

    return one_thread_a_task(edges).select("g", "u", "v").groupBy("g").applyInPandas(run, "g bigint, u bigint, p array<double>")


def _laplacian(a: np.ndarray) -> np.ndarray:
    a = (np.maximum(a, a.T) > 0).astype(float)
    np.fill_diagonal(a, 0)
    d = a.sum(1)
    scale = np.divide(1.0, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return np.eye(len(a)) - scale[:, None] * a * scale[None]


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its entry of largest size positive."""
    if not vectors.size:
        return vectors
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def _padded(x: np.ndarray, k: int) -> np.ndarray:
    return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, k - x.shape[-1])])


def laplacian_encodings(edges: DataFrame, k: int = 7, zero: float = 1e-10) -> DataFrame:
    """(g, u, values, vector): the k smallest eigenvalues above ``zero``, over the largest of them, and u's entries; padded with zeros.

    Repeated eigenvalues leave their vectors free up to a rotation, as everywhere.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _dense(pdf)
        values, vectors = np.linalg.eigh(_laplacian(a))
        kept = np.flatnonzero(values > zero)[:k]
        values, vectors = values[kept], _signed(vectors[:, kept])
        scaled = values / values.max() if len(values) else values
        return pd.DataFrame({"g": pdf["g"].iloc[0], "u": nodes, "values": [_padded(scaled, k)] * len(nodes), "vector": [*_padded(vectors, k)]})

    return one_thread_a_task(edges).select("g", "u", "v").groupBy("g").applyInPandas(run, "g bigint, u bigint, values array<double>, vector array<double>")


def bary_encodings(links: DataFrame, k: int = 7, zero: float = 1e-9) -> DataFrame:
    """(g, cell, values, vector): encodings on the barycentric skeleton, links (g, a, b) between named cells.

    Of the min(k + 8, cells - 1) smallest eigenpairs those above ``zero``; values halved and cut to [0, 1], vectors of unit length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.unique(np.concatenate([pdf["a"], pdf["b"]]).astype(str))
        a = np.zeros((len(cells), len(cells)))
        i, j = np.searchsorted(cells, pdf["a"].astype(str)), np.searchsorted(cells, pdf["b"].astype(str))
        a[i, j] = a[j, i] = 1.0
        values, vectors = np.linalg.eigh(_laplacian(a))
        pool = max(1, min(k + 8, len(cells) - 1))
        kept = np.flatnonzero(values[:pool] > zero)[:k]
        values, vectors = values[kept], _signed(vectors[:, kept])
        length = np.linalg.norm(vectors, axis=0)
        vectors = vectors / np.where(length > 0, length, 1)
        shown = _padded(np.clip(values / 2, 0, 1), k)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "cell": cells, "values": [shown] * len(cells), "vector": [*_padded(vectors, k)]})

    return one_thread_a_task(links).select("g", "a", "b").groupBy("g").applyInPandas(run, "g bigint, cell string, values array<double>, vector array<double>")


def nested_encodings(found: DataFrame, k: int = 7, steps: int = 16, zero: float = 1e-10) -> DataFrame:
    """(g, n, values, vectors, returns, hops) of nested complexes, one row a graph: spectrum, walk returns and hop matrix.

    vectors, returns and hops are flat, node after node: n times k, n times ``steps``, n times n.

    The plan for collections of small graphs: each row is a whole graph, so nothing is shuffled and a batch is one call.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for g, atoms, bonds in zip(pdf["g"], pdf["atoms"], pdf["bonds"]):
                n = len(atoms)
                a = np.zeros((n, n))
                for b in bonds:
                    a[b["u"], b["v"]] = a[b["v"], b["u"]] = 1.0
                values, vectors = np.linalg.eigh(_laplacian(a))
                kept = np.flatnonzero(values > zero)[:k]
                values, vectors = values[kept], _signed(vectors[:, kept])
                total = a.sum(1, keepdims=True)
                p = np.divide(a, total, out=np.eye(n), where=total > 0)
                power, back = np.eye(n), []
                for _ in range(steps):
                    power = power @ p
                    back.append(np.diag(power).copy())
                hops = np.full((n, n), -1, np.int32)
                np.fill_diagonal(hops, 0)
                front, d, links = np.eye(n, dtype=bool), 0, a.astype(np.float32)
                while front.any():
                    d += 1
                    front = ((front.astype(np.float32) @ links) > 0) & (hops < 0)
                    hops[front] = d
                scaled = values / values.max() if len(values) else values
                rows.append((g, n, _padded(scaled, k), _padded(vectors, k).ravel(), np.stack(back, 1).ravel(), hops.ravel()))
            yield pd.DataFrame(rows, columns=["g", "n", "values", "vectors", "returns", "hops"])

    schema = "g bigint, n int, values array<double>, vectors array<double>, returns array<double>, hops array<int>"
    return one_thread_a_task(found).select("g", "atoms", "bonds").mapInPandas(run, schema)
