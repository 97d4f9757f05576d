"""Batches under caps: windows sorted by size, greedy packing, batch counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sortish_order(df: DataFrame, key: str, size: str, window: int, seed: int, block_bits: int = 12) -> DataFrame:
    """(key, size, place, win): a seeded shuffle cut into windows of ``window`` rows, each sorted by descending size.

    The place in the shuffle is the count of smaller hashes: whole hash blocks first, then the rows of the own block. Ties by key.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rows = df.select(key, size, h.alias("h")).withColumn("block", F.substring("h", 1, block_bits // 4))
    sums = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("h", key)) - 1
    placed = rows.withColumn("nth", nth).join(before, "block").withColumn("at", F.col("nth") + F.col("before"))
    win = F.floor(F.col("at") / window).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("win").orderBy(F.desc(size), "at")) - 1
    return placed.withColumn("win", win).withColumn("place", (F.col("win") * window + inside).cast("bigint")).select(key, size, "place", "win")


def token_buckets(df: DataFrame, order: str, nodes: str, edges: str, most_nodes: int, most_edges: int, most_rows: int, shards: int = 1, drop_last: bool = False) -> DataFrame:
    """(shard, batch, order): greedy batches in order under three caps; a row that alone breaks a cap is a batch of its own.

    The packing is sequential within a shard; shards of a hash of the order column pack side by side, each with one open batch at its end.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        n, e = (np.r_[0, pdf[c].to_numpy().cumsum()] for c in ("n", "e"))
        # a batch that begins at a row ends before the first one at which a running sum or the number of rows breaks its cap
        ends = np.minimum(np.minimum(np.searchsorted(n, n[:-1] + most_nodes, "right"), np.searchsorted(e, e[:-1] + most_edges, "right")) - 1, np.arange(len(pdf)) + most_rows)
        starts, at = [], 0
        while at < len(pdf):
            starts.append(at)
            at = max(at + 1, int(ends[at]))
        last = len(starts)
        batch = np.searchsorted(starts, np.arange(len(pdf)), "right") - 1
        if drop_last and last and ends[starts[-1]] > starts[-1]:
            pdf, batch = pdf[batch < last - 1], batch[batch < last - 1]
        return pd.DataFrame({"shard": pdf["shard"], "batch": batch, "at": pdf["at"]})

    rows = df.select(F.col(order).cast("bigint").alias("at"), F.col(nodes).cast("bigint").alias("n"), F.col(edges).cast("bigint").alias("e")).withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInPandas(run, "shard int, batch bigint, at bigint").withColumnRenamed("at", order)


def batch_estimate(df: DataFrame, size: str, cap: int) -> DataFrame:
    """(n_batches): whole size over the cap, rounded up, at least 1."""
    return df.agg(F.greatest(F.ceil(F.coalesce(F.sum(size), F.lit(0)) / cap), F.lit(1)).cast("bigint").alias("n_batches"))


def pack_offsets(df: DataFrame, pack: str, order: str, size: str) -> DataFrame:
    """(pack, order, offset): exclusive running sum of sizes within a pack, which is bounded by its cap."""
    w = Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(pack, order, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint").alias("offset"))


def micro_batches(packed: DataFrame, order: str, packs: int) -> DataFrame:
    """``packed`` (shard, batch, order) with ``micro``, ``packs`` neighbouring batches of a shard together."""
    return packed.select("shard", "batch", order, F.floor(F.col("batch") / packs).cast("bigint").alias("micro"))


def collated(packed: DataFrame, sizes: DataFrame, order: str, nodes: str, edges: str) -> DataFrame:
    """(shard, batch, order, node_offset, edge_offset): where each graph's nodes and edges begin in its batch."""
    w = Window.partitionBy("shard", "batch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, name: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(name)
    return packed.join(sizes, order).select("shard", "batch", order, before(nodes, "node_offset"), before(edges, "edge_offset"))
