"""Problem 3: items of varying length go into containers of a fixed capacity with little unused space.

Method: sum-of-squares packing. N(g) is the number of open containers with g left. An item goes where
the sum of N(g) squared becomes smallest; a new container is one of the choices. An item longer
than the capacity is cut into full containers and one remainder, which is packed like an item.

Placing is sequential, so rows are spread over shards by a hash and each shard packs its own
containers, for all capacities in one pass. A shard leaves a few hundred open containers at most,
whatever its size, so the loss does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one shard packs.
SHARD_ROWS = 50_000
#: White space of any kind and zero-width characters, which take no room.
_NO_ROOM = r"[\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}-\x{2064}\x{3000}\x{feff}]+"


def room_taken(c: Column) -> Column:
    """The number of characters of a string without white space and zero-width characters; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(c, _NO_ROOM, "")), F.lit(0))


class SumOfSquares:
    """Places lengths into containers of one capacity; containers are numbered from 0."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        # counts[g] and its negative twin, each with the closed gap 0 and the unopened gap `capacity` pinned
        self.open = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, n: int) -> int:
        """The container of an item of length n, 1 <= n <= capacity."""
        c, held = self.capacity, self.open
        gaps = held[n:c]
        # change of the sum of squares, halved: N(g - n) - N(g), one less of that where the container closes
        change = np.where(gaps > 0, held[: c - n] - gaps + 1, 1 << 60)
        if n < c:
            change[0] = 1 - 2 * gaps[0] if gaps[0] > 0 else 1 << 60
            change[1:] *= 2
        best = int(change.argmin()) if n < c else -1
        new = 2 * int(held[c - n]) + 1 if n < c else 1
        if best >= 0 and change[best] <= new:
            gap = n + best
            held[gap] -= 1
            number = self.bins[gap].pop()
        else:
            gap, number = c, self.used
            self.used += 1
        if gap > n:
            held[gap - n] += 1
            self.bins[gap - n].append(number)
        return number


def pack(df: DataFrame, id_col: str, text_col: str, capacities: Mapping[int, int], shard_rows: int = SHARD_ROWS, seed: int = 3) -> DataFrame:
    """(limit_id, container, id, piece, n_pieces, start, length): the container of every piece of every row.

    start and length count characters that take room. Rows with a null id, or whose text is null,
    blank or empty, take no room and get no container. A row whose id is repeated is packed as often
    as it comes. Container numbers are unique within a limit. Capacities must be positive.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be positive")
    items = df.select(F.col(id_col).cast("long").alias("id"), room_taken(F.col(text_col).cast("string")).alias("n")).where("id is not null and n > 0")
    shards = max(1, math.ceil(df.count() / shard_rows))
    items = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int"))
    limits = sorted(capacities.items())
    names = ["limit_id", "container", "id", "piece", "n_pieces", "start", "length"]

    def run(batches):
        at, packers = None, []
        for b in batches:
            out: list[tuple] = []
            for i, n, shard in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    at, packers = shard, [(k, c, SumOfSquares(c)) for k, c in limits]
                for k, c, packer in packers:
                    pieces = -(-n // c)
                    for p in range(pieces):
                        size = min(c, n - p * c)
                        out.append((k, (shard << 36) | packer.place(size), i, p, pieces, p * c, size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    placed = items.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "id"))
    return placed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def fill_report(placed: DataFrame, capacities: Mapping[int, int]) -> DataFrame:
    """(limit_id, n_containers, n_pieces, unused_share) of a packing."""
    size = F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair))
    per = placed.groupBy("limit_id", "container").agg(F.sum("length").alias("held"), F.count("*").alias("n"))
    return per.groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), (1 - F.sum("held") / (F.count("*") * F.first(F.element_at(size, F.col("limit_id").cast("int"))))).alias("unused_share"))
