"""Problem 7: for every bit vector the k most similar other ones, at an accepted loss of accuracy.

Method: shifted space-filling curves. Each curve projects a vector onto a few coordinates, the smallest ranks of its set bits
under random orders of the bits. Near vectors have equal or near smallest ranks, as a vector's next smallest rank is
not far, so the coordinates keep their order. They are shifted by a random step per curve and put on a Hilbert curve.
Every curve orders all vectors; Spark range-partitions the orders at keys it samples, and windows of neighbouring positions give candidates. The
edges of neighbouring ranges meet once more, so no window is cut by a range. A folded copy of each vector travels along: two
folded vectors differ in no more bits than the vectors do, which drops candidates below the least similarity
and never one above it. What is left is reranked with the full vectors.

Vectors cross the network for the rerank only. Equal vectors of one batch travel as one row and are expanded at the end, so a
vector that a third of all rows share costs no more than others; a cell that many vectors share is split over ranges by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetmill.llm.collapse import BATCH_ROWS
from facetmill.sources.scratch import Scratch

CURVES = 12
COORDINATES = 6
#: Bits of a smallest rank; larger ranks count as the largest. A shift adds one bit.
BITS = 7
WINDOW = 40
#: 64-bit words of a folded vector.
FOLDED = 4
#: Rows of one curve in a range, about.
RANGE_ROWS = 50_000
_CURVE_AT = COORDINATES * (BITS + 1)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points``, whole numbers below 2**bits; at most 63 bits in all."""
    x = points.astype(np.uint64).copy()
    dims = x.shape[1]
    one = np.uint64(1)
    # undo the reflections and swaps of each level, from the coarsest on
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - one
        for i in range(dims):
            hit = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & low
            swap[hit] = 0
            x[:, 0] ^= swap
            x[:, i] ^= swap
            x[hit, 0] ^= low
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        turn[(x[:, dims - 1] & q) != 0] ^= q - one
    x ^= turn[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[:, i] >> np.uint64(level)) & one)
    return out


def smallest_ranks(vectors: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """(rows, orders): the smallest rank of each row's set bits under each order, at most 2**BITS - 1; every row has a set bit."""
    bits = np.unpackbits(vectors, axis=1)
    where = np.flatnonzero(bits) % bits.shape[1]
    counts = bits.sum(1, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return np.stack([np.minimum(np.minimum.reduceat(o[where], first), (1 << BITS) - 1) for o in orders], 1)


def curve_keys(vectors: np.ndarray, curves: int, coordinates: int, seed: int) -> np.ndarray:
    """(rows, curves) positions: the curve, and the place of the shifted coordinates on it."""
    dice = np.random.default_rng(seed)
    orders = np.stack([dice.permutation(vectors.shape[1] * 8).astype(np.uint16) for _ in range(curves * coordinates)])
    shifts = dice.integers(0, 1 << BITS, (curves, coordinates))
    ranks = smallest_ranks(vectors, orders).astype(np.int64)
    out = np.empty((len(vectors), curves), np.int64)
    for c in range(curves):
        out[:, c] = hilbert(ranks[:, c * coordinates : (c + 1) * coordinates] + shifts[c], BITS + 1).astype(np.int64) | np.int64(c) << _CURVE_AT
    return out


def fold(vectors: np.ndarray) -> np.ndarray:
    """(rows, FOLDED) words: the vector's 64-bit words xored into a few, which differ in no more bits than the vectors."""
    words = np.ascontiguousarray(vectors).view(np.uint64)
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, FOLDED), axis=1)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def prepare(df: DataFrame, id_col: str, vector_col: str, width: int, curves: int, coordinates: int, seed: int) -> DataFrame:
    """(id, twins, n, f0.., keys): one row for each distinct vector of a batch, under its smallest id."""
    words = [f"f{i}" for i in range(FOLDED)]
    out = pa.schema([("id", pa.int64()), ("twins", pa.list_(pa.int64())), ("n", pa.int32()), *((w, pa.int64()) for w in words), ("keys", pa.list_(pa.int64()))])

    def flush(parts: list[pa.Table]):
        if not parts:
            return
        same = pa.concat_tables(parts).group_by("vector", use_threads=False).aggregate([("id", "min"), ("id", "distinct"), ("id", "count")])
        for b in same.combine_chunks().to_batches(20_000):
            v = _rows(b.column("vector"), width)
            folded = fold(v).view(np.int64)
            keys = curve_keys(v, curves, coordinates, seed)
            # most vectors are alone: only others keep their list of ids
            many = np.flatnonzero(b.column("id_count").to_numpy() > 1)
            twins: list = [None] * len(v)
            for i in many.tolist():
                ids = sorted(b.column("id_distinct")[i].as_py())
                twins[i] = ids if len(ids) > 1 else None
            offsets = pa.array(np.arange(0, len(v) * curves + 1, curves), pa.int32())
            n = np.bitwise_count(v).sum(1, dtype=np.int32)
            columns = [b.column("id_min"), pa.array(twins, out.field(1).type), pa.array(n), *(pa.array(folded[:, i].copy()) for i in range(FOLDED)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches):
        parts, rows = [], 0
        for b in batches:
            parts.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= BATCH_ROWS:
                yield from flush(parts)
                parts, rows = [], 0
        yield from flush(parts)

    zero = F.unhex(F.lit("00" * width))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.length("vector") == width) & (F.col("vector") != zero))
    return rows.mapInArrow(run, "id bigint, twins array<bigint>, n int, " + ", ".join(f"{w} bigint" for w in words) + ", keys array<bigint>")


def _near_in_windows(t: np.ndarray, old: int, window: int, least: float) -> np.ndarray:
    """(a, b), each once, of rows at most ``window`` apart on one curve that may reach ``least``; both before ``old`` is done already.

    t holds the columns at, id, n and the folded words, in order of at.
    """
    at, ids, n, words = t[0], t[1], t[2], t[3:].view(np.uint64)
    curve, rows = at >> _CURVE_AT, t.shape[1]
    found = [np.empty((2, 0), np.int64)]
    for step in range(1, min(window, rows - 1) + 1):
        i = np.arange(max(0, old - step), rows - step)
        j = i + step
        i, j = (x[(curve[i] == curve[j]) & (ids[i] != ids[j])] for x in (i, j))
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
        near = apart <= (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-6
        found.append(np.stack([i[near], j[near]]))
    i, j = ids[np.concatenate(found, axis=1)]
    return np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)


def window_pairs(prepared: DataFrame, ranges: int, window: int, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of neighbouring positions of any curve that may reach ``least``.

    First each range by itself; it also hands on its first and last ``window`` rows, under the number of the edge they lie at.
    Then the two sides of each edge.
    """
    kept = ["at", "id", "n", *(f"f{i}" for i in range(FOLDED))]
    names = ["a", "b", "edge", *kept]
    empty = np.empty((2, 0), np.int64)

    def rows_out(pairs: np.ndarray, edge: int | None, rows: np.ndarray | None) -> pa.RecordBatch:
        some = pairs.shape[1] if rows is None else rows.shape[1]
        blank = pa.nulls(some, pa.int64())
        own = [pa.array(pairs[0].copy()), pa.array(pairs[1].copy()), blank] if rows is None else [blank, blank, pa.array(np.full(some, edge))]
        return pa.RecordBatch.from_arrays([*own, *([blank] * len(kept) if rows is None else [pa.array(r.copy()) for r in rows])], names=names)

    def inside(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        tail, head = None, None
        for b in batches:
            t = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            old = 0 if tail is None else tail.shape[1]
            t = t if tail is None else np.concatenate([tail, t], axis=1)
            if head is None or head.shape[1] < window:
                own = t[:, old:] if head is not None else t
                head = (own if head is None else np.concatenate([head, own], axis=1))[:, :window]
            yield rows_out(_near_in_windows(t, old, window, least), None, None)
            tail = t[:, -window:]
        if tail is not None:
            yield rows_out(empty, number, head)
            yield rows_out(empty, number + 1, tail)

    def across(batches):
        held, at = [], None

        def meet():
            t = np.concatenate(held, axis=1)
            return rows_out(_near_in_windows(t[1:], 0, window, least), None, None).select(["a", "b"])

        for b in batches:
            t = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            cuts = np.flatnonzero(np.diff(t[0])) + 1
            for part in np.split(t, cuts, axis=1):
                if part.shape[1] and part[0, 0] != at and held:
                    yield meet()
                    held = []
                if part.shape[1]:
                    at = part[0, 0]
                    held.append(part)
        if held:
            yield meet()

    rows = prepared.select(F.explode("keys").alias("at"), *kept[1:])
    schema = ", ".join(f"{n} bigint" for n in names)
    found = scratch.write(rows.repartitionByRange(ranges, "at", "id").sortWithinPartitions("at", "id").mapInArrow(inside, schema), "windows")
    edges = found.where("edge is not null").select("edge", *kept).repartition("edge").sortWithinPartitions("edge", "at", "id").mapInArrow(across, "a bigint, b bigint")
    return found.where("edge is null").select("a", "b").unionAll(edges)


def similarities(pairs: DataFrame, vectors: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach ``least``, from their full vectors."""

    def run(batches):
        for b in batches:
            x, y = (_rows(b.column(i), width).view(np.uint64) for i in (2, 3))
            both = np.bitwise_count(x & y).sum(1, dtype=np.int64)
            s = both / np.bitwise_count(x | y).sum(1, dtype=np.int64)
            t = pa.table({"a": b.column(0), "b": b.column(1), "similarity": s}).filter(pa.array(s >= least))
            yield from t.to_batches()

    of_a, of_b = (vectors.select(F.col("id").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    joined = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 3, least: float = 0.6, width: int = 256, curves: int = CURVES, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """(id, other, similarity, nth): of each vector up to k others with the highest Tanimoto similarity, all at least ``least``.

    Ties go to the smaller id. Rows with a null id, a null vector, one of another width, or one without a set bit take
    no part; a repeated row is one row; an id with several vectors is compared by the smallest of them. Curves and
    windows are fixed; raise ``curves`` or ``window`` for more recall. Measured recall is in the README.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "nearest")
    prepared = prepare(df, id_col, vector_col, width, curves, COORDINATES, seed)
    ready = scratch.write(prepared, "ready")
    # results don't depend on the number of ranges, as their edges meet
    ranges = max(1, ready.count() * curves // RANGE_ROWS)
    pairs = scratch.write(window_pairs(ready, ranges, window, least, scratch).distinct(), "pairs")
    scratch.tidy()
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where((F.length("vector") == width) & F.col("id").isNotNull()).groupBy("id").agg(F.min("vector").alias("vector"))
    near = similarities(pairs, vectors, width, least)
    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    # each row stands for its equals in a batch: they are near it and near each other
    equals = ready.where("twins is not null").select("id", "twins")
    own = equals.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    top = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    both = both.unionAll(own).withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth")
    few = equals.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("twins", 1, k + 1)))), 1, k + 1).alias("few"))
    others = both.join(few.withColumnRenamed("id", "b"), "b", "left").select("a", F.explode(F.coalesce("few", F.array("b"))).alias("other"), "similarity")
    all_ids = equals.select(F.col("id").alias("a"), F.explode("twins").alias("id")).distinct()
    spread = others.join(all_ids, "a", "left").select(F.coalesce("id", "a").alias("id"), "other", "similarity").where("id <> other").distinct()
    last = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return spread.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= k)
