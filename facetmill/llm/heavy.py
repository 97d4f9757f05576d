"""Problem 6: the most frequent values of a column with approximate counts, in bounded memory.

Method: a heavy-light split. A value hashes to a bucket with a few cells. A cell keeps one value and
its exact count since it moved in; a value that finds no cell votes against the bucket's weakest
cell and evicts it when the votes outweigh its count. Evicted and refused counts fall into a
compact counter array. Partition sketches merge bucket by bucket: equal values add up, the
strongest stay, the rest falls into the merged counter array.

All sketches have the same size, BUCKETS * CELLS cells and LIGHT counters, whatever the data. Each
bucket also sums what fell out of it. No value outside a bucket's cells can be more frequent than
that sum, so the sketch proves when its candidates are complete; for buckets where it can't, the
second pass counts all their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.llm.collapse import BATCH_ROWS
from facetmill.sources.scratch import Scratch

BUCKETS = 1024
CELLS = 8
LIGHT = 1 << 14
#: Votes against a cell, as a multiple of its count, that evict it.
EVICT = 8


class Sketch(NamedTuple):
    """cells: bucket, value, n, upper. total: rows with a value. fell: mass outside the cells by bucket."""

    cells: DataFrame
    total: int
    fell: dict[int, int]


def not_blank(c: Column) -> Column:
    """Whether a string has a character other than white space and zero-width ones; null has none."""
    return F.coalesce(c.rlike(r"[^\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"), F.lit(False))


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _spot(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), c), F.lit(LIGHT)).cast("int")


def _sketch(batches) -> Iterator[pa.RecordBatch]:
    """(kind, at, value, n) of one partition: cells (0), light counters (1), mass that fell out of a bucket (2)."""
    cells: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    votes, light, fell = [0] * BUCKETS, [0] * LIGHT, [0] * BUCKETS

    def add(parts: list[pa.RecordBatch]) -> None:
        grouped = pa.Table.from_batches(parts).group_by(["value", "bucket", "spot"], use_threads=False).aggregate([([], "count_all")])
        for value, at, spot, n in zip(*(grouped[c].to_pylist() for c in ("value", "bucket", "spot", "count_all"))):
            held = cells[at]
            cell = held.get(value)
            if cell is not None:
                cell[0] += n
                continue
            if len(held) < CELLS:
                held[value] = [n, spot]
                continue
            votes[at] += n
            weakest = min(held, key=held.__getitem__)
            if votes[at] >= EVICT * held[weakest][0]:
                out, out_spot = held.pop(weakest)
                held[value] = [n, spot]
                votes[at] = 0
            else:
                out, out_spot = n, spot
            light[out_spot] += out
            fell[at] += out

    parts, rows = [], 0
    for b in batches:
        parts.append(b)
        rows += b.num_rows
        if rows >= BATCH_ROWS:
            add(parts)
            parts, rows = [], 0
    if parts:
        add(parts)
    out = [(0, at, value, n) for at, held in enumerate(cells) for value, (n, _) in held.items()]
    out += [(kind, at, None, n) for kind, sums in ((1, light), (2, fell)) for at, n in enumerate(sums) if n]
    for i in range(0, len(out), 10_000):
        kinds, ats, values, ns = zip(*out[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ats, pa.int32()), pa.array(values, pa.string()), pa.array(ns, pa.int64())], names=["kind", "at", "value", "n"])


def sketch(df: DataFrame, column: str, scratch: Scratch) -> Sketch:
    """The merged sketch of the non-blank values of ``column``; n is a lower, upper an upper bound of a value's count."""
    value = F.col(column).cast("string")
    rows = df.select(value.alias("value")).where(not_blank(F.col("value")))
    parts = scratch.write(rows.select("value", _bucket(F.col("value")).alias("bucket"), _spot(F.col("value")).alias("spot")).mapInArrow(_sketch, "kind int, at int, value string, n bigint").groupBy("kind", "at", "value").agg(F.sum("n").alias("n")), "parts")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), "value"))
    ranked = parts.where("kind = 0").select(F.col("at").alias("bucket"), "value", "n", rank.alias("nth"), _spot(F.col("value")).alias("spot"))
    ranked = scratch.write(ranked, "ranked")
    lost = ranked.where(F.col("nth") > CELLS)
    light = parts.where("kind = 1").select(F.col("at").alias("spot"), "n").unionAll(lost.select("spot", "n")).groupBy("spot").agg(F.sum("n").alias("light"))
    fell = dict(parts.where("kind = 2").select("at", "n").unionAll(lost.select("bucket", "n")).groupBy("at").agg(F.sum("n")).collect())
    total = int(parts.where("kind < 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cells = ranked.where(F.col("nth") <= CELLS).join(F.broadcast(light), "spot", "left").select("bucket", "value", "n", (F.col("n") + F.coalesce("light", F.lit(0))).alias("upper"))
    return Sketch(cells, total, fell)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, approx_count, upper): the k values with the largest counts in the sketch; ties by value."""
    found = sketch(df, column, Scratch(df.sparkSession, "heavy"))
    return found.cells.orderBy(F.desc("n"), "value").limit(k).select("value", F.col("n").alias("approx_count"), "upper")


def frequent_values(df: DataFrame, column: str, share: float) -> DataFrame:
    """(value, n_rows): each value, as stored, with at least ``share`` of the rows that have a non-blank value; exact.

    The sketch gives the candidates, at most BUCKETS * CELLS of them; one more scan counts those. Null and
    blank values are no values. An empty column has no frequent value.
    """
    scratch = Scratch(df.sparkSession, "heavy")
    found = sketch(df, column, scratch)
    least = found.total * share
    # what the sketch can't rule out: a value that holds less than its bound can't be frequent
    open_buckets = [at for at, n in found.fell.items() if n >= least]
    candidates = found.cells.where((F.col("upper") >= least) & ~F.col("bucket").isin(open_buckets)).select("value")
    rows = df.select(F.col(column).cast("string").alias("value"))
    counted = rows.join(F.broadcast(candidates), "value").groupBy("value").agg(F.count("*").alias("n_rows"))
    if open_buckets:
        rest = rows.where(not_blank(F.col("value")) & _bucket(F.col("value")).isin(open_buckets))
        counted = counted.unionAll(rest.groupBy("value").agg(F.count("*").alias("n_rows")))
    return counted.where(F.col("n_rows") >= least)
