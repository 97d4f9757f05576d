"""Problem 2: records that are the same but for their spelling become one record with its number of copies.

Method: recursive radix partitioning on the canonical bytes. A bucket above the capacity is split by
further bytes (from the end of the prefix that all its keys share) until each bucket fits; then
each bucket is counted in a trie whose terminals hold the counters.

Plan
1. One Arrow pass writes the plain spelling and groups copies inside each batch, so a group that
   holds a third of all rows leaves a batch as one entry. The entries are written to shared storage.
2. The radix plan needs one small aggregate per round over the still oversized prefixes: at most
   ``entries / capacity`` of them, each with a branch per next byte.
3. Entries go to their bucket: one shuffle of distinct-per-batch keys. Entries with many ids send
   only their smallest one and get their members from the written table afterwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions.spelling import plain_spelling
from facetmill.sources.scratch import Scratch

#: Rows whose copies are grouped together before anything is shuffled.
BATCH_ROWS = 100_000
#: Entries that a bucket's trie counts at most, save where they are all of one key.
CAPACITY = 20_000
#: Prefixes that are sent to every executor at most; more are joined by a shuffle.
SENT = 100_000
#: An entry with more ids than this keeps them in the written table while it is counted.
CARRIED_IDS = 64


class Collapsed(NamedTuple):
    """records: rep_id, plain, copies. members: rep_id, id for every row that has a record."""

    records: DataFrame
    members: DataFrame


def entries(df: DataFrame, id_col: str, text_col: str, canonical: Callable[[str | None], str | None] = plain_spelling) -> DataFrame:
    """(plain, ids): the rows of one batch with the same plain spelling; rows without one are left out."""
    out = pa.schema([("plain", pa.string()), ("ids", pa.list_(pa.int64()))])

    def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if parts:
            grouped = pa.concat_tables(parts).group_by("plain", use_threads=False).aggregate([("id", "list")])
            yield from pa.table([grouped["plain"], grouped["id_list"]], schema=out).to_batches(10_000)

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            plain = pa.array(map(canonical, batch.column(1).to_pylist()), pa.string())
            t = pa.table({"plain": plain, "id": batch.column(0)})
            parts.append(t.filter(t["plain"].is_valid()))
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield from flush(parts)
                parts, rows = [], 0
        yield from flush(parts)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(run, "plain string, ids array<bigint>")


def radix_plan(keys: DataFrame, column: str, capacity: int | None = None) -> list[str]:
    """Sorted lower bounds of radix buckets over ``column``: each holds at most ``capacity`` keys, or one key only.

    The driver sees bucket counts, not keys: per round at most ``keys / capacity`` oversized
    prefixes with one branch for each next byte. Buckets grow in number with the keys, never in size.
    """
    key = F.col(column)
    capacity = capacity or CAPACITY
    leaves: list[tuple[str, int]] = []
    wide = [("", 2)]
    while wide:
        spark = keys.sparkSession
        opened = spark.createDataFrame([(p, len(p), d) for p, d in wide], "prefix string, len int, depth int")
        if wide == [("", 2)]:
            cut = keys.select(key.alias("k"), F.substring(key, 1, 2).alias("p"))
        else:
            lengths = sorted({len(p) for p, _ in wide})
            cut = None
            for n in lengths:
                own = opened.where(F.col("len") == n)
                part = keys.join(F.broadcast(own) if len(wide) <= SENT else own, F.substring(key, 1, n) == F.col("prefix")).select(key.alias("k"), F.expr(f"substring({column}, 1, depth)").alias("p"))
                cut = part if cut is None else cut.unionAll(part)
        wide = []
        for p, n, low, high in cut.groupBy("p").agg(F.count("*"), F.min("k"), F.max("k")).collect():
            if n <= capacity or low == high:
                leaves.append((p, n))
            else:
                shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
                wide.append((low[:shared], shared + 1))
    bounds, held = [], 0
    for prefix, n in sorted(leaves):
        if not bounds or held + n > capacity:
            bounds.append(prefix)
            held = 0
        held += n
    return bounds


class CountingTrie:
    """A burst trie: inner nodes branch on the next bytes, leaves hold the rest of a key with its terminal counter."""

    STEP, BURST = 8, 512

    def __init__(self):
        self.root: list = [None, {}]  # children by next bytes or None, terminals by the rest of the key

    def terminal(self, key: str) -> list:
        node, at = self.root, 0
        while node[0] is not None:
            node = node[0].setdefault(key[at : at + self.STEP], [None, {}])
            at += self.STEP
        found = node[1].get(key[at:])
        if found is None:
            if len(node[1]) >= self.BURST and any(map(len, node[1])):
                self._burst(node)
                return self.terminal(key)
            found = node[1][key[at:]] = []
        return found

    def _burst(self, node: list) -> None:
        kids: dict[str, list] = {}
        for rest, held in node[1].items():
            kids.setdefault(rest[: self.STEP], [None, {}])[1][rest[self.STEP :]] = held
        node[0], node[1] = kids, {}

    def terminals(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            todo.extend((node[0] or {}).values())
            yield from node[1].values()


def count_buckets(found: DataFrame, bounds: list[str], partitions: int) -> DataFrame:
    """(rep_id, copies, entry_id, ids): every entry with the smallest id and the row count of its key over all entries."""

    def place(batches):
        for b in batches:
            where = [bisect_right(bounds, k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *b.columns], names=["bucket", *b.schema.names])

    def count(trie: CountingTrie) -> Iterator[tuple]:
        for held in trie.terminals():
            rep, copies = min(e[0] for e in held), sum(e[1] for e in held)
            for entry_id, _, ids in held:
                yield rep, copies, entry_id, ids

    def tries(batches):
        trie, at = CountingTrie(), None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def flush():
            rows = [*count(trie)]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), kinds)], names=["rep_id", "copies", "entry_id", "ids"])

        for b in batches:
            for bucket, key, entry_id, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != at:
                    yield from flush()
                    trie, at = CountingTrie(), bucket
                trie.terminal(key).append((entry_id, n, ids))
        yield from flush()

    sent = found.select("plain", F.array_min("ids").alias("entry_id"), F.size("ids").cast("long").alias("n"), F.when(F.size("ids") <= CARRIED_IDS, F.col("ids")).alias("ids"))
    placed = sent.mapInArrow(place, "bucket int, plain string, entry_id bigint, n bigint, ids array<bigint>")
    return placed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(tries, "rep_id bigint, copies bigint, entry_id bigint, ids array<bigint>")


def collapse(df: DataFrame, id_col: str, text_col: str, canonical: Callable[[str | None], str | None] = plain_spelling, capacity: int | None = None, least: int = 1) -> Collapsed:
    """Collapses rows whose ``text_col`` spells the same record, keeping groups of at least ``least`` rows.

    Ids are unique; a row delivered again under its id only counts as one more copy. Null ids, and null, blank or mark-only texts, belong to no record. Other columns are never touched, so their names can't clash. An empty table gives no record.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "collapse")
    found = scratch.write(entries(df, id_col, text_col, canonical), "entries")
    bounds = radix_plan(found, "plain", capacity)
    counted = count_buckets(found, bounds, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = scratch.write(counted.where(F.col("copies") >= least), "counted")
    big = found.where(F.size("ids") > CARRIED_IDS).select(F.array_min("ids").alias("entry_id"), F.col("ids").alias("kept"))
    members = counted.where("ids is not null").select("rep_id", F.explode("ids").alias("id")).unionAll(
        counted.where("ids is null").select("rep_id", "entry_id").distinct().join(big, "entry_id").select("rep_id", F.explode("kept").alias("id"))
    )
    plain = found.select(F.array_min("ids").alias("rep_id"), "plain").dropDuplicates(["rep_id"])
    records = counted.where("entry_id = rep_id").select("rep_id", "copies").dropDuplicates(["rep_id"]).join(plain, "rep_id").select("rep_id", "plain", "copies")
    return Collapsed(records, members)
