"""Problem 5: train, validation and test splits in which all rows that are tied get the same split.

Method: an incremental component table that is kept on storage, with pointer jumping for merges.
Rows tie through keys (a plain spelling, a scaffold, a lot). The table has one row for each key with its component, one for
each tied row, and one for each component with its split; ``save`` writes it as a new generation under a path and
``open_state`` reads the last whole one, in any later session. A new batch is linked
through that table: components that have a split keep it, components without one fill what the
splits lack, and a batch that would merge components of different splits has its rows quarantined.
``present_table`` makes the table of rows that have splits already; ties which these break stand in it as quarantined components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.functions.spelling import plain_spelling
from facetmill.llm.collapse import BATCH_ROWS, CARRIED_IDS
from facetmill.operators.components import connected_components
from facetmill.sources.scratch import Scratch

#: Words that stand for a missing value, compared without padding and case.
MISSING = frozenset(("", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "unknown", "missing", "not available", "undefined", "unspecified", "tbd", "-", "--", "?"))
#: Hash buckets over which new components are dealt out; shares are met to about one bucket.
DEAL_BUCKETS = 4096
#: Components above this share of all rows are placed one by one, largest first: at most 1 / LARGE of them.
LARGE = 1 / 1024


#: Split of components whose rows lie in different splits, and of rows that would join such ones.
QUARANTINE = "quarantine"


class State(NamedTuple):
    """keys: ka, kb, component. components: component, split, n. members: id, component of tied rows, quarantined batches left out.

    A component is named by its smallest row id; a row that nothing ties is a component of its own and no member.
    """

    keys: DataFrame
    components: DataFrame
    members: DataFrame


def _generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the generations under ``path`` whose last table is whole."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{State._fields[-1]}/_SUCCESS")))


def save(state: State, path: str) -> State:
    """Writes the table as the next generation under ``path``, in a folder that all executors share, and returns it as read from there."""
    spark = state.keys.sparkSession
    n = max(_generations(spark, path), default=-1) + 1
    for name, df in state._asdict().items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{n}/{name}")
    return open_state(spark, path)


def open_state(spark: SparkSession, path: str) -> State | None:
    """The last whole generation under ``path``; None where there is none."""
    found = _generations(spark, path)
    return State(*(spark.read.parquet(f"{path}/{found[-1]}/{name}") for name in State._fields)) if found else None


def split_name(c: Column) -> Column:
    """A split without padding and case; empty stands for test, null stays null."""
    x = F.lower(F.regexp_replace(c, r"^[\s\x{a0}\x{200b}\x{feff}]+|[\s\x{a0}\x{200b}\x{feff}]+$", ""))
    return F.when(x == "", "test").otherwise(x)


def _token(value: str | None) -> str | None:
    value = value.strip().strip("\u200b\ufeff").strip().lower() if value else ""
    return None if value in MISSING else value


def tie_entries(df: DataFrame, id_col: str, spelled: list[str], named: list[str]) -> DataFrame:
    """(ka, kb, ids): for each batch, the ids behind each 128-bit key of a spelled or named column."""
    schema = "ka bigint, kb bigint, ids array<bigint>"
    kinds = [(i, plain_spelling) for i in range(1, 1 + len(spelled))] + [(i, _token) for i in range(1 + len(spelled), 1 + len(spelled) + len(named))]

    def digest(tag: str, value: str) -> bytes:
        return hashlib.blake2b(f"{tag}\x00{value}".encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def flush(keys: list[bytes], ids: list[int]):
        held: dict[bytes, list[int]] = {}
        for k, i in zip(keys, ids):
            held.setdefault(k, []).append(i)
        halves = [(int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True), v) for k, v in held.items()]
        for at in range(0, len(halves), 10_000):
            a, b, v = zip(*halves[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.list_(pa.int64()))], names=["ka", "kb", "ids"])

    def run(batches):
        keys: list[bytes] = []
        ids: list[int] = []
        rows = 0
        for b in batches:
            own = b.column(0).to_pylist()
            for at, clean in kinds:
                for i, v in zip(own, b.column(at).to_pylist()):
                    v = clean(v)
                    if v is not None:
                        keys.append(digest(str(at), v))
                        ids.append(i)
            rows += len(own)
            if rows >= BATCH_ROWS:
                yield from flush(keys, ids)
                keys, ids, rows = [], [], 0
        yield from flush(keys, ids)

    picked = [F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*spelled, *named]))]
    return df.select(*picked).where("id is not null").mapInArrow(run, schema)


def link(df: DataFrame, id_col: str, spelled: list[str], named: list[str], scratch: Scratch, state: State | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges u, v) between ids tied by a key, and (ka, kb, hub) with the smallest id behind each key.

    A key that many rows share comes as one entry per batch, so the window over a key runs over
    entries, row after row, without holding them.
    """
    found = scratch.write(tie_entries(df, id_col, spelled, named), "ties")
    sent = found.select("ka", "kb", F.array_min("ids").alias("entry_id"), F.when(F.size("ids") <= CARRIED_IDS, F.col("ids")).alias("ids"))
    if state:
        known = state.keys.select("ka", "kb", F.col("component").alias("entry_id"))
        sent = sent.unionByName(known.withColumn("ids", F.array("entry_id")))
    over = Window.partitionBy("ka", "kb").orderBy("entry_id")
    hubs = sent.withColumn("hub", F.first("entry_id").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(over))
    hubs = scratch.write(hubs, "hubs")
    carried = hubs.select(F.explode(F.coalesce("ids", F.array("entry_id"))).alias("u"), F.col("hub").alias("v"))
    stars = found.where(F.size("ids") > CARRIED_IDS).select(F.explode("ids").alias("u"), F.array_min("ids").alias("v"))
    return carried.unionAll(stars).where("u <> v"), hubs.where("nth = 1").select("ka", "kb", "hub")


def _named(hubs: DataFrame, roots: DataFrame) -> DataFrame:
    """(ka, kb, component) of each key."""
    return hubs.join(roots, F.col("hub") == F.col("node"), "left").select("ka", "kb", F.coalesce("root", "hub").alias("component"))


def present_table(df: DataFrame, id_col: str, split_col: str, spelled: list[str], named: list[str], path: str | None = None, alone: bool = True) -> State:
    """The component table, saved under ``path``, of rows that have splits.

    A component's split is that of its rows, ``quarantine`` where they lie in more than one, null where none has any. Without ``alone``
    rows that nothing ties are no components. Nulls, blanks and words for "missing" tie nothing, rows with a
    null id are left out, repeated ids are one row with all their splits.
    """
    scratch = Scratch(df.sparkSession, "components")
    edges, hubs = link(df, id_col, spelled, named, scratch)
    roots = scratch.write(connected_components(edges, scratch=scratch), "roots")
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("component"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), split_name(F.col(split_col)).alias("split")).where("id is not null")
    rows = rows.join(members, "id", "left" if alone else "inner").select("id", F.coalesce("component", "id").alias("component"), "split")
    split = F.when(F.min("split") == F.max("split"), F.min("split")).when(F.min("split").isNotNull(), QUARANTINE)
    components = rows.groupBy("component").agg(split.alias("split"), F.count("*").alias("n"))
    return save(State(_named(hubs, roots), components, members), path or f"{scratch.root}/table")


def broken_ties(df: DataFrame, id_col: str, split_col: str, spelled: list[str], named: list[str], path: str | None = None) -> DataFrame:
    """(group_row_id, row_id): every row of each tied group that lies in more than one split, from the component table; a null split is none."""
    state = present_table(df, id_col, split_col, spelled, named, path, alone=False)
    torn = state.components.where(F.col("split") == QUARANTINE).select("component")
    return state.members.join(torn, "component").select(F.col("component").alias("group_row_id"), F.col("id").alias("row_id"))


def _deal(spark: SparkSession, fresh: DataFrame, held: Mapping[str, int], shares: Mapping[str, float], seed: int, total: int) -> Column:
    """The split of a new component, as an expression over component, n and bucket.

    Large components go, largest first, to the split that lacks most; the rest are cut at hash
    buckets so that each split gets what it then lacks. The driver sees at most 1 / LARGE
    components and DEAL_BUCKETS sums.
    """
    whole = sum(shares.values())
    lack = {s: total * share / whole - held.get(s, 0) for s, share in shares.items()}
    large: dict[int, str] = {}
    bound = max(1, int(total * LARGE))
    for r in fresh.where(F.col("n") > bound).select("component", "n").orderBy(F.desc("n"), "component").limit(int(1 / LARGE) + 1).collect():
        large[r.component] = max(lack, key=lambda s: (lack[s], s))
        lack[large[r.component]] -= r.n
    mass = dict(fresh.where(F.col("n") <= bound).groupBy("bucket").agg(F.sum("n")).collect())
    left = sum(mass.values())
    want = {s: max(0.0, v) for s, v in lack.items()}
    scale = left / (sum(want.values()) or 1)
    ends, done, names = [], 0.0, list(shares)
    for s in names[:-1]:
        done += want[s] * scale
        run, cut = 0, 0
        for b in range(DEAL_BUCKETS):
            if run + mass.get(b, 0) / 2 > done:
                break
            run, cut = run + mass.get(b, 0), b + 1
        ends.append((s, cut))
    by_bucket = F.lit(names[-1])
    for s, cut in reversed(ends):
        by_bucket = F.when(F.col("bucket") < cut, s).otherwise(by_bucket)
    if not large:
        return by_bucket
    table = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))
    return F.when(F.col("n") > bound, F.element_at(table, F.col("component"))).otherwise(by_bucket)


def assign_splits(df: DataFrame, id_col: str, spelled: list[str], named: list[str], shares: Mapping[str, float], seed: int = 17, state: State | None = None) -> tuple[DataFrame, State]:
    """(row_id, group_row_id, split, outcome) of each row, and the state for the next batch.

    outcome: kept (the split of an existing component), filled (a new one) or quarantined. split is one of ``shares`` or ``quarantine``, for rows whose group would join components of
    different splits; those components keep their split and the rows are not added to them. Rows
    that nothing ties are groups of their own. Null ids are left out; an empty batch changes
    nothing. Shares need not sum to one.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "splits")
    edges, hubs = link(df, id_col, spelled, named, scratch, state)
    roots = scratch.write(connected_components(edges, scratch=scratch), "roots")
    own = df.select(F.col(id_col).cast("long").alias("node")).where("node is not null").distinct()
    rows = scratch.write(own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "rows")
    sizes = rows.groupBy(F.col("root").alias("component")).agg(F.count("*").alias("n"))
    if state:
        old = state.components.select(F.col("component").alias("node"), F.col("split").alias("old"), F.col("n").alias("m"))
        old = old.join(roots, "node", "left").select(F.coalesce("root", "node").alias("component"), "node", "old", "m")
        merged = old.groupBy("component").agg(F.min("old").alias("old"), F.max("old").alias("other"), F.sum("m").alias("m"))
    else:
        merged = sizes.select("component", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("m")).limit(0)
    both = sizes.join(merged, "component", "full").select("component", F.coalesce("n", F.lit(0)).alias("n"), "old", "other", F.coalesce("m", F.lit(0)).alias("m"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(DEAL_BUCKETS))
    both = scratch.write(both.withColumn("bucket", bucket), "sizes")
    both = both.withColumn("n", F.when(F.col("old").isNull(), F.col("n") + F.col("m")).otherwise(F.col("n")))
    held = {r.old: int(r.n) for r in both.where("old = other").groupBy("old").agg(F.sum(F.col("n") + F.col("m")).alias("n")).collect()}
    total = sum(held.values()) + int(both.where("old is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    fresh = both.where("old is null")
    split = F.when(F.col("old") != F.col("other"), QUARANTINE).when(F.col("old").isNotNull(), F.col("old")).otherwise(_deal(spark, fresh, held, shares, seed, total))
    decided = scratch.write(both.select("component", split.alias("split"), F.when(split == QUARANTINE, "quarantined").when(F.col("old").isNotNull(), "kept").otherwise("filled").alias("outcome"), (F.col("n") + F.when(F.col("old").isNotNull(), F.col("m")).otherwise(0)).alias("n"), (F.col("old").isNotNull() & (F.col("old") != F.col("other"))).alias("torn")), "decided")
    out = rows.join(decided, F.col("root") == F.col("component")).select(F.col("node").alias("row_id"), F.col("root").alias("group_row_id"), "split", "outcome")

    kept = _named(hubs, roots).join(decided.where("not torn").select("component"), "component", "left_semi").select("ka", "kb", "component")
    components = decided.where("not torn").select("component", "split", "n")
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("component")).join(decided.where("not torn").select("component"), "component", "left_semi").select("id", "component")
    if state:
        torn = old.join(decided.where("torn").select("component"), "component", "left_semi").select(F.col("node").alias("component"), F.col("old").alias("split"), F.col("m").alias("n"))
        components = components.unionAll(torn)
        kept = kept.unionAll(state.keys.join(torn.select("component"), "component", "left_semi").select("ka", "kb", "component"))
        # members of a component that was merged follow it to its new name; those of one that would be torn stay
        moved = roots.join(decided.where("not torn").select(F.col("component").alias("root")), "root", "left_semi").select(F.col("node").alias("component"), "root")
        before = state.members.join(moved, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        members = members.unionAll(before).distinct()
    return out, State(scratch.write(kept, "state-keys"), scratch.write(components, "state-components"), scratch.write(members, "state-members"))
