"""Problem 4: records of the evaluation splits that also stand, exactly or almost, in the training split.

Method: content-defined chunks. Plain spellings are cut by a rolling hash, the digests of their chunks are joined
across splits, and what a pair shares of its chunks' lengths are the overlap fractions of its two records. Only pairs that
may share LEAST_SHARE of the longer record's length are looked for, so each record posts just its rarest chunks, up to that part
of its length which can't hold the rest: a pair within the bound always meets at one of them. A posting carries what
the record still has behind that chunk, its number of runs and 192 parity bits of its runs. A join keeps those
that can reach both the share and the Jaccard limit; the parity bound follows from the limit, so it loses
nothing. Records of few runs have few chunks, of which an edit breaks a larger part: up to FEW_RUNS runs they post all their chunks, and
up to FEWEST_RUNS their rarest runs as well, by the same rule with the limit itself as the share, which misses no pair.
The pairs left are compared exactly.

Above FEWEST_RUNS runs the share is measured, not proven: the least of all pairs is in the README. ``exact_candidates``
finds candidates without it, from the rarest runs of every record, at a cost that grows with train times evaluation rows.

Copies: rows of the same record are one class from the first Arrow batch on. Classes are compared,
and the result is expanded to rows at the end. Chunks that many records hold are salted.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions.spelling import plain_spelling
from facetmill.llm.chunks import cut_chunks
from facetmill.llm.collapse import BATCH_ROWS
from facetmill.llm.group_split import split_name
from facetmill.sources.scratch import Scratch

RUN = 6
LEAST_JACCARD = 0.7
#: Part of the longer record's chunk length that a near pair shares at least, and numbers of runs up to which all chunks, and runs, are posted.
LEAST_SHARE = 0.44
FEW_RUNS, FEWEST_RUNS = 72, 32
#: Bits that tell which chunks occur in train and which elsewhere, and parts in which they and the counters are merged.
SEEN = 1 << 25
SEGMENTS = 16
#: Longest chunk.
MOST = 32
#: Records whose chunks are cut at a time, pairs that are compared exactly at a time (what fits a cache), and records of train that meet one salted copy of an evaluation posting.
CUT = 5_000
COMPARED = 500
SALTED = 20_000
#: Classes that are sent to every executor at most; more are joined by a shuffle.
SENT = 250_000
#: Evaluation records that are indexed at a time by the exact search, and training records that are held against them at a time.
BLOCK = 65_536
PROBED = 500
#: Hashed counters that rank chunks or runs, and parity bits of a record.
COUNTERS = 1 << 18
PARITY = 256
POSTED_PARITY = 192


class Overlaps(NamedTuple):
    """links: class pairs with jaccard and both overlap fractions. members: ka, kb, train_ids, eval_ids of each batch's entries."""

    links: DataFrame
    members: DataFrame


def runs_of(text: str, n: int = RUN) -> set[str]:
    """All distinct runs of ``n`` characters; a shorter text is its own only run."""
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def classes(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train") -> DataFrame:
    """(ka, kb, plain, train_ids, eval_ids): the rows of one batch with the same plain spelling, by side."""
    out = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("plain", pa.string()), ("train_ids", pa.list_(pa.int64())), ("eval_ids", pa.list_(pa.int64()))])

    def flush(held: dict[str, tuple[list, list]]):
        rows = [*held.items()]
        for i in range(0, len(rows), 5_000):
            part = rows[i : i + 5_000]
            raw = np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=16).digest() for p, _ in part), np.int64).reshape(-1, 2)
            columns = [pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), pa.array([p for p, _ in part]), pa.array([t for _, (t, _) in part], out.field(3).type), pa.array([e for _, (_, e) in part], out.field(4).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        rows = 0
        for b in batches:
            for i, text, is_train in zip(*(c.to_pylist() for c in b.columns)):
                plain = plain_spelling(text)
                if plain is not None:
                    held.setdefault(plain, ([], []))[not is_train].append(i)
            rows += b.num_rows
            if rows >= BATCH_ROWS:
                yield from flush(held)
                held, rows = {}, 0
        yield from flush(held)

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (split_name(F.col(split_col)) == train).alias("t"))
    return picked.where("id is not null and t is not null").mapInArrow(run, "ka bigint, kb bigint, plain string, train_ids array<bigint>, eval_ids array<bigint>")


def coded_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, run) of all runs of plain spellings, seven bits a character; a shorter text is its own only run."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(t.ljust(RUN, "\0") for t in texts).encode("ascii"), np.uint8).astype(np.int64)
    two = (flat[:-1] << 7) | flat[1:]
    code = (((two[:-4] << 14) | two[2:-2]) << 14) | two[4:]
    many = np.maximum(size - RUN + 1, 1)
    text = np.repeat(np.arange(len(texts)), many)
    held = np.maximum(size, RUN)
    return text, code[np.arange(len(text)) + np.repeat(np.cumsum(held) - held - np.cumsum(many) + many, many)]


def _hashed(run: np.ndarray, parts: int) -> np.ndarray:
    return ((run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def run_ranks(found: DataFrame) -> np.ndarray:
    """The rank of each of COUNTERS counters of runs, rare ones first."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount(_hashed(coded_runs(b.column(0).to_pylist())[1], COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = found.select("plain").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    ranks = np.empty(COUNTERS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(COUNTERS)
    return ranks


class FirstRuns(NamedTuple):
    """Of each text the number of its distinct runs and its parity bits; of each of its first runs the text, the place and the run."""

    size: np.ndarray
    parity: np.ndarray
    text: np.ndarray
    place: np.ndarray
    run: np.ndarray


def first_runs(texts: list[str], ranks: np.ndarray, least: float) -> FirstRuns:
    """The rarest runs of each text, as many as any text that reaches ``least`` with it can miss, and one more."""
    text, run = coded_runs(texts)
    ranked = (ranks[_hashed(run, COUNTERS)] << (7 * RUN)) | run
    order = np.lexsort((ranked, text))
    text, ranked = text[order], ranked[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (ranked[1:] != ranked[:-1])
    text, ranked = text[fresh], ranked[fresh]
    size = np.bincount(text, minlength=len(texts))
    odd = np.bincount(text * PARITY + _hashed(ranked & ((1 << (7 * RUN)) - 1), PARITY), minlength=len(texts) * PARITY) & 1
    parity = np.packbits(odd.astype(np.uint8).reshape(-1, PARITY), axis=1).view(np.uint64)
    place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
    used = place <= size[text] - np.ceil(least * size - 1e-9).astype(np.int64)[text]
    return FirstRuns(size, parity, text[used], place[used], ranked[used])


class RunIndex(NamedTuple):
    """The first runs of a block of records: distinct runs, and postings by run and size of the record.

    room: what a record's own size leaves for the share of the other one, from the place of the run on.
    """

    keys: np.ndarray
    size: np.ndarray
    parity: np.ndarray
    runs: np.ndarray
    at: np.ndarray
    text: np.ndarray
    room: np.ndarray


def index_runs(keys: np.ndarray, texts: list[str], ranks: np.ndarray, least: float) -> RunIndex:
    parts = [first_runs(texts[i : i + 5_000], ranks, least) for i in range(0, len(texts), 5_000)]
    size, parity = np.concatenate([p.size for p in parts]), np.concatenate([p.parity for p in parts])
    text = np.concatenate([p.text + 5_000 * i for i, p in enumerate(parts)])
    place = np.concatenate([p.place for p in parts])
    runs, which = np.unique(np.concatenate([p.run for p in parts]), return_inverse=True)
    at = (which << 32) | size[text]
    order = np.argsort(at, kind="stable")
    room = size[text] * (1 - least / (1 + least)) - place
    return RunIndex(keys, size, parity, runs, at[order], text[order].astype(np.int32), room[order] + 1e-6)


def probe(index: RunIndex, texts: list[str], ranks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, indexed text), each pair once, of all that may reach ``least``."""
    f = first_runs(texts, ranks, least)
    part = least / (1 + least)
    run = np.minimum(np.searchsorted(index.runs, f.run), len(index.runs) - 1)
    hit = index.runs[run] == f.run
    text, place, run = f.text[hit], f.place[hit], run[hit]
    n = f.size[text]
    # the shared runs o = part * (n + m) fit into what follows the place, own place included: a bound on the size m
    low = np.ceil(least * n - 1e-9).astype(np.int64)
    high = np.floor((n - place) / part - n + 1e-6).astype(np.int64)
    start = np.searchsorted(index.at, (run << 32) | low, side="left")
    many = np.maximum(np.searchsorted(index.at, (run << 32) | np.maximum(high, 0), side="right") - start, 0)
    i = np.repeat(np.arange(len(text)), many)
    j = np.arange(len(i)) + np.repeat(start - np.cumsum(many) + many, many)
    fits = index.room[j] >= (part * n)[i]
    t, e = text[i[fits]], index.text[j[fits]]
    differ = np.bitwise_count(f.parity[t] ^ index.parity[e]).sum(1, dtype=np.int64)
    total = f.size[t] + index.size[e]
    near = differ <= total - 2 * part * total + 1e-6
    pairs = np.unique(t[near] * len(index.size) + e[near])
    return pairs // len(index.size), pairs % len(index.size)


def exact_candidates(found: DataFrame, scratch: Scratch, least: float, block: int = BLOCK) -> DataFrame:
    """(ta, ea): classes of train and of other splits that may reach ``least``, one block of the others at a time, by their first runs alone."""
    spark = found.sparkSession
    ranks = spark.sparkContext.broadcast(run_ranks(found))
    wanted = scratch.write(found.where(F.size("eval_ids") > 0).select("ka", "kb", "plain").dropDuplicates(["ka", "kb"]), "wanted")
    train = found.where(F.size("train_ids") > 0).select("ka", "plain")
    n = max(1, -(-wanted.count() // block))
    out = None
    for k in range(n):
        own = wanted.where(F.pmod(F.xxhash64("kb"), F.lit(n)) == k).select("ka", "plain").toPandas()
        if not len(own):
            continue
        held = spark.sparkContext.broadcast(index_runs(own["ka"].to_numpy(np.int64), own["plain"].tolist(), ranks.value, least))

        def run(batches, held=held):
            for b in batches:
                keys = b.column(0).to_numpy()
                for at in range(0, b.num_rows, PROBED):
                    t, e = probe(held.value, b.column(1).slice(at, PROBED).to_pylist(), ranks.value, least)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + PROBED][t]), pa.array(held.value.keys[e])], names=["ta", "ea"])

        part = train.mapInArrow(run, "ta bigint, ea bigint")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = found.selectExpr("ka as ta", "ka as ea").limit(0)
    return scratch.write(out.where("ta <> ea").distinct(), "candidates")


class Postings(NamedTuple):
    """What each text posts: text, digest, what is left of the weight from there on, and the weight a partner must share.

    runs, parity: of each text the number of distinct runs, and parity bits.
    """

    runs: np.ndarray
    parity: np.ndarray
    text: np.ndarray
    digest: np.ndarray
    room: np.ndarray
    need: np.ndarray


class Costs(NamedTuple):
    """What is known of all chunks: how many classes of train and of other splits fall into each counter, and which digests either has."""

    train: np.ndarray
    other: np.ndarray
    in_train: np.ndarray
    in_other: np.ndarray

    def price(self, digest: np.ndarray) -> np.ndarray:
        """Pairs that a chunk may make; 0 where one side lacks it."""
        at = _spot(digest, SEEN)
        both = (self.in_train[at >> 3] & self.in_other[at >> 3] & (np.uint8(1) << (at & 7).astype(np.uint8))) != 0
        at = _spot(digest, COUNTERS)
        return np.where(both, np.maximum(1, self.train[at] * self.other[at]), 0)


def _spot(digest: np.ndarray, parts: int) -> np.ndarray:
    return (digest.view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts


def weighed_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight, digest) of the distinct chunks of each text; then the texts with a chunk that comes again or has no end of its own."""
    owner, length, digest = cut_chunks([t.encode() for t in texts], most=MOST)
    order = np.lexsort((digest, owner))
    owner, length, digest = owner[order], length[order], digest[order].view(np.int64)
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])][: len(owner)]
    return owner[fresh], length[fresh], digest[fresh], owner[~fresh | (length >= MOST)]


def distinct_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, run) of the distinct runs of each text, in order."""
    text, run = coded_runs(texts)
    both = np.sort((text << (7 * RUN)) | run)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both >> (7 * RUN), both & ((1 << (7 * RUN)) - 1)


def weighed_runs(texts: list[str], again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight 1, digest) of the distinct runs of each text with at most FEWEST_RUNS, which is short or one of ``again``."""
    short = np.fromiter((len(t) < FEWEST_RUNS + RUN for t in texts), bool, len(texts))
    short[again] = True
    few = np.flatnonzero(short)
    text, run = distinct_runs([texts[i] for i in few])
    kept = np.bincount(text, minlength=len(few))[text] <= FEWEST_RUNS
    text, run = text[kept], run[kept]
    coded = (run.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return few[text], np.ones(len(text), np.int64), ((coded ^ (coded >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def posted(texts: list[str], costs: Costs, least: float, share: float = LEAST_SHARE) -> Postings:
    """The cheapest chunks of each text up to the weight that no partner needs, and the cheapest runs of the shortest texts, as far as both sides have them."""
    text, run = distinct_runs(texts)
    runs = np.bincount(text, minlength=len(texts))
    odd = np.bincount(text * POSTED_PARITY + _hashed(run, POSTED_PARITY), minlength=len(texts) * POSTED_PARITY) & 1
    parity = np.packbits(odd.astype(np.uint8).reshape(-1, POSTED_PARITY), axis=1).view(np.int64)
    out = []
    *chunks, again = weighed_chunks(texts)
    for (text, weight, digest), part in ((chunks, np.where(runs <= FEW_RUNS, 0.0, share)), (weighed_runs(texts, again), np.full(len(texts), least))):
        price = costs.price(digest)
        order = np.lexsort((digest, price, text))
        text, weight, digest, price = text[order], weight[order], digest[order], price[order]
        whole = np.bincount(text, weight, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(weight)
        own = np.bincount(text, minlength=len(texts))
        first = np.repeat((np.r_[0, ends])[np.cumsum(own) - own], own)
        room = whole[text] - (ends - weight - first)
        need = np.ceil(whole * part - 1e-9).astype(np.int64)[text]
        used = (room >= need) & (price > 0)
        out.append((text[used], digest[used], room[used], need[used]))
    return Postings(runs, parity, *(np.concatenate(c) for c in zip(*out)))


def posting_costs(found: DataFrame) -> Costs:
    """The costs of all chunks and runs. Each task packs its counters and bits into SEGMENTS rows; these are added up part by part, as they stream in."""
    kinds = ((np.uint32, COUNTERS), (np.uint32, COUNTERS), (np.uint8, SEEN // 8), (np.uint8, SEEN // 8))

    def parts(total: list[np.ndarray]):
        for k in range(SEGMENTS):
            yield k, [zlib.compress(t.reshape(SEGMENTS, -1)[k].tobytes(), 1) for t in total]

    def row(k: int, packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], names=["segment", "a", "b", "c", "d"])

    def count(batches):
        total = [np.zeros(n, kind) for kind, n in kinds]
        for b in batches:
            for i in range(0, b.num_rows, CUT):
                texts, *sides = (b.column(c).slice(i, CUT) for c in range(3))
                texts = texts.to_pylist()
                *chunks, again = weighed_chunks(texts)
                for text, _, digest in (chunks, weighed_runs(texts, again)):
                    for k, side in enumerate(sides if len(text) else ()):
                        own = digest[side.to_numpy(zero_copy_only=False)[text]]
                        total[k] += np.bincount(_spot(own, COUNTERS), minlength=COUNTERS).astype(np.uint32)
                        at = _spot(own, SEEN)
                        np.bitwise_or.at(total[2 + k], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k, packed in parts(total):
            yield row(k, packed)

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, *packed in zip(*(c.to_pylist() for c in b.columns)):
                own = [np.frombuffer(zlib.decompress(p), kind) for p, (kind, _) in zip(packed, kinds)]
                if k not in held:
                    held[k] = [x.copy() for x in own]
                else:
                    for n, (x, y) in enumerate(zip(held[k], own)):
                        x += y if n < 2 else 0
                        x |= y if n >= 2 else 0
        for k, own in held.items():
            yield row(k, [zlib.compress(x.tobytes(), 1) for x in own])

    schema = "segment int, a binary, b binary, c binary, d binary"
    sides = found.select("plain", (F.size("train_ids") > 0).alias("t"), (F.size("eval_ids") > 0).alias("e"))
    merged = sides.mapInArrow(count, schema).repartition(SEGMENTS, "segment").mapInArrow(merge, schema).collect()
    out = [np.zeros(n, kind) for kind, n in kinds]
    for r in merged:
        for x, p, (kind, _) in zip(out, r[1:], kinds):
            x.reshape(SEGMENTS, -1)[r[0]] = np.frombuffer(zlib.decompress(p), kind)
    return Costs(out[0].astype(np.int64), out[1].astype(np.int64), out[2], out[3])


def candidates(found: DataFrame, scratch: Scratch, least: float, share: float = LEAST_SHARE, salted: int = SALTED) -> DataFrame:
    """(ta, ea): classes of train and of other splits that share posted chunks and may reach ``share`` and ``least``.

    All that the driver sees are counters and bits of fixed number. A posting that many classes of train hold is spread over salts:
    each of its evaluation postings is copied to all of them.
    """
    held = found.sparkSession.sparkContext.broadcast(posting_costs(found))
    names = ["digest", "salt", "key", "p0", "p1", "p2", "sizes"]

    def side(train: bool) -> DataFrame:
        def run(batches):
            costs = held.value
            salts = np.maximum(1, -(-costs.train // salted))
            dice = np.random.default_rng(0)
            for b in batches:
                keys = b.column(0).to_numpy()
                for i in range(0, b.num_rows, CUT):
                    p = posted(b.column(1).slice(i, CUT).to_pylist(), costs, least, share)
                    many = salts[_spot(p.digest, COUNTERS)]
                    if train:
                        at, salt = np.arange(len(many)), dice.integers(0, many)
                    else:
                        at = np.repeat(np.arange(len(many)), many)
                        salt = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    text, most = p.text[at], (1 << 21) - 1
                    # a size above 21 bits counts as that: the bounds only get looser
                    sizes = np.minimum(p.room[at], most) << 42 | np.minimum(p.need[at], most) << 21 | np.minimum(p.runs[text], most)
                    columns = [p.digest[at], salt.astype(np.int32), keys[i + text], *p.parity[text].T.copy(), sizes]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        rows = found.where(F.size("train_ids" if train else "eval_ids") > 0).select("ka", "plain")
        return rows.mapInArrow(run, "digest bigint, salt int, key bigint, p0 bigint, p1 bigint, p2 bigint, sizes bigint")

    t, e = side(True).alias("t"), side(False).alias("e")
    size = lambda x, shift: F.shiftright(f"{x}.sizes", shift).bitwiseAND(F.lit((1 << 21) - 1))
    few, many = F.least(size("t", 0), size("e", 0)), F.greatest(size("t", 0), size("e", 0))
    p0, p1, p2 = (F.bit_count(F.col(f"t.p{i}").bitwiseXOR(F.col(f"e.p{i}"))) for i in range(3))
    differ = p0 + p1 + p2
    may = (
        (F.col("t.digest") == F.col("e.digest")) & (F.col("t.salt") == F.col("e.salt")) & (F.col("t.key") != F.col("e.key"))
        & (F.least(size("t", 42), size("e", 42)) >= F.greatest(size("t", 21), size("e", 21))) & (few >= many * least - 1e-6)
        & (differ <= (few + many) * (1 - 2 * least / (1 + least)) + 1e-6)
    )
    return scratch.write(t.join(e, may).select(F.col("t.key").alias("ta"), F.col("e.key").alias("ea")).distinct(), "candidates")


def shared_runs(texts: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the number of distinct runs in both, and of those in either."""
    n = len(texts)
    text, run = coded_runs(texts + others)
    coded = np.sort(((text % n) << (7 * RUN + 1)) | (run << 1) | (text >= n)) if n else np.empty(0, np.int64)
    coded = coded[np.r_[True, coded[1:] != coded[:-1]]] if n else coded
    same = coded[1:] >> 1 == coded[:-1] >> 1
    shared = np.bincount(coded[1:][same] >> (7 * RUN + 1), minlength=n)
    return shared, np.bincount(coded >> (7 * RUN + 1), minlength=n) - shared


def verify(pairs: DataFrame, least: float) -> DataFrame:
    """Keeps the pairs (.., plain_t, plain_e) of which at least ``least`` of all distinct runs are shared; adds jaccard and overlaps."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, COMPARED):
                b = batch.slice(first, COMPARED)
                p, q = b.column("plain_t").to_pylist(), b.column("plain_e").to_pylist()
                both, either = shared_runs(p, q)
                at = np.flatnonzero(both >= least * either - 1e-9)
                at = at[[p[i] != q[i] for i in at]] if len(at) else at
                of_t, of_e = [], []
                for i in at:
                    text, length, digest = cut_chunks([p[i].encode(), q[i].encode()], most=MOST)
                    a, c = (dict(zip(digest[text == s].tolist(), length[text == s].tolist())) for s in (0, 1))
                    shared = sum(n for d, n in a.items() if d in c)
                    of_t.append(shared / sum(a.values()))
                    of_e.append(shared / sum(c.values()))
                rows = b.select(["ta", "tb", "ea", "eb"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((both / either)[at], pa.float64()), pa.array(of_t, pa.float64()), pa.array(of_e, pa.float64())], names=[*rows.schema.names, "jaccard", "overlap_t", "overlap_e"])

    return pairs.mapInArrow(run, "ta bigint, tb bigint, ea bigint, eb bigint, jaccard double, overlap_t double, overlap_e double")


def overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", least: float = LEAST_JACCARD, share: float = LEAST_SHARE, exact: bool = False) -> Overlaps:
    """Links between record classes with rows in ``train`` and classes with rows in another split.

    Rows with a null id, a null split, or a null, blank or mark-only text take no part. A class with rows on both
    sides links to itself at jaccard 1. Records shorter than a run have one run, themselves. An
    empty table gives no link; other columns are never touched. ``exact`` looks for candidates without ``share``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "overlap")
    found = scratch.write(classes(df, id_col, text_col, split_col, train), "classes")
    near = exact_candidates(found, scratch, least) if exact else candidates(found, scratch, least, share)
    n = near.count()
    scratch.tidy()

    def side(name: str) -> DataFrame:
        rows = found.where(F.size(f"{name}_ids") > 0)
        ids = near.select(F.col(f"{name[0]}a").alias("ka")).distinct()
        rows = rows.join(F.broadcast(ids) if n <= SENT else ids, "ka", "left_semi")
        return rows.select(F.col("ka").alias(f"{name[0]}a"), F.col("kb").alias(f"{name[0]}b"), F.col("plain").alias(f"plain_{name[0]}")).dropDuplicates([f"{name[0]}a", f"{name[0]}b"])

    pairs = near.join(side("eval"), "ea").join(side("train"), "ta").select("ta", "tb", "ea", "eb", "plain_t", "plain_e")
    links = scratch.write(verify(pairs, least), "links")
    members = found.select("ka", "kb", "train_ids", "eval_ids")
    return Overlaps(links, members)


def _rows(found: Overlaps, side: str) -> DataFrame:
    """(ka, kb, ids): the entries of classes with rows on that side."""
    return found.members.where(F.size(f"{side}_ids") > 0).select("ka", "kb", F.col(f"{side}_ids").alias(f"{side}_ids"))


def row_pairs(found: Overlaps) -> DataFrame:
    """(row_id_a, row_id_b, jaccard, train_id, eval_id) with row_id_a < row_id_b for each train row and each other row that link."""
    t, e = _rows(found, "train"), _rows(found, "eval")
    same = t.join(e, ["ka", "kb"]).select("train_ids", "eval_ids", F.lit(1.0).alias("jaccard"))
    of_t = t.withColumnsRenamed({"ka": "ta", "kb": "tb"})
    of_e = e.withColumnsRenamed({"ka": "ea", "kb": "eb"})
    near = found.links.join(of_e, ["ea", "eb"]).join(of_t, ["ta", "tb"]).select("train_ids", "eval_ids", "jaccard")
    both = same.unionAll(near).withColumn("train_id", F.explode("train_ids")).withColumn("eval_id", F.explode("eval_ids")).where("train_id <> eval_id")
    return both.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"), "jaccard", "train_id", "eval_id").dropDuplicates(["train_id", "eval_id"])


def linked_classes(found: Overlaps) -> DataFrame:
    """(id, class_id, is_train, n_links): each row of a class with links, its class' smallest row, and how many classes of the other side it links to.

    A class with rows on both sides counts itself. Copies are not paired.
    """
    entries = found.members.select("ka", "kb", F.array_min(F.concat("train_ids", "eval_ids")).alias("low"), (F.size("train_ids") > 0).alias("t"), (F.size("eval_ids") > 0).alias("e"))
    classes_ = entries.groupBy("ka", "kb").agg(F.min("low").alias("class_id"), F.max("t").alias("t"), F.max("e").alias("e"))
    ends = found.links.select(F.col("ta").alias("ka"), F.col("tb").alias("kb"), F.lit(True).alias("is_train")).unionAll(found.links.select(F.col("ea").alias("ka"), F.col("eb").alias("kb"), F.lit(False).alias("is_train")))
    own = classes_.where("t and e").select("ka", "kb", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_train"))
    degree = ends.unionAll(own).groupBy("ka", "kb", "is_train").agg(F.count("*").alias("n_links"))
    rows = found.members.select("ka", "kb", F.explode(F.array(F.struct(F.lit(True).alias("is_train"), F.col("train_ids").alias("ids")), F.struct(F.lit(False).alias("is_train"), F.col("eval_ids").alias("ids")))).alias("x")).where(F.size("x.ids") > 0)
    linked = rows.select("ka", "kb", "x.is_train", "x.ids").join(degree, ["ka", "kb", "is_train"]).join(classes_.select("ka", "kb", "class_id"), ["ka", "kb"])
    return linked.select(F.explode("ids").alias("id"), "class_id", "is_train", "n_links").distinct()


def report(df: DataFrame, found: Overlaps, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """(split, source, n_rows, n_exact, n_near): evaluation rows, those with the same record in train, and those with only a near one."""
    exact = _rows(found, "train").select("ka", "kb").distinct().withColumn("exact", F.lit(True))
    near = found.links.select(F.col("ea").alias("ka"), F.col("eb").alias("kb")).distinct().withColumn("near", F.lit(True))
    e = _rows(found, "eval").join(exact, ["ka", "kb"], "left").join(near, ["ka", "kb"], "left")
    hit = e.where("exact or near").withColumn("id", F.explode("eval_ids")).groupBy("id").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), split_name(F.col(split_col)).alias("split"), F.lower(F.trim(F.col(source_col))).alias("source")).where("split <> 'train'")
    return rows.join(hit, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce("exact", F.lit(False))).alias("n_exact"), F.count_if(F.coalesce("near", F.lit(False)) & ~F.coalesce("exact", F.lit(False))).alias("n_near")
    )
