"""Problem 8: documents that hold passages of evaluation items, and which items leaked.

Method: SimHash fingerprints of windows of the passage length, of items and of documents, find what is
whole or nearly so. Item fingerprints are indexed by RADIUS + 1 blocks of bits: two fingerprints within
the radius agree in one block at least, so the index finds every window within it. But a window with
one other word is mostly further away, so the near search does not rest on them: two windows alike to any
degree share a five-word shingle, and an index of the items' shingles gives, for each pair of windows
that share some, a bound on their similarity. Candidates of both are verified by the exact weighted
similarity of the windows' five-word shingles, rarer shingles weighing more.

Equal windows have equal fingerprints, so a passage of WORDS words in a row is always found. The
items are the stated query set: they are indexed in blocks of BLOCK_ITEMS, and every document is
scanned once per block, where it lies, without a shuffle. Texts are read whole, in stretches of
words that overlap by a window.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
SHINGLE = 5
LEAST = 0.8
RADIUS = 2
#: Items that are indexed at a time.
BLOCK_ITEMS = 20_000
#: Low bits of a block in the table that tells which blocks occur at all.
FILTER_BITS = 20
#: Words whose windows are fingerprinted at a time.
STRETCH = 60_000
#: Pairs of windows that are bounded at a time.
PAIRS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


class Index(NamedTuple):
    """Item windows: fingerprints, their items and words, sorted blocks, and the weight of each shingle.

    codes, code_weights: the items' shingles, sorted, and their weights. begins, holders: of the n-th shingle the item windows that
    hold it are holders[begins[n] : begins[n + 1]]. totals: the weight of all shingles of a window.
    """

    prints: np.ndarray
    items: np.ndarray
    words: list[tuple[str, ...]]
    present: list[np.ndarray]
    sorted: list[np.ndarray]
    orders: list[np.ndarray]
    weights: dict[tuple[str, ...], float]
    most: float
    codes: np.ndarray
    code_weights: np.ndarray
    begins: np.ndarray
    holders: np.ndarray
    totals: np.ndarray


#: ASCII characters that are no letters or digits become blanks, capitals small letters.
_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(128)


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters or digits, without case."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN).decode().split()
    return _WORD.findall(text.lower())


def _signs(word: str, kind: type) -> np.ndarray:
    raw = np.frombuffer(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint8)
    return np.unpackbits(raw).astype(kind) * 2 - 1


class Signs:
    """The +1 and -1 of each word's hash bits, kept for words seen before.

    Eight bits hold the sum of a window below 128 words.
    """

    def __init__(self, size: int):
        self.kind = np.int8 if size < 128 else np.int32
        self.at: dict[str, int] = {}
        self.rows = np.empty((1024, 64), self.kind)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.at) > 500_000:
            self.at.clear()
        coded = pa.array(words, pa.string()).dictionary_encode()
        spots = np.empty(len(coded.dictionary), np.int64)
        for i, w in enumerate(coded.dictionary.to_pylist()):
            k = self.at.get(w)
            if k is None:
                k = self.at[w] = len(self.at)
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[k] = _signs(w, self.kind)
            spots[i] = k
        return self.rows[spots[coded.indices.to_numpy()]]


def window_prints(signs: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words, adding stretches of 1, 2, 4 and so on words."""
    n = len(signs) - size + 1
    total, at, part, width = np.zeros((n, signs.shape[1]), signs.dtype), 0, signs, 1
    while width <= size:
        if size & width:
            total += part[at : at + n]
            at += width
        part, width = part[:-width] + part[width:], 2 * width
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def shingle_codes(signs: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit code of every run of ``shingle`` words."""
    n = max(0, len(signs) - shingle + 1)
    words = np.packbits(signs > 0, axis=1).view(np.uint64).ravel()
    code = np.zeros(n, np.uint64)
    for i in range(shingle):
        code = (code ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    width = 64 // (radius + 1)
    return [((prints >> np.uint64(i * width)) & np.uint64((1 << width) - 1)).astype(np.int64) for i in range(radius + 1)]


def build_index(items: list[tuple[int, str]], size: int, shingle: int, radius: int) -> Index:
    """Indexes every window of every item; items with fewer than ``size`` words have none."""
    signs = Signs(size)
    prints, owners, windows = [], [], []
    holders: Counter = Counter()
    for item, text in items:
        words = words_of(text)
        holders.update({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)})
        if len(words) >= size:
            prints.append(window_prints(signs.of(words), size))
            owners += [item] * len(prints[-1])
            windows += [tuple(words[i : i + size]) for i in range(len(prints[-1]))]
    flat = np.concatenate(prints) if prints else np.empty(0, np.uint64)
    present, ordered, orders = [], [], []
    for block in _blocks(flat, radius):
        orders.append(np.argsort(block, kind="stable"))
        ordered.append(block[orders[-1]])
        present.append(np.zeros(1 << FILTER_BITS, bool))
        present[-1][block & ((1 << FILTER_BITS) - 1)] = True
    weights = {s: 1 + math.log(len(items) / n) for s, n in holders.items()}
    names = [*weights]
    coded = [shingle_codes(signs.of([w for s in names[i : i + 5_000] for w in s]), shingle)[::shingle] for i in range(0, len(names), 5_000)]
    # two shingles with one code are one: the heavier weight keeps the bound a bound
    codes, which = np.unique(np.concatenate(coded) if coded else np.empty(0, np.uint64), return_inverse=True)
    code_weights = np.zeros(len(codes))
    np.maximum.at(code_weights, which, np.array([weights[s] for s in names], float))
    number = dict(zip(names, which.tolist()))
    totals, shared, holding = np.zeros(len(windows)), array("i"), array("i")
    for k, w in enumerate(windows):
        own = {w[i : i + shingle] for i in range(size - shingle + 1)}
        totals[k] = sum(weights[s] for s in own)
        shared.extend(number[s] for s in own)
        holding.extend([k] * len(own))
    order = np.argsort(np.array(shared), kind="stable")
    begins = np.searchsorted(np.array(shared)[order], np.arange(len(codes) + 1))
    return Index(flat, np.array(owners, np.int64), windows, present, ordered, orders, weights, 1 + math.log(max(1, len(items))), codes, code_weights, begins, np.array(holding)[order], totals)


def shingle_similarity(a: tuple[str, ...], b: tuple[str, ...], shingle: int, weights: dict[tuple[str, ...], float], most: float) -> float:
    """Weight of the shingles in both windows over the weight of those in either; unknown shingles weigh most."""
    if a == b:
        return 1.0
    x, y = ({w[i : i + shingle] for i in range(len(w) - shingle + 1)} for w in (a, b))
    total = sum(weights.get(s, most) for s in x | y)
    return sum(weights.get(s, most) for s in x & y) / total if total else 0.0


def _candidates(prints: np.ndarray, index: Index, radius: int) -> np.ndarray:
    """(window, item window) within the radius, each once."""
    found = []
    for block, present, ordered, order in zip(_blocks(prints, radius), index.present, index.sorted, index.orders):
        hit = np.flatnonzero(present[block & ((1 << FILTER_BITS) - 1)])
        low = np.searchsorted(ordered, block[hit], side="left")
        many = np.searchsorted(ordered, block[hit], side="right") - low
        total = int(many.sum())
        if total:
            i = np.repeat(hit, many)
            j = order[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
            near = np.bitwise_count(prints[i] ^ index.prints[j]) <= radius
            found.append(np.stack([i[near], j[near]]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)


def _sharing(signs: np.ndarray, index: Index, size: int, shingle: int, least: float) -> np.ndarray:
    """(window, item window), each once, of all pairs whose shared shingles may reach ``least`` of the item window's weight."""
    codes = shingle_codes(signs, shingle)
    if size < shingle or not len(index.codes) or not len(codes):
        return np.empty((2, 0), np.int64)
    at = np.minimum(np.searchsorted(index.codes, codes), len(index.codes) - 1)
    hit = np.flatnonzero(index.codes[at] == codes)
    at = at[hit]
    width, n = size - shingle + 1, len(signs) - size + 1
    cost = np.cumsum(width * (index.begins[at + 1] - index.begins[at]))
    found = []

    def bound(first: int, last: int):
        """Pairs of the windows from ``first`` to before ``last``: halves while there are too many."""
        lo, hi = np.searchsorted(hit, (first, last + width - 1))
        if lo == hi:
            return
        if last - first > 1 and cost[hi - 1] - (cost[lo - 1] if lo else 0) > PAIRS:
            middle = (first + last) // 2
            bound(first, middle)
            bound(middle, last)
            return
        p, a = hit[lo:hi], at[lo:hi]
        many = index.begins[a + 1] - index.begins[a]
        k = index.holders[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.begins[a], many)]
        i = (np.repeat(p, many)[:, None] - np.arange(width)).ravel()
        k, w = np.repeat(k, width), np.repeat(np.repeat(index.code_weights[a], many), width)
        inside = (i >= first) & (i < last)
        pairs, which = np.unique(i[inside] * len(index.items) + k[inside], return_inverse=True)
        # a shingle that stands twice in a window counts twice here, which only lifts the bound
        shared = np.bincount(which, w[inside], len(pairs))
        i, k = pairs // len(index.items), pairs % len(index.items)
        near = shared >= least * index.totals[k] - 1e-6
        found.append(np.stack([i[near], k[near]]))

    if n > 0:
        bound(0, n)
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def leaked_windows(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, size: int = WORDS, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_equal): how many windows of the item a document holds nearly, and how many exactly.

    Windows whose weighted shingle similarity is at least ``least`` count. Null or empty texts and null ids take no part; items shorter
    than a window have none. A repeated document counts for itself. No items give no rows.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    n_blocks = max(1, math.ceil(wanted.count() / block_items))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    out = None
    for n in range(n_blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == n).collect()
        index = spark.sparkContext.broadcast(build_index(sorted({(r.item_id, r.text) for r in own}), size, shingle, radius))
        part = rows.mapInArrow(_scan(index, size, shingle, least, radius), "doc_id bigint, item_id bigint, n_windows bigint, n_equal bigint")
        out = part if out is None else out.unionAll(part)
    return out


def _scan(held, size: int, shingle: int, least: float, radius: int):
    def run(batches):
        index: Index = held.value
        signs = Signs(size)

        def flush(ids: list[int], words: list[str], begins: list[int]):
            """Counts of a stretch of words; windows over the end of a text are none."""
            found: dict[tuple[int, int], list[int]] = {}
            if len(words) >= size and len(index.prints):
                starts = np.array(begins)
                rows = signs.of(words)
                i, j = np.unique(np.concatenate([_candidates(window_prints(rows, size), index, radius), _sharing(rows, index, size, shingle, least)], axis=1), axis=1)
                text = np.searchsorted(starts, i, side="right") - 1
                within = i + size <= np.append(starts[1:], len(words))[text]
                for at, k, t in zip(i[within].tolist(), j[within].tolist(), text[within].tolist()):
                    window = tuple(words[at : at + size])
                    if shingle_similarity(window, index.words[k], shingle, index.weights, index.most) >= least:
                        n = found.setdefault((ids[t], int(index.items[k])), [0, 0])
                        n[0] += 1
                        n[1] += window == index.words[k]
            return found

        for b in batches:
            totals: Counter = Counter()
            equal: Counter = Counter()
            ids: list[int] = []
            begins: list[int] = []
            words: list[str] = []

            def done():
                for pair, (n, e) in flush(ids, words, begins).items():
                    totals[pair] += n
                    equal[pair] += e
                ids.clear(), begins.clear(), words.clear()

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = words_of(text)
                for at in range(0, max(1, len(own) - size + 1), STRETCH):
                    ids.append(doc)
                    begins.append(len(words))
                    words.extend(own[at : at + STRETCH + size - 1])
                    if len(words) >= STRETCH:
                        done()
            done()
            pairs = [*totals]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([totals[p] for p in pairs], pa.int64()), pa.array([equal[p] for p in pairs], pa.int64())],
                names=["doc_id", "item_id", "n_windows", "n_equal"],
            )

    return run
