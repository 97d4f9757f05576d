"""From molecule strings to model inputs: coded cells as nested rows, their tables, encodings and a forward pass, in batches of graphs.

A nested row holds a whole graph, so nothing is shuffled. The kernels take many graphs at once: graphs of one size share stacked
matrices (spectra, walks, hops, attention), and the cells of all graphs of a batch share flat arrays (messages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions.codes import ATOM_FIELDS, BOND_FIELDS, BOND_STEREO, BOND_TYPES, RING_FIELDS, coded_cells
from facetmill.functions.spelling import plain_spelling
from facetmill.operators.inference import Block, layer_norm, mlp
from facetmill.sources.scratch import one_thread_a_task

#: Graphs whose cells are taken together, and rows of a table of cells that are sent at a time.
GRAPHS = 128
ROWS = 65_536
#: Pairs of atoms of graphs that are taken together, and pairs that one step of attention takes at a time.
PAIRS = 1 << 20
ATTENDED = 1 << 15
CODED = "g bigint, n int, atoms array<int>, bonds array<int>, bond_codes array<int>, ring_sizes array<int>, ring_bonds array<int>, ring_codes array<int>"


def coded_complexes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Nested coded graphs, all lists flat: n atoms with 12 codes each, bonds as pairs of atoms with 4 codes, rings with 6, and each ring's bonds.

    Strings that can't be read, or hold only the tag, are left out, as are null ids.
    """
    names = [f.split()[0] for f in CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for g, text in zip(*(c.to_pylist() for c in b.columns)):
                found = coded_cells(plain_spelling(text))
                if found:
                    atoms, bonds, bond_codes, rings, ring_codes = found
                    flat = [[x for row in rows for x in row] for rows in (atoms, bonds, bond_codes)]
                    row = g, len(atoms), *flat, [*map(len, rings)], [x for r in rings for x in r], [x for r in ring_codes for x in r]
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("g"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, CODED)


def _rows(found: DataFrame, columns: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    """(g, ``name``, fields..): one row for each entry of the flat lists ``columns``, which have as many entries as each other; nothing is joined."""
    fields = [f for own in columns.values() for f in own]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            g, *lists = b.columns
            width = len(next(iter(columns.values())))
            many = lists[0].value_lengths().to_numpy(zero_copy_only=False) // width
            codes = [x.flatten().to_numpy().reshape(-1, len(own))[:, i] for x, own in zip(lists, columns.values()) for i in range(len(own))]
            rows = np.repeat(g.to_numpy(), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            for at in range(0, len(rows[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][at : at + ROWS]), *(pa.array(c[at : at + ROWS].astype(np.int32)) for c in (rows[1], *codes))], names=["g", name, *fields])

    return found.select("g", *columns).mapInArrow(run, ", ".join(["g bigint", *(f"{f} int" for f in (name, *fields))]))


def atom_table(found: DataFrame) -> DataFrame:
    """(g, atom, the 12 codes)."""
    return _rows(found, {"atoms": ATOM_FIELDS}, "atom")


def bond_table(found: DataFrame) -> DataFrame:
    """(g, bond, u, v, the 4 codes)."""
    return _rows(found, {"bonds": ("u", "v"), "bond_codes": BOND_FIELDS}, "bond")


def ring_table(found: DataFrame) -> DataFrame:
    """(g, ring, the 6 codes)."""
    return _rows(found, {"ring_codes": RING_FIELDS}, "ring")


def hops_of(n: int, bonds: list[np.ndarray]) -> np.ndarray:
    """(graphs, n, n) hops of stacked graphs of n atoms, 0 to itself, -1 where there is no way; bonds are pairs of atoms of each graph.

    Atoms join one by one through their first bond to an earlier atom, which gives their hops to all earlier ones. Each bond left shortens
    the ways that lead over it once.
    """
    kind, far = (np.int16, 16_000) if n < 16_000 else (np.int32, 1 << 29)
    graphs, parent, left = np.arange(len(bonds)), np.full((len(bonds), n), n), []
    for k, b in enumerate(bonds):
        low, high = b.min(1), b.max(1)
        _, first = np.unique(high, return_index=True)
        parent[k, high[first]] = low[first]
        left.append(np.delete(b, first, 0))
    # the last row stands for no earlier atom
    d = np.full((len(bonds), n + 1, n), far, kind)
    for i in range(n):
        d[:, i, :i] = np.minimum(d[graphs, parent[:, i], :i] + kind(1), far)
        d[:, :i, i] = d[:, i, :i]
        d[:, i, i] = 0
    d = d[:, :n]
    for e in range(max(map(len, left), default=0)):
        own = np.array([k for k, b in enumerate(left) if len(b) > e])
        a, b = np.array([left[k][e] for k in own]).T
        to_a, to_b = d[own, a], d[own, b]
        ways = np.minimum(to_a[:, :, None] + to_b[:, None], to_b[:, :, None] + to_a[:, None])
        ways += kind(1)
        d[own] = np.minimum(d[own], ways)
    return np.where(d < far, d, kind(-1)).astype(np.int32)


def eigen_of(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the symmetric normalised Laplacians of stacked adjacency matrices."""
    degree = links.sum(2)
    scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
    return np.linalg.eigh(np.eye(links.shape[1]) - scale[:, :, None] * links * scale[:, None, :])


def returns_of(links: np.ndarray, values: np.ndarray, vectors: np.ndarray, steps: int) -> np.ndarray:
    """(graphs, n, steps): chances to be back after 1 to ``steps`` steps, from the spectrum; an atom without bonds keeps the walk."""
    powers = np.stack([(1 - values) ** k for k in range(1, steps + 1)], 2)
    back = np.clip(vectors**2 @ powers, 0.0, 1.0)
    back[links.sum(2) == 0] = 1.0
    return back


def spectra_of(values: np.ndarray, vectors: np.ndarray, k: int, zero: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(graphs, k) eigenvalues above ``zero`` over the largest of them, and (graphs, n, k) vectors, largest entry positive; padded with zeros."""
    graphs, n = values.shape
    at = (values <= zero).sum(1)[:, None] + np.arange(k)
    there = at < n
    at = np.minimum(at, n - 1)
    values = np.where(there, np.take_along_axis(values, at, 1), 0.0)
    vectors = np.where(there[:, None], np.take_along_axis(vectors, np.broadcast_to(at[:, None], (graphs, n, k)), 2), 0.0)
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)
    vectors = vectors * np.where(top < 0, -1.0, 1.0)
    most = values.max(1, keepdims=True)
    return np.divide(values, most, out=np.zeros_like(values), where=most > 0), vectors


def _batches(b: pa.RecordBatch) -> Iterator[list[dict]]:
    """The graphs of a batch by size, at most GRAPHS and PAIRS pairs of atoms at a time; one graph at least."""
    columns = []
    for x in b.columns:
        if pa.types.is_list(x.type):
            values, ends = x.flatten().to_numpy().astype(np.int64), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
            columns.append(np.split(values, ends[:-1]))
        else:
            columns.append(x.to_pylist())
    rows = sorted((dict(zip(b.schema.names, r)) for r in zip(*columns)), key=lambda r: r["n"])
    own: list[dict] = []
    for r in rows:
        if own and (len(own) == GRAPHS or (len(own) + 1) * r["n"] ** 2 > PAIRS):
            yield own
            own = []
        own.append(r)
    if own:
        yield own


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(np.size, rows)]), pa.int32()), pa.array(np.concatenate([r.ravel() for r in rows]), kind))


def _by_size(graphs: list[dict]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Positions and stacked adjacency matrices of the graphs of each size."""
    sizes: dict[int, list[int]] = {}
    for i, g in enumerate(graphs):
        sizes.setdefault(g["n"], []).append(i)
    for n, own in sizes.items():
        links = np.zeros((len(own), n, n))
        for k, i in enumerate(own):
            u, v = graphs[i]["bonds"].reshape(-1, 2).T
            links[k, u, v] = links[k, v, u] = 1.0
        yield own, links


def _ends(graphs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(atoms of each graph, u, v): the bonds of all graphs in both directions, atoms numbered over all graphs."""
    n = np.array([g["n"] for g in graphs])
    one = np.concatenate([g["bonds"].reshape(-1, 2) + a for g, a in zip(graphs, np.cumsum(n) - n)])
    return n, np.r_[one[:, 0], one[:, 1]], np.r_[one[:, 1], one[:, 0]]


def encodings(found: DataFrame, k: int = 7, steps: int = 16) -> DataFrame:
    """(g, n, values, vectors, returns, hops) of coded graphs; vectors, returns and hops are flat, atom after atom."""
    schema = "g bigint, n int, values array<double>, vectors array<double>, returns array<double>, hops array<int>"

    def run(batches):
        for b in batches:
            for graphs in _batches(b):
                out: list = []
                for own, links in _by_size(graphs):
                    hops = hops_of(links.shape[1], [graphs[i]["bonds"].reshape(-1, 2) for i in own])
                    eigen = eigen_of(links)
                    back = returns_of(links, *eigen, steps)
                    values, vectors = spectra_of(*eigen, k)
                    out += [(graphs[i]["g"], graphs[i]["n"], values[j], vectors[j], back[j], hops[j]) for j, i in enumerate(own)]
                g, n, *lists = zip(*out)
                kinds = [*[pa.float64()] * 3, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int32()), *map(_lists, lists, kinds)], names=["g", "n", "values", "vectors", "returns", "hops"])

    return one_thread_a_task(found).select("g", "n", "bonds").mapInArrow(run, schema)


def _sums(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` added up by ``at``."""
    return np.stack([np.bincount(at, c, n) for c in x.T], 1) if len(x) else np.zeros((n, x.shape[1]))


def _looked_up(block: Block, name: str, codes: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """The sum over code fields of their embeddings."""
    return sum(block.get(f"{name}{i}", s, block.width)[np.minimum(codes[:, i], s - 1)] for i, s in enumerate(sizes))


def message_layer(block: Block, name: str, x, e, f, g, u, v, inc_face, inc_edge, of_node, of_edge, of_face, alpha: float = 1.0) -> tuple:
    """Face, edge, node and graph update of all graphs of a batch; inc_face, inc_edge: directed edges of each face.

    A face hears the sum of its edges; each of its edges hears the face and the mean of its other edges, times ``alpha``; nodes hear
    incoming and outgoing edges with their far ends; graphs the sums of all cells. Residuals around each.
    """
    own = np.bincount(inc_face, minlength=len(f)).astype(float)
    held = _sums(e[inc_edge], inc_face, len(f))
    f_new = mlp(block, name + "face", np.concatenate([held, f, g[of_face]], 1))
    others = (held[inc_face] - e[inc_edge]) / np.maximum(own - 1, 1)[inc_face][:, None]
    coface = alpha * _sums(np.concatenate([f_new[inc_face], others], 1), inc_edge, len(e))
    e_new = mlp(block, name + "edge", np.concatenate([x[u], x[v], e, coface, g[of_edge]], 1))
    into, out = _sums(np.concatenate([e_new, x[u]], 1), v, len(x)), _sums(np.concatenate([e_new, x[v]], 1), u, len(x))
    x_new = mlp(block, name + "node", np.concatenate([x, into, out, g[of_node]], 1))
    g_new = mlp(block, name + "graph", np.concatenate([g, _sums(x_new, of_node, len(g)), _sums(e_new, of_edge, len(g)), _sums(f_new, of_face, len(g))], 1))
    return layer_norm(x_new) + x, e + e_new, f + f_new, g + g_new


def hop_bias(block: Block, hops: np.ndarray) -> np.ndarray:
    """(graphs, heads, n, n): a bias by head and hops; minus infinity where there is no way."""
    table = np.vstack([block.get("bias", block.most_hops + 3, block.heads), np.full(block.heads, -np.inf)])
    at = np.where(hops < 0, block.most_hops + 3, np.minimum(np.where(hops > 0, hops + 1, 0), block.most_hops + 1))
    return np.stack([table[:, h][at] for h in range(block.heads)], 1)


def attend(block: Block, name: str, x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Softmax attention within stacked graphs (graphs, n, width), with a bias; no way, no attention."""
    k, n, d = x.shape
    split = lambda w: (x @ block.get(name + w, d, d)).reshape(k, n, block.heads, -1).transpose(0, 2, 1, 3)
    query, key, value = split("query") / np.sqrt(d / block.heads), split("key").transpose(0, 1, 3, 2), split("value")
    heard = np.empty_like(query)
    step = max(1, ATTENDED // (n * n))
    for i in range(0, k, step):
        w = query[i : i + step] @ key[i : i + step]
        w += bias[i : i + step]
        w -= w.max(-1, keepdims=True)
        np.exp(w, out=w)
        heard[i : i + step] = w @ value[i : i + step] / w.sum(-1, keepdims=True)
    return heard.transpose(0, 2, 1, 3).reshape(k, n, d) @ block.get(name + "out", d, d)


ATOM_SIZES, BOND_SIZES, RING_SIZES = (11, 5, 6, 6, 5, 5, 5, 4, 4, 2, 2, 2), (len(BOND_TYPES) + 1, len(BOND_STEREO) + 1, 2, 2), (6, 2, 6, 2, 2, 12)


def forward_batch(block: Block, graphs: list[dict], layers: int = 2, targets: int = 3, k: int = 7, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(graphs, width) embeddings and (graphs, targets) logits of a batch.

    Nodes start from their codes, degree, spectrum and walk, edges and faces from their codes, a graph from a common vector and its
    eigenvalues. Each layer adds messages and attention, then a feed-forward step. Embeddings are sums over nodes.
    """
    n, u, v = _ends(graphs)
    first = np.cumsum(n) - n
    m = np.array([len(g["bonds"]) // 2 for g in graphs])
    before = np.cumsum(m) - m
    of_node, of_edge = np.repeat(np.arange(len(n)), n), np.tile(np.repeat(np.arange(len(n)), m), 2)
    faces = np.array([len(g["ring_sizes"]) for g in graphs])
    of_face = np.repeat(np.arange(len(n)), faces)
    sizes = np.concatenate([g["ring_sizes"] for g in graphs])
    bonds = np.concatenate([g["ring_bonds"] + b for g, b in zip(graphs, before)])
    inc_face, inc_edge = np.tile(np.repeat(np.arange(len(sizes)), sizes), 2), np.r_[bonds, bonds + m.sum()]
    width = block.width
    values, vectors, back = np.zeros((len(n), k)), np.zeros((n.sum(), k)), np.zeros((n.sum(), steps))
    biases = []
    for own, links in _by_size(graphs):
        rows = first[own][:, None] + np.arange(links.shape[1])
        eigen = eigen_of(links)
        values[own], vectors[rows] = spectra_of(*eigen, k)
        back[rows] = returns_of(links, *eigen, steps)
        biases.append((rows, hop_bias(block, hops_of(links.shape[1], [graphs[i]["bonds"].reshape(-1, 2) for i in own]))))
    codes = [np.concatenate([g[c] for g in graphs]).reshape(-1, w) for c, w in (("atoms", 12), ("bond_codes", 4), ("ring_codes", 6))]
    x = _looked_up(block, "atom", codes[0], ATOM_SIZES) + block.get("degree", 6, width)[np.minimum(np.bincount(u, minlength=n.sum()), 5)]
    x = x + mlp(block, "spectrum", vectors) + mlp(block, "walk", back)
    e = np.tile(_looked_up(block, "bond", codes[1], BOND_SIZES), (2, 1)) if len(u) else np.zeros((0, width))
    f = _looked_up(block, "ring", codes[2], RING_SIZES) if len(sizes) else np.zeros((0, width))
    g = block.get("global", 1, width) + mlp(block, "values", values)
    for layer in range(layers):
        name = f"layer{layer}-"
        moved, e, f, g = message_layer(block, name, x, e, f, g, u, v, inc_face, inc_edge, of_node, of_edge, of_face)
        seen = np.zeros_like(x)
        for rows, bias in biases:
            seen[rows] = attend(block, name, x[rows], bias)
        x = layer_norm(moved + seen)
        x = x + mlp(block, name + "feed", x)
    pooled = _sums(x, of_node, len(n))
    return pooled, pooled @ block.get("head", width, targets)


def forward(found: DataFrame, block: Block, layers: int = 2) -> DataFrame:
    """(g, embedding, logits) of coded graphs, with fixed weights."""

    def run(batches):
        for b in batches:
            for graphs in _batches(b):
                pooled, logits = forward_batch(block, graphs, layers)
                yield pa.RecordBatch.from_arrays([pa.array([x["g"] for x in graphs], pa.int64()), _lists([*pooled], pa.float64()), _lists([*logits], pa.float64())], names=["g", "embedding", "logits"])

    return one_thread_a_task(found).mapInArrow(run, "g bigint, embedding array<double>, logits array<double>")
