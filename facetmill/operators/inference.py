"""Fixed-weight forward pass of a message-passing and attention block over small graphs, one Arrow task a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.sources.scratch import one_thread_a_task


@dataclass(frozen=True)
class Block:
    """Weights of one block; drawn from a seed unless given, so that a plan needs no files."""

    width: int = 16
    heads: int = 4
    most_hops: int = 35
    seed: int = 0
    weights: dict = field(default_factory=dict)

    def get(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.weights:
            rng = np.random.default_rng([self.seed, *name.encode()])
            self.weights[name] = rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return self.weights[name]


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def gelu(x: np.ndarray) -> np.ndarray:
    # the error function to seven digits, as a rational approximation
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return x * (1 + np.sign(x) * erf) / 2


def mlp(block: Block, name: str, x: np.ndarray) -> np.ndarray:
    first, second = block.get(name + "1", x.shape[-1], 2 * block.width), block.get(name + "2", 2 * block.width, block.width)
    # rows that fit a cache at a time
    parts = [layer_norm(gelu(x[i : i + 2048] @ first)) @ second for i in range(0, max(1, len(x)), 2048)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def message_step(block: Block, x: np.ndarray, u: np.ndarray, v: np.ndarray, e: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge, node and graph update: messages summed by receiver and by sender, residuals around each."""
    wide = np.broadcast_to(g, (len(e), len(g)))
    e_new = mlp(block, "edge", np.concatenate([x[u], x[v], e, wide], 1))
    into, out = np.zeros((len(x), 2 * x.shape[1])), np.zeros((len(x), 2 * x.shape[1]))
    np.add.at(into, v, np.concatenate([e_new, x[u]], 1))
    np.add.at(out, u, np.concatenate([e_new, x[v]], 1))
    x_new = mlp(block, "node", np.concatenate([x, into, out, np.broadcast_to(g, (len(x), len(g)))], 1))
    g_new = mlp(block, "graph", np.concatenate([g, x_new.sum(0), e_new.sum(0)])[None])[0]
    return layer_norm(x_new) + x, e + e_new, g + g_new


def biased_attention(block: Block, x: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax attention of all nodes with a bias per head and pair, minus infinity where there is no way; (output, weights)."""
    n, d = x.shape
    q, k, v = (x @ block.get(name, d, d) for name in ("query", "key", "value"))
    split = lambda m: m.reshape(n, block.heads, -1).transpose(1, 0, 2)
    score = split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(d / block.heads) + bias
    w = np.exp(score - score.max(-1, keepdims=True))
    w /= w.sum(-1, keepdims=True)
    return (w @ split(v)).transpose(1, 0, 2).reshape(n, d) @ block.get("out", d, d), w


def _hops(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    links = np.zeros((n, n), np.float32)
    links[u, v] = 1
    d = np.full((n, n), -1)
    np.fill_diagonal(d, 0)
    front, k = np.eye(n, dtype=bool), 0
    while front.any():
        k += 1
        front = (front.astype(np.float32) @ links > 0) & (d < 0)
        d[front] = k
    return d


def embed(block: Block, n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """(embedding, logit) of one graph of n nodes: a message and an attention step, a feed-forward step, a sum over nodes.

    Nodes start from their degree. Edges are taken in both directions.
    """
    u, v = np.unique(np.stack([np.r_[u, v], np.r_[v, u]], 1), axis=0).T.reshape(2, -1)
    x = block.get("degree", 6, block.width)[np.minimum(np.bincount(u, minlength=n), 5)]
    e = np.broadcast_to(block.get("bond", 1, block.width), (len(u), block.width))
    m, e, _ = message_step(block, x, u, v, e, block.get("global", 1, block.width)[0])
    hops = _hops(n, u, v)
    recoded = np.where(hops > 0, hops + 1, hops)
    table = block.get("bias", block.most_hops + 3, block.heads)
    bias = table[np.where(recoded < 0, block.most_hops + 2, np.minimum(recoded, block.most_hops + 1))].transpose(2, 0, 1)
    attended, _ = biased_attention(block, x, np.where(hops[None] < 0, -np.inf, bias))
    x = layer_norm(m + attended + x)
    pooled = (x + mlp(block, "feed", x)).sum(0)
    return pooled, float(pooled @ block.get("head", block.width, 1)[:, 0])


def forward(edges: DataFrame, block: Block) -> DataFrame:
    """(g, embedding, logit) of each graph of an edge table (g, u, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["u"], pdf["v"]]))
        pooled, logit = embed(block, len(nodes), np.searchsorted(nodes, pdf["u"]), np.searchsorted(nodes, pdf["v"]))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "embedding": [pooled], "logit": [logit]})

    return one_thread_a_task(edges).select("g", "u", "v").groupBy("g").applyInPandas(run, "g bigint, embedding array<double>, logit double")


def nested_forward(found: DataFrame, block: Block) -> DataFrame:
    """(g, embedding, logit) of nested complexes, one row a graph, without a shuffle."""

    def run(batches):
        for pdf in batches:
            rows = []
            for g, atoms, bonds in zip(pdf["g"], pdf["atoms"], pdf["bonds"]):
                ends = np.array([(b["u"], b["v"]) for b in bonds], np.int64).reshape(-1, 2)
                rows.append((g, *embed(block, len(atoms), ends[:, 0], ends[:, 1])))
            yield pd.DataFrame(rows, columns=["g", "embedding", "logit"])

    return one_thread_a_task(found).select("g", "atoms", "bonds").mapInPandas(run, "g bigint, embedding array<double>, logit double")


def embedding_sums(codes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., dim, value): the sum over an item's code fields of their embedding vectors.

    codes is (keys.., field, code), table is (field, code, vector). The table has one row for each code of a vocabulary; it is broadcast only
    by Spark's own size limit. A code without a row adds nothing.
    """
    held = codes.join(table, ["field", "code"]).select(*keys, F.posexplode("vector").alias("dim", "x"))
    return held.groupBy(*keys, "dim").agg(F.sum("x").alias("value"))
