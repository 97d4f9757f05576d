"""Connected components of an edge table by hooking and pointer jumping.

Every node hooks onto its smallest smaller neighbour, which gives a forest; pointer jumping halves
the depth of its trees until each node points at a root; then edges are rewritten to roots, loops
and repeats fall away and the next round works on what is left. Both loops take a number of rounds
logarithmic in the graph, and each result is a written table, so neither lineage nor a lost
executor matters. Nothing is gathered on the driver but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.sources.scratch import Scratch


def _jump(parents: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root): every parent replaced by the root of its tree."""
    step = 0
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("root").alias("above"))
        child = parents.select("node", F.col("root").alias("parent"))
        moved = child.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("root"), F.col("above").isNotNull().alias("moved"))
        nxt = scratch.write(moved, f"{label}-jump{step}")
        if step:
            scratch.drop(f"{label}-jump{step - 1}")
        parents = nxt.select("node", "root")
        if nxt.where("moved").limit(1).count() == 0:
            return parents
        step += 1


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the smallest node of the component.

    Loops, repeated edges and both directions are allowed; edges with a null end are left out. An
    edge table without any edge gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    rest = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges0")
    levels: list[DataFrame] = []
    while rest.limit(1).count():
        n = len(levels)
        hooked = scratch.write(rest.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), f"hook{n}")
        roots = _jump(hooked, scratch, f"level{n}")
        levels.append(roots)
        of_u = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        of_v = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        ends = rest.join(of_u, "u").join(of_v, "v", "left").select("ru", F.coalesce("rv", "v").alias("rv")).where("ru <> rv")
        rest = scratch.write(ends.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), f"edges{n + 1}")
        scratch.drop(f"edges{n}", f"hook{n}")
        scratch.tidy()
    if not levels:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[-1]
    for lower in reversed(levels[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = lower.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionAll(found)
    # a root of one level is a node of the next, so each node stands in one level only
    nodes = scratch.write(found, "found")
    return nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())
