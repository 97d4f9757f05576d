"""Problem 1: a sample whose cells take given shares, with a minimum of small cells, and a report of what can't be met.

Method: min-cost flow over the cross-classified cell counts. What a cell lacks of its need is the flow on the slack arc beside
it. The quotas come from a flow between the margins of the two categories: arcs carry the margins, the floors and
what is available, and what a short cell can't give, or a floor takes, is moved to cells of its row and column so that both
margins hold wherever they can. The rounding of cells and margins to whole numbers is drawn at random.

The table is reduced to one count per cell before anything reaches the driver. All plans draw from one order of a cell's rows,
by a seeded hash, each from a place of its own: a histogram over hash buckets tells the buckets that a plan takes
whole, and only rows of the buckets where a plan begins or ends are ranked. No cell is ever sorted, and rows no plan takes never leave the scan.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.llm.flow import Network
from facetmill.sources.scratch import Scratch

#: Hash buckets in which a cell's rows are counted.
DRAW_BUCKETS = 4096
#: More plan rows than this are refused: plans are collected, so their number must be bounded.
MOST_PLAN_ROWS = 100_000


def letters_and_digits(c: Column) -> Column:
    """A name with only its letters and digits, without case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def usable_rows(df: DataFrame, id_col: str, category: str, label: str, known: Sequence[str]) -> DataFrame:
    """(id, category, label): one row per id with a known category, as ``known`` spells it, and a label of 0 or 1.

    Rows with a null id, another or null category, or another or null label are left out. Of rows
    delivered again under their id, the one with the smallest category and label counts.
    """
    name = letters_and_digits(F.col(category))
    spelled = F.coalesce(*(F.when(name == letters_and_digits(F.lit(k)), k) for k in known))
    rows = df.select(F.col(id_col).alias("id"), spelled.alias("category"), F.col(label).cast("int").alias("label"))
    rows = rows.where("id is not null and category is not null and label in (0, 1)")
    one = rows.groupBy("id").agg(F.min(F.struct("category", "label")).alias("one"))
    return one.select("id", "one.category", "one.label")


def shortfalls(cells: dict[tuple, tuple[float, int]], available: dict[tuple, int]) -> dict[tuple, int]:
    """What each cell lacks of its need, the larger of target and floor: the flow on its slack arc."""
    net = Network()
    slack, total = {}, 0
    for cell, (target, floor) in cells.items():
        need = max(math.ceil(target), floor or 0)
        total += need
        net.arc("source", ("margin", cell[0]), need)
        net.arc(("margin", cell[0]), ("cell", *cell), min(need, available.get(cell, 0)), 0)
        slack[cell] = net.arc(("margin", cell[0]), ("cell", *cell), need, 1)
        net.arc(("cell", *cell), ("label", cell[1]), need)
        net.arc(("label", cell[1]), "sink", need)
    net.send("source", "sink", total)
    return {cell: net.flow(a) for cell, a in slack.items()}


#: Costs of a unit in the quota flow: of a floor, of a target, above the target, over a margin, and of one that no cell can give.
_FLOOR, _TARGET, _ABOVE, _OVER, _LACKING = 0, 1000, 1100, 300, 20_000


def draw_quotas(cells: dict[tuple, tuple[float, int]], available: dict[tuple, int], seed: int) -> dict[tuple, int]:
    """A random integer quota per cell, at least its floor and at most what is there.

    The quotas sum to the targets' sum, halves rounded up, or to the floors' where that is more, as far as rows are there. Each margin of the targets, rounded down or up at random, is
    kept where floors and availability allow; what a cell lacks or a floor adds is balanced inside its row and column first, as
    going over a margin costs more than moving units around a cycle of cells.
    """
    dice = random.Random(seed)
    net = Network()
    margins: list[dict] = [{}, {}]
    for cell, (target, _) in cells.items():
        for side in (0, 1):
            margins[side][cell[side]] = margins[side].get(cell[side], 0.0) + target
    for side in (0, 1):
        for name, whole in margins[side].items():
            node = (side, name)
            for room, cost in ((math.floor(whole), 0), (int(whole > math.floor(whole)), -math.log(1 - dice.random()) / max(whole - math.floor(whole), 1e-3)), (1 << 60, _OVER)):
                net.arc(*(("source", node) if side == 0 else (node, "sink")), room, min(cost, _OVER))
    arcs: dict[tuple, list[int]] = {}
    floors = 0
    for cell, (target, least) in sorted(cells.items(), key=lambda c: dice.random()):
        there = available.get(cell, 0)
        low = min(there, least or 0)
        floors += low
        whole = max(low, min(there, math.floor(target)))
        part = target - math.floor(target)
        up = int(part > 1e-9 and low <= target and whole < there)
        # a cell with a large part left over is likelier to be rounded up
        steps = [(low, _FLOOR), (whole - low, _TARGET), (up, _TARGET + min(90.0, -math.log(1 - dice.random()) / max(part, 1e-3)))]
        spare = there - whole - up
        steps += [(spare // 8 + (k < spare % 8), _ABOVE + k) for k in range(8)]
        arcs[cell] = [net.arc((0, cell[0]), (1, cell[1]), room, cost) for room, cost in steps if room > 0]
        net.arc((0, cell[0]), (1, cell[1]), 1 << 60, _LACKING)
    net.send("source", "sink", max(floors, math.floor(sum(t for t, _ in cells.values()) + 0.5 + 1e-6)))
    return {c: sum(map(net.flow, arcs[c])) for c in cells}


def plan_report(usable: DataFrame, plans: DataFrame, plan: str, category: str, label: str, share: str, fraction: str, floor: str, seed: int = 11) -> list[tuple]:
    """(plan, category, label, target, available, quota, shortfall, target share, share reached) of every cell of every plan.

    Plan rows with a null plan, category, label, share or fraction are left out; a null floor is 0; a cell named
    twice in a plan takes the sum of its shares and the larger floor.
    """
    counts = {(r.category, r.label): r.n for r in usable.groupBy("category", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    held = plans.select(*(F.col(c).alias(n) for n, c in (("plan", plan), ("category", category), ("label", label), ("share", share), ("fraction", fraction), ("floor", floor)))).dropna(subset=["plan", "category", "label", "share", "fraction"]).limit(MOST_PLAN_ROWS + 1).collect()
    if len(held) > MOST_PLAN_ROWS:
        raise ValueError(f"more than {MOST_PLAN_ROWS} plan rows")
    by_plan: dict = {}
    for r in held:
        cells = by_plan.setdefault(r.plan, {})
        target, least = cells.get((r.category, r.label), (0.0, 0))
        cells[r.category, r.label] = (target + r.share * r.fraction * total, max(least, r.floor or 0))
    out = []
    for name, cells in sorted(by_plan.items()):
        short = shortfalls(cells, counts)
        quotas = draw_quotas(cells, counts, _digest(seed, name))
        size, wanted = sum(quotas.values()), sum(t for t, _ in cells.values())
        out += [(name, *cell, float(cells[cell][0]), counts.get(cell, 0), quotas[cell], short[cell], cells[cell][0] / wanted if wanted else 0.0, quotas[cell] / size if size else 0.0) for cell in sorted(cells)]
    return out


REPORT = "plan_id bigint, category string, label int, target double, available bigint, quota bigint, shortfall bigint, target_share double, reached_share double"


def _digest(*parts) -> int:
    """The same whole number in every process."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _stretches(start: int, quota: int, n: int) -> list[tuple[int, int]]:
    """The places of ``quota`` of n rows from ``start`` on, going round."""
    return [(a, b) for a, b in ((start, min(n, start + quota)), (0, start + quota - n)) if a < b]


def draw(usable: DataFrame, quotas: DataFrame, seed: int = 11) -> DataFrame:
    """(plan_id, category, label, id): of each plan's cell exactly its quota of rows, by seeded hash; ties by id.

    ids are unique in ``usable``. Plans that name a cell overlap in it where their stretches do.
    """
    spark = usable.sparkSession
    scratch = Scratch(spark, "draw")
    h = F.xxhash64(F.lit(seed), "id")
    rows = scratch.write(usable.select("category", "label", "id").withColumn("bucket", F.pmod(h, F.lit(DRAW_BUCKETS)).cast("int")), "usable")
    wanted = quotas.where("quota > 0").select("plan_id", "category", "label", "quota").limit(MOST_PLAN_ROWS + 1).collect()
    if len(wanted) > MOST_PLAN_ROWS:
        raise ValueError(f"more than {MOST_PLAN_ROWS} cells of plans")
    cells = {(r.category, r.label) for r in wanted}
    sizes: dict[tuple, np.ndarray] = {c: np.zeros(DRAW_BUCKETS, np.int64) for c in cells}
    for r in rows.groupBy("category", "label", "bucket").agg(F.count("*").alias("n")).toLocalIterator():
        if (r.category, r.label) in sizes:
            sizes[r.category, r.label][r.bucket] = r.n
    whole: dict[tuple, list] = {}
    parts: list[tuple] = []
    for r in wanted:
        ends = np.cumsum(sizes[r.category, r.label])
        n = int(ends[-1])
        for a, b in _stretches(_digest(seed, r.plan_id, r.category, r.label) % n if n else 0, min(r.quota, n), n):
            for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1):
                first, size = int(ends[k] - sizes[r.category, r.label][k]), int(sizes[r.category, r.label][k])
                low, high = max(a - first, 0), min(b - first, size)
                if high - low == size:
                    whole.setdefault((r.category, r.label, k), []).append(r.plan_id)
                elif low < high:
                    parts.append((r.plan_id, r.category, r.label, k, low, high))
    kind = quotas.schema["plan_id"].dataType.simpleString()
    # bounded: one row for each cell and bucket, and two for each plan's cell
    taken = spark.createDataFrame([(*k, v) for k, v in whole.items()], f"category string, label int, bucket int, plans array<{kind}>")
    ends_ = spark.createDataFrame(parts, f"plan_id {kind}, category string, label int, bucket int, low bigint, high bigint")
    key = ["category", "label", "bucket"]
    out = rows.join(F.broadcast(taken), key).select(F.explode("plans").alias("plan_id"), "category", "label", "id")
    cut = rows.join(F.broadcast(ends_.select(*key).distinct()), key, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(h, "id")) - 1)
    some = cut.join(F.broadcast(ends_), key).where("nth >= low and nth < high").select("plan_id", "category", "label", "id")
    return out.unionAll(some)
