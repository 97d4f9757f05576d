"""Line notation to cell complexes: a tolerant reader for molecule strings, one Arrow pass.

Reads atoms, bonds, branches, ring marks and components of the plain spelling of a string. It checks
syntax, not chemistry: a string it can't read gives no graph and goes to quarantine. Rings are the cycles that ring marks close:
the shortest way between the two ends when the mark closes.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions.spelling import plain_spelling

TOKEN = re.compile(r"(\[[^\[\]]+\]|Br|Cl|[BCNOFPSI]|[bcnops]|\*)|(%\d\d|\d)|([-=#$:/\\~])|([().])")
_SYMBOL = re.compile(r"\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)")


def read_line(text: str | None) -> tuple[list[str], list[tuple[int, int, str]], list[list[int]]] | None:
    """(atom symbols, bonds, rings) of a string, None where it can't be read; rings list their atoms in order."""
    if not text:
        return None
    atoms: list[str] = []
    bonds: list[tuple[int, int, str]] = []
    near: list[list[int]] = []
    rings: list[list[int]] = []
    opened: dict[str, tuple[int, str]] = {}
    stack: list[int] = []
    last, bond, at = -1, "", 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        atom, mark, link, sign = m.groups()
        at = m.end()
        if atom:
            symbol = _SYMBOL.match(atom)
            atoms.append(symbol.group(1) if symbol else atom)
            near.append([])
            if last >= 0:
                bonds.append((last, len(atoms) - 1, bond or "-"))
                near[last].append(len(atoms) - 1)
                near[-1].append(last)
            last, bond = len(atoms) - 1, ""
        elif mark:
            if last < 0:
                return None
            if mark in opened:
                start, kind = opened.pop(mark)
                if start == last or last in near[start]:
                    return None
                rings.append(_way(near, start, last))
                bonds.append((start, last, bond or kind or "-"))
                near[start].append(last)
                near[last].append(start)
            else:
                opened[mark] = (last, bond)
            bond = ""
        elif link:
            bond = link
        elif sign == "(":
            stack.append(last)
        elif sign == ")":
            if not stack:
                return None
            last = stack.pop()
        else:
            last, bond = -1, ""
    return None if opened or stack or not atoms else (atoms, bonds, [r for r in rings if r])


def _way(near: list[list[int]], start: int, end: int) -> list[int]:
    """A shortest way between two atoms, both included; empty where there is none."""
    via = {start: -1}
    todo = deque([start])
    while todo:
        u = todo.popleft()
        if u == end:
            way = []
            while u >= 0:
                way.append(u)
                u = via[u]
            return way
        for v in near[u]:
            if v not in via:
                via[v] = u
                todo.append(v)
    return []


_COMPLEX = "g bigint, atoms array<string>, bonds array<struct<u:bigint,v:bigint,kind:string>>, rings array<array<bigint>>"


def complexes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(g, atoms, bonds, rings): the nested cell complex of each string with a readable plain spelling; others are left out, see ``unreadable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, read_line(plain_spelling(t))) for g, t in zip(b["g"], b["t"])]
            rows = [(g, r) for g, r in rows if r]
            if not rows:
                continue
            yield pd.DataFrame({"g": [g for g, _ in rows], "atoms": [r[0] for _, r in rows], "bonds": [[{"u": u, "v": v, "kind": k} for u, v, k in r[1]] for _, r in rows], "rings": [r[2] for _, r in rows]})

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("g"), F.col(text_col).alias("t")).mapInPandas(run, _COMPLEX)


def unreadable(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The quarantine: rows whose string gave no complex."""
    return df.join(found.select(F.col("g").alias(id_col)), id_col, "left_anti")


def edges_of(found: DataFrame) -> DataFrame:
    """(g, u, v, kind), one row a bond."""
    return found.select("g", F.inline("bonds"))


def faces_of(found: DataFrame) -> DataFrame:
    """(g, face, u, v), one row for each bond of each ring."""
    ring = found.select("g", F.posexplode("rings").alias("face", "ring"))
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    return ring.select("g", "face", F.inline(F.arrays_zip(F.col("ring").alias("u"), nxt.alias("v")))).toDF("g", "face", "u", "v")
