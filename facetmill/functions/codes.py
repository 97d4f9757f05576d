"""Categorical codes of atoms, bonds and rings, from the line notation alone.

There is no chemistry toolkit here: hydrogens follow the usual valences of the organic subset, hybridisation and conjugation follow
bond orders, and rings are the cycles that ring marks close. The tag atom is left out, as are its bonds.
"""

from __future__ import annotations

import re
from functools import lru_cache

from facetmill.functions.lines import TOKEN, read_line

# The vocabularies of the codes; a value outside of one takes the code after its last.
ATOMIC_NUMBERS = (5, 6, 7, 8, 9, 14, 16, 17, 35, 53)
PERIODS = (2, 3, 4, 5)
GROUPS = (13, 14, 15, 16, 17)
DEGREES = (0, 1, 2, 3, 4)
HYDROGENS = (0, 1, 2, 3)
CHARGES = (-1, 0, 1)
HYBRIDISATIONS = ("SP", "SP2", "SP3")
BOND_TYPES = ("SINGLE", "DOUBLE", "TRIPLE", "AROMATIC")
BOND_STEREO = ("STEREONONE", "STEREOE")
RING_SIZES = (3, 4, 5, 6, 7)
HETERO_COUNTS = (0, 1, 2, 3, 4)
ELECTRONEGATIVITY_BINS = 11

# Symbol, atomic number, period, group, Pauling electronegativity, usual valences.
ELEMENTS = {
    "H": (1, 1, 1, 2.20, (1,)),
    "B": (5, 2, 13, 2.04, (3,)),
    "C": (6, 2, 14, 2.55, (4,)),
    "N": (7, 2, 15, 3.04, (3, 5)),
    "O": (8, 2, 16, 3.44, (2,)),
    "F": (9, 2, 17, 3.98, (1,)),
    "Na": (11, 3, 1, 0.93, (1,)),
    "Si": (14, 3, 14, 1.90, (4,)),
    "P": (15, 3, 15, 2.19, (3, 5)),
    "S": (16, 3, 16, 2.58, (2, 4, 6)),
    "Cl": (17, 3, 17, 3.16, (1,)),
    "K": (19, 4, 1, 0.82, (1,)),
    "Se": (34, 4, 16, 2.55, (2, 4, 6)),
    "Br": (35, 4, 17, 2.96, (1,)),
    "I": (53, 5, 17, 2.66, (1,)),
}
TAG = "Dy"
ATOM_FIELDS = ("number", "period", "group", "degree", "implicit_hydrogens", "hydrogens", "radicals", "charge", "hybridisation", "aromatic", "in_ring", "chiral")
BOND_FIELDS = ("kind", "stereo", "conjugated", "in_ring")
RING_FIELDS = ("size", "aromatic", "hetero", "saturated", "fused", "electronegativity")

_BRACKET = re.compile(r"\[\d*(?:[A-Z][a-z]?|[a-z][a-z]?|\*)(@*)(?:H(\d*))?(@*)([+-]\d+|\++|-+)?")
_ORDER = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5, "/": 1.0, "\\": 1.0, "~": 1.0, "$": 4.0}


def code(value, vocabulary: tuple) -> int:
    return vocabulary.index(value) if value in vocabulary else len(vocabulary)


def _marks(raw: str) -> tuple[int | None, int, bool]:
    """(hydrogens of a bracket atom or None, charge, whether a stereo mark is set)."""
    m = _BRACKET.match(raw)
    if not m:
        return None, 0, False
    sign = m.group(4) or ""
    charge = int(sign) if len(sign) > 1 and sign[1].isdigit() else sign.count("+") - sign.count("-")
    hydrogens = 0 if m.group(2) is None else int(m.group(2) or 1)
    return hydrogens, charge, bool(m.group(1) or m.group(3))


def ring_electronegativity(mean: float) -> int:
    """Bin of a mean electronegativity, half-way values to the even bin; the last code outside of [2.475, 2.975]."""
    if mean < 2.475 or mean > 2.975:
        return ELECTRONEGATIVITY_BINS
    return max(0, min(round((mean - 2.5) / 0.05), ELECTRONEGATIVITY_BINS))


@lru_cache(maxsize=1 << 16)
def atom_codes(name: str, raw: str, aromatic: bool, kinds: tuple[str, ...], in_ring: bool) -> tuple[int, ...]:
    """The 12 codes of an atom, from its symbol, its spelling and the kinds of its bonds: few of these differ."""
    number, period, group, _, valences = ELEMENTS.get(name, (0, 0, 0, 0.0, ()))
    bracket, charge, chiral = _marks(raw)
    order = sum(_ORDER[k] for k in kinds)
    if aromatic and name in ("O", "S", "Se", "N"):
        # a ring atom that gives a pair of electrons counts single bonds
        order = max(len(kinds), 3) if name == "N" and len(kinds) < 3 and bracket is None else len(kinds)
    used = int(order + 0.5) if order % 1 != 0.5 or not aromatic else int(order)
    implicit = 0
    if bracket is None and valences:
        implicit = max(0, next((v for v in valences if v >= used), used) - used)
    hydrogens = implicit + (bracket or 0)
    radicals = 0
    if bracket is not None and valences and charge == 0 and not aromatic:
        radicals = max(0, next((v for v in valences if v >= used + hydrogens), used + hydrogens) - used - hydrogens)
    hybrid = "SP" if "#" in kinds or kinds.count("=") > 1 else "SP2" if aromatic or "=" in kinds else "SP3"
    return (
        code(number, ATOMIC_NUMBERS), code(period, PERIODS), code(group, GROUPS), code(len(kinds), DEGREES), code(implicit, HYDROGENS), code(hydrogens, HYDROGENS),
        code(radicals, HYDROGENS), code(charge, CHARGES), code(hybrid, HYBRIDISATIONS), int(aromatic), int(in_ring), int(chiral),
    )


@lru_cache(maxsize=None)
def bond_codes_of(kind: str, stereo: str, conjugated: bool, in_ring: bool) -> tuple[int, ...]:
    name = {"=": "DOUBLE", "#": "TRIPLE", ":": "AROMATIC", "$": "QUADRUPLE"}.get(kind, "SINGLE")
    return code(name, BOND_TYPES), code(stereo, BOND_STEREO), int(conjugated), int(in_ring)


def coded_cells(plain: str | None) -> tuple[list[list[int]], list[tuple[int, int]], list[list[int]], list[list[int]], list[list[int]]] | None:
    """(atom codes, bonds, bond codes, rings, ring codes) of a plain spelling; None where it can't be read or only the tag is left.

    Rings list positions in ``bonds``.
    """
    found = read_line(plain)
    if found is None:
        return None
    symbols, links, cycles = found
    raw = [m.group(1) for m in TOKEN.finditer(plain) if m.group(1)]
    kept = {i: k for k, i in enumerate(i for i, s in enumerate(symbols) if s != TAG)}
    if not kept:
        return None
    names = [symbols[i] for i in kept]
    aromatic = [s[0].islower() for s in names]
    names = [s.capitalize() for s in names]
    cycles = [[kept[a] for a in c] for c in cycles if all(a in kept for a in c)]
    around: dict[tuple[int, int], int] = {}
    for c in cycles:
        for a, b in zip(c, c[1:] + c[:1]):
            around[min(a, b), max(a, b)] = around.get((min(a, b), max(a, b)), 0) + 1
    bonds, kinds = [], []
    for a, b, kind in links:
        if a in kept and b in kept:
            a, b = kept[a], kept[b]
            bonds.append((a, b))
            both = aromatic[a] and aromatic[b] and (min(a, b), max(a, b)) in around
            kinds.append(":" if kind == "-" and both else kind)
    at: list[list[int]] = [[] for _ in names]
    for k, (a, b) in enumerate(bonds):
        at[a].append(k)
        at[b].append(k)
    in_ring = {a for c in cycles for a in c}
    orders = [tuple([kinds[k] for k in own]) for own in at]
    many = ["=" in own or "#" in own or ":" in own for own in orders]
    atoms = [list(atom_codes(name, raw[j], ring, own, i in in_ring)) for i, (name, j, ring, own) in enumerate(zip(names, kept, aromatic, orders))]
    bond_codes = []
    for k, (a, b) in enumerate(bonds):
        kind = kinds[k]
        stereo = "STEREONONE"
        if kind == "=":
            left, right = ([x for x in orders[end] if x in "/\\"] for end in (a, b))
            if left and right:
                stereo = "STEREOE" if left[0] == right[0] else "STEREOZ"
        far = lambda end: any(kinds[x] in "-/\\" and many[sum(bonds[x]) - end] for x in at[end] if x != k)  # noqa: E731, B023
        conjugated = kind == ":" or (kind in "-/\\" and many[a] and many[b]) or (kind in "=#" and (far(a) or far(b)))
        bond_codes.append(list(bond_codes_of(kind, stereo, conjugated, ((a, b) if a < b else (b, a)) in around)))
    number_of = {(min(a, b), max(a, b)): k for k, (a, b) in enumerate(bonds)}
    rings, ring_codes = [], []
    for c in cycles:
        pairs = [(min(a, b), max(a, b)) for a, b in zip(c, c[1:] + c[:1])]
        rings.append([number_of[p] for p in pairs])
        hetero = sum(names[a] != "C" for a in c)
        mean = sum(ELEMENTS.get(names[a], (0, 0, 0, 0.0, ()))[3] for a in c) / len(c)
        ring_codes.append([
            code(len(c), RING_SIZES), int(all(aromatic[a] for a in c)), code(hetero, HETERO_COUNTS), int(all(kinds[k] in "-/\\" for k in rings[-1])),
            int(any(around[p] > 1 for p in pairs)), ring_electronegativity(mean),
        ])
    return atoms, bonds, bond_codes, rings, ring_codes
