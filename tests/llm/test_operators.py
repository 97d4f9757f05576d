"""The dealt operators on small fixtures: brute force, round trips, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm import collapse, cross_split, group_split, heavy, leaks, mixing, neighbours, packing, quotas, spam
from facetmill.llm.chunks import cut_chunks
from facetmill.llm.flow import Network
from facetmill.llm.spelling import plain_spelling

BASE = "CC(Cl)c1c(Br)nc(O)c1C[C@H](N)N[Dy].[Na+]"


@pytest.mark.parametrize("other", [
    "[Na+].CC(Cl)c1c(Br)nc(O)c1C[C@H](N)N[Dy]", " CC(Cl)c1c(B r)nc(O)\tc1C[C@H](N)N[Dy].[Na+]\n", "“CC(Cl)c1c(Br)nc(O)c1C[C@H](N)N[Dy].[Na+]”,,",
    "CC（Cl）c1c（Br）nc（O）c1C［C@H］（N）N［Dy］.［Na+］", "CC(CL)c1c(BR)nc(O)c1C[C@H](N)NDY.[NA+]", "C-C(Cl)c1c(br)nc(O)c1C–[C@H](N)NDy.[Na+] ;", "`CC(cl)c1c(Br)nc(O)c1C[C@h](N)N[dy].[Na+]`\t|",
])
def test_spellings_of_one_record(other):
    assert plain_spelling(other) == plain_spelling(BASE) == plain_spelling(plain_spelling(BASE))


@pytest.mark.parametrize("other", [
    "CC(Cl)c1c(Br)nc(O)c1C[C@@H](N)N[Dy].[Na+]", "CC(Cl)C1c(Br)nc(O)c1C[C@H](N)N[Dy].[Na+]", "C=C(Cl)c1c(Br)nc(O)c1C[C@H](N)N[Dy].[Na+]",
    "CC(Cl)c1c(Br)nc(O)c1C[C@H]NN[Dy].[Na+]", "CC(Cl)c1c(Br)nc([O-])c1C[C@H](N)N[Dy].[Na+]", "CCCl.c1c(Br)nc(O)c1C[C@H](N)N[Dy].[Na+]",
])
def test_other_records_stay_apart(other):
    assert plain_spelling(other) != plain_spelling(BASE)


def test_spelling_details():
    assert [plain_spelling(x) for x in (None, "", " \t\n", '",;|"', "﻿​")] == [None] * 5
    assert plain_spelling("c1ccccc1-c1ccccc1") == "c1ccccc1-c1ccccc1"
    assert plain_spelling("C-c1ccccc1") == "Cc1ccccc1" and plain_spelling("[O−]") == "[O-]" and plain_spelling("[SIH2]") == "[SiH2]"
    assert plain_spelling("[nH]1cccc1") == "[nH]1cccc1" and plain_spelling("[se]1cccc1") != plain_spelling("[Se]1cccc1")
    assert len(plain_spelling("C" * 100_000)) == 100_000


MOLECULES = "row_id long, molecule_smiles string, split string, scaffold string, lot_code string, source string, id long, plain string, n long, text string, vector string, k long"


def molecules(spark, rows):
    """Rows with columns whose names clash with names used inside the operators."""
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), 7, "x", 1, "t", "v", 2) for r in rows], MOLECULES)


def test_collapse(spark):
    rows = [(1, "CCO"), (2, " CCO "), (3, "OCC"), (4, None), (5, ""), (6, " "), (7, "CC-O"), (None, "CCO"), (8, "C" * 5000), (9, "C" * 5000 + " ")]
    rows += [(100 + i, "c1ccccc1") for i in range(200)]
    got = collapse.collapse(molecules(spark, rows), "row_id", "molecule_smiles", least=2, capacity=2)
    groups = defaultdict(set)
    for rep, i in got.members.collect():
        groups[rep].add(i)
    assert groups == {1: {1, 2, 7}, 8: {8, 9}, 100: set(range(100, 300))}
    assert {(r.rep_id, r.copies) for r in got.records.collect()} == {(1, 3), (8, 2), (100, 200)}
    assert collapse.collapse(molecules(spark, []), "row_id", "molecule_smiles").records.count() == 0


def test_radix_plan_bounds_and_trie(spark):
    dice = random.Random(1)
    keys = ["".join(dice.choice("CNO()") for _ in range(dice.randint(1, 30))) for _ in range(3000)] + ["C" * 40 + str(i) for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "plain string")
    bounds = collapse.radix_plan(df, "plain", 100)
    assert bounds == sorted(bounds)
    from bisect import bisect_right

    assert max(Counter(bisect_right(bounds, k) for k in keys).values()) <= 200
    trie = collapse.CountingTrie()
    for k in keys:
        trie.terminal(k).append(1)
    assert sorted(map(len, trie.terminals())) == sorted(Counter(keys).values())


def test_groups_and_splits(spark):
    rows = [(1, "CCO", "train", "s1", None), (2, "CCN", " Test ", "S1 ", None), (3, "CCC", "", None, "L1"), (4, "CCCC", "val", "n/a", "l1 "), (5, "CCF", "train", "unknown", "NA"), (6, "CCF.", None, None, None), (7, None, "test", None, None), (8, "CCI", "train", "s2", "L2"), (9, "CCBr", "train", "s2", "L3")]
    got = group_split.broken_ties(molecules(spark, rows), "row_id", "split", ["molecule_smiles"], ["scaffold", "lot_code"])
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (3, 3), (3, 4)]
    assert group_split.broken_ties(molecules(spark, []), "row_id", "split", ["molecule_smiles"], ["scaffold", "lot_code"]).count() == 0
    # a chain through many rows, tied hop by hop
    chain = [(i, None, "train" if i else "val", f"s{i // 2}", f"L{(i + 1) // 2}") for i in range(60)]
    got = group_split.broken_ties(molecules(spark, chain), "row_id", "split", ["molecule_smiles"], ["scaffold", "lot_code"])
    assert sorted(map(tuple, got.collect())) == [(0, i) for i in range(60)]


def test_incremental_assignment_keeps_and_quarantines(spark):
    shares = {"train": 0.5, "test": 0.5}
    first = molecules(spark, [(i, None, None, f"s{i // 2}", None) for i in range(200)])
    args = ("row_id", ["molecule_smiles"], ["scaffold", "lot_code"], shares)
    out, state = group_split.assign_splits(first, *args)
    before = {r.row_id: r.split for r in out.collect()}
    assert len(before) == 200 and all(before[i] == before[i + 1] for i in range(0, 200, 2))
    assert abs(Counter(before.values())["train"] - 100) <= 10
    a = next(i for i in range(0, 200, 2) if before[i] == "train")
    b = next(i for i in range(0, 200, 2) if before[i] == "test")
    second = molecules(spark, [(1000, None, None, f"s{a // 2}", None), (1001, None, None, f"s{a // 2}", "bridge"), (1002, None, None, f"s{b // 2}", "bridge"), (1003, None, None, "new", None)])
    c = next(i for i in range(0, 200, 2) if before[i] == "test" and i != b)
    third = molecules(spark, [(2000, None, None, f"s{c // 2}", None)])
    out, state = group_split.assign_splits(second, *args, state=state)
    after = {r.row_id: r.split for r in out.collect()}
    assert {after[i] for i in (1000, 1001, 1002)} == {"quarantine"} and after[1003] in shares
    out, state = group_split.assign_splits(third, *args, state=state)
    assert [r.split for r in out.collect()] == ["test"]
    kept = {r.component: r.split for r in state.components.collect()}
    assert kept[a] == "train" and kept[b] == "test"


def test_component_table_lasts(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert group_split.open_state(spark, path) is None
    ties = ["molecule_smiles"], ["scaffold", "lot_code"]
    first = molecules(spark, [(1, "CCO", "train", "s1", None), (2, " CCO", None, None, None), (3, "CN", "val", "s3", None), (4, "CF", "test", "s4", None), (5, "FC", "test", None, "L"), (6, "CI", None, "s6", None), (7, "CBr", "train", None, "l "), (8, None, "val", None, None)])
    state = group_split.present_table(first, "row_id", "split", *ties, path)
    assert {r.component: (r.split, r.n) for r in state.components.collect()} == {1: ("train", 2), 3: ("val", 1), 4: ("test", 1), 5: ("quarantine", 2), 6: (None, 1), 8: ("val", 1)}
    second = molecules(spark, [(10, "CN", None, None, None), (11, "x9", None, "S1", None), (12, "x8", None, "s3", "bridge"), (13, "x7", None, "s4", "bridge"), (0, "CI", None, None, None), (14, "x6", None, None, "L"), (15, "x5", None, None, None)])
    out, after = group_split.assign_splits(second, "row_id", *ties, {"train": 1, "val": 1, "test": 1}, state=group_split.open_state(spark, path))
    got = {r.row_id: (r.split, r.outcome) for r in out.collect()}
    # row 10 is tied to component 3, which the rows 12 and 13 would merge with component 4
    assert got[11] == ("train", "kept") and {got[i] for i in (10, 12, 13, 14)} == {("quarantine", "quarantined")} and got[0][1] == got[15][1] == "filled"
    group_split.save(after, path)
    again = group_split.open_state(spark, path)
    held = {r.component: r.split for r in again.components.collect()}
    assert held[1] == "train" and held[3] == "val" and held[4] == "test" and held[0] == got[0][0] and 6 not in held
    assert {(r.id, r.component) for r in again.members.collect()} >= {(11, 1), (2, 1), (6, 0), (7, 5)}
    out, _ = group_split.assign_splits(molecules(spark, [(20, "CI", None, None, None), (21, "CN", None, None, None)]), "row_id", *ties, {"train": 1}, state=again)
    assert {r.row_id: r.split for r in out.collect()} == {20: held[0], 21: "val"}


def test_overlaps_against_brute_force(spark):
    dice = random.Random(3)
    parts = ["c1c(O)cccc1", "C(=O)N", "CC", "OCC", "[C@H](C)", "S(=O)(=O)", "N(C)", "C#N", "c1nc(Cl)cn1", "B(O)O", "CCCl", "P(=O)(O)"]
    base = ["".join(dice.choice(parts) for _ in range(18)) for _ in range(120)]
    rows = []
    for i, s in enumerate(base):
        rows.append((2 * i, s, "train"))
        cut = dice.randint(0, len(s) - 12)
        rows.append((2 * i + 1, s if i % 3 == 0 else s[:cut] + dice.choice(parts) + s[cut + (i % 7) :], dice.choice(["val", "", "TEST "])))
    rows += [(900, None, "train"), (901, "", "val"), (902, "CCO", "train"), (903, "OCC", "val"), (904, "CCO ", "val"), (905, "CCO", None)]
    df = molecules(spark, rows)
    got = {(r[0], r[1]) for r in cross_split.row_pairs(cross_split.overlaps(df, "row_id", "molecule_smiles", "split")).collect()}
    plain = {r[0]: plain_spelling(r[1]) for r in rows}
    side = {r[0]: None if r[2] is None else r[2] == "train" for r in rows}
    want = set()
    for a, b in combinations(sorted(plain), 2):
        if plain[a] and plain[b] and side[a] is not None and side[b] is not None and side[a] != side[b]:
            x, y = cross_split.runs_of(plain[a]), cross_split.runs_of(plain[b])
            if plain[a] == plain[b] or len(x & y) >= 0.7 * len(x | y):
                want.add((a, b))
    assert len(want - got) <= len(want) // 50 and not got - want
    assert (902, 904) in got and cross_split.overlaps(molecules(spark, []), "row_id", "molecule_smiles", "split").links.count() == 0
    found = cross_split.overlaps(df, "row_id", "molecule_smiles", "split")
    assert sum(r.n_rows for r in cross_split.report(df, found, "row_id", "split", "source").collect()) == sum(1 for r in rows if r[2] is not None and r[2].strip().lower() != "train")


def test_overlaps_with_two_edits(spark):
    """Two separate edits of 75 characters leave a Jaccard index just above 0.7, but few whole chunks."""
    dice = random.Random(11)
    rows, want = [], set()
    for i in range(150):
        s = "".join(dice.choice("BCNOPSFI") for _ in range(75))
        t = s[:20] + ("N" if s[20] == "C" else "C") + s[21:52] + ("N" if s[52] == "C" else "C") + s[53:]
        x, y = cross_split.runs_of(s), cross_split.runs_of(t)
        rows += [(2 * i, s, "train"), (2 * i + 1, t, "test")]
        if len(x & y) >= 0.7 * len(x | y):
            want.add((2 * i, 2 * i + 1))
    got = cross_split.row_pairs(cross_split.overlaps(molecules(spark, rows), "row_id", "molecule_smiles", "split"))
    assert len(want) > 100 and {(r[0], r[1]) for r in got.collect()} == want


def test_overlap_modes_and_classes(spark):
    """Short, periodic and repeated records: the chunk join finds what the exact search finds, and classes count their links."""
    dice = random.Random(17)
    rows = []
    for i in range(120):
        s = dice.choice(["C" * dice.randint(1, 40), "CN" * dice.randint(1, 60), "".join(dice.choice("CNOPS()=") for _ in range(dice.randint(1, 200)))])
        cut = dice.randint(0, len(s))
        rows += [(4 * i, s, "train"), (4 * i + 1, s, dice.choice(["train", "val"])), (4 * i + 2, s[:cut] + dice.choice("BF") + s[cut:], "test"), (4 * i + 3, s + "C", None)]
    df = molecules(spark, rows).repartition(3)
    both = [cross_split.overlaps(df, "row_id", "molecule_smiles", "split", exact=e) for e in (False, True)]
    pairs = [{(r[0], r[1]) for r in cross_split.row_pairs(b).collect()} for b in both]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100
    plain = {r[0]: plain_spelling(r[1]) for r in rows if r[2]}
    links = defaultdict(set)
    for a, b in pairs[0]:
        links[a].add(plain[b]), links[b].add(plain[a])
    got = cross_split.linked_classes(both[0]).collect()
    assert {r.id: r.n_links for r in got} == {i: len(x) for i, x in links.items()}
    assert all(r.class_id == min(i for i, p in plain.items() if p == plain[r.id]) for r in got)


def test_salted_postings_lose_nothing(spark):
    dice = random.Random(19)
    core = "".join(dice.choice("CNOPS()=") for _ in range(60))
    rows = [(i, core[: dice.randint(30, 60)] + "".join(dice.choice("CNO") for _ in range(dice.randint(0, 25))), "train" if i % 3 else "val") for i in range(90)]
    scratch = cross_split.Scratch(spark, "salted")
    found = scratch.write(cross_split.classes(molecules(spark, rows), "row_id", "molecule_smiles", "split"), "classes")
    got = [{tuple(r) for r in cross_split.candidates(found, cross_split.Scratch(spark, "s"), 0.7, salted=n).collect()} for n in (20_000, 3)]
    assert got[0] == got[1] and len(got[0]) > 50


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_posted_meet_every_partner(least):
    """Two records of few runs that reach the limit post a common run, and the parity bits don't part them."""
    dice = random.Random(13)
    texts = ["".join(dice.choice("CN(") for _ in range(dice.randint(1, 36))) for _ in range(150)]
    texts += [t[: len(t) // 3] + "O" + t[len(t) // 3 :] for t in texts]
    full = np.full(cross_split.SEEN // 8, 255, np.uint8)
    count = np.random.default_rng(2).integers(1, 90, cross_split.COUNTERS)
    p = cross_split.posted(texts, cross_split.Costs(count, count, full, full), least)
    keys = defaultdict(set)
    for t, d in zip(p.text.tolist(), p.digest.tolist()):
        keys[t].add(d)
    runs = [cross_split.runs_of(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if len(runs[i] & runs[j]) >= least * len(runs[i] | runs[j]) and max(len(runs[i]), len(runs[j])) <= cross_split.FEWEST_RUNS:
            assert keys[i] & keys[j], (texts[i], texts[j])
            assert np.bitwise_count((p.parity[i] ^ p.parity[j]).view(np.uint64)).sum() <= len(runs[i] ^ runs[j])


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_probe_keeps_every_pair(least):
    dice = random.Random(12)
    texts = ["".join(dice.choice("CN(") for _ in range(dice.randint(1, 60))) for _ in range(150)]
    texts += [t[: len(t) // 3] + "O" + t[len(t) // 3 :] for t in texts]
    ranks = np.random.default_rng(1).permutation(cross_split.COUNTERS)
    index = cross_split.index_runs(np.arange(len(texts)), texts, ranks, least)
    got = set(zip(*map(np.ndarray.tolist, cross_split.probe(index, texts, ranks, least))))
    runs = [cross_split.runs_of(t) for t in texts]
    want = {(i, j) for i, x in enumerate(runs) for j, y in enumerate(runs) if len(x & y) >= least * len(x | y)}
    assert len(want) >= len(texts) and want <= got


def test_chunks_are_content_defined():
    text = bytes(random.Random(5).choice(b"CNOcnos()=#123") for _ in range(400))
    t, n, d = cut_chunks([b"", text, b"ab", b"XYZ" + text])
    assert set(t) == {1, 2, 3} and sum(n[t == 1]) == 400
    assert len(set(d[t == 1]) & set(d[t == 3])) >= len(d[t == 1]) - 2


@pytest.mark.parametrize("buckets", [1, 1024])
def test_frequent_values(spark, monkeypatch, buckets):
    monkeypatch.setattr(heavy, "BUCKETS", buckets)
    dice = random.Random(2)
    values = ["hot"] * 400 + [" hot"] * 300 + [f"v{dice.randint(0, 4000)}" for _ in range(3000)] + [None, "", " \t", "​"] * 50 + ["x" * 20_000] * 60
    dice.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "molecule_smiles string, value long").repartition(3)
    counts = Counter(v for v in values if v and re.sub(r"[\s​]", "", v))
    want = {(v, n) for v, n in counts.items() if n >= 0.01 * sum(counts.values())}
    assert set(map(tuple, heavy.frequent_values(df, "molecule_smiles", 0.01).collect())) == want
    assert heavy.frequent_values(df.limit(0), "molecule_smiles", 0.01).count() == 0


def test_top_values_bounds(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(50) for _ in range(50 - i)], "v string")
    top = heavy.top_values(df, "v", 5).collect()
    assert [r.value for r in top] == ["v0", "v1", "v2", "v3", "v4"] and all(r.approx_count <= 50 - i <= r.upper for i, r in enumerate(top))


def test_nearest_recall_ties_and_copies(spark):
    dice = np.random.default_rng(1)
    centres = dice.random((60, 2048)) < 0.06
    rows = [(c ^ (dice.random(2048) < 0.004)) for c in centres for _ in range(6)]
    vectors = [np.packbits(r).tobytes() for r in rows] + [np.packbits(centres[0]).tobytes()] * 12
    data = [(i, v, "id") for i, v in enumerate(vectors)] + [(5, vectors[5], "id"), (9000, bytes(256), "z"), (9001, None, "n"), (None, vectors[0], "n"), (9002, b"ab", "s")]
    df = spark.createDataFrame(data, "row_id long, fps binary, vector string")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, "row_id", "fps", 3, 0.6).collect():
        got[r.id][r.nth] = r.other
    m = np.array([np.unpackbits(np.frombuffer(v, np.uint8)) for v in vectors], float)
    both = m @ m.T
    s = both / (m.sum(1)[:, None] + m.sum(1)[None] - both)
    np.fill_diagonal(s, -1)
    hit = total = 0
    for i in range(len(vectors)):
        order = [j for j in sorted(range(len(vectors)), key=lambda j: (-s[i, j], j))[:3] if s[i, j] >= 0.6]
        total += len(order)
        hit += len(set(order) & set(got[i].values()))
    assert hit / total >= 0.97
    assert got[len(vectors) - 1] == {1: 360, 2: 361, 3: 362} and not {9000, 9001, 9002} & set(got)
    assert neighbours.nearest(df.limit(0), "row_id", "fps").count() == 0


def test_windows_do_not_depend_on_ranges(spark):
    dice = np.random.default_rng(5)
    centres = dice.random((40, 2048)) < 0.06
    data = [(i, np.packbits(centres[i % 40] ^ (dice.random(2048) < 0.004)).tobytes()) for i in range(400)]
    ready = neighbours.prepare(spark.createDataFrame(data, "id long, v binary"), "id", "v", 256, 3, neighbours.COORDINATES, 7).cache()
    found = [{tuple(r) for r in neighbours.window_pairs(ready, n, 4, 0.6, neighbours.Scratch(spark, "w")).collect()} for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) > 300


def test_curves_beat_hashed_cells():
    """With the place on the curve replaced by a hash, near vectors lie together only where all coordinates are equal."""
    dice = np.random.default_rng(6)
    centres = dice.random((1500, 2048)) < 0.05
    rows = np.packbits(np.concatenate([centres, centres ^ (dice.random(centres.shape) < 0.02)]), axis=1)
    keys = neighbours.curve_keys(rows, 3, neighbours.COORDINATES, 7)
    hashed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys.astype(np.uint64) >> np.uint64(17))

    def met(k):
        out = np.zeros(len(centres), bool)
        for c in range(k.shape[1]):
            place = np.empty(len(rows), int)
            place[np.argsort(k[:, c], kind="stable")] = np.arange(len(rows))
            out |= np.abs(place[: len(centres)] - place[len(centres) :]) <= neighbours.WINDOW
        return out.mean()

    assert met(keys) > met(hashed) + 0.1


def test_hilbert_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = neighbours.hilbert(grid, 3)
    assert sorted(at) == list(range(512)) and np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1).max() == 1


def test_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (3, None), (4, ""), (5, " ".join(f"É{i}" for i in range(20)))], "item_id long, text string")
    noise = [f"n{i}" for i in range(300)]
    docs = [
        (1, " ".join(noise[:50] + words[7:20] + noise[50:])), (2, " ".join(noise[:50] + words[7:19] + noise[50:])), (3, "-- ".join(w.upper() + "," for w in words)),
        (4, None), (5, ""), (6, " ".join(reversed(words))), (7, " ".join(noise * 400 + words[40:53])), (8, "_".join(f"é{i}" for i in range(14))), (None, " ".join(words)),
    ]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item_id int, lang string")
    got = leaks.leaked_windows(df, "doc_id", "text", items, "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.where("n_equal > 0").collect()} == {(1, 1), (3, 1), (7, 1), (8, 5)}
    blocked = leaks.leaked_windows(df, "doc_id", "text", items, "item_id", "text", block_items=1)
    assert {(r.doc_id, r.item_id) for r in blocked.where("n_equal > 0").collect()} == {(1, 1), (3, 1), (7, 1), (8, 5)}
    assert leaks.leaked_windows(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leaks.leaked_windows(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_near_windows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PAIRS", 500)
    dice = random.Random(21)
    texts = [[f"w{dice.randint(0, 400)}" for _ in range(dice.randint(40, 99))] for _ in range(12)]
    texts[5][10:25] = texts[6][10:25] = texts[7][20:35] = ["the"] * 6 + ["same", "start", "of", "an", "item"] + ["x"] * 4
    docs = []
    for i, t in enumerate(texts):
        edited = list(t)
        for at in range(12, len(t), 13):
            edited[at] = f"z{at}"
        docs += [(3 * i, edited), (3 * i + 1, t[:20] + ["in", "between"] + t[20:]), (3 * i + 2, [f"w{dice.randint(0, 400)}" for _ in range(80)])]
    got = leaks.leaked_windows(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), "doc_id", "text",
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "item_id long, text string"), "item_id", "text",
    )
    index = leaks.build_index([(i, " ".join(w)) for i, w in enumerate(texts)], 13, 5, 2)
    want = Counter()
    for d, words in docs:
        for at in range(len(words) - 12):
            window = tuple(words[at : at + 13])
            want.update((d, int(index.items[k])) for k, w in enumerate(index.words) if leaks.shingle_similarity(window, w, 5, index.weights, index.most) >= 0.8)
    assert {(r.doc_id, r.item_id): r.n_windows for r in got.collect()} == want
    # one other word in every 13: no window is whole, and still each item is reported
    assert {(3 * i, i) for i in range(12)} <= set(want)


def test_window_prints_match_plain_simhash():
    words = [f"w{i % 9}" for i in range(40)]
    signs = leaks.Signs(13)
    fast = leaks.window_prints(signs.of(words), 13)
    slow = [np.packbits(signs.of(words[i : i + 13]).astype(int).sum(0) > 0).view(np.uint64)[0] for i in range(28)]
    assert list(fast) == slow


def test_flow_is_cheapest():
    net = Network()
    cheap, dear = net.arc("s", "a", 3, 1), net.arc("s", "b", 5, 4)
    net.arc("a", "t", 2), net.arc("b", "t", 9), net.arc("a", "b", 9, 1)
    assert net.send("s", "t", 6) == 6 and (net.flow(cheap), net.flow(dear)) == (3, 3)


def test_quotas_and_draw(spark):
    rows = [(i, "BRD4" if i % 3 else "h s-a", i % 2) for i in range(300)] + [(0, "h s-a", 0), (400, "misc", 1), (401, None, 1), (402, "BRD4", 255), (403, "BRD4", None), (None, "HSA", 1)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, protein_name string, binds int, category string, label int")
    usable = quotas.usable_rows(df, "id", "protein_name", "binds", ["BRD4", "HSA"])
    assert usable.count() == 300
    plans = spark.createDataFrame([(1, "BRD4", 0, 0.5, 0.5, 0), (1, "HSA", 1, 0.45, 0.5, 60), (1, "XX", 1, 0.05, 0.5, None), (2, "BRD4", 1, 0.333, 0.1, 0), (2, "HSA", 1, 0.667, 0.1, 0), (None, "HSA", 1, 1.0, 1.0, 0)], "p long, c string, l int, s double, f double, m int")
    report = quotas.plan_report(usable, plans, "p", "c", "l", "s", "f", "m")
    by = {r[:3]: r for r in report}
    assert by[1, "HSA", 1][6] == 18 and by[1, "HSA", 1][5] == 50 and by[1, "XX", 1][6] == 8 and by[1, "BRD4", 0][6] == 0
    assert by[2, "BRD4", 1][5] + by[2, "HSA", 1][5] == 30
    drawn = quotas.draw(usable, spark.createDataFrame(report, quotas.REPORT))
    got = Counter((r.plan_id, r.category, r.label) for r in drawn.collect())
    assert got == {k: r[5] for k, r in by.items() if r[5]} and drawn.distinct().count() == drawn.count()
    assert quotas.plan_report(usable, plans.limit(0), "p", "c", "l", "s", "f", "m") == []
    assert all(r[5] == 0 for r in quotas.plan_report(usable.limit(0), plans, "p", "c", "l", "s", "f", "m"))


def test_quotas_hold_their_margins():
    """A short cell is made up within its row and column, and a floor is taken from them: cell by cell the quotas would differ."""
    cells = {("A", 0): (40.0, 0), ("A", 1): (10.0, 0), ("B", 0): (30.0, 0), ("B", 1): (20.0, 0)}
    many = dict.fromkeys(cells, 100)
    for available, floors in (({**many, ("A", 1): 4}, {}), (many, {("A", 1): 25}), ({**many, ("B", 0): 28}, {("A", 1): 4})):
        wanted = {c: (t, floors.get(c, 0)) for c, (t, _) in cells.items()}
        got = quotas.draw_quotas(wanted, available, 1)
        assert [sum(n for c, n in got.items() if c[0] == r) for r in "AB"] == [50, 50] and [sum(n for c, n in got.items() if c[1] == k) for k in (0, 1)] == [70, 30]
        assert all(min(floors.get(c, 0), available[c]) <= n <= available[c] for c, n in got.items())
    thirds = {("A", 0): (1.4, 0), ("A", 1): (1.3, 0), ("B", 0): (1.3, 0)}
    draws = Counter(tuple(quotas.draw_quotas(thirds, many, seed).values()) for seed in range(60))
    assert all(sum(d) == 4 and set(d) <= {1, 2} for d in draws) and len(draws) == 3
    # floors that need more than the sample, and cells with nothing at all
    assert quotas.draw_quotas({("A", 0): (1.0, 5), ("A", 1): (1.0, 0)}, many, 1) == {("A", 0): 5, ("A", 1): 0}
    assert quotas.draw_quotas(cells, {}, 1) == dict.fromkeys(cells, 0)


def test_packing_round_trip(spark):
    dice = random.Random(4)
    texts = ["x" * dice.randint(1, 60) for _ in range(400)] + ["y" * 1234, None, "", " \t​", "z z " * 40, "y" * 100]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "abc", 1)], "row_id long, molecule_smiles string, n int")
    placed = packing.pack(df, "row_id", "molecule_smiles", {1: 100, 2: 64}, shard_rows=150)
    rows = placed.collect()
    for limit, cap in ((1, 100), (2, 64)):
        own = [r for r in rows if r.limit_id == limit]
        held = Counter()
        pieces = defaultdict(list)
        for r in own:
            held[r.container] += r.length
            pieces[r.id].append((r.start, r.length))
        assert max(held.values()) <= cap
        size = {i: len(re.sub(r"[\s​]", "", t)) for i, t in enumerate(texts) if t and re.sub(r"[\s​]", "", t)}
        assert {i: sum(n for _, n in p) for i, p in pieces.items()} == size
        assert {i for i, p in pieces.items() if len(p) > 1} == {i for i, n in size.items() if n > cap}
        for p in pieces.values():
            assert [s for s, _ in sorted(p)] == [cap * k for k in range(len(p))]
        assert 1 - sum(held.values()) / cap / len(held) < 0.12
    assert packing.pack(df.limit(0), "row_id", "molecule_smiles", {1: 100}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "row_id", "molecule_smiles", {1: 0})


def test_mixing(spark):
    rows = [(i, f"t{i} " * 10, s) for i, s in enumerate(["lab_note", "Lab Note", "forum", "forum", "FORUM ", None, "", "web"])] + [(8, "t0 " * 10, "web"), (9, None, "web"), (None, "x", "web")]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id long, text string, source string, n_tokens int, pattern string")
    single = mixing.memberships(df, "doc_id", "text", "source", mixing.blank_tokens(df["text"]), merge=False)
    targets = spark.createDataFrame([(1, "lab_note", 0.8, 2, 1.0), (1, "forum", 0.2, 1, 1.0), (2, "none", 1.0, 3, 0.1), (3, None, 1.0, 1, 1.0)], "recipe_id long, source string, target_share double, max_repeats int, total_factor double")
    report, flows = mixing.mix_report(single, targets)
    assert {(r[0], r[1]): r[2:5] for r in report} == {(1, "lab_note"): (56, 40, 16), (1, "forum"): (14, 14, 0), (2, "none"): (7, 0, 7)}
    merged = mixing.memberships(df, "doc_id", "text", "source", mixing.blank_tokens(df["text"]), merge=True)
    assert sorted(map(tuple, (r.pattern for r in merged.collect())))[0] == ("forum",) and {tuple(r.pattern) for r in merged.collect()} >= {("labnote", "web")}
    taken = mixing.select_documents(single, spark.createDataFrame(flows, mixing.FLOWS))
    got = Counter()
    for r in taken.collect():
        got[r.recipe_id, r.source] += r.copies * r.n_tokens
    assert got == {(1, "lab_note"): 40, (1, "forum"): 20} or got == {(1, "lab_note"): 40, (1, "forum"): 10}
    assert mixing.mix_report(single.limit(0), targets)[0][0][3] == 0 and mixing.mix_report(single, targets.limit(0)) == ([], [])


PROSE = "The weak fit of the compound was seen near the detection limit and in the pilot library. We therefore trust the kinetic trace more than the plate read. "


def test_sentences_and_words():
    assert spam.in_sentences("") == 0 and spam.in_sentences(PROSE) > 0.9
    for page in ("buy mibrotexin best mibrotexin mibrotexin online " * 20, "\n".join(f"cheap compound library Town{i}" for i in range(40)), "#loop #helix #pocket " * 20, "A - 5.70 | in stock | EUR 3.20\n" * 20):
        assert spam.in_sentences(page) < 0.1, page
    assert spam.words_of("A-b 7.2 Éa_x") == ["a", "b", "7", "2", "éa", "x"] and spam.words_of("A-b 7.2") == ["a", "b", "7", "2"]


def test_fits_against_numpy(spark, tmp_path):
    dice = random.Random(9)
    texts = [" ".join(dice.choices([f"w{k}" for k in range(40)], weights=[1 / (k + 1) for k in range(40)], k=dice.randint(1, 300))) for _ in range(30)] + ["one", "one one one", "a b c d"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    pages = spam.page_counts(df, "doc_id", "text", "lang", spam.Scratch(spark, "fits"))
    got = {r.doc_id: (r.slope, r.residual) for r in pages.join(spam.page_fits(pages), "page").collect()}
    for i, t in enumerate(texts):
        n = np.array(sorted(Counter(t.split()).values(), reverse=True), float)
        rank = np.array([np.mean(np.flatnonzero(n == x) + 1) for x in n])
        x, y = np.log(rank), np.log(n / n.sum())
        slope = np.cov(x, y, bias=True)[0, 1] / x.var() if x.var() > 1e-9 else 0.0
        assert np.allclose(got[i], (slope, np.sqrt(np.mean((y - y.mean() - slope * (x - x.mean())) ** 2))), atol=1e-6)


def test_spam_pages(spark):
    dice = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    prose = lambda: " ".join(" ".join(["the", "of", *dice.sample(vocabulary, 8), "and", "the", "in"]) + "." for _ in range(dice.randint(5, 15)))
    rows = [(i, prose().capitalize(), dice.choice(["en", "EN", "en-EN"])) for i in range(300)]
    rows += [(1000, "buy zork best zork zork online " * 30, "en"), (1001, "zork " * 200, None), (1002, None, "en"), (1003, "", "en"), (1004, " ... ", "de"), (None, "zork " * 100, "en"), (1005, "#a1 #b2 #c3 #d4 " * 30, "fr")]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, lang string, n int, word string")
    assert {r.doc_id for r in spam.spam_pages(df, "doc_id", "text", "lang").collect()} == {1000, 1001, 1005}
    assert spam.spam_pages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_spam_pages_of_a_link_farm(spark):
    """A third of all rows, of one language and length, from one farm: alike pages that are no exception in their class."""
    dice = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)]
    prose = lambda: " ".join(" ".join(["The", "of", *dice.sample(vocabulary, 8), "and", "the", "in"]) + "." for _ in range(9))
    farm = lambda: "\n".join(f"cheap {dice.choice(vocabulary)} https://farm.example/{dice.randint(0, 999)}" for _ in range(20))
    rows = [(i, prose() if i % 3 else farm(), "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in spam.spam_pages(df, "doc_id", "text", "lang").collect()} == {i for i in range(0, 300, 3)}


def test_merged_tokens(spark):
    rows = [(i, "same text again", "Web") for i in range(5)] + [(9, "same text again", "books"), (10, "other", " web"), (11, None, "web"), (None, "other", "web"), (12, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.merged_away(df, "doc_id", "text", "source", mixing.blank_tokens(F.col("text")))
    assert {r.key: r.merged_tokens for r in got.collect()} == {"web": 12, "books": 0}


def test_pairs_are_compared_in_small_slices(spark):
    """Exact comparison of more pairs than one slice, the last slice not full, against sets of runs."""
    dice = np.random.default_rng(11)
    n = 2 * cross_split.COMPARED + 3
    texts = ["".join(dice.choice(list("CNO=()"), 40)) for _ in range(n)]
    others = [t[: int(k)] + "S" + t[int(k) + 1 :] for t, k in zip(texts, dice.integers(0, 40, n))]
    rows = [(i, 0, i, 1, t, o) for i, (t, o) in enumerate(zip(texts, others))]
    df = spark.createDataFrame(rows, "ta long, tb long, ea long, eb long, plain_t string, plain_e string").coalesce(1)
    share = lambda a, b: len(a & b) / len(a | b)
    want = {i: share(cross_split.runs_of(t), cross_split.runs_of(o)) for i, (t, o) in enumerate(zip(texts, others))}
    got = {r.ta: r.jaccard for r in cross_split.verify(df, 0.75).collect()}
    assert 0 < len(got) < n and got.keys() == {i for i, x in want.items() if x >= 0.75 - 1e-9} and all(abs(got[i] - want[i]) < 1e-12 for i in got)
