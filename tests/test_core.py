"""Core operators on fixtures with known values, and every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.functions import codes, lines
from facetmill.functions.columns import bucket_hops, code_of, electronegativity_code, recode_hops
from facetmill.operators import batching, complexes, features, graph_algos, inference, losses, messages, sampling, scoring, setsim, stats
from facetmill.operators.components import connected_components
from facetmill.plans import catalog
from facetmill.plans.config import Config, parse
from facetmill.sources import stores
from facetmill.streaming import ingest

DATA = "/root/testdata/sf0.001"

GRAPHS = {
    1: ("path", [(0, 1), (1, 2)], []),
    2: ("triangle", [(0, 1), (1, 2), (0, 2)], [[(0, 1), (1, 2), (0, 2)]]),
    3: ("square", [(0, 1), (1, 2), (2, 3), (0, 3)], [[(0, 1), (1, 2), (2, 3), (0, 3)]]),
    4: ("two triangles", [(0, 1), (1, 2), (0, 2), (1, 3), (2, 3)], [[(0, 1), (1, 2), (0, 2)], [(1, 3), (2, 3), (1, 2)]]),
    5: ("star", [(0, 1), (0, 2), (0, 3)], []),
    6: ("apart", [(0, 1), (2, 3)], []),
}
SPECTRA = {1: [0, 1, 2], 2: [0, 1.5, 1.5], 3: [0, 1, 1, 2], 4: [0, 1, 4 / 3, 5 / 3], 5: [0, 1, 1, 2], 6: [0, 0, 2, 2]}
LINKS = {1: 4, 2: 12, 3: 16, 4: 22, 5: 6, 6: 4}
BACK2 = {1: [0.5, 1, 0.5], 2: [0.5] * 3, 3: [0.5] * 4, 4: [1 / 3, 4 / 9, 4 / 9, 1 / 3], 5: [1, 1 / 3, 1 / 3, 1 / 3], 6: [1] * 4}
BACK3 = {1: [0] * 3, 2: [0.25] * 3, 3: [0] * 4, 4: [1 / 9, 2 / 9, 2 / 9, 1 / 9], 5: [0] * 4, 6: [0] * 4}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, a, b) for g, (_, e, _) in GRAPHS.items() for u, v in e for a, b in ((u, v), (v, u))]
    return spark.createDataFrame(rows, "g long, u long, v long").cache()


@pytest.fixture(scope="module")
def faces(spark):
    return spark.createDataFrame([(g, i, u, v) for g, (_, _, f) in GRAPHS.items() for i, ring in enumerate(f) for u, v in ring], "g long, face long, u long, v long")


def test_skeleton_and_laplacian(edges, faces):
    n = {r.g: r["count"] for r in complexes.bary_skeleton(edges, faces).groupBy("g").count().collect()}
    assert n == LINKS
    for g, values in SPECTRA.items():
        m = np.zeros((4, 4))
        for r in complexes.normalised_laplacian(edges.where(F.col("g") == g)).collect():
            m[r.u, r.v] = r.w
        k = len(values)
        assert np.allclose(np.linalg.eigvalsh(m[:k, :k]), values, atol=1e-9)


def test_hops_and_walks(edges):
    joined = {(r.g, r.u, r.v): r.d for r in graph_algos.hops_by_frontier(edges).collect()}
    dense = {(r.g, r.u, r.v): r.d for r in graph_algos.hops_by_graph(edges).collect()}
    assert joined == {k: d for k, d in dense.items() if d > 0}
    assert dense[4, 0, 3] == 2 and dense[6, 0, 2] == -1 and dense[5, 1, 2] == 2 and dense[1, 0, 0] == 0
    back = {(r.g, r.u, r.k): r.p for r in graph_algos.returns_by_join(edges, 3).collect()}
    whole = {(r.g, r.u): r.p for r in graph_algos.returns_by_graph(edges, 3).collect()}
    for g in GRAPHS:
        for k, want in ((2, BACK2[g]), (3, BACK3[g])):
            assert np.allclose([back[g, u, k] for u in range(len(want))], want) and np.allclose([whole[g, u][k - 1] for u in range(len(want))], want)


def test_encodings(edges, faces):
    for r in graph_algos.laplacian_encodings(edges).collect():
        kept = [v for v in SPECTRA[r.g] if v > 1e-10]
        assert np.allclose(r["values"], [*(np.array(kept) / max(kept)), *[0] * (7 - len(kept))])
    cells = graph_algos.bary_encodings(complexes.bary_skeleton(edges, faces)).collect()
    assert all(0 <= x <= 1 for r in cells for x in r["values"]) and {r.cell for r in cells if r.g == 2} == {"n:0", "n:1", "n:2", "e:0-1", "e:0-2", "e:1-2", "f:0"}


def test_recoded_hops(spark):
    d = spark.createDataFrame([(0, True), (3, False), (-1, False), (60, False)], "d int, same boolean")
    code = recode_hops(F.col("d"), F.col("same"))
    assert [r[0] for r in d.select(code).collect()] == [0, 4, -1, 61] and [r[0] for r in d.select(bucket_hops(code, 35)).collect()] == [0, 4, 37, 36]


def test_line_reader(spark):
    atoms, bonds, rings = lines.read_line("C1CC1C(=O)O.[Na+]")
    assert atoms == ["C", "C", "C", "C", "O", "O", "Na"] and (3, 4, "=") in bonds and sorted(rings[0]) == [0, 1, 2] and len(bonds) == 6
    assert all(lines.read_line(x) is None for x in (None, "", "C(", "C1CC", "C)", "1C", "Q", "C(C"))
    df = spark.createDataFrame([(1, "c1ccccc1"), (2, None), (3, "C("), (None, "C")], "row_id long, s string")
    found = lines.complexes(df, "row_id", "s")
    assert lines.faces_of(found).count() == 6 and lines.edges_of(found).count() == 6
    assert {r.row_id for r in lines.unreadable(df.where("row_id is not null"), found, "row_id").collect()} == {2, 3}
    nested = graph_algos.nested_encodings(found).first()
    assert nested.n == 6 and max(nested.hops) == 3 and np.allclose(nested.returns[1], 0.5)
    out = inference.nested_forward(found, inference.Block()).first()
    same = inference.forward(lines.edges_of(found), inference.Block()).first()
    assert math.isclose(out.logit, same.logit) and np.allclose(out.embedding, same.embedding)


def test_average_precision(spark):
    rows = [("a", 0, 0.1), ("a", 0, 0.4), ("a", 1, 0.35), ("a", 1, 0.8), *(("b", y, 0.5) for y in (1, 1, 0, 0)), ("c", 0, 0.3), ("d", 1, 1e-9), ("d", 0, -5.0)]
    got = {r.g: r.ap for r in scoring.average_precision(spark.createDataFrame(rows, "g string, y int, score double"), ["g"]).collect()}
    assert math.isclose(got["a"], 5 / 6) and got["b"] == 0.5 and got["c"] == 0 and got["d"] == 1
    dice = np.random.default_rng(0)
    y, s = dice.integers(0, 2, 500), np.round(dice.random(500) * 3 - 1, 2)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)], "g int, y int, score double")
    want = sum((y[s == t].sum() / y.sum()) * (y[s >= t].mean()) for t in np.unique(s))
    assert math.isclose(scoring.average_precision(df, ["g"]).first().ap, want)


def test_components(spark):
    dice = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in dice.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {x: x for p in pairs if None not in p for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent if any(find(y) == find(x) for y in parent if y != x)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i * 3, int(i < 5), int(i % 2)) for i in range(100)], "k long, a int, b int")
    got = {r.k for r in sampling.quota_sample(df, "k", ["a", "b"], 30, 5, 1).collect()}
    assert len(got) == 30 and {0, 3, 6, 9, 12} <= got
    with pytest.raises(ValueError):
        sampling.quota_sample(df, "k", ["a"], 30, 6, 1)
    with pytest.raises(ValueError):
        sampling.quota_sample(df, "k", ["a", "b"], 3, 5, 1)
    idx = {r.k: r.idx for r in sampling.dense_index(df, "k", block=7).collect()}
    assert idx == {i * 3: i for i in range(100)}
    ids = spark.createDataFrame([(0, 9), (1, 3), (2, 9)], "at int, i long")
    assert sorted((r["at"], r.k) for r in sampling.gather(df, "k", ids, "i", "at").collect()) == [(0, 9), (1, 3), (2, 9)]


def test_line_reader_takes_every_spelling(spark):
    base = "CC(Cl)c1c(Br)cccc1N[Dy]"
    forms = [base, f" {base}\n", "CC(Cl)c1c(B\u200br)cccc1N[Dy]", "\u201cCC\uff08Cl\uff09c1c(Br)cccc1N[Dy]\u201d;", "CC(CL)c1c(br)cccc1NDY", "C\u2013C(Cl)c1c(Br)cccc1N[dy]"]
    df = spark.createDataFrame([*enumerate(forms), (90, "C("), (91, None), (92, " "), (None, "C")], "row_id long, s string")
    found = lines.complexes(df, "row_id", "s")
    got = {r.g: (r.atoms, r.bonds, r.rings) for r in found.collect()}
    assert set(got) == set(range(len(forms))) and all(x == got[0] for x in got.values())
    assert {r.row_id for r in lines.unreadable(df, found, "row_id").collect()} == {90, 91, 92, None}


def test_unreadable_molecules_are_reported(spark, tmp_path):
    spark.createDataFrame([(1, "CCDy "), (2, "C(")], "row_id long, molecule_smiles string").write.parquet(str(tmp_path / "molecules.parquet"))
    assert [r.row_id for r in catalog.queries()["molecule_unreadable"](spark, str(tmp_path)).collect()] == [2]


def test_similarity(spark):
    dice = np.random.default_rng(2)
    v = [np.packbits(dice.random(2048) < 0.05).tobytes() for _ in range(40)] + [bytes(256)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "row_id long, fps binary")
    m = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in v], float)
    both = m @ m.T
    union = m.sum(1)[:, None] + m.sum(1)[None] - both
    s = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    best = {r.row_id: r.best for r in setsim.nearest_similarity(df.where("row_id < 10"), df.where("row_id >= 10"), "row_id", "fps", block=4).collect()}
    assert np.allclose([best[i] for i in range(10)], s[:10, 10:].max(1), atol=1e-6)
    d = setsim.discrepancy(df.where("row_id < 15"), df.where("row_id >= 15"), "row_id", "fps").first()
    x, y = s[:15, :15], s[15:, 15:]
    off = lambda a: (a.sum() - np.trace(a)) / (len(a) * (len(a) - 1))
    assert np.allclose([d.exx, d.eyy, d.exy], [off(x), off(y), s[:15, 15:].mean()], atol=1e-6)
    assert setsim.nearest_similarity(df.limit(0), df, "row_id", "fps").count() == 0


def test_discrepancy_takes_all_rows(spark):
    """More rows than any cap on a side: few different vectors, so that the means follow from their counts."""
    v = [bytes([255] * 32 + [0] * 224), bytes([15] * 32 + [0] * 224), bytes(256)]
    n_a, n_b = 50_400, 30
    a = spark.range(n_a).select(F.col("id").alias("row_id"), F.when(F.col("id") < n_a - 400, F.lit(v[0])).otherwise(F.lit(v[1])).alias("fps"))
    b = spark.createDataFrame([(i, v[2] if i < 10 else v[1]) for i in range(n_b)], "row_id long, fps binary")
    d = setsim.discrepancy(a, b, "row_id", "fps").first()
    p, q = n_a - 400, 400
    exx = (p * (p - 1) + q * (q - 1) + p * q) / (n_a * (n_a - 1))
    assert (d.n_a, d.n_b) == (n_a, n_b) and np.isclose(d.exx, exx, atol=1e-9)
    assert np.isclose(d.eyy, 20 * 19 / (30 * 29), atol=1e-9) and np.isclose(d.exy, (p * 20 * 0.5 + q * 20) / (n_a * n_b), atol=1e-9)


def test_discrepancy_in_blocks(spark):
    dice = np.random.default_rng(4)
    df = spark.createDataFrame([(i, np.packbits(dice.random(2048) < 0.05).tobytes()) for i in range(60)], "row_id long, fps binary")
    a, b = df.where("row_id < 40"), df.where("row_id >= 40")
    whole, cut = (setsim.discrepancy(a, b, "row_id", "fps", block=n).first() for n in (4096, 7))
    assert np.allclose(list(whole), list(cut), atol=1e-12)


def test_packing_rules(spark):
    rows = [(0, 5, 1), (1, 5, 1), (2, 30, 1), (3, 4, 1), (4, 4, 50), (5, 1, 1), (6, 1, 1), (7, 1, 1), (8, 1, 1)]
    got = batching.token_buckets(spark.createDataFrame(rows, "k long, n long, e long"), "k", "n", "e", 10, 20, 3).collect()
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(r.k)
    assert [sorted(v) for _, v in sorted(batches.items())] == [[0, 1], [2], [3], [4], [5, 6, 7], [8]]


def test_early_stopping_and_losses(spark):
    log = spark.createDataFrame([("a", i, x) for i, x in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])] + [("b", 0, 1.0)], "run string, epoch long, loss double")
    got = {r.run: (r.best_epoch, r.stop_epoch) for r in stats.early_stopping(log, "run", "epoch", "loss", 2).collect()}
    assert got == {"a": (1, 3), "b": (0, None)}
    z = spark.createDataFrame([(0.0, 255), (0.0, 1), (800.0, 1), (-800.0, 0)], "z double, y int")
    assert z.select(losses.label(F.col("y"))).first()[0] is None and z.select(losses.label(F.col("y"), True)).first()[0] == 1
    assert all(r[0] is None or math.isfinite(r[0]) for r in z.select(losses.weighted_bce(F.col("z"), losses.label(F.col("y")))).collect())
    e = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("x", [1.0, 0.0]), ("y", [2.0, 2.0])], "g string, v array<double>")
    assert {r.g: round(r.cosine, 9) for r in messages.mean_pairwise_cosine(e, ["g"], "v").collect()} == {"x": round(1 / 3, 9), "y": 1.0}


def test_codes(spark):
    one = spark.createDataFrame([("b",), ("zz",), (None,)], "v string")
    assert [r[0] for r in one.select(code_of(F.col("v"), ["a", "b", "misc"])).collect()] == [1, 2, 2]
    e = spark.createDataFrame([(2.5,), (2.525,), (2.575,), (2.2,), (3.2,)], "x double")
    assert [r[0] for r in e.select(electronegativity_code(F.col("x"))).collect()][3:] == [11, 11]


def test_stores_and_config(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, float("nan"), [1.0, float("inf")])], "variance int, sigma double, model_score double, mean_curves array<double>")
    stores.write_row_log(df, f"{tmp_path}/log")
    row = stores.read_row_log(spark, f"{tmp_path}/log").first()
    assert (row.variance, row.sigma, row.model_score, row.mean_curves) == (1, 0.5, None, [1.0, None])
    folder = stores.write_cache(df, str(tmp_path), "train", 2048, "abcdef0123456789")
    rows, meta = stores.read_cache(spark, folder)
    assert rows.count() == 1 and meta["bits"] == 2048 and "train-b2048" in folder
    docs = spark.createDataFrame([('{"stats": {"h": [1.0, 2.0]}}',), ('{"h": [3.0]}',)], "j string")
    assert [r[0]["h"] for r in docs.select(stores.statistics(F.col("j"))).collect()] == [[1.0, 2.0], [3.0]]
    (tmp_path / "ids.json").write_text("[5, 3, 5]")
    assert [(r["at"], r.id) for r in stores.read_id_list(spark, f"{tmp_path}/ids.json").collect()] == [(0, 5), (1, 3), (2, 5)]
    assert [r.line for r in stores.report_lines(spark.createDataFrame([(0.5, None)], "a double, b double"), "x").collect()] == ["x | a: 0.5000", "x | b: NA"]
    stores.write_shards(df.withColumn("chunk", F.lit(2)), f"{tmp_path}/shards", "chunk")
    assert stores.read_shards(spark, [f"{tmp_path}/shards"], 1).first().chunk == 2
    config = parse(["--no-face", "--loss", "FOCAL", "--variance", "3"])
    assert config.checkpoint("/r") == "/r/bary_attn/focal/var3" and config.least_positives == 1000 and Config().most_hops == 55


def test_stream(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/bindings.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = source.schema.simpleString()[len("struct<") : -1]
    once = ingest.deliver_once(ingest.read_stream(spark, f"{tmp_path}/in", source.schema, 1), "id", "ingested_at", "500 weeks")
    ingest.write_stream(once, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert schema and spark.read.parquet(f"{tmp_path}/out").count() == source.select("id").distinct().count()
    ingest.write_stream(ingest.windowed_labels(ingest.read_stream(spark, f"{tmp_path}/in", source.schema), "measured_at", "protein_name", "binds"), f"{tmp_path}/w", f"{tmp_path}/wc").awaitTermination()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    if name == "quota_sample":
        pytest.skip("the smallest tables hold too few positives for the production quota")
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_codes_of_cells():
    atoms, bonds, bond_codes, rings, ring_codes = codes.coded_cells("Cc1ccncc1[Dy]")
    assert len(atoms) == 7 and len(bonds) == 7 and [len(r) for r in rings] == [6]
    by = dict(zip(codes.ATOM_FIELDS, zip(*atoms)))
    # methyl carbon, ring carbon with the methyl, ring nitrogen
    assert by["number"] == (1, 1, 1, 1, 2, 1, 1) and by["implicit_hydrogens"] == (3, 0, 1, 1, 0, 1, 1) and by["aromatic"] == (0, 1, 1, 1, 1, 1, 1)
    assert by["hybridisation"][:2] == (2, 1) and by["degree"] == (1, 3, 2, 2, 2, 2, 2)
    assert bond_codes[0] == [0, 0, 0, 0] and bond_codes[1] == [3, 0, 1, 1]
    # six members, aromatic, one hetero atom, not saturated, not fused, mean electronegativity 2.63
    assert ring_codes == [[3, 1, 1, 0, 0, 3]]
    assert codes.coded_cells("F/C=C/F")[2][1][:2] == [1, 1] and codes.coded_cells("F/C=C\\F")[2][1][:2] == [1, 2]
    charged = dict(zip(codes.ATOM_FIELDS, codes.coded_cells("C[C@H](N)C(=O)[O-]")[0][5]))
    assert charged["charge"] == 0 and charged["hydrogens"] == 0 and codes.coded_cells("C[C@H](N)O")[0][1][-1] == 1
    assert [r[4] for r in codes.coded_cells("C1CC2CCC12")[4]] == [1, 1] and codes.coded_cells("C1CC1")[4][0][3] == 1
    assert codes.coded_cells("[CH3]")[0][0][6] == 1 and codes.coded_cells("[Dy]") is None and codes.coded_cells("C(") is None and codes.coded_cells(None) is None
    assert [codes.ring_electronegativity(x) for x in (2.4, 2.5, 2.525, 2.575, 2.96, 3.0)] == [11, 0, 0, 2, 9, 11]


def test_features_against_dense(spark):
    texts = [(1, "c1ccccc1"), (2, "C" * 90), (3, "CC.C"), (4, "C1CC2CCC12O"), (5, "C"), (6, "[Dy]"), (7, None), (None, "CC")]
    found = features.coded_complexes(spark.createDataFrame(texts, "row_id long, s string"), "row_id", "s").cache()
    assert {r.g: r.n for r in found.collect()} == {1: 6, 2: 90, 3: 3, 4: 7, 5: 1}
    assert features.atom_table(found).count() == 107 and features.bond_table(found).count() == 6 + 89 + 1 + 8 and features.ring_table(found).count() == 3
    for r in features.encodings(found).collect():
        n, bonds = r.n, next(x.bonds for x in found.collect() if x.g == r.g)
        a = np.zeros((n, n))
        for u, v in zip(bonds[::2], bonds[1::2]):
            a[u, v] = a[v, u] = 1
        hops = np.array(r.hops).reshape(n, n)
        total = a.sum(1, keepdims=True)
        p = np.divide(a, total, out=np.eye(n), where=total > 0)
        assert np.allclose(np.array(r.returns).reshape(n, 16)[:, 3], np.diag(np.linalg.matrix_power(p, 4)), atol=1e-9)
        walks, seen = np.eye(n), np.where(np.eye(n) > 0, 0, -1)
        for k in range(1, n):
            walks = ((walks @ a) > 0).astype(float)
            seen = np.where((seen < 0) & (walks > 0), k, seen)
        assert (hops == seen).all()
        assert r["values"][0] >= 0 and max(r["values"]) <= 1 + 1e-12
    whole = {r.g: r.logits for r in features.forward(found, inference.Block()).collect()}
    alone = {r.g: r.logits for r in features.forward(found.where("g = 4"), inference.Block()).collect()}
    assert len(whole) == 5 and np.allclose(whole[4], alone[4]) and all(np.isfinite(x).all() for x in whole.values())


def test_coface_messages():
    """The message of a face to its edges: itself and the mean of the other edges, an edge without a face hears nothing."""
    block = inference.Block(width=4, heads=2)
    dice = np.random.default_rng(3)
    x, e, f, g = (dice.normal(size=(k, 4)) for k in (3, 6, 1, 1))
    u, v = np.array([0, 1, 2, 1, 2, 0]), np.array([1, 2, 0, 0, 1, 2])
    args = (u, v, np.zeros(4, int), np.array([0, 1, 3, 4]), np.zeros(3, int), np.zeros(6, int), np.zeros(1, int))
    _, e1, f1, g1 = features.message_layer(block, "a", x, e, f, g, *args)
    held = e[[0, 1, 3, 4]].sum(0)
    face = inference.mlp(block, "aface", np.concatenate([held, f[0], g[0]])[None])[0]
    hears = np.concatenate([face, (held - e[1]) / 3])
    want = inference.mlp(block, "aedge", np.concatenate([x[1], x[2], e[1], hears, g[0]])[None])[0]
    assert np.allclose(e1[1], e[1] + want) and np.allclose(f1[0], f[0] + face)
    lone = inference.mlp(block, "aedge", np.concatenate([x[2], x[0], e[2], np.zeros(8), g[0]])[None])[0]
    assert np.allclose(e1[2], e[2] + lone)


def test_skeleton_distances(edges, faces):
    """Hops between nodes on the skeleton: two per edge, and two across a face."""
    links = complexes.bary_skeleton(edges, faces)
    d = {(r.g, r.u, r.v): r.d for r in graph_algos.skeleton_hops(links).collect()}
    assert d[1, "n:0", "n:2"] == 4 and d[1, "n:0", "n:1"] == 2 and d[3, "n:0", "n:2"] == 2 and d[4, "n:0", "n:3"] == 4 and d[5, "n:1", "n:2"] == 4
    assert (6, "n:0", "n:2") not in d and {x for k, x in d.items() if k[0] == 2} == {2}
    back = {(r.g, r.cell, r.k): r.p for r in graph_algos.skeleton_returns(links, 2).collect()}
    assert back[1, "n:0", 1] == 0 and math.isclose(back[1, "n:0", 2], 0.5) and math.isclose(back[6, "n:0", 2], 0.5)


def test_hops_beyond_64(spark):
    path = spark.createDataFrame([(1, i, i + 1) for i in range(70)], "g long, u long, v long")
    assert {r.v: r.d for r in graph_algos.hops_by_frontier(path).where("u = 0").collect()} == {i: i for i in range(1, 71)}
    assert graph_algos.hops_by_frontier(path, 3).agg(F.max("d")).first()[0] == 3


def test_checks_and_guards(spark):
    df = spark.range(5).select("id", F.col("id").alias("idx"))
    ids = lambda *x: spark.createDataFrame([(v, i) for i, v in enumerate(x)], "at long, nth long")
    assert [r.id for r in sampling.checked_gather(df, "idx", ids(3, 0, 3), "at", "nth").orderBy("nth").collect()] == [3, 0, 3]
    for bad in ((), (5,), (-1,), (0,) * 6):
        with pytest.raises(ValueError):
            sampling.checked_gather(df, "idx", ids(*bad), "at", "nth")
    values = spark.createDataFrame([(1, 0.5, float("inf")), (2, None, 1.0), (3, float("nan"), 2.0)], "k int, a double, b double")
    assert [(r.k, r.name) for r in stats.first_non_finite(values, ["k"], ["a", "b"]).collect()] == [(1, "b"), (3, "a")]
    with pytest.raises(ValueError):
        stats.require_finite(values, ["k"], ["a"])
    assert stats.require_finite(values, ["k"], ["k"]) is values and stats.noisy(values, "k", "b", 0.0, 1) is values
    assert stats.ridge_r2(values.limit(0), ["a"], "b").first().n == 0
    assert stats.parameter_count(spark.createDataFrame([], "s array<bigint>"), "s").first()[0] == 0
    one = spark.createDataFrame([(1, [0.0, 3.0]), (2, [4.0, 0.0])], "k int, v array<double>")
    got = setsim.energy_distance(one, one, "k", "v").first()
    assert math.isclose(got.exx, 5) and math.isclose(got.exy, 2.5) and math.isclose(got.energy, -5)


def test_greedy_batches_follow_the_rule(spark):
    dice = np.random.default_rng(4)
    sizes = [(int(i), int(a), int(b)) for i, (a, b) in enumerate(dice.integers(1, 60, (400, 2)))]
    out, batch, held = {}, 0, [0, 0, 0]
    for i, n, e in sizes:
        if held[2] and (held[0] + n > 50 or held[1] + e > 90 or held[2] + 1 > 4):
            batch, held = batch + 1, [0, 0, 0]
        out[i] = batch
        held = [held[0] + n, held[1] + e, held[2] + 1]
        if n > 50 or e > 90:
            batch, held = batch + 1, [0, 0, 0]
    df = spark.createDataFrame(sizes, "i long, n long, e long")
    assert {r.i: r.batch for r in batching.token_buckets(df, "i", "n", "e", 50, 90, 4).collect()} == out
    assert batching.token_buckets(df.limit(0), "i", "n", "e", 50, 90, 4).count() == 0


def test_gather_of_keys_with_gaps(spark, tmp_path):
    """Copies with shifted keys: more listed keys than rows, positions outside of the table and below zero, a null; the query gives the rows of its SQL."""
    shift = 10_000_000_000
    spark.createDataFrame([(i + k * shift,) for k in range(2) for i in (0, 1, 2, 5)], "row_id long").write.parquet(f"{tmp_path}/molecules.parquet")
    listed = [i + k * shift for k in range(2) for i in range(-4, 22)]
    spark.createDataFrame([(i,) for i in (*listed, None)], "row_id long").write.parquet(f"{tmp_path}/fingerprints.parquet")
    con = duckdb.connect()
    for name in ("molecules", "fingerprints"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["gather_checked"]).fetchall()
    got = catalog.queries()["gather_checked"](spark, str(tmp_path)).collect()
    assert len(want) == 24 and sorted(map(tuple, got)) == sorted(want)


def test_bond_table_joins_nothing(spark):
    """Bonds and their codes stand in lists of one order: their table needs no join, of which a planner could send one side to the driver."""
    texts = [(1, "C=CC#N"), (2, "C"), (3, "c1ccccc1C"), (-4, "CC")]
    found = features.coded_complexes(spark.createDataFrame(texts, "row_id long, s string"), "row_id", "s").cache()
    table = features.bond_table(found)
    assert "Join" not in table._jdf.queryExecution().executedPlan().toString() and table.dtypes == [("g", "bigint"), *((c, "int") for c in ("bond", "u", "v", *codes.BOND_FIELDS))]
    want = []
    for g, text in texts:
        _, bonds, bond_codes, *_ = codes.coded_cells(text)
        want += [(g, i, *ends, *own) for i, (ends, own) in enumerate(zip(bonds, bond_codes))]
    assert sorted(map(tuple, table.collect())) == sorted(want)
    rings = codes.coded_cells("c1ccccc1C")[4]
    assert [tuple(r) for r in features.ring_table(found).collect()] == [(3, i, *c) for i, c in enumerate(rings)]


def test_hops_of_stacked_graphs():
    """Graphs of one size, with rings, parts apart and atoms numbered in any order, against all ways."""
    dice = np.random.default_rng(5)
    for n in (1, 2, 9, 40):
        bonds = []
        for m in (0, n // 2, n, 2 * n):
            pairs = {tuple(sorted(p)) for p in dice.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
            bonds.append(dice.permuted(np.array(sorted(pairs), np.int64).reshape(-1, 2), axis=1))
        got = features.hops_of(n, bonds)
        for d, own in zip(got, bonds):
            want = np.where(np.eye(n) > 0, 0.0, np.inf)
            want[own[:, 0], own[:, 1]] = want[own[:, 1], own[:, 0]] = 1
            for k in range(n):
                want = np.minimum(want, want[:, k : k + 1] + want[k : k + 1])
            assert d.dtype == np.int32 and (d == np.where(np.isinf(want), -1, want)).all()


def test_wide_graphs_stand_apart(spark):
    """Graphs of a batch are taken by size, so that a wide one doesn't widen the others, and every graph comes out once."""
    texts = [(i, "C" * (900 if i % 50 == 7 else 2 + i % 9)) for i in range(300)]
    found = features.coded_complexes(spark.createDataFrame(texts, "row_id long, s string").coalesce(1), "row_id", "s")
    slices = [g for b in found.select("g", "n", "bonds").toArrow().to_batches() for g in features._batches(b)]
    assert sorted(r["g"] for own in slices for r in own) == [i for i, _ in texts]
    assert all(len(own) == 1 or len(own) <= features.GRAPHS and len(own) * max(r["n"] for r in own) ** 2 <= features.PAIRS for own in slices)
    out = {r.g: r for r in features.encodings(found).where("g in (7, 8)").collect()}
    assert max(out[7].hops) == 899 and len(out[7].hops) == 810_000 and max(out[8].hops) == 9


def test_attention_in_steps():
    """Attention of a stack in steps equals the plain formula of each graph, and wide layers equal their rows one by one."""
    block, dice = inference.Block(width=8, heads=2), np.random.default_rng(6)
    x, hops = dice.normal(size=(50, 30, 8)), dice.integers(-1, 60, (50, 30, 30))
    hops[:, range(30), range(30)] = 0
    got = features.attend(block, "a", x, features.hop_bias(block, hops))
    table = block.get("bias", block.most_hops + 3, 2)
    for i in (0, 37, 49):
        q, k, v = ((x[i] @ block.get("a" + w, 8, 8)).reshape(30, 2, 4) for w in ("query", "key", "value"))
        heard = np.zeros((30, 2, 4))
        for h in range(2):
            bias = np.array([[-np.inf if d < 0 else table[min(d + (d > 0), block.most_hops + 1), h] for d in row] for row in hops[i]])
            w = np.exp(q[:, h] @ k[:, h].T / 2 + bias)
            heard[:, h] = w / w.sum(1, keepdims=True) @ v[:, h]
        assert np.allclose(got[i], heard.reshape(30, 8) @ block.get("aout", 8, 8))
    rows = dice.normal(size=(5000, 8))
    assert np.allclose(inference.mlp(block, "m", rows)[[0, 2048, 4999]], inference.mlp(block, "m", rows[[0, 2048, 4999]])) and inference.mlp(block, "m", rows[:0]).shape == (0, 8)


def test_packed_counts():
    """Shared bits of vectors of every density, those of more than 255 bits among them, against plain counts."""
    dice = np.random.default_rng(7)
    v = np.packbits(dice.random((90, 2048)) < np.r_[0, 1, dice.random(88)][:, None], axis=1)
    m = np.unpackbits(v, axis=1).astype(int)
    q, r = setsim.packed(v[:50], True), setsim.packed(v[:1:-1], False)
    both, either = setsim.shared_and_all(q, r)
    assert (both == m[:50] @ m[:1:-1].T).all() and (either == np.maximum(1, (m[:50, None] | m[:1:-1][None]).sum(2))).all()


def test_pairs_sharing_moves_no_pairs(spark):
    """Pairs come from blocks: repeated keys stay apart, as in SQL, and no pair passes a shuffle."""
    dice = np.random.default_rng(8)
    v = [np.packbits(dice.random(2048) < 0.02).tobytes() for _ in range(30)] + [bytes(256)]
    rows = [*enumerate(v), (4, v[5])]
    df = spark.createDataFrame(rows, "row_id long, fps binary")
    found = setsim.pairs_sharing(df.where("row_id < 9"), df, "row_id", "fps", block=4)
    assert "Aggregate" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for _, x in rows]
    want = [(a, b, round(int((x & y).sum()) / int((x | y).sum()) + 1e-12, 6)) for (a, _), x in zip(rows, bits) if a < 9 for (b, _), y in zip(rows, bits) if (x & y).any()]
    got = sorted(map(tuple, found.collect()))
    assert len(got) == len(want) and np.allclose(got, sorted(want), atol=1e-9)
    assert setsim.pairs_sharing(df.limit(0), df, "row_id", "fps").count() == 0


def test_pairs_of_like_sizes_stand_together(spark):
    """The pairs are most of what the query stores: tasks hold few different similarities, and pairs are the same in any blocks."""
    dice = np.random.default_rng(10)
    v = np.packbits(dice.random((1600, 2048)) < dice.uniform(0.02, 0.1, 1600)[:, None], axis=1)
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "row_id long, fps binary")
    found = setsim.pairs_sharing(df.where("row_id % 4 = 0"), df, "row_id", "fps", block=40).withColumn("task", F.spark_partition_id()).toPandas()
    assert found.groupby("task").similarity.nunique().mean() < 0.1 * found.similarity.nunique()
    m = np.unpackbits(v, axis=1).astype(int)
    both = m[::4] @ m.T
    i, j = np.nonzero(both)
    found = found.sort_values(["a", "b"])
    assert (found.a == 4 * i).all() and (found.b == j).all() and np.allclose(found.similarity, both[i, j] / (m[::4].sum(1)[i] + m.sum(1)[j] - both[i, j]), atol=6e-7)
    same = setsim.pairs_sharing(df.where("row_id % 4 = 0"), df, "row_id", "fps", block=400).toPandas().sort_values(["a", "b"])
    assert (same.to_numpy() == found[["a", "b", "similarity"]].to_numpy()).all()


def test_discrepancy_in_full_precision(spark):
    """Sparse, dense and equal vectors, against all pairs in double precision."""
    dice = np.random.default_rng(9)
    v = np.packbits(dice.random((40, 2048)) < np.r_[[0.03] * 25, [0.6] * 15][:, None], axis=1)
    v[3] = v[4]
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "row_id long, fps binary")
    m = np.unpackbits(v, axis=1).astype(float)
    both = m @ m.T
    s = both / (m.sum(1)[:, None] + m.sum(1) - both)
    off = lambda a: (a.sum() - np.trace(a)) / (len(a) * (len(a) - 1))
    d = setsim.discrepancy(df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0"), "row_id", "fps", block=9).first()
    x, y = np.arange(40) % 3 > 0, np.arange(40) % 3 == 0
    assert np.allclose([d.exx, d.eyy, d.exy], [off(s[np.ix_(x, x)]), off(s[np.ix_(y, y)]), s[np.ix_(x, y)].mean()], atol=1e-13, rtol=0)
