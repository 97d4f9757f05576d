"""Queries on fingerprints, keys, vocabularies and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetmill.functions.bits import set_bits
from facetmill.functions.columns import code_of, index_or_last, tag_as_carbon, tag_in_brackets, unpack_bits
from facetmill.operators import setsim, vocab
from facetmill.plans.catalog import register
from facetmill.sources.tables import table

_FP = "fp AS (SELECT DISTINCT row_id, fps FROM fingerprints WHERE row_id IS NOT NULL), fb AS (SELECT f.row_id, CAST(f.fps AS BIT) AS v, coalesce(m.split, '') AS split FROM fp f JOIN molecules m USING (row_id))"
_SIM = "CASE WHEN bit_count(q.v | r.v) = 0 THEN 0.0 ELSE bit_count(q.v & r.v) / CAST(bit_count(q.v | r.v) AS DOUBLE) END"


def _split_vectors(spark, root):
    fp = table(spark, root, "fingerprints", ["row_id", "fps"]).where("row_id is not null").distinct()
    return fp.join(table(spark, root, "molecules", ["row_id", "split"]), "row_id").withColumn("split", F.coalesce("split", F.lit("")))


@register("fp_popcount", "SELECT row_id, CAST(bit_count(CAST(fps AS BIT)) AS INT) AS bits, popcount <> bit_count(CAST(fps AS BIT)) AS stale FROM fingerprints")
def fp_popcount(spark, root):
    fp = table(spark, root, "fingerprints", ["row_id", "fps", "popcount"]).withColumn("bits", set_bits("fps"))
    return fp.select("row_id", "bits", (F.col("popcount") != F.col("bits")).alias("stale"))


@register("fp_cache_summary", """WITH b AS (SELECT popcount, valid, scaffold, bit_count(CAST(fps AS BIT)) AS bits FROM fingerprints)
SELECT count(*) AS n, count(*) FILTER (popcount <> bits) AS n_stale, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (valid <> (bits > 0)) AS n_flag_wrong,
quantile_cont(bits, 0.05) AS p05, quantile_cont(bits, 0.5) AS p50, quantile_cont(bits, 0.95) AS p95, count(DISTINCT scaffold) AS n_scaffolds FROM b""")
def fp_cache_summary(spark, root):
    return setsim.cache_summary(table(spark, root, "fingerprints"), "fps", "popcount", "valid", "scaffold")


@register("avg_nn_tanimoto", f"""WITH {_FP}, b AS (SELECT q.row_id, max({_SIM}) AS best FROM fb q, fb r WHERE q.split IN ('test', '') AND q.row_id % 20 = 0 AND r.split = 'train' GROUP BY q.row_id)
SELECT round(avg(best), 6) AS mean, round(quantile_cont(best, 0.5), 6) AS median, round(quantile_cont(best, 0.05), 6) AS p05, round(quantile_cont(best, 0.95), 6) AS p95, count(*) AS n FROM b""")
def avg_nn_tanimoto(spark, root):
    v = _split_vectors(spark, root)
    best = setsim.nearest_similarity(v.where("split in ('test', '') and row_id % 20 = 0"), v.where("split = 'train'"), "row_id", "fps")
    out = setsim.similarity_summary(best)
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "median", "p05", "p95")), "n")


@register("tanimoto_pairs", f"WITH {_FP} SELECT q.row_id AS query, r.row_id AS reference, round({_SIM}, 6) AS similarity FROM fb q, fb r WHERE q.row_id % 20 = 0 AND q.row_id <> r.row_id AND {_SIM} >= 0.5")
def tanimoto_pairs(spark, root):
    v = _split_vectors(spark, root)
    return setsim.pairs_above(v.where("row_id % 20 = 0"), v, "row_id", "fps", 0.5).withColumn("similarity", F.round("similarity", 6))


@register("tanimoto_inverted", f"WITH {_FP} SELECT q.row_id AS a, r.row_id AS b, round({_SIM}, 6) AS similarity FROM fb q, fb r WHERE q.row_id % 20 = 0 AND bit_count(q.v & r.v) > 0")
def tanimoto_inverted(spark, root):
    v = _split_vectors(spark, root)
    return setsim.pairs_sharing(v.where("row_id % 20 = 0"), v, "row_id", "fps")


@register("mmd2_exact", f"""WITH {_FP}, x AS (SELECT avg({_SIM}) AS e FROM fb q, fb r WHERE q.split = 'train' AND r.split = 'train' AND q.row_id <> r.row_id),
y AS (SELECT avg({_SIM}) AS e FROM fb q, fb r WHERE q.split IN ('test', '') AND r.split IN ('test', '') AND q.row_id <> r.row_id),
c AS (SELECT avg({_SIM}) AS e FROM fb q, fb r WHERE q.split = 'train' AND r.split IN ('test', ''))
SELECT round(x.e, 6) AS exx, round(y.e, 6) AS eyy, round(c.e, 6) AS exy, round(x.e + y.e - 2 * c.e, 6) AS mmd2,
(SELECT count(*) FROM fb WHERE split = 'train') AS n_a, (SELECT count(*) FROM fb WHERE split IN ('test', '')) AS n_b FROM x, y, c""")
def mmd2_exact(spark, root):
    v = _split_vectors(spark, root)
    out = setsim.discrepancy(v.where("split = 'train'"), v.where("split in ('test', '')"), "row_id", "fps")
    return out.select(*(F.round(c, 6).alias(c) for c in ("exx", "eyy", "exy", "mmd2")), "n_a", "n_b")


@register("key_overlap_jaccard", """WITH a AS (SELECT DISTINCT scaffold FROM molecules WHERE split = 'train' AND scaffold IS NOT NULL), b AS (SELECT DISTINCT scaffold FROM molecules WHERE split IN ('test', '') AND scaffold IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (scaffold)) AS n_both)
SELECT n_a, n_b, n_both, n_both / CAST(n_a AS DOUBLE) AS a_in_b, n_both / CAST(n_b AS DOUBLE) AS b_in_a, n_both / CAST(n_a + n_b - n_both AS DOUBLE) AS jaccard FROM n""")
def key_overlap_jaccard(spark, root):
    m = table(spark, root, "molecules", ["split", "scaffold"])
    return setsim.key_overlap(m.where("split = 'train'"), m.where("split in ('test', '')"), "scaffold")


@register("key_intersection", "SELECT DISTINCT scaffold FROM molecules WHERE split = 'train' AND scaffold IS NOT NULL INTERSECT SELECT scaffold FROM molecules WHERE split IN ('test', '')")
def key_intersection(spark, root):
    m = table(spark, root, "molecules", ["split", "scaffold"]).where("scaffold is not null")
    return m.where("split = 'train'").select("scaffold").intersect(m.where("split in ('test', '')").select("scaffold"))


@register("set_digest", """WITH d AS (SELECT sha256(molecule_smiles) AS d FROM molecules WHERE molecule_smiles IS NOT NULL),
b AS (SELECT substr(d, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM d GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b""")
def set_digest(spark, root):
    return setsim.set_digest(table(spark, root, "molecules"), "molecule_smiles")


GROUPS = ("share", "non_share", "kin0", "misc")


@register("vocab_codes", "SELECT row_id, CAST(CASE split_group WHEN 'share' THEN 0 WHEN 'non_share' THEN 1 WHEN 'kin0' THEN 2 ELSE 3 END AS INT) AS code FROM molecules")
def vocab_codes(spark, root):
    return table(spark, root, "molecules").select("row_id", code_of(F.col("split_group"), GROUPS).alias("code"))


@register("index_or_last", "SELECT row_id, CAST(CASE WHEN split_group IS NULL OR list_position(['share', 'non_share', 'kin0', 'misc'], split_group) IS NULL OR list_position(['share', 'non_share', 'kin0', 'misc'], split_group) = 0 THEN 3 ELSE list_position(['share', 'non_share', 'kin0', 'misc'], split_group) - 1 END AS BIGINT) AS at FROM molecules")
def index_of(spark, root):
    items = F.array(*map(F.lit, GROUPS))
    return table(spark, root, "molecules").select("row_id", index_or_last(items, F.coalesce("split_group", F.lit("misc"))).cast("bigint").alias("at"))


@register("dense_id", "SELECT protein_name AS value, CAST(dense_rank() OVER (ORDER BY protein_name) - 1 AS INT) AS id FROM (SELECT DISTINCT protein_name FROM bindings WHERE protein_name IS NOT NULL)")
def dense_id(spark, root):
    return vocab.dense_ids(table(spark, root, "bindings"), "protein_name")


@register("unique_profile", "SELECT list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS source, list_sort(list(DISTINCT split) FILTER (split IS NOT NULL)) AS split, list_sort(list(DISTINCT split_group) FILTER (split_group IS NOT NULL)) AS split_group FROM molecules")
def unique_profile(spark, root):
    return vocab.unique_profile(table(spark, root, "molecules"), ["source", "split", "split_group"])


@register("list_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 9) AS mean, CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min FROM fingerprints" for c in ("popcount", "row_id")))
def list_profile(spark, root):
    return vocab.list_profile(table(spark, root, "fingerprints"), ["popcount", "row_id"]).withColumn("mean", F.round("mean", 9))


@register("top_scaffolds", "SELECT scaffold AS value, count(*) AS n FROM fingerprints WHERE scaffold IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_scaffolds(spark, root):
    return vocab.top_values(table(spark, root, "fingerprints"), "scaffold", 5)


@register("bit_unpack", "SELECT l_linenumber AS value, [l_linenumber & 3, (l_linenumber >> 2) & 3, (l_linenumber >> 4) & 3, (l_linenumber >> 6) & 3] AS fields, count(*) AS n FROM lineitem GROUP BY ALL")
def bit_unpack(spark, root):
    return table(spark, root, "lineitem").select(F.col("l_linenumber").alias("value"), unpack_bits(F.col("l_linenumber"), 2).alias("fields")).groupBy("value", "fields").agg(F.count("*").alias("n"))


@register("tag_normalise", "SELECT row_id, CASE WHEN molecule_smiles IS NOT NULL THEN replace(replace(replace(molecule_smiles, '[Dy', chr(1)), 'Dy', '[Dy]'), chr(1), '[Dy') END AS bracketed, replace(molecule_smiles, '[Dy]', '[C]') AS carbon FROM molecules")
def tag_normalise(spark, root):
    s = F.col("molecule_smiles")
    return table(spark, root, "molecules").select("row_id", tag_in_brackets(s).alias("bracketed"), tag_as_carbon(s).alias("carbon"))
