"""Queries on splits, samples, scores and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions.columns import close, finite_array, missing, with_sentinel
from facetmill.operators import sampling, scoring, stats
from facetmill.plans.catalog import register
from facetmill.sources.tables import table

LABELS = ("binds_brd4", "binds_hsa", "binds_seh")
TARGETS = ("brd4", "hsa", "seh")
SEED = 42

_LONG = " UNION ALL ".join(
    f"SELECT variance, split_group, '{t}' AS target, CAST(truth_{t} AS INT) AS y, pred_{t} AS score FROM predictions WHERE split_group IS NOT NULL AND truth_{t} <> 255 AND truth_{t} IS NOT NULL AND pred_{t} IS NOT NULL AND isfinite(pred_{t})" for t in TARGETS
)
_AP = f"""
WITH s AS ({_LONG}),
ties AS (SELECT variance, split_group, target, score, sum(y) AS p, count(*) AS k FROM s GROUP BY ALL),
run AS (SELECT *, sum(p) OVER w AS cp, sum(k) OVER w AS ck FROM ties WINDOW w AS (PARTITION BY variance, split_group, target ORDER BY score DESC)),
ap AS (SELECT variance, split_group, target, CASE WHEN sum(p) > 0 THEN sum(p * cp / ck) / sum(p) ELSE 0 END AS ap, CAST(sum(k) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos FROM run GROUP BY ALL)"""


def _scores(spark: SparkSession, root: str) -> DataFrame:
    return scoring.long_scores(table(spark, root, "predictions").where("split_group is not null"), ["variance", "split_group"], TARGETS)


@register("ap_by_cell", _AP + " SELECT variance, split_group, target, round(ap, 9) AS ap, n, n_pos FROM ap")
def ap_by_cell(spark, root):
    return scoring.average_precision(_scores(spark, root), ["variance", "split_group", "target"]).withColumn("ap", F.round("ap", 9))


@register("map_by_group", _AP + " SELECT variance, split_group, round(avg(ap), 9) AS map, count(*) AS n_cells FROM ap GROUP BY ALL")
def map_by_group(spark, root):
    return scoring.mean_average_precision(_scores(spark, root), ["variance", "split_group"], ["target"]).withColumn("map", F.round("map", 9))


@register("map_by_run", _AP + " SELECT variance, round(avg(ap), 9) AS map, count(*) AS n_cells FROM ap GROUP BY ALL")
def map_by_run(spark, root):
    return scoring.mean_average_precision(_scores(spark, root), ["variance"], ["split_group", "target"]).withColumn("map", F.round("map", 9))


def _each(f: str) -> str:
    return " UNION ALL ".join(f.replace("?", c) for c in LABELS)


@register("label_counts", _each("SELECT '?' AS target, count(*) AS n_rows, count(*) FILTER (? = 1) AS n_pos, count(*) FILTER (? = 0) AS n_neg, count(*) FILTER (? IS NULL OR NOT isfinite(?)) AS n_missing FROM molecules WHERE split = 'train'"))
def label_counts(spark, root):
    return scoring.label_counts(sampling.split_filter(table(spark, root, "molecules"), "split", "train"), LABELS)


@register("class_pos_weight", _each("SELECT '?' AS target, round(CASE WHEN count(*) FILTER (? = 1) = 0 THEN 1.0 ELSE count(*) FILTER (? = 0) / CAST(count(*) FILTER (? = 1) AS DOUBLE) END, 9) AS pos_weight FROM molecules WHERE split = 'train'"))
def class_pos_weight(spark, root):
    return scoring.class_weights(sampling.split_filter(table(spark, root, "molecules"), "split", "train"), LABELS).withColumn("pos_weight", F.round("pos_weight", 9))


@register("pos_weight_by_protein", "SELECT protein_name AS key, CAST(sum(binds) AS BIGINT) AS n_pos, CAST(count(*) - sum(binds) AS BIGINT) AS n_neg, count(*) AS n_rows FROM bindings WHERE binds IN (0, 1) GROUP BY protein_name")
def pos_weight_by_protein(spark, root):
    return scoring.weights_by_key(table(spark, root, "bindings"), F.col("protein_name"), "binds")


@register("sentinel_fill", "SELECT row_id, " + ", ".join(f"CAST(CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 255 ELSE {c} END AS SMALLINT) AS {c}" for c in LABELS) + ", CASE WHEN split IN ('test', '') THEN split_group END AS split_group FROM molecules")
def sentinel_fill(spark, root):
    m = table(spark, root, "molecules")
    return m.select("row_id", *(with_sentinel(F.col(c)).alias(c) for c in LABELS), F.when(F.col("split").isin("test", ""), F.col("split_group")).alias("split_group"))


@register("split_filter", "SELECT row_id, molecule_smiles, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in LABELS) + " FROM molecules WHERE split IN ('test', '')")
def split_filter(spark, root):
    return sampling.split_filter(table(spark, root, "molecules"), "split", "test").select("row_id", "molecule_smiles", *(missing(F.col(c)).alias(c) for c in LABELS))


@register("chunk_assign", """WITH t AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS idx, count(*) OVER () AS n FROM molecules WHERE split = 'train')
SELECT row_id, idx, CAST(least(idx // greatest(1, n // 8), 7) AS INT) AS chunk FROM t""")
def chunk_assign(spark, root):
    train = sampling.split_filter(table(spark, root, "molecules"), "split", "train").select("row_id")
    return sampling.dense_index(train, "row_id").withColumn("chunk", sampling.chunk_of(F.col("idx"), train.count(), 8))


_HASH = f"md5('{SEED}|' || CAST(row_id AS VARCHAR))"


@register("quota_sample", "WITH t AS (SELECT * FROM molecules WHERE split = 'train'), " + ", ".join(f"p{i} AS (SELECT row_id FROM t WHERE {c} = 1 ORDER BY {_HASH}, row_id LIMIT 20)" for i, c in enumerate(LABELS)) + f""",
s AS (SELECT row_id FROM p0 UNION SELECT row_id FROM p1 UNION SELECT row_id FROM p2),
r AS (SELECT row_id FROM t WHERE row_id NOT IN (SELECT row_id FROM s) QUALIFY row_number() OVER (ORDER BY {_HASH}, row_id) <= 1000 - (SELECT count(*) FROM s))
SELECT row_id FROM s UNION ALL SELECT row_id FROM r""")
def quota_sample(spark, root):
    return sampling.quota_sample(sampling.split_filter(table(spark, root, "molecules"), "split", "train"), "row_id", LABELS, 1000, 20, SEED)


_ONE = f"SELECT id, binds, protein_name FROM (SELECT DISTINCT id, binds, protein_name FROM bindings WHERE binds = ?) ORDER BY {_HASH.replace('row_id', 'id')}, id LIMIT 200"


@register("balanced_sample", f"SELECT * FROM ({_ONE.replace('?', '0')}) UNION ALL SELECT * FROM ({_ONE.replace('?', '1')})")
def balanced_sample(spark, root):
    rows = table(spark, root, "bindings").select("id", "binds", "protein_name").distinct()
    return sampling.balanced_sample(rows, "id", "binds", 200, SEED)


@register("remainder_anti", "SELECT row_id FROM molecules WHERE row_id NOT IN (SELECT row_id FROM fingerprints WHERE row_id IS NOT NULL)")
def remainder_anti(spark, root):
    return table(spark, root, "molecules").select("row_id").join(table(spark, root, "fingerprints").select("row_id"), "row_id", "left_anti")


@register("gather_by_ids", "SELECT p.row_id, p.variance, m.split, m.source FROM predictions p JOIN molecules m USING (row_id)")
def gather_by_ids(spark, root):
    ids = table(spark, root, "predictions", ["row_id", "variance"])
    return sampling.gather(table(spark, root, "molecules", ["row_id", "split", "source"]), "row_id", ids, "row_id", "variance")


@register("uniform_subsample", f"SELECT row_id, scaffold FROM (SELECT DISTINCT row_id, scaffold FROM fingerprints) ORDER BY {_HASH}, row_id LIMIT 500")
def uniform_subsample(spark, root):
    return sampling.first_by_seed(table(spark, root, "fingerprints").select("row_id", "scaffold").distinct(), "row_id", 500, SEED)


@register("wide_to_long", " UNION ALL ".join(f"SELECT row_id, '{t}' AS target, {c} AS y FROM molecules WHERE {c} IS NOT NULL AND isfinite({c})" for t, c in zip(TARGETS, LABELS)))
def wide_to_long(spark, root):
    rows = F.array(*(F.struct(F.lit(t).alias("target"), F.nanvl(F.col(c), F.lit(None)).alias("y")) for t, c in zip(TARGETS, LABELS)))
    return table(spark, root, "molecules").select("row_id", F.inline(rows)).where("y is not null")


@register("long_to_wide", """SELECT row_id, max(binds) FILTER (protein_name = 'BRD4') AS "BRD4", max(binds) FILTER (protein_name = 'HSA') AS "HSA", max(binds) FILTER (protein_name = 'sEH') AS "sEH"
FROM bindings WHERE binds IN (0, 1) AND row_id IS NOT NULL AND protein_name IN ('BRD4', 'HSA', 'sEH') GROUP BY row_id""")
def long_to_wide(spark, root):
    rows = table(spark, root, "bindings").where("binds in (0, 1) and row_id is not null")
    return rows.groupBy("row_id").pivot("protein_name", ["BRD4", "HSA", "sEH"]).agg(F.max("binds")).where("BRD4 is not null or HSA is not null or sEH is not null")


# Sweeps. The log has no position column, so the checkpoint path and the score order its rows.
def _log(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ablation_rows").withColumn("sigma", F.round("sigma", 6)).withColumn("at", F.struct("checkpoint_path", "model_score"))


_SIGMA = "l AS (SELECT variance, round(sigma, 6) AS sigma, alpha, model_score, model_scores, mean_curves, checkpoint_path FROM ablation_rows), f AS (SELECT * FROM l WHERE model_score IS NOT NULL AND abs(alpha - 1) <= 1e-9 QUALIFY row_number() OVER (PARTITION BY variance, sigma ORDER BY checkpoint_path, model_score) = 1)"
_ALPHA = "l AS (SELECT variance, round(sigma, 6) AS sigma, alpha, model_score, model_scores, mean_curves FROM ablation_rows), f AS (SELECT * FROM l WHERE model_score IS NOT NULL AND abs(sigma) <= 1e-9)"
_STD = "CASE WHEN count(?) = 1 THEN 0.0 ELSE stddev_samp(?) END"
_SETTING = "SELECT variance, {k}, avg(model_score) AS mean, " + _STD.replace("?", "model_score") + " AS std FROM f GROUP BY variance, {k}"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@register("sweep_first_wins", f"WITH {_SIGMA}, s AS ({_SETTING.format(k='sigma')}) SELECT variance, sigma, round(mean, 9) AS mean, round(std, 9) AS std FROM s")
def sweep_first_wins(spark, root):
    return _round(stats.setting_stats(stats.sigma_rows(_log(spark, root), "at"), "sigma"), "mean", "std")


@register("sweep_pooled", f"WITH {_ALPHA}, s AS ({_SETTING.format(k='alpha')}) SELECT variance, alpha, round(mean, 9) AS mean, round(std, 9) AS std FROM s")
def sweep_pooled(spark, root):
    return _round(stats.setting_stats(stats.alpha_rows(_log(spark, root)), "alpha"), "mean", "std")


def _pooled(key: str, head: str) -> str:
    return f"WITH {head}, s AS ({_SETTING.format(k=key)}) SELECT {key}, round(avg(mean), 9) AS mean_of_means, round({_STD.replace('?', 'mean')}, 9) AS std_of_means, count(*) AS n FROM s GROUP BY {key}"


@register("rollup_sigma", _pooled("sigma", _SIGMA))
def rollup_sigma(spark, root):
    return _round(stats.over_variances(stats.setting_stats(stats.sigma_rows(_log(spark, root), "at"), "sigma"), "sigma"), "mean_of_means", "std_of_means")


@register("rollup_alpha", _pooled("alpha", _ALPHA))
def rollup_alpha(spark, root):
    return _round(stats.over_variances(stats.setting_stats(stats.alpha_rows(_log(spark, root)), "alpha"), "alpha"), "mean_of_means", "std_of_means")


def _positions(array: str, keys: str, head: str) -> str:
    return f"""WITH {head}, e AS (SELECT {keys}, unnest({array}) AS x, generate_subscripts({array}, 1) - 1 AS pos FROM f),
c AS (SELECT {keys}, CAST(pos AS INT) AS pos, CASE WHEN isfinite(x) THEN x END AS x FROM e)
SELECT {keys}, pos, round(avg(x), 9) AS mean, round({_STD.replace('?', 'x')}, 9) AS std, count(x) AS n FROM c GROUP BY {keys}, pos"""


@register("array_elementwise_stats", _positions("model_scores", "variance, sigma", _SIGMA))
def array_elementwise_stats(spark, root):
    return _round(stats.elementwise(stats.sigma_rows(_log(spark, root), "at"), ["variance", "sigma"], "model_scores"), "mean", "std")


@register("curve_stats_by_run", _positions("mean_curves", "variance", "f AS (SELECT * FROM ablation_rows)"))
def curve_stats_by_run(spark, root):
    return _round(stats.elementwise(table(spark, root, "ablation_rows"), ["variance"], "mean_curves"), "mean", "std")


@register("curve_stats_overall", f"""WITH e AS (SELECT variance, unnest(mean_curves) AS x, generate_subscripts(mean_curves, 1) - 1 AS pos FROM ablation_rows),
v AS (SELECT variance, CAST(pos AS INT) AS pos, avg(CASE WHEN isfinite(x) THEN x END) AS x FROM e GROUP BY ALL)
SELECT pos, round(avg(x), 9) AS mean, round({_STD.replace('?', 'x')}, 9) AS std, count(x) AS n FROM v GROUP BY pos""")
def curve_stats_overall(spark, root):
    own = stats.elementwise(table(spark, root, "ablation_rows"), ["variance"], "mean_curves")
    out = own.groupBy("pos").agg(F.avg("mean").alias("mean_"), stats.std_or_zero("mean").alias("std_"), F.count("mean").alias("n"))
    return _round(out.withColumnsRenamed({"mean_": "mean", "std_": "std"}), "mean", "std")


@register("nan_mean_std", "SELECT variance, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, count(x) AS n FROM (SELECT variance, CASE WHEN isfinite(pred_hsa) THEN pred_hsa END AS x FROM predictions) GROUP BY variance")
def nan_mean_std(spark, root):
    return _round(stats.nan_stats(table(spark, root, "predictions"), ["variance"], "pred_hsa"), "mean", "std")


@register("closest_key", f"WITH {_SIGMA} SELECT variance, sigma, model_score FROM f QUALIFY row_number() OVER (PARTITION BY variance ORDER BY abs(sigma - 0.4), checkpoint_path, model_score) = 1")
def closest_key(spark, root):
    return stats.closest(stats.sigma_rows(_log(spark, root), "at"), ["variance"], "sigma", 0.4, "at").select("variance", "sigma", "model_score")


@register("delta_quadrature", f"WITH {_SIGMA}, s AS ({_SETTING.format(k='sigma')}), b AS (SELECT * FROM s WHERE sigma = 0) SELECT s.variance, s.sigma, round(s.mean - b.mean, 9) AS delta, round(sqrt(s.std * s.std + b.std * b.std), 9) AS error FROM s JOIN b USING (variance)")
def delta_quadrature(spark, root):
    s = stats.setting_stats(stats.sigma_rows(_log(spark, root), "at"), "sigma")
    base = s.where(close(F.col("sigma"), F.lit(0.0))).drop("sigma")
    sigma = s.select("variance", F.col("sigma"), "mean", "std")
    joined = sigma.join(base.withColumnsRenamed({"mean": "bm", "std": "bs"}), "variance")
    return _round(joined.select("variance", "sigma", (F.col("mean") - F.col("bm")).alias("delta"), F.sqrt(F.col("std") ** 2 + F.col("bs") ** 2).alias("error")), "delta", "error")


@register("curve_delta", """WITH e AS (SELECT variance, round(sigma, 6) AS sigma, unnest(mean_curves) AS x, generate_subscripts(mean_curves, 1) - 1 AS pos FROM ablation_rows WHERE variance = 0),
c AS (SELECT sigma, CAST(pos AS INT) AS pos, avg(CASE WHEN isfinite(x) THEN x END) AS mean, CASE WHEN count(CASE WHEN isfinite(x) THEN x END) = 1 THEN 0.0 ELSE stddev_samp(CASE WHEN isfinite(x) THEN x END) END AS std FROM e GROUP BY ALL)
SELECT o.sigma, o.pos, round(o.mean - b.mean, 9) AS delta, round(sqrt(o.std * o.std + b.std * b.std), 9) AS error FROM c o JOIN c b USING (pos) WHERE b.sigma = 0""")
def curve_delta(spark, root):
    own = stats.elementwise(_log(spark, root).where("variance = 0"), ["sigma"], "mean_curves")
    base = own.where("sigma = 0").select("pos", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    out = own.join(base, "pos").select("sigma", "pos", (F.col("mean") - F.col("bm")).alias("delta"), F.sqrt(F.col("std") ** 2 + F.col("bs") ** 2).alias("error"))
    return _round(out, "delta", "error")


@register("json_finite", "SELECT variance, checkpoint_path, model_score, list_transform(mean_curves, lambda x: CASE WHEN isfinite(x) THEN x END) AS mean_curves FROM ablation_rows")
def json_finite(spark, root):
    return table(spark, root, "ablation_rows").select("variance", "checkpoint_path", "model_score", finite_array("mean_curves").alias("mean_curves"))
