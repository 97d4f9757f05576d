"""Queries on cell complexes, graph encodings, messages, losses, attention and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetmill.functions import lines
from facetmill.functions.columns import bucket_hops, electronegativity_code, gaussian_kernels, learning_rate_factor, recode_hops
from facetmill.operators import attention, batching, complexes, features, graph_algos, inference, losses, messages
from facetmill.plans.catalog import register
from facetmill.sources.tables import table

# One small graph an order: its parts and its suppliers (below zero, since keys start at zero), linked by its lines.
_ORDERS = "o AS (SELECT DISTINCT l_orderkey AS g, -1 - l_suppkey AS u, l_partkey AS v FROM lineitem)"
_FACES = "f AS (SELECT DISTINCT l_orderkey AS g, CAST(CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS BIGINT) AS face, -1 - l_suppkey AS u, l_partkey AS v FROM lineitem)"
# One directed graph a user: which event type follows which.
_STEPS = """t AS (SELECT user_id AS g, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS c, ts, event_id FROM events),
s AS (SELECT g, CAST(c AS BIGINT) AS u, CAST(lead(c) OVER (PARTITION BY g ORDER BY ts, event_id) AS BIGINT) AS v FROM t),
e AS (SELECT g, u, v FROM s WHERE v IS NOT NULL), d1 AS (SELECT DISTINCT g, u, v FROM e WHERE u <> v)"""


def _orders(spark, root):
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("g"), (-1 - F.col("l_suppkey")).alias("u"), F.col("l_partkey").alias("v"))


def _faces(spark, root):
    face = F.when(F.col("l_linestatus") == "O", 0).otherwise(1).cast("bigint")
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("g"), face.alias("face"), (-1 - F.col("l_suppkey")).alias("u"), F.col("l_partkey").alias("v")).distinct()


def _steps(spark, root):
    kind = F.col("event_type")
    code = F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(4).cast("bigint")
    nxt = F.lead("u").over(Window.partitionBy("g").orderBy("ts", "event_id"))
    return table(spark, root, "events").select(F.col("user_id").alias("g"), code.alias("u"), "ts", "event_id").withColumn("v", nxt).where("v is not null").select("g", "u", "v")


@register("undirected_edges", f"WITH {_ORDERS} SELECT g, u, v FROM o")
def undirected_edges(spark, root):
    return complexes.undirected_edges(_orders(spark, root))


@register("bary_skeleton", f"""WITH {_ORDERS}, {_FACES}, n AS (SELECT *, 'e:' || u || '-' || v AS e FROM o), x AS (SELECT *, 'e:' || u || '-' || v AS e, 'f:' || face AS t FROM f)
SELECT g, 'n:' || u AS a, e AS b FROM n UNION ALL SELECT g, 'n:' || v, e FROM n UNION ALL SELECT g, e, t FROM x
UNION ALL SELECT * FROM (SELECT DISTINCT g, 'n:' || u, t FROM x UNION SELECT DISTINCT g, 'n:' || v, t FROM x)""")
def bary_skeleton(spark, root):
    return complexes.bary_skeleton(_orders(spark, root), _faces(spark, root))


@register("numbered_edges", f"WITH {_ORDERS}, b AS (SELECT g, u, v, row_number() OVER (PARTITION BY g ORDER BY u, v) - 1 AS b FROM o) SELECT g, 2 * b AS edge, u, v FROM b UNION ALL SELECT g, 2 * b + 1, v, u FROM b")
def numbered_edges(spark, root):
    return complexes.numbered_edges(_orders(spark, root))


@register("ring_member_stats", "SELECT l_orderkey AS g, l_linestatus AS face, count(*) AS n, round(avg(l_discount), 9) AS mean, bool_and(l_tax > 0.04) AS all_set, bool_or(l_tax > 0.04) AS any_set, count(*) FILTER (l_tax > 0.04) AS n_set FROM lineitem GROUP BY ALL")
def ring_member_stats(spark, root):
    m = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linestatus").alias("face"), "l_discount", (F.col("l_tax") > 0.04).alias("high"))
    return complexes.member_stats(m, "l_discount", "high").withColumn("mean", F.round("mean", 9))


@register("edge_face_counts", f"WITH {_FACES} SELECT g, u, v, count(DISTINCT face) AS n_faces FROM f GROUP BY ALL")
def edge_face_counts(spark, root):
    return complexes.membership_counts(_faces(spark, root))


_TWO = "w AS (SELECT g, u, v FROM o UNION ALL SELECT g, v, u FROM o), d AS (SELECT g, u, count(*) AS n FROM w GROUP BY ALL)"


@register("degree_clamped", f"WITH {_ORDERS}, {_TWO} SELECT g, u, least(n, 5) AS degree FROM d")
def degree_clamped(spark, root):
    return complexes.degrees(complexes.both_directions(_orders(spark, root)), most=5)


_HELD = "o AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, -1 - l_suppkey AS u, l_partkey AS v FROM lineitem), w AS MATERIALIZED (SELECT g, u, v, count(*) OVER (PARTITION BY g, u) AS n FROM (SELECT g, u, v FROM o UNION ALL SELECT g, v, u FROM o)), b AS MATERIALIZED (SELECT g, u AS v, v AS u, n AS m FROM w)"


@register("norm_laplacian", f"WITH {_HELD} SELECT w.g, w.u, w.v, round(-1 / sqrt(w.n * b.m), 9) AS w FROM w JOIN b USING (g, u, v) UNION ALL SELECT DISTINCT g, u, u, 1.0::DOUBLE FROM w")
def norm_laplacian(spark, root):
    return complexes.normalised_laplacian(_orders(spark, root)).withColumn("w", F.round("w", 9))


_HOPS = " ".join(f", d{k} AS (SELECT g, u, v, min(d) AS d FROM (SELECT g, u, v, d FROM d{k - 1}x UNION ALL SELECT a.g, a.u, b.v, a.d + 1 FROM d{k - 1}x a JOIN d1 b ON a.g = b.g AND a.v = b.u WHERE a.u <> b.v) GROUP BY ALL), d{k}x AS (SELECT * FROM d{k})" for k in (2, 3, 4))
_HOPS = f"WITH {_STEPS}, d1x AS (SELECT g, u, v, 1 AS d FROM d1){_HOPS}"


@register("spd_allpairs", _HOPS + " SELECT g, u, v, CAST(d AS INT) AS d FROM d4")
def spd_allpairs(spark, root):
    return graph_algos.hops_by_frontier(_steps(spark, root))


_FULL = _HOPS + ", n AS (SELECT DISTINCT g, x AS u FROM (SELECT g, u AS x FROM e UNION ALL SELECT g, v FROM e)), p AS (SELECT a.g, a.u, b.u AS v, CAST(CASE WHEN a.u = b.u THEN 0 ELSE coalesce(d.d, -1) END AS BIGINT) AS d FROM n a JOIN n b ON a.g = b.g LEFT JOIN d4 d ON d.g = a.g AND d.u = a.u AND d.v = b.u)"


@register("spd_by_graph", _FULL + " SELECT g, u, v, d FROM p")
def spd_by_graph(spark, root):
    return graph_algos.hops_by_graph(_steps(spark, root))


@register("spd_recode", _FULL + ", r AS (SELECT g, u, v, CASE WHEN u = v THEN 0 WHEN d < 0 THEN -1 ELSE d + 1 END AS code FROM p) SELECT g, u, v, code, CASE WHEN code < 0 THEN 37 ELSE least(code, 36) END AS bucket FROM r")
def spd_recode(spark, root):
    d = graph_algos.hops_by_graph(_steps(spark, root))
    code = recode_hops(F.col("d"), F.col("u") == F.col("v")).cast("bigint")
    return d.select("g", "u", "v", code.alias("code")).withColumn("bucket", bucket_hops(F.col("code"), 35).cast("bigint"))


@register("rw_landing_k3", f"""WITH {_STEPS}, c AS (SELECT g, u, v, count(*) AS w FROM e GROUP BY ALL), p0 AS (SELECT g, u, v, w / CAST(sum(w) OVER (PARTITION BY g, u) AS DOUBLE) AS p FROM c),
n AS (SELECT DISTINCT g, x AS u FROM (SELECT g, u AS x FROM c UNION ALL SELECT g, v FROM c)), p1 AS (SELECT * FROM p0 UNION ALL SELECT g, u, u, 1.0 FROM n WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.g = n.g AND p0.u = n.u)),
p2 AS (SELECT a.g, a.u, b.v, sum(a.p * b.p) AS p FROM p1 a JOIN p1 b ON a.g = b.g AND a.v = b.u GROUP BY ALL), p3 AS (SELECT a.g, a.u, b.v, sum(a.p * b.p) AS p FROM p2 a JOIN p1 b ON a.g = b.g AND a.v = b.u GROUP BY ALL),
k AS (SELECT 1 AS k, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)
SELECT n.g, n.u, CAST(ks.k AS INT) AS k, round(coalesce(k.p, 0), 9) AS p FROM n CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) ks LEFT JOIN k ON k.g = n.g AND k.u = n.u AND k.v = n.u AND k.k = ks.k""")
def rw_landing_k3(spark, root):
    return graph_algos.returns_by_join(_steps(spark, root), 3).withColumn("p", F.round("p", 9))


@register("rw_landing_16")
def rw_landing_16(spark, root):
    return graph_algos.returns_by_graph(_steps(spark, root), 16)


@register("laplacian_pe")
def laplacian_pe(spark, root):
    return graph_algos.laplacian_encodings(_steps(spark, root))


@register("bary_pe")
def bary_pe(spark, root):
    return graph_algos.bary_encodings(complexes.bary_skeleton(_steps(spark, root)))


@register("molecule_complexes")
def molecule_complexes(spark, root):
    found = lines.complexes(table(spark, root, "molecules"), "row_id", "molecule_smiles")
    return found.select(F.col("g").alias("row_id"), F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"), F.size("rings").alias("n_rings"))


@register("molecule_unreadable")
def molecule_unreadable(spark, root):
    """Rows that give no graph: strings that can't be read, none at all, or no row number."""
    rows = table(spark, root, "molecules", ["row_id", "molecule_smiles"])
    return lines.unreadable(rows, lines.complexes(rows, "row_id", "molecule_smiles"), "row_id")


def _coded(spark, root):
    return features.coded_complexes(_spread(table(spark, root, "molecules", ["row_id", "molecule_smiles"])), "row_id", "molecule_smiles")


@register("molecule_atoms")
def molecule_atoms(spark, root):
    return features.atom_table(_coded(spark, root)).withColumnRenamed("g", "row_id")


@register("molecule_bonds")
def molecule_bonds(spark, root):
    return features.bond_table(_coded(spark, root)).withColumnRenamed("g", "row_id")


@register("molecule_rings")
def molecule_rings(spark, root):
    return features.ring_table(_coded(spark, root)).withColumnRenamed("g", "row_id")


@register("molecule_encodings")
def molecule_encodings(spark, root):
    """Spectrum, vectors, walk returns and hops of every molecule's graph, whole."""
    return features.encodings(_coded(spark, root)).withColumnRenamed("g", "row_id")


@register("molecule_forward")
def molecule_forward(spark, root):
    return features.forward(_coded(spark, root), inference.Block()).withColumnRenamed("g", "row_id")


def _spread(rows):
    """Strings over all cores before they become graphs: the work of a graph is heavy beside its string, and its cells are a hundred times as large."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "row_id")


# Messages: lines as edges, prices as values.
@register("scatter_in_out", """WITH e AS (SELECT l_orderkey AS g, -1 - l_suppkey AS u, l_partkey AS v, l_discount AS x FROM lineitem), n AS (SELECT DISTINCT g, u, CAST(abs(u) % 7 AS DOUBLE) AS y FROM (SELECT g, u FROM e UNION ALL SELECT g, v FROM e)),
i AS (SELECT e.g, e.v AS u, sum(e.x) AS a, sum(n.y) AS b FROM e JOIN n ON n.g = e.g AND n.u = e.u GROUP BY ALL), q AS (SELECT e.g, e.u, sum(e.x) AS a, sum(n.y) AS b FROM e JOIN n ON n.g = e.g AND n.u = e.v GROUP BY ALL)
SELECT n.g, n.u, round(coalesce(i.a, 0), 9) AS in_edge, round(coalesce(i.b, 0), 9) AS in_node, round(coalesce(q.a, 0), 9) AS out_edge, round(coalesce(q.b, 0), 9) AS out_node FROM n LEFT JOIN i ON i.g = n.g AND i.u = n.u LEFT JOIN q ON q.g = n.g AND q.u = n.u""")
def scatter_in_out(spark, root):
    e = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("g"), (-1 - F.col("l_suppkey")).alias("u"), F.col("l_partkey").alias("v"), "l_discount")
    n = e.select("g", F.explode(F.array("u", "v")).alias("u")).distinct().withColumn("y", (F.abs("u") % 7).cast("double"))
    out = messages.scatter_sums(e, n, "l_discount", "y")
    return out.select("g", "u", *(F.round(c, 9).alias(c) for c in ("in_edge", "in_node", "out_edge", "out_node")))


@register("coface_leave_one_out", """WITH i AS (SELECT l_orderkey AS g, l_linestatus AS face, l_partkey AS edge, sum(l_quantity) AS x FROM lineitem GROUP BY ALL), f AS (SELECT g, face, sum(x) AS s, count(*) AS n FROM i GROUP BY ALL)
SELECT i.g, i.edge, round(sum((f.s - i.x) / greatest(f.n - 1, 1)) * 0.5, 9) AS coface FROM i JOIN f USING (g, face) GROUP BY i.g, i.edge""")
def coface_leave_one_out(spark, root):
    i = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linestatus").alias("face"), F.col("l_partkey").alias("edge")).agg(F.sum("l_quantity").alias("x"))
    return messages.coface_means(i, "x", 0.5).withColumn("coface", F.round("coface", 9))


@register("graph_mean_pool", "SELECT l_orderkey, round(avg(l_quantity), 9) AS mean_pool, sum(l_quantity) AS sum_pool, count(l_quantity) AS n FROM lineitem GROUP BY l_orderkey")
def graph_mean_pool(spark, root):
    return messages.pool(table(spark, root, "lineitem"), ["l_orderkey"], "l_quantity").withColumn("mean_pool", F.round("mean_pool", 9))


@register("segment_softmax_pool", "WITH m AS (SELECT *, exp(l_quantity - max(l_quantity) OVER (PARTITION BY l_orderkey)) AS w FROM lineitem) SELECT l_orderkey, round(sum(w * l_extendedprice) / sum(w), 5) AS pooled FROM m GROUP BY l_orderkey")
def segment_softmax_pool(spark, root):
    return messages.softmax_pool(table(spark, root, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice").withColumn("pooled", F.round("pooled", 5))


@register("pairwise_cosine", "WITH d AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.label, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS cosine, (SELECT count(*) FROM d WHERE d.label = a.label) AS n FROM d a JOIN d b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def pairwise_cosine(spark, root):
    return messages.mean_pairwise_cosine(table(spark, root, "embeddings"), ["label"], "embedding").withColumn("cosine", F.round("cosine", 6))


# Losses: scores spread to logits.
_LOGITS = "l AS (SELECT variance, (pred_hsa - 0.5) * 8 AS z, CAST(truth_hsa AS DOUBLE) AS y FROM predictions WHERE truth_hsa IN (0, 1) AND isfinite(pred_hsa)), b AS (SELECT *, 1 / (1 + exp(-z)) AS p, ln(1 + exp(-abs(z))) + greatest(-z, 0) AS soft FROM l)"


def _logits(spark, root):
    z = (F.col("pred_hsa") - 0.5) * 8
    return table(spark, root, "predictions").where(~F.isnan("pred_hsa")).select("variance", z.alias("z"), losses.label(F.col("truth_hsa")).alias("y"))


@register("pointwise_losses", f"""WITH {_LOGITS}, c AS (SELECT *, (1 - y) * z + (1 + 1.5 * y) * soft AS bce, CASE WHEN y = 1 THEN 0.8 ELSE 0.2 END * pow(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2) * ((1 - y) * z + soft) AS focal,
greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM b), s AS (SELECT *, greatest(q - 0.05, 0) AS m FROM c)
SELECT variance, round(avg(bce), 9) AS bce, round(avg(focal), 9) AS focal, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE pow(m, 4) * -ln(1 - m) END), 9) AS asymmetric, count(*) AS n FROM s GROUP BY variance""")
def pointwise_losses(spark, root):
    z, y = F.col("z"), F.col("y")
    made = {"bce": losses.weighted_bce(z, y, 2.5), "focal": losses.focal(z, y), "asymmetric": losses.asymmetric(z, y)}
    out = losses.loss_table(_logits(spark, root), "z", "y", made, ["variance"])
    return out.select("variance", *(F.round(c, 9).alias(c) for c in made), "n")


_CENTRES = "d AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM d GROUP BY ALL)"


@register("svdd", f"WITH {_CENTRES}, p AS (SELECT label, vec_id, sum(x * m) / sqrt(sum(CAST(x AS DOUBLE) * x)) / sqrt(sum(m * m)) AS cos FROM d JOIN c USING (label, pos) GROUP BY ALL) SELECT label, round(avg(2 - 2 * cos), 6) AS loss, count(*) AS n FROM p GROUP BY label")
def svdd(spark, root):
    e = table(spark, root, "embeddings")
    return losses.svdd(e, "label", "embedding", losses.class_means(e, "label", "embedding")).withColumn("loss", F.round("loss", 6))


@register("center_loss", f"WITH {_CENTRES} SELECT round(sum((x - m) * (x - m)) / 2 / count(DISTINCT vec_id), 6) AS loss, count(DISTINCT vec_id) AS n FROM d JOIN c USING (label, pos)")
def center_loss(spark, root):
    e = table(spark, root, "embeddings")
    return losses.centre_loss(e, "label", "embedding", losses.class_means(e, "label", "embedding")).withColumn("loss", F.round("loss", 6))


@register("center_update", f"WITH {_CENTRES} SELECT label, CAST(pos - 1 AS INT) AS pos, round(0.2 * m, 7) AS centre FROM c")
def center_update(spark, root):
    e = table(spark, root, "embeddings")
    start = losses.class_means(e, "label", "embedding").select("label", F.transform("centre", lambda x: x * 0.0).alias("centre"))
    moved = losses.moved_centres(e, "label", "embedding", start)
    return moved.select("label", F.posexplode("centre").alias("pos", "centre")).withColumn("centre", F.round("centre", 7))


@register("gaussian_kernel", "SELECT p_partkey, list_transform(range(0, 128), lambda k: round(-1 / sqrt(2 * pi() * ln(2)) * exp(-0.5 * pow(p_size / 5.0 - k * (10.0 / 127), 2) / ln(2)), 9) + 0.0) AS kernels FROM part")
def gaussian_kernel(spark, root):
    k = gaussian_kernels(F.col("p_size") / 5.0)
    return table(spark, root, "part").select("p_partkey", F.transform(k, lambda x: F.round(x, 9) + 0.0).alias("kernels"))


@register("kernel_centrality", "WITH k AS (SELECT l_suppkey AS u, k, sum(-1 / sqrt(2 * pi() * ln(2)) * exp(-0.5 * pow(l_quantity / 5.0 - k * (10.0 / 7), 2) / ln(2))) AS s FROM lineitem CROSS JOIN (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL) SELECT u, CAST(k AS INT) AS k, round(s, 6) AS s FROM k")
def kernel_centrality(spark, root):
    kernels = gaussian_kernels(F.col("l_quantity") / 5.0, kernels=8)
    rows = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("u"), F.posexplode(kernels).alias("k", "x"))
    return rows.groupBy("u", "k").agg(F.round(F.sum("x"), 6).alias("s"))


@register("electronegativity_bins", "SELECT p_partkey, CASE WHEN x >= 0 AND x < 11 THEN CAST(x AS INT) ELSE 11 END AS code FROM (SELECT p_partkey, round_even((p_retailprice / 500.0 - 2.5) / 0.05, 0) AS x FROM part)")
def electronegativity_bins(spark, root):
    return table(spark, root, "part").select("p_partkey", electronegativity_code(F.col("p_retailprice") / 500.0).alias("code"))


@register("lr_schedule", "SELECT e AS epoch, round(CASE WHEN e < 10 THEN (e + 1) / 10.0 ELSE greatest(1 - 0.99 * (e - 10) / 440.0, 0.01) END, 9) AS factor FROM (SELECT unnest(range(0, 450)) AS e)")
def lr_schedule(spark, root):
    return spark.range(450).select(F.col("id").alias("epoch"), F.round(learning_rate_factor(F.col("id"), 10, 450, 0.01), 9).alias("factor"))


# Attention: softmax of products of the vectors of a label; distance from the ids.
_ATT = """v AS (SELECT label AS g, vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.g, a.i % 2 AS head, a.i, b.i AS j, list_dot_product(a.e, b.e) AS z FROM v a JOIN v b ON a.g = b.g),
a AS (SELECT g, head, i, j, exp(z - max(z) OVER (PARTITION BY g, i)) AS w FROM s), att AS (SELECT g, head, i, j, w / sum(w) OVER (PARTITION BY g, i) AS a, CASE WHEN abs(i - j) % 23 = 22 THEN -1 ELSE abs(i - j) % 23 END AS d FROM a)"""


def _attention(spark, root):
    v = table(spark, root, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("i"), "embedding")
    other = v.select("g", F.col("i").alias("j"), F.col("embedding").alias("f"))
    scored = v.join(other, "g").select("g", (F.col("i") % 2).alias("head"), "i", "j", messages.dot(F.col("embedding"), F.col("f")).alias("z"))
    row = Window.partitionBy("g", "i")
    weight = scored.withColumn("w", F.exp(F.col("z") - F.max("z").over(row)))
    gap = F.abs(F.col("i") - F.col("j")) % 23
    return weight.select("g", "head", "i", "j", (F.col("w") / F.sum("w").over(row)).alias("a"), F.when(gap == 22, -1).otherwise(gap).cast("bigint").alias("d"))


@register("attn_entropy", f"WITH {_ATT}, r AS (SELECT g, head, i, sum(-greatest(a, 1e-12) * ln(greatest(a, 1e-12))) AS h, count(*) FILTER (i <> j) AS k FROM att GROUP BY ALL) SELECT head, round(avg(CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END), 6) AS entropy, count(*) AS n FROM r GROUP BY head")
def attn_entropy(spark, root):
    return attention.entropy(_attention(spark, root)).withColumn("entropy", F.round("entropy", 6))


@register("attn_by_distance", f"WITH {_ATT} SELECT head, d, round(avg(a), 7) AS mean, count(*) AS n FROM att WHERE d >= 0 GROUP BY ALL")
def attn_by_distance(spark, root):
    return attention.by_distance(_attention(spark, root)).withColumn("mean", F.round("mean", 7))


@register("long_range_ratio", f"WITH {_ATT} SELECT head, round(sum(a) FILTER (d >= 8) / greatest(sum(a) FILTER (d > 0), 1e-12), 7) AS share_8, round(sum(a) FILTER (d >= 16) / greatest(sum(a) FILTER (d > 0), 1e-12), 7) AS share_16 FROM att GROUP BY head")
def long_range_ratio(spark, root):
    return attention.long_range(_attention(spark, root)).select("head", F.round("share_8", 7).alias("share_8"), F.round("share_16", 7).alias("share_16"))


@register("attn_pearson", f"WITH {_ATT} SELECT head, round(corr(a, d), 6) AS r FROM att WHERE d >= 0 AND i <> j GROUP BY head")
def attn_pearson(spark, root):
    return attention.distance_correlation(_attention(spark, root)).withColumn("r", F.round("r", 6))


@register("attn_layer_means", f"WITH {_ATT}, h AS (SELECT g AS layer, head, avg(a) AS m FROM att GROUP BY ALL) SELECT layer, round(avg(m), 9) AS mean, count(*) AS n FROM h GROUP BY layer")
def attn_layer_means(spark, root):
    return attention.layer_means(_attention(spark, root).withColumnRenamed("g", "layer"), "layer", "head", "a").withColumn("mean", F.round("mean", 9))


# Batches: molecules by their length.
@register("sortish_order", """WITH r AS (SELECT row_id, length(molecule_smiles) AS size, row_number() OVER (ORDER BY md5('7|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS pos FROM molecules WHERE molecule_smiles IS NOT NULL)
SELECT row_id, size, pos // 2048 AS win, pos // 2048 * 2048 + row_number() OVER (PARTITION BY pos // 2048 ORDER BY size DESC, pos) - 1 AS place FROM r""")
def sortish_order(spark, root):
    rows = table(spark, root, "molecules").where("molecule_smiles is not null").select("row_id", F.length("molecule_smiles").cast("bigint").alias("size"))
    return batching.sortish_order(rows, "row_id", "size", 2048, 7)


@register("batch_estimate", "SELECT CAST(greatest(ceil(coalesce(sum(length(molecule_smiles)), 0) / 15000.0), 1) AS BIGINT) AS n_batches FROM molecules")
def batch_estimate(spark, root):
    return batching.batch_estimate(table(spark, root, "molecules").select(F.length("molecule_smiles").alias("n")), "n", 15_000)


@register("collate_offsets", "SELECT l_orderkey, l_partkey, CAST(coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT l_orderkey, l_partkey, sum(l_linenumber) AS q FROM lineitem GROUP BY ALL)")
def collate_offsets(spark, root):
    rows = table(spark, root, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_linenumber").alias("q"))
    return batching.pack_offsets(rows, "l_orderkey", "l_partkey", "q")
