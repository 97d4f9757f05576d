"""The training-data queries over the project's tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.llm import collapse, cross_split, group_split, heavy, leaks, mixing, neighbours, packing, quotas, spam
from facetmill.sources.scratch import Scratch
from facetmill.sources.tables import table

PROTEINS = ("BRD4", "HSA", "sEH")
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
#: Molecules ingested from here on are a later batch.
LATER = "2024-06-01"
FREQUENT = 1 / 200
TOP = 50
NEAREST = 3
LEAST_SIMILARITY = 0.6
#: File of a public tokenizer, where the session's ``facetmill.tokenizer`` names none; every executor must reach it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _molecules(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "molecules")


def _plan_report(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    usable = quotas.usable_rows(table(spark, root, "bindings"), "id", "protein_name", "binds", PROTEINS)
    rows = quotas.plan_report(usable, table(spark, root, "sample_plans"), "plan_id", "protein_name", "binds", "target_share", "sample_frac", "min_rows")
    return usable, spark.createDataFrame(rows, quotas.REPORT)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Cells of the sampling plans that the usable rows can't fill."""
    _, report = _plan_report(spark, root)
    return report.where("shortfall > 0").select("plan_id", F.col("category").alias("protein_name"), F.col("label").alias("binds"))


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    """Of every plan the rows drawn: exactly the quota of each cell."""
    usable, report = _plan_report(spark, root)
    drawn = quotas.draw(usable, report)
    return drawn.select("plan_id", F.col("category").alias("protein_name"), F.col("label").alias("binds"), "id")


def p1_quotas(spark: SparkSession, root: str) -> DataFrame:
    """Of every cell of every plan its target, what is there, the quota drawn, what it lacks, and the shares wanted and reached."""
    return _plan_report(spark, root)[1].withColumnsRenamed({"category": "protein_name", "label": "binds"})


def p1_sizes(spark: SparkSession, root: str) -> DataFrame:
    """The size of every plan's sample: what its targets or its floors need, as far as rows are there."""
    return _plan_report(spark, root)[1].groupBy("plan_id").agg(F.sum("quota").alias("size"), F.count("*").alias("n_cells"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The smallest row of each group of same records with each other row of it."""
    found = collapse.collapse(_molecules(spark, root), "row_id", "molecule_smiles", least=2)
    return found.members.where("id <> rep_id").select(F.col("rep_id").alias("row_id_a"), F.col("id").alias("row_id_b")).distinct()


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """One record for each group of same records, with its number of copies."""
    return collapse.collapse(_molecules(spark, root), "row_id", "molecule_smiles").records


def _capacities(spark: SparkSession, root: str) -> dict[int, int]:
    rows = table(spark, root, "pack_limits").dropna().limit(101).collect()
    if len(rows) > 100:
        raise ValueError("more than 100 container sizes")
    return {int(r.limit_id): int(r.max_chars) for r in rows}


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that the packing had to cut."""
    placed = packing.pack(_molecules(spark, root), "row_id", "molecule_smiles", _capacities(spark, root))
    return placed.where("n_pieces > 1 and piece = 0").select("limit_id", F.col("id").alias("row_id")).distinct()


def p3_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every piece of every row."""
    placed = packing.pack(_molecules(spark, root), "row_id", "molecule_smiles", _capacities(spark, root))
    return placed.withColumnRenamed("id", "row_id")


def p3_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Of each container size the rows and characters packed, and the containers that hold more than fits: none."""
    sizes = F.create_map(*(F.lit(x) for pair in _capacities(spark, root).items() for x in pair))
    held = p3_containers(spark, root).groupBy("limit_id", "container").agg(F.sum("length").alias("held"), F.count_if(F.col("piece") == 0).alias("rows"))
    over = F.count_if(F.col("held") > F.element_at(sizes, F.col("limit_id").cast("int")))
    return held.groupBy("limit_id").agg(F.sum("rows").alias("n_rows"), F.sum("held").alias("n_chars"), over.alias("n_overfull"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows of train and of another split that are the same record or nearly so."""
    found = cross_split.overlaps(_molecules(spark, root), "row_id", "molecule_smiles", "split")
    return cross_split.row_pairs(found).select("row_id_a", "row_id_b").distinct()


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation rows that also stand in train, by split and source."""
    rows = _molecules(spark, root)
    return cross_split.report(rows, cross_split.overlaps(rows, "row_id", "molecule_smiles", "split"), "row_id", "split", "source")


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose record stands in both train and another split, or nearly, with its class and the number of classes it links to."""
    found = cross_split.overlaps(_molecules(spark, root), "row_id", "molecule_smiles", "split")
    return cross_split.linked_classes(found).withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every row of each tied group that lies in more than one split."""
    return group_split.broken_ties(_molecules(spark, root), "row_id", "split", ["molecule_smiles"], ["scaffold", "lot_code"])


def p5_assign(spark: SparkSession, root: str) -> DataFrame:
    """A split for every row, the same for all tied rows."""
    return group_split.assign_splits(_molecules(spark, root), "row_id", ["molecule_smiles"], ["scaffold", "lot_code"], SHARES)[0].drop("outcome")


def p5_batches(spark: SparkSession, root: str) -> DataFrame:
    """The split of each row ingested from LATER on, against the saved table of the rows before, which have splits.

    outcome: kept (an existing component's split), filled (a new component) or quarantined.
    """
    rows = _molecules(spark, root)
    later = F.coalesce(F.col("ingested_at") >= F.lit(LATER).cast("timestamp"), F.lit(False))
    ties = ["molecule_smiles"], ["scaffold", "lot_code"]
    path = f"{Scratch(spark, 'table').root}/components"
    group_split.present_table(rows.where(~later), "row_id", "split", *ties, path)
    state = group_split.open_state(spark, path)
    out, after = group_split.assign_splits(rows.where(later), "row_id", *ties, SHARES, state=state)
    group_split.save(after, path)
    return out


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Values that make up at least one in 200 of the rows with a value."""
    found = heavy.frequent_values(table(spark, root, "bindings"), "molecule_smiles", FREQUENT)
    return found.select(F.col("value").alias("molecule_smiles"))


def p6_top(spark: SparkSession, root: str) -> DataFrame:
    """The most frequent values with approximate counts."""
    return heavy.top_values(table(spark, root, "bindings"), "molecule_smiles", TOP).withColumnRenamed("value", "molecule_smiles")


def p6_ranks(spark: SparkSession, root: str) -> DataFrame:
    """The true counts of the values that the sketch ranks first, in order: those of the truly most frequent ones if it misses none."""
    top = p6_top(spark, root).select("molecule_smiles")
    # TOP rows
    exact = table(spark, root, "bindings").join(F.broadcast(top), "molecule_smiles").groupBy("molecule_smiles").agg(F.count("*").alias("n_rows"))
    return exact.select((F.row_number().over(Window.orderBy(F.desc("n_rows"), "molecule_smiles"))).alias("nth"), "n_rows")


def _nearest(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.nearest(table(spark, root, "fingerprints"), "row_id", "fps", NEAREST, LEAST_SIMILARITY)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's most similar."""
    return _nearest(spark, root).select(F.least("id", "other").alias("row_id_a"), F.greatest("id", "other").alias("row_id_b")).distinct()


def p7_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Each vector's most similar others, with rank and similarity."""
    return _nearest(spark, root).select(F.col("id").alias("row_id"), F.col("other").alias("other_row_id"), "similarity", "nth")


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked_windows(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the items of which they hold a whole window of words."""
    return _leaks(spark, root).where("n_equal > 0").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    """How many documents hold passages of each item, and how many windows at most."""
    found = _leaks(spark, root)
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_windows").alias("most_windows"), F.max("n_equal").alias("most_equal"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources that can't give their target share within the repeats allowed, tokens being pieces between white space."""
    docs = table(spark, root, "documents")
    members = mixing.memberships(docs, "doc_id", "text", "source", mixing.blank_tokens(F.col("text")), merge=False)
    report, _ = mixing.mix_report(members, table(spark, root, "mix_targets"))
    return spark.createDataFrame(report, mixing.REPORT).where("lacking > 0").select("recipe_id", "source")


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, list[tuple], list[tuple]]:
    scratch = Scratch(spark, "tokens")
    counted = mixing.model_tokens(table(spark, root, "documents"), "doc_id", "text", "source", spark.conf.get("facetmill.tokenizer", TOKENIZER))
    # from here on texts are only told apart
    counted = scratch.write(counted.withColumn("text", F.sha2("text", 256)), "counted")
    members = scratch.write(mixing.memberships(counted, "doc_id", "text", "source", F.col("n_tokens"), merge=True), "members")
    return counted, members, *mixing.mix_report(members, table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Tokens wanted and reached by source of every recipe, in tokens of a public tokenizer, and those of its repeated texts that count once."""
    counted, _, report, _ = _mix(spark, root)
    merged = mixing.merged_away(counted, "doc_id", "text", "source", F.col("n_tokens"))
    shares = spark.createDataFrame(report, mixing.REPORT).withColumn("key", mixing.letters(F.col("source")))
    return shares.join(merged, "key", "left").drop("key").withColumn("merged_tokens", F.coalesce("merged_tokens", F.lit(0)))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The documents of every recipe with their copies."""
    _, members, _, flows = _mix(spark, root)
    return mixing.select_documents(members, spark.createDataFrame(flows, mixing.FLOWS))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose word frequencies are no prose: keywords, links, menus or tags in a row."""
    return spam.spam_pages(table(spark, root, "documents"), "doc_id", "text", "lang").select("doc_id").distinct()


def p10_pages(spark: SparkSession, root: str) -> DataFrame:
    """The same pages with the fit of their rank-frequency curve and their distances from prose."""
    return spam.spam_pages(table(spark, root, "documents"), "doc_id", "text", "lang")


_USABLE = """
usable AS (
  SELECT DISTINCT id, CASE regexp_replace(lower(protein_name), '[^a-z0-9]', '', 'g') WHEN 'brd4' THEN 'BRD4' WHEN 'hsa' THEN 'HSA' WHEN 'seh' THEN 'sEH' END AS protein, binds
  FROM bindings WHERE id IS NOT NULL AND binds IN (0, 1) AND regexp_replace(lower(protein_name), '[^a-z0-9]', '', 'g') IN ('brd4', 'hsa', 'seh')),
cells AS (SELECT protein, binds, count(*) AS n FROM usable GROUP BY 1, 2),
total AS (SELECT count(*) AS n FROM usable)"""

_SQUEEZE = r"""regexp_replace(molecule_smiles, '[\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}-\x{2064}\x{3000}\x{feff}]', '', 'g')"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_quotas, p1_sample, p1_sizes, p2_found, p2_records, p3_found, p3_containers, p3_coverage, p4_found, p4_report, p4_classes, p5_found, p5_assign, p5_batches, p6_found, p6_top, p6_ranks, p7_found, p7_neighbours, p8_found, p8_leaks, p9_found, p9_shares, p9_mix, p10_found, p10_pages)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH {_USABLE}
SELECT p.plan_id, p.protein_name, p.binds
FROM sample_plans p CROSS JOIN total t LEFT JOIN cells c ON c.protein = p.protein_name AND c.binds = p.binds
WHERE coalesce(c.n, 0) < p.target_share * p.sample_frac * t.n OR coalesce(c.n, 0) < p.min_rows""",
        "p1_sizes": f"""
WITH {_USABLE},
wanted AS (SELECT plan_id, protein_name, binds, sum(target_share * sample_frac * t.n) AS target, max(coalesce(min_rows, 0)) AS least FROM sample_plans, total t GROUP BY ALL),
held AS (SELECT w.*, coalesce(c.n, 0) AS there FROM wanted w LEFT JOIN cells c ON c.protein = w.protein_name AND c.binds = w.binds)
SELECT plan_id, CAST(least(sum(there), greatest(sum(least(there, least)), floor(sum(target) + 0.5 + 1e-6))) AS BIGINT) AS size, count(*) AS n_cells FROM held GROUP BY plan_id""",
        "p3_coverage": f"""
WITH m AS (SELECT length({_SQUEEZE}) AS n FROM molecules WHERE row_id IS NOT NULL)
SELECT l.limit_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars, 0::BIGINT AS n_overfull FROM m, pack_limits l WHERE n > 0 GROUP BY l.limit_id""",
        "p6_ranks": r"""
WITH c AS (SELECT count(*) AS n_rows FROM bindings WHERE regexp_matches(molecule_smiles, '[^\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]') GROUP BY molecule_smiles)
SELECT CAST(row_number() OVER (ORDER BY n_rows DESC) AS INT) AS nth, n_rows FROM c ORDER BY n_rows DESC LIMIT 50""",
        "p3_found": f"""
SELECT l.limit_id, m.row_id FROM (SELECT row_id, length({_SQUEEZE}) AS n FROM molecules) m JOIN pack_limits l ON m.n > l.max_chars""",
        "p6_found": r"""
WITH rows_ AS (SELECT molecule_smiles FROM bindings WHERE regexp_matches(molecule_smiles, '[^\s\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]'))
SELECT molecule_smiles FROM rows_ GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM rows_) / 200.0""",
        "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE length(text) > 0),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE length(text) > 0),
dw AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
iw AS (SELECT item_id, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
        "p9_found": r"""
WITH d AS (SELECT regexp_replace(lower(source), '[^\p{L}]', '', 'g') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT s, sum(n) AS n FROM d WHERE s <> '' GROUP BY s)
SELECT m.recipe_id, m.source FROM mix_targets m LEFT JOIN t ON t.s = regexp_replace(lower(m.source), '[^\p{L}]', '', 'g')
WHERE m.target_share * m.total_factor * (SELECT sum(n) FROM t) > m.max_repeats * coalesce(t.n, 0)""",
    }
