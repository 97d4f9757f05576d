"""Sources and sinks: shards, row logs, summaries, statistics in two shapes, fingerprint caches, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions.columns import finite, finite_array


def write_shards(df: DataFrame, path: str, chunk: str | None = None, rows_per_file: int = 50_000) -> None:
    """Parquet shards, partitioned by a chunk column when one is given; zstd, at most ``rows_per_file`` rows a file."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(chunk) if chunk else writer).parquet(path)


def read_shards(spark: SparkSession, paths: Sequence[str], seed: int | None = None) -> DataFrame:
    """All shards as one table; with a seed, rows come in a seeded order within each shard file's partition."""
    df = spark.read.parquet(*paths)
    return df if seed is None else df.withColumn("_order", F.xxhash64(F.lit(seed), F.input_file_name(), F.monotonically_increasing_id())).sortWithinPartitions("_order").drop("_order")


def write_id_list(ids: DataFrame, column: str, path: str) -> None:
    """A list of row ids, in their order, as JSON lines with their positions from 0 on."""
    from facetmill.operators.sampling import dense_index

    dense_index(ids.select(F.col(column).alias("id")), "id").select(F.col("idx").alias("at"), "id").write.mode("overwrite").json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(at, id) from JSON lines, or from one JSON array of ids."""
    lines = spark.read.schema("at long, id long").json(path).where("id is not null")
    array = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<bigint>")).alias("at", "id"))
    return lines if lines.limit(1).count() else array.select(F.col("at").cast("bigint").alias("at"), "id")


ROW_LOG = "variance int, sigma double, alpha double, model_score double, model_scores array<double>, checkpoint_path string, mean_curves array<double>"


def read_row_log(spark: SparkSession, path: str) -> DataFrame:
    """A sweep log from a JSON array or JSON lines; NaN is allowed."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(ROW_LOG).option("multiLine", array).option("allowNonNumericNumbers", True).json(path)


def write_row_log(df: DataFrame, path: str) -> None:
    """A sweep log as JSON lines, NaN and infinities as null."""
    clean = {c: finite(F.col(c)) if t in ("double", "float") else finite_array(F.col(c)) for c, t in df.dtypes if t in ("double", "float", "array<double>")}
    df.withColumns(clean).write.mode("overwrite").json(path)


def summary_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


STATS = "map<string,array<double>>"


def statistics(json_column: Column) -> Column:
    """Per-layer statistics from a document that has them under ``stats`` or at its top."""
    wrapped = F.from_json(json_column, f"stats {STATS}").getField("stats")
    return F.coalesce(wrapped, F.from_json(json_column, STATS))


def write_cache(df: DataFrame, path: str, name: str, vector_bits: int, digest: str, version: str = "1") -> str:
    """A fingerprint cache named by what it holds: parquet and a small JSON of its settings; returns its folder."""
    folder = f"{path.rstrip('/')}/{cache_id(name, vector_bits, digest, version)}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows")
    meta = json.dumps({"name": name, "bits": vector_bits, "digest": digest, "version": version})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return folder


def cache_id(name: str, vector_bits: int, digest: str, version: str = "1") -> str:
    return f"{name}-b{vector_bits}-v{version}-{digest[:12]}"


def read_cache(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/rows"), json.loads(spark.read.text(f"{folder}/meta", wholetext=True).first()[0])


def shown(c: Column, digits: int = 4) -> Column:
    """A number for a report; null as NA."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise("NA")


def report_lines(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """(line): one ``label | name: value`` line for each column of each row; append with ``mode("append").text``."""
    numeric = {"double", "float", "int", "bigint", "smallint"}
    lines = F.array(*(F.concat(F.lit(f"{label} | {c}: "), shown(F.col(c), digits) if t in numeric else F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c, t in df.dtypes))
    return df.select(F.explode(lines).alias("line"))
