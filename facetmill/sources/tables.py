"""Reading the input tables: columnar scans that stay lazy so that Catalyst prunes and pushes down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The parquet table ``name`` under ``root``, projected to ``columns`` when they are given."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
