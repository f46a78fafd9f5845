"""Parquet tables of the asset graph and the rule that picks each record's holding row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, whole; columns are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def holding(df: DataFrame, *columns: str, key: str = "id", version: str = "ingested_at") -> DataFrame:
    """One row per `key`: the `columns` of the row with the latest `version`.

    A hash aggregate with map-side combine, so only `key`, `version` and the named columns are shuffled; narrow the
    columns (derive a verdict from a text first) before calling it. Rows of equal key and version are equal by
    contract; if they are not, the greatest struct is taken, so the result does not depend on row order. A null version
    counts as the earliest. Rows whose key is null are dropped.
    """
    packed = F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    out = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(packed).alias("_h"))
    return out.select(key, *[F.col("_h").getField(f"_{i}").alias(c) for i, c in enumerate(columns)])


def alive(at: Column, added: Column, removed: Column) -> Column:
    """True where an asset with this life span is alive at `at`; a null `added` or `at` is never alive."""
    return F.coalesce((added <= at) & (removed.isNull() | (at < removed)), F.lit(False))
