"""Queries on the content of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.llm.copies import collapse, format_copies
from sitegrove.llm.mojibake import garbled_records
from sitegrove.llm.splitting import oversized_assets, split_assets
from sitegrove.llm.unparsable import parse_rates, parse_verdicts
from sitegrove.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_verdicts(table(spark, sf, "assets")).where(F.col("verdict") != "valid").select("id")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return parse_rates(parse_verdicts(table(spark, sf, "assets")), table(spark, sf, "sites"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_records(table(spark, sf, "assets"), "site_id", "type").select("id")


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_records(table(spark, sf, "assets"), "site_id", "type")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return oversized_assets(table(spark, sf, "assets"), table(spark, sf, "size_limits")).select("id")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_assets(table(spark, sf, "assets"), table(spark, sf, "size_limits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    copies = format_copies(table(spark, sf, "assets"))
    return copies.where(F.col("id") != F.col("keeper")).select(F.col("keeper").alias("id_a"), F.col("id").alias("id_b"))


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(format_copies(table(spark, sf, "assets")))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_collapsed": p5_collapsed}
SQL: dict[str, str] = {}
