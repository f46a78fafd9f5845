"""Queries on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.llm.leaks import leaked
from sitegrove.llm.packing import WORD_PUNCT, containers, oversized_documents, pack_documents
from sitegrove.llm.residue import residue
from sitegrove.sources.tables import table


def capacity(spark: SparkSession, sf: str) -> int:
    """The token limit of documents: one aggregated number."""
    return table(spark, sf, "size_limits").where(F.col("target_table") == "documents").agg(F.min("max_size")).first()[0]


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), capacity(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return oversized_documents(_packed(spark, sf))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(_packed(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item: in how many documents its passage or answer leaked, and the longest run of words."""
    return _leaks(spark, sf).groupBy("item_id", "field").agg(F.countDistinct("doc_id").alias("documents"), F.max("shared_words").alias("longest"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents")).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_reasons": p8_reasons}
SQL = {
    "p6_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{WORD_PUNCT}')) > (SELECT min(max_size) FROM size_limits WHERE target_table = 'documents')",
}
