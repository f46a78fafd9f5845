"""The graph of the parquet tables: holding rows as assets and relations."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitegrove.graph import Graph
from sitegrove.sources.tables import holding, table

ASSET_COLUMNS = ("seq", "site_id", "type", "url", "is_loaded", "is_initial", "is_redirect", "status_code", "encoding", "content_type", "last_known_byte_length", "md5_hex", "file_name", "extension", "added_at", "removed_at")
RELATION_COLUMNS = ("type", "site_id", "from_id", "to_id", "ord", "href", "base_url", "target_type", "media", "seen_at")


def narrow_graph(spark: SparkSession, sf: str, *more: str) -> Graph:
    """Holding rows without contents: all that graph queries need (`more` columns of assets where named), so no text is shuffled."""
    return Graph(holding(table(spark, sf, "assets"), *ASSET_COLUMNS, *more), holding(table(spark, sf, "relations"), *RELATION_COLUMNS))


def text_graph(spark: SparkSession, sf: str) -> Graph:
    """Holding rows with text, for transforms of contents; relations have no attributes of their nodes here."""
    relations = holding(table(spark, sf, "relations"), *RELATION_COLUMNS).withColumn("node_attrs", F.lit(None).cast("map<string,string>")).withColumn("in_head", F.lit(True))
    return Graph(holding(table(spark, sf, "assets"), *ASSET_COLUMNS, "text", "raw_src").withColumn("props", F.lit(None).cast("map<string,string>")), relations)


#: The same holding rows for ANSI SQL: `a` and `r`.
HOLD = """WITH RECURSIVE a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM assets) WHERE rn = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM relations) WHERE rn = 1)"""
