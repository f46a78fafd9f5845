"""Functions of urls and small texts, the rest of the query language, and transforms of the graph without contents."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.functions import urls as U
from sitegrove.functions.text import srcset_entries, srcset_text
from sitegrove.operators import transforms as T
from sitegrove.operators.aggregate import readable_size
from sitegrove.operators.facts import asset_facts
from sitegrove.plans.tables_graph import HOLD, narrow_graph
from sitegrove.sources.loaders import data_url_parts
from sitegrove.sources.tables import holding, table

KINDS = ("absolute", "protocolRelative", "rootRelative", "relative")


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    """Relations with the urls at both ends."""
    graph = narrow_graph(spark, sf)
    urls = graph.assets.where(F.col("url").isNotNull())
    edges = graph.relations.select("id", "from_id", "to_id", "type", "href")
    return edges.join(urls.select(F.col("id").alias("from_id"), F.col("url").alias("from_url")), "from_id").join(urls.select(F.col("id").alias("to_id"), F.col("url").alias("to_url")), "to_id")


def href_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Hrefs of every kind between the ends of each relation, resolved again."""
    kinds = _ends(spark, sf).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    built = kinds.withColumn("built", U.build_href("to_url", "from_url", "kind"))
    return built.select("id", "kind", U.resolve_url("built", "from_url").alias("target"))


def root_relative_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return _ends(spark, sf).select("id", U.build_href("to_url", "from_url", F.lit("rootRelative")).alias("href"))


def canonical_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    known = narrow_graph(spark, sf).find_assets({"url": {"$exists": True}})
    moved = U.canonical_href(F.col("url"), "https://", "//cdn.example/")
    return known.select("id", moved.alias("href"), U.is_canonical(moved, "//cdn.example/").alias("canonical"))


def new_fragments(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = narrow_graph(spark, sf).relations.where(F.col("href").isNotNull())
    return hrefs.select("id", U.with_fragment(F.col("href"), F.lit("#part")).alias("changed"), U.with_fragment(F.col("href"), F.lit("")).alias("bare"))


def data_url_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All bytes written as data: urls and read again."""
    kept = holding(table(spark, sf, "assets"), "raw_src").where(F.col("raw_src").isNotNull())
    return kept.select("id", F.md5(data_url_parts(U.data_url(F.lit("application/octet-stream"), F.col("raw_src")))["raw_src"]).alias("digest"))


def file_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).assets.select("id", readable_size(F.col("last_known_byte_length")).alias("size"))


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return asset_facts(narrow_graph(spark, sf).assets.withColumn("text", F.lit(None).cast("string"))).select("id", "description", "is_inline", "base_name", "path", "origin")


def srcset_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Srcsets made of the hrefs: their entries, and the srcset written again."""
    plain = F.regexp_replace("href", "[^A-Za-z0-9/._,-]", "-")
    made = narrow_graph(spark, sf).relations.where(F.col("href").isNotNull()).select("id", F.concat(F.lit("  a/"), plain, F.lit("x 1x,  b/"), plain, F.lit("y\t200w , c")).alias("srcset"))
    entries = made.select("id", srcset_entries(F.col("srcset")).alias("e"))
    return entries.select("id", F.col("e")[0]["url"].alias("first"), F.col("e")[1]["url"].alias("second"), F.col("e")[1]["descriptors"].alias("width"), srcset_text(F.col("e")).alias("whole"))


def more_finds(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of queries with the operators that no other query uses."""
    graph = narrow_graph(spark, sf)
    finds = {
        "all": graph.find_assets({}), "nothing": graph.find_assets(None), "regex": graph.find_assets({"url": {"$regex": "\\.css$"}}), "in nothing": graph.find_assets({"type": {"$in": []}}),
        "function of a value": graph.find_assets({"seq": lambda c: c % 2 == 0}), "function": graph.find_assets(lambda df: df["type"] == "Css"), "and": graph.find_assets({"$and": [{"type": "Css"}, {"is_loaded": True}]}),
        "not equal": graph.find_assets({"type": {"$ne": "Css"}}), "less": graph.find_assets({"seq": {"$lte": 50}}), "not regex": graph.find_assets({"url": {"$not": re.compile("^https:")}}), "from types": graph.find_relations({"from": {"type": {"$in": ["Css", "Svg"]}}}),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in finds.items()]
    return functools.reduce(DataFrame.unionByName, counted)


def removed_relations(spark: SparkSession, sf: str) -> DataFrame:
    return T.remove_relations(narrow_graph(spark, sf), {"type": {"$in": ["HtmlAnchor", "SvgAnchor"]}}).relations.select("id", "type")


def replaced_asset(spark: SparkSession, sf: str) -> DataFrame:
    return T.replace_asset(narrow_graph(spark, sf), "a0000000001", "a0000000002").relations.select("id", "from_id", "to_id")


def cloned_assets(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    cloned = T.clone_assets(graph, {"type": "Css"}).assets
    return cloned.where(F.col("type") == "Css").select("url", "seq")


def updated_assets(spark: SparkSession, sf: str) -> DataFrame:
    graph = T.update_assets(narrow_graph(spark, sf), {"type": "Css", "encoding": {"$ne": "utf-8"}}, {"encoding": "utf-8"})
    return graph.assets.groupBy("type", "encoding").agg(F.count(F.lit(1)).alias("n"))


def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    edges = T.add_javascript_source_url(narrow_graph(spark, sf)).relations
    return edges.where(F.col("type") == "JavaScriptSourceUrl").select("from_id", "to_id", "href")


def styles_as_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports per inline sheet that stands for the styles of a page."""
    before = narrow_graph(spark, sf)
    graph = T.convert_html_styles_to_inline_css_imports(before.with_(assets=before.assets.withColumn("text", F.lit(None).cast("string"))), 2)
    sheets = graph.relations.where(F.col("type") == "HtmlStyle").select(F.col("to_id").alias("sheet"), F.col("from_id").alias("page"))
    return graph.relations.where(F.col("type") == "CssImport").join(sheets, F.col("from_id") == F.col("sheet")).groupBy("page", "sheet").agg(F.count(F.lit(1)).alias("n"), F.min("to_id").alias("least")).select("page", "n", "least")


def moved_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Style sheets moved into one folder, where names meet."""
    graph = narrow_graph(spark, sf)
    sheets = graph.find_assets({"type": "Css", "url": {"$exists": True}})
    return T.move_assets(graph, sheets.select("id", F.concat(F.lit("https://w.example/"), F.pmod("seq", F.lit(7)).cast("string"), F.lit(".css")).alias("new_url"))).assets.where(F.col("type") == "Css").select("id", "url")


QUERIES = {
    f.__name__: f
    for f in (
        href_round_trip, root_relative_hrefs, canonical_hrefs, new_fragments, data_url_round_trip, file_sizes, descriptions, srcset_round_trip, more_finds, removed_relations, replaced_asset, cloned_assets, updated_assets, source_urls, styles_as_imports, moved_assets,
    )
}

_ENDS = f"{HOLD}, x AS (SELECT r.id, f.url AS from_url, t.url AS to_url FROM r JOIN a f ON f.id = r.from_id JOIN a t ON t.id = r.to_id WHERE f.url IS NOT NULL AND t.url IS NOT NULL)"
_ORIGIN = "regexp_extract({0}, '^([^:/?#]+://[^/?#]*)', 1)"
_PLAIN = "regexp_replace(href, '[^A-Za-z0-9/._,-]', '-', 'g')"
_COUNTS = {
    "all": "a", "nothing": "a", "regex": "a WHERE regexp_matches(url, '\\.css$')", "in nothing": "a WHERE false", "function of a value": "a WHERE seq % 2 = 0", "function": "a WHERE type = 'Css'", "and": "a WHERE type = 'Css' AND is_loaded", "not equal": "a WHERE type IS DISTINCT FROM 'Css'", "less": "a WHERE seq <= 50",
    "not regex": "a WHERE NOT coalesce(starts_with(url, 'https:'), false)", "from types": "r WHERE from_id IN (SELECT id FROM a WHERE type IN ('Css', 'Svg'))",
}
SQL = {
    "href_round_trip": f"{_ENDS} SELECT id, kind, CASE WHEN kind = 'protocolRelative' THEN regexp_extract(from_url, '^[^:]+') || regexp_replace(to_url, '^[^:]+', '') ELSE to_url END AS target FROM x, (VALUES {', '.join(f'({k!r})' for k in KINDS)}) AS k (kind)",
    "root_relative_hrefs": f"{_ENDS} SELECT id, CASE WHEN {_ORIGIN.format('from_url')} = {_ORIGIN.format('to_url')} THEN CASE WHEN starts_with(substr(to_url, 1 + length({_ORIGIN.format('to_url')})), '/') THEN '' ELSE '/' END || substr(to_url, 1 + length({_ORIGIN.format('to_url')})) ELSE to_url END AS href FROM x",
    "canonical_hrefs": f"{HOLD} SELECT id, CASE WHEN starts_with(url, 'https://') THEN '//cdn.example/' || substr(url, 9) ELSE url END AS href, starts_with(url, 'https://') AS canonical FROM a WHERE url IS NOT NULL",
    "new_fragments": f"{HOLD} SELECT id, regexp_replace(href, '(?s)#.*$', '') || '#part' AS changed, regexp_replace(href, '(?s)#.*$', '') AS bare FROM r WHERE href IS NOT NULL",
    "data_url_round_trip": f"{HOLD} SELECT id, md5(raw_src) AS digest FROM a WHERE raw_src IS NOT NULL",
    "file_sizes": f"{HOLD}, s AS (SELECT id, last_known_byte_length AS n FROM a) SELECT id, CASE WHEN n >= 1000000 THEN format('{{:,.1f}} MB', n / 1048576.0) WHEN n >= 1000 THEN format('{{:,.1f}} KB', n / 1024.0) ELSE n || ' B' END AS size FROM s",
    "descriptions": f"""{HOLD} SELECT id, '[' || coalesce(type, 'null') || '/' || id || ' ' || coalesce(url, 'inline') || ']' AS description, url IS NULL AS is_inline, regexp_replace(nullif(CASE WHEN regexp_matches(url, '(?i)^(?:https?|file):') THEN regexp_extract(regexp_extract(url, '^[^?#]*'), '^[^:]+://[^/]*(?:/[^/]*)*?/?([^/]*)$', 1) END, ''), '\\.[^.]*$', '') AS base_name,
regexp_extract(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '^(.*/)', 1) AS path, nullif({_ORIGIN.format('url')}, '') AS origin FROM a""",
    "srcset_round_trip": f"{HOLD} SELECT id, 'a/' || {_PLAIN} || 'x' AS first, 'b/' || {_PLAIN} || 'y' AS second, '200w' AS width, 'a/' || {_PLAIN} || 'x 1x, b/' || {_PLAIN} || 'y 200w, c' AS whole FROM r WHERE href IS NOT NULL",
    "more_finds": f"{HOLD} " + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {where}" for name, where in _COUNTS.items()),
    "removed_relations": f"{HOLD} SELECT id, type FROM r WHERE type NOT IN ('HtmlAnchor', 'SvgAnchor')",
    "replaced_asset": f"{HOLD} SELECT id, from_id, CASE WHEN to_id = 'a0000000001' THEN 'a0000000002' ELSE to_id END AS to_id FROM r WHERE from_id IS DISTINCT FROM 'a0000000001'",
    "cloned_assets": f"{HOLD}, c AS (SELECT url, seq, regexp_extract(url, '((?:\\.[^./?#]*)?(?:[?#].*)?)$', 1) AS tail FROM a WHERE type = 'Css') SELECT url, seq FROM c UNION ALL SELECT left(url, length(url) - length(tail)) || '-1' || tail, seq FROM c",
    "updated_assets": f"{HOLD} SELECT type, CASE WHEN type = 'Css' AND encoding IS DISTINCT FROM 'utf-8' THEN 'utf-8' ELSE encoding END AS encoding, count(*) AS n FROM a GROUP BY 1, 2",
    "source_urls": f"{HOLD} SELECT from_id, to_id, href FROM r WHERE type = 'JavaScriptSourceUrl' UNION ALL SELECT id, id, url FROM a WHERE type = 'JavaScript' AND url IS NOT NULL",
    "styles_as_imports": f"""{HOLD}, s AS (SELECT r.*, a.id IS NOT NULL AS inl FROM r LEFT JOIN a ON a.id = r.to_id AND a.url IS NULL WHERE r.type = 'HtmlStyle' AND r.to_id IS NOT NULL),
p AS (SELECT *, count(*) FILTER (WHERE inl) OVER (PARTITION BY from_id ORDER BY ord, id) AS part FROM s), n AS (SELECT *, (row_number() OVER (PARTITION BY from_id, part ORDER BY ord, id) - 1) // 2 AS k FROM p WHERE NOT inl)
SELECT from_id AS page, count(*) AS n, min(to_id) AS least FROM n GROUP BY from_id, part, k
UNION ALL SELECT s.from_id, count(*), min(i.to_id) FROM s JOIN r i ON i.from_id = s.to_id AND i.type = 'CssImport' WHERE s.inl GROUP BY s.from_id, s.to_id""",
    "moved_assets": f"""{HOLD}, m AS (SELECT id, seq, CASE WHEN type = 'Css' AND url IS NOT NULL THEN 'https://w.example/' || (seq % 7) || '.css' END AS new, url, type FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(new, url) ORDER BY new IS NULL, seq, id) - 1 AS n FROM m)
SELECT id, CASE WHEN url IS NULL THEN NULL WHEN n > 0 THEN 'https://w.example/' || (seq % 7) || '-' || n || '.css' ELSE new END AS url FROM k WHERE type = 'Css'""",
}
