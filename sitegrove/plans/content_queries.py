"""Extraction from the contents of the tables, and transforms of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.extract.operator import extract, resolved, with_inline
from sitegrove.functions.content import content
from sitegrove.functions.text import sniffed_charset, srcset_entries
from sitegrove.graph import Graph
from sitegrove.operators import styles as S
from sitegrove.operators import transforms as T
from sitegrove.operators.facts import asset_facts
from sitegrove.operators.traverse import inline_owner, populate
from sitegrove.plans.tables_graph import HOLD, text_graph
from sitegrove.sources.tables import holding, table


#: The types that relations are extracted from.
SOURCES = ("Html", "Css", "JavaScript", "Svg", "Atom")


def _texts(spark: SparkSession, sf: str, *types: str, decoded: bool = True) -> DataFrame:
    """id, type, url, text of the holding rows; only these types' texts are shuffled.

    Assets that aren't decoded yet give their raw content; not with `decoded=False`, for queries whose SQL knows the column
    text only.
    """
    assets = table(spark, sf, "assets")
    text = F.when(F.col("type").isin(*types), content() if decoded else F.col("text"))
    return holding(assets.select("id", "ingested_at", "type", "url", text.alias("text")), "type", "url", "text")


def extracted_relations(spark: SparkSession, sf: str) -> DataFrame:
    """All relations in the texts, inline assets included, counted by type."""
    relations, _ = with_inline(_texts(spark, sf, *SOURCES), levels=None)
    return relations.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("href").alias("with_href"))


def extracted_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, type, href) of the plain attribute relations of complete pages."""
    pages = _texts(spark, sf, "Html", decoded=False).where(F.col("text").rlike(r"(?i)</html>\s*$") & ~F.col("text").rlike(r"<!--|<svg|<noscript|<template|[<>=]{7}"))
    found = extract(pages, ["HtmlAnchor", "HtmlImage", "HtmlStyle", "HtmlScript"])
    return found.where(F.col("href").isNotNull()).select("from_id", "type", "href").distinct()


def extracted_hrefs_all(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, type, href) of the same relations of all pages, whatever they hold; those in inline assets count for the
    page around them. Regular expressions can't follow these, so there is no SQL."""
    found, _ = with_inline(_texts(spark, sf, "Html"), levels=None)
    return found.where(F.col("type").isin("HtmlAnchor", "HtmlImage", "HtmlStyle", "HtmlScript") & F.col("href").isNotNull()).select(F.col("owner_id").alias("from_id"), "type", "href").distinct()


def css_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, href) of image and font urls in sheets without comments and strings."""
    sheets = _texts(spark, sf, "Css", decoded=False).where(~F.col("text").rlike(r"/\*|content\s*:|[<>=]{7}"))
    return extract(sheets, ["CssImage", "CssFontFaceSrc"]).select("from_id", "href").distinct()


def css_urls_all(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (id, href) of image and font urls in all sheets, with comments and strings; without SQL as above."""
    return extract(_texts(spark, sf, "Css"), ["CssImage", "CssFontFaceSrc"]).select("from_id", "href").distinct()


def resolved_targets(spark: SparkSession, sf: str) -> DataFrame:
    """How many extracted relations of each type resolve to an asset of the table."""
    assets = _texts(spark, sf, *SOURCES)
    found = resolved(extract(assets), assets)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("to_id").alias("resolved"))


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Urls loaded by a crawl from the initial pages over stylesheets, scripts and images."""
    assets = holding(table(spark, sf, "assets").withColumn("text", content()), "type", "url", "text", "is_initial").where(F.col("url").isNotNull())
    web = assets.groupBy("url").agg(F.min_by(F.struct("id", "type", "text"), "id").alias("x")).select("url", "x.*")
    bases = web.select("id", "url")
    starts = assets.where(F.col("is_initial") & (F.col("type") == "Html")).select("url")
    loaded, _, _ = populate(web, starts, lambda pages: resolved(extract(pages), bases), {"type": {"$nin": ["HtmlAnchor"]}})
    return loaded.select("id", "type")


def inline_owners(spark: SparkSession, sf: str) -> DataFrame:
    graph = text_graph(spark, sf)
    return inline_owner(graph.assets.select("id", "url"), graph.relations)


def charsets(spark: SparkSession, sf: str) -> DataFrame:
    kept = holding(table(spark, sf, "assets").select("id", "ingested_at", sniffed_charset(F.col("raw_src")).alias("charset")), "charset")
    return kept.groupBy("charset").agg(F.count(F.lit(1)).alias("n"))


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    graph = T.bundle_relations(text_graph(spark, sf), {"type": {"$in": ["HtmlStyle", "HtmlScript"]}}, "sharedBundles")
    return graph.relations.where(F.col("type").isin("HtmlStyle", "HtmlScript")).select("id", "from_id", "to_id", "type")


def css_imports_to_styles(spark: SparkSession, sf: str) -> DataFrame:
    graph = T.convert_css_imports_to_html_styles(text_graph(spark, sf))
    return graph.relations.where(F.col("type") == "HtmlStyle").select("from_id", "to_id")


def cache_manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    # Without the texts and all else that entries don't depend on, which the holding rows would shuffle.
    named = Graph(holding(table(spark, sf, "assets"), "type", "url", "is_loaded", "is_initial"), holding(table(spark, sf, "relations"), "type", "from_id", "to_id"))
    graph = T.add_cache_manifest(named, {"is_initial": True})
    return graph.relations.where(F.col("type") == "CacheManifestEntry").select("from_id", "to_id")


def _content_graph(spark: SparkSession, sf: str) -> Graph:
    """The text graph, with the contents of assets that aren't decoded yet."""
    graph = text_graph(spark, sf)
    return graph.with_(assets=graph.assets.withColumn("text", content()))


def _page_digests(graph: Graph) -> DataFrame:
    return graph.assets.where((F.col("type") == "Html") & F.col("text").isNotNull()).select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def critical_css(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with their critical rules inlined."""
    return _page_digests(S.inline_critical_css(_content_graph(spark, sf)))


def inline_styles(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with their sheets' rules in style attributes."""
    return _page_digests(S.convert_stylesheets_to_inline_styles(_content_graph(spark, sf)))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(_texts(spark, sf, "Html", "JavaScript", "Css", "Json", decoded=False))


def facts_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same facts with contents that aren't decoded yet; the SQL of `facts` cannot decode, so there is none."""
    return _facts(_texts(spark, sf, "Html", "JavaScript", "Css", "Json"))


def _facts(assets: DataFrame) -> DataFrame:
    return asset_facts(assets).select("id", "is_inline", "is_image", "is_font", "is_text", "is_fragment", "is_strict", "is_pretty", "hostname")


def minified(spark: SparkSession, sf: str) -> DataFrame:
    graph = text_graph(spark, sf)
    return T.minify_assets(graph, {"type": {"$in": ["Json", "Css", "Svg"]}}).assets.where(F.col("type").isin("Json", "Css", "Svg") & F.col("text").isNotNull()).select("id", F.length("text").alias("chars"))


def stripped(spark: SparkSession, sf: str) -> DataFrame:
    graph = text_graph(spark, sf)
    return T.strip_debug(graph).assets.where((F.col("type") == "JavaScript") & F.col("text").isNotNull()).select("id", F.md5("text").alias("digest"))


def gzipped(spark: SparkSession, sf: str) -> DataFrame:
    graph = text_graph(spark, sf)
    return T.gzip(graph).assets.where(F.col("url").endswith(".gz")).select("id", "url", F.length("raw_src").alias("bytes"))


def selector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "Css").where(F.col("text").isNotNull()).select("id", T.rule_count("text").alias("selectors"))


def srcsets(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of all srcsets: those in pages, at any depth, and assets of this type."""
    assets = _texts(spark, sf, "Html", "SrcSet")
    _, inline = with_inline(assets, levels=None)
    whole = inline.select("id", "type", "text").unionByName(assets.select("id", "type", "text")).where((F.col("type") == "SrcSet") & F.col("text").isNotNull())
    return whole.select("id", F.inline(srcset_entries(F.col("text"))))


QUERIES = {
    f.__name__: f
    for f in (
        extracted_relations, extracted_hrefs, extracted_hrefs_all, css_urls, css_urls_all, resolved_targets, crawl, inline_owners, charsets, bundles, css_imports_to_styles, cache_manifest_entries, critical_css, inline_styles, facts, facts_all, minified, stripped, gzipped, selector_counts, srcsets,
    )
}

SQL = {
    "charsets": f"""{HOLD}, h AS (SELECT CAST(raw_src[1:1024] AS VARCHAR) AS s FROM a) SELECT lower(coalesce(nullif(regexp_extract(s, '(?i)<meta[^>]*charset\\s*=\\s*["'']?\\s*([\\w-]+)', 1), ''), nullif(regexp_extract(s, '(?i)^\\s*@charset\\s*["'']([\\w-]+)["'']', 1), ''), nullif(regexp_extract(s, '(?i)^\\s*<\\?xml[^>]*encoding\\s*=\\s*["'']([\\w-]+)["'']', 1), ''))) AS charset, count(*) AS n FROM h GROUP BY 1""",
    "inline_owners": f"""{HOLD}, p AS (SELECT to_id, arg_min(from_id, (ord, from_id)) AS parent FROM r WHERE to_id IN (SELECT id FROM a WHERE url IS NULL) GROUP BY to_id),
o AS (SELECT id, id AS owner_id FROM a WHERE url IS NOT NULL UNION SELECT p.to_id, o.owner_id FROM o JOIN p ON p.parent = o.id) SELECT id, owner_id FROM o""",
    "css_imports_to_styles": f"""{HOLD}, s AS (SELECT DISTINCT from_id AS page, to_id AS sheet FROM r WHERE type = 'HtmlStyle' AND to_id IS NOT NULL), i AS (SELECT DISTINCT from_id, to_id FROM r WHERE type = 'CssImport' AND to_id IS NOT NULL),
m AS (SELECT page, sheet, to_id AS y FROM s JOIN i ON i.from_id = s.sheet UNION SELECT m.page, m.sheet, i.to_id FROM m JOIN i ON i.from_id = m.y)
SELECT from_id, to_id FROM r WHERE type = 'HtmlStyle' UNION ALL SELECT DISTINCT page, y FROM m WHERE y <> sheet""",
    "cache_manifest_entries": f"""{HOLD}, e AS (SELECT DISTINCT from_id, to_id FROM r WHERE to_id IS NOT NULL AND type NOT IN ('HtmlAnchor', 'HtmlMetaRefresh', 'HtmlCacheManifest', 'HtmlConditionalComment', 'JavaScriptSourceUrl', 'JavaScriptSourceMappingUrl', 'JavaScriptSourceMap')),
p AS (SELECT id, coalesce((SELECT min(to_id) FROM r WHERE r.type = 'HtmlCacheManifest' AND r.from_id = a.id), md5('manifest|' || id)) AS manifest FROM a WHERE type = 'Html' AND url IS NOT NULL AND is_initial),
m AS (SELECT id AS start, id FROM p UNION SELECT m.start, e.to_id FROM m JOIN e ON e.from_id = m.id)
SELECT from_id, to_id FROM r WHERE type = 'CacheManifestEntry' UNION ALL
SELECT p.manifest, m.id FROM m JOIN p ON p.id = m.start JOIN a ON a.id = m.id WHERE m.id <> m.start AND a.url IS NOT NULL AND a.is_loaded AND NOT EXISTS (SELECT 1 FROM r WHERE r.type = 'CacheManifestEntry' AND r.from_id = p.manifest AND r.to_id = m.id)""",
    "facts": f"""{HOLD} SELECT id, url IS NULL AS is_inline, coalesce(type IN ('Png', 'Gif', 'Jpeg', 'Svg'), false) AS is_image, coalesce(type = 'Woff2', false) AS is_font, coalesce(type IN ('Html', 'JavaScript', 'Css', 'Json', 'Svg', 'Atom', 'Text'), false) AS is_text,
CASE WHEN type = 'Html' THEN NOT regexp_matches(text, '(?i)<(?:!doctype|html|head|body)[\\s>]') END AS is_fragment,
CASE WHEN type = 'JavaScript' THEN regexp_matches(regexp_replace(text, '(?s:/\\*.*?\\*/)|//[^\\n]*', '', 'g'), '^\\s*["'']use strict["'']') END AS is_strict,
CASE WHEN type = 'Json' THEN regexp_matches(text, '^\\s*[\\[{{]\\s*\\n\\s') END AS is_pretty, nullif(regexp_extract(nullif(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1), ''), '^(?:.*@)?([^:]*)', 1), '') AS hostname FROM a""",
    "extracted_hrefs": f"""{HOLD}, p AS (SELECT id, text FROM a WHERE type = 'Html' AND regexp_matches(text, '(?i)</html>\\s*$') AND NOT regexp_matches(text, '<!--|<svg|<noscript|<template|[<>=]{{7}}')),
e AS (SELECT id, 'HtmlAnchor' AS type, unnest(regexp_extract_all(text, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM p
UNION ALL SELECT id, 'HtmlImage', unnest(regexp_extract_all(text, '(?i)<img\\s[^>]*?src=["'']([^"'']*)["'']', 1)) FROM p
UNION ALL SELECT id, 'HtmlStyle', unnest(regexp_extract_all(text, '(?i)<link\\s[^>]*?stylesheet[^>]*?href=["'']([^"'']*)["'']', 1)) FROM p
UNION ALL SELECT id, 'HtmlScript', unnest(regexp_extract_all(text, '(?i)<script\\s[^>]*?src=["'']([^"'']*)["'']', 1)) FROM p)
SELECT DISTINCT id AS from_id, type, href FROM e""",
    "css_urls": f"""{HOLD}, p AS (SELECT id, text FROM a WHERE type = 'Css' AND NOT regexp_matches(text, '/\\*|content\\s*:|[<>=]{{7}}')),
e AS (SELECT id, unnest(regexp_extract_all(text, '(?:background|background-image|src)\\s*:\\s*url\\(["'']?([^"'')]*)["'']?\\)', 1)) AS href FROM p) SELECT DISTINCT id AS from_id, href FROM e""",
}

