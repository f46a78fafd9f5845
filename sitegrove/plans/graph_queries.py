"""Queries, aggregates and fixpoints on the graph of the parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.functions import urls as U
from sitegrove.operators import aggregate, traverse
from sitegrove.operators.facts import request_destinations
from sitegrove.plans.pipeline import Pipeline
from sitegrove.plans.tables_graph import HOLD, narrow_graph
from sitegrove.schema import inferred_type, registry
from sitegrove.session import cut
from sitegrove.sinks import dot_lines, stats_table
from sitegrove.sources.loaders import KNOWN_PROTOCOLS, protocol_support
from sitegrove.sources.tables import holding, table


def anchors_by_href_type(spark: SparkSession, sf: str) -> DataFrame:
    found = narrow_graph(spark, sf).find_relations({"type": "HtmlAnchor"})
    return found.groupBy("from_id", U.href_type(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def relation_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).relations.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("to_id").alias("resolved"), F.count_distinct("from_id").alias("sources"))


def find_assets_regex(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).find_assets({"type": "Html", "url": re.compile(r"\.html(\?|$)")}).select("id", "url", "seq")


def find_assets_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).find_assets({"encoding": {"$nin": ["utf-8", "UTF-8", "utf8"]}, "type": {"$not": re.compile("^(Png|Gif|Jpeg|Woff2)$")}}).select("id", "type", "encoding")


def find_assets_operators(spark: SparkSession, sf: str) -> DataFrame:
    query = {"$or": [{"status_code": {"$gte": 300, "$lt": 500}}, {"last_known_byte_length": {"$gt": 5000}, "is_initial": True}], "url": {"$exists": True}, "site_id": {"$mod": [3, 1]}}
    return narrow_graph(spark, sf).find_assets(query).select("id", "status_code", "last_known_byte_length")


def find_relations_nested(spark: SparkSession, sf: str) -> DataFrame:
    query = {"type": {"$in": ["HtmlAnchor", "HtmlScript", "HtmlStyle"]}, "to": {"type": "Html", "url": {"$regex": "^https:"}}, "from": {"is_loaded": True}}
    return narrow_graph(spark, sf).find_relations(query).select("id", "type", "from_id", "to_id")


def elem_match_incoming(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).find_assets({"incomingRelations": {"$elemMatch": {"type": "CssImport", "media": {"$exists": False}}}}).select("id", "type")


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return narrow_graph(spark, sf).find_assets({"url": {"$exists": True}, "incomingRelations": {"$size": 0}}).select("id", "url")


def stats_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return stats_table(narrow_graph(spark, sf)).select("kind", "assets", "bytes", "is_total")


def merge_identical(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.identical_survivors(narrow_graph(spark, sf).assets)


def merged_edges(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    _, relations = aggregate.merge_identical(graph.assets, graph.relations)
    return relations.select("id", "from_id", "to_id")


def remove_duplicate_styles(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.first_style_per_page(narrow_graph(spark, sf).relations).where(F.col("type") == "HtmlStyle").select("id", "from_id", "to_id")


def incompatible_types(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    return aggregate.incompatible_types(graph.assets, graph.relations)


def content_type_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """As if all assets of odd sites had been served as plain text, or pages as Json, beside what the table says."""
    graph = narrow_graph(spark, sf, "location")
    odd = F.col("site_id") % 2 == 1
    served = F.when(odd & (F.col("type") == "Html"), "application/json; charset=utf-8").when(odd & F.col("type").isin("JavaScript", "Css"), "Text/Plain").otherwise(F.col("content_type"))
    return aggregate.content_type_conflicts(graph.assets.withColumn("content_type", served), graph.relations)


def hint_destinations(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    return request_destinations(graph.assets, graph.relations)


def rewritten_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Urls with a query string: with one more parameter, one in place, and without one."""
    u = F.col("url")
    known = narrow_graph(spark, sf).find_assets({"url": re.compile(r"\?")})
    return known.select("id", U.with_query_parameter(u, "added", F.lit("a b&c*")).alias("added"), U.with_query_parameter(u, "v", F.lit("new")).alias("changed"), U.without_query_parameter(u, "v").alias("removed"))


def protocols(spark: SparkSession, sf: str) -> DataFrame:
    return protocol_support(narrow_graph(spark, sf).relations)


def drawing(spark: SparkSession, sf: str) -> DataFrame:
    return dot_lines(narrow_graph(spark, sf), {"type": {"$in": ["Html", "Css"]}})


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Several transforms in a row, as a pipeline."""
    steps = Pipeline().merge_identical_assets().remove_duplicate_html_styles().if_(True).add_javascript_source_url().endif().remove_relations({"type": "HtmlAnchor"}).remove_unreferenced_assets({"is_initial": {"$ne": True}})
    narrow = narrow_graph(spark, sf)
    graph = steps.run(narrow.with_(cut(narrow.assets), cut(narrow.relations)), keep=True)
    return graph.relations.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def bundle_runs(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    numbered = graph.relations.withColumn("_o", F.format_string("%010d%s", "ord", "id"))
    return aggregate.runs(numbered, "from_id", "_o", "type").groupBy("from_id", "run").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n"))


def crossorigin_edges(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    ends = graph.assets.select("id", "url")
    joined = graph.relations.select("id", "from_id", "to_id").join(ends.select(F.col("id").alias("from_id"), F.col("url").alias("from_url")), "from_id").join(ends.select(F.col("id").alias("to_id"), F.col("url").alias("to_url")), "to_id")
    return joined.select("id", U.crossorigin(F.col("from_url"), F.col("to_url")).alias("is_crossorigin"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    known = narrow_graph(spark, sf).find_assets({"url": {"$exists": True}})
    return known.select("id", U.protocol(u).alias("protocol"), U.hostname(u).alias("hostname"), U.port(u).alias("port"), U.origin(u).alias("origin"), U.path_and_name(u).alias("path"), U.file_name(u).alias("file"), U.extension(u).alias("ext"), U.base_name(u).alias("base"), U.directory(u).alias("dir"))


def query_parameters(spark: SparkSession, sf: str) -> DataFrame:
    known = narrow_graph(spark, sf).find_assets({"url": re.compile(r"\?")})
    return known.select("id", F.explode(U.query_map(F.col("url"))).alias("name", "value"))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    relations = narrow_graph(spark, sf).relations.where(F.col("href").isNotNull())
    return relations.groupBy(U.fragment(F.col("href")).alias("frag")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(U.without_fragment(F.col("href"))).alias("targets"))


def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    assets = narrow_graph(spark, sf).assets
    return assets.groupBy(inferred_type(F.col("content_type"), F.lit(None).cast("string"), F.col("extension")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def reachable_assets(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    edges = graph.find_relations({"type": {"$nin": ["HtmlAnchor"]}})
    return traverse.reached_set(edges, graph.find_assets({"is_initial": True}))


def unreferenced_assets(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    return traverse.unreferenced(graph.assets, graph.relations, {"is_initial": {"$ne": True}})


def post_order(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    return traverse.collect_assets(graph.relations, graph.assets, graph.find_assets({"is_initial": True}), {"type": {"$nin": ["HtmlAnchor"]}}, post=True)


def selector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    relations = narrow_graph(spark, sf).relations.select("from_id", F.col("id").alias("_id"), F.length(F.coalesce("href", F.lit(""))).alias("w"))
    return aggregate.running_chunks(relations, "from_id", "_id", "w", 100).groupBy("from_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def diagnostics_by_month(spark: SparkSession, sf: str) -> DataFrame:
    kept = holding(table(spark, sf, "diagnostics"), "severity", "code", "raised_at")
    return kept.groupBy(F.lower("severity").alias("level"), "code", F.date_format("raised_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def minimum_referrer_distance(spark: SparkSession, sf: str) -> DataFrame:
    graph = narrow_graph(spark, sf)
    sites = graph.assets.where(F.col("is_initial")).select("id", F.col("site_id").alias("value"))
    return traverse.propagate_min(graph.relations, sites)


QUERIES = {
    f.__name__: f
    for f in (
        anchors_by_href_type, relation_counts_by_type, find_assets_regex, find_assets_not_in, find_assets_operators, find_relations_nested, elem_match_incoming, orphans, stats_by_type, merge_identical, merged_edges, remove_duplicate_styles,
        incompatible_types, content_type_warnings, hint_destinations, rewritten_queries, protocols, drawing, pipeline, bundle_runs, crossorigin_edges, url_parts, query_parameters, fragments, inferred_types, reachable_assets, unreferenced_assets, post_order, selector_chunks, diagnostics_by_month, minimum_referrer_distance,
    )
}

_KIND = """CASE WHEN href IS NULL OR regexp_matches(trim(href), '(?i)^data:') THEN 'inline' WHEN starts_with(trim(href), '//') THEN 'protocolRelative' WHEN starts_with(trim(href), '/') THEN 'rootRelative'
 WHEN regexp_matches(trim(href), '(?i)^[a-z+]+:') THEN 'absolute' ELSE 'relative' END"""
_PROTOCOL = "nullif(lower(regexp_extract({0}, '(?i)^([a-z][a-z0-9+.\\-]*:)', 1)), '')"
_AUTHORITY = "nullif(regexp_extract({0}, '(?i)^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1), '')"
_HOST = f"nullif(regexp_extract({_AUTHORITY}, '^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1), '')"
_PORT = f"CAST(nullif(regexp_extract({_AUTHORITY}, ':([0-9]+)$', 1), '') AS INTEGER)"
_EFFECTIVE = f"coalesce({_PORT}, CASE {_PROTOCOL} WHEN 'http:' THEN 80 WHEN 'https:' THEN 443 END)"
_PATH = "regexp_extract({0}, '(?i)^(?:[a-z][a-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_FILE = f"nullif(CASE WHEN regexp_matches({{0}}, '(?i)^(?:https?|file):') THEN regexp_extract({_PATH}, '([^/]+)$', 1) END, '')"
_SURVIVORS = f"{HOLD}, m AS (SELECT id, first_value(id) OVER (PARTITION BY type, md5_hex ORDER BY seq, id) AS survivor, count(*) OVER (PARTITION BY type, md5_hex) AS copies FROM a WHERE md5_hex IS NOT NULL)"

_NAMES = sorted(registry.types)
_CLASHES = ", ".join(f"('{a}', '{b}')" for a in _NAMES for b in _NAMES if a < b and not registry.compatible(a, b))

_ALL_CLASHES = ", ".join(f"('{a}', '{b}')" for a in _NAMES for b in _NAMES if not registry.compatible(a, b))
_BY_CONTENT_TYPE = ", ".join(f"('{a}', '{b}')" for a, b in sorted(registry.by_content_type().items()))
_QUERY = "regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1)"
_PLAIN = "regexp_extract({0}, '^([^?#]*)', 1)"

SQL = {
    "content_type_warnings": f"""{HOLD}, s AS (SELECT id, type, lower(trim(split_part(CASE WHEN site_id % 2 = 1 AND type = 'Html' THEN 'application/json; charset=utf-8' WHEN site_id % 2 = 1 AND type IN ('JavaScript', 'Css') THEN 'Text/Plain' ELSE content_type END, ';', 1))) AS served FROM a WHERE location IS NULL),
c AS (SELECT * FROM (VALUES {_BY_CONTENT_TYPE}) AS t (served, t)), z AS (SELECT * FROM (VALUES {_ALL_CLASHES}) AS t (x, y)),
own AS (SELECT s.id, s.served, s.type AS used FROM s JOIN c USING (served) JOIN z ON z.x = s.type AND z.y = c.t),
e AS (SELECT to_id AS id, arg_min(target_type, (ord, id)) AS used, list(DISTINCT target_type) AS seen FROM r WHERE to_id IS NOT NULL AND target_type IS NOT NULL GROUP BY to_id),
txt AS (SELECT s.id, s.served, e.used FROM s JOIN e USING (id) WHERE s.served = 'text/plain' AND e.used <> 'Text' AND NOT EXISTS (SELECT 1 FROM z WHERE z.x = e.used AND list_contains(e.seen, z.y)))
SELECT DISTINCT 'warn' AS severity, 'content-type' AS code, id AS asset_id, 'Asset served with a Content-Type of ' || served || ', but used as ' || used AS message FROM (SELECT * FROM own UNION ALL SELECT * FROM txt)""",
    "hint_destinations": f"""{HOLD}, h AS (SELECT id, to_id FROM r WHERE type IN ('HtmlDnsPrefetchLink', 'HtmlPreconnectLink', 'HtmlPrefetchLink', 'HtmlPreloadLink', 'HtmlPrerenderLink')),
x AS (SELECT h.id, h.to_id, a.type AS t, lower(regexp_extract(regexp_extract(a.url, '^[^?#]*'), '\\.([^./]*)$', 1)) AS ext, (SELECT arg_min(r.type, (r.ord, r.id)) FROM r WHERE r.to_id = h.to_id AND r.id <> h.id) AS other FROM h LEFT JOIN a ON a.id = h.to_id)
SELECT id, CASE WHEN to_id IS NULL THEN NULL WHEN t IN ('Png', 'Gif', 'Jpeg', 'Svg', 'Ico', 'Image') THEN 'image' WHEN t = 'JavaScript' THEN 'script' WHEN t = 'Css' THEN 'style' WHEN other IN ('HtmlStyle', 'CssImport') THEN 'style'
WHEN t = 'Html' AND other IN ('HtmlFrame', 'HtmlIFrame') THEN 'document' WHEN other IN ('HtmlAudio', 'HtmlVideo') THEN 'media' WHEN other = 'CssFontFaceSrc' THEN 'font' WHEN other = 'HtmlEmbed' THEN 'embed' WHEN other = 'HtmlObject' THEN 'object'
WHEN ext = 'css' THEN 'style' WHEN ext = 'js' THEN 'script' WHEN ext IN ('svg', 'jpg', 'jpeg', 'png', 'gif', 'webp', 'ico', 'tiff', 'bmp') THEN 'image' WHEN ext = 'html' THEN 'document' WHEN ext IN ('woff', 'woff2', 'ttf', 'eot', 'otf') THEN 'font' ELSE '' END AS destination FROM x""",
    "rewritten_queries": f"""{HOLD}, p AS (SELECT id, url, list_filter(string_split({_QUERY.format("url")}, '&'), lambda x: x <> '') AS parts FROM a WHERE contains(url, '?')),
q AS (SELECT id, {_PLAIN.format("url")} AS head, regexp_extract(url, '(?s)(#.*)$', 1) AS tail, list_transform(parts, lambda x: url_encode(url_decode(split_part(x, '=', 1))) || '=' || url_encode(url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)))) AS w FROM p)
SELECT id, head || '?' || array_to_string(list_append(w, 'added=a%20b%26c%2A'), '&') || tail AS added,
head || '?' || array_to_string(CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'v='))) > 0 THEN list_transform(w, lambda x: CASE WHEN starts_with(x, 'v=') THEN 'v=new' ELSE x END) ELSE list_append(w, 'v=new') END, '&') || tail AS changed,
head || CASE WHEN len(list_filter(w, lambda x: NOT starts_with(x, 'v='))) > 0 THEN '?' ELSE '' END || array_to_string(list_filter(w, lambda x: NOT starts_with(x, 'v=')), '&') || tail AS removed FROM q""",
    "protocols": f"""{HOLD}, k AS (SELECT lower(regexp_extract(trim(href), '(?i)^([a-z][a-z0-9+.\\-]*:)', 1)) AS protocol FROM r) SELECT protocol, CASE WHEN protocol IN ('http:', 'https:', 'file:', 'data:', 'javascript:') THEN 'loaded'
WHEN protocol IN ({", ".join(f"'{p}'" for p in KNOWN_PROTOCOLS)}) THEN 'known' ELSE 'unsupported' END AS support, count(*) AS n FROM k WHERE protocol <> '' GROUP BY 1, 2""",
    "drawing": f"""{HOLD}, n AS (SELECT id, type, url, regexp_extract({_PATH.format("url")}, '^(.*/)', 1) AS dir, coalesce({_FILE.format("url")}, url, 'inline ' || type) AS label FROM a WHERE type IN ('Html', 'Css')),
w AS (SELECT id, coalesce(dir, '') AS key, '"' || regexp_replace('cluster_' || coalesce(dir, 'inline'), '(["\\\\])', '\\\\\\1', 'g') || '"' AS c, '"' || regexp_replace(id, '(["\\\\])', '\\\\\\1', 'g') || '"' AS q, '"' || regexp_replace(label, '(["\\\\])', '\\\\\\1', 'g') || '"' AS l FROM n)
SELECT 0 AS part, key, 'subgraph ' || c || ' {{ ' || q || ' [label=' || l || ']; }}' AS line FROM w
UNION ALL SELECT 1, from_id, '"' || from_id || '" -> "' || to_id || '" [label="' || type || '"];' FROM r WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)""",
    "pipeline": f"""{_SURVIVORS}, gone AS (SELECT * FROM m WHERE id <> survivor),
e AS (SELECT r.id, r.type, r.ord, r.from_id, coalesce(gone.survivor, r.to_id) AS to_id FROM r LEFT JOIN gone ON gone.id = r.to_id WHERE r.from_id IS NULL OR r.from_id NOT IN (SELECT id FROM gone)),
one AS (SELECT id, type, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY ord, id) AS k FROM e) WHERE type <> 'HtmlAnchor' AND (to_id IS NULL OR k = 1 OR type NOT IN ('CacheManifestEntry', 'HtmlStyle'))
  UNION ALL SELECT id, 'JavaScriptSourceUrl', id, id FROM a WHERE type = 'JavaScript' AND url IS NOT NULL AND id NOT IN (SELECT id FROM gone)),
c AS (SELECT id FROM a WHERE url IS NOT NULL AND is_initial IS DISTINCT FROM true AND id NOT IN (SELECT id FROM gone)), l AS (SELECT DISTINCT from_id, to_id FROM one WHERE to_id IS NOT NULL),
tc AS (SELECT from_id AS src, to_id AS dst FROM l UNION SELECT tc.src, l.to_id FROM tc JOIN l ON l.from_id = tc.dst),
lost AS (SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.dst = c.id AND (tc.src NOT IN (SELECT id FROM c) OR tc.src IN (SELECT src FROM tc WHERE src = dst))))
SELECT type, count(*) AS n FROM one WHERE from_id IS NULL OR from_id NOT IN (SELECT id FROM lost) GROUP BY 1""",
    "incompatible_types": f"""{HOLD}, t AS (SELECT to_id AS id, target_type AS t FROM r WHERE to_id IS NOT NULL AND target_type IS NOT NULL UNION SELECT id, type FROM a WHERE type <> 'Asset')
SELECT 'warn' AS severity, 'incompatible-types' AS code, x.id AS asset_id, 'used as both ' || x.t || ' and ' || y.t AS message FROM t x JOIN t y ON x.id = y.id AND x.t < y.t WHERE (x.t, y.t) IN ({_CLASHES})""",
    "unreferenced_assets": f"""{HOLD}, c AS (SELECT id FROM a WHERE url IS NOT NULL AND is_initial IS DISTINCT FROM true), e AS (SELECT DISTINCT from_id, to_id FROM r WHERE to_id IS NOT NULL),
tc AS (SELECT from_id AS src, to_id AS dst FROM e UNION SELECT tc.src, e.to_id FROM tc JOIN e ON e.from_id = tc.dst)
SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM tc WHERE tc.dst = c.id AND (tc.src NOT IN (SELECT id FROM c) OR tc.src IN (SELECT src FROM tc WHERE src = dst)))""",
    "selector_chunks": f"""{HOLD}, w AS (SELECT from_id, length(coalesce(href, '')) AS w, row_number() OVER (PARTITION BY from_id ORDER BY id) AS k FROM r),
x AS (SELECT from_id, k, w, CAST(w AS BIGINT) AS total, 0 AS chunk FROM w WHERE k = 1
UNION ALL SELECT w.from_id, w.k, w.w, CASE WHEN x.total + w.w > 100 AND x.total > 0 THEN w.w ELSE x.total + w.w END, CASE WHEN x.total + w.w > 100 AND x.total > 0 THEN x.chunk + 1 ELSE x.chunk END FROM x JOIN w ON w.from_id IS NOT DISTINCT FROM x.from_id AND w.k = x.k + 1)
SELECT from_id, chunk, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM x GROUP BY 1, 2""",
    "anchors_by_href_type": f"{HOLD} SELECT from_id, {_KIND} AS kind, count(*) AS n FROM r WHERE type = 'HtmlAnchor' GROUP BY 1, 2",
    "relation_counts_by_type": f"{HOLD} SELECT type, count(*) AS n, count(to_id) AS resolved, count(DISTINCT from_id) AS sources FROM r GROUP BY 1",
    "find_assets_regex": f"{HOLD} SELECT id, url, seq FROM a WHERE type = 'Html' AND regexp_matches(url, '\\.html(\\?|$)')",
    "find_assets_not_in": f"{HOLD} SELECT id, type, encoding FROM a WHERE coalesce(encoding NOT IN ('utf-8', 'UTF-8', 'utf8'), true) AND NOT coalesce(regexp_matches(type, '^(Png|Gif|Jpeg|Woff2)$'), false)",
    "find_assets_operators": f"{HOLD} SELECT id, status_code, last_known_byte_length FROM a WHERE (coalesce(status_code >= 300 AND status_code < 500, false) OR coalesce(last_known_byte_length > 5000 AND is_initial, false)) AND url IS NOT NULL AND site_id % 3 = 1",
    "find_relations_nested": f"{HOLD} SELECT id, type, from_id, to_id FROM r WHERE type IN ('HtmlAnchor', 'HtmlScript', 'HtmlStyle') AND EXISTS (SELECT 1 FROM a WHERE a.id = r.to_id AND a.type = 'Html' AND regexp_matches(a.url, '^https:')) AND EXISTS (SELECT 1 FROM a WHERE a.id = r.from_id AND a.is_loaded)",
    "elem_match_incoming": f"{HOLD} SELECT id, type FROM a WHERE EXISTS (SELECT 1 FROM r WHERE r.to_id = a.id AND r.type = 'CssImport' AND r.media IS NULL)",
    "orphans": f"{HOLD} SELECT id, url FROM a WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.to_id = a.id)",
    "stats_by_type": f"{HOLD} SELECT coalesce(kind, 'Total') AS kind, count(*) AS assets, CAST(sum(n) AS BIGINT) AS bytes, kind IS NULL AS is_total FROM (SELECT type AS kind, coalesce(last_known_byte_length, 0) AS n FROM a WHERE url IS NOT NULL AND is_loaded AND NOT coalesce(is_redirect, false)) GROUP BY ROLLUP (kind)",
    "merge_identical": f"{_SURVIVORS} SELECT id, survivor FROM m WHERE copies > 1",
    "merged_edges": f"""{_SURVIVORS}, gone AS (SELECT * FROM m WHERE id <> survivor),
e AS (SELECT r.id, r.type, r.ord, r.from_id, coalesce(gone.survivor, r.to_id) AS to_id FROM r LEFT JOIN gone ON gone.id = r.to_id WHERE r.from_id IS NULL OR r.from_id NOT IN (SELECT id FROM gone))
SELECT id, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, type ORDER BY ord, id) AS k FROM e) WHERE type <> 'CacheManifestEntry' OR to_id IS NULL OR k = 1""",
    "remove_duplicate_styles": f"{HOLD} SELECT id, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY ord, id) AS k FROM r WHERE type = 'HtmlStyle') WHERE to_id IS NULL OR k = 1",
    "bundle_runs": f"""{HOLD}, b AS (SELECT from_id, ord, id, type, CASE WHEN row_number() OVER w > 1 AND type IS DISTINCT FROM lag(type) OVER w THEN 1 ELSE 0 END AS changed FROM r WINDOW w AS (PARTITION BY from_id ORDER BY ord, id)),
c AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY from_id ORDER BY ord, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b) SELECT from_id, run, min(type) AS type, count(*) AS n FROM c GROUP BY 1, 2""",
    "crossorigin_edges": f"""{HOLD}, e AS (SELECT r.id, f.url AS fu, t.url AS tu FROM r JOIN a f ON f.id = r.from_id JOIN a t ON t.id = r.to_id)
SELECT id, CASE WHEN fu IS NULL OR tu IS NULL THEN false ELSE {_PROTOCOL.format("fu")} IS DISTINCT FROM {_PROTOCOL.format("tu")} OR lower({_HOST.format("fu")}) IS DISTINCT FROM lower({_HOST.format("tu")}) OR {_EFFECTIVE.format("fu")} IS DISTINCT FROM {_EFFECTIVE.format("tu")} END AS is_crossorigin FROM e""",
    "url_parts": f"""{HOLD} SELECT id, {_PROTOCOL.format("url")} AS protocol, {_HOST.format("url")} AS hostname, {_PORT.format("url")} AS port, nullif(regexp_extract(url, '(?i)^([a-z][a-z0-9+.\\-]*://[^/?#]*)', 1), '') AS origin, {_PATH.format("url")} AS path, {_FILE.format("url")} AS file,
regexp_extract({_FILE.format("url")}, '(\\.[^.]*)$', 1) AS ext, regexp_replace({_FILE.format("url")}, '\\.[^.]*$', '') AS base, regexp_extract({_PATH.format("url")}, '^(.*/)', 1) AS dir FROM a WHERE url IS NOT NULL""",
    "query_parameters": f"""{HOLD}, p AS (SELECT id, unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS part, generate_subscripts(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), 1) AS k FROM a WHERE regexp_matches(url, '\\?')),
q AS (SELECT id, k, url_decode(split_part(part, '=', 1)) AS name, url_decode(regexp_extract(part, '^[^=]*=(.*)$', 1)) AS value FROM p WHERE part <> '')
SELECT id, name, arg_max(value, k) AS value FROM q GROUP BY id, name""",
    "fragments": f"{HOLD} SELECT regexp_extract(href, '(?s)(#.*)$', 1) AS frag, count(*) AS n, count(DISTINCT regexp_replace(href, '(?s)#.*$', '')) AS targets FROM r WHERE href IS NOT NULL GROUP BY 1",
    "reachable_assets": f"""{HOLD}, reach AS (SELECT id, 0 AS depth FROM a WHERE is_initial UNION SELECT r.to_id, reach.depth + 1 FROM reach JOIN r ON r.from_id = reach.id WHERE r.type <> 'HtmlAnchor' AND r.to_id IS NOT NULL AND reach.depth < 64)
SELECT id, min(depth) AS depth FROM reach GROUP BY id""",
    "minimum_referrer_distance": f"{HOLD}, v AS (SELECT id, site_id AS value FROM a WHERE is_initial UNION SELECT r.to_id, v.value FROM v JOIN r ON r.from_id = v.id WHERE r.to_id IS NOT NULL) SELECT id, min(value) AS value FROM v GROUP BY id",
    "inferred_types": f"""{HOLD}, t AS (SELECT CASE regexp_extract(lower(content_type), '^([^;]*)', 1) WHEN 'text/html' THEN 'Html' WHEN 'application/javascript' THEN 'JavaScript' WHEN 'text/javascript' THEN 'JavaScript' WHEN 'text/css' THEN 'Css' WHEN 'application/json' THEN 'Json' WHEN 'image/svg+xml' THEN 'Svg'
 WHEN 'application/atom+xml' THEN 'Atom' WHEN 'image/png' THEN 'Png' WHEN 'image/jpeg' THEN 'Jpeg' WHEN 'image/gif' THEN 'Gif' WHEN 'font/woff2' THEN 'Woff2' WHEN 'text/xml' THEN 'Xml' WHEN 'application/octet-stream' THEN 'Asset' WHEN 'text/plain' THEN 'Text' END AS own,
 CASE WHEN lower(extension) IN ('.html', '.template', '.xhtml', '.shtml', '.ko', '.ejs') THEN 'Html' WHEN lower(extension) = '.css' THEN 'Css' WHEN lower(extension) = '.js' THEN 'JavaScript' WHEN lower(extension) IN ('.json', '.topojson') THEN 'Json' WHEN lower(extension) = '.svg' THEN 'Svg' WHEN lower(extension) = '.atom' THEN 'Atom' WHEN lower(extension) = '.xml' THEN 'Xml' WHEN lower(extension) IN ('.rss', '.rdf') THEN 'Rss'
 WHEN lower(extension) = '.png' THEN 'Png' WHEN lower(extension) IN ('.jpg', '.jpeg') THEN 'Jpeg' WHEN lower(extension) = '.gif' THEN 'Gif' WHEN lower(extension) = '.woff2' THEN 'Woff2' WHEN lower(extension) IN ('.txt', '.md', '.csv', '.rst', '.tsv', '.htaccess', '.ics', '.xtemplate') THEN 'Text' WHEN lower(extension) = '.webmanifest' THEN 'ApplicationManifest' WHEN lower(extension) = '.map' THEN 'SourceMap' END AS ext FROM a)
SELECT CASE WHEN own IS NULL THEN ext WHEN own = 'Asset' THEN coalesce(ext, own) WHEN own = 'Json' AND ext IN ('ApplicationManifest', 'SourceMap') THEN ext ELSE own END AS kind, count(*) AS n FROM t GROUP BY 1""",
    "diagnostics_by_month": "SELECT lower(severity) AS level, code, strftime(raised_at, '%Y-%m') AS month, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM diagnostics) WHERE rn = 1 GROUP BY 1, 2, 3",
}
