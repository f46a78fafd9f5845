"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sitegrove.operators.dangling import all_references, dangling, dangling_references, dangling_report, id_references
from sitegrove.session import cut
from sitegrove.sources.tables import holding, table


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, name) for name in ("assets", "relations", "diagnostics", "sites")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return dangling_references(*_tables(spark, sf)).select("table_name", "record_id", "field_name").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    refs, parents = all_references(*_tables(spark, sf))
    return dangling_report(dangling(refs, parents), refs)


def p1_ids_report(spark: SparkSession, sf: str) -> DataFrame:
    kept = holding(table(spark, sf, "assets"), "added_at", "removed_at")
    refs = cut(id_references(table(spark, sf, "relations"), table(spark, sf, "diagnostics")))
    return dangling_report(dangling(refs, kept.withColumnRenamed("id", "key")), refs)


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_ids_report": p1_ids_report}
_HOLD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM {}) WHERE rn = 1"
_KEPT = f"""a AS ({_HOLD.format("assets")}), r AS ({_HOLD.format("relations")}), d AS ({_HOLD.format("diagnostics")}),
refs AS (
  SELECT 'relations' AS table_name, id AS record_id, 'from_id' AS field_name, from_id AS key, seen_at AS made FROM r WHERE from_id IS NOT NULL
  UNION ALL SELECT 'relations', id, 'to_id', to_id, seen_at FROM r WHERE to_id IS NOT NULL
  UNION ALL SELECT 'diagnostics', id, 'asset_id', asset_id, raised_at FROM d WHERE asset_id IS NOT NULL)"""
_DANGLES = "NOT EXISTS (SELECT 1 FROM {} p WHERE p.{} = {}.key AND p.added_at <= {}.made AND (p.removed_at IS NULL OR {}.made < p.removed_at))"
_REPORT = """SELECT *, round(dangling / total, 6) AS rate FROM (
SELECT table_name, field_name, strftime(made, '%Y-%m') AS month, count(*) FILTER (WHERE dangles) AS dangling, count(DISTINCT key) FILTER (WHERE dangles) AS keys, count(*) AS total FROM {} GROUP BY 1, 2, 3) WHERE dangling > 0"""
#: RFC 3986: the parts of an url, and the path without dot segments.
_PART = "regexp_extract({}, '(?s)^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?', {})"
_TRIMMED = "regexp_replace({}, '^[\\t\\n\\r\\f\\x0B ]+|[\\t\\n\\r\\f\\x0B ]+$', '', 'g')"


def _split(column: str, name: str) -> str:
    return ", ".join(f"{_PART.format(column, i)} AS {name}{i}" for i in (1, 2, 3, 4)) + f", regexp_matches({column}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//') AS {name}_has"


def _without_dots(path: str) -> str:
    return f"""array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda s, i: CASE WHEN s IN ('.', '..') AND i = len(string_split({path}, '/')) THEN [s, ''] ELSE [s] END),
lambda x, y: CASE WHEN y[1] = '.' THEN list_concat(x, y[2:]) WHEN y[1] = '..' THEN list_concat(CASE WHEN len(x) > 1 OR (len(x) = 1 AND x[1] <> '') THEN x[:-2] ELSE x END, y[2:]) ELSE list_concat(x, y) END), '/')"""


def _decoded(text: str) -> str:
    """Each run of escapes decoded once, where it is UTF-8; else in upper case."""
    runs = f"regexp_extract_all({text}, '(?:%[0-9A-Fa-f]{{2}})+')"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '(?:%[0-9A-Fa-f]{{2}})+'), {runs}), lambda z: coalesce(z[1], '') || coalesce(try(url_decode(z[2])), upper(z[2]), '')), '')"


_URLS = f"""hosts AS (SELECT DISTINCT lower(host) AS host FROM sites),
asked AS (SELECT r.id AS record_id, r.seen_at AS made, {_TRIMMED.format("r.href")} AS h, {_TRIMMED.format("coalesce(r.base_url, a.url)")} AS b FROM r LEFT JOIN a ON a.id = r.from_id WHERE r.to_id IS NULL
  UNION ALL SELECT '=' || id, added_at, {_TRIMMED.format("url")}, NULL FROM a WHERE url IS NOT NULL),
parts AS (SELECT record_id, made, {_split("h", "h")}, {_split("b", "b")} FROM asked WHERE h <> '' AND NOT starts_with(h, '#')),
full_ AS (SELECT record_id, made, lower(CASE WHEN h1 <> '' THEN h1 ELSE b1 END) AS scheme, CASE WHEN h1 <> '' OR h_has THEN h2 ELSE b2 END AS authority,
  CASE WHEN h1 <> '' OR h_has OR starts_with(h3, '/') THEN h3 WHEN h3 = '' THEN b3 WHEN b_has AND b3 = '' THEN '/' || h3 ELSE regexp_replace(b3, '[^/]*$', '') || h3 END AS path,
  NOT (h1 = '' AND NOT h_has AND h3 = '') AS clean, CASE WHEN h1 = '' AND NOT h_has AND h3 = '' AND h4 = '' THEN b4 ELSE h4 END AS query FROM parts),
web AS (SELECT record_id, made, scheme, regexp_extract(authority, '^(.*@)?', 0) AS user_, lower({_decoded("regexp_extract(authority, '^(?:.*@)?(.*?)(?::[0-9]*)?$', 1)")}) AS host,
  nullif(nullif(regexp_extract(authority, ':([0-9]*)$', 1), ''), CASE scheme WHEN 'http' THEN '80' ELSE '443' END) AS port,
  CASE WHEN clean AND contains(path, '.') THEN {_without_dots("path")} ELSE path END || query AS rest FROM full_ WHERE scheme IN ('http', 'https') AND authority <> ''),
urls AS (SELECT record_id, made, host, scheme || '://' || user_ || host || coalesce(':' || port, '') || {_decoded("rest")} AS key FROM web),
lives AS (SELECT u.key, a.added_at, a.removed_at FROM urls u JOIN a ON u.record_id = '=' || a.id),
hrefs AS (SELECT 'relations' AS table_name, record_id, 'href' AS field_name, key, made FROM urls WHERE NOT starts_with(record_id, '=') AND host IN (SELECT host FROM hosts)),
every AS (SELECT *, {_DANGLES.format("a", "id", *["refs"] * 3)} AS dangles FROM refs UNION ALL SELECT *, {_DANGLES.format("lives", "key", *["hrefs"] * 3)} FROM hrefs)"""
SQL = {
    "p1_found": f"WITH {_KEPT}, {_URLS} SELECT DISTINCT table_name, record_id, field_name FROM every WHERE dangles",
    "p1_report": f"WITH {_KEPT}, {_URLS} {_REPORT.format('every')}",
    "p1_ids_report": f"WITH {_KEPT}, every AS (SELECT *, {_DANGLES.format('a', 'id', *['refs'] * 3)} AS dangles FROM refs) {_REPORT.format('every')}",
}
