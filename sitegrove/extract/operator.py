"""Extraction as an operator: assets in, relations out, one pass of Arrow batches per level of inline assets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrove.extract.css import extract_css
from sitegrove.extract.data import extract_cache_manifest, extract_manifest, extract_source_map, extract_srcset, extract_xml
from sitegrove.extract.edges import Edge
from sitegrove.extract.html import extract_html
from sitegrove.extract.javascript import extract_javascript
from sitegrove.functions.urls import resolve_url
from sitegrove.schema import RELATIONS, registry
from sitegrove.session import cut

#: Extractors by asset type; more can be registered.
EXTRACTORS: dict[str, Callable[[str], list[Edge]]] = {
    "Html": extract_html, "Htc": extract_html, "Css": extract_css, "JavaScript": extract_javascript, "ApplicationManifest": extract_manifest, "SourceMap": extract_source_map, "CacheManifest": extract_cache_manifest,
    "SrcSet": extract_srcset, "Xml": extract_xml, "Xslt": extract_xml,
} | {t: (lambda text, t=t: extract_xml(text, t)) for t in ("Svg", "Atom", "Rss", "MsApplicationConfig")}
#: A text that lacks all of these cannot hold a relation: tested natively before a text goes to Python.
HINTS = {"Html": "[<]", "Htc": "[<]", "Css": r"(?i)url|import|src=|behavior|source", "JavaScript": r"import|export|importScripts|Worker|register|addModule|toString|source", "Svg": r"(?i)href|<script|<style|style=|\son\w", "Atom": "<", "Rss": "<"}


def register_extractor(type_: str, extract: Callable[[str], list[Edge]], parent: str = "Text") -> None:
    """Adds or replaces the extractor of a type; an unknown type is registered below `parent`."""
    from sitegrove.schema import AssetType

    if type_ not in registry.types:
        registry.register(AssetType(type_, (parent,)))
    EXTRACTORS[type_] = extract


def _work(extractors: dict[str, Callable[[str], list[Edge]]]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, type_, text in zip(batch["id"], batch["type"], batch["text"]):
                for n, edge in enumerate(extractors[type_](text)):
                    kind, ord_, *rest = edge.row(n)
                    rows.append((id_, kind, ord_, *rest))
            yield pd.DataFrame(rows, columns=RELATIONS.names)

    return work


def extract(assets: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The relations that the texts of `assets` (id, type, text) hold themselves, in document order by `ord`.

    With `types` only relations of these types are kept. Null texts and types without an extractor give none. Texts that
    cannot hold a relation are dropped before they reach Python.
    """
    known = assets.select("id", "type", "text").where(F.col("text").isNotNull() & F.col("type").isin(*EXTRACTORS))
    useless = F.lit(False)
    for type_, hint in HINTS.items():
        useless = useless | ((F.col("type") == type_) & ~F.col("text").rlike(hint))
    found = known.where(~useless).mapInPandas(_work(dict(EXTRACTORS)), RELATIONS)
    return found.where(F.col("type").isin(*types)) if types else found


def redirects(assets: DataFrame) -> DataFrame:
    """HttpRedirect of loaded assets with a redirect status and a location, FileRedirect of directories."""
    http = assets.where(F.col("status_code").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull())
    folder = assets.where(F.col("url").rlike(r"(?i)^file:.*/$"))
    empty = F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, type_: str, href) -> DataFrame:
        values = {"from_id": F.col("id"), "type": F.lit(type_), "ord": F.lit(0), "href": href, "node_attrs": empty, "props": empty}
        return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RELATIONS.fields])

    return rows(http, "HttpRedirect", F.col("location")).unionByName(rows(folder, "FileRedirect", F.concat("url", F.lit("index.html"))))


def with_inline(assets: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations, inline assets) of the assets and of the inline assets in them, `levels` deep; with None, to the last level.

    The last level is found by writing each one: an inline asset is a part of the text around it, so there is one. An inline asset's id is its relation's source and position, its owner the non-inline asset around it.
    """
    current = assets.select("id", "type", "text", F.col("id").alias("owner_id"))
    all_relations = all_inline = None
    level, more = 0, True
    while more and (levels is None or level < levels):
        level += 1
        found = extract(current).join(current.select(F.col("id").alias("from_id"), "owner_id"), "from_id").withColumn("to_id", F.when(F.col("inline_text").isNotNull(), F.concat_ws("/", "from_id", F.col("ord").cast("string"))))
        found = cut(found) if levels is None else found
        inline = found.where(F.col("inline_text").isNotNull()).select(F.col("to_id").alias("id"), F.col("inline_type").alias("type"), F.col("inline_text").alias("text"), "owner_id")
        relations = found.drop("inline_text")
        all_relations = relations if all_relations is None else all_relations.unionByName(relations)
        all_inline = inline if all_inline is None else all_inline.unionByName(inline)
        current, more = inline, levels is not None or not inline.isEmpty()
    return all_relations, all_inline


def resolved(relations: DataFrame, assets: DataFrame) -> DataFrame:
    """Relations with base_url (the owner's url), url (the resolved href without fragment) and to_id where it is known.

    A pure fragment leads back to its source. `assets` has id and url; several assets of one url count as the first id.
    """
    owner = F.coalesce(F.col("owner_id"), F.col("from_id")) if "owner_id" in relations.columns else F.col("from_id")
    bases = assets.select(F.col("id").alias("_owner"), F.col("url").alias("base_url"))
    based = relations.withColumn("_owner", owner).join(bases, "_owner", "left").drop("_owner")
    full = based.withColumn("url", F.regexp_replace(resolve_url("href", "base_url"), r"(?s)#.*$", ""))
    targets = assets.where(F.col("url").isNotNull()).groupBy(F.regexp_replace("url", r"(?s)#.*$", "").alias("url")).agg(F.min("id").alias("_target"))
    joined = full.join(targets, "url", "left")
    known = F.col("to_id") if "to_id" in relations.columns else F.lit(None).cast("string")
    return joined.withColumn("to_id", F.coalesce(known, F.when(F.trim("href").startswith("#"), F.col("from_id")), F.col("_target"))).drop("_target")
