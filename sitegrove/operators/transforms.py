"""Graph transforms. Each takes a Graph (and options) and returns a Graph; they are registered for pipelines by name.

Relations have id, type, from_id, to_id, ord, href and, where a transform says so, media, in_head and node_attrs.
"""

from __future__ import annotations

import gzip as _gzip
import json
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from sitegrove.extract.css import count_rules, declarations
from sitegrove.extract.javascript import _TOKEN, compressed
from sitegrove.functions.urls import build_href, crossorigin, data_url, href_type, query_map, with_fragment, without_fragment
from sitegrove.functions.urls import fragment as fragment_of
from sitegrove.graph import Graph
from sitegrove.operators import aggregate, query, traverse
from sitegrove.operators.query import Query, predicate
from sitegrove.plans.pipeline import transform
from sitegrove.session import cut

#: Relations that do not make their target part of a page.
NOT_PART_OF_PAGE = ["HtmlAnchor", "HtmlMetaRefresh", "HtmlCacheManifest", "HtmlConditionalComment", "JavaScriptSourceUrl", "JavaScriptSourceMappingUrl", "JavaScriptSourceMap"]
#: The size above which a file is worth compressing; selectors that old browsers read per sheet; imports.
GZIP_ABOVE, SELECTOR_LIMIT_OLD, SELECTOR_LIMIT, IMPORTS_PER_SHEET = 860, 4095, 65534, 32


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df` with exactly the columns of `like`; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _add(graph: Graph, new: DataFrame) -> DataFrame:
    return graph.relations.unionByName(_columns(new, graph.relations))


def _new_id(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _next_ord(graph: Graph) -> DataFrame:
    return graph.relations.groupBy("from_id").agg((F.max("ord") + 1).alias("_next"))


@transform
def add_assets(graph: Graph, new: DataFrame) -> Graph:
    """Upserts by url without fragment: the later config overwrites text and type, the lowest seq keeps its id."""
    both = graph.assets.withColumn("_new", F.lit(0)).unionByName(_columns(new, graph.assets).withColumn("_new", F.lit(1)))
    inline = both.where(F.col("url").isNull()).drop("_new")
    key = without_fragment(F.col("url"))
    w = Window.partitionBy("_url").orderBy("seq", "_new", "id")
    keyed = both.where(F.col("url").isNotNull()).withColumn("_url", key)
    ranked = keyed.withColumn("_n", F.row_number().over(w)).withColumn("text", F.last("text", True).over(Window.partitionBy("_url").orderBy("_new", "seq", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = ranked.where("_n = 1").withColumn("url", F.col("_url")).drop("_new", "_url", "_n")
    return graph.with_(assets=inline.unionByName(kept))


@transform
def load_assets(graph: Graph, new: DataFrame) -> Graph:
    """As add_assets, with is_initial set."""
    return add_assets(graph, new.withColumn("is_initial", F.lit(True)))


@transform
def update_assets(graph: Graph, wanted: Query, values: dict) -> Graph:
    return graph.with_(assets=query.update_assets(graph.assets, wanted, values))


@transform
def merge_identical_assets(graph: Graph, wanted: Query = None) -> Graph:
    chosen = graph.find_assets(wanted)
    _, relations = aggregate.merge_identical(chosen, graph.relations)
    gone = aggregate.identical_survivors(chosen).where(F.col("id") != F.col("survivor")).select("id")
    return graph.with_(assets=graph.assets.join(gone, "id", "left_anti"), relations=relations)


@transform
def remove_duplicate_html_styles(graph: Graph, wanted: Query = None) -> Graph:
    pages = graph.find_assets({"type": "Html"} | dict(wanted or {})).select(F.col("id").alias("from_id"))
    own = graph.relations.join(pages, "from_id", "left_semi")
    rest = graph.relations.join(pages, "from_id", "left_anti")
    return graph.with_(relations=rest.unionByName(aggregate.first_style_per_page(own)))


@transform
def check_incompatible_types(graph: Graph) -> Graph:
    return graph.with_(diagnostics=aggregate.incompatible_types(graph.assets, graph.relations).unionByName(aggregate.content_type_conflicts(graph.assets, graph.relations)))


@transform
def remove_relations(graph: Graph, wanted: Query = None, remove_orphan: bool = False) -> Graph:
    """Without the matching relations; with remove_orphan also without targets that lost their last relation by it."""
    gone = graph.find_relations(wanted)
    kept = graph.relations.join(gone.select("id"), "id", "left_anti")
    if not remove_orphan:
        return graph.with_(relations=kept)
    lost = gone.where(F.col("to_id").isNotNull()).select(F.col("to_id").alias("id")).distinct()
    orphans = lost.join(kept.select(F.col("to_id").alias("id")), "id", "left_anti")
    return remove_assets(graph.with_(relations=kept), orphans)


@transform
def remove_assets(graph: Graph, ids: DataFrame) -> Graph:
    """Without these assets and what is inline in them; relations into them are detached with a warning."""
    inline = graph.assets.where(F.col("url").isNull()).select("id")
    inner = graph.relations.join(inline.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    gone = cut(traverse.reached_set(inner, ids).select("id"))
    out = graph.relations.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    into = out.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    notes = into.select(F.lit("warn").alias("severity"), F.lit("detached").alias("code"), F.col("from_id").alias("asset_id"), F.concat(F.lit("detached a relation to removed asset "), F.col("to_id")).alias("message"))
    return graph.with_(assets=graph.assets.join(gone, "id", "left_anti"), relations=out.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti"), diagnostics=notes)


@transform
def remove_unreferenced_assets(graph: Graph, wanted: Query = None) -> Graph:
    gone = traverse.unreferenced(graph.assets, graph.relations, wanted)
    return graph.with_(assets=graph.assets.join(gone, "id", "left_anti"), relations=graph.relations.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti"))


@transform
def externalize_relations(graph: Graph, wanted: Query = None) -> Graph:
    """Gives the inline targets of the matching relations a url below the root, named by id and the type's extension."""
    from sitegrove.schema import registry

    chosen = graph.find_relations(wanted).select(F.col("to_id").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("_out", F.lit(True))
    pairs = [F.lit(x) for t in registry.types.values() if t.extensions for x in (t.name, t.extensions[0])]
    end = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("type")), F.lit(""))
    assets = graph.assets.join(chosen, "id", "left").withColumn("url", F.when(F.col("_out") & F.col("url").isNull(), F.concat(F.lit(graph.root), F.col("id"), end)).otherwise(F.col("url"))).drop("_out")
    return refresh_hrefs(graph.with_(assets=assets))


@transform
def inline_relations(graph: Graph, wanted: Query = None) -> Graph:
    """Makes the targets inline: each relation gets a copy of its own; the last one, if none is left, the asset itself."""
    chosen = graph.find_relations(wanted).where(F.col("to_id").isNotNull())
    uses = graph.relations.where(F.col("to_id").isNotNull()).groupBy("to_id").agg(F.count(F.lit(1)).alias("_uses"))
    counted = chosen.join(uses, "to_id").withColumn("_chosen", F.count(F.lit(1)).over(Window.partitionBy("to_id"))).withColumn("_k", F.row_number().over(Window.partitionBy("to_id").orderBy("from_id", "ord", "id")))
    itself = (F.col("_chosen") == F.col("_uses")) & (F.col("_k") == F.col("_chosen"))
    plan = cut(counted.select(F.col("id").alias("rel"), "to_id", F.when(itself, F.col("to_id")).otherwise(_new_id("inline", F.col("id"))).alias("_new")))
    copies = graph.assets.join(plan.where("_new != to_id").select(F.col("to_id").alias("id"), "_new"), "id").withColumn("id", F.col("_new")).drop("_new").withColumn("url", F.lit(None).cast("string"))
    bare = plan.where("_new = to_id").select(F.col("to_id").alias("id")).distinct().withColumn("_bare", F.lit(True))
    assets = graph.assets.join(bare, "id", "left").withColumn("url", F.when(F.col("_bare"), F.lit(None)).otherwise(F.col("url"))).drop("_bare")
    moved = graph.relations.join(plan.select(F.col("rel").alias("id"), "_new"), "id", "left").withColumn("href", F.when(F.col("_new").isNotNull(), F.lit(None)).otherwise(F.col("href"))).withColumn("to_id", F.coalesce("_new", "to_id")).drop("_new")
    return graph.with_(assets=assets.unionByName(copies.select(*assets.columns)), relations=moved.select(*graph.relations.columns))


def refresh_hrefs(graph: Graph) -> Graph:
    """Hrefs anew from the urls at both ends, in the form and with the fragment they had; pure fragments stay."""
    ends = graph.assets.select("id", "url")
    joined = graph.relations.join(ends.select(F.col("id").alias("to_id"), F.col("url").alias("_to")), "to_id", "left").join(ends.select(F.col("id").alias("from_id"), F.col("url").alias("_from")), "from_id", "left")
    kind = F.when(F.col("href").isNull(), "relative").otherwise(href_type(F.col("href")))
    fresh = build_href("_to", "_from", kind)
    fresh = with_fragment(fresh, F.coalesce(fragment_of(F.col("href")), F.lit("")))
    fresh = F.when(fresh.rlike(r"/index\.html(?:#.*)?$") & ~F.col("href").contains("index.html"), F.regexp_replace(fresh, r"index\.html(?=#|$)", "")).otherwise(fresh)
    keep = F.col("href").startswith("#") | F.col("_to").isNull() | (kind == "inline")
    return graph.with_(relations=joined.withColumn("href", F.when(F.coalesce(keep, F.lit(False)), F.col("href")).otherwise(fresh)).select(*graph.relations.columns))


@transform
def move_assets(graph: Graph, urls: DataFrame) -> Graph:
    """Sets urls (id, new_url); an asset that is in the way gets the next free suffix `-1`, `-2` ...; hrefs follow."""
    moved = graph.assets.join(urls.select("id", "new_url"), "id", "left").withColumn("_moved", F.col("new_url").isNotNull()).withColumn("url", F.coalesce("new_url", "url"))
    w = Window.partitionBy("url").orderBy(F.col("_moved").desc(), "seq", "id")
    ranked = moved.withColumn("_n", F.when(F.col("url").isNotNull(), F.row_number().over(w) - 1).otherwise(0))
    end_pattern = r"((?:\.[^./?#]*)?(?:[?#].*)?)$"
    suffixed, end = F.regexp_replace("url", end_pattern, ""), F.regexp_extract("url", end_pattern, 1)
    # Suffixes that are in use already are passed over.
    in_way = ranked.where(F.col("_n") > 0).select("url").distinct()
    used = moved.where(suffixed.rlike(r"-[0-9]+$")).select(F.concat(F.regexp_replace(suffixed, r"-[0-9]+$", ""), end).alias("url"), F.regexp_extract(suffixed, r"-([0-9]+)$", 1).cast("int").alias("_k"))
    taken = used.join(in_way, "url", "left_semi").groupBy("url").agg(F.collect_set("_k").alias("_taken"))
    free = F.array_except(F.sequence(F.lit(1), (F.col("_n") + F.coalesce(F.size("_taken"), F.lit(0))).cast("int")), F.coalesce("_taken", F.array().cast("array<int>")))
    number = F.try_element_at(free, F.greatest("_n", F.lit(1)).cast("int"))
    assets = ranked.join(taken, "url", "left").withColumn("url", F.when(F.col("_n") > 0, F.concat(suffixed, F.lit("-"), number.cast("string"), end)).otherwise(F.col("url")))
    return refresh_hrefs(graph.with_(assets=assets.select(*graph.assets.columns)))


@transform
def replace_asset(graph: Graph, old: str, new: str) -> Graph:
    """Relations to the old asset lead to the new one; the old one goes."""
    relations = graph.relations.withColumn("to_id", F.when(F.col("to_id") == old, F.lit(new)).otherwise(F.col("to_id"))).where(~F.col("from_id").eqNullSafe(F.lit(old)))
    return graph.with_(assets=graph.assets.where(~F.col("id").eqNullSafe(F.lit(old))), relations=relations)


@transform
def clone_assets(graph: Graph, wanted: Query = None) -> Graph:
    """Copies of the matching assets with their relations, at `name-1` beside the original."""
    chosen = cut(graph.find_assets(wanted).select("id").withColumn("_new", _new_id("clone", F.col("id"))))
    copies = graph.assets.join(chosen, "id").withColumn("id", F.col("_new")).drop("_new")
    end = r"((?:\.[^./?#]*)?(?:[?#].*)?)$"
    copies = copies.withColumn("url", F.concat(F.regexp_replace("url", end, ""), F.lit("-1"), F.regexp_extract("url", end, 1)))
    edges = graph.relations.join(chosen.select(F.col("id").alias("from_id"), "_new"), "from_id").withColumn("from_id", F.col("_new")).withColumn("id", _new_id(F.col("id"), "clone")).drop("_new")
    return graph.with_(assets=graph.assets.unionByName(copies.select(*graph.assets.columns)), relations=_add(graph, edges))


@transform
def add_javascript_source_url(graph: Graph, wanted: Query = None) -> Graph:
    """A JavaScriptSourceUrl from each JavaScript asset with a url to itself."""
    scripts = graph.find_assets({"type": "JavaScript", "url": {"$exists": True}} | dict(wanted or {}))
    edges = scripts.join(_next_ord(graph).withColumnRenamed("from_id", "id"), "id", "left").select(_new_id("source-url", F.col("id")).alias("id"), F.lit("JavaScriptSourceUrl").alias("type"), F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.coalesce("_next", F.lit(0)).alias("ord"), F.col("url").alias("href"))
    return graph.with_(relations=_add(graph, edges))


@transform
def add_rel_noopener_to_blank_target_anchors(graph: Graph) -> Graph:
    """rel=noopener on crossorigin anchors with target=_blank, unless rel already says opener or noopener.

    Every anchor is looked at; the transform does not end at the first that already has one.
    """
    ends = graph.assets.select("id", "url")
    joined = graph.relations.join(ends.select(F.col("id").alias("from_id"), F.col("url").alias("_from")), "from_id", "left").join(ends.select(F.col("id").alias("to_id"), F.col("url").alias("_to")), "to_id", "left")
    attrs = F.coalesce("node_attrs", F.create_map().cast("map<string,string>"))
    rel = F.trim(F.coalesce(F.try_element_at(attrs, F.lit("rel")), F.lit("")))
    match = (F.col("type") == "HtmlAnchor") & (F.try_element_at(attrs, F.lit("target")) == "_blank") & crossorigin(F.col("_from"), F.col("_to")) & ~rel.rlike(r"(?i)(?:^|\s)(?:no)?opener(?:\s|$)")
    fresh = F.map_concat(F.map_filter(attrs, lambda k, _: k != "rel"), F.create_map(F.lit("rel"), F.trim(F.concat(rel, F.lit(" noopener")))))
    return graph.with_(relations=joined.withColumn("node_attrs", F.when(F.coalesce(match, F.lit(False)), fresh).otherwise(F.col("node_attrs"))).select(*graph.relations.columns))


@transform
def set_async_or_defer_on_html_scripts(graph: Graph, wanted: Query = None, is_async: bool = False, is_defer: bool = False) -> Graph:
    """Sets the attributes on the matching HtmlScript relations that have an href."""
    chosen = graph.find_relations({"type": "HtmlScript", "href": {"$exists": True}} | dict(wanted or {})).select("id").withColumn("_set", F.lit(True))
    names = [n for n, on in (("async", is_async), ("defer", is_defer)) if on]
    attrs = F.coalesce("node_attrs", F.create_map().cast("map<string,string>"))
    fresh = F.map_concat(F.map_filter(attrs, lambda k, _: ~k.isin(*names)), *[F.create_map(F.lit(n), F.lit(n)) for n in names]) if names else attrs
    return graph.with_(relations=graph.relations.join(chosen, "id", "left").withColumn("node_attrs", F.when(F.col("_set"), fresh).otherwise(F.col("node_attrs"))).select(*graph.relations.columns))


@transform
def add_data_version_attribute(graph: Graph, version: str, wanted: Query = None) -> Graph:
    """data-version on the html element of the matching pages; `{0}` in the version is the value that was there."""
    tag = r"(?is)<html\b[^>]*>"
    old = F.regexp_extract("text", r"(?is)<html\b[^>]*\sdata-version\s*=\s*[\"']?([^\"'>\s]*)", 1)
    bare = F.regexp_replace(F.regexp_extract("text", f"({tag})", 1), r"(?i)\sdata-version\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*)", "")
    value = F.replace(F.lit(version), F.lit("{0}"), old)
    fresh = F.concat(F.substr(bare, F.lit(1), F.char_length(bare) - 1), F.lit(' data-version="'), value, F.lit('">'))
    at = F.regexp_instr(F.col("text"), F.lit(tag))
    text = F.concat(F.substr("text", F.lit(1), at - 1), fresh, F.substr(F.col("text"), at + F.char_length(F.regexp_extract("text", f"({tag})", 1))))
    match = predicate(graph.assets, {"type": "Html"} | dict(wanted or {})) & (at > 0)
    return graph.with_(assets=graph.assets.withColumn("text", F.when(match, text).otherwise(F.col("text"))))


@transform
def duplicate_favicon(graph: Graph, wanted: Query = None) -> Graph:
    """An HtmlShortcutIcon from every full page without one to the root's favicon.ico, which is copied for them."""
    icon = graph.assets.where(F.col("url") == f"{graph.root}favicon.ico").orderBy("seq").limit(1)
    copy = icon.withColumn("id", _new_id("favicon", F.col("id"))).withColumn("url", F.lit(f"{graph.root}favicon.copy.ico"))
    if "is_initial" in copy.columns:
        copy = copy.withColumn("is_initial", F.lit(False))
    pages = graph.find_assets({"type": "Html", "url": {"$exists": True}, "is_loaded": True} | dict(wanted or {})).where(F.col("text").rlike(r"(?i)<(?:!doctype|html|head|body)[\s>]"))
    without = pages.join(graph.relations.where(F.col("type") == "HtmlShortcutIcon").select(F.col("from_id").alias("id")), "id", "left_anti")
    found = copy.select("id", "url").first()
    if found is None:
        return graph
    edges = without.join(_next_ord(graph).withColumnRenamed("from_id", "id"), "id", "left").select(_new_id("favicon", F.col("id")).alias("id"), F.lit("HtmlShortcutIcon").alias("type"), F.col("id").alias("from_id"), F.lit(found["id"]).alias("to_id"), F.coalesce("_next", F.lit(0)).alias("ord"), build_href(F.lit(found["url"]), "url", F.lit("rootRelative")).alias("href"))
    moved = graph.relations.join(icon.select(F.col("id").alias("to_id"), _new_id("favicon", F.col("id")).alias("_copy")), "to_id", "left").withColumn("to_id", F.coalesce("_copy", "to_id")).drop("_copy")
    relations = moved.select(*graph.relations.columns).unionByName(_columns(edges, graph.relations))
    return refresh_hrefs(graph.with_(assets=graph.assets.unionByName(copy.select(*graph.assets.columns)), relations=relations))


def _remove_empty(graph: Graph, type_: str, relation: str, usual: dict[str, set[str] | None], wanted: Query) -> Graph:
    """Drops empty assets of a type with their relations, unless an attribute of the tag means something."""
    empty = graph.find_assets({"type": type_} | dict(wanted or {})).where(F.col("text").isNotNull() & ~F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "").rlike(r"[^\s;]")).select(F.col("id").alias("to_id"))
    attrs = F.coalesce("node_attrs", F.create_map().cast("map<string,string>"))
    odd = F.map_filter(attrs, lambda k, v: ~_usual(k, v, usual))
    into = graph.relations.join(empty, "to_id", "left_semi").withColumn("_keep", (F.col("type") == relation) & (F.size(odd) > 0))
    kept_targets = into.where("_keep").select(F.col("to_id").alias("id"))
    gone = empty.select(F.col("to_id").alias("id")).join(kept_targets, "id", "left_anti")
    relations = graph.relations.join(into.where("not _keep").select("id"), "id", "left_anti")
    return graph.with_(assets=graph.assets.join(gone, "id", "left_anti"), relations=relations.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti"))


def _usual(key: Column, value: Column, usual: dict[str, set[str] | None]) -> Column:
    out = F.lit(False)
    for name, values in usual.items():
        out = out | ((key == name) & (F.lit(True) if values is None else value.isin(*values)))
    return out


@transform
def remove_empty_javascripts(graph: Graph, wanted: Query = None) -> Graph:
    return _remove_empty(graph, "JavaScript", "HtmlScript", {"src": None, "defer": {"defer"}, "async": {"async"}, "type": {"text/javascript"}}, wanted)


@transform
def remove_empty_stylesheets(graph: Graph, wanted: Query = None) -> Graph:
    return _remove_empty(graph, "Css", "HtmlStyle", {"rel": {"stylesheet"}, "media": None, "type": {"text/css"}, "href": None}, wanted)


@transform
def convert_css_imports_to_html_styles(graph: Graph) -> Graph:
    """Each sheet that a page's style imports, directly or not, becomes an HtmlStyle of the page before it (post order).

    The loop goes on until no import path grows; a path meets no sheet twice, so it ends.
    """
    last = F.lit(2**31 - 1)
    imports = graph.relations.where(F.col("type") == "CssImport").select(F.col("from_id").alias("_sheet"), F.col("to_id").alias("_imported"), F.col("ord").alias("_ord"), "media").where(F.col("_imported").isNotNull())
    level = cut(graph.relations.where((F.col("type") == "HtmlStyle") & F.col("to_id").isNotNull()).select("from_id", "to_id", F.array("ord").alias("key"), F.array("to_id").alias("seen"), F.lit(None).cast("string").alias("media")))
    found = None
    while True:
        level = cut(level.join(imports.withColumnRenamed("media", "_media"), level["to_id"] == imports["_sheet"]).where(~F.array_contains("seen", F.col("_imported"))).select("from_id", F.col("_imported").alias("to_id"), F.concat("key", F.array("_ord")).alias("key"), F.concat("seen", F.array("_imported")).alias("seen"), F.col("_media").alias("media")))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
    if found is None:
        return graph
    post = F.concat("key", F.array(last))
    new = found.groupBy("from_id", "to_id").agg(F.min(post).alias("_key"), F.min_by("media", post).alias("media"))
    new = new.withColumn("id", _new_id("style", F.col("from_id"), F.col("to_id"))).withColumn("type", F.lit("HtmlStyle"))
    own = graph.relations.where(F.col("type") != "CssImport").withColumn("_key", F.array(F.coalesce("ord", F.lit(0)), last))
    pages = new.select("from_id").distinct()
    affected = own.join(pages, "from_id", "left_semi").unionByName(_columns(new.drop("_key"), graph.relations).join(new.select("id", "_key"), "id"), allowMissingColumns=True)
    placed = affected.withColumn("ord", (F.row_number().over(Window.partitionBy("from_id").orderBy("_key", "id")) - 1).cast("int")).drop("_key")
    return refresh_hrefs(graph.with_(relations=own.join(pages, "from_id", "left_anti").drop("_key").unionByName(placed.select(*graph.relations.columns))))


@transform
def convert_html_styles_to_inline_css_imports(graph: Graph, per_sheet: int = IMPORTS_PER_SHEET) -> Graph:
    """External styles of a page become imports of inline sheets, at most `per_sheet` each; an inline style ends a sheet.

    The transform goes on after an inline style; it does not end there.
    """
    inline = graph.assets.where(F.col("url").isNull()).select(F.col("id").alias("to_id"), F.lit(True).alias("_inline"))
    styles = graph.relations.where((F.col("type") == "HtmlStyle") & F.col("to_id").isNotNull()).join(inline, "to_id", "left")
    w = Window.partitionBy("from_id").orderBy("ord", "id")
    part = styles.withColumn("_part", F.count("_inline").over(w)).where(F.col("_inline").isNull())
    numbered = part.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("from_id", "_part").orderBy("ord", "id")) - 1) / per_sheet)).withColumn("_sheet", _new_id("imports", F.col("from_id"), F.col("_part"), F.col("_k")))
    rule = F.concat(F.lit('@import "'), F.coalesce("href", F.lit("")), F.lit('"'), F.coalesce(F.concat(F.lit(" "), F.col("media")), F.lit("")), F.lit(";"))
    sheets = numbered.groupBy("_sheet", "from_id").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", rule.alias("r")))), lambda x: x["r"]), "\n").alias("text"))
    new_assets = _columns(sheets.select(F.col("_sheet").alias("id"), F.lit("Css").alias("type"), "text"), graph.assets)
    pages = _columns(sheets.select(_new_id("to", F.col("_sheet")).alias("id"), F.lit("HtmlStyle").alias("type"), "from_id", F.col("_sheet").alias("to_id"), "ord"), graph.relations)
    edges = _columns(numbered.withColumn("from_id", F.col("_sheet")).withColumn("type", F.lit("CssImport")), graph.relations)
    rest = graph.relations.join(numbered.select("id"), "id", "left_anti")
    return graph.with_(assets=graph.assets.unionByName(new_assets), relations=rest.unionByName(pages).unionByName(edges))


#: Attributes that don't keep a style or script out of a bundle.
_STYLE_ATTRS = {"charset": None, "media": None, "bundle": None, "nonce": None, "rel": {"stylesheet"}, "href": None, "type": {"text/css"}}
_SCRIPT_ATTRS = {"charset": None, "src": None, "bundle": None, "nonce": None, "defer": {"defer"}, "async": {"async"}, "type": {"text/javascript"}}


def bundle_discriminator() -> Column:
    """What must be equal for two neighbouring relations to go in one bundle; null for those that never do."""
    attrs = F.coalesce("node_attrs", F.create_map().cast("map<string,string>"))
    style, script = F.col("type") == "HtmlStyle", F.col("type") == "HtmlScript"
    odd = F.size(F.map_filter(attrs, lambda k, v: ~F.when(style, _usual(k, v, _STYLE_ATTRS)).when(script, _usual(k, v, _SCRIPT_ATTRS)).otherwise(True))) > 0
    parts = F.concat_ws(
        ":", "type", F.when(F.coalesce("in_head", F.lit(False)), "head").otherwise("body"), F.try_element_at(attrs, F.lit("bundle")), F.when(style, F.coalesce("media", F.lit("all"))),
        *[F.when(script & (F.try_element_at(attrs, F.lit(n)) == n), F.lit(n)) for n in ("defer", "async")], F.when(script & F.col("_text").rlike(r"^\s*[\"']use strict[\"']"), "strict"),
    )
    return F.when(~odd, parts)


@transform
def bundle_relations(graph: Graph, wanted: Query = None, strategy: str = "oneBundlePerIncludingAsset") -> Graph:
    """Neighbouring relations of one page, type and discriminator become one relation to a concatenated asset.

    oneBundlePerIncludingAsset: each run of a page is a bundle. sharedBundles: two neighbours stay together only if they
    are neighbours on every page that includes either, so no text is in two bundles and the order is kept everywhere.
    Both are windows and aggregates over the relations; only a bundle's own texts are brought together.
    """
    texts = graph.assets.select(F.col("id").alias("to_id"), F.col("text").alias("_text"))
    chosen = graph.find_relations(wanted).where(F.col("to_id").isNotNull()).join(texts, "to_id").where(F.col("_text").isNotNull())
    keyed = cut(chosen.withColumn("_key", F.coalesce(bundle_discriminator(), F.concat(F.lit("nobundle:"), F.col("id")))))
    w = Window.partitionBy("from_id", "type").orderBy("ord", "id")
    before = keyed.withColumn("_prev", F.lag("to_id").over(w)).withColumn("_joined", F.lag("_key").over(w).eqNullSafe(F.col("_key")))
    if strategy == "sharedBundles":
        pages = keyed.groupBy("to_id").agg(F.count_distinct("from_id").alias("_pages"))
        pairs = before.where("_joined").groupBy("_prev", "to_id").agg(F.count_distinct("from_id").alias("_both"))
        before = before.join(pairs, ["_prev", "to_id"], "left").join(pages, "to_id").join(pages.select(F.col("to_id").alias("_prev"), F.col("_pages").alias("_prev_pages")), "_prev", "left")
        before = before.withColumn("_joined", F.col("_joined") & F.coalesce((F.col("_both") == F.col("_pages")) & (F.col("_both") == F.col("_prev_pages")), F.lit(False)))
    elif strategy != "oneBundlePerIncludingAsset":
        raise ValueError(f"unknown strategy {strategy}")
    runs = before.withColumn("_run", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(w))
    members = runs.groupBy("from_id", "type", "_run").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "to_id", "_text", "media"))).alias("xs"))
    many = cut(members.where(F.size("xs") > 1).withColumn("_bundle", _new_id("bundle", F.array_join(F.transform("xs", lambda x: x["to_id"]), ","))))
    kind = F.when(F.col("type").isin("HtmlScript", "JavaScriptImportScripts", "SvgScript"), F.lit("JavaScript")).otherwise(F.lit("Css"))
    imports = F.transform("xs", lambda x: F.regexp_extract_all(x["_text"], F.lit(r"(@import[^;]*;)"), 1))
    bodies = F.transform("xs", lambda x: F.when(kind == "Css", F.regexp_replace(x["_text"], r"@import[^;]*;\s*", "")).otherwise(x["_text"]))
    text = F.concat(F.when(kind == "Css", F.array_join(F.flatten(imports), "")).otherwise(""), F.when(kind == "JavaScript", F.array_join(bodies, ";\n")).otherwise(F.array_join(bodies, "\n")))
    bundles = many.select(F.col("_bundle").alias("id"), kind.alias("type"), text.alias("text")).dropDuplicates(["id"]).withColumn("url", F.concat(F.lit(graph.root), F.col("id"), F.when(F.col("type") == "Css", ".css").otherwise(".js")))
    if "is_loaded" in graph.assets.columns:
        bundles = bundles.withColumn("is_loaded", F.lit(True))
    gone = many.select(F.explode("xs").alias("x")).select("x.id", "x.to_id")
    edges = many.select(_new_id("to", F.col("from_id"), F.col("_bundle"), F.col("_run")).alias("id"), "type", "from_id", F.col("_bundle").alias("to_id"), F.col("xs")[0]["ord"].alias("ord"), F.col("xs")[0]["media"].alias("media"))
    rest = graph.relations.join(gone.select("id"), "id", "left_anti")
    unused = gone.select(F.col("to_id").alias("id")).distinct().join(rest.select(F.col("to_id").alias("id")), "id", "left_anti")
    assets = graph.assets.join(unused, "id", "left_anti").unionByName(_columns(bundles, graph.assets))
    return refresh_hrefs(graph.with_(assets=assets, relations=rest.join(unused.select(F.col("id").alias("from_id")), "from_id", "left_anti").unionByName(_columns(edges, graph.relations))))


@transform
def add_cache_manifest(graph: Graph, wanted: Query = None) -> Graph:
    """A cache manifest per page with entries for the non-inline, loaded assets that are part of it (post-order set)."""
    pages = cut(graph.find_assets({"type": "Html", "url": {"$exists": True}} | dict(wanted or {})).select("id", "url"))
    part = graph.relations.where(~F.col("type").isin(*NOT_PART_OF_PAGE))
    there = cut(graph.relations.where(F.col("type").isin("HtmlCacheManifest", "CacheManifestEntry") & F.col("to_id").isNotNull()).select("type", "from_id", "to_id"))
    known = there.where(F.col("type") == "HtmlCacheManifest").groupBy(F.col("from_id").alias("start")).agg(F.min("to_id").alias("_known"))
    owners = pages.select(F.col("id").alias("start"), F.col("url").alias("_page")).join(known, "start", "left").withColumn("_manifest", F.coalesce("_known", _new_id("manifest", F.col("start"))))
    fresh = owners.where(F.col("_known").isNull())
    url = F.concat(F.regexp_replace(F.regexp_replace("_page", r"[?#].*$", ""), r"\.html$", ""), F.lit(".appcache"))
    assets = _columns(fresh.select(F.col("_manifest").alias("id"), F.lit("CacheManifest").alias("type"), url.alias("url"), F.lit("CACHE MANIFEST\nNETWORK:\n*\n").alias("text")), graph.assets)
    links = _columns(fresh.select(_new_id("manifest-of", F.col("start")).alias("id"), F.lit("HtmlCacheManifest").alias("type"), F.col("start").alias("from_id"), F.col("_manifest").alias("to_id"), F.lit(-1).alias("ord"), build_href(url, F.col("_page"), F.lit("relative")).alias("href")), graph.relations)
    targets = graph.assets.where(F.col("url").isNotNull() & F.col("is_loaded"))
    listed = there.where(F.col("type") == "CacheManifestEntry").select(F.col("from_id").alias("_manifest"), F.col("to_id").alias("id"))
    reach = traverse.reached_targets(part, owners.select(F.col("start").alias("id"), F.col("_manifest").alias("label")), targets.select("id"), owners.join(listed, "_manifest").select("start", "id"))
    # Joins to the left with unique keys, so that a plan without hrefs goes without them.
    urls = targets.groupBy("id").agg(F.min("url").alias("_target"))
    entries = reach.withColumnRenamed("label", "_manifest").join(urls, "id", "left").join(pages.groupBy(F.col("id").alias("start")).agg(F.min("url").alias("_page")), "start", "left")
    edges = _columns(entries.select(_new_id("entry", F.col("_manifest"), F.col("id")).alias("id"), F.lit("CacheManifestEntry").alias("type"), F.col("_manifest").alias("from_id"), F.col("id").alias("to_id"), F.col("depth").alias("ord"), build_href("_target", url, F.lit("relative")).alias("href")), graph.relations)
    return graph.with_(assets=graph.assets.unionByName(assets), relations=graph.relations.unionByName(links).unionByName(edges))


@transform
def inline_assets_per_query_string(graph: Graph, wanted: Query = None, minimum_ie_version: int | None = None) -> Graph:
    """Assets whose url asks for it (`?inline`, or true, on, yes, 1) become inline; warnings for old browsers."""
    value = F.try_element_at(query_map(F.col("url")), F.lit("inline"))
    chosen = graph.find_assets(wanted).where(F.col("url").isNotNull() & value.isNotNull() & (value.rlike(r"(?i)^(?:true|on|yes|1)$") | (value == "")))
    ids = cut(chosen.select("id", "url", F.length("raw_src").alias("_bytes")))
    notes = None
    if minimum_ie_version is not None and minimum_ie_version <= 8:
        edges = graph.relations
        condition = F.regexp_extract(F.coalesce("condition", F.lit("")), r"(?i)^(gte?|lte?)\s+IE\s+(\d+)$", 1) if "condition" in edges.columns else F.lit("")
        version = F.regexp_extract(F.coalesce("condition", F.lit("")), r"(?i)IE\s+(\d+)$", 1).try_cast("int") if "condition" in edges.columns else F.lit(None).cast("int")
        weight = F.when(F.lower(condition).startswith("lt"), 1).when(condition != "", version + (F.lower(condition) == "gt").cast("int"))
        least = traverse.propagate_min(edges, graph.assets.where(F.col("type") == "Html").select("id", F.lit(1).alias("value")), weight)
        limit = F.when((F.lit(minimum_ie_version) <= 7) & (F.col("value") <= 7), "IE7 and below").when((F.col("_bytes") * 4 / 3 > 32768) & (F.col("value") <= 8), "IE8 and below because the data url is > 32 KB")
        notes = ids.join(least, "id").withColumn("_who", limit).where(F.col("_who").isNotNull()).select(F.lit("warn").alias("severity"), F.lit("inline").alias("code"), F.col("id").alias("asset_id"), F.concat(F.lit("inlining "), F.col("url"), F.lit(" keeps it from "), F.col("_who")).alias("message"))
    into = graph.relations.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("id")
    out = _inline_ids(graph, into)
    return out.with_(diagnostics=notes) if notes is not None else out


def _inline_ids(graph: Graph, ids: DataFrame) -> Graph:
    """inline_relations for relations given by id."""
    marked = graph.relations.join(ids.withColumn("_pick", F.lit(True)), "id", "left")
    out = inline_relations(Graph(graph.assets, marked, graph.root, graph.diagnostics, graph.canonical_root), {"_pick": True})
    return graph.with_(assets=out.assets, relations=out.relations.select(*graph.relations.columns))


@transform
def inline_css_images(graph: Graph, size_threshold: int = 8192) -> Graph:
    """Images of at most `size_threshold` bytes that their sheet uses once become data: urls."""
    sizes = graph.assets.where(F.col("raw_src").isNotNull() & (F.length("raw_src") <= size_threshold)).select(F.col("id").alias("to_id"))
    w = Window.partitionBy("from_id", "to_id")
    once = graph.relations.where((F.col("type") == "CssImage") & F.col("to_id").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1")
    return _inline_ids(graph, once.join(sizes, "to_id", "left_semi").select("id"))


def data_urls(assets: DataFrame) -> DataFrame:
    """id and data_url of assets with bytes."""
    return assets.where(F.col("raw_src").isNotNull()).select("id", data_url(F.col("content_type"), F.col("raw_src")).alias("data_url"))


@F.pandas_udf(BinaryType())
def _gzipped(raw: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else _gzip.compress(bytes(r), mtime=0) for r in raw], dtype=object)


@transform
def gzip(graph: Graph, wanted: Query = None) -> Graph:
    """A sibling `.gz` of each matching asset above 860 bytes that isn't a source map, where it is smaller."""
    chosen = graph.find_assets(wanted).where((F.col("type") != "SourceMap") & F.col("url").isNotNull() & (F.length("raw_src") > GZIP_ABOVE))
    packed = chosen.withColumn("_gz", _gzipped("raw_src")).where(F.length("_gz") < F.length("raw_src"))
    new = packed.withColumn("id", _new_id("gz", F.col("id"))).withColumn("url", F.concat("url", F.lit(".gz"))).withColumn("raw_src", F.col("_gz")).withColumn("type", F.lit("Asset")).withColumn("text", F.lit(None).cast("string"))
    return graph.with_(assets=graph.assets.unionByName(_columns(new, graph.assets)))


IMAGE_SIZE = StructType().add("width", IntegerType()).add("height", IntegerType())


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a Png, Gif, Jpeg or Webp image."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8X" and len(raw) >= 30:
        return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            marker = raw[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(IMAGE_SIZE)
def _image_size(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None if r is None else image_size(bytes(r))) or (None, None) for r in raw], columns=["width", "height"]).astype("Int64")


@transform
def set_html_image_dimensions(graph: Graph, wanted: Query = None) -> Graph:
    """width and height attributes of HtmlImage relations that have neither, from the image's header or svg element."""
    raster = graph.assets.where(F.col("raw_src").isNotNull() & F.col("type").isin("Png", "Gif", "Jpeg", "Webp")).select("id", _image_size("raw_src").alias("s")).select("id", "s.width", "s.height")
    tag = F.regexp_extract("text", r"(?is)(<svg\b[^>]*>)", 1)
    svg = graph.assets.where((F.col("type") == "Svg") & F.col("text").isNotNull()).select("id", *[F.regexp_extract(tag, rf"(?i)\s{n}\s*=\s*[\"']?(\d+)", 1).try_cast("int").alias(n) for n in ("width", "height")])
    sizes = raster.unionByName(svg).where(F.col("width").isNotNull() & F.col("height").isNotNull())
    attrs = F.coalesce("node_attrs", F.create_map().cast("map<string,string>"))
    chosen = graph.find_relations({"type": "HtmlImage"} | dict(wanted or {})).where(F.try_element_at(attrs, F.lit("width")).isNull() & F.try_element_at(attrs, F.lit("height")).isNull())
    fresh = chosen.join(sizes.withColumnRenamed("id", "to_id"), "to_id").select("id", F.create_map(F.lit("width"), F.col("width").cast("string"), F.lit("height"), F.col("height").cast("string")).alias("_size"))
    return graph.with_(relations=graph.relations.join(fresh, "id", "left").withColumn("node_attrs", F.when(F.col("_size").isNotNull(), F.map_concat(attrs, F.col("_size"))).otherwise(F.col("node_attrs"))).select(*graph.relations.columns))


@F.pandas_udf(IntegerType())
def rule_count(text: pd.Series) -> pd.Series:
    """Selectors in a style sheet."""
    return pd.Series([None if t is None else count_rules(t) for t in text], dtype="Int64")


def _sheet_chunks(text: str, limit: int) -> list[str]:
    """A sheet cut between top-level rules so that no part has more than `limit` selectors (a single rule may)."""
    parts, start, depth, total, at = [], 0, 0, 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            n = count_rules(text[at : i + 1])
            if total and total + n > limit:
                parts.append(text[start:at])
                start, total = at, 0
            total += n
            at = i + 1
    parts.append(text[start:])
    return [p for p in parts if p.strip()]


@transform
def split_css_if_ie_limit_is_reached(graph: Graph, minimum_ie_version: int | None = None) -> Graph:
    """Sheets with more selectors than a browser reads are replaced by parts; their HtmlStyle relations follow in order."""
    limit = SELECTOR_LIMIT_OLD if minimum_ie_version is not None and minimum_ie_version <= 9 else SELECTOR_LIMIT

    @F.pandas_udf(ArrayType(StringType()))
    def chunks(text: pd.Series) -> pd.Series:
        return pd.Series([_sheet_chunks(t, limit) for t in text], dtype=object)

    big = graph.assets.where((F.col("type") == "Css") & F.col("text").isNotNull() & (F.length(F.col("text")) > limit) & (rule_count("text") > limit))
    parts = cut(big.select("id", "url", F.posexplode(chunks("text")).alias("_k", "_part")).withColumn("_new", _new_id("part", F.col("id"), F.col("_k"))))
    url = F.regexp_replace("url", r"(\.[^./?#]*)?$", "")
    assets = _columns(parts.select(F.col("_new").alias("id"), F.lit("Css").alias("type"), F.col("_part").alias("text"), F.when(F.col("url").isNotNull(), F.concat(url, F.lit("-"), F.col("_k").cast("string"), F.lit(".css"))).alias("url")), graph.assets)
    edges = graph.relations.join(parts.select(F.col("id").alias("to_id"), "_new", "_k"), "to_id")
    edges = _columns(edges.withColumn("to_id", F.col("_new")).withColumn("id", _new_id(F.col("id"), F.col("_k"))), graph.relations)
    gone = parts.select("id").distinct()
    rest = graph.relations.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    notes = gone.select(F.lit("info").alias("severity"), F.lit("split-css").alias("code"), F.col("id").alias("asset_id"), F.lit(f"more than {limit} selectors").alias("message"))
    return refresh_hrefs(graph.with_(assets=graph.assets.join(gone, "id", "left_anti").unionByName(assets), relations=rest.unionByName(edges), diagnostics=notes))


@transform
def apply_source_maps(graph: Graph) -> Graph:
    """The first loaded source map of each script or sheet, as the property source_map of the asset."""
    maps = graph.assets.where((F.col("type") == "SourceMap") & F.col("text").isNotNull()).select(F.col("id").alias("to_id"))
    first = graph.relations.where(F.col("type").isin("JavaScriptSourceMappingUrl", "CssSourceMappingUrl")).join(maps, "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", F.struct("ord", "id")).alias("_map"))
    props = F.coalesce("props", F.create_map().cast("map<string,string>"))
    fresh = F.map_concat(F.map_filter(props, lambda k, _: k != "source_map"), F.create_map(F.lit("source_map"), F.col("_map")))
    return graph.with_(assets=graph.assets.join(first, "id", "left").withColumn("props", F.when(F.col("_map").isNotNull(), fresh).otherwise(F.col("props"))).select(*graph.assets.columns))


@transform
def set_source_map_root(graph: Graph, wanted: Query = None, root: str = "") -> Graph:
    """sourceRoot of the matching source maps; their sources' hrefs are resolved against it from now on."""
    match = predicate(graph.assets, {"type": "SourceMap"} | dict(wanted or {}))
    bare = F.regexp_replace("text", r"\s*\"sourceRoot\"\s*:\s*\"(?:[^\"\\]|\\.)*\"\s*,?", "")
    fresh = F.regexp_replace(bare, r"^(\s*(?:\)\]\}'?[^\n]*\n)?\s*)\{", '$1{"sourceRoot":' + '"' + root.replace("\\", "\\\\").replace('"', '\\"').replace("$", "\\$") + '",')
    return graph.with_(assets=graph.assets.withColumn("text", F.when(match & F.col("text").isNotNull(), F.regexp_replace(fresh, r",\s*\}$", "}")).otherwise(F.col("text"))))


def strip_statements(text: str) -> str:
    """JavaScript without `debugger` statements and statements that only call console methods."""
    out, at, start = [], 0, True
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "name" and start and value in ("console", "debugger"):
            end = _statement_end(text, m.end(), value)
            if end is not None:
                at = end
                continue
        if kind not in ("space", "comment"):
            start = value in (";", "{", "}")
        out.append(value)
        at = m.end()
    return "".join(out)


def _statement_end(text: str, at: int, word: str) -> int | None:
    """The end of a statement that begins with `word`, if it is one to drop."""
    if word == "debugger":
        m = re.compile(r"[ \t]*(?:;|(?=[\r\n}])|$)").match(text, at)
        return m.end() if m else None
    m = re.compile(r"\s*\.\s*[\w$]+\s*\(").match(text, at)
    if not m:
        return None
    depth, at = 1, m.end()
    while depth and at < len(text):
        t = _TOKEN.match(text, at)
        if t.lastgroup == "mark":
            depth += (t.group() in "([{") - (t.group() in ")]}")
        at = t.end()
    m = re.compile(r"[ \t]*(?:;|(?=[\r\n}])|$)").match(text, at)
    return m.end() if m and not depth else None


@F.pandas_udf(StringType())
def _stripped(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else strip_statements(t) for t in text], dtype=object)


@transform
def strip_debug(graph: Graph, wanted: Query = None) -> Graph:
    match = predicate(graph.assets, {"type": "JavaScript"} | dict(wanted or {}))
    return graph.with_(assets=_with_text(graph.assets, match & F.col("text").rlike(r"\b(?:console|debugger)\b"), _stripped))


def _with_text(assets: DataFrame, match: Column, f) -> DataFrame:
    """Text changed by a Python function where `match`; other texts don't leave the JVM."""
    changed = f(F.when(match, F.col("text")))
    return assets.withColumn("text", F.coalesce(changed, F.col("text")))


def minified(type_: str, text: str) -> str:
    """Text without white space and comments that don't matter."""
    if type_ in ("Json", "SourceMap", "ApplicationManifest", "I18n"):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text
    if type_ == "JavaScript":
        return compressed(text)
    if type_ == "Css":
        kept: list[str] = []
        for m in re.finditer(r"/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\s+|[{}:;,>]|[^\s{}:;,>\"'/]+|/", text, re.S):
            t = m.group()
            if t.startswith("/*"):
                continue
            kept.append(" " if t.isspace() else t)
        return re.sub(r" ?([{};,]) ?|^ | $", lambda m: m.group(1) or "", "".join(kept)).replace(";}", "}")
    if type_ in ("Xml", "Svg", "Atom", "Rss", "Xslt", "Html"):
        return re.sub(r">\s+<", "><", re.sub(r"<!--(?!\[if).*?-->", "", text, flags=re.S)).strip() if type_ != "Html" else re.sub(r"<!--(?!\[if|\s*/?ko\b|esi).*?-->", "", text, flags=re.S)
    return text


@transform
def minify_assets(graph: Graph, wanted: Query = None) -> Graph:
    """Minifies the matching Json, JavaScript, Css and Xml texts, and drops comments of Html."""
    match = predicate(graph.assets, wanted)

    @F.pandas_udf(StringType())
    def work(type_: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else minified(k, t) for k, t in zip(type_, text)], dtype=object)

    return graph.with_(assets=graph.assets.withColumn("text", F.coalesce(work("type", F.when(match, F.col("text"))), F.col("text"))))


@transform
def compress_javascript(graph: Graph, wanted: Query = None) -> Graph:
    """minify_assets for the matching scripts: comments and white space go, names stay."""
    return minify_assets(graph, {"type": "JavaScript"} | dict(wanted or {}))


def bundled_declarations(text: str) -> list[tuple[str, str]]:
    """(selector, declaration) of the top-level style rules of a sheet."""
    return [(around[-1], body) for kind, around, body in declarations(text) if kind == "declaration" and len(around) == 1 and not around[-1].startswith("@")]
