"""Computed columns of assets: what their text, url and type say, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrove.functions import urls as U
from sitegrove.functions.text import device_pixel_ratio, xml_declaration
from sitegrove.schema import is_a

_COMMENTS = r"(?s)/\*.*?\*/|//[^\n]*"


def is_strict() -> Column:
    """Whether a script begins with a "use strict" directive."""
    return F.regexp_replace("text", _COMMENTS, "").rlike(r"^\s*[\"']use strict[\"']")


def is_empty() -> Column:
    """Whether a script or sheet holds nothing but white space, comments and semicolons."""
    return ~F.regexp_replace("text", _COMMENTS, "").rlike(r"[^\s;]")


def asset_facts(assets: DataFrame) -> DataFrame:
    """The asset with is_inline, is_image, is_font, is_text, is_fragment, is_empty, is_strict, is_pretty, base_name, path,
    protocol, hostname, port, origin, query, device_pixel_ratio, xml_declaration and description.

    Facts about a text are null where it is null or of another type.
    """
    kind = F.col("type")
    script, sheet = is_a(kind, "JavaScript"), is_a(kind, "Css")
    url = F.col("url")
    return assets.withColumns(
        {
            "is_inline": url.isNull(), "is_image": is_a(kind, "Image"), "is_font": is_a(kind, "Font"), "is_text": is_a(kind, "Text"),
            "is_fragment": F.when(is_a(kind, "Html"), ~F.col("text").rlike(r"(?i)<(?:!doctype|html|head|body)[\s>]")), "is_empty": F.when(script | sheet, is_empty()), "is_strict": F.when(script, is_strict()),
            "is_pretty": F.when(is_a(kind, "Json"), F.col("text").rlike(r"^\s*[\[{]\s*\n\s")), "base_name": U.base_name(url), "path": U.directory(url), "protocol": U.protocol(url), "hostname": U.hostname(url), "port": U.port(url), "origin": U.origin(url),
            "query": U.query_map(url), "device_pixel_ratio": F.when(is_a(kind, "Image"), device_pixel_ratio(F.coalesce(U.file_name(url), F.lit("")))), "xml_declaration": F.when(is_a(kind, "Xml"), xml_declaration(F.col("text"))),
            "description": F.format_string("[%s/%s %s]", kind, F.col("id"), F.coalesce(url, F.lit("inline"))),
        }
    )


def dirty(assets: DataFrame, changed: DataFrame, owners: DataFrame) -> DataFrame:
    """Assets with is_dirty: they, or an asset inline in them, are among `changed` (id). `owners` is (id, owner_id)."""
    touched = changed.select("id").unionByName(owners.join(changed.select("id"), "id", "left_semi").select(F.col("owner_id").alias("id"))).distinct().withColumn("is_dirty", F.lit(True))
    return assets.join(touched, "id", "left").withColumn("is_dirty", F.coalesce("is_dirty", F.lit(False)))


#: Relations that hint at a resource, and what a request for a target is called by its type, by another
#: relation that leads to it, and by its extension.
RESOURCE_HINTS = ("HtmlDnsPrefetchLink", "HtmlPreconnectLink", "HtmlPrefetchLink", "HtmlPreloadLink", "HtmlPrerenderLink")
DESTINATION_OF_RELATION = {"HtmlStyle": "style", "CssImport": "style", "HtmlAudio": "media", "HtmlVideo": "media", "CssFontFaceSrc": "font", "HtmlEmbed": "embed", "HtmlObject": "object"}
DESTINATION_OF_EXTENSION = {
    "style": ("css",), "script": ("js",), "image": ("svg", "jpg", "jpeg", "png", "gif", "webp", "ico", "tiff", "bmp"), "document": ("html",), "font": ("woff", "woff2", "ttf", "eot", "otf"),
}


def request_destinations(assets: DataFrame, relations: DataFrame) -> DataFrame:
    """id and destination of each resource hint: by the target's type, else by the first other relation into the target that
    says something (by ord and id), else by the target's extension; empty if nothing tells, null without a target."""
    into = relations.where(F.col("to_id").isNotNull())
    hints = relations.where(F.col("type").isin(*RESOURCE_HINTS)).select("id", "to_id")
    # The first two relations into a target are enough to know the first other one.
    order = F.struct(F.col("ord"), F.col("id"), F.col("type"))
    wanted = into.join(hints.select("to_id").distinct(), "to_id", "left_semi")
    first = wanted.groupBy("to_id").agg(F.min(order).alias("_a"))
    second = wanted.join(first, "to_id").where(F.col("id") != F.col("_a.id")).groupBy("to_id").agg(F.min(order).alias("_b"))
    targets = assets.select(F.col("id").alias("to_id"), F.col("type").alias("_type"), F.col("url").alias("_url"))
    rows = hints.join(targets, "to_id", "left").join(first, "to_id", "left").join(second, "to_id", "left")
    other = F.when(F.col("_a.id") != F.col("id"), F.col("_a.type")).otherwise(F.col("_b.type"))
    by_relation = F.when(other.isin("HtmlFrame", "HtmlIFrame") & (F.col("_type") == "Html"), "document")
    for type_, name in DESTINATION_OF_RELATION.items():
        by_relation = by_relation.when(other == type_, name)
    ending = F.lower(F.substr(U.extension(F.col("_url")), F.lit(2)))
    by_extension = F.when(F.lit(False), "")
    for name, endings in DESTINATION_OF_EXTENSION.items():
        by_extension = by_extension.when(ending.isin(*endings), name)
    by_type = F.when(is_a(F.col("_type"), "Image") | (F.col("_type") == "Svg"), "image").when(F.col("_type") == "JavaScript", "script").when(F.col("_type") == "Css", "style")
    return rows.select("id", F.when(F.col("to_id").isNotNull(), F.coalesce(by_type, by_relation, by_extension, F.lit(""))).alias("destination"))
