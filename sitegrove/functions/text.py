"""Scalar functions on small texts: srcset, source map positions, canonical Json, conditions, sniffed charsets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: The digits of base64 VLQ.
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MAPPING = StructType().add("generated_line", IntegerType()).add("generated_column", IntegerType()).add("source", StringType()).add("original_line", IntegerType()).add("original_column", IntegerType()).add("name", StringType())


def srcset_entries(srcset: Column) -> Column:
    """Array of (url, descriptors): entries end at a comma followed by white space."""
    parts = F.filter(F.split(F.trim(srcset), r",\s+"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\S+)", 1).alias("url"), F.trim(F.regexp_extract(p, r"^\s*\S+\s*(.*?)\s*,?\s*$", 1)).alias("descriptors")))


def srcset_text(entries: Column) -> Column:
    """The srcset of an array of (url, descriptors)."""
    return F.array_join(F.transform(entries, lambda e: F.trim(F.concat_ws(" ", e["url"], F.when(e["descriptors"] != "", e["descriptors"])))), ", ")


def device_pixel_ratio(file_name: Column) -> Column:
    """The number of an `@2x` suffix before the extension; 1 without."""
    found = F.regexp_extract(file_name, r"@(\d+(?:\.\d+)?)x(?:\.[^.]*)?$", 1)
    return F.coalesce(F.when(found != "", found.cast("double")), F.lit(1.0))


def sniffed_charset(head: Column) -> Column:
    """The charset that the first 1024 bytes of Html, Css or Xml declare, in lower case; null without one."""
    start = F.substr(F.decode(F.substr(head, F.lit(1), F.lit(1024)), "iso-8859-1"), F.lit(1))
    found = F.coalesce(
        *[F.nullif(F.regexp_extract(start, p, 1), F.lit("")) for p in (r"(?i)<meta[^>]*charset\s*=\s*[\"']?\s*([\w-]+)", r"(?i)^\s*@charset\s*[\"']([\w-]+)[\"']", r"(?i)^\s*<\?xml[^>]*encoding\s*=\s*[\"']([\w-]+)[\"']")]
    )
    return F.lower(found)


def xml_declaration(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^﻿?\s*(<\?xml\s[^>]*\?>)", 1), F.lit(""))


#: Stands for the namespace of a prefix that nothing declares.
ADDED_NAMESPACE = "urn:added"


def with_svg_namespaces(text: Column) -> Column:
    """Inline svg with the namespace declarations that it needs as a document of its own."""
    tag = F.regexp_extract(text, r"(?is)(<svg\b[^>]*>)", 1)
    own = F.when(~tag.rlike(r"(?i)\sxmlns\s*="), F.lit(' xmlns="http://www.w3.org/2000/svg"')).otherwise("")
    link = F.when(text.rlike(r"(?i)\sxlink:") & ~tag.rlike(r"(?i)\sxmlns:xlink\s*="), F.lit(' xmlns:xlink="http://www.w3.org/1999/xlink"')).otherwise("")
    used = F.regexp_extract_all(text, F.lit(r"[<\s/]([A-Za-z][\w.-]*):[A-Za-z]"), F.lit(1))
    other = F.filter(F.array_distinct(used), lambda p: ~p.isin("xml", "xmlns", "svg", "xlink") & ~F.contains(text, F.concat(F.lit("xmlns:"), p)))
    fake = F.array_join(F.transform(other, lambda p: F.concat(F.lit(" xmlns:"), p, F.lit(f'="{ADDED_NAMESPACE}"'))), "")
    at = F.regexp_instr(text, F.lit(r"(?i)<svg\b"))
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at + 3), own, link, fake, F.substr(text, at + 4))).otherwise(text)


def without_added_namespaces(text: Column) -> Column:
    """The text without the declarations that with_svg_namespaces made up for unknown prefixes."""
    return F.regexp_replace(text, rf' xmlns:[^=\s]+="{ADDED_NAMESPACE}"', "")


def decode_mappings(text: str) -> list[tuple]:
    """The mappings of a source map (version 3) as rows of MAPPING; lines from 1, columns from 0."""
    try:
        data = json.loads(re.sub(r"^\)\]\}'?[^\n]*\n", "", text))
        mappings, sources, names = data["mappings"], data.get("sources") or [], data.get("names") or []
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    root = data.get("sourceRoot") or ""
    out = []
    source = line = column = name = 0
    for n, group in enumerate(mappings.split(";"), 1):
        at = 0
        for segment in filter(None, group.split(",")):
            values, shift, value = [], 0, 0
            for c in segment:
                digit = _DIGITS.find(c)
                if digit < 0:
                    return out
                value |= (digit & 31) << shift
                shift += 5
                if not digit & 32:
                    values.append(-(value >> 1) if value & 1 else value >> 1)
                    shift = value = 0
            if not values:
                continue
            at += values[0]
            if len(values) < 4:
                out.append((n, at, None, None, None, None))
                continue
            source, line, column = source + values[1], line + values[2], column + values[3]
            found = None
            if len(values) > 4:
                name += values[4]
                found = names[name] if 0 <= name < len(names) else None
            out.append((n, at, root + sources[source] if 0 <= source < len(sources) else None, line + 1, column, found))
    return out


@F.pandas_udf(ArrayType(MAPPING))
def source_map_positions(text: pd.Series) -> pd.Series:
    """All mappings of source maps, for explode and range joins on positions."""
    return pd.Series([None if t is None else decode_mappings(t) for t in text], dtype=object)


def canonical(value: object) -> object:
    """Objects with sorted keys, all the way down."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    return [canonical(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Json with sorted keys and no white space; null where it doesn't parse."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(canonical(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pd.Series([one(t) for t in text], dtype=object)


def parse_conditions(text: str) -> dict[str, list[str]] | None:
    """`name: 'v', other: ['a', 'b']` as a dictionary of lists; None if it isn't of this form."""
    out: dict[str, list[str]] = {}
    at, item = 0, re.compile(r"\s*([\w-]+)\s*:\s*(?:'([^']*)'|\"([^\"]*)\"|\[([^\]]*)\])\s*(,|$)")
    while at < len(text.rstrip()):
        m = item.match(text, at)
        if not m:
            return None
        out[m.group(1)] = re.findall(r"['\"]([^'\"]*)['\"]", m.group(4)) if m.group(4) is not None else [m.group(2) if m.group(2) is not None else m.group(3)]
        at = m.end()
    return out


def stringify_conditions(conditions: dict[str, list[str]]) -> str:
    return ", ".join(f"{k}: {repr(v[0]) if len(v) == 1 else '[' + ', '.join(map(repr, v)) + ']'}" for k, v in conditions.items())
