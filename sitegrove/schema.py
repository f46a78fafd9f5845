"""The registry of asset types and the schemas of the two tables of a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType


@dataclass(frozen=True)
class AssetType:
    name: str
    parents: tuple[str, ...] = ()
    content_type: str | None = None
    extensions: tuple[str, ...] = field(default=())


#: The types with their parent (Svg is an image too), content type and extensions.
_TYPES = """
Asset | | application/octet-stream |
Text | Asset | text/plain | .txt .htaccess .md .rst .ics .csv .tsv .xtemplate
Html | Text | text/html | .html .template .xhtml .shtml .ko .ejs
Htc | Html | text/x-component | .htc
Css | Text | text/css | .css
JavaScript | Text | application/javascript | .js
Json | Text | application/json | .json .topojson
I18n | Json | | .i18n
SourceMap | Json | | .map
ApplicationManifest | Json | application/manifest+json | .webmanifest
Xml | Text | text/xml | .xml
Xslt | Xml | text/xslt+xml | .xsl .xslt
Atom | Xml | application/atom+xml | .atom
Rss | Xml | application/rss+xml | .rdf .rss
MsApplicationConfig | Xml | |
Svg | Xml Image | image/svg+xml | .svg
CacheManifest | Text | text/cache-manifest | .appcache
SrcSet | Text | |
Image | Asset | |
Png | Image | image/png | .png
Gif | Image | image/gif | .gif
Jpeg | Image | image/jpeg | .jpg .jpeg
Webp | Image | image/webp | .webp
Avif | Image | image/avif | .avif
Ico | Image | image/x-icon | .ico
Font | Asset | |
Eot | Font | application/vnd.ms-fontobject | .eot
Otf | Font | font/otf | .otf
Ttf | Font | font/ttf | .ttf
Woff | Font | font/woff | .woff
Woff2 | Font | font/woff2 | .woff2
Flash | Asset | application/x-shockwave-flash | .swf
"""
#: Further content types.
_EXTRA_CONTENT_TYPES = {"text/javascript": "JavaScript", "application/x-font-woff": "Woff"}


def _read(table: str) -> dict[str, AssetType]:
    out = {}
    for line in table.strip().split("\n"):
        name, parents, content_type, extensions = (part.strip() for part in line.split("|"))
        out[name] = AssetType(name, tuple(parents.split()), content_type or None, tuple(extensions.split()))
    return out


class Registry:
    """Types by name, content type and extension; more can be registered."""

    def __init__(self) -> None:
        self.types = _read(_TYPES)

    def register(self, type_: AssetType) -> None:
        unknown = [p for p in type_.parents if p not in self.types]
        if unknown:
            raise ValueError(f"unknown parent types: {unknown}")
        self.types[type_.name] = type_

    def by_content_type(self) -> dict[str, str]:
        return {t.content_type: t.name for t in self.types.values() if t.content_type} | _EXTRA_CONTENT_TYPES

    def by_extension(self) -> dict[str, str]:
        return {e: t.name for t in self.types.values() for e in t.extensions}

    def ancestors(self, name: str) -> set[str]:
        """The type itself and everything above it."""
        out = {name}
        for parent in self.types[name].parents if name in self.types else ():
            out |= self.ancestors(parent)
        return out

    def descendants(self, name: str) -> list[str]:
        return sorted(t for t in self.types if name in self.ancestors(t))

    def compatible(self, a: str | None, b: str | None) -> bool:
        """Whether two expected types agree: one is the other's ancestor. Any image or font stands for its kind."""
        if a is None or b is None or a not in self.types or b not in self.types:
            return True
        up_a, up_b = self.ancestors(a), self.ancestors(b)
        return a in up_b or b in up_a or ("Image" in up_a and "Image" in up_b) or ("Font" in up_a and "Font" in up_b)


registry = Registry()


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """table[key] as a literal map, null where there is none."""
    pairs = [F.lit(x) for pair in sorted(table.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def type_of_content_type(content_type: Column) -> Column:
    """The type of a Content-Type header: without parameters and case; exact, without `+xml`, with `+xml`, then text/*."""
    plain = F.lower(F.trim(F.regexp_extract(content_type, r"^([^;]*)", 1)))
    table = registry.by_content_type()
    found = F.coalesce(_lookup(plain, table), _lookup(F.regexp_replace(plain, r"\+xml$", ""), table), _lookup(F.concat(plain, F.lit("+xml")), table))
    return F.coalesce(found, F.when(plain.startswith("text/"), F.lit("Text")))


def type_of_extension(extension: Column) -> Column:
    return _lookup(F.lower(extension), registry.by_extension())


def is_a(type_: Column, ancestor: str) -> Column:
    """Whether a type is `ancestor` or below it; null types are not."""
    return F.coalesce(type_.isin(*registry.descendants(ancestor)), F.lit(False))


def inferred_type(content_type: Column, target_type: Column, extension: Column) -> Column:
    """The type by content type, refined by the incoming relation's target type and then by the extension.

    A target type counts only if nothing or a general type (Asset, Image, Font) is known and it refines that; the
    extension only if nothing is known or it refines what is, and the content type was not plain text.
    """
    own = type_of_content_type(content_type)

    above = F.create_map(*[x for t in sorted(registry.types) for x in (F.lit(t), F.array(*[F.lit(p) for p in sorted(registry.ancestors(t) - {t})] or [F.lit("")]))])

    def refines(new: Column, old: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at(above, new), old), F.lit(False))

    general = own.isNull() | own.isin("Asset", "Image", "Font")
    second = F.when(general & target_type.isNotNull() & (own.isNull() | refines(target_type, own)), target_type).otherwise(own)
    by_extension = type_of_extension(extension)
    third = F.when(by_extension.isNotNull() & (second.isNull() | (refines(by_extension, second) & (F.coalesce(own, F.lit("")) != "Text"))), by_extension)
    return F.coalesce(third, second)


ASSETS = StructType(
    [
        StructField("id", StringType()), StructField("seq", LongType()), StructField("type", StringType()), StructField("url", StringType()), StructField("is_initial", BooleanType()), StructField("is_redirect", BooleanType()),
        StructField("location", StringType()), StructField("status_code", IntegerType()), StructField("raw_src", BinaryType()), StructField("text", StringType()), StructField("encoding", StringType()), StructField("content_type", StringType()),
        StructField("last_modified", TimestampNTZType()), StructField("props", MapType(StringType(), StringType())),
    ]
)
RELATIONS = StructType(
    [
        StructField("from_id", StringType()), StructField("type", StringType()), StructField("ord", IntegerType()), StructField("href", StringType()), StructField("target_type", StringType()), StructField("inline_text", StringType()),
        StructField("inline_type", StringType()), StructField("media", StringType()), StructField("condition", StringType()), StructField("in_head", BooleanType()), StructField("node_path", StringType()),
        StructField("node_attrs", MapType(StringType(), StringType())), StructField("props", MapType(StringType(), StringType())),
    ]
)
DIAGNOSTICS = StructType([StructField("severity", StringType()), StructField("code", StringType()), StructField("asset_id", StringType()), StructField("message", StringType())])
ARRAY_OF_RELATIONS = ArrayType(RELATIONS)
