"""Relations of Xml dialects, Json dialects, cache manifests and srcsets."""

from __future__ import annotations

import json
import re

from sitegrove.extract.dom import Node, parse_xml
from sitegrove.extract.edges import Edge

_STYLESHEET = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: Elements of Svg with an href, with relation and target type; elements of the tile configuration.
SVG_HREFS = {"a": ("SvgAnchor", None), "font-face-uri": ("SvgFontFaceUri", "Font"), "image": ("SvgImage", "Image"), "pattern": ("SvgPattern", "Image"), "use": ("SvgUse", "Svg")}
TILE_IMAGES = ("TileImage", "square70x70logo", "square150x150logo", "wide310x150logo", "square310x310logo")
POLLING = ("polling-uri", "polling-uri2", "polling-uri3", "polling-uri4", "polling-uri5")


def _local(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


def _href(node: Node) -> tuple[str | None, bool]:
    """The non-empty xlink:href, else href; whether it was the first."""
    return (node.get("xlink:href"), True) if node.get("xlink:href") else (node.get("href"), False)


def extract_xml(text: str, type_: str = "Xml") -> list[Edge]:
    """Relations of Xml, Svg, Atom, Rss and MsApplicationConfig."""
    out: list[Edge] = []
    for node in parse_xml(text).walk():
        found: list[Edge] = []
        tag = _local(node.tag)
        if node.tag == "?xml-stylesheet" and (m := _STYLESHEET.search(node.text)):
            found.append(Edge("XmlStylesheet", m.group(1) if m.group(1) is not None else m.group(2)))
        elif type_ == "Svg":
            found = _svg(node, tag)
        elif type_ == "Rss" and node.parent is not None:
            if tag == "link" and _local(node.parent.tag) == "channel" and node.content().strip():
                found.append(Edge("RssChannelLink", node.content().strip()))
            elif tag == "description" and _local(node.parent.tag) == "item":
                found.append(Edge("RssHtmlInlineFragment", None, "Html", node.content(), "Html"))
        elif type_ == "Atom" and tag == "content" and node.parent is not None and _local(node.parent.tag) == "entry" and (node.get("type") or "").lower() == "html":
            found.append(Edge("AtomHtmlInlineFragment", None, "Html", node.content(), "Html"))
        elif type_ == "MsApplicationConfig":
            if tag in TILE_IMAGES and node.get("src") is not None:
                found.append(Edge("MsApplicationConfigImage", node.get("src"), "Image"))
            elif tag in POLLING and node.get("src") is not None and node.parent is not None and _local(node.parent.tag) in ("badge", "notification"):
                found.append(Edge("MsApplicationConfigPollingUri", node.get("src"), "Xml"))
        for edge in found:
            edge.node_path, edge.node_attrs = node.path(), dict(node.attrs)
        out.extend(found)
    return out


def _svg(node: Node, tag: str) -> list[Edge]:
    out: list[Edge] = []
    if tag in SVG_HREFS:
        href, xlink = _href(node)
        if href is not None:
            type_, target = SVG_HREFS[tag]
            out.append(Edge(type_, href, target, props={"isXlink": str(xlink).lower()}))
    out.extend(Edge("SvgInlineEventHandler", None, "JavaScript", f"function bogus() {{{value}}}", "JavaScript", props={"attributeName": name}) for name, value in node.attrs.items() if re.match(r"(?i)on\w", name))
    if tag == "script" and (node.get("type") or "text/javascript") == "text/javascript":
        href, xlink = _href(node)
        out.append(Edge("SvgScript", href, "JavaScript", props={"isXlink": str(xlink).lower()}) if href else Edge("SvgScript", None, "JavaScript", node.content(), "JavaScript"))
    if tag == "style":
        out.append(Edge("SvgStyle", None, "Css", node.content(), "Css"))
    if node.get("style") is not None:
        out.append(Edge("SvgStyleAttribute", None, "Css", f"bogusselector {{{node.get('style')}}}", "Css"))
    return out


def _loads(text: str) -> object:
    try:
        return json.loads(re.sub(r"^\)\]\}'?[^\n]*\n", "", text.lstrip("﻿")))
    except (ValueError, RecursionError):
        return None


def extract_manifest(text: str) -> list[Edge]:
    """Relations of a web application manifest."""
    data = _loads(text)
    if not isinstance(data, dict):
        return []
    out = []

    def add(value: object, property_: str) -> None:
        if isinstance(value, str):
            out.append(Edge("ApplicationManifestUrl", value, props={"hrefProperty": property_}))

    add(data.get("start_url"), "start_url")
    for key, name in (("related_applications", "url"), ("splash_screens", "src"), ("icons", "src")):
        for item in data.get(key) if isinstance(data.get(key), list) else []:
            if isinstance(item, dict):
                add(item.get(name), f"{key}.{name}")
    return out


def extract_source_map(text: str) -> list[Edge]:
    """Relations of a source map: its file and sources, without the names that bundlers make up."""
    data = _loads(text)
    if not isinstance(data, dict):
        return []
    out = [Edge("SourceMapFile", data["file"])] if isinstance(data.get("file"), str) and data["file"] else []
    sources = data.get("sources")
    for i, source in enumerate(sources if isinstance(sources, list) else []):
        if isinstance(source, str) and not re.match(r"^(?:webpack:|\(webpack\)|webpack/|.*/\(webpack\)/)|^<", source):
            out.append(Edge("SourceMapSource", source, props={"index": str(i)}))
    return out


def manifest_sections(text: str) -> dict[str, list[list[str]]]:
    """Tokens of each line of a cache manifest by section; lines before any header belong to CACHE."""
    out: dict[str, list[list[str]]] = {"CACHE": []}
    section = "CACHE"
    for n, line in enumerate(text.lstrip("﻿").splitlines()):
        line = line.strip()
        if (n == 0 and line.startswith("CACHE MANIFEST")) or not line or line.startswith("#"):
            continue
        if line.endswith(":") and " " not in line:
            section = line[:-1].upper()
            out.setdefault(section, [])
        else:
            out[section].append(line.split())
    return out


def extract_cache_manifest(text: str) -> list[Edge]:
    """Entries of all sections but NETWORK, sections in alphabetical order: the last token of each line."""
    sections = manifest_sections(text)
    return [Edge("CacheManifestEntry", line[-1], props={"sectionName": name}) for name in sorted(sections) if name != "NETWORK" for line in sections[name]]


def extract_srcset(text: str) -> list[Edge]:
    """Entries of a srcset: urls with their descriptors."""
    out = []
    for part in re.split(r",\s+", text.strip()):
        words = part.strip().rstrip(",").split()
        if words:
            out.append(Edge("SrcSetEntry", words[0], "Image", props={"extraTokens": " ".join(words[1:])}))
    return out
