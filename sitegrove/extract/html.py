"""Relations of Html: tables of elements and attributes, and functions where a table doesn't do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from sitegrove.extract.dom import Node, parse_html
from sitegrove.extract.edges import Edge

#: Relation by rel token of a link with href, with the target type and whether the type attribute counts.
LINKS = {
    "alternate": ("HtmlAlternateLink", None), "apple-touch-startup-image": ("HtmlAppleTouchStartupImage", "Image"), "manifest": ("HtmlApplicationManifest", "ApplicationManifest"), "author": ("HtmlAuthorLink", None),
    "dns-prefetch": ("HtmlDnsPrefetchLink", None), "import": ("HtmlImport", "Html"), "logo": ("HtmlLogo", "Image"), "preconnect": ("HtmlPreconnectLink", None), "prefetch": ("HtmlPrefetchLink", None),
    "preload": ("HtmlPreloadLink", None), "prerender": ("HtmlPrerenderLink", None), "search": ("HtmlSearchLink", None), "serviceworker": ("HtmlServiceWorkerRegistration", "JavaScript"),
    "icon": ("HtmlShortcutIcon", "Image"), "mask-icon": ("HtmlShortcutIcon", "Image"), "apple-touch-icon": ("HtmlShortcutIcon", "Image"), "apple-touch-icon-precomposed": ("HtmlShortcutIcon", "Image"),
}
#: Relation, element, attribute with the href, target type.
ATTRIBUTES = (
    ("HtmlAnchor", "a", "href", None), ("HtmlCacheManifest", "html", "manifest", "CacheManifest"), ("HtmlEdgeSideInclude", "esi:include", "src", None), ("HtmlEmbed", "embed", "src", None), ("HtmlFrame", "frame", "src", None),
    ("HtmlIFrame", "iframe", "src", None), ("HtmlImage", "img", "src", "Image"), ("HtmlVideo", "video", "src", None), ("HtmlVideoPoster", "video", "poster", "Image"), ("HtmlAudio", "audio", "src", None), ("HtmlApplet", "applet", "archive", None),
    ("HtmlApplet", "applet", "codebase", None), ("HtmlObject", "object", "data", None),
)
#: What a resource hint's `as` says about its target.
AS_TYPES = {"script": "JavaScript", "worker": "JavaScript", "style": "Css", "image": "Image", "font": "Font", "document": "Html", "track": "Text"}
_BY_TAG: dict[str, list[tuple[str, str, str | None]]] = {}
for _type, _tag, _attr, _target in ATTRIBUTES:
    _BY_TAG.setdefault(_tag, []).append((_type, _attr, _target))
_REFRESH = re.compile(r"^\d+;\s*url\s*=\s*(.*?)\s*$", re.I | re.S)
_CONDITIONAL = re.compile(r"^\[if\s([^\]]*)\]>(.*)<!\[endif\]$", re.I | re.S)
_KNOCKOUT = re.compile(r"^\s*ko\s+(.*?)\s*$", re.S)
_OPEN_GRAPH = re.compile(r"^og:(?:.*url$|image|audio|video)", re.I)
_OBJECT = re.compile(r"^\s*(?:[\w$]+|\"[^\"]*\"|'[^']*')\s*:", re.S)
_SCRIPT_TYPES = ("text/javascript", "module")
_TEMPLATE_TYPES = ("text/html", "text/ng-template")


def _link(node: Node) -> Iterator[Edge]:
    rels, href = node.tokens("rel"), node.get("href")
    if "stylesheet" in rels:
        yield Edge("HtmlStyle", href, "Css", media=node.get("media"))
    if href is None:
        return
    if (node.get("rel") or "").strip().lower() == "fluid-icon":
        yield Edge("HtmlFluidIconLink", href, "Image")
    for type_, target in dict.fromkeys(LINKS[r] for r in rels if r in LINKS):
        props = {}
        if type_ in ("HtmlPrefetchLink", "HtmlPreloadLink", "HtmlPrerenderLink"):
            kind = node.get("as")
            target = AS_TYPES.get((kind or "").lower(), target)
            props = {"as": kind} if kind else {}
        if type_ == "HtmlServiceWorkerRegistration" and node.get("scope"):
            props = {"scope": node.get("scope")}
        if node.get("type") and type_ in ("HtmlAlternateLink", "HtmlAuthorLink", "HtmlLogo", "HtmlPreloadLink", "HtmlSearchLink"):
            props["contentType"] = node.get("type")
        yield Edge(type_, href, target, props=props)


def _meta(node: Node) -> Iterator[Edge]:
    content, name = node.get("content"), (node.get("name") or "").lower()
    if content is None:
        return
    if (node.get("http-equiv") or "").lower() == "refresh" and (m := _REFRESH.match(content)):
        yield Edge("HtmlMetaRefresh", m.group(1))
    if name == "msapplication-config":
        yield Edge("HtmlMsApplicationConfig", content, "MsApplicationConfig")
    if name == "msapplication-tileimage":
        yield Edge("HtmlMsApplicationTileImageMeta", content, "Image")
    if _OPEN_GRAPH.match(node.get("property") or ""):
        yield Edge("HtmlOpenGraph", content, props={"ogProperty": node.get("property")})


def _script(node: Node) -> Iterator[Edge]:
    kind = node.get("type")
    if kind is None or kind.strip().lower() in _SCRIPT_TYPES:
        if node.get("src"):
            yield Edge("HtmlScript", node.get("src"), "JavaScript")
        else:
            yield Edge("HtmlScript", None, "JavaScript", node.content(), "JavaScript")
    elif kind.strip().lower() in _TEMPLATE_TYPES:
        yield Edge("HtmlInlineScriptTemplate", None, None, node.content(), "Html")


def _source(node: Node) -> Iterator[Edge]:
    parent = node.parent.tag if node.parent else ""
    if parent in ("audio", "video") and node.get("src") is not None:
        yield Edge("HtmlAudio" if parent == "audio" else "HtmlVideo", node.get("src"))
    if parent == "picture":
        if node.get("src") is not None:
            yield Edge("HtmlPictureSource", node.get("src"), "Image")
        if node.get("srcset") is not None:
            yield Edge("HtmlPictureSourceSrcSet", None, None, node.get("srcset"), "SrcSet")


def _param(node: Node) -> Iterator[Edge]:
    name = (node.get("name") or "").lower()
    if node.parent and node.parent.tag == "object" and name in ("src", "movie") and node.get("value") is not None:
        yield Edge("HtmlObject", node.get("value"), props={"attributeName": "value"})


def _track(node: Node) -> Iterator[Edge]:
    if node.parent and node.parent.tag == "audio" and node.get("src") is not None:
        yield Edge("HtmlAudio", node.get("src"))


SPECIAL: dict[str, Callable[[Node], Iterator[Edge]]] = {"link": _link, "meta": _meta, "script": _script, "source": _source, "param": _param, "track": _track}


def _inline(node: Node, source: str) -> Iterator[Edge]:
    """Inline assets that any element or comment may hold, in alphabetical order of relation types as far as it matters."""
    if node.tag == "#comment":
        if m := _CONDITIONAL.match(node.text.strip()):
            yield Edge("HtmlConditionalComment", None, "Html", m.group(2), "Html", condition=m.group(1))
        elif node.text.startswith("esi"):
            yield Edge("HtmlEdgeSideIncludeSafeComment", None, None, node.text[3:], "Html")
        elif m := _KNOCKOUT.match(node.text):
            yield Edge("HtmlKnockoutContainerless", None, "JavaScript", f"({{{m.group(1)}}});", "JavaScript")
        return
    for name, value in node.attrs.items():
        if name.startswith("on") and len(name) > 2:
            yield Edge("HtmlInlineEventHandler", None, "JavaScript", f"function bogus() {{{value}}}", "JavaScript", props={"attributeName": name})
    if _OBJECT.match(node.get("data-bind") or ""):
        yield Edge("HtmlDataBindAttribute", None, "JavaScript", f"({{{node.get('data-bind')}}});", "JavaScript")
    if _OBJECT.match(node.get("params") or ""):
        yield Edge("HtmlParamsAttribute", None, "JavaScript", f"({{{node.get('params')}}});", "JavaScript")
    if node.get("style") is not None:
        yield Edge("HtmlStyleAttribute", None, "Css", f"bogusselector {{{node.get('style')}}}", "Css")
    if node.tag == "img" and node.get("srcset") is not None:
        yield Edge("HtmlImageSrcSet", None, "SrcSet", node.get("srcset"), "SrcSet")
    if node.tag == "iframe" and node.get("srcdoc") is not None:
        yield Edge("HtmlIFrameSrcDoc", None, None, node.get("srcdoc"), "Html")
    if node.tag == "style":
        yield Edge("HtmlStyle", None, "Css", node.content(), "Css", media=node.get("media"))
    if node.tag in ("noscript", "template"):
        inside = source[source.find(">", node.start) + 1 : node.end]
        inside = re.sub(rf"</{node.tag}\s*>\s*$", "", inside, flags=re.I)
        yield Edge("HtmlNoscript", None, "Html", inside, "Html") if node.tag == "noscript" else Edge("HtmlTemplate", None, None, inside, "Html")
    if node.tag == "svg":
        yield Edge("HtmlSvgIsland", None, None, source[node.start : node.end], "Svg")


def extract_html(text: str) -> list[Edge]:
    """All relations in document order; the inside of svg, noscript and template belongs to their inline assets."""
    out: list[Edge] = []
    stack = [parse_html(text)]
    while stack:
        node = stack.pop()
        if node.tag != "#text":
            found = [Edge(type_, node.get(attr), target, props={"attributeName": attr} if node.tag in ("applet", "object") else {}) for type_, attr, target in _BY_TAG.get(node.tag, ()) if node.get(attr) is not None]
            if node.tag in SPECIAL:
                found.extend(SPECIAL[node.tag](node))
            found.extend(_inline(node, text))
            for edge in found:
                edge.in_head, edge.node_path, edge.node_attrs = node.in_head, node.path(), dict(node.attrs)
            out.extend(found)
        if node.tag not in ("svg", "noscript", "template"):
            stack.extend(reversed(node.children))
    return out


def is_fragment(text: str) -> bool:
    """Whether Html lacks all of doctype, html, head and body."""
    return re.search(r"<(?:!doctype|html|head|body)[\s>]", text, re.I) is None


def base_href(text: str) -> str | None:
    """The href of the first base element that has one."""
    for node in parse_html(text).walk():
        if node.tag == "base" and node.get("href") is not None:
            return node.get("href")
    return None
