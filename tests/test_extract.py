import pytest

from sitegrove.extract.css import count_rules, extract_css, strip_dynamic
from sitegrove.extract.data import extract_cache_manifest, extract_manifest, extract_source_map, extract_srcset, extract_xml
from sitegrove.extract.html import LINKS, base_href, extract_html, is_fragment
from sitegrove.extract.javascript import extract_javascript
from sitegrove.extract.operator import extract, redirects, resolved, with_inline
from sitegrove.sources.loaders import assets_from_rows


def hrefs(edges):
    return [(e.type, e.href) for e in edges]


@pytest.mark.parametrize("rel", LINKS)
def test_links(rel):
    found = extract_html(f'<link rel="x {rel.upper()}" href="t">')
    assert [(e.type, e.href, e.target_type) for e in found] == [(LINKS[rel][0], "t", LINKS[rel][1])]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<a href=x><a>", [("HtmlAnchor", "x")]), ("<img src='a b'>", [("HtmlImage", "a b")]), ("<video src=v poster=p><source src=s></video>", [("HtmlVideo", "v"), ("HtmlVideoPoster", "p"), ("HtmlVideo", "s")]),
        ("<audio><source src=s><track src=t></audio><source src=z>", [("HtmlAudio", "s"), ("HtmlAudio", "t")]), ("<picture><source src=s></picture>", [("HtmlPictureSource", "s")]), ("<iframe src=i></iframe><frame src=f>", [("HtmlIFrame", "i"), ("HtmlFrame", "f")]),
        ("<object data=d><param name=Movie value=m></object>", [("HtmlObject", "d"), ("HtmlObject", "m")]), ("<applet archive=a codebase=c></applet>", [("HtmlApplet", "a"), ("HtmlApplet", "c")]), ("<embed src=e>", [("HtmlEmbed", "e")]),
        ("<meta http-equiv=refresh content='5; url=r '>", [("HtmlMetaRefresh", "r")]), ("<meta property=og:image content=o>", [("HtmlOpenGraph", "o")]), ("<meta name=msapplication-config content=c>", [("HtmlMsApplicationConfig", "c")]),
        ("<meta name=msapplication-TileImage content=t>", [("HtmlMsApplicationTileImageMeta", "t")]), ("<html manifest=m>", [("HtmlCacheManifest", "m")]), ("<esi:include src=e />", [("HtmlEdgeSideInclude", "e")]), ("<link rel=fluid-icon href=f>", [("HtmlFluidIconLink", "f")]),
        ("<script src=s></script><script type=module src=m></script><script type=x src=n></script>", [("HtmlScript", "s"), ("HtmlScript", "m")]), ("<link rel=stylesheet href=c media=print>", [("HtmlStyle", "c")]), ("<p title='<a href=q>'>&lt;a href=z&gt;", []),
    ],
)
def test_html_hrefs(html, expected):
    assert hrefs(extract_html(html)) == expected


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<style media=x>a{}</style>", ("HtmlStyle", "a{}", "Css")), ("<script>x('</p>')</script>", ("HtmlScript", "x('</p>')", "JavaScript")), ("<p style='color:red'>", ("HtmlStyleAttribute", "bogusselector {color:red}", "Css")),
        ("<b onclick='f()'>", ("HtmlInlineEventHandler", "function bogus() {f()}", "JavaScript")), ("<!--[if IE 6]><b>x</b><![endif]-->", ("HtmlConditionalComment", "<b>x</b>", "Html")), ("<!--esi <b>--> ", ("HtmlEdgeSideIncludeSafeComment", " <b>", "Html")),
        ("<!-- ko if: a -->", ("HtmlKnockoutContainerless", "({if: a});", "JavaScript")), ("<i data-bind='text: a'>", ("HtmlDataBindAttribute", "({text: a});", "JavaScript")), ("<i params='a: b'>", ("HtmlParamsAttribute", "({a: b});", "JavaScript")),
        ("<img srcset='a 1x'>", ("HtmlImageSrcSet", "a 1x", "SrcSet")), ("<picture><source srcset='b'></picture>", ("HtmlPictureSourceSrcSet", "b", "SrcSet")), ("<iframe srcdoc='<b>'>", ("HtmlIFrameSrcDoc", "<b>", "Html")),
        ("<noscript><img src=n></noscript>", ("HtmlNoscript", "<img src=n>", "Html")), ("<template><a href=x></template>", ("HtmlTemplate", "<a href=x>", "Html")), ("<svg><use href=u /></svg>", ("HtmlSvgIsland", "<svg><use href=u /></svg>", "Svg")),
        ("<script type='text/ng-template'><a></script>", ("HtmlInlineScriptTemplate", "<a>", "Html")),
    ],
)
def test_html_inline_assets(html, expected):
    assert [(e.type, e.inline_text, e.inline_type) for e in extract_html(html)] == [expected]


def test_html_facts():
    assert is_fragment("<p>") and not is_fragment("<!DOCTYPE html>") and base_href("<base><base href=/x/>") == "/x/"
    head, body = extract_html("<head><script src=a></script></head><body><p><b><script src=b></script>")
    assert (head.in_head, body.in_head, body.node_path) == (True, False, "/body/p/b/script")


def test_css():
    text = "@import 'a' print; @import url(b);\n@font-face{src:url(f.woff) format('woff'), url('g')}\na,b{background:url(x) , url(\"y\"); behavior:url(h.htc); -webkit-mask:url(m); src:url(no)} @media print{c::after{content:url(z)}} d{filter:alpha(src='i')} e{fill:url(#q)} /*# sourceURL=u */ /* url(no) */"
    assert hrefs(extract_css(text)) == [("CssImport", "a"), ("CssImport", "b"), ("CssFontFaceSrc", "f.woff"), ("CssFontFaceSrc", "g"), ("CssImage", "x"), ("CssImage", "y"), ("CssBehavior", "h.htc"), ("CssImage", "m"), ("CssImage", "z"), ("CssAlphaImageLoader", "i"), ("CssSourceUrl", "u")]
    assert count_rules(text) == 5
    assert strip_dynamic("a:hover > b::before, c:not(.d)") == "a > b, c:not(.d)"


def test_javascript():
    text = """/*# sourceURL=u */import a,{b} from './a';import 'bare';import "./c";export {x} from "../d";export const y = "./no";import('./e');import(`./no`);self.importScripts('f','g');
    new Worker("w");navigator.serviceWorker.register('s');CSS.paintWorklet.addModule('p');ctx.audioWorklet.addModule("q");'t.png'.toString('url');var r=/import "x"/;
    //# sourceMappingURL=m"""
    assert hrefs(extract_javascript(text)) == [("JavaScriptImport", "./a"), ("JavaScriptImport", "./c"), ("JavaScriptExport", "../d"), ("JavaScriptDynamicImport", "./e"), ("JavaScriptImportScripts", "f"), ("JavaScriptImportScripts", "g"), ("JavaScriptWebWorker", "w"), ("JavaScriptServiceWorkerRegistration", "s"), ("JavaScriptWorklet", "p"), ("JavaScriptWorklet", "q"), ("JavaScriptStaticUrl", "t.png"), ("JavaScriptSourceUrl", "u"), ("JavaScriptSourceMappingUrl", "m")]


def test_data():
    svg = "<?xml-stylesheet href='s'?><svg xmlns:xlink='x' onload='f()'><a xlink:href='a'/><use href='#u'/><image href='i'/><pattern href='p'/><font-face-uri href='f'/><script href='j'/><script>k</script><style>c{}</style><g style='d'/></svg>"
    assert [e.type for e in extract_xml(svg, "Svg")] == ["XmlStylesheet", "SvgInlineEventHandler", "SvgAnchor", "SvgUse", "SvgImage", "SvgPattern", "SvgFontFaceUri", "SvgScript", "SvgScript", "SvgStyle", "SvgStyleAttribute"]
    assert hrefs(extract_xml("<rss><channel><link>l</link><item><description>d</description></item></channel></rss>", "Rss")) == [("RssChannelLink", "l"), ("RssHtmlInlineFragment", None)]
    assert extract_xml("<feed><entry><content type='HTML'>&lt;b></content></entry></feed>", "Atom")[0].inline_text == "<b>"
    assert hrefs(extract_xml("<b><tile><TileImage src='t'/></tile><badge><polling-uri src='p'/></badge></b>", "MsApplicationConfig")) == [("MsApplicationConfigImage", "t"), ("MsApplicationConfigPollingUri", "p")]
    assert hrefs(extract_manifest('{"start_url":"s","icons":[{"src":"i"},1],"related_applications":[{"url":"r"}]}')) == [("ApplicationManifestUrl", "s"), ("ApplicationManifestUrl", "r"), ("ApplicationManifestUrl", "i")]
    assert hrefs(extract_source_map(')]}\'\n{"file":"f","sources":["a","webpack:x","<anon>"]}')) == [("SourceMapFile", "f"), ("SourceMapSource", "a")]
    assert hrefs(extract_cache_manifest("CACHE MANIFEST\na\nFALLBACK:\nb c\nNETWORK:\n*\n# x\nCACHE:\nd")) == [("CacheManifestEntry", "a"), ("CacheManifestEntry", "d"), ("CacheManifestEntry", "c")]
    assert [(e.href, e.props["extraTokens"]) for e in extract_srcset("a 1x, b,c 2x")] == [("a", "1x"), ("b,c", "2x")]
    assert extract_manifest("[") == [] and extract_xml("<a", "Svg") == [] and extract_srcset("") == []


def test_operator(spark):
    assets = assets_from_rows(spark, [{"id": "p", "type": "Html", "url": "http://h/p", "text": "<a href='q#x'></a><style>b{background:url(i.png)}</style><a href='#top'>"}, {"id": "q", "type": "Html", "url": "http://h/q", "text": None, "status_code": 301, "location": "/p"}, {"id": "n", "type": None, "text": "<a href=x>"}])
    assert extract(assets.limit(0)).count() == 0
    relations, inline = with_inline(assets)
    assert [(r.id, r.type, r.owner_id) for r in inline.collect()] == [("p/1", "Css", "p")]
    got = sorted((r.from_id, r.type, r.href or "", r.to_id or "") for r in resolved(relations, assets).collect())
    assert got == [("p", "HtmlAnchor", "#top", "p"), ("p", "HtmlAnchor", "q#x", "q"), ("p", "HtmlStyle", "", "p/1"), ("p/1", "CssImage", "i.png", "")]
    assert [(r.type, r.href) for r in redirects(assets).collect()] == [("HttpRedirect", "/p")]
