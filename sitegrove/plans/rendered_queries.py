"""Every type of relation, written in its own syntax around the hrefs of the relations table and extracted again.

Each holding relation is rendered as one small text, by the number in its id as one type after the other. What the
extractor returns must be the href again, or, for relations to inline assets, the text around it; SQL needs no parser to
say what that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.extract.operator import extract, redirects
from sitegrove.plans.tables_graph import HOLD, narrow_graph

#: relation, asset type, text, and what is extracted. {r} is the url, {m} the url as markup writes it.
FORMS = (
    ("HtmlAlternateLink", "Html", '<link rel="alternate" href="{m}">', "{r}"), ("HtmlAnchor", "Html", '<p><a class=x href="{m}">x</a>', "{r}"), ("HtmlAppleTouchStartupImage", "Html", '<link rel="apple-touch-startup-image" href="{m}">', "{r}"),
    ("HtmlApplet", "Html", '<applet archive="{m}"></applet>', "{r}"), ("HtmlApplicationManifest", "Html", "<link rel=manifest href='{m}'>", "{r}"), ("HtmlAudio", "Html", '<audio src="{m}"></audio>', "{r}"), ("HtmlAuthorLink", "Html", '<link rel="author" href="{m}">', "{r}"),
    ("HtmlCacheManifest", "Html", '<html manifest="{m}"><body></body></html>', "{r}"), ("HtmlConditionalComment", "Html", '<!--[if IE]><a href="{m}">x</a><![endif]-->', '<a href="{m}">x</a>'), ("HtmlDataBindAttribute", "Html", "<b data-bind=\"text: '{m}'\">x</b>", "({text: '{r}'});"),
    ("HtmlDnsPrefetchLink", "Html", '<link rel="dns-prefetch" href="{m}">', "{r}"), ("HtmlEdgeSideInclude", "Html", '<esi:include src="{m}">', "{r}"), ("HtmlEdgeSideIncludeSafeComment", "Html", '<!--esi<img src="{m}">-->', '<img src="{m}">'), ("HtmlEmbed", "Html", '<embed src="{m}">', "{r}"),
    ("HtmlFluidIconLink", "Html", '<link rel="fluid-icon" href="{m}">', "{r}"), ("HtmlFrame", "Html", '<frameset><frame src="{m}"></frameset>', "{r}"), ("HtmlIFrame", "Html", '<iframe src="{m}"></iframe>', "{r}"), ("HtmlIFrameSrcDoc", "Html", "<iframe srcdoc=\"<a href='{m}'>x</a>\"></iframe>", "<a href='{r}'>x</a>"),
    ("HtmlImage", "Html", '<IMG alt="" SRC="{m}">', "{r}"), ("HtmlImageSrcSet", "Html", '<img srcset="{m} 2x">', "{r} 2x"), ("HtmlImport", "Html", '<link rel="import" href="{m}">', "{r}"), ("HtmlInlineEventHandler", "Html", "<b onclick=\"go('{m}')\">x</b>", "function bogus() {go('{r}')}"),
    ("HtmlInlineScriptTemplate", "Html", '<script type="text/html"><a href="{m}">x</a></script>', '<a href="{m}">x</a>'), ("HtmlKnockoutContainerless", "Html", "<!-- ko with: '{r}' --><!-- /ko -->", "({with: '{r}'});"), ("HtmlLogo", "Html", '<link rel="logo" href="{m}">', "{r}"),
    ("HtmlMetaRefresh", "Html", '<meta http-equiv="refresh" content="5; url={m}">', "{r}"), ("HtmlMsApplicationConfig", "Html", '<meta name="msapplication-config" content="{m}">', "{r}"), ("HtmlMsApplicationTileImageMeta", "Html", '<meta name="msapplication-TileImage" content="{m}">', "{r}"),
    ("HtmlNoscript", "Html", '<noscript><img src="{m}"></noscript>', '<img src="{m}">'), ("HtmlObject", "Html", '<object data="{m}"></object>', "{r}"), ("HtmlOpenGraph", "Html", '<meta property="og:image" content="{m}">', "{r}"), ("HtmlParamsAttribute", "Html", "<b params=\"text: '{m}'\">x</b>", "({text: '{r}'});"),
    ("HtmlPictureSource", "Html", '<picture><source src="{m}"></picture>', "{r}"), ("HtmlPictureSourceSrcSet", "Html", '<picture><source srcset="{m} 2x"></picture>', "{r} 2x"), ("HtmlPreconnectLink", "Html", '<link rel="preconnect" href="{m}">', "{r}"), ("HtmlPrefetchLink", "Html", '<link rel="prefetch" href="{m}">', "{r}"),
    ("HtmlPreloadLink", "Html", '<link rel="preload" as="font" href="{m}">', "{r}"), ("HtmlPrerenderLink", "Html", '<link rel="prerender" href="{m}">', "{r}"), ("HtmlScript", "Html", '<script src="{m}"></script>', "{r}"), ("HtmlSearchLink", "Html", '<link rel="search" href="{m}">', "{r}"),
    ("HtmlServiceWorkerRegistration", "Html", '<link rel="serviceworker" href="{m}">', "{r}"), ("HtmlShortcutIcon", "Html", '<link rel="shortcut icon" href="{m}">', "{r}"), ("HtmlStyle", "Html", '<link rel="stylesheet" href="{m}">', "{r}"), ("HtmlStyleAttribute", "Html", '<b style="background: url({m})">x</b>', "bogusselector {background: url({r})}"),
    ("HtmlSvgIsland", "Html", '<svg><use href="{m}"/></svg>', '<svg><use href="{m}"/></svg>'), ("HtmlTemplate", "Html", '<template><img src="{m}"></template>', '<img src="{m}">'), ("HtmlVideo", "Html", '<video><source src="{m}"></video>', "{r}"), ("HtmlVideoPoster", "Html", '<video poster="{m}"></video>', "{r}"),
    ("CssAlphaImageLoader", "Css", "a{filter:progid:DXImageTransform.Microsoft.AlphaImageLoader(src='{r}')}", "{r}"), ("CssBehavior", "Css", 'a{behavior:url("{r}")}', "{r}"), ("CssFontFaceSrc", "Css", "@font-face{font-family:x;src:url('{r}') format('woff2')}", "{r}"), ("CssImage", "Css", "/* x */ a { background : #fff url( {r} ) }", "{r}"),
    ("CssImport", "Css", '@import url("{r}") screen;', "{r}"), ("CssSourceMappingUrl", "Css", "a{b:c}\n/*# sourceMappingURL={r} */", "{r}"), ("CssSourceUrl", "Css", "a{b:c}\n/*# sourceURL={r} */", "{r}"),
    ("JavaScriptDynamicImport", "JavaScript", 'f(async () => await import("{r}"))', "{r}"), ("JavaScriptExport", "JavaScript", 'export * from "{r}";', "{r}"), ("JavaScriptImport", "JavaScript", "import a, {b as c} from '{r}'", "{r}"), ("JavaScriptImportScripts", "JavaScript", "importScripts('{r}');", "{r}"),
    ("JavaScriptServiceWorkerRegistration", "JavaScript", "navigator.serviceWorker.register('{r}', {scope: '/'});", "{r}"), ("JavaScriptSourceMappingUrl", "JavaScript", "a();\n//# sourceMappingURL={r}\n", "{r}"), ("JavaScriptSourceUrl", "JavaScript", "a();\n//# sourceURL={r}\n", "{r}"), ("JavaScriptStaticUrl", "JavaScript", "var a = '{r}'.toString('url');", "{r}"),
    ("JavaScriptWebWorker", "JavaScript", "new Worker('{r}');", "{r}"), ("JavaScriptWorklet", "JavaScript", "CSS.paintWorklet.addModule('{r}');", "{r}"),
    ("ApplicationManifestUrl", "ApplicationManifest", '{"start_url": "{r}"}', "{r}"), ("CacheManifestEntry", "CacheManifest", "CACHE MANIFEST\n# x\n{r}\nNETWORK:\n*\n", "{r}"), ("SourceMapFile", "SourceMap", '{"version": 3, "file": "{r}", "sources": [], "mappings": ""}', "{r}"), ("SourceMapSource", "SourceMap", '{"version": 3, "sources": ["{r}"], "mappings": ""}', "{r}"),
    ("SrcSetEntry", "SrcSet", "{r} 2x", "{r}"), ("RssChannelLink", "Rss", "<rss><channel><link>{m}</link></channel></rss>", "{r}"), ("RssHtmlInlineFragment", "Rss", "<rss><channel><item><description>x {m}</description></item></channel></rss>", "x {r}"), ("AtomHtmlInlineFragment", "Atom", '<feed><entry><content type="html">x {m}</content></entry></feed>', "x {r}"),
    ("XmlStylesheet", "Svg", '<?xml-stylesheet href="{r}"?><svg></svg>', "{r}"), ("MsApplicationConfigImage", "MsApplicationConfig", '<browserconfig><msapplication><tile><square70x70logo src="{m}"/></tile></msapplication></browserconfig>', "{r}"), ("MsApplicationConfigPollingUri", "MsApplicationConfig", '<browserconfig><msapplication><badge><polling-uri src="{m}"/></badge></msapplication></browserconfig>', "{r}"),
    ("SvgAnchor", "Svg", '<svg><a xlink:href="{m}"><g/></a></svg>', "{r}"), ("SvgFontFaceUri", "Svg", '<svg><font-face-src><font-face-uri xlink:href="{m}"/></font-face-src></svg>', "{r}"), ("SvgImage", "Svg", '<svg><image href="{m}"/></svg>', "{r}"), ("SvgInlineEventHandler", "Svg", "<svg><g onclick=\"go('{m}')\"/></svg>", "function bogus() {go('{r}')}"),
    ("SvgPattern", "Svg", '<svg><pattern xlink:href="{m}"/></svg>', "{r}"), ("SvgScript", "Svg", '<svg><script xlink:href="{m}"/></svg>', "{r}"), ("SvgStyle", "Svg", "<svg><style>a{b:url({m})}</style></svg>", "a{b:url({r})}"), ("SvgStyleAttribute", "Svg", '<svg><g style="fill: url({m})"/></svg>', "bogusselector {fill: url({r})}"), ("SvgUse", "Svg", '<svg><use xlink:href="{m}"/></svg>', "{r}"),
)


def _filled(form: Column, url: Column) -> Column:
    return F.replace(F.replace(form, F.lit("{m}"), F.replace(url, F.lit("&"), F.lit("&amp;"))), F.lit("{r}"), url)


def rendered_relations(spark: SparkSession, sf: str) -> DataFrame:
    """(id, type, value): what is extracted from each relation's rendering, of the type it was rendered as."""
    url = F.concat(F.lit("https://w.example/"), F.regexp_replace(F.coalesce("href", F.lit("")), "[^A-Za-z0-9/._-]", "-"), F.lit("?a=1&i="), F.col("id"))
    number = (F.coalesce(F.expr("try_cast(substr(id, 2) as bigint)"), F.lit(0)) % len(FORMS) + 1).cast("int")
    form = F.element_at(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(a).alias("asset"), F.lit(x).alias("text")) for t, a, x, _ in FORMS]), number)
    rows = narrow_graph(spark, sf).relations.select("id", url.alias("url"), form.alias("form"))
    texts = rows.select(F.concat_ws("|", "id", "form.type").alias("id"), F.col("form.asset").alias("type"), _filled(F.col("form.text"), F.col("url")).alias("text"))
    id_, wanted = F.substring_index("from_id", "|", 1), F.substring_index("from_id", "|", -1)
    return extract(texts).where(F.col("type") == wanted).select(id_.alias("id"), "type", F.coalesce("href", "inline_text").alias("value"))


def redirected(spark: SparkSession, sf: str) -> DataFrame:
    """The redirects that the assets' responses and folders are."""
    return redirects(narrow_graph(spark, sf, "location").assets).select("from_id", "type", "href")


QUERIES = {"rendered_relations": rendered_relations, "redirected": redirected}
_VALUES = ", ".join("({}, '{}', '{}')".format(i, t, want.replace("'", "''")) for i, (t, _, _, want) in enumerate(FORMS))
SQL = {
    "rendered_relations": f"""{HOLD}, f AS (SELECT * FROM (VALUES {_VALUES}) AS t (k, type, want)), x AS (SELECT id, coalesce(try_cast(substr(id, 2) AS BIGINT), 0) % {len(FORMS)} AS k, 'https://w.example/' || regexp_replace(coalesce(href, ''), '[^A-Za-z0-9/._-]', '-', 'g') || '?a=1&i=' || id AS url FROM r)
SELECT x.id, f.type, replace(replace(f.want, '{{m}}', replace(x.url, '&', '&amp;')), '{{r}}', x.url) AS value FROM x JOIN f USING (k)""",
    "redirected": f"""{HOLD} SELECT id AS from_id, 'HttpRedirect' AS type, location AS href FROM a WHERE status_code IN (301, 302, 303, 307, 308) AND location IS NOT NULL UNION ALL SELECT id, 'FileRedirect', url || 'index.html' FROM a WHERE regexp_matches(url, '(?i)^file:.*/$')""",
}
