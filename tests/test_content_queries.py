import hashlib
import itertools
import re
from html.parser import HTMLParser

import pytest
from conftest import day
from pyspark.sql import functions as F
from test_graph import graph

from sitegrove.plans import content_queries as C

PAGES = {
    "plain": "<html><body><a href=a>x</a><img src=b><link rel=stylesheet href=c><script src=d></script></body></html>",
    "cut off": "<html><body><a href=e>x</a><p>no end",
    "comment": "<html><body><!-- <a href=no> --><a href=f>x</a></body></html>",
    "svg": "<html><body><svg><image href=no /></svg><img src=g></body></html>",
    "noscript": "<html><body><noscript><img src=h><noscript></noscript></noscript><a href=i>x</a></body></html>",
    "template": "<html><body><template><a href=j>x</a><template><img src=k><template><template><template><a href=l>x</a></template></template></template></template></template></body></html>",
    "marks": "<html><body><<<<<<< HEAD\n<a href=m>x</a>\n=======\n<a href=n>x</a>\n>>>>>>> b</body></html>",
}
SHEETS = {
    "plain": "a{background:url(a.png)}",
    "comment": "/* b{background:url(no.png)} */b{background:url(b.png)}",
    "content": "c:before{content:'url(s.png)'}d{background-image:url('c.png')}",
    "font": "@font-face{font-family:x;src:url(d.woff2)}/* end */",
}


class _Hrefs(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.found = set()
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        type_, name = {"a": ("HtmlAnchor", "href"), "img": ("HtmlImage", "src"), "link": ("HtmlStyle", "href"), "script": ("HtmlScript", "src")}.get(tag, (None, None))
        if dict(attrs).get(name):
            self.found.add((type_, dict(attrs)[name]))


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows (id, type, text, raw_src, encoding) as the assets of a folder of tables."""
    numbers = itertools.count()

    def write(rows, relations=()):
        path = f"{tmp_path}/{next(numbers)}"
        g = graph(spark, [{"id": i, "type": t} for i, t, *_ in rows], list(relations))
        assets = spark.createDataFrame([(*r, day(n)) for n, r in enumerate(rows)], "id string, type string, text string, raw_src binary, encoding string, ingested_at timestamp")
        missing = "site_id long, status_code int, file_name string, extension string, added_at timestamp, removed_at timestamp"
        own = g.assets.drop("type", "text", "raw_src", "props").selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (m.split() for m in missing.split(", "))])
        assets.join(own, "id").write.parquet(f"{path}/assets.parquet")
        g.relations.selectExpr("*", "0L as site_id", "'http://h/' as base_url", "timestamp'2024-01-01' as seen_at", "timestamp'2024-01-01' as ingested_at").drop("in_head", "node_attrs").write.parquet(f"{path}/relations.parquet")
        return path

    return write


def test_hrefs_and_urls_of_all_texts(spark, folder):
    sf = folder([(i, "Html", t, None, None) for i, t in PAGES.items()] + [(f"sheet {i}", "Css", t, None, None) for i, t in SHEETS.items()])
    assert {tuple(r) for r in C.extracted_hrefs_all(spark, sf).collect()} == {(i, *e) for i, page in PAGES.items() for e in _Hrefs(page).found}
    bare = {i: re.sub(r"(?s)/\*.*?\*/", "", t) for i, t in SHEETS.items()}  # urls in strings count, as in the reference's token pattern
    assert {tuple(r) for r in C.css_urls_all(spark, sf).collect()} == {(f"sheet {i}", u) for i, t in bare.items() for u in re.findall(r"url\('?([^')]*)", t)}


def test_styles_and_srcsets_over_the_tables(spark, folder):
    page = "<html><head></head><body><p class=x>a</p><link rel=stylesheet href=s><i>b</i><noscript><img srcset='a.png 1x, b.png 2x'></noscript></body></html>"
    sheet = "p{color:red}.x{margin:0}i{top:0}"
    rows = [("p", "Html", page, None, None), ("q", "Html", None, page.encode(), None), ("s", "Css", sheet, None, None), ("t", "Css", None, sheet.encode("utf-16"), "utf-16"), ("u", "Html", "<p>", None, None), ("z", "SrcSet", "c.png", None, None)]
    sf = folder(rows, [{"from_id": "p", "to_id": "t", "type": "HtmlStyle"}, {"from_id": "q", "to_id": "s", "type": "HtmlStyle"}])

    def digest(text):
        return len(text), hashlib.md5(text.encode()).hexdigest()

    critical = page.replace("</head>", "<style>p{color:red}.x{margin:0}</style></head>")
    inlined = page.replace("class=x", 'class=x style="color: red; margin: 0"').replace("<i>", '<i style="top: 0">')
    for query, expected in ((C.critical_css, critical), (C.inline_styles, inlined)):
        assert {r.id: (r.chars, r.digest) for r in query(spark, sf).collect()} == {"p": digest(expected), "q": digest(expected), "u": digest("<p>")}
    entries = [("a.png", "1x"), ("b.png", "2x")]
    found = C.srcsets(spark, sf).collect()
    assert sorted((r.id.split("/")[0], r.url, r.descriptors) for r in found) == [*[("p", *e) for e in entries], *[("q", *e) for e in entries], ("z", "c.png", "")]


def test_contents_that_are_not_decoded(spark, folder):
    texts = {"p": ("Html", "<html><body><a href=q>é</a><a href=v>x</a><a href=d>x</a></body></html>"), "q": ("Html", "<p>ü"), "s": ("Css", "a,b{background:url(p)}"), "j": ("JavaScript", "'use strict';import 'p'"), "v": ("Svg", "<svg><image href='p'/></svg>"), "d": ("Atom", "<feed><link href='q'/></feed>")}
    given = [(i, kind, text, None, None) for i, (kind, text) in texts.items()]
    raw = [(i, kind, None, text.encode("utf-16"), "utf-16") for i, (kind, text) in texts.items()]
    queries = (C.extracted_relations, C.resolved_targets, C.selector_counts, C.extracted_hrefs_all, C.css_urls_all, C.facts_all)
    results = []
    for rows in (given, raw):
        sf = folder(rows)
        results.append([{tuple(r) for r in q(spark, sf).collect()} for q in queries])
        table = spark.read.parquet(f"{sf}/assets.parquet").withColumn("is_initial", F.col("id") == "p")
        table.write.parquet(f"{sf}/initial/assets.parquet")
        results[-1].append({tuple(r) for r in C.crawl(spark, f"{sf}/initial").collect()})
    assert results[0] == results[1] and all(results[0])
    assert {t for t, *_ in results[0][1]} >= {"SvgImage", "HtmlAnchor", "CssImage"} and ("j", "JavaScript") not in results[0][-1]
