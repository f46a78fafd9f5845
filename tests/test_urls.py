import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitegrove.functions import urls as U

BASE = "http://a/b/c/d;p?q"
# RFC 3986, 5.4: normal and abnormal examples
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
}


@pytest.mark.parametrize("href", RFC)
def test_resolution_follows_the_rfc(href):
    assert U.resolve(href, BASE) == RFC[href]


@pytest.mark.parametrize("base", ["https://h.example/x/y.html?a#b", "http://h.example", "https://h.example/a/b/"])
@pytest.mark.parametrize("href", ["a.png", "../a", "/z?q=1", "//o.example/p", "?x", "a/../../b"])
def test_resolution_agrees_with_the_standard_library(base, href):
    assert U.resolve(href, base) == urljoin(base, href)


@pytest.mark.parametrize(
    ("url", "identity", "host"),
    [
        ("HTTP://A.Example:80/B%20c?d=%2B#e", "http://a.example/B c?d=+", "a.example"),
        ("https://u:p@h:443/x", "https://u:p@h/x", "h"),
        ("https://h:8443/x", "https://h:8443/x", "h"),
        ("https://h:/x", "https://h/x", "h"),
        ("http://h/%ff", "http://h/%FF", "h"),
        ("mailto:a@b", None, None),
        (None, None, None),
    ],
)
def test_web_identity(url, identity, host):
    assert U.web_identity(url) == (identity, host)


def test_parts(spark):
    u = F.col("u")
    rows = spark.createDataFrame([("https://u:p@h.example:8080/a/b.min.js?x=1&y=a%20b&x=2#f",), ("/rel/x",), (None,)], "u string")
    got = rows.select(U.protocol(u), U.hostname(u), U.port(u), U.username(u), U.password(u), U.file_name(u), U.extension(u), U.base_name(u), U.directory(u), U.query_map(u), U.fragment(u)).collect()
    assert tuple(got[0]) == ("https:", "h.example", 8080, "u", "p", "b.min.js", ".js", "b.min", "/a/", {"x": "2", "y": "a b"}, "#f")
    assert got[1][0] is None and got[1][4] is None
    assert all(v is None for v in got[2])


def test_href_types_and_crossorigin(spark):
    rows = spark.createDataFrame([("//a",), ("/a",), ("data:x",), ("http:a",), (" a",), (None,)], "h string")
    assert [r[0] for r in rows.select(U.href_type(F.col("h"))).collect()] == ["protocolRelative", "rootRelative", "inline", "absolute", "relative", "inline"]
    pairs = spark.createDataFrame([("http://a/x", "http://A:80/y"), ("http://a/", "https://a/"), ("http://a/", "http://a:81/"), (None, "http://a/")], "f string, t string")
    assert [r[0] for r in pairs.select(U.crossorigin(F.col("f"), F.col("t"))).collect()] == [False, True, True, False]


@pytest.mark.parametrize(
    ("to", "base", "kind", "href"),
    [
        ("http://a/b/c.png", "http://a/b/d/e.html", "relative", "../c.png"), ("http://a/b/c.png", "http://a/x.html", "rootRelative", "/b/c.png"), ("http://a/b", "http://a/x", "protocolRelative", "//a/b"),
        ("http://b/c", "http://a/x", "relative", "http://b/c"), ("http://a/b", "http://c/", "absolute", "http://a/b"),
    ],
)
def test_built_hrefs_resolve_back(to, base, kind, href):
    assert U.build(to, base, kind) == href
    assert U.resolve(href, base) == to


def test_encoding_and_fragments(spark):
    row = spark.createDataFrame([("/für a%20",)], "u string").select(U.percent_encoded(F.col("u")), U.with_fragment(F.lit("a#b"), F.lit("#c")), U.with_fragment(F.lit("a"), F.lit("c"))).first()
    assert tuple(row) == ("/f%C3%BCr%20a%20", "a#c", None)


def test_native_identity_agrees_with_parsing(spark):
    rng = random.Random(4)
    bits = ["http:", "https:", "HTTP:", "mailto:", "//", "/", "h.example", "H.example", "u@h", ":80", ":81", "a", "é", "b.c", ".", "..", "%41", "%ff", "?", "#", "?x=/../y", " ", ":", ";", "\n"]
    bases = ["https://h.example/x/y.html?a#b", "http://h.example", "http://H.example/", "https://h.example/a/../b/", "https://h.example/a%41/b", "https://h.example:8/a/", "https://h.example/q?/z/", "/relative", "", None, " https://h.example/a/b "]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))), rng.choice(bases)) for _ in range(4000)] + [(h, BASE) for h in RFC] + [(None, BASE), ("https://h.example/a/b", None)]
    df = spark.createDataFrame(rows, "href string, base string")
    out = df.select("href", "base", U.identity(F.col("href"), F.col("base")).alias("x"), U.resolved_identity("href", "base").alias("y"))
    assert out.where(~F.col("x").eqNullSafe(F.col("y"))).limit(5).collect() == []
