import pytest

from sitegrove.functions.urls import resolve_in_root
from sitegrove.operators.facts import asset_facts, dirty


def test_facts(spark):
    rows = spark.createDataFrame([("a", "JavaScript", "http://h/x/a.js", "/* c */ 'use strict';x"), ("b", "Css", None, " /* x */ ;"), ("c", "Png", "http://h:8/i@2x.png?a=b", None), ("d", "Html", None, "<p>"), ("e", "Json", None, "{\n  1"), ("f", "Svg", None, "<?xml version='1.0'?><svg/>"), ("g", None, None, None)], "id string, type string, url string, text string")
    got = {r.id: r for r in asset_facts(rows).collect()}
    assert got["a"].is_strict and not got["a"].is_empty and got["a"].path == "/x/" and got["a"].description == "[JavaScript/a http://h/x/a.js]"
    assert got["b"].is_empty and got["b"].is_inline and got["b"].is_strict is None
    assert got["c"].is_image and got["c"].device_pixel_ratio == 2.0 and got["c"].port == 8 and got["c"].query == {"a": "b"}
    assert got["d"].is_fragment and got["e"].is_pretty and got["f"].xml_declaration == "<?xml version='1.0'?>" and got["f"].is_image and got["f"].is_text
    assert got["g"].is_text is False and got["g"].is_fragment is None
    owners = spark.createDataFrame([("b", "a"), ("a", "a")], "id string, owner_id string")
    assert sorted(r.id for r in dirty(rows, rows.where("id = 'b'"), owners).where("is_dirty").collect()) == ["a", "b"]


@pytest.mark.parametrize(
    ("href", "base", "canonical", "expected"),
    [("/a/b", "file:///r/x/p.html", None, "file:///r/a/b"), ("c", "file:///r/x/p.html", None, "file:///r/x/c"), ("/s/a", "file:///r/p", "http://h/s/", "file:///r/a"), ("http://h/s/a", "file:///r/p", "http://h/s/", "file:///r/a"), ("//h/a", "http://x/", "//h/", "file:///r/a"), ("http://o/a", "file:///r/p", "http://h/", "http://o/a")],
)
def test_resolution_in_a_root(href, base, canonical, expected):
    assert resolve_in_root(href, base, "file:///r/", canonical) == expected
