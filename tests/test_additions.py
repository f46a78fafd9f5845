from pyspark.sql import functions as F

from sitegrove.extract.operator import extract, resolved
from sitegrove.functions import text as X
from sitegrove.functions import urls as U
from sitegrove.graph import Graph
from sitegrove.operators import transforms as T
from sitegrove.operators.aggregate import content_type_conflicts
from sitegrove.operators.facts import request_destinations
from sitegrove.operators.traverse import populate
from sitegrove.session import cut
from sitegrove.sources.loaders import assets_from_rows

EDGES = "id string, type string, from_id string, to_id string, ord int, href string, target_type string, media string, in_head boolean, node_attrs map<string,string>"


def test_suffixes_in_use_are_passed_over(spark):
    urls = {"a": "http://h/x.css", "b": "http://h/y.css", "c": "http://h/z.css", "d": "http://h/x-1.css", "e": None}
    graph = Graph(assets_from_rows(spark, [{"id": i, "type": "Css", "url": u} for i, u in urls.items()]), spark.createDataFrame([], EDGES), root="http://h/")
    wanted = spark.createDataFrame([("b", "http://h/x.css"), ("c", "http://h/x.css"), ("nobody", "http://h/q")], "id string, new_url string")
    got = {r.id: r.url for r in T.move_assets(graph, wanted).assets.collect()}
    assert got["b"] == "http://h/x.css" and got["d"] == "http://h/x-1.css" and got["e"] is None
    assert sorted([got["a"], got["c"]]) == ["http://h/x-2.css", "http://h/x-3.css"]


def test_relations_without_a_source_stay(spark):
    graph = Graph(assets_from_rows(spark, [{"id": "a", "type": "Css"}, {"id": "b", "type": "Css"}]), spark.createDataFrame([("r", "CssImport", None, "a", 0, "x", None, None, None, None), ("s", "CssImport", "a", "b", 0, "x", None, None, None, None)], EDGES))
    assert [(r.id, r.to_id) for r in T.replace_asset(graph, "a", "b").relations.collect()] == [("r", "b")]


def test_query_parameters(spark):
    urls = ["http://h/a?v=1&w=x%20y#f", "http://h/a?w&&v=2&v=3", "http://h/a", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(U.with_query_parameter(F.col("u"), "v", F.lit("9*")).alias("set"), U.without_query_parameter(F.col("u"), "v").alias("cut")).collect()
    assert [r.set for r in rows] == ["http://h/a?v=9%2A&w=x%20y#f", "http://h/a?w=&v=9%2A", "http://h/a?v=9%2A", None]
    assert [r["cut"] for r in rows] == ["http://h/a?w=x%20y#f", "http://h/a?w=", "http://h/a", None]


def test_unknown_prefixes_of_svg(spark):
    frame = spark.createDataFrame([('<svg><g sketch:type="x" xml:space="y"/></svg>',), ('<svg xmlns="u" xmlns:a="v"><a:b/></svg>',)], "t string")
    got = [r[0] for r in frame.select(X.with_svg_namespaces(F.col("t"))).collect()]
    assert got == ['<svg xmlns="http://www.w3.org/2000/svg" xmlns:sketch="urn:added"><g sketch:type="x" xml:space="y"/></svg>', '<svg xmlns="u" xmlns:a="v"><a:b/></svg>']
    assert frame.select(X.without_added_namespaces(X.with_svg_namespaces(F.col("t"))).alias("t")).collect()[0].t == '<svg xmlns="http://www.w3.org/2000/svg"><g sketch:type="x" xml:space="y"/></svg>'


def test_destinations_and_content_types(spark):
    assets = assets_from_rows(spark, [{"id": "p", "type": "Html", "content_type": "Text/Plain; charset=x"}, {"id": "f", "type": "Asset", "url": "http://h/f.bin"}, {"id": "g", "type": "Asset", "url": "http://h/g.woff2?x"}, {"id": "s", "type": "Css", "content_type": "image/png"}, {"id": "n", "type": None, "content_type": None}])
    edges = [("1", "HtmlPreloadLink", "p", "f", 0), ("2", "CssFontFaceSrc", "s", "f", 1), ("3", "HtmlPrefetchLink", "p", "g", 2), ("4", "HtmlPrefetchLink", "p", "s", 3), ("5", "HtmlPrefetchLink", "p", None, 4), ("6", "HtmlAnchor", "s", "p", 0)]
    relations = spark.createDataFrame([(*e, "x", "Html" if e[3] == "p" else None, None, None, None) for e in edges], EDGES)
    assert {r.id: r.destination for r in request_destinations(assets, relations).collect()} == {"1": "font", "3": "font", "4": "style", "5": None}
    assert sorted((r.asset_id, r.message.split("of ")[1]) for r in content_type_conflicts(assets, relations).collect()) == [("p", "text/plain, but used as Html"), ("s", "image/png, but used as Css")]
    assert content_type_conflicts(assets.limit(0), relations.limit(0)).count() == 0 == request_destinations(assets.limit(0), relations.limit(0)).count()


def test_checkpoints_go_where_the_session_says(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert cut(spark.range(3)).count() == 3 and folder


def test_crawl_of_deep_links_and_without_starts(spark):
    pages = [{"id": f"p{i}", "type": "Html", "url": f"http://h/{i}", "text": f'<a href="/{i + 1}">x</a>'} for i in range(6)]
    web = assets_from_rows(spark, pages).select("id", "type", "url", "text")
    bases = web.select("id", "url")
    for starts, found, missing in ((["http://h/0"], {f"p{i}" for i in range(6)}, ["cannot load http://h/6"]), ([], set(), [])):
        frame = spark.createDataFrame([(u,) for u in starts], "url string")
        loaded, relations, notes = populate(web, frame, lambda df: resolved(extract(df), bases))
        assert {r.id for r in loaded.collect()} == found and relations.count() == len(found) and [r.message for r in notes.collect()] == missing
