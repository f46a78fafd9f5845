import io
import random

import pytest
from pyspark.sql import functions as F

from sitegrove import sinks
from sitegrove.extract.operator import extract, resolved
from sitegrove.graph import Graph, GraphWarning
from sitegrove.operators import aggregate, traverse
from sitegrove.operators import transforms as T
from sitegrove.plans.pipeline import Pipeline, PipelineError
from sitegrove.schema import inferred_type
from sitegrove.sources.loaders import assets_from_files, assets_from_responses, inline_targets, parse_data_url

A = "id string, seq long, type string, url string, is_loaded boolean, is_initial boolean, is_redirect boolean, md5_hex string, last_known_byte_length long, text string, raw_src binary, content_type string, props map<string,string>"
R = "id string, type string, from_id string, to_id string, ord int, href string, target_type string, media string, in_head boolean, node_attrs map<string,string>"


def graph(spark, assets, relations, root="http://h/"):
    names, edge_names = [f.split()[0] for f in A.split(", ")], [f.split()[0] for f in R.split(", ")]
    rows = [tuple(({"seq": i, "is_loaded": True, "url": f"http://h/{a['id']}"} | a).get(n) for n in names) for i, a in enumerate(assets)]
    edges = [tuple(({"id": f"r{i}", "ord": i, "type": "HtmlAnchor"} | e).get(n) for n in edge_names) for i, e in enumerate(relations)]
    return Graph(spark.createDataFrame(rows, A), spark.createDataFrame(edges, R), root)


def edges(*pairs, type="HtmlAnchor"):
    return [{"from_id": a, "to_id": b, "type": type} for a, b in pairs]


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_random_reachability_and_order(spark):
    rng = random.Random(3)
    nodes = [str(i) for i in range(25)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)]
    g = graph(spark, [{"id": n} for n in nodes], edges(*pairs))
    start = g.assets.where("id in ('0', '1')").select("id")

    def dfs(s, post):
        out, seen = [], set()

        def visit(n):
            if n in seen:
                return
            seen.add(n)
            if not post:
                out.append(n)
            for a, b in pairs:
                if a == n:
                    visit(b)
            if post:
                out.append(n)

        visit(s)
        return out

    for post in (False, True):
        rows = traverse.collect_assets(g.relations, g.assets, start, post=post).orderBy("start", "visit_seq").collect()
        for s in ("0", "1"):
            assert [r.id for r in rows if r.start == s] == dfs(s, post)
    assert {(r.start, r.id) for r in traverse.reachable(g.relations, start).collect()} == {(s, n) for s in ("0", "1") for n in dfs(s, False)}
    assert set(ids(traverse.reached_set(g.relations, start))) == set(dfs("0", False)) | set(dfs("1", False))


def test_unreferenced_keeps_cycles(spark):
    g = graph(spark, [{"id": x} for x in "abcdef"], edges(("a", "b"), ("b", "c"), ("d", "e"), ("e", "d")))
    assert ids(traverse.unreferenced(g.assets, g.relations)) == ["a", "b", "c", "f"]
    assert ids(T.remove_unreferenced_assets(g, {"id": {"$ne": "a"}}).assets) == ["a", "b", "c", "d", "e"]


def test_merge_and_styles(spark):
    g = graph(spark, [{"id": "p", "type": "Html"}, {"id": "x", "type": "Png", "md5_hex": "1"}, {"id": "y", "type": "Png", "md5_hex": "1"}, {"id": "z", "type": "Css", "md5_hex": "1"}, {"id": "n", "type": "Png"}], [*edges(("p", "y"), ("p", "x")), *edges(("p", "z"), ("p", "z"), type="HtmlStyle"), *edges(("p", "x"), ("p", "y"), type="CacheManifestEntry")])
    merged = T.merge_identical_assets(g)
    assert ids(merged.assets) == ["n", "p", "x", "z"]
    assert sorted((r.type, r.to_id) for r in merged.relations.collect()) == [("CacheManifestEntry", "x"), ("HtmlAnchor", "x"), ("HtmlAnchor", "x"), ("HtmlStyle", "z"), ("HtmlStyle", "z")]
    assert T.remove_duplicate_html_styles(g).relations.where("type = 'HtmlStyle'").count() == 1


def test_stats_and_sizes(spark):
    g = graph(spark, [{"id": "a", "type": "Css", "last_known_byte_length": 1500}, {"id": "b", "type": "Css", "last_known_byte_length": 10}, {"id": "c", "url": None, "type": "Css"}, {"id": "d", "type": "Png", "is_loaded": False}], [])
    assert [(r.kind, r.assets, r.bytes, r["size"]) for r in sinks.stats_table(g).orderBy("is_total").collect()] == [("Css", 2, 1510, "1.5 KB"), ("Total", 2, 1510, "1.5 KB")]
    out = io.StringIO()
    sinks.write_stats(g, out=out)
    assert "Total" in out.getvalue()


def test_incompatible_types_and_warnings(spark):
    g = graph(spark, [{"id": "a", "type": "Css"}, {"id": "b", "type": "Png"}], [{"from_id": "b", "to_id": "a", "target_type": "JavaScript"}, {"from_id": "a", "to_id": "b", "target_type": "Image"}, {"from_id": "a", "to_id": "b", "target_type": "Gif"}])
    checked = T.check_incompatible_types(g)
    assert [(r.asset_id, r.message) for r in checked.warnings().collect()] == [("a", "used as both Css and JavaScript")]
    with pytest.raises(GraphWarning):
        checked.warnings("raise")
    out = io.StringIO()
    assert sinks.log_events(checked, out) == 1


def test_running_chunks_restart(spark):
    rows = spark.createDataFrame([("k", i, w) for i, w in enumerate([3, 3, 3, 9, 1, 1])], "k string, o int, w long")
    got = aggregate.running_chunks(rows, "k", "o", "w", 6).orderBy("o").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 3, 3]


def test_removal_takes_inline_children(spark):
    g = graph(spark, [{"id": "p"}, {"id": "i", "url": None}, {"id": "j", "url": None}, {"id": "q"}], edges(("p", "i"), ("i", "j"), ("q", "p")))
    out = T.remove_relations(g, {"from": "q"}, remove_orphan=True)
    assert ids(out.assets) == ["q"] and out.relations.count() == 0
    assert [r.owner_id for r in traverse.inline_owner(g.assets, g.relations).orderBy("id").collect()] == ["p", "p", "p", "q"]


def test_inline_and_externalize(spark):
    g = graph(spark, [{"id": "p", "type": "Html"}, {"id": "s", "type": "Css", "text": "x"}, {"id": "q", "type": "Html"}], [{"from_id": "p", "to_id": "s", "href": "s"}, {"from_id": "q", "to_id": "s", "href": "s"}])
    out = T.inline_relations(g, {"from": "p"})
    assert out.assets.where("url is null").count() == 1 and out.assets.count() == 4
    assert [(r.from_id, r.to_id == "s", r.href) for r in out.relations.orderBy("from_id").collect()] == [("p", False, None), ("q", True, "s")]
    back = T.externalize_relations(out, {"from": "p"})
    assert back.assets.where("url is null").count() == 0
    assert back.relations.where("from_id = 'p'").first().href.endswith(".css")


def test_moving_assets_refreshes_hrefs(spark):
    g = graph(spark, [{"id": "p", "url": "http://h/d/p.html"}, {"id": "i", "url": "http://h/i.png"}, {"id": "o", "url": "http://h/n/j.png"}], [{"from_id": "p", "to_id": "i", "href": "../i.png#f"}, {"from_id": "p", "to_id": "o", "href": "/n/j.png"}])
    out = T.move_assets(g, spark.createDataFrame([("i", "http://h/n/j.png")], "id string, new_url string"))
    assert {r.id: r.url for r in out.assets.collect()} == {"p": "http://h/d/p.html", "i": "http://h/n/j.png", "o": "http://h/n/j-1.png"}
    assert [r.href for r in out.relations.orderBy("ord").collect()] == ["../n/j.png#f", "/n/j-1.png"]
    assert ids(T.replace_asset(g, "i", "o").assets) == ["o", "p"]
    assert T.clone_assets(g, {"id": "i"}).assets.where("url = 'http://h/i-1.png'").count() == 1


def test_anchors_scripts_and_versions(spark):
    g = graph(spark, [{"id": "p", "type": "Html", "text": "<html lang=en data-version='1'><p>"}, {"id": "x", "url": "http://o/"}, {"id": "s", "type": "JavaScript"}], [{"from_id": "p", "to_id": "x", "node_attrs": {"target": "_blank", "rel": "me"}}, {"from_id": "p", "to_id": "x", "node_attrs": {"target": "_blank", "rel": "Opener"}}, {"from_id": "p", "to_id": "s", "node_attrs": {"target": "_blank"}}, {"from_id": "p", "to_id": "s", "type": "HtmlScript", "href": "s"}])
    rels = [(r.node_attrs or {}).get("rel") for r in T.add_rel_noopener_to_blank_target_anchors(g).relations.orderBy("ord").collect()]
    assert rels == ["me noopener", "Opener", None, None]
    assert T.set_async_or_defer_on_html_scripts(g, is_defer=True).relations.where("type = 'HtmlScript'").first().node_attrs == {"defer": "defer"}
    assert T.add_data_version_attribute(g, "{0}.2").assets.where("id = 'p'").first().text == '<html lang=en data-version="1.2"><p>'
    assert [(r.from_id, r.to_id) for r in T.add_javascript_source_url(g).relations.where("type = 'JavaScriptSourceUrl'").collect()] == [("s", "s")]


def test_favicon(spark):
    g = graph(spark, [{"id": "f", "url": "http://h/favicon.ico"}, {"id": "p", "type": "Html", "text": "<html>"}, {"id": "q", "type": "Html", "text": "<html>"}, {"id": "z", "type": "Html", "text": "<p>"}], [{"from_id": "q", "to_id": "f", "type": "HtmlShortcutIcon", "href": "favicon.ico"}])
    out = T.duplicate_favicon(g)
    assert sorted((r.from_id, r.href) for r in out.relations.collect()) == [("p", "/favicon.copy.ico"), ("q", "favicon.copy.ico")]
    assert T.duplicate_favicon(graph(spark, [{"id": "p", "type": "Html", "text": "<html>"}], [])).relations.count() == 0


def test_empty_scripts_and_sheets(spark):
    g = graph(spark, [{"id": "p"}, {"id": "a", "type": "JavaScript", "text": " /* x */ "}, {"id": "b", "type": "JavaScript", "text": ""}, {"id": "c", "type": "JavaScript", "text": "x"}, {"id": "d", "type": "Css", "text": ""}], [{"from_id": "p", "to_id": "a", "type": "HtmlScript", "node_attrs": {"src": "a"}}, {"from_id": "p", "to_id": "b", "type": "HtmlScript", "node_attrs": {"id": "keep"}}, {"from_id": "p", "to_id": "d", "type": "HtmlStyle"}])
    assert ids(T.remove_empty_javascripts(g).assets) == ["b", "c", "d", "p"]
    assert ids(T.remove_empty_stylesheets(g).assets) == ["a", "b", "c", "p"]


def test_css_imports_and_styles(spark):
    sheets = [{"id": x, "type": "Css"} for x in "abc"]
    g = graph(spark, [{"id": "p", "type": "Html"}, *sheets], [{"from_id": "p", "to_id": "a", "type": "HtmlStyle", "href": "a"}, {"from_id": "a", "to_id": "b", "type": "CssImport", "media": "print"}, {"from_id": "b", "to_id": "c", "type": "CssImport"}, {"from_id": "c", "to_id": "a", "type": "CssImport"}])
    out = T.convert_css_imports_to_html_styles(g).relations.where("from_id = 'p'").orderBy("ord").collect()
    assert [(r.to_id, r.media) for r in out] == [("c", None), ("b", "print"), ("a", None)]
    many = graph(spark, [{"id": "p", "type": "Html"}, *[{"id": f"s{i}", "type": "Css"} for i in range(5)]], [{"from_id": "p", "to_id": f"s{i}", "type": "HtmlStyle", "href": f"s{i}"} for i in range(5)])
    back = T.convert_html_styles_to_inline_css_imports(many, per_sheet=2)
    assert back.relations.where("type = 'HtmlStyle'").count() == 3
    assert back.assets.where("url is null").orderBy(F.length("text").desc(), "text").first().text == '@import "s0";\n@import "s1";'


def test_bundles(spark):
    scripts = [{"id": x, "type": "JavaScript", "text": x} for x in "abcd"]
    links = [{"from_id": p, "to_id": x, "type": "HtmlScript", "in_head": True, "node_attrs": {"src": x} | ({"id": "odd"} if (p, x) == ("q", "d") else {})} for p, xs in (("p", "abc"), ("q", "abd")) for x in xs]
    g = graph(spark, [{"id": "p", "type": "Html"}, {"id": "q", "type": "Html"}, *scripts], links)
    own = T.bundle_relations(g, {"type": "HtmlScript"})
    texts = {r.id: r.text for r in own.assets.collect()}
    assert [texts[r.to_id] for r in own.relations.orderBy("from_id", "ord").collect()] == ["a;\nb;\nc", "a;\nb", "d"]
    shared = T.bundle_relations(g, {"type": "HtmlScript"}, "sharedBundles")
    texts = {r.id: r.text for r in shared.assets.collect()}
    assert [texts[r.to_id] for r in shared.relations.orderBy("from_id", "ord").collect()] == ["a;\nb", "c", "a;\nb", "d"]
    with pytest.raises(ValueError):
        T.bundle_relations(g, None, "nope")


def test_manifest_query_string_and_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    g = graph(spark, [{"id": "p", "type": "Html", "url": "http://h/p.html"}, {"id": "c", "type": "Css"}, {"id": "i", "type": "Png", "url": "http://h/i.png?inline", "raw_src": png, "content_type": "image/png"}, {"id": "q", "type": "Html"}], [{"from_id": "p", "to_id": "c", "type": "HtmlStyle"}, {"from_id": "c", "to_id": "i", "type": "CssImage", "href": "i.png?inline"}, {"from_id": "p", "to_id": "q"}, {"from_id": "p", "to_id": "i", "type": "HtmlImage"}])
    listed = T.add_cache_manifest(g, {"id": "p"})
    assert ids(listed.relations.where("type = 'CacheManifestEntry'"), "to_id") == ["c", "i"]
    assert listed.assets.where("url = 'http://h/p.appcache'").count() == 1
    inlined = T.inline_assets_per_query_string(g, minimum_ie_version=7)
    assert inlined.assets.where("id = 'i' and url is not null").count() == 0
    assert inlined.warnings().count() == 1
    assert T.set_html_image_dimensions(g).relations.where("type = 'HtmlImage'").first().node_attrs == {"width": "7", "height": "9"}
    assert T.data_urls(g.assets).first().data_url.startswith("data:image/png;base64,")
    assert T.inline_css_images(g, 1000).relations.where("type = 'CssImage'").first().href is None


def test_text_transforms(spark):
    g = graph(spark, [{"id": "j", "type": "JavaScript", "text": 'a();console.log("x(", {b:1});debugger;if(c){console.warn(1)}x=console'}, {"id": "c", "type": "Css", "text": "a , b { color : red ; /* x */ }"}, {"id": "k", "type": "Css", "text": "a{}b,c{}d{}"}, {"id": "s", "type": "Json", "text": '{ "a": [1, 2] }'}, {"id": "z", "type": "Text", "raw_src": b"x" * 2000}], [{"from_id": "j", "to_id": "k", "type": "HtmlStyle", "href": "k"}])
    assert T.strip_debug(g).assets.where("id = 'j'").first().text == "a();if(c){}x=console"
    small = {r.id: r.text for r in T.minify_assets(g).assets.collect()}
    assert small["s"] == '{"a":[1,2]}' and small["c"] == "a,b{color : red}"
    T.SELECTOR_LIMIT = 2
    try:
        out = T.split_css_if_ie_limit_is_reached(g)
        assert sorted(r.text for r in out.assets.where("type = 'Css'").collect()) == ["a , b { color : red ; /* x */ }", "a{}", "b,c{}", "d{}"]
        assert out.relations.where("type = 'HtmlStyle'").count() == 3
    finally:
        T.SELECTOR_LIMIT = 65534
    packed = T.gzip(g).assets.where(F.col("url").endswith(".gz")).collect()
    assert len(packed) == 1 and len(packed[0].raw_src) < 100


def test_pipeline(spark):
    g = graph(spark, [{"id": "a"}, {"id": "b"}], edges(("a", "b")))
    heard = []
    out = Pipeline().if_(False).if_(True).remove_relations().endif().else_().queue(None).endif().update_assets({"id": "a"}, {"type": "Html"}).run(g, lambda when, name: heard.append((when, name)), keep=True)
    assert out.relations.count() == 0 and heard[0] == ("before", "remove_relations") and out.assets.where("type = 'Html'").count() == 1
    with pytest.raises(PipelineError, match="bundle_relations transform: "):
        Pipeline().bundle_relations(None, "nope").run(g)
    with pytest.raises(PipelineError):
        Pipeline().if_(True).run(g)
    with pytest.raises(AttributeError):
        Pipeline().nope()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/p.html").write_text("<a href='d/q.css'>")
    (tmp_path / "in/d/q.css").write_text("@import 'x'")
    (tmp_path / "in/e").write_bytes(b"\xff")
    root = f"file://{tmp_path}/in/"
    assets = assets_from_files(spark, str(tmp_path / "in"))
    assert sorted((r.url[len(root) :], r.type, r.text) for r in assets.collect()) == [("d/q.css", "Css", "@import 'x'"), ("e", "Asset", None), ("p.html", "Html", "<a href='d/q.css'>")]
    g = Graph(assets, resolved(extract(assets), assets).withColumn("id", F.md5(F.concat("from_id", "ord"))), root)
    assert [r.href for r in g.relations.where("to_id is not null").collect()] == ["d/q.css"]
    notes = sinks.write_assets(Graph(assets.unionByName(assets.limit(1).withColumn("url", F.lit(root + "../x"))), g.relations, root), str(tmp_path / "out"))
    assert notes.count() == 1
    assert (tmp_path / "out/d/q.css").read_text() == "@import 'x'" and not (tmp_path / "x").exists()
    buffer = io.BytesIO()
    sinks.write_assets_to_stdout(g, {"type": "Css"}, buffer)
    assert buffer.getvalue() == b"@import 'x'"
    sinks.draw_graph(g, str(tmp_path / "g.dot"))
    assert "->" in (tmp_path / "g.dot").read_text()


def test_responses_and_data_urls(spark):
    web = spark.createDataFrame([("http://h/a#x", 200, "text/css; charset=iso-8859-1", None, b"\xe9", 1), ("http://h/a", 200, "text/html", None, b"z", 2), ("http://h/b", 302, None, "/a", None, 3)], "url string, status_code int, content_type string, location string, raw_src binary, seq long")
    rows = {r.url: r for r in assets_from_responses(web).collect()}
    assert (rows["http://h/a"].type, rows["http://h/a"].text, rows["http://h/b"].is_redirect) == ("Css", "é", True)
    assert parse_data_url("data:,a%20b") == ("text/plain", "utf-8", b"a b") and parse_data_url("data:text/css;base64,YQ==") == ("text/css", "utf-8", b"a") and parse_data_url("x") is None
    relations = spark.createDataFrame([("r", "data:text/css,a{}", None), ("s", "javascript:a+b%20", None), ("t", "x", None)], "id string, href string, target_type string")
    assert sorted((r.id, r.type, r.text) for r in inline_targets(relations).collect()) == [("r", "Css", "a{}"), ("s", "JavaScript", "a+b ")]
    kinds = spark.createDataFrame([("text/html", None, ".js"), (None, "Image", ".svg"), (None, "Image", ""), ("text/plain", None, ".css"), ("application/json", None, ".map"), (None, None, None)], "c string, t string, e string")
    assert [r[0] for r in kinds.select(inferred_type(F.col("c"), F.col("t"), F.col("e"))).collect()] == ["Html", "Svg", "Image", "Text", "SourceMap", None]


def test_crawl(spark):
    web = spark.createDataFrame([("1", "http://h/p", "Html", "<link rel=stylesheet href=s><a href=q>"), ("2", "http://h/s", "Css", "a{background:url(i)} /*# sourceMappingURL=m */"), ("3", "http://h/q", "Html", "<a href=p>")], "id string, url string, type string, text string")
    loaded, relations, notes = traverse.populate(web, web.where("id = '1'"), lambda pages: resolved(extract(pages), web), {"type": {"$not": "HtmlAnchor"}})
    assert ids(loaded) == ["1", "2"] and relations.count() == 4
    assert sorted((r.severity, r.message) for r in notes.collect()) == [("info", "cannot load http://h/m"), ("warn", "cannot load http://h/i")]


def test_manifest_entries_of_many_pages_take_no_rounds(spark, monkeypatch):
    n = 400
    assets = [{"id": f"p{i}", "type": "Html", "url": f"http://h/p{i}.html"} for i in range(3)] + [{"id": f"c{i}", "type": "Css", "url": f"http://h/c{i}.css"} for i in range(n)] + [{"id": "m", "type": "CacheManifest", "url": "http://h/m"}]
    chain = [{"from_id": f"c{i}", "to_id": f"c{(i + 1) % n}", "type": "CssImport"} for i in range(n)]
    g = graph(spark, assets, [{"from_id": f"p{i}", "to_id": f"c{i}", "type": "HtmlStyle"} for i in range(3)] + [{"from_id": "p2", "to_id": "m", "type": "HtmlCacheManifest"}, {"from_id": "m", "to_id": "c5", "type": "CacheManifestEntry", "href": "c5.css"}, *chain])
    monkeypatch.setattr(T.traverse, "reachable", None)
    rows = [r for r in T.add_cache_manifest(g).relations.where("type = 'CacheManifestEntry'").collect() if r.to_id.startswith("c")]
    by = {}
    for r in rows:
        by.setdefault(r.from_id, []).append(r)
    assert len(by) == 3 and all(sorted(r.to_id for r in listed) == sorted(f"c{i}" for i in range(n)) for listed in by.values())
    own = {r.to_id: r for r in by["m"]}
    assert own["c2"].ord == 1 and own["c1"].ord == n and own["c1"].href == "c1.css" and own["c5"].href == "c5.css"


def test_order_of_long_chains_takes_no_rounds(spark, monkeypatch):
    n = 9000
    chain = [{"from_id": f"c{i}", "to_id": f"c{(i + 1) % n}", "ord": 1} for i in range(n)]
    g = graph(spark, [{"id": "c0"}], [*chain, {"from_id": "c0", "to_id": "x", "ord": None}, {"from_id": "c0", "to_id": "y", "ord": 0}, {"from_id": "c9", "to_id": None, "ord": 0}, {"from_id": "alone", "to_id": None}])
    monkeypatch.setattr(traverse, "reachable", None)
    start = spark.createDataFrame([("c0",), ("c7",), ("alone",), ("c0",), (None,)], "id string")
    for post in (False, True):
        rows = traverse.collect_assets(g.relations, g.assets, start, post=post).orderBy("start", "visit_seq").collect()
        got = {s: [r.id for r in rows if r.start == s] for s in ("alone", "c0", "c7")}
        down = [f"c{i}" for i in range(n)]
        assert len(rows) == sum(map(len, got.values())) and [r.visit_seq for r in rows if r.start == "c7"] == list(range(n + 2))
        assert got["alone"] == ["alone"]
        assert got["c0"] == (["y", *down[:0:-1], "x", "c0"] if post else ["c0", "y", *down[1:], "x"])
        assert got["c7"] == (["y", *down[6:0:-1], "x", "c0", *down[:6:-1]] if post else [*down[7:], "c0", "y", *down[1:7], "x"])
    assert traverse.collect_assets(g.relations, g.assets, start.limit(0)).count() == 0
