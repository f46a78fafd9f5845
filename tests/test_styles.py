import pytest
from test_graph import graph

from sitegrove.extract.dom import parse_html
from sitegrove.extract.selectors import matches, specificity
from sitegrove.operators import styles as S

PAGE = "<html><head><title>x</title></head><body class='c d'><div id=i><p>a<p class=e lang=en-us>b</div><h1>t</h1><link rel=stylesheet href=s><h2>u</h2></body></html>"


@pytest.mark.parametrize(
    ("selector", "tags"),
    [("p", "pp"), ("body > div p", "pp"), ("body > p", ""), ("#i", "div"), (".c.d", "body"), (".e", "p"), ("p + p", "p"), ("p ~ .e", "p"), ("[lang|=en]", "p"), ("[class~=d]", "body"), ("p:not(.e)", "p"), ("p:first-child", "p"), ("div p:nth-child(2n)", "p"), ("h1, h2", "h1h2"), ("p:hover", "pp"), ("p:unknown", ""), ("*:is(h1,h2)", "h1h2")],
)
def test_selectors(selector, tags):
    assert "".join(n.tag for n in parse_html(PAGE).walk() if not n.tag.startswith("#") and matches(n, selector)) == tags


def test_specificity_and_rules():
    assert specificity("#a .b[c] d:not(#e)") == (2, 2, 1)
    assert S.rules("a{b:c;d:e}@media print{f{g:h}}@media screen{i{j:k}}@font-face{l:m}") == [("a", ["b:c", "d:e"]), ("i", ["j:k"])]


def test_transforms(spark):
    g = graph(spark, [{"id": "p", "type": "Html", "text": "<html><head></head><body><p class=x style='color:blue'>a</p><i>b</i></body></html>"}, {"id": "s", "type": "Css", "text": "p{color:red;margin:0}.x{margin:1px}i:hover{top:0}"}, {"id": "q", "type": "Html", "text": PAGE}, {"id": "t", "type": "Css", "text": "h1{a:b}h2{c:d}p:hover{e:f}"}], [{"from_id": "p", "to_id": "s", "type": "HtmlStyle"}, {"from_id": "q", "to_id": "t", "type": "HtmlStyle"}])
    out = S.convert_stylesheets_to_inline_styles(g, {"id": "p"})
    assert out.assets.where("id = 'p'").first().text == '<html><head></head><body><p class=x style="margin: 1px; color: blue">a</p><i>b</i></body></html>'
    assert [r.from_id for r in out.relations.collect()] == ["q"]
    assert "<style>h1{a:b}p:hover{e:f}</style></head>" in S.inline_critical_css(g).assets.where("id = 'q'").first().text


def test_scripts_and_templates(spark):
    assert S.replace_symbols("if(DEBUG){x.DEBUG=DEBUG;DEBUG=1;A.B.c('DEBUG')}", {"DEBUG": "false", "A.B": "null"}) == "if(false){x.DEBUG=false;DEBUG=1;null.c('DEBUG')}"
    assert S.global_uses("a.b.c(); a.b; x['a.b']") == {"a.b": 2, "a.b.c": 1}
    g = graph(spark, [{"id": "p", "type": "Html", "text": "<body>x</body>"}, {"id": "t", "type": "Html", "url": "http://h/t/name.ko", "text": "<b>"}, {"id": "j", "type": "JavaScript", "text": "DEBUG", "props": {"source_map_text": "{}"}}], [{"from_id": "p", "to_id": "t"}])
    assert S.inline_html_templates(g).assets.where("id = 'p'").first().text == '<body>x<script type="text/html" id="name"><b></script></body>'
    assert S.replace_symbols_in_javascript(g, {"DEBUG": "0"}).assets.where("id = 'j'").first().text == "0"
    out = S.serialize_source_maps(g)
    assert out.assets.where("type = 'SourceMap'").first().url == "http://h/j.map" and out.relations.where("from_id = 'j'").first().href == "j.map"
