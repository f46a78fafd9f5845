import re

import pytest
from pyspark.sql import functions as F

from sitegrove.operators.query import find_assets, find_relations, update_assets

ROWS = [("1", "Html", "http://a/x.html", None, 1, {"foo": "bar"}), ("2", "Css", "http://a/y.css", "utf-8", 2, None), ("3", None, None, "latin1", None, {}), ("4", "Png", "http://b/z.png", None, 7, {"foo": "quux"})]
NAMES = ("id", "type", "url", "encoding", "size", "props")


def value(row, key):
    r = dict(zip(NAMES, row))
    return r[key] if key in r else (r["props"] or {}).get(key)


def matches(v, wanted):
    """A plain evaluator of the two-valued language."""
    if isinstance(wanted, re.Pattern):
        return v is not None and wanted.search(v) is not None
    if isinstance(wanted, dict):
        out = True
        for op, x in wanted.items():
            out &= {
                "$in": lambda x: any(matches(v, y) for y in x), "$nin": lambda x: not any(matches(v, y) for y in x), "$not": lambda x: not matches(v, x), "$or": lambda x: any(matches(v, y) for y in x), "$gt": lambda x: v is not None and v > x,
                "$gte": lambda x: v is not None and v >= x, "$lt": lambda x: v is not None and v < x, "$lte": lambda x: v is not None and v <= x, "$ne": lambda x: v != x, "$eq": lambda x: v == x, "$exists": lambda x: (v is not None) == x,
                "$regex": lambda x: v is not None and re.search(x, v) is not None, "$mod": lambda x: v is not None and v % x[0] == x[1],
            }[op](x)
        return out
    return v == wanted


QUERIES = [
    {}, {"type": "Html"}, {"type": None}, {"url": re.compile("html")}, {"url": re.compile("HTML", re.I)}, {"type": {"$in": ["Css", "Png"]}}, {"type": {"$in": []}}, {"type": {"$nin": ["Css"]}}, {"type": {"$nin": []}}, {"type": {"$not": "Html"}},
    {"url": {"$not": re.compile("a/")}}, {"type": {"$or": ["Css", re.compile("P")]}}, {"foo": "bar"}, {"foo": {"$exists": False}}, {"nothing": None}, {"nothing": {"$not": "x"}}, {"size": {"$gt": 1, "$lt": 7}}, {"size": {"$gte": 2}}, {"size": {"$mod": [2, 1]}},
    {"encoding": {"$ne": "utf-8"}}, {"type": "Html", "encoding": None}, {"url": {"$regex": "^http://b"}}, {"type": {"$in": [None, "Css"]}},
]


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "id string, type string, url string, encoding string, size int, props map<string,string>, seq long")


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_predicates_agree_with_plain_evaluation(assets, query):
    expected = [r[0] for r in ROWS if all(matches(value(r, k), w) for k, w in query.items())]
    assert [r["id"] for r in find_assets(assets, query).collect()] == expected


def test_boolean_operators_and_functions(assets):
    assert [r.id for r in find_assets(assets, {"$or": [{"type": "Css"}, {"size": 7}]}).collect()] == ["2", "4"]
    assert [r.id for r in find_assets(assets, {"$and": [{"type": "Css"}, {"size": 7}]}).collect()] == []
    assert [r.id for r in find_assets(assets, {"$nor": [{"type": "Css"}]}).collect()] == ["1", "3", "4"]
    assert [r.id for r in find_assets(assets, {"size": lambda c: c % 2 == 1}).collect()] == ["1", "4"]
    assert [r.id for r in find_assets(assets, lambda df: df["size"] > 1).collect()] == ["2", "4"]
    with pytest.raises(ValueError):
        find_assets(assets, {"size": {"$nope": 1}})


def test_relations_with_nested_queries(spark, assets):
    relations = spark.createDataFrame([("r1", "HtmlStyle", "1", "2", 0), ("r2", "HtmlImage", "1", "4", 1), ("r3", "CssImage", "2", "4", 0), ("r4", "HtmlAnchor", "1", None, 2)], "id string, type string, from_id string, to_id string, ord int")
    ids = lambda q: [r.id for r in find_relations(relations, assets, q, ordered=True).collect()]
    assert ids({"to": {"type": "Png"}}) == ["r2", "r3"]
    assert ids({"from": "1", "to": {"type": {"$not": "Png"}}}) == ["r1"]
    assert ids({"from": ["1", {"type": "Css"}]}) == ["r1", "r2", "r4", "r3"]
    got = lambda q: [r.id for r in find_assets(assets, q, relations).collect()]
    assert got({"incomingRelations": {"$elemMatch": {"type": "CssImage"}}}) == ["4"]
    assert got({"incomingRelations": {"$size": 0}}) == ["1", "3"]
    assert got({"outgoingRelations": {"$not": {"$elemMatch": {"type": "HtmlImage"}}}}) == ["2", "3", "4"]


def test_update(assets):
    out = update_assets(assets, {"type": "Css"}, {"encoding": "x", "foo": "new"}).where(F.col("encoding") == "x").collect()
    assert [(r.id, r.props) for r in out] == [("2", {"foo": "new"})]
