import random

from conftest import day
from pyspark.sql import functions as F

from sitegrove.operators.dangling import dangling, dangling_references, dangling_report

ASSETS = "id string, url string, added_at timestamp_ntz, removed_at timestamp_ntz, ingested_at timestamp_ntz, key string"
RELATIONS = "id string, from_id string, to_id string, href string, base_url string, seen_at timestamp_ntz, ingested_at timestamp_ntz, n int"
NOTES = "id string, asset_id string, raised_at timestamp_ntz, ingested_at timestamp_ntz"
SITES = "site_id int, host string"


def found(spark, assets, relations, notes=(), hosts=("h.example",)):
    df = dangling_references(spark.createDataFrame(list(assets), ASSETS), spark.createDataFrame(list(relations), RELATIONS), spark.createDataFrame(list(notes), NOTES), spark.createDataFrame([(1, h) for h in hosts], SITES))
    return sorted(tuple(r)[:3] for r in df.collect())


def test_missing_late_and_removed_parents(spark):
    assets = [("a", "http://h.example/a", day(0), day(10), day(0), "x"), ("late", None, day(5), None, day(5), None)]
    relations = [("r1", "a", "late", None, None, day(4), day(4), 1), ("r2", "a", "late", None, None, day(6), day(6), 1), ("r3", "a", "gone", None, None, day(10), day(10), 1), ("r4", "a", None, None, None, day(9), day(9), 1)]
    notes = [("d1", "late", day(1), day(1)), ("d2", None, day(1), day(1)), ("d3", "a", None, day(1))]
    assert found(spark, assets, relations, notes) == [("diagnostics", "d1", "asset_id"), ("diagnostics", "d3", "asset_id"), ("relations", "r1", "to_id"), ("relations", "r3", "from_id"), ("relations", "r3", "to_id")]


def test_hrefs(spark):
    assets = [("p", "http://h.example/d/p.html", day(0), None, day(0), None), ("q", "http://H.example:80/d/q%20x?v=1#f", day(0), day(5), day(0), None), ("q2", "http://h.example/d/q x?v=1", day(7), None, day(7), None)]
    hrefs = [("in time", " q%20x?v=1#z ", 1), ("between", "q%20x?v=1", 6), ("again", "q%20x?v=1", 8), ("query counts", "q%20x", 1), ("other host", "http://o.example/", 1), ("fragment", "#x", 1), ("empty", "  ", 1), ("mail", "mailto:x@h.example", 1), ("missing", "/nope", 1)]
    relations = [(name, "p", None, href, None, day(at), day(at), 1) for name, href, at in hrefs] + [("based", "p", None, "x", "http://h.example/e/", day(1), day(1), 1)]
    assert [r[1] for r in found(spark, assets, relations)] == ["based", "between", "missing", "query counts"]


def test_latest_delivery_holds(spark):
    assets = [("a", None, day(0), None, day(0), None), ("a", None, day(0), day(1), day(2), None), ("b", None, day(0), None, day(0), None), ("b", None, day(0), None, day(0), None)]
    relations = [("r", "b", "a", None, None, day(3), day(3), 1), ("r", "b", "a", None, None, day(3), day(3), 1)]
    assert found(spark, assets, relations) == [("relations", "r", "to_id")]


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [("r", "x", None, None, None, day(0), day(0), 1)]) == [("relations", "r", "from_id")]


def test_random_against_brute_force_with_hot_keys(spark):
    rng = random.Random(7)
    parents = [(f"k{rng.randrange(12)}", day(a := rng.randrange(20)), None if rng.random() < 0.3 else day(a + rng.randrange(1, 9))) for _ in range(30)]
    refs = [("t", str(i), "f", "k0" if rng.random() < 0.4 else f"k{rng.randrange(15)}", None if rng.random() < 0.05 else day(rng.randrange(25))) for i in range(400)]
    got = dangling(spark.createDataFrame(refs, "table_name string, record_id string, field_name string, key string, at timestamp_ntz"), spark.createDataFrame(parents, "key string, added_at timestamp_ntz, removed_at timestamp_ntz"), hot_rows=50)
    expected = {r[1] for r in refs if not any(k == r[3] and r[4] is not None and a <= r[4] and (b is None or r[4] < b) for k, a, b in parents)}
    rows = [r["record_id"] for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    report = dangling_report(got, spark.createDataFrame(refs, "table_name string, record_id string, field_name string, key string, at timestamp_ntz"))
    assert report.agg(F.sum("dangling")).first()[0] == len(expected)
    assert {(r.month, r.total, round(r.dangling / r.total, 6) == r.rate) for r in report.collect()} == {(m, sum(1 for r in refs if (r[4] and r[4].strftime("%Y-%m")) == m), True) for m in {r[4] and r[4].strftime("%Y-%m") for r in refs if r[1] in expected}}
