from conftest import day

from sitegrove.streaming.arrivals import arriving, arriving_relations, diagnostics_per_window, each_batch, holding_updates, to_parquet

ASSETS = "id string, type string, text string, ingested_at timestamp_ntz"


def test_arriving_relations(spark, tmp_path):
    rows = spark.createDataFrame([("p", "Html", "<a href=x>", day(0)), ("p", "Html", "<a href=x>", day(0)), ("q", "Css", "@import 'y'", day(1))], ASSETS)
    rows.write.parquet(str(tmp_path / "in"))
    stream = arriving_relations(holding_updates(arriving(spark, str(tmp_path / "in"), rows.schema)))
    to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.from_id, r.type, r.href) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("p", "HtmlAnchor", "x"), ("q", "CssImport", "y")]


def test_windows_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "WARN", "x", day(0)), ("d2", "warn", "x", day(0)), ("d3", "info", "y", day(9))], "id string, severity string, code string, raised_at timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    query = each_batch(diagnostics_per_window(arriving(spark, str(tmp_path / "in"), rows.schema), delay="1 day"), lambda df, n: seen.extend((r.severity, r.code, r.n) for r in df.collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert ("warn", "x", 2) in seen
