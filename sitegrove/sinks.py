"""Sinks: files, standard output, statistics, a Graphviz graph, logged diagnostics."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sitegrove.functions.urls import directory, file_name
from sitegrove.graph import Graph
from sitegrove.operators.aggregate import readable_size, stats
from sitegrove.operators.query import Query


def _write(out_root: str) -> Callable[[Iterator[Row]], None]:
    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            path = os.path.join(out_root, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["raw"])
            os.replace(part, path)  # a retried task writes the same bytes again

    return write


def write_assets(graph: Graph, out_root: str, query: Query = None, root: str | None = None) -> DataFrame:
    """Writes the matching non-inline assets below `out_root`, a folder that all executors share, from the executors.

    Returns diagnostics: urls that are not below the root or end in a slash are not written and give a warning. Urls that
    would leave the folder are refused in the same way.
    """
    root = root or graph.root
    chosen = graph.find_assets(query).where(F.col("url").isNotNull())
    path = F.regexp_replace(F.substr(F.col("url"), F.lit(len(root) + 1)), r"[?#].*$", "")
    raw = F.coalesce("raw_src", F.encode("text", "utf-8"))
    below = F.col("url").startswith(root) & ~F.col("url").endswith("/") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)|^/") & (path != "")
    chosen.where(below & raw.isNotNull()).select(path.alias("path"), raw.alias("raw")).foreachPartition(_write(out_root))
    return chosen.where(~below).select(F.lit("warn").alias("severity"), F.lit("write").alias("code"), F.col("id").alias("asset_id"), F.concat(F.lit("not written: "), F.col("url")).alias("message"))


def write_assets_to_stdout(graph: Graph, query: Query = None, out=None) -> None:
    """The bytes of the matching assets in graph order, one partition at a time."""
    out = out or sys.stdout.buffer
    for r in graph.find_assets(query).select(F.coalesce("raw_src", F.encode("text", "utf-8")).alias("raw")).toLocalIterator():
        if r["raw"] is not None:
            out.write(r["raw"])


def stats_table(graph: Graph, query: Query = None) -> DataFrame:
    """kind, assets and size for people; the total last."""
    rows = stats(graph.find_assets(query))
    return rows.select(F.coalesce("kind", F.lit("Total")).alias("kind"), "assets", "bytes", readable_size(F.col("bytes")).alias("size"), F.col("kind").isNull().alias("is_total"))


def write_stats(graph: Graph, query: Query = None, out=None) -> None:
    out = out or sys.stderr
    rows = stats_table(graph, query).orderBy("is_total", F.col("bytes").desc(), "kind").collect()  # one row per type
    for r in rows:
        print(f"{r['kind']:>20} {r['assets']:>8} {r['size']:>12}", file=out)


def dot_lines(graph: Graph, query: Query = None) -> DataFrame:
    """(part, key, line): the lines of a Graphviz graph; clusters by directory, nodes, then edges."""
    assets = graph.find_assets(query)

    def quoted(c):
        return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))

    label = F.coalesce(file_name(F.col("url")), F.col("url"), F.concat(F.lit("inline "), F.col("type")))
    nodes = assets.select(F.lit(0).alias("part"), F.coalesce(directory(F.col("url")), F.lit("")).alias("key"), F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), F.coalesce(directory(F.col("url")), F.lit("inline")))), F.lit(" { "), quoted(F.col("id")), F.lit(" [label="), quoted(label), F.lit("]; }")).alias("line"))
    ids = assets.select("id")
    edges = graph.relations.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return nodes.unionByName(edges.select(F.lit(1).alias("part"), F.col("from_id").alias("key"), F.concat(quoted(F.col("from_id")), F.lit(" -> "), quoted(F.col("to_id")), F.lit(" [label="), quoted(F.col("type")), F.lit("];")).alias("line")))


def draw_graph(graph: Graph, path: str, query: Query = None) -> None:
    """Writes the dot text, streamed in order; turning it into a picture is left to the dot program."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("digraph sites {\n")
        for r in dot_lines(graph, query).orderBy("part", "key", "line").toLocalIterator():
            f.write(r["line"] + "\n")
        f.write("}\n")


def log_events(graph: Graph, out=None, stop_on_warning: bool = False) -> int:
    """Prints the diagnostics; the number of warnings. With stop_on_warning a warning ends the program."""
    out = out or sys.stderr
    warnings = 0
    for r in graph.warnings().orderBy("severity", "code", "message").toLocalIterator():
        warnings += r["severity"] == "warn"
        print(f"{r['severity']}: {r['code']}: {r['message']}", file=out)
    if warnings and stop_on_warning:
        raise SystemExit(1)
    return warnings
