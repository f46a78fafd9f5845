"""The graph: two lazy tables and the operators on them. Nothing is mutated; each operator returns a new graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrove.operators import query as q
from sitegrove.schema import DIAGNOSTICS


class GraphWarning(Exception):
    """A warning that nothing listens to."""


@dataclass(frozen=True)
class Graph:
    """Assets and relations, the root url, and the diagnostics so far (severity, code, asset_id, message)."""

    assets: DataFrame
    relations: DataFrame
    root: str = "file:///"
    diagnostics: DataFrame | None = None
    canonical_root: str | None = None

    def __post_init__(self) -> None:
        if not self.root.endswith("/"):
            object.__setattr__(self, "root", self.root + "/")
        if self.canonical_root is not None:
            if not self.canonical_root.startswith(("http://", "https://", "//")):
                raise ValueError("a canonical root is an absolute http(s) or protocol-relative url")
            if not self.canonical_root.endswith("/"):
                object.__setattr__(self, "canonical_root", self.canonical_root + "/")

    @property
    def spark(self) -> SparkSession:
        return self.assets.sparkSession

    def find_assets(self, query: q.Query = None) -> DataFrame:
        return q.find_assets(self.assets, query, self.relations)

    def find_relations(self, query: q.Query = None, ordered: bool = False) -> DataFrame:
        return q.find_relations(self.relations, self.assets, query, ordered)

    def with_(self, assets: DataFrame | None = None, relations: DataFrame | None = None, diagnostics: DataFrame | None = None) -> Graph:
        """A graph with other tables; diagnostics are added to those there are."""
        if diagnostics is not None and self.diagnostics is not None:
            diagnostics = self.diagnostics.unionByName(diagnostics)
        return replace(self, assets=self.assets if assets is None else assets, relations=self.relations if relations is None else relations, diagnostics=self.diagnostics if diagnostics is None else diagnostics)

    def apply(self, transform: Callable[..., Graph], *args, **options) -> Graph:
        return transform(self, *args, **options)

    def warnings(self, on_warn: str = "collect") -> DataFrame:
        """The diagnostics; with on_warn='raise' the first warning raises instead."""
        found = self.diagnostics if self.diagnostics is not None else self.spark.createDataFrame([], DIAGNOSTICS)
        if on_warn == "raise":
            first = found.where(F.col("severity") == "warn").orderBy("code", "message").limit(1).collect()
            if first:
                raise GraphWarning(f"{first[0]['code']}: {first[0]['message']}")
        return found

    def out_of(self, id_: str) -> DataFrame:
        """The relations of an asset in document order."""
        return self.relations.where(F.col("from_id") == id_).orderBy("ord")

    def into(self, id_: str) -> DataFrame:
        return self.relations.where(F.col("to_id") == id_)
