"""The queries of this subpackage, for the driver's entry."""

from sitegrove.llm import queries_assets, queries_documents

MODULES = [queries_assets, queries_documents]
