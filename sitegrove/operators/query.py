"""Query objects: nested dictionaries that compile to Column predicates and semi joins.

The language knows two values only: a comparison with something missing is false and its negation true. Every leaf is
therefore closed with coalesce, so that SQL's third value never reaches a filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

Query = Mapping[str, Any] | Callable[[DataFrame], Column] | None
_FLAGS = ((re.I, "i"), (re.M, "m"), (re.S, "s"))


def two_valued(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _regex(pattern: re.Pattern | str) -> str:
    """A Python or textual pattern for rlike; flags go inline."""
    if isinstance(pattern, str):
        return pattern
    flags = "".join(letter for flag, letter in _FLAGS if pattern.flags & flag)
    return f"(?{flags}){pattern.pattern}" if flags else pattern.pattern


def value_predicate(column: Column, wanted: Any) -> Column:
    """Whether a value matches: a scalar, a regular expression, a predicate function, or an object of operators."""
    if isinstance(wanted, re.Pattern):
        return two_valued(column.rlike(_regex(wanted)))
    if callable(wanted):
        return two_valued(wanted(column))
    if isinstance(wanted, Mapping):
        out = F.lit(True)
        for operator, operand in wanted.items():
            if operator not in OPERATORS:
                raise ValueError(f"unknown operator {operator}")
            if operator == "$options":
                continue
            if operator == "$regex" and wanted.get("$options"):
                operand = f"(?{wanted['$options']}){_regex(operand)}"
            out = out & OPERATORS[operator](column, operand)
        return out
    return column.eqNullSafe(F.lit(wanted))


def _in(column: Column, values: Any) -> Column:
    out = F.lit(False)
    scalars = [v for v in values if v is not None and not isinstance(v, (re.Pattern, Mapping)) and not callable(v)]
    if scalars:
        out = two_valued(column.isin(*scalars))
    for v in values:
        if v is None:
            out = out | column.isNull()
        elif isinstance(v, (re.Pattern, Mapping)) or callable(v):
            out = out | value_predicate(column, v)
    return out


def _any(column: Column, options: Any) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | value_predicate(column, o)
    return out


def _all(column: Column, values: Any) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & two_valued(F.array_contains(column, v))
    return out


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: value_predicate(c, v),
    "$ne": lambda c, v: ~value_predicate(c, v),
    "$gt": lambda c, v: two_valued(c > F.lit(v)),
    "$gte": lambda c, v: two_valued(c >= F.lit(v)),
    "$lt": lambda c, v: two_valued(c < F.lit(v)),
    "$lte": lambda c, v: two_valued(c <= F.lit(v)),
    "$in": _in,
    "$nin": lambda c, v: ~_in(c, v),
    "$not": lambda c, v: ~value_predicate(c, v),
    "$or": _any,
    "$nor": lambda c, v: ~_any(c, v),
    "$and": lambda c, v: ~_any(c, [{"$not": x} for x in v]),
    "$regex": lambda c, v: two_valued(c.rlike(_regex(v))),
    "$options": lambda c, v: F.lit(True),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$mod": lambda c, v: two_valued(F.pmod(c, F.lit(v[0])) == v[1]),
    "$size": lambda c, v: two_valued(F.size(c) == v),
    "$all": _all,
    "$elemMatch": lambda c, v: two_valued(F.exists(c, lambda e: value_predicate(e, v) if not isinstance(v, Mapping) or any(k.startswith("$") for k in v) else struct_predicate(e, v))),
}


def struct_predicate(struct: Column, query: Mapping[str, Any]) -> Column:
    """A query on the fields of a struct value."""
    out = F.lit(True)
    for key, wanted in query.items():
        out = out & value_predicate(struct.getField(key), wanted)
    return out


def predicate(df: DataFrame, query: Query) -> Column:
    """The Column of a query on the rows of `df`. Keys that are no column are looked up in `props`; else they are missing."""
    if query is None:
        return F.lit(True)
    if callable(query):
        return two_valued(query(df))
    out = F.lit(True)
    for key, wanted in query.items():
        if key in ("$and", "$or", "$nor"):
            parts = [predicate(df, q) for q in wanted]
            joined = F.lit(key == "$and")
            for p in parts:
                joined = joined & p if key == "$and" else joined | p
            out = out & (~joined if key == "$nor" else joined)
        elif key == "$not":
            out = out & ~predicate(df, wanted)
        elif key == "$where":
            out = out & two_valued(wanted(df))
        else:
            column, kind = _column(df, key)
            nested = isinstance(wanted, Mapping) and not any(k.startswith("$") for k in wanted)
            if nested and isinstance(kind, StructType):
                out = out & struct_predicate(column, wanted)
            elif nested and isinstance(kind, MapType):
                for k, w in wanted.items():
                    out = out & value_predicate(F.try_element_at(column, F.lit(k)), w)
            elif isinstance(kind, ArrayType) and not isinstance(wanted, Mapping) and not callable(wanted) and not isinstance(wanted, re.Pattern):
                out = out & two_valued(F.array_contains(column, wanted))
            else:
                out = out & value_predicate(column, wanted)
    return out


def _column(df: DataFrame, key: str):
    names = {f.name: f.dataType for f in df.schema.fields}
    if key in names:
        return df[key], names[key]
    if "props" in names and isinstance(names["props"], MapType):
        return F.try_element_at(df["props"], F.lit(key)), None
    return F.lit(None).cast("string"), None


def _split(query: Query, *keys: str) -> tuple[Query, dict[str, Any]]:
    """The query without the keys that name other tables, and these."""
    if not isinstance(query, Mapping):
        return query, {}
    return {k: v for k, v in query.items() if k not in keys}, {k: query[k] for k in keys if k in query}


def find_assets(assets: DataFrame, query: Query = None, relations: DataFrame | None = None) -> DataFrame:
    """The matching assets in insertion order.

    incomingRelations / outgoingRelations with $elemMatch become left semi joins with the matching relations; with $size
    0 or $not $elemMatch left anti joins.
    """
    own, nested = _split(query, "incomingRelations", "outgoingRelations")
    out = assets.where(predicate(assets, own))
    for key, wanted in nested.items():
        if relations is None:
            raise ValueError(f"{key} needs the relations")
        end = "to_id" if key == "incomingRelations" else "from_id"
        how = "left_semi"
        if "$not" in wanted:
            wanted, how = wanted["$not"], "left_anti"
        if wanted.get("$size") == 0:
            matching, how = relations, "left_anti"
        elif "$elemMatch" in wanted:
            matching = find_relations(relations, assets, wanted["$elemMatch"])
        else:
            raise ValueError(f"{key} takes $elemMatch, $not of it, or $size 0")
        out = out.join(matching.select(F.col(end).alias("_end")).where(F.col("_end").isNotNull()), out["id"] == F.col("_end"), how)
    return out.orderBy("seq") if "seq" in out.columns else out


def find_relations(relations: DataFrame, assets: DataFrame, query: Query = None, ordered: bool = False) -> DataFrame:
    """The matching relations. Queries on `from` and `to` are semi joins with the matching assets; a list of ids or
    queries means any of them."""
    own, nested = _split(query, "from", "to")
    out = relations.where(predicate(relations, own))
    for key, wanted in nested.items():
        column = f"{key}_id"
        if isinstance(wanted, str):
            out = out.where(F.col(column) == wanted)
            continue
        options = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        ids = [o for o in options if isinstance(o, str)]
        match = assets["id"].isin(*ids) if ids else F.lit(False)
        for o in options:
            if not isinstance(o, str):
                match = match | predicate(assets, o)
        ends = assets.where(match).select(F.col("id").alias("_end"))
        out = out.join(ends, out[column] == F.col("_end"), "left_semi")
    if ordered:
        seqs = assets.select(F.col("id").alias("from_id"), F.col("seq").alias("_seq"))
        out = out.join(seqs, "from_id", "left").orderBy("_seq", "ord").drop("_seq")
    return out


def update_assets(assets: DataFrame, query: Query, values: Mapping[str, Any]) -> DataFrame:
    """Sets constants on the matching rows; keys that are no column go to props."""
    match = predicate(assets, query)
    out = assets
    for key, value in values.items():
        if key in assets.columns:
            out = out.withColumn(key, F.when(match, F.lit(value).cast(assets.schema[key].dataType)).otherwise(F.col(key)))
        elif "props" in assets.columns:
            props = F.coalesce(F.col("props"), F.create_map().cast("map<string,string>"))
            out = out.withColumn("props", F.when(match, F.map_concat(F.map_filter(props, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(str(value))))).otherwise(F.col("props")))
        else:
            out = out.withColumn(key, F.when(match, F.lit(value)))
    return out
