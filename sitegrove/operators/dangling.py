"""References to records that do not exist.

A reference is (table_name, record_id, field_name, key, at): something that names the asset `key` and was made at `at`.
It dangles if no parent row of that key was alive at that time.

Plan: the references are reduced to distinct non-null keys with their first and last time (map-side combine, so a key
that holds a third of all rows leaves each task as one row). A left anti-join of these with the parent keys leaves the
keys that no single parent covers over the whole span: missing parents, and those that came later or were removed
earlier. Only references with such keys are joined back, and tested one by one by a second anti-join on key and time.
References by id and by url go through together; they and the doubtful keys are written once. The heaviest keys are
spread over parts in the join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrove.functions.urls import identity
from sitegrove.operators.skew import HOT_ROWS, hot_keys, replicate, spread
from sitegrove.session import cut
from sitegrove.sources.tables import holding

REFERENCE = ("table_name", "record_id", "field_name", "key", "at")


def dangling(references: DataFrame, parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references that no parent row (key, added_at, removed_at) covers.

    Null keys are no references. A null `at` is covered by no parent, so such a reference is returned. A parent without
    `added_at` is never alive; one without `removed_at` lives on. Repeated references stay repeated; several parents of
    one key are any of them. Empty tables give an empty result, or, for parents, all references. Extra columns are
    ignored.
    """
    refs = references.select(*REFERENCE).where(F.col("key").isNotNull())
    spans = parents.select("key", "added_at", "removed_at").where(F.col("key").isNotNull() & F.col("added_at").isNotNull())
    keys = refs.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("at").alias("timed"))
    cover = spans.select(F.col("key").alias("_key"), F.col("added_at").alias("_from"), F.col("removed_at").alias("_to"))
    suspects = keys.join(cover, (F.col("key") == F.col("_key")) & (F.col("_from") <= F.col("lo")) & (F.col("_to").isNull() | (F.col("hi") < F.col("_to"))) & (F.col("n") == F.col("timed")), "left_anti")
    suspects = cut(suspects.select("key", "n"))
    hot = hot_keys(suspects, "key", hot_rows=hot_rows)
    spread_refs = spread(refs, "key", F.col("record_id"), hot)
    spread_suspects = replicate(suspects.select("key"), "key", hot)
    doubtful = spread_refs.join(spread_suspects, ["key", "_part"], "left_semi")
    lives = replicate(cover, "_key", hot).withColumnRenamed("_part", "_life_part")
    covered = (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_life_part")) & (F.col("_from") <= F.col("at")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    return doubtful.join(lives, covered, "left_anti").select(*REFERENCE)


def id_references(relations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The references by id of the holding rows: from_id and to_id of relations, asset_id of diagnostics."""
    kept = holding(relations, "from_id", "to_id", "seen_at")
    fields = F.explode(F.array(F.struct(F.lit("from_id").alias("field_name"), F.col("from_id").alias("key")), F.struct(F.lit("to_id").alias("field_name"), F.col("to_id").alias("key"))))
    edges = kept.select("id", "seen_at", fields.alias("f")).select(F.lit("relations").alias("table_name"), F.col("id").alias("record_id"), "f.field_name", "f.key", F.col("seen_at").alias("at"))
    notes = holding(diagnostics, "asset_id", "raised_at").select(F.lit("diagnostics").alias("table_name"), F.col("id").alias("record_id"), F.lit("asset_id").alias("field_name"), F.col("asset_id").alias("key"), F.col("raised_at").alias("at"))
    return edges.unionByName(notes).where(F.col("key").isNotNull())


def href_references(relations: DataFrame, assets: DataFrame, sites: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references by href of the holding relations without to_id, resolved to the identity of a url of these sites.

    `assets` has one row per id. Hrefs that are null, empty, pure fragments, not resolvable or not on a host of `sites`
    are no references. The base is base_url, else the url of the source asset.
    """
    trimmed = F.trim(F.regexp_replace("href", r"^[\t\n\r\f\x0B ]+|[\t\n\r\f\x0B ]+$", ""))
    kept = holding(relations, "from_id", "to_id", "href", "base_url", "seen_at").where(F.col("to_id").isNull())
    kept = kept.withColumn("href", trimmed).where((F.col("href") != "") & ~F.col("href").startswith("#"))
    needs = F.col("base_url").isNull() & ~F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    without = kept.where(needs).drop("base_url")
    hot = hot_keys(without.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")), "from_id", hot_rows=hot_rows)
    urls = replicate(assets.where(F.col("url").isNotNull()).select(F.col("id").alias("from_id"), F.col("url").alias("base_url")), "from_id", hot)
    based = spread(without, "from_id", F.col("id"), hot).join(urls, ["from_id", "_part"], "left").drop("_part")
    all_hrefs = kept.where(~needs).unionByName(based)
    found = all_hrefs.select("id", "seen_at", identity(F.col("href"), F.col("base_url")).alias("r")).where(F.col("r.url").isNotNull())
    hosts = sites.select(F.lower("host").alias("_host")).where(F.col("_host").isNotNull()).distinct()
    refs = found.select("id", "seen_at", F.col("r.url").alias("key"), F.col("r.host").alias("_host")).join(hosts, "_host", "left_semi")
    return refs.select(F.lit("relations").alias("table_name"), F.col("id").alias("record_id"), F.lit("href").alias("field_name"), "key", F.col("seen_at").alias("at"))


def all_references(assets: DataFrame, relations: DataFrame, diagnostics: DataFrame, sites: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The references of both tables, written once, and the parents they may have. Keys are ids after a `#`, or urls."""
    kept = holding(assets, "url", "added_at", "removed_at")
    by_id = id_references(relations, diagnostics).withColumn("key", F.concat(F.lit("#"), "key"))
    refs = cut(by_id.unionByName(href_references(relations, kept, sites, hot_rows)))
    ids = kept.select(F.concat(F.lit("#"), "id").alias("key"), "added_at", "removed_at")
    urls = kept.where(F.col("url").isNotNull()).select(identity(F.col("url"), F.lit(None).cast("string"))["url"].alias("key"), "added_at", "removed_at")
    return refs, ids.unionByName(urls)


def dangling_references(assets: DataFrame, relations: DataFrame, diagnostics: DataFrame, sites: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every reference of relations and diagnostics to no asset alive then: REFERENCE columns, one row each."""
    refs, parents = all_references(assets, relations, diagnostics, sites, hot_rows)
    return dangling(refs, parents, hot_rows).withColumn("key", F.regexp_replace("key", "^#", ""))


def dangling_report(found: DataFrame, references: DataFrame) -> DataFrame:
    """Per table, field and month (null where the time is null) with any: dangling references, their keys, all references, and
    the rate."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    counts = found.groupBy("table_name", "field_name", month).agg(F.count(F.lit(1)).alias("dangling"), F.countDistinct("key").alias("keys"))
    totals = references.groupBy(F.col("table_name").alias("_t"), F.col("field_name").alias("_f"), month.alias("_m")).agg(F.count(F.lit(1)).alias("total"))
    same = (F.col("table_name") == F.col("_t")) & (F.col("field_name") == F.col("_f")) & F.col("month").eqNullSafe(F.col("_m"))
    return counts.join(totals, same).select("table_name", "field_name", "month", "dangling", "keys", "total", F.round(F.col("dangling") / F.col("total"), 6).alias("rate"))
