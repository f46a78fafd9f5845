"""Aggregation, deduplication and checks over assets and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrove.functions.urls import extension
from sitegrove.schema import registry, type_of_content_type

#: Units of sizes.
_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def readable_size(n: Column) -> Column:
    """A size in bytes for people: units change at powers of 1000 and divide by powers of 1024."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(_UNITS[1:], 1):
        out = F.when(n >= 1000**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def stats(assets: DataFrame) -> DataFrame:
    """Count and bytes of non-inline, loaded assets that are no redirects, by type (else extension), with a total row.

    The total has a null kind. Assets without bytes count with size 0.
    """
    chosen = assets.where(F.col("url").isNotNull() & F.col("is_loaded") & ~F.coalesce("is_redirect", F.lit(False)))
    kind = F.coalesce("type", extension(F.col("url")), F.lit(""))
    return chosen.select(kind.alias("kind"), F.coalesce("last_known_byte_length", F.lit(0)).alias("n")).rollup("kind").agg(F.count(F.lit(1)).alias("assets"), F.sum("n").alias("bytes"))


def identical_survivors(assets: DataFrame) -> DataFrame:
    """id and survivor: the first asset in graph order with the same type and md5. Null hashes stay as they are."""
    known = assets.where(F.col("md5_hex").isNotNull())
    first = known.groupBy("type", "md5_hex").agg(F.min_by("id", F.struct("seq", "id")).alias("survivor"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    joined = known.join(first, (known["type"].eqNullSafe(first["type"])) & (known["md5_hex"] == first["md5_hex"]))
    return joined.select(known["id"], "survivor")


def merge_identical(assets: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets without the copies; relations that led to a copy lead to its survivor, doubled manifest entries are gone."""
    mapping = identical_survivors(assets)
    gone = mapping.where(F.col("id") != F.col("survivor"))
    kept = assets.join(gone.select("id"), "id", "left_anti")
    moved = relations.join(gone.select(F.col("id").alias("to_id"), "survivor"), "to_id", "left").withColumn("to_id", F.coalesce("survivor", "to_id")).drop("survivor")
    moved = moved.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    w = Window.partitionBy("from_id", "to_id", "type").orderBy("ord", "id")
    doubled = (F.col("type") == "CacheManifestEntry") & F.col("to_id").isNotNull()
    manifest = moved.where(doubled).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept, moved.where(~F.coalesce(doubled, F.lit(False))).unionByName(manifest)


def first_style_per_page(relations: DataFrame) -> DataFrame:
    """Relations without the second and later HtmlStyle from a page to the same target."""
    style = (F.col("type") == "HtmlStyle") & F.col("to_id").isNotNull()
    w = Window.partitionBy("from_id", "to_id").orderBy("ord", "id")
    first = relations.where(style).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return relations.where(~F.coalesce(style, F.lit(False))).unionByName(first)


def incompatible_types(assets: DataFrame, relations: DataFrame) -> DataFrame:
    """Diagnostics: assets whose incoming relations or content type expect types that don't agree with each other.

    The expected types of an asset are few (at most the registry), so they are collected as a set per asset; the pairs
    that disagree are looked up in a literal table. One row per asset and sorted pair.
    """
    names = sorted(registry.types)
    clashes = [f"{a}|{b}" for a in names for b in names if a < b and not registry.compatible(a, b)]
    expected = relations.where(F.col("to_id").isNotNull() & F.col("target_type").isNotNull()).select(F.col("to_id").alias("id"), F.col("target_type").alias("t"))
    own = assets.where(F.col("type").isNotNull() & ~F.col("type").isin("Asset")).select("id", F.col("type").alias("t"))
    sets = expected.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("ts")).where(F.size("ts") > 1)
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.concat(a, F.lit("|"), b))))
    found = sets.select("id", F.explode(pairs).alias("pair")).where(F.col("pair").isin(*clashes))
    message = F.concat(F.lit("used as both "), F.regexp_replace("pair", r"\|", " and "))
    return found.select(F.lit("warn").alias("severity"), F.lit("incompatible-types").alias("code"), F.col("id").alias("asset_id"), message.alias("message"))


def content_type_conflicts(assets: DataFrame, relations: DataFrame) -> DataFrame:
    """Diagnostics: assets that aren't redirected and whose Content-Type names another type than they are used as.

    The type of the content type must agree with the asset's own, and text/plain with the type that all relations into the
    asset expect (the first one's, in their order, if no other contradicts it), which must be Text then. Parameters of
    the content type don't count. Null content types and types give no row.
    """
    served = F.lower(F.trim(F.regexp_extract("content_type", r"^([^;]*)", 1)))
    plain = assets.where(F.col("content_type").isNotNull() & F.col("location").isNull() if "location" in assets.columns else F.col("content_type").isNotNull())
    typed = plain.select("id", "type", served.alias("_served"), type_of_content_type(F.col("content_type")).alias("_t"))
    names = sorted(registry.types)
    clashes = [f"{a}|{b}" for a in names for b in names if not registry.compatible(a, b)]
    own = typed.where(F.concat_ws("|", "type", "_t").isin(*clashes)).select("id", "_served", F.col("type").alias("_used"))
    wanted = relations.where(F.col("to_id").isNotNull() & F.col("target_type").isNotNull())
    expected = wanted.groupBy(F.col("to_id").alias("id")).agg(F.min_by("target_type", F.struct("ord", F.col("id"))).alias("_used"), F.collect_set("target_type").alias("_all"))
    agreed = expected.where((F.col("_used") != "Text") & ~F.exists("_all", lambda t: F.concat_ws("|", "_used", t).isin(*clashes)))
    text = typed.where(F.col("_served") == "text/plain").select("id", "_served").join(agreed.select("id", "_used"), "id")
    message = F.concat(F.lit("Asset served with a Content-Type of "), F.col("_served"), F.lit(", but used as "), F.col("_used"))
    return own.unionByName(text).distinct().select(F.lit("warn").alias("severity"), F.lit("content-type").alias("code"), F.col("id").alias("asset_id"), message.alias("message"))


def running_chunks(rows: DataFrame, key: str, order: str, weight: str, limit: int) -> DataFrame:
    """Adds `chunk`: a new one begins where the running sum of weights would pass the limit; the sum then starts again.

    The restart makes the sum depend on every cut before, so it is an aggregate over the ordered weights of one key.
    """
    items = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(weight).cast("long").alias("w")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["sum"] + x["w"] > limit) & (acc["sum"] > 0)
        chunk = F.when(over, acc["chunk"] + 1).otherwise(acc["chunk"])
        total = F.when(over, x["w"]).otherwise(acc["sum"] + x["w"])
        return F.struct(total.alias("sum"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    cut = items.select(key, "xs", F.aggregate("xs", start, step, lambda acc: acc["out"]).alias("chunks"))
    return cut.select(key, F.explode(F.arrays_zip("xs", "chunks")).alias("z")).select(key, F.col(f"z.xs.{order}").alias(order), F.col("z.xs.w").alias(weight), F.col("z.chunks").alias("chunk"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds `run`: the number of the run of equal consecutive values within the key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")
