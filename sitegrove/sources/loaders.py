"""Sources of assets: files, response tables, data: and javascript: urls, rows from memory."""

from __future__ import annotations

import base64
import binascii
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from sitegrove.functions.content import content
from sitegrove.functions.urls import extension, protocol, without_fragment
from sitegrove.schema import ASSETS, inferred_type, is_a, type_of_extension

#: Protocols that name no file to load, and are no mistake.
KNOWN_PROTOCOLS = "about: blob: callto: chrome: data: facetime: geo: git: intent: irc: javascript: magnet: mailto: maps: market: news: sip: skype: sms: ssh: steam: tel: urn: view-source: webcal: whatsapp: xmpp:".split()


def _as_assets(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ASSETS.fields])


def assets_from_files(spark: SparkSession, paths: str | list[str], root: str = "file:///", pattern: str | None = None) -> DataFrame:
    """One asset per file below the paths or globs: url, type by extension, bytes, and the text of textual types.

    The ids are hashes of the urls, seq their order. `pattern` is a glob on file names, applied by the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(paths).select(F.regexp_replace("path", r"^file:/+", "file:///").alias("url"), F.col("content").alias("raw_src"), F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"))
    typed = found.withColumn("type", F.coalesce(type_of_extension(extension(F.col("url"))), F.lit("Asset"))).withColumn("text", F.lit(None).cast("string")).withColumn("encoding", F.lit("utf-8"))
    text = F.when(is_a(F.col("type"), "Text"), content())
    return _as_assets(typed.withColumn("text", text).withColumn("id", F.md5("url")).withColumn("seq", F.xxhash64("url")).withColumn("is_initial", F.lit(True)))


def assets_from_responses(responses: DataFrame) -> DataFrame:
    """Assets from a table of http responses (url, status_code, content_type, location, raw_src or text ...).

    Urls lose their fragment; of responses of one url the one with the lowest seq holds. The type is given or inferred
    from content type and extension.
    """
    df = responses
    for name, kind in (("seq", "long"), ("content_type", "string"), ("target_type", "string"), ("type", "string"), ("raw_src", "binary"), ("text", "string"), ("encoding", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.withColumn("url", without_fragment(F.col("url"))).withColumn("seq", F.coalesce("seq", F.xxhash64("url")))
    df = df.withColumn("type", F.coalesce("type", inferred_type(F.col("content_type"), F.col("target_type"), extension(F.col("url"))), F.lit("Asset")))
    charset = F.regexp_extract("content_type", r"(?i)charset\s*=\s*[\"']?([^\"';\s]+)", 1)
    df = df.withColumn("encoding", F.coalesce("encoding", F.when(charset != "", charset)))
    df = df.withColumn("text", F.when(is_a(F.col("type"), "Text"), content()))
    first = df.withColumn("id", F.md5("url")).groupBy("id").agg(F.min_by(F.struct(*[c for c in df.columns]), "seq").alias("r")).select("id", "r.*")
    return _as_assets(first.withColumn("is_redirect", F.coalesce(F.col("status_code").isin(301, 302, 303, 307, 308), F.lit(False)) if "status_code" in first.columns else F.lit(False)))


DATA = StructType().add("content_type", StringType()).add("encoding", StringType()).add("raw_src", BinaryType())


def parse_data_url(url: str) -> tuple[str, str, bytes] | None:
    """(content type, charset, bytes) of a data: url; None if it isn't one. Defaults are text/plain and utf-8."""
    if url[:5].lower() != "data:" or "," not in url:
        return None
    head, _, body = url[5:].partition(",")
    parts = [p.strip() for p in head.split(";")]
    kind = parts[0].lower() or "text/plain"
    charset = next((p.partition("=")[2].strip("\"'") for p in parts[1:] if p.lower().startswith("charset=")), "utf-8")
    data = unquote_to_bytes(body)
    if any(p.lower() == "base64" for p in parts[1:]):
        try:
            data = base64.b64decode(b"".join(data.split()) + b"=" * (-len(data) % 4))
        except (binascii.Error, ValueError):
            return None
    return kind, charset, data


@F.pandas_udf(DATA)
def data_url_parts(url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None if u is None else parse_data_url(u)) or (None, None, None) for u in url], columns=["content_type", "encoding", "raw_src"], dtype=object)


def inline_targets(relations: DataFrame) -> DataFrame:
    """Inline assets behind the data: and javascript: hrefs of relations; their id is the relation's."""
    href = F.trim("href")
    data = relations.where(href.rlike("(?i)^data:")).select(F.col("id"), data_url_parts(href).alias("d"), "target_type").select("id", "d.*", "target_type").where(F.col("raw_src").isNotNull())
    data = data.withColumn("type", F.coalesce(inferred_type(F.col("content_type"), F.col("target_type"), F.lit("")), F.lit("Asset"))).withColumn("text", F.lit(None).cast("string"))
    data = data.withColumn("text", F.when(is_a(F.col("type"), "Text"), content()))
    script = relations.where(href.rlike("(?i)^javascript:")).select("id", F.lit("JavaScript").alias("type"), F.coalesce(F.try_url_decode(F.replace(F.substr(href, F.lit(12)), F.lit("+"), F.lit("%2B"))), F.substr(href, F.lit(12))).alias("text"))
    return _as_assets(data).unionByName(_as_assets(script))


def unsupported_protocols(relations: DataFrame) -> DataFrame:
    """Diagnostics: hrefs with a protocol that is neither loadable nor known."""
    kind = protocol(F.trim("href"))
    odd = relations.where(kind.isNotNull() & ~kind.isin("http:", "https:", "file:", *KNOWN_PROTOCOLS))
    return odd.select(F.lit("warn").alias("severity"), F.lit("protocol").alias("code"), F.col("from_id").alias("asset_id"), F.concat(F.lit("no loader for "), kind).alias("message")).distinct()


def protocol_support(relations: DataFrame) -> DataFrame:
    """protocol, n and support of the hrefs with a scheme: 'loaded', 'known' (left alone) or 'unsupported' (warned of)."""
    kind = protocol(F.trim("href"))
    support = F.when(kind.isin("http:", "https:", "file:", "data:", "javascript:"), "loaded").when(kind.isin(*KNOWN_PROTOCOLS), "known").otherwise("unsupported")
    return relations.where(kind.isNotNull()).groupBy(kind.alias("protocol"), support.alias("support")).agg(F.count(F.lit(1)).alias("n"))


def assets_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Assets from memory; missing columns are null, seq is the position."""
    names = ASSETS.names
    return spark.createDataFrame([tuple(({"seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)], ASSETS)
