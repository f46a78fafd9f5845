"""Source files that do not parse.

Every file is ranked by the tokens typical of each language and then parsed against all supported grammars in that
order; the parsers stop at the first error, so a foreign grammar costs little. A file that its own grammar refuses and
another accepts has the wrong extension; one that all refuse is corrupt (cut off, merge conflict, mixed).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sitegrove.functions.content import content_of, undecoded
from sitegrove.llm.grammars import accepts
from sitegrove.sources.tables import holding

#: The grammar of each judged asset type, and of those whose empty content is valid.
GRAMMARS = {"JavaScript": "JavaScript", "Css": "Css", "Json": "Json", "Svg": "Xml", "Atom": "Xml"}
#: Tokens that speak for a language, with their weight.
SIGNS = {
    "JavaScript": (re.compile(r"\b(?:const|let|var|function|return|import|export|typeof|new|await|class)\b|=>|===|\);"), 2.0),
    "Css": (re.compile(r"[{;]\s*[a-z-]+\s*:\s*[^;{}\"]+;|@(?:media|import|font-face|charset|keyframes)\b|[.#][\w-]+\s*\{"), 3.0),
    "Json": (re.compile(r"[{,]\s*\"[^\"\\]*\"\s*:|\b(?:true|false|null)\b\s*[,}\]]"), 2.5),
    "Xml": (re.compile(r"</[\w:]+\s*>|<[\w:]+(?:\s[^<>]*)?/>|<\?xml\b|<!\[CDATA\["), 3.0),
}
VERDICT = StructType().add("verdict", StringType()).add("language", StringType())


def ranking(text: str) -> list[str]:
    """The grammars, most likely first, by counts of typical tokens over the whole text; ties keep the order of SIGNS."""
    scores = {name: weight * sum(1 for _ in sign.finditer(text)) for name, (sign, weight) in SIGNS.items()}
    return sorted(scores, key=lambda name: -scores[name])


def judge(type_: str, text: str) -> tuple[str, str]:
    """('valid' | 'wrong extension' | 'corrupt', language): the language that parses, else the likeliest."""
    own, order = GRAMMARS[type_], ranking(text)
    if not text.strip("﻿ \t\r\n"):
        return "valid" if own in ("JavaScript", "Css") else "corrupt", own
    parsed = [name for name in order if accepts[name](text)]
    if own in parsed:
        return "valid", own
    return ("wrong extension", parsed[0]) if parsed else ("corrupt", order[0])


@F.pandas_udf(VERDICT)
def _judge(type_: pd.Series, text: pd.Series, raw: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    out = []
    for kind, t, r, e in zip(type_, text, raw, encoding):
        whole = content_of(t, r, e) if kind in GRAMMARS else None
        out.append((None, None) if whole is None else judge(kind, whole))
    return pd.DataFrame(out, columns=["verdict", "language"], dtype=object)


def parse_verdicts(assets: DataFrame) -> DataFrame:
    """id, type, site_id, verdict, language of each judged asset (holding row, content not null, type in GRAMMARS).

    Texts stay in the map stage: only the verdict is shuffled to choose the holding row. Types that aren't judged, null
    types and null contents give no row; an empty content is valid JavaScript and Css and else corrupt. Ties of
    ingested_at are equal rows. Extra columns are ignored.
    """
    judged = F.col("type").isin(*GRAMMARS)
    texts = F.when(judged, F.col("text"))
    verdicts = assets.select("id", "ingested_at", "type", "site_id", _judge(F.col("type"), texts, F.when(judged, undecoded()), F.col("encoding")).alias("v"))
    kept = holding(verdicts.select("id", "ingested_at", "type", "site_id", "v.verdict", "v.language"), "type", "site_id", "verdict", "language")
    return kept.where(F.col("verdict").isNotNull())


def parse_rates(verdicts: DataFrame, sites: DataFrame) -> DataFrame:
    """Judged and failed files per repository and type; assets of unknown sites count under a null repo."""
    repos = sites.select("site_id", "repo").dropDuplicates(["site_id"])
    per_site = verdicts.groupBy("site_id", "type").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(F.col("verdict") == "wrong extension").alias("wrong_extension"), F.count_if(F.col("verdict") == "corrupt").alias("corrupt")
    )
    sums = per_site.join(repos, "site_id", "left").groupBy("repo", "type").agg(*[F.sum(c).alias(c) for c in ("judged", "wrong_extension", "corrupt")])
    return sums.withColumn("rate", F.round((F.col("wrong_extension") + F.col("corrupt")) / F.col("judged"), 6))
