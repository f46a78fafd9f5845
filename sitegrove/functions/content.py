"""The content of an asset: its text, or its raw bytes decoded by their label where the type is textual."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Asset types whose raw bytes are text.
TEXT_TYPES = ("Html", "JavaScript", "Css", "Json", "Svg", "Atom", "Text")
#: Labels that Python's codecs spell differently.
LABELS = {"macintosh": "mac-roman", "x-mac-roman": "mac-roman", "x-sjis": "shift_jis", "windows-31j": "cp932", "x-cp1251": "cp1251"}


def decode(raw: bytes | None, label: str | None) -> str | None:
    """`raw` by the charset `label`; without a known label as UTF-8, else as windows-1252. Wrong bytes become U+FFFD."""
    if raw is None:
        return None
    raw = bytes(raw)
    name = (label or "").strip().strip("\"'").lower()
    try:
        codec = codecs.lookup(LABELS.get(name, name)).name if name else None
    except (LookupError, ValueError):
        codec = None
    if codec is not None:
        try:
            out = raw.decode(codec, "replace")
            return out if isinstance(out, str) else None
        except (LookupError, UnicodeError):
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def undecoded() -> Column:
    """raw_src where the content must come from it, else null: few bytes reach Python."""
    return F.when(F.col("text").isNull() & F.col("type").isin(*TEXT_TYPES), F.col("raw_src"))


def content_of(text: str | None, raw: bytes | None, encoding: str | None) -> str | None:
    """For use inside other functions over text, undecoded() and encoding."""
    return text if text is not None else decode(raw, encoding)


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else decode(r, e) for r, e in zip(raw, encoding)], dtype=object)


def content() -> Column:
    """The content as a column of an assets table."""
    return F.coalesce(F.col("text"), _decoded(undecoded(), F.col("encoding")))
