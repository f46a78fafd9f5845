"""Duplicates hidden by formatting differences.

The records' values are dictionary-encoded. A value is canonicalised where it is read, once per worker, and known from
then on by 128 bits of its canonical form, so texts are never shuffled. All distinct entries (type, field, value) make
one dictionary, in which each has an integer identifier; entries of a single record are left out with their records,
which have no copies. The other records are rewritten as sorted tuples of their entries' identifiers, and equal tuples
are grouped and counted. Plain text has one field, a Json object one per member.
"""

from __future__ import annotations

import hashlib
import json
import re
from json.decoder import scanstring

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from sitegrove.functions.content import content_of, undecoded
from sitegrove.llm.grammars.markup import _constant
from sitegrove.operators.skew import HOT_ROWS, hot_keys, replicate, spread
from sitegrove.session import cut
from sitegrove.sources.tables import holding

#: Values that a worker remembers.
REMEMBER = 200_000

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def reduced(text: str) -> str:
    """Letters and digits of the text in lower case."""
    return _OTHER.sub("", text.lower())


def _number(literal: str) -> tuple[str, str]:
    return ("n", repr(float(literal)))


_DECODER = json.JSONDecoder(parse_int=lambda s: ("n", s), parse_float=_number, parse_constant=_constant, object_pairs_hook=lambda pairs: ("o", pairs))
_SPACE, _NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_LITERALS = {"t": ("true", "cTrue"), "f": ("false", "cFalse"), "n": ("null", "cNone")}


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Canonical:
    """Canonical forms of the values that a worker has seen, as 128-bit digests; each value is canonicalised once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], bytes] = {}

    def text(self, value: str, mark: str = "s") -> bytes:
        """Of a string (s), a member's name (k), or anything else as it is (v)."""
        found = self.known.get((mark, value))
        if found is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            found = self.known[mark, value] = _digest((value if mark == "v" else mark + reduced(value)).encode("utf-8", "surrogatepass"))
        return found

    @staticmethod
    def object(members: list[tuple[bytes, bytes]]) -> bytes:
        return _digest(b"o" + b"".join(k + v for k, v in sorted(members)))

    @staticmethod
    def list(values: list[bytes]) -> bytes:
        return _digest(b"a" + b"".join(values))

    def value(self, node: object) -> bytes:
        """Of a value as _DECODER gives it."""
        if isinstance(node, str):
            return self.text(node)
        if isinstance(node, tuple) and node[0] == "o":
            return self.object([(self.text(k, "k"), self.value(v)) for k, v in node[1]])
        if isinstance(node, list):
            return self.list([self.value(v) for v in node])
        return self.text(f"n{node[1]}" if isinstance(node, tuple) else f"c{node}", "v")

    def members(self, text: str) -> list[tuple[bytes, bytes]]:
        """The fields of a Json text: the members of the outermost object, else one field without name."""
        try:
            node = _DECODER.decode(text)
            if isinstance(node, tuple) and node[0] == "o" and node[1]:
                return [(self.text(k, "k"), self.value(v)) for k, v in node[1]]
            return [(b"", self.value(node))]
        except RecursionError:
            return self.nested(text)

    def nested(self, text: str) -> list[tuple[bytes, bytes]]:
        """As `members`, with a stack of its own instead of recursion, for texts of any depth."""

        def skipped(at: int) -> int:
            return _SPACE.match(text, at).end()

        def name(at: int) -> tuple[bytes, int]:
            if text[at : at + 1] != '"':
                raise ValueError("a name is missing")
            found, end = scanstring(text, at + 1, True)
            end = skipped(end)
            if text[end : end + 1] != ":":
                raise ValueError("a colon is missing")
            return self.text(found, "k"), skipped(end + 1)

        # Open containers: whether it is an object, its members or values so far, and the name that waits for its value.
        stack: list[list] = []
        at = skipped(0)
        while True:
            c = text[at : at + 1]
            if c in ("{", "["):
                end = skipped(at + 1)
                closed = text[end : end + 1] == ("}" if c == "{" else "]")
                if not closed:
                    stack.append([c == "{", [], None])
                    at = end
                    if c == "{":
                        stack[-1][2], at = name(at)
                    continue
                value, at = (self.object([]) if c == "{" else self.list([])), end + 1
            elif c == '"':
                found, at = scanstring(text, at + 1, True)
                value = self.text(found)
            elif c in _LITERALS and text.startswith(_LITERALS[c][0], at):
                value, at = self.text(_LITERALS[c][1], "v"), at + len(_LITERALS[c][0])
            else:
                m = _NUMBER.match(text, at)
                if m is None:
                    raise ValueError("a value is missing")
                value, at = self.text(f"n{_number(m.group())[1] if m[2] or m[3] else m.group()}", "v"), m.end()
            while True:
                at = skipped(at)
                if not stack:
                    if at < len(text):
                        raise ValueError("more follows")
                    return [(b"", value)]
                is_object, parts, waiting = stack[-1]
                parts.append((waiting, value) if is_object else value)
                c = text[at : at + 1]
                if c == ",":
                    at = skipped(at + 1)
                    if is_object:
                        stack[-1][2], at = name(at)
                    break
                if c != ("}" if is_object else "]"):
                    raise ValueError("a container isn't closed")
                stack.pop()
                at = skipped(at + 1)
                if is_object and not stack:
                    if at < len(text):
                        raise ValueError("more follows")
                    return parts
                value = self.object(parts) if is_object else self.list(parts)


def record_fields(kind: str, text: str, values: Canonical) -> list[tuple[bytes, bytes]] | None:
    """(field, value) of a record in canonical form, None if nothing is left of it. Only Json has several fields."""
    rest = reduced(text)
    if not rest:
        return None
    if kind == "Json":
        try:
            return values.members(text)
        except ValueError:
            pass
    return [(b"text", _digest(b"s" + rest.encode("utf-8", "surrogatepass")))]


@F.pandas_udf(ArrayType(BinaryType()))
def _entries(kind: pd.Series, text: pd.Series, raw: pd.Series, encoding: pd.Series) -> pd.Series:
    """The dictionary entries of each record: type, field and value in one."""
    values, seen, out = Canonical(), {}, []
    for k, t, r, e in zip(kind, text, raw, encoding):
        whole = content_of(t, r, e)
        if whole is None or k is None:
            out.append(None)
            continue
        if (k, whole) not in seen:
            fields = record_fields(k, whole, values)
            seen[k, whole] = None if fields is None else sorted(_digest(k.encode() + b"|" + f + v) for f, v in fields)
        out.append(seen[k, whole])
    return pd.Series(out, dtype=object)


def format_copies(assets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, type, keeper (smallest id of its set) and copies (assets in the set) for every asset in a set of two or more.

    The fields' canonical values of all records form one dictionary, counted before any join: an entry is a type, a field
    and a value, and has an integer identifier. A record with an entry of its own has no copies and is left out there;
    the others are rewritten as sorted tuples of their entries' identifiers, and equal tuples are one set.

    Each asset counts by its holding row. Contents that are null or without letters and digits, and null types, belong
    to no set. Equal texts are copies too. Entries and sets above `hot_rows` are spread over several tasks when they are
    joined back.
    """
    coded = assets.select("id", "ingested_at", "type", _entries(F.col("type"), F.col("text"), undecoded(), F.col("encoding")).alias("entries"))
    kept = cut(holding(coded, "type", "entries").where(F.col("entries").isNotNull()))
    entries = kept.select("id", F.explode(F.array_distinct("entries")).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Identifiers must not change when a task is run again, so the dictionary is written before they are used.
    dictionary = cut(entries.select("entry", "n", F.monotonically_increasing_id().alias("number")))
    hot = hot_keys(dictionary, "entry", hot_rows=hot_rows)
    fields = spread(kept.select("id", "type", F.size("entries").alias("width"), F.explode("entries").alias("entry")), "entry", F.col("id"), hot)
    numbered = fields.join(replicate(dictionary.select("entry", "number"), "entry", hot), ["entry", "_part"])
    tuples = numbered.groupBy("id", "type", "width").agg(F.sort_array(F.collect_list("number")).alias("tuple"))
    members = cut(tuples.where(F.size("tuple") == F.col("width")).select("id", "type", "tuple"))
    sets = members.groupBy("tuple").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    hot_sets = hot_keys(sets, "tuple", "copies", hot_rows)
    return spread(members, "tuple", F.col("id"), hot_sets).join(replicate(sets, "tuple", hot_sets), ["tuple", "_part"]).select("id", "type", "keeper", "copies")


def collapse(copies: DataFrame) -> DataFrame:
    """One row per set: type, keeper and the number of assets that it stands for."""
    return copies.where(F.col("id") == F.col("keeper")).select("type", "keeper", "copies")
