"""Splitting oversized items at natural boundaries, by ranges with halos.

An item is covered by ranges of fixed length: byte ranges of files, which workers read by seeking, or stretches of the
content of a table cell, made where the cell is read. From then on no row holds a whole item. The worker of a range sees
it with a halo before it, long enough to find the boundary at which the range begins; the end of the range is the halo of
the next one, so both neighbours compute the same boundary from the same characters. Between the two it cuts pieces,
which are offsets only. These narrow tables of boundaries are stitched: the pieces and characters of the ranges before
are added up, within blocks of ranges and over the blocks, so no task sees all ranges of a giant item. In the end the
ranges are read once more, and each piece is emitted by its offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from sitegrove.functions.content import content_of, undecoded
from sitegrove.session import cut

#: Range length in pieces of the greatest size, ranges of a block of prefix sums, ranges of a batch.
RANGE_PIECES, BLOCK_RANGES, BATCH_RANGES = 64, 4096, 256
#: Places after which a text may be cut, best kind first. Nodes of a parse tree rank above them all.
KINDS = (
    ("block", re.compile(r"(?:\r?\n[ \t]*){2,}|[}\]>;][ \t]*\r?\n|</[\w:-]+>[ \t]*\r?\n")),
    ("line", re.compile(r"\r?\n|\r")),
    ("syntax", re.compile(r"</[\w:-]+>|[};>]|[.!?。！？][\"'”»)]*(?=\s)|[。！？]|,(?=\")")),
    ("word", re.compile(r"\s+|(?<=\w)(?=[^\w\s])|(?<=[^\w\s])(?=\w)")),
)
#: Of a range: its halo and text, whether it is the last, and the ends of nodes, by their offset from its first character.
RANGE = StructType().add("_number", LongType()).add("_last", BooleanType()).add("_left", StringType()).add("_body", StringType()).add("_nodes", ArrayType(LongType())).add("max_size", IntegerType()).add("overlap", IntegerType())
CUT = StructType().add("start", LongType()).add("end", LongType()).add("cut", StringType())


class Cutter:
    """Boundaries of one stretch of text; offsets are local to it. `nodes` are further cuts of the best kind."""

    def __init__(self, text: str, nodes: np.ndarray | None = None):
        self.text = text
        plausible = [] if nodes is None else [e for e in nodes if 0 < e < len(text) and not (text[e - 1].isalnum() and text[e].isalnum())]
        self.places = [("node", np.array(sorted(plausible), dtype=np.int64))]
        for name, pattern in KINDS:
            self.places.append((name, np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)))

    def best(self, low: int, high: int) -> tuple[int, str]:
        """The cut in (low, high]: the last boundary of the best kind in the upper half, else in all of it, else high."""
        for floor in (low + (high - low) // 2, low):
            for name, places in self.places:
                k = int(np.searchsorted(places, high, "right")) - 1
                if k >= 0 and places[k] > floor:
                    return int(places[k]), name
        text, at = self.text, high
        while low + 1 < at < len(text) and (_joins(text[at]) or (text[at] == "\n" and text[at - 1] == "\r")):
            at -= 1
        return (at if at > low + 1 or high == low + 1 else high), "hard"


def _joins(char: str) -> bool:
    """Combining marks, joiners and variation selectors stay with the character before them."""
    code = ord(char)
    return 0x300 <= code <= 0x36F or code in (0x200C, 0x200D) or 0xFE00 <= code <= 0xFE0F


def range_start(text: str, at: int, size: int, overlap: int, nodes: np.ndarray | None = None) -> tuple[int, str]:
    """Where the range that nominally begins at the local offset `at` begins, found in the `size` characters before it and
    nothing else, so that both neighbours find the same place."""
    low = max(at - size, 0)
    near = None if nodes is None else nodes[(nodes > low) & (nodes < at)] - low
    place, kind = Cutter(text[low:at], near).best(max(at - low - (size - overlap), 0), at - low)
    return low + place, kind


def cut_range(cutter: Cutter, begin: int, end: int, end_kind: str, first: bool, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of the pieces between two boundaries; all but the first piece of an item reach back."""
    out, at = [], begin
    while at < end:
        back = 0 if first and at == begin else overlap
        room = size - back
        low = at if back or not first else at + overlap  # or else the next piece would begin before the item
        cut, kind = (end, end_kind) if end - at <= room else cutter.best(low, at + room)
        out.append((at - back, cut, kind))
        at = cut
    return out


def cut_window(left: str, body: str, first: bool, last: bool, size: int, overlap: int, nodes: list[int] | None = None) -> list[tuple[int, int, str]]:
    """The pieces of a range, by offsets from its first character. `left` are the `size` characters before it."""
    text, o = left + body, len(left)
    ends = None if nodes is None else np.asarray(nodes, dtype=np.int64) + o
    b = 0 if first else range_start(text, o, size, overlap, ends)[0]
    e, kind = (len(text), "end") if last else range_start(text, len(text), size, overlap, ends)
    return [(a - o, z - o, c) for a, z, c in cut_range(Cutter(text, ends), b, e, kind, first, size, overlap)]


@F.pandas_udf(StructType().add("chars", LongType()).add("pieces", ArrayType(CUT)))
def _boundaries(number: pd.Series, last: pd.Series, left: pd.Series, body: pd.Series, nodes: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.DataFrame:
    rows = [(len(b), cut_window(l, b, k == 0, end, int(s), int(v), n)) for k, end, l, b, n, s, v in zip(number, last, left, body, nodes, size, overlap)]
    return pd.DataFrame(rows, columns=["chars", "pieces"])


@F.pandas_udf(ArrayType(StringType()))
def _texts(left: pd.Series, body: pd.Series, pieces: pd.Series) -> pd.Series:
    """The text of each piece, sliced from its range."""
    out = []
    for l, b, cuts in zip(left, body, pieces):
        text, o = l + b, len(l)
        out.append([text[p["start"] + o : p["end"] + o] for p in cuts])
    return pd.Series(out, dtype=object)


def boundaries(ranges: DataFrame, key: str) -> DataFrame:
    """The boundary table of the ranges, stitched: key, _number, pieces (offsets from the range), and how many pieces and
    characters come before the range. No text is in it. A range that was delivered twice counts once."""
    found = ranges.select(key, "_number", _boundaries("_number", "_last", "_left", "_body", "_nodes", "max_size", "overlap").alias("b"))
    narrow = cut(found.groupBy(key, "_number").agg(F.max("b").alias("b")).select(key, "_number", F.floor(F.col("_number") / BLOCK_RANGES).alias("_block"), "b.chars", F.size("b.pieces").alias("n"), "b.pieces"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)

    def running(column: str, over) -> F.Column:
        return F.coalesce(F.sum(column).over(over), F.lit(0))

    in_block, of_blocks = before.partitionBy(key, "_block").orderBy("_number"), before.partitionBy(key).orderBy("_block")
    within = narrow.select(key, "_block", "_number", running("n", in_block).alias("_n"), running("chars", in_block).alias("_chars"))
    blocks = narrow.groupBy(key, "_block").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    ahead = blocks.select(key, "_block", running("n", of_blocks).alias("_block_n"), running("chars", of_blocks).alias("_block_chars"))
    placed = within.join(ahead, [key, "_block"]).select(key, "_number", (F.col("_n") + F.col("_block_n")).alias("pieces_before"), (F.col("_chars") + F.col("_block_chars")).alias("chars_before"))
    return narrow.select(key, "_number", "pieces").join(placed, [key, "_number"])


def emitted(ranges: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The pieces with their texts: each range, read again, is cut at the offsets of the stitched boundary table."""
    once = ranges.select(key, "_number", "_left", "_body").dropDuplicates([key, "_number"])
    cuts = once.join(table, [key, "_number"]).select(key, "pieces_before", "chars_before", F.arrays_zip("pieces", _texts("_left", "_body", "pieces").alias("text")).alias("p"))
    rows = cuts.select(key, "pieces_before", "chars_before", F.posexplode("p").alias("_k", "p"))
    base = F.col("chars_before")
    return rows.select(key, (F.col("pieces_before") + F.col("_k")).alias("piece_no"), (F.col("p.pieces.start") + base).alias("start"), (F.col("p.pieces.end") + base).alias("end"), F.col("p.pieces.cut").alias("cut"), F.col("p.text").alias("text"))


def _limits(size: object, overlap: object) -> tuple[int, int] | None:
    """A usable limit and overlap; the overlap is at most one less than the limit. None where there is no limit."""
    if pd.isna(size) or size < 1:
        return None
    return int(size), min(max(0, 0 if pd.isna(overlap) else int(overlap)), int(size) - 1)


def text_ranges(items: DataFrame, keys: list[str], range_pieces: int = RANGE_PIECES) -> DataFrame:
    """The ranges of the items (`keys`, text, raw, encoding, max_size, overlap, node_ends) that exceed their limit.

    Narrow except for the text of the range and its halo; each content is gone through once, where it is read, and its
    ranges leave the task in small batches.
    """
    names = [*keys, *RANGE.names]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for *key, text, raw, encoding, size, overlap, ends in zip(*[batch[c] for c in [*keys, "text", "raw", "encoding", "max_size", "overlap", "node_ends"]]):
                content, limits = content_of(text, raw, encoding), _limits(size, overlap)
                if content is None or limits is None or len(content) <= limits[0]:
                    continue
                length = limits[0] * range_pieces
                nodes = None if ends is None else np.sort(np.array([e for e in ends if not pd.isna(e)], dtype=np.int64))
                for at in range(0, len(content), length):
                    low = max(at - limits[0], 0)
                    near = None if nodes is None else nodes[np.searchsorted(nodes, low, "right") : np.searchsorted(nodes, at + length, "right")] - at
                    rows.append((*key, at // length, at + length >= len(content), content[low:at], content[at : at + length], near, *limits))
                    if len(rows) >= BATCH_RANGES:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    schema = StructType([*(items.schema[k] for k in keys), *RANGE])
    return items.select(*keys, "text", "raw", "encoding", "max_size", "overlap", "node_ends").mapInPandas(work, schema)


def split_texts(items: DataFrame, key: str, range_pieces: int = RANGE_PIECES) -> DataFrame:
    """Pieces of the items that are longer than their limit.

    `items` has the `key`, content, max_size, overlap and node_ends (array of offsets or null); one row per key. Returns
    key, piece_no (from 0), start, end (exclusive, in code points), cut (kind of boundary at the end) and text. Every
    piece has at most max_size characters, each but the first begins `overlap` characters before the end of the one
    before, and without these the pieces are the content again. Items within their limit, null contents, limits that are
    null or below 1, and null keys give no rows. A null or negative overlap is 0, and one of max_size or more is max_size - 1.
    """
    rows = items.where(F.col(key).isNotNull()).select(key, F.col("content").alias("text"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("encoding"), "max_size", "overlap", "node_ends")
    ranges = text_ranges(rows, [key], range_pieces).repartition(key, "_number")
    return emitted(ranges, boundaries(ranges, key), key)


def asset_ranges(assets: DataFrame, limits: DataFrame, range_pieces: int = RANGE_PIECES) -> DataFrame:
    """The ranges of the assets whose content is longer than the limit of their type, by id, of the holding rows.

    Types without a row in `limits` have no limit, nor have rows without max_size; a null overlap is 0; two rows of one
    type count as the smaller. Which delivery holds is decided over ids and times alone. Ids whose latest deliveries
    differ, against the tables' rule, go by the greatest content hash.
    """
    bounds = limits.where(F.col("type").isNotNull() & F.col("max_size").isNotNull() & (F.col("target_table") == "assets")).groupBy("type").agg(F.min(F.struct("max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))).alias("l")).select("type", "l.max_size", "l.overlap")
    raw = undecoded()
    rows = assets.where(F.col("id").isNotNull()).select("id", "ingested_at", "type", "text", raw.alias("raw"), "encoding", F.transform("parse_tree", lambda p: p["end_char"]).alias("node_ends"))
    # Nothing decodes to more characters than it has bytes.
    long_ = rows.join(F.broadcast(bounds), "type").where((F.char_length("text") > F.col("max_size")) | (F.octet_length("raw") > F.col("max_size")))
    marked = long_.withColumn("_version", F.struct("ingested_at", F.xxhash64("text", "raw").alias("hash")))
    ranges = text_ranges(marked, ["id", "_version"], range_pieces)
    latest = assets.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("ingested_at").alias("_at"))
    suspects = marked.groupBy("id").agg(F.max("_version").alias("_version"))
    holds = suspects.join(latest, "id").where(F.col("_version.ingested_at").eqNullSafe(F.col("_at"))).select("id", "_version")
    return ranges.join(holds, ["id", "_version"]).drop("_version").repartition("id", "_number")


def split_assets(assets: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of all oversized assets, as split_texts gives them."""
    ranges = asset_ranges(assets, limits)
    return emitted(ranges, boundaries(ranges, "id"), "id")


def oversized_assets(assets: DataFrame, limits: DataFrame) -> DataFrame:
    """id, pieces and characters of each asset that has to be cut, by the stitched boundary table of its ranges."""
    table = boundaries(asset_ranges(assets, limits), "id")
    return table.groupBy("id").agg(F.sum(F.size("pieces")).alias("pieces"), F.max(F.col("chars_before") + F.element_at("pieces", -1)["end"]).alias("n_chars"))


def _opened(path: str) -> BinaryIO:
    """A file for reading by seeking, on whatever file system its url names."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def split_files(spark: SparkSession, paths: list[str], max_size: int, overlap: int, range_bytes: int | None = None) -> DataFrame:
    """Pieces of UTF-8 files: path, piece_no, start, end (in code points), cut and text, as split_texts gives them.

    Workers read byte ranges with a halo of four bytes a character by seeking; no file is read whole by anyone. Code
    points of the ranges before are added up for the offsets. Wrong bytes become U+FFFD. Paths are folders, files or
    globs of any file system that Spark and Arrow can both open; empty files give no rows; a file within the limit is one piece. An
    overlap of max_size or more is max_size - 1.
    """
    limits = _limits(max_size, overlap)
    length = range_bytes or RANGE_PIECES * max_size
    if limits is None or length < 4 * max_size:
        raise ValueError("max_size must be 1 or more, and a range longer than its halo")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length").where(F.col("length") > 0)
    tasks = files.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / length))))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, total, k in zip(batch["path"], batch["length"], batch["_number"]):
                with _opened(path) as f:
                    left, body, last = file_range(f, int(total), int(k), length, max_size)
                yield pd.DataFrame([(path, k, last, left, body, None, *limits)], columns=["path", *RANGE.names])

    ranges = tasks.repartition("path", "_number").mapInPandas(work, StructType([tasks.schema["path"], *RANGE]))
    return emitted(ranges, boundaries(ranges, "path"), "path")


def file_range(f: BinaryIO, total: int, k: int, length: int, size: int) -> tuple[str, str, bool]:
    """Of the k-th byte range of a file: the `size` characters before it, its text, and whether it is the last."""

    def snapped(at: int) -> int:
        """The first code point at or after the byte `at`."""
        if at <= 0 or at >= total:
            return max(0, min(at, total))
        f.seek(at)
        after = f.read(3)
        step = 0
        while step < len(after) and after[step] & 0xC0 == 0x80:
            step += 1
        return at + step

    def read(a: int, b: int) -> str:
        f.seek(a)
        return f.read(b - a).decode("utf-8", "replace")

    begin, end = snapped(k * length), snapped((k + 1) * length)
    return read(snapped(begin - 4 * size), begin)[-size:] if k else "", read(begin, end), end >= total
