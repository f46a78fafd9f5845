"""Filling fixed-capacity containers: sum-of-squares packing.

A document goes where the squared counts of open containers per residual gap sum to least afterwards. Documents are
dealt to independent packers by the hash of their id, so a hot source is spread evenly; a packer keeps one count per gap
and open containers by gap, never all containers. What the packers leave in badly filled containers is packed once more
by fewer packers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from sitegrove.session import cut

#: Items of one packer.
PACK_ROWS = 100_000
#: Containers filled less than this are opened again in the second round.
REPACK_BELOW = 0.98
#: Python's white space as a Java and RE2 class.
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"

PACKED = StructType().add("doc_id", LongType()).add("part", IntegerType()).add("tokens", IntegerType()).add("container", StringType()).add("used", IntegerType()).add("whole", BooleanType())


def word_punct_tokens(text: Column) -> Column:
    """Number of WordPunct tokens, counted in the JVM over the whole text."""
    return F.regexp_count(text, F.lit(WORD_PUNCT))


class SumOfSquares:
    """Packs sizes from 1 to `capacity` one by one; `place` returns the container's number."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; gap 0 is closed
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def place(self, size: int) -> int:
        capacity, counts = self.capacity, self.counts
        # Taking a container of gap g to gap g - size changes the sum by 2 (counts[g - size] - counts[g]) + 2; a new one by
        # 2 counts[capacity - size] + 1; closing one (g = size) by 1 - 2 counts[size].
        before, after = counts[size:], counts[: capacity - size + 1]
        change = 2 * (after - before) + 2
        change[0] = 1 - 2 * before[0]
        change[before == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        fresh = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = best + size
            number = self.open[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, len(self.used)
            self.used.append(0)
        self.used[number] += size
        left = gap - size
        if left:
            counts[left] += 1
            self.open[left].append(number)
        return number


def _packer(capacity: int, prefix: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "part"], kind="stable")
        packer = SumOfSquares(capacity)
        numbers = [packer.place(int(n)) for n in rows["tokens"]]
        used = np.array(packer.used or [0], dtype=np.int64)
        group = rows["packer"].iloc[0]
        return pd.DataFrame({"doc_id": rows["doc_id"], "part": rows["part"], "tokens": rows["tokens"], "container": [f"{prefix}{group}-{n}" for n in numbers], "used": used[numbers], "whole": rows["whole"]})

    return pack


def pack_documents(documents: DataFrame, capacity: int | None, pack_rows: int = PACK_ROWS) -> DataFrame:
    """doc_id, part, tokens, container, used (tokens in the container) and whole (the document is undivided).

    Only documents with more tokens than the capacity are divided: into full containers and one rest, which is packed
    like any document. Null and empty texts have no tokens and get no row, nor
    have documents without doc_id. Repeated doc_ids are items of their own. Without a capacity (None, no limit is set)
    there are no containers and the result is empty.
    """
    if capacity is None:
        return documents.sparkSession.createDataFrame([], PACKED)
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    counted = documents.select("doc_id", word_punct_tokens(F.col("text")).alias("n")).where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    n = F.col("n")
    parts = F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1)
    items = counted.select("doc_id", (n <= capacity).alias("whole"), n, F.explode(parts).alias("part")).select("doc_id", "part", "whole", F.least(n - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    items = cut(items)
    full = items.where(F.col("tokens") == capacity).select("doc_id", "part", "tokens", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), F.col("tokens").alias("used"), "whole")
    rest = items.where(F.col("tokens") < capacity)
    first = cut(_round(rest, capacity, math.ceil(rest.count() / pack_rows), "a"))
    good = F.col("used") >= REPACK_BELOW * capacity
    loose = first.where(~good).select("doc_id", "part", "whole", "tokens")
    second = _round(loose, capacity, math.ceil(loose.count() / pack_rows), "b")
    return full.unionByName(first.where(good)).unionByName(second)


def _round(items: DataFrame, capacity: int, packers: int, prefix: str) -> DataFrame:
    order = F.xxhash64("doc_id", "part")
    dealt = items.withColumn("order", order).withColumn("packer", F.pmod(F.xxhash64("doc_id", "part", F.lit(prefix)), F.lit(max(1, packers))).cast("int"))
    return dealt.groupBy("packer").applyInPandas(_packer(capacity, prefix), PACKED)


def oversized_documents(packed: DataFrame) -> DataFrame:
    """Documents that had to be divided."""
    return packed.where(~F.col("whole")).select("doc_id").distinct()


def containers(packed: DataFrame) -> DataFrame:
    """Items and tokens per container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("used"))
