"""Joins that survive hot keys: the few heaviest keys are spread over several tasks, all others join as usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that are ever treated as hot; with the counts sorted, every other key has under 1 / HOT_KEYS of all rows, less
#: than a task's share on a thousand executors.
HOT_KEYS = 4096
#: Rows from which a key is worth spreading, and the number of parts.
HOT_ROWS = 200_000
PARTS = 32


def hot_keys(counts: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The at most HOT_KEYS keys with most rows among those of at least `hot_rows`; bounded, so safe to broadcast."""
    return counts.where(F.col(n) >= hot_rows).orderBy(F.col(n).desc(), F.col(key)).limit(HOT_KEYS).select(F.col(key).alias("_hot"))


def spread(rows: DataFrame, key: str, by: Column, hot: DataFrame, parts: int = PARTS) -> DataFrame:
    """Adds `_part`: 0, or for hot keys one of `parts` numbers chosen by the hash of `by`."""
    marked = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left")
    return marked.withColumn("_part", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))).drop("_hot")


def replicate(rows: DataFrame, key: str, hot: DataFrame, parts: int = PARTS) -> DataFrame:
    """The other side of `spread`: rows of hot keys once per part, all others once."""
    marked = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left")
    numbers = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    return marked.withColumn("_part", F.explode(numbers)).drop("_hot")
