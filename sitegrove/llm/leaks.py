"""Evaluation texts leaking into training text: a BM25 index of the test items, queried by every training passage.

The test items (passages and answers of 13 words or more) form the index; blocks of items that fit a fixed number of
bytes are built into one index each, once per worker process, so the index never outgrows a worker. The query side is
every document, whole: its words are cut where a word is unknown to the index (no shared run can cross it), and the
remaining runs of 13 words or more are queried in short windows. Block-max WAND moves cursors over the posting lists: the
pivot is the first entry whose lists' greatest impacts reach the threshold together; if the greatest impacts within the
blocks around it don't, all cursors skip to the end of the nearest block. It returns all entries above a threshold that
loses nothing: an entry that shares 13 consecutive words has at least the least impact of each of them, so the threshold
is the least such sum over the window's 13-word runs; and at least the least score that any 13 consecutive words of the
entry itself have. Candidates are verified word by word, and the overlap with question and answer is reported.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

#: Consecutive words that make a leak, further words of a query, and bytes of items of an index.
RUN, QUERY_MORE, INDEX_BYTES = 13, 7, 32 << 20
#: BM25's parameters, postings of a block, windows whose candidates a worker remembers.
K1, B, BLOCK, REMEMBER = 1.2, 0.75, 64, 100_000
#: Beyond all entries.
END = 1 << 62
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
LEAK = StructType().add("doc_id", LongType()).add("item_id", IntegerType()).add("field", StringType()).add("shared_words", IntegerType()).add("question_seen", BooleanType()).add("answer_seen", BooleanType())


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC, without format characters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


class Index:
    """An inverted index of entries (item, field, words) with BM25 impacts in blocks."""

    def __init__(self, items: list[tuple[int, str | None, str | None, str | None]], run: int = RUN):
        self.run, self.entries = run, []
        self.question: dict[int, set[str]] = {}
        self.answer: dict[int, str] = {}
        for item, passage, question, answer in items:
            self.question[item], self.answer[item] = set(words(question)), " ".join(words(answer))
            for field, text in (("passage", passage), ("answer", answer)):
                found = words(text)
                if len(found) >= run:
                    self.entries.append((item, field, found))
        n = len(self.entries)
        df = Counter(w for _, _, found in self.entries for w in set(found))
        average = sum(len(found) for _, _, found in self.entries) / n if n else 1
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.grams: list[set[tuple[str, ...]]] = []
        self.least: list[float] = []
        for e, (_, _, found) in enumerate(self.entries):
            impact = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(found) / average)) for w, tf in Counter(found).items()}
            grams = {tuple(found[i : i + run]) for i in range(len(found) - run + 1)}
            self.grams.append(grams)
            self.least.append(min(sum(impact[w] for w in set(g)) for g in grams) * (1 - 1e-9))
            for w, x in impact.items():
                postings[w].append((e, x))
        # Per term: entries, impacts, the last entry and the greatest impact of each block of postings, the greatest of all.
        self.lists: dict[str, tuple[list[int], list[float], list[int], list[float], float]] = {}
        for w, p in postings.items():
            entries, impacts = [e for e, _ in p], [x for _, x in p]
            starts = range(0, len(p), BLOCK)
            self.lists[w] = entries, impacts, [entries[min(i + BLOCK, len(p)) - 1] for i in starts], [max(impacts[i : i + BLOCK]) for i in starts], max(impacts)
        self.lower = {w: min(x for _, x in p) for w, p in postings.items()}
        self.remembered: dict[tuple[str, ...], list[int]] = {}
        self.touched = 0

    def retrieve(self, query: set[str], threshold: float) -> list[tuple[int, float]]:
        """(entry, score) of all entries whose score for the query's words is at least `threshold`, by block-max WAND.

        `touched` counts the postings on which a cursor came to stand.
        """
        # A cursor: entry it stands on, position, and its term's list.
        cursors = [[self.lists[w][0][0], 0, *self.lists[w]] for w in query if w in self.lists]
        self.touched += len(cursors)
        out: list[tuple[int, float]] = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot_at = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[6]
                if bound >= threshold:
                    pivot_at = i
                    break
            if pivot_at < 0:
                break
            pivot = cursors[pivot_at][0]
            while pivot_at + 1 < len(cursors) and cursors[pivot_at + 1][0] == pivot:
                pivot_at += 1
            ahead = cursors[: pivot_at + 1]
            bound, block_end, exhausted = 0.0, END, False
            for c in ahead:
                k = bisect_left(c[4], pivot, c[1] // BLOCK)
                if k < len(c[4]):
                    bound += c[5][k]
                    block_end = min(block_end, c[4][k])
            if bound < threshold:
                target = block_end + 1 if block_end < END else END
                if pivot_at + 1 < len(cursors):
                    target = min(target, cursors[pivot_at + 1][0])
            elif ahead[0][0] == pivot:
                score = sum(c[3][c[1]] for c in ahead)
                if score >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in ahead:
                if c[0] < target:
                    at = bisect_left(c[2], target, c[1] + 1)
                    if at < len(c[2]):
                        c[0], c[1] = c[2][at], at
                        self.touched += 1
                    else:
                        c[0], exhausted = END, True
            if exhausted:
                cursors = [c for c in cursors if c[0] < END]
        return out

    def passages(self, found: list[str]) -> Iterator[list[str]]:
        """Runs of words that the index knows, if they are long enough for a leak."""
        run: list[str] = []
        known = self.lists
        for w in [*found, None]:
            if w is not None and w in known:
                run.append(w)
                continue
            if len(run) >= self.run:
                yield run
            run = []

    def candidates(self, passage: list[str]) -> set[int]:
        """Entries that may share a run with the passage. Its windows overlap by one word less than a run."""
        out: set[int] = set()
        lower, run = self.lower, self.run
        for i in range(0, max(1, len(passage) - run + 1), QUERY_MORE + 1):
            window = tuple(passage[i : i + run + QUERY_MORE])
            found = self.remembered.get(window)
            if found is None:
                threshold = min(sum(lower[w] for w in set(window[k : k + run])) for k in range(len(window) - run + 1)) * (1 - 1e-9)
                found = [e for e, score in self.retrieve(set(window), threshold) if score >= self.least[e]]
                if len(self.remembered) >= REMEMBER:
                    self.remembered.clear()
                self.remembered[window] = found
            out.update(found)
        return out

    def leaks(self, text: str | None) -> list[tuple[int, str, int, bool, bool]]:
        """(item, field, most shared consecutive words, question seen, answer seen) for each item and field that leaks."""
        found = words(text)
        best: dict[tuple[int, str], int] = {}
        for passage in self.passages(found):
            grams = [tuple(passage[i : i + self.run]) for i in range(len(passage) - self.run + 1)]
            for e in self.candidates(passage):
                longest = now = 0
                for g in grams:
                    now = now + 1 if g in self.grams[e] else 0
                    longest = max(longest, now)
                if longest:
                    key = self.entries[e][:2]
                    best[key] = max(best.get(key, 0), longest + self.run - 1)
        if not best:
            return []
        whole, joined = set(found), f" {' '.join(found)} "
        return [(item, field, n, bool(self.question[item]) and self.question[item] <= whole, bool(self.answer[item]) and f" {self.answer[item]} " in joined) for (item, field), n in best.items()]


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document, item and field (passage or answer) with at least `run` consecutive words in common.

    shared_words is the longest such run, question_seen whether all words of the question occur in the document,
    answer_seen whether the answer occurs in it. Null and empty texts have no words; rows without doc_id or item_id are
    left out; items with shorter passages and answers cannot leak; repeated items are reported once each; without items
    the result is empty. Items whose texts exceed `index_bytes` together are dealt to several indexes, each of which meets
    all documents; only the items of one index are sent to the workers at a time.
    """
    spark = documents.sparkSession
    columns = items.select("item_id", "passage", "question", "answer").where(F.col("item_id").isNotNull())
    size = F.coalesce(F.octet_length("passage"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + F.coalesce(F.octet_length("question"), F.lit(0))
    indexes = max(1, -(-(columns.agg(F.sum(size.cast("long")).alias("n")).first().n or 0) // index_bytes))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    out = None
    for b in range(indexes):
        dealt = columns.where(F.pmod(F.xxhash64("item_id"), F.lit(indexes)) == b) if indexes > 1 else columns
        shared = spark.sparkContext.broadcast([tuple(r) for r in dealt.toLocalIterator()])
        found = texts.mapInPandas(_searcher(shared, run, uuid.uuid4().hex), LEAK)
        out = found if out is None else out.unionByName(found)
    return out


_INDEXES: dict[str, Index] = {}


def _searcher(shared, run: int, token: str):
    """The search of one index, which a worker process builds once and keeps while it is in use."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[token] = Index(shared.value, run)
        index = _INDEXES[token]
        for batch in batches:
            rows = [(d, *leak) for d, t in zip(batch["doc_id"], batch["text"]) for leak in index.leaks(t)]
            yield pd.DataFrame(rows, columns=LEAK.names)

    return search
