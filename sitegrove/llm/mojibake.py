"""Garbled text from wrong character encodings: expectation-maximization over latent encoding chains.

A chain says how a word came to look as it does: its bytes, in encoding X, were read as Y, once or twice; or nothing
happened. Undoing a chain is a function of the word, so words decide between chains by the likelihood of what they would
have been (a character bigram model of the corpus itself) and by how usual the chain is in the source and field of the
record. Neither is known at first: expectation steps give every word its chains' posteriors, maximization steps take
from them the bigram counts of the undone words and the chain frequencies, pooled per source and field. Both are kept in
tables of fixed size (hashed), which is all that is ever sent around; words are counted before the first step.

Words are taken from the text as its reader sees it: character references and \\u and \\x escapes count as the characters
they stand for, since garbled text is often stored that way. A record is garbled if a word's posterior is against
"nothing happened", if it holds what only a wrong decoding leaves (U+FFFD, C1 controls, NUL), if UTF-7 was left undecoded
in a word that the corpus knows, or if its bytes, by its labels or otherwise, are the same text with letters where the
text has replacement marks. It is repaired from raw_src by the decoding that reads best, else word by word.
"""

from __future__ import annotations

import codecs
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from bisect import bisect_right
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from sitegrove.session import cut
from sitegrove.sources.tables import holding

#: Encodings in which texts are written, and as which bytes are taken by mistake.
WRITTEN = ("utf-8", "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "iso8859-7", "cp1254", "mac-roman", "cp437", "cp850", "cp866", "shift_jis", "euc_jp", "gbk", "euc_kr")
READ = (
    "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "iso8859-7", "mac-roman", "cp437", "cp866", "shift_jis", "euc_jp",
    "cp1257", "cp852", "iso8859-5", "mac-cyrillic", "gbk", "euc_kr", "big5",
)
TWICE = tuple((a, b) for a in ("cp1252", "latin-1", "cp1250", "mac-roman", "cp437") for b in ("cp1252", "latin-1", "cp1250", "mac-roman", "cp437"))
#: Chain 0 is "nothing happened"; the others name the readings from the last to the first, then the writing.
CHAINS = ((),) + tuple((y, x) for y in READ for x in WRITTEN if x != y and {x, y} != {"cp1252", "cp1254"}) + tuple((a, b, "utf-8") for a, b in TWICE)
#: Sizes of the hashed tables of character pairs and of pools, expectation steps, prior weight of a pool, prior of any damage, and the posterior needed.
BUCKETS, POOLS, STEPS, POOL_WEIGHT, DAMAGE, NEEDED = 1 << 18, 1 << 12, 3, 200.0, 0.02, 0.7
#: Least and greatest size of the hashed table of words; in between it has WORD_ROOM slots a distinct word. Beyond, a word
#: must be as many times as frequent as the average slot before it counts as known, so the table stays telling.
LEAST_WORDS, MOST_WORDS, WORD_ROOM, ABOVE_NOISE = 1 << 19, 1 << 22, 8, 4.0
#: Up to this share of its original's occurrences, a word may be nothing but its garbled form.
GARBLED_SHARE = 0.25
#: Words that a worker remembers; occurrences of a word that don't yet count as known; nats that a chain may lie behind
#: "nothing happened" by likelihood and still be weighed; occurrences of a word in one record that count.
REMEMBER, UNKNOWN, BEHIND, OCCURRENCES = 200_000, 5.0, 12.0, 5

WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7f\s]\xa0*[A-Za-z]*)+")
#: Marks that typography adds to words in any language; their price in nats.
_MARKS = re.compile("[\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026\u2022\u00ab\u00bb\u20ac\u00a9\u00ae\u2122\u00b0\u00a7\u00b7\u2192\ufeff]")
MARK = -4.6
LOST = re.compile("[�\x00\x80-\x84\x86-\x9f]")
#: Marks that stand for a character that an encoding couldn't store.
_SUBSTITUTES = "?\x1a_"
#: Ways to write a character in ASCII: references (once more escaped within feeds) and escapes of scripts and Json.
_WRITTEN_OUT = re.compile(r"&(?:amp;)*#(?:([0-9]{2,7})|[xX]([0-9A-Fa-f]{2,6}));|&([A-Za-z]{2,8}[0-9]{0,2});|(?<!\\)(?:\\\\)*\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
_UTF7 = re.compile(r"([A-Za-z]*)\+([A-Za-z0-9+/]{3,})-([A-Za-z]*)")
#: Java's pattern of the texts that can show any damage in themselves.
TELLING = r"[^\x00-\x7F]|\x00|&(?:amp;)*#|&[A-Za-z]{2,8}[0-9]{0,2};|\\[ux][0-9A-Fa-f]{2}|\+[A-Za-z0-9+/]{3,}-"


class View:
    """A text as its reader sees it: characters beyond ASCII that are written out as references or escapes are decoded."""

    def __init__(self, text: str):
        self.source, self.shown = text, text
        self.starts: list[int] = []
        if "&" not in text and "\\" not in text:
            return
        parts, at, length, spans = [], 0, 0, []
        for m in _WRITTEN_OUT.finditer(text):
            decimal, hexadecimal, name, short, byte = m.groups()
            code = int(decimal) if decimal else int(hexadecimal or short or byte, 16) if not name else name2codepoint.get(name, 0)
            if not 0x80 <= code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                continue
            begin = m.start() if m.group()[0] == "&" else m.end() - (6 if short else 4)
            parts += (text[at:begin], chr(code))
            length += begin - at + 1
            spans.append((length - 1, begin, m.end()))
            at = m.end()
        if spans:
            parts.append(text[at:])
            # A single reference to a C1 control is a habit of authors: browsers show the windows-1252 character.
            alone = [i for i, (_, b, e) in enumerate(spans) if text[b] == "&" and (i == 0 or spans[i - 1][2] != b) and (i + 1 == len(spans) or spans[i + 1][1] != e)]
            for i in alone:
                c = parts[2 * i + 1]
                if "\x80" <= c <= "\x9f":
                    parts[2 * i + 1] = c.encode("latin-1").decode("cp1252", "ignore") or c
            self.shown = "".join(parts)
            self.starts = [s for s, _, _ in spans]
            self.spans = spans

    def place(self, at: int) -> int:
        """The offset in the source of an offset in what is shown."""
        i = bisect_right(self.starts, at - 1)
        return at if i == 0 else self.spans[i - 1][2] + at - self.starts[i - 1] - 1

    def replaced(self, change: dict[str, str]) -> str:
        """The source with the shown words of `change` replaced; all other references and escapes stay."""
        if not change:
            return self.source
        parts, at = [], 0
        for m in WORD.finditer(self.shown):
            if m.group() in change:
                begin = self.place(m.start())
                parts += (self.source[at:begin], change[m.group()])
                at = self.place(m.end())
        return "".join([*parts, self.source[at:]])


def lost_letters(text: str, raw: bytes, labels: tuple[str | None, ...]) -> bool:
    """Whether the text is what the bytes say, but for letters that became marks of substitution."""
    if not any(c in text for c in _SUBSTITUTES) or raw.isascii():
        return False
    for encoding in dict.fromkeys([*labels, "utf-8", *WRITTEN]):
        try:
            decoded = raw.decode(encoding) if encoding else ""
        except (UnicodeError, ValueError, LookupError):
            continue
        if len(decoded) == len(text) and decoded != text and all(a == b or (a in _SUBSTITUTES and b > "\x7f") for a, b in zip(text, decoded)):
            return True
    return False


def _sloppy(text: str, encoding: str) -> bytes:
    """Bytes of a text that was read as `encoding`; bytes that it doesn't assign had become C1 controls."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1253", "cp1251") or not re.search("[\x80-\x9f]", text):
            raise
        return b"".join(bytes((ord(c),)) if "\x80" <= c <= "\x9f" else c.encode(encoding) for c in text)


def candidates(word: str) -> list[tuple[int, str]]:
    """(chain, original) for the chains that may have led to the word; chain 0 first. An original is named once."""
    out, seen = [(0, word)], {word}
    encoded: dict[str, bytes | None] = {}
    for k, chain in enumerate(CHAINS):
        if not chain:
            continue
        first = chain[0]
        if first not in encoded:
            try:
                encoded[first] = _sloppy(word, first)
            except (UnicodeError, ValueError):
                encoded[first] = None
        data = encoded[first]
        if data is None:
            continue
        try:
            original = data.decode(chain[1] if len(chain) == 2 else "utf-8")
            if len(chain) == 3:
                original = _sloppy(original, chain[1]).decode("utf-8")
        except (UnicodeError, ValueError):
            continue
        if original in seen:
            continue
        seen.add(original)
        if original.isprintable() and not LOST.search(original) and (len(original) < len(word) or any(c.isalpha() for c in original)):
            out.append((k, original))
    return out


def misread_utf16(text: str) -> str | None:
    """What a run of text was if its code units are really the bytes of UTF-8 (or mostly ASCII) text, else None.

    Genuine ideographs hardly ever spell UTF-8; kana would spell every other byte as a zero digit.
    """
    if len(text) < 6 or sum(c > "\u0200" for c in text) < 0.5 * len(text):
        return None
    for encoding in ("utf-16-le", "utf-16-be"):
        try:
            data = text.encode(encoding)
        except UnicodeError:
            continue
        while data and data[0] & 0xC0 == 0x80 and len(text) * 2 - len(data) < 3:
            data = data[1:]
        try:
            original = codecs.getincrementaldecoder("utf-8")().decode(data)
        except UnicodeError:
            original = data.decode("latin-1")
            if sum(c.isascii() and (c.isalpha() or c.isspace()) for c in original) < 0.6 * len(original):
                continue
        if all(c.isprintable() or c.isspace() for c in original) and original.count("0") < 0.3 * len(original) and sum(c.isalpha() or c.isspace() for c in original) >= 0.5 * len(original):
            return original
    return None


def _slot(a: int, b: int) -> int:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (b >> 7)) % BUCKETS


def _slots(word: str) -> list[tuple[int, int]]:
    """Buckets of (first character, pair) for each pair of a word with its ends."""
    codes = [2, *map(ord, word), 3]
    return [(_slot(1, a), _slot(a, b)) for a, b in zip(codes, codes[1:])]


def _word_slots(word: str) -> tuple[int, int]:
    """Two hashes of a word, whatever its case; their slots in the table of words follow from its size."""
    one, two = 7, 11
    for c in word.lower():
        one, two = (one * 131 + ord(c)) & 0xFFFFFFFF, (two * 257 + ord(c)) & 0xFFFFFFFF
    return one, two


class Model:
    """The word and bigram counts and the chain frequencies of each pool, as arrays of fixed size."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, used: np.ndarray):
        self.counts, self.words = counts, words
        self.seen = max(float(words.sum()) / 2, 1.0)
        self.unknown = max(UNKNOWN, ABOVE_NOISE * 2 * self.seen / len(words))
        self.pairs: dict[tuple[int, int], float] = {}
        base = np.full(len(CHAINS), DAMAGE / (len(CHAINS) - 1))
        base[0] = 1 - DAMAGE
        total = used.sum(axis=0) + 100 * base
        overall = total / total.sum()
        self.prior = np.log((used + POOL_WEIGHT * overall) / (used.sum(axis=1, keepdims=True) + POOL_WEIGHT) + 1e-9).astype(np.float32)
        self.score_of: dict[str, list[tuple[int, str, float]]] = {}

    def likelihood(self, word: str, explained: float = 0.0) -> float:
        """Log likelihood: of what stands between typographic marks, with a fixed price for each mark. So many occurrences of
        the word are explained otherwise and don't make it known."""
        if _MARKS.search(word):
            parts = _MARKS.split(word)
            return (len(parts) - 1) * MARK + sum(self._likelihood(p, self.count(p) - explained) for p in parts if p)
        return self._likelihood(word, self.count(word) - explained)

    def _likelihood(self, word: str, occurrences: float) -> float:
        """As a known word if it is one, else by its pairs of characters."""
        out, pairs, a = 0.0, self.pairs, 2
        for b in (*map(ord, word), 3):
            x = pairs.get((a, b))
            if x is None:
                if len(pairs) >= REMEMBER:
                    pairs.clear()
                x = pairs[a, b] = math.log((self.counts[_slot(a, b)] + 1e-3) / (self.counts[_slot(1, a)] + 20.0))
            out += x
            a = b
        known = occurrences - self.unknown
        return max(out, math.log(known / self.seen)) if known > 0 else out

    def count(self, word: str) -> float:
        """Occurrences of the word, or somewhat more."""
        one, two = _word_slots(word)
        return float(min(self.words[one % len(self.words)], self.words[two % len(self.words)]))

    def scored(self, word: str) -> list[tuple[int, str, float]]:
        """(chain, original, log likelihood) of the chains worth weighing; chain 0 first, mostly alone.

        A word is known by its occurrences, but garbled words recur as well: those that its most frequent original would leave
        behind at a usual rate don't count, however large the corpus.
        """
        found = self.score_of.get(word)
        if found is None:
            if len(self.score_of) >= REMEMBER:
                self.score_of.clear()
            originals = candidates(word)[1:]
            explained = GARBLED_SHARE * max((self.count(o) for _, o in originals), default=0.0)
            itself = self.likelihood(word, explained)
            found = [(0, word, itself)]
            for k, original in originals:
                x = self.likelihood(original)
                if x > itself - BEHIND:
                    found.append((k, original, x))
            self.score_of[word] = found
        return found

    def posterior(self, word: str, prior: np.ndarray) -> list[tuple[int, str, float]]:
        found = self.scored(word)
        if len(found) == 1:
            return [(0, word, 1.0)]
        logs = [x + float(prior[k]) for k, _, x in found]
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
        total = sum(weights)
        return [(k, original, w / total) for (k, original, _), w in zip(found, weights)]

    def judge(self, text: str, pool: int) -> tuple[bool, list[tuple[str, str, int]]]:
        """Whether the text is garbled; the words to replace with their original and chain.

        The record is a pool of its own: its words' posteriors shift the chain frequencies once before the decision.
        """
        words = Counter(WORD.findall(View(text).shown))
        prior = self.prior[pool]
        unsure = [w for w in words if len(self.scored(w)) > 1]
        if unsure and len(words) > 1:
            own = np.zeros(len(CHAINS))
            own[0] = sum(min(words[w], OCCURRENCES) for w in words) - sum(min(words[w], OCCURRENCES) for w in unsure)
            for word in unsure:
                for k, _, p in self.posterior(word, prior):
                    own[k] += p * min(words[word], OCCURRENCES)
            share = own.sum() / (own.sum() + 10.0)
            prior = np.log((1 - share) * np.exp(prior) + share * own / max(own.sum(), 1e-9) + 1e-9)
        repairs = []
        for word in unsure:
            best = self.posterior(word, prior)
            if best[0][2] < 1 - NEEDED:
                k, original, _ = max(best[1:], key=lambda x: (x[2], x[1]))
                repairs.append((word, original, k))
        for word in words:
            original = misread_utf16(word)
            if original is not None:
                repairs = [r for r in repairs if r[0] != word] + [(word, original, 0)]
        return bool(repairs) or LOST.search(text) is not None or self.undecoded(text), repairs

    def undecoded(self, text: str) -> bool:
        """Whether UTF-7 was left in a word that is known when decoded."""
        for m in _UTF7.finditer(text):
            try:
                inside = f"+{m[2]}-".encode().decode("utf-7")
            except UnicodeError:
                continue
            if inside.isalpha() and not inside.isascii() and any(self.count(w) > self.unknown for w in WORD.findall(m[1] + inside + m[3])):
                return True
        return False


_MODELS: dict[str, Model] = {}


def _model(token: str, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    """The model of a step, kept with what it remembers between the tasks of a worker."""
    if token not in _MODELS:
        _MODELS.clear()
        _MODELS[token] = Model(*state)
    return _MODELS[token]


def _pool(source: object, field: object) -> int:
    out = 0
    for c in f"{source}|{field}":
        out = (out * 131 + ord(c)) & 0xFFFFFFFF
    return out % POOLS


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter[tuple[int, str]] = Counter()
        for source, field, text in zip(batch["source"], batch["field"], batch["text"]):
            pool = _pool(source, field)
            counts.update((pool, w) for w in set(WORD.findall(View(text).shown)))
        yield pd.DataFrame([(p, w, n) for (p, w), n in counts.items()], columns=["pool", "word", "n"])


STATISTIC = StructType().add("slot", LongType()).add("value", DoubleType())


def _step(shared, first: bool, token: str, slots: int):
    """Expectation over counted words: the statistics of the maximization step, summed per batch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None if first else _model(token, shared.value)
        for batch in batches:
            out: Counter[int] = Counter()
            for pool, word, n in zip(batch["pool"], batch["word"], batch["n"]):
                for k, original, p in [(0, word, 1.0)] if first else model.posterior(word, model.prior[pool]):
                    if p > 1e-4:
                        for one, two in _slots(original):
                            out[one] += p * n
                            out[two] += p * n
                        for slot in _word_slots(original):
                            out[BUCKETS + slot % slots] += p * n
                        if not first:
                            out[BUCKETS + slots + pool * len(CHAINS) + k] += p * n
            yield pd.DataFrame(list(out.items()), columns=["slot", "value"])

    return work


def _state(sums: pd.DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.zeros(BUCKETS + slots + POOLS * len(CHAINS), dtype=np.float32)
    flat[sums["slot"].to_numpy(dtype=np.int64)] = sums["value"].to_numpy(dtype=np.float32)
    return flat[:BUCKETS], flat[BUCKETS : BUCKETS + slots], flat[BUCKETS + slots :].reshape(POOLS, len(CHAINS))


def fit(texts: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's tables from all texts (source, field, text); what reaches the driver is bounded by MOST_WORDS."""
    spark = texts.sparkSession
    counted = texts.mapInPandas(_count_words, StructType().add("pool", LongType()).add("word", StringType()).add("n", LongType()))
    words = cut(counted.repartition("word").groupBy("word", "pool").agg(F.sum("n").alias("n")))
    slots = min(MOST_WORDS, max(LEAST_WORDS, 1 << (WORD_ROOM * words.count()).bit_length()))
    state = None
    for step in range(steps):
        shared = spark.sparkContext.broadcast(state)
        state = _state(words.mapInPandas(_step(shared, step == 0, uuid.uuid4().hex, slots), STATISTIC).groupBy("slot").agg(F.sum("value").alias("value")).toPandas(), slots)
    return state


def best_decoding(raw: bytes, model: Model) -> str | None:
    """The raw bytes by the encoding whose words are likeliest; None if none reads them without loss."""
    found: dict[str, float] = {}
    for encoding in WRITTEN:
        try:
            text = raw.decode(encoding)
        except (UnicodeError, ValueError):
            continue
        if text not in found and not LOST.search(text):
            words = Counter(WORD.findall(View(text).shown))
            found[text] = sum(n * model.likelihood(w) for w, n in words.items())
    return max(found, key=lambda t: found[t]) if found else None


def repaired(text: str, raw: bytes | None, repairs: list[tuple[str, str, int]], model: Model, pool: int) -> str | None:
    """The original text, from the bytes if they read cleanly, else by undoing words; None if something stays lost."""
    if raw is not None:
        restored = best_decoding(bytes(raw), model)
        if restored is not None:
            # Garbled before it was stored as these bytes: undo the words that still speak for a chain.
            _, again = model.judge(restored, pool)
            return View(restored).replaced({a: b for a, b, _ in again})
    if LOST.search(text) and any(LOST.search(w) and w not in {a for a, _, _ in repairs} for w in WORD.findall(text)):
        return None
    return View(text).replaced({a: b for a, b, _ in repairs})


VERDICT = StructType().add("garbled", BooleanType()).add("chain", StringType()).add("restored", StringType())


def garbled_records(records: DataFrame, source: str, field: str, steps: int = STEPS) -> DataFrame:
    """id, chain (most usual among the repaired words, null if lost) and restored text of the garbled holding rows.

    `records` has id, ingested_at, text, raw_src, encoding, content_type and the columns named by `source` and `field`.
    Null texts are never garbled, nor are ASCII texts that write out no other characters, hold no NUL and no UTF-7, and
    whose bytes have no letters for their marks of substitution. restored is null where text and raw_src no longer allow
    it. Null raw_src, labels, sources and fields are allowed. Ties of ingested_at are equal rows; an empty table gives an
    empty result.
    """
    telling = F.col("text").rlike(TELLING)
    state = fit(records.select(F.col(source).cast("string").alias("source"), F.col(field).cast("string").alias("field"), "text").where(telling), steps)
    shared, token = records.sparkSession.sparkContext.broadcast(state), uuid.uuid4().hex

    @F.pandas_udf(VERDICT)
    def verdict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = _model(token, shared.value)
        for batch in batches:
            rows = []
            for src, fld, text, raw, *labels in zip(*batch):
                if text is None:
                    rows.append((False, None, None))
                    continue
                pool = _pool(src, fld)
                found, repairs = model.judge(text, pool)
                found = found or (raw is not None and lost_letters(text, bytes(raw), tuple(labels)))
                chain = Counter(k for _, _, k in repairs).most_common(1)
                rows.append((found, ("<".join(CHAINS[chain[0][0]]) or "utf-16<utf-8") if chain else None, repaired(text, raw, repairs, model, pool) if found else None))
            yield pd.DataFrame(rows, columns=VERDICT.names)

    marked = F.col("text").rlike(r"[?_\x1A]") & F.col("raw_src").cast("string").rlike(r"[^\x00-\x7F]")
    judged_texts = F.coalesce(telling | marked, F.coalesce(telling, F.lit(False)))
    kept_text, raw = F.when(judged_texts, F.col("text")), F.when(judged_texts, F.col("raw_src"))
    charset = F.nullif(F.lower(F.regexp_extract("content_type", r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)), F.lit(""))
    judged = records.select("id", "ingested_at", verdict(F.col(source).cast("string"), F.col(field).cast("string"), kept_text, raw, F.lower(F.trim("encoding")), charset).alias("v"))
    kept = holding(judged.select("id", "ingested_at", "v.garbled", "v.chain", "v.restored"), "garbled", "chain", "restored")
    return kept.where("garbled").select("id", "chain", "restored")
