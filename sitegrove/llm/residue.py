"""Template residue and error-page text.

Three kinds of evidence are combined. (1) Placeholders left in running text: code, quotations and log lines are set aside
first. (2) The corpus: a document none of whose body's terms answers its address slug or title says nothing of its own
if each of its few sentences is, but for numbers and rare words, the whole of what documents of several hosts say, and
hardly ever stands within documents that say more; or if its body, however long, is the body of documents of several
hosts or of a notable share of one host's documents, and of as many documents as it has distinct terms. Sentences are
counted over all documents, alone and within others, per host. (3) Wording: blocks that say, in any of the listed
languages, that a page is missing, that scripts or cookies are needed, or that only stand in for text. Wording lets less
evidence of hosts suffice; without any, it counts only if nothing else is left of the body.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from sitegrove.operators.skew import hot_keys, replicate, spread
from sitegrove.session import cut

#: A body repeated in so many documents of so many hosts is a low-information response.
REPEATED_DOCS, REPEATED_HOSTS = 5, 3
#: On fewer hosts it must be in as many documents of one host, and in this share of them.
REPEATED_SHARE = 0.01
#: Most sentences of a bare response, and terms up to which a sentence tells little (beyond, it must be the response of as
#: many documents as it has terms); how many times more often a response stands alone than within more text; documents
#: and hosts that suffice beside wording.
RESPONSE_SENTENCES, LITTLE, DOMINANCE, THIN = 3, 20, 3, 2
#: A term is rare below this number of documents, and below this share of them, which bounds the list of the others.
RARE_DOCS, RARE_SHARE = 4, 2e-5
#: Longest block and sentence, in words, that may be a notice by its wording alone.
NOTICE_WORDS, SENTENCE_WORDS = 60, 18

_I = re.IGNORECASE


def _stems(items) -> set[str] | None:
    """Texts of which any match of a parsed pattern must hold one, in lower case; None if there is no such set."""
    best: set[str] | None = None
    run = ""
    options: list[set[str] | None] = []
    for op, value in [*items, (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            options.append({run})
            run = ""
        if op is re._constants.SUBPATTERN:
            options.append(_stems(value[3]))
        elif op is re._constants.BRANCH:
            inner = [_stems(branch) for branch in value[1]]
            options.append(None if any(i is None for i in inner) else set().union(*inner))
        elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0] > 0:
            options.append(_stems(value[2]))
    for option in options:
        if option and (best is None or min(map(len, option)) > min(map(len, best))):
            best = option
    return best


class Wording:
    """A large alternation without regard to case, tried only on texts that hold one of the stems it needs."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern, _I)
        self.stems = tuple(sorted(_stems(re._parser.parse(pattern, _I)) or ("",)))

    def search(self, text: str) -> re.Match | None:
        lower = text.lower()
        return self.pattern.search(text) if any(stem in lower for stem in self.stems) else None
#: Set aside: what shows or quotes a placeholder, but doesn't leave one.
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_TICKS = re.compile(r"`+")
_INDENTED = re.compile(r"(?:(?<=\n\n)|(?<=\r\n\r\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+")
_ASIDE = re.compile(r"<(!--|script\b|style\b|template\b|code\b|pre\b|kbd\b|samp\b)", _I)
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]|「[^「」\n]+」|(?<!\w)'[^'\n]+'(?!\w)")
_LOG = re.compile(r"^(?:\[?\d{4}-\d\d-\d\d[T ])?\[?\d\d:\d\d:\d\d\b.*$|^\S+ - - \[.*$", re.M)
_CITED = re.compile(r"^[ \t]*>.*$", re.M)
_NAME = r"[A-Za-z_][\w-]*"
_PATH = rf"{_NAME}(?:[.:]{_NAME})*"
#: Placeholders of common template languages, merge fields and hand-written forms.
PLACEHOLDERS = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?[\s#/^&!]*{_PATH}(?:\s*\|\s*{_PATH})*\s*\}}?\}}\}}",  # {{name}}, {{#a}}
            rf"[$#]\{{\s*{_PATH}\s*\}}",  # ${name}, #{name}
            rf"(?<![\w$#{{/\\])\{{\s?{_PATH}\s?\}}(?![}}/])",  # {name}
            rf"<%[=\-#]?\s*[^%<>\n]{{1,80}}%>|\{{%[=\-]?\s*[^%{{}}\n]{{1,80}}%\}}",  # <%= name %>, {% name %}
            rf"@@{_NAME}@@|\*\|{_PATH}\|\*|\[\[{_PATH}\|{_PATH}\]\]|\[%\s*{_PATH}\s*%\]",
            r"(?<![\w/.])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)|(?<![\w/.])__[a-z][a-z0-9]*_[a-z0-9_]*[a-z0-9]__(?![\w.(])",
            r"(?<![\w%/\\])%[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+%(?![\w/\\])|(?<![\w%/\\])%[A-Z]{3,}%(?![\w/\\])",
            r"(?<![\w$])\$[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\$(?![\w$])|(?<![\w$])\$[A-Z]{3,}\$(?![\w$])",
            r"(?i:\[\s*(?:insert|enter|add|type|your|replace)\s[^\[\]\n]{1,60}\](?!\())|(?i:\[[\w -]{2,40}\s(?:here|goes here)\](?!\())|(?i:\((?:insert|your)\s[^()\n]{1,40}\shere\))",
            r"(?i:<(?:your|insert|enter)[\s_-][^<>\n]{1,40}>)|<[A-Z]{2,}(?:[-_ ][A-Z]{2,})+>",
            r"(?<!\w)(?:[Xx]{4,})(?!\w)",
            r"(?<![\w])(?:TBD|TBC|TBA|tbd)(?=\s*:)|\[(?:TBD|TBC|TODO|FIXME)[^\]\n]*\](?!\()",
        )
    )
)
_MAYBE = re.compile(r"[{\[<%$@|]|__|[Xx]{4}|TB[DCA]|tbd")
_LOWER_TAG = re.compile(r"<([a-z]+(?:[-_][a-z]+)+)>")

#: Wording of notices and filler in the languages of the corpus, as word beginnings.
ERROR_WORDING = Wording(
    r"not be found|not found|could not be found|nothing at this address|no longer exists|introuvable|n['’]existe pas|no se ha encontrado|no se encontr|no encontrad|não (?:foi )?encontrad|nicht gefunden|wurde nicht gefunden|не найден|nie znalezion|nie została znaleziona|nebyla nalezena|nenalezen|δεν βρέθηκε|見つかりません|存在しません"
    r"|bad gateway|gateway time|internal server error|service (?:temporarily )?unavailable|temporarily unavailable|is unavailable|forbidden|access (?:is |was )?denied|permission denied|unauthori[sz]ed|accès (?:refusé|interdit)|acceso (?:denegado|prohibido)|acesso negado|zugriff (?:verweigert|wurde)|доступ (?:запрещ|закрыт|к )|odmowa dostępu|brak dostępu|dostęp zabroniony|přístup (?:odepřen|zamítnut)|δεν επιτρέπεται|απαγορεύεται|άρνηση πρόσβασης|アクセス(?:が|は)?(?:拒否|禁止|でき)|アクセスが拒否"
    r"|indisponible|no disponible|no está disponible|indisponível|nicht (?:verfügbar|erreichbar)|недоступ|niedostępn|nedostupn|δεν είναι διαθέσιμ|μη διαθέσιμ|利用できません|ご利用いただけません"
    r"|maintenance|wartung|mantenimiento|manutenção|техническ\w+ (?:работ|обслуж)|konserwac|prace techniczne|údržb|συντήρησ|メンテナンス"
    r"|too many requests|unusual (?:traffic|number)|rate limit|session has (?:expired|ended|timed)|session (?:expired|timed out)|log ?in again|sign ?in again|could not connect|unable to connect|can['’]t be reached|cannot be reached|refused to connect|connection (?:refused|timed out|was reset)|took too long|unable to (?:complete|process)|something went wrong|went wrong|uncaught exception|exception has occurred|application error|fatal error|stack ?trace|server error|database error|try again (?:later|in )|requête|demasiadas solicitudes|zu viele anfragen|muitas solicitações|слишком много запросов|sitzung ist abgelaufen|session a expiré|sesión ha caducado"
    r"|(?:error|erreur|erro|fehler|ошибка|błąd|chyba|σφάλμα|エラー)\s*(?:code\s*)?[:#(]?\s*[1-5]\d\d\b|\b(?:400|401|403|404|408|410|429|500|502|503|504)\b\s*[-–:.|]?\s*(?:error|fehler|erreur|page|not|bad|gateway|forbidden|server)|エラー|エラ-",
)
SCRIPT_WORDING = Wording(r"java ?script|\bscripts\b|\bscripting\b|\bcookies?\b|skript|скрипт|javascriptu?|σενάρι|スクリプト|クッキー|\bcookies\b|checking (?:your|if the site) |verify (?:that )?you are (?:a )?human|captcha")
SCRIPT_VERBS = Wording(
    r"enabl|turn on|allow|activat|require|need|must|support|disabled|switch(?:ed)? off|reload|solve|proceed|checking|activ|habilit|necesit|necesari|precisa|ative|aktivier|benötig|erforder|einschalt|erlaub|включ|разреш|требу|нуж|отключ|włącz|wymaga|obsług|povol|zapn|vyžaduj|nutn|ενεργοποι|απαιτ|χρειάζ|有効|必要|許可|オンに|autoris|nécessit|requis|requier|veuillez|permit",
)
FILLER_WORDING = Wording(
    r"^\W*lorem ipsum|dummy text|sample (?:text|paragraph|content)|placeholder (?:text|content)|filler text|some text goes here|text goes here|goes here\b|replace this (?:text|paragraph|sentence|content)|replace before|coming soon|content to follow|under construction|(?:überschrift|titel|text|inhalt) einfügen|folgt (?:später|in kürze)|hier (?:steht|kommt) (?:ein |der |noch |später )?(?:text|inhalt)|texto de (?:relleno|ejemplo|exemplo|preenchimento|amostra|teste)|texte (?:d['’]exemple|de remplissage|factice|provisoire)|faux texte|blindtext|beispieltext|platzhalter|fülltext|muster ?text|текст[- ](?:заполнитель|заглушка|рыба)|пример текста|образец текста|рыба-текст|tekst (?:przykładowy|zastępczy|wypełni)|przykładowy tekst|ukázkový text|výplňový text|zástupný text|vzorový text|κείμενο (?:κράτησης|υποκατάστα|δείγμα|πλήρωσης)|δείγμα κειμένου|ダミー|サンプル(?:テキスト|文)|仮のテキスト|仮テキスト|ここに(?:テキスト|本文|文章)|準備中|近日公開|próximamente|em breve|bientôt|demnächst|скоро (?:здесь|появ)|wkrótce|již brzy|σύντομα|asdf|qwert|test test|foo bar baz",
)
#: The vocabulary of the usual filler generators, without words that other languages share.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
    " nullam vitae arcu nisl tempus sapien feugiat aliquam tortor semper pharetra ultrices ultricies varius egestas lacinia lacus quisque porta dictum morbi tellus mauris vestibulum pellentesque habitant tristique senectus netus malesuada fames turpis vivamus luctus posuere curabitur maecenas suspendisse bibendum euismod faucibus interdum molestie sollicitudin sodales convallis fringilla hendrerit iaculis imperdiet laoreet ligula lobortis mattis metus neque nibh nunc odio orci purus rhoncus risus sagittis scelerisque tincidunt vehicula venenatis vulputate dapibus dignissim efficitur elementum facilisis fermentum finibus gravida integer justo leo libero phasellus placerat praesent proin quam rutrum sem tempor ullamcorper urna viverra volutpat".split()
)
_SPACELESS = r"\u3040-\u30ff\u3400-\u9fff"
_WORD = regex.compile(rf"[{_SPACELESS}]|[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{M}}\p{{N}}_'’]*[\p{{L}}\p{{N}}])?".replace("[\\p{L}\\p{N}_](", f"(?![{_SPACELESS}])[\\p{{L}}\\p{{N}}_]("))
_PLAIN_WORD, _CJK = re.compile(r"\w+(?:['’]+\w+)*"), re.compile(f"[{_SPACELESS}]")
#: The same words, without inner apostrophes, for Java.
JAVA_WORD = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[\p{L}\p{N}_&&[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}]]+"
#: Lines that surround a body: navigation, status and credits, single titles.
_CHROME = re.compile(r"^(?:[^|\n]{1,30}(?:\s\|\s[^|\n]{1,30})+|[^/\n]{1,30}(?:\s[/»›>]\s[^/\n]{1,30})+|(?:©|\(c\)|copyright\b|powered by\b|status\s*:|id\s|ref(?:erence)?\s*[.:#]|trace\s*:|request id|ray id|server\s*:)[^\n]{0,60}|[\w-]+/[\w.-]+|back|home|zurück|retour|volver|voltar|назад|wróć|zpět|πίσω|戻る)$", _I)
_SYNTAX = re.compile(r"^\w+(?:\.\w+)*\(.*\)$|^\w+: \w+$|^\$ |^--|^[+\-*] .*\(#\d+\)$|^#+ \d+\.\d+")
_LOREM = re.compile(r"^\W*lorem ipsum", _I | re.M)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n|(?<=。)")
_TITLE = re.compile(r"<title[^<>]*>([^<]*)</title>", _I)
_TAG = re.compile(r"<[^<>]*>")


def without_markup(text: str, tags: tuple[str, ...] = ("!--", "script", "style", "template", "code", "pre", "kbd", "samp")) -> str:
    """The text without comments and the elements that hold code; one that isn't closed stays. Linear in the text."""
    out, at, lower, unclosed = [], 0, text.lower(), set()
    if len(lower) != len(text):
        lower = text
    for m in _ASIDE.finditer(text):
        tag = m.group(1).lower()
        if m.start() < at or tag in unclosed or tag not in tags:
            continue
        close = "-->" if tag == "!--" else f"</{tag}"
        end = lower.find(close, m.end())
        if end < 0:
            unclosed.add(tag)
            continue
        after = text.find(">", end + len(close) - 1)
        out.append(text[at : m.start()])
        at = len(text) if after < 0 else after + 1
    return " ".join([*out, text[at:]]) if at else text


def without_inline_code(text: str) -> str:
    """The text without what stands between two equally long runs of backticks in one paragraph. Linear in the text."""
    runs = list(_TICKS.finditer(text))
    if len(runs) < 2:
        return text
    following: dict[int, int] = {}
    pairs = [0] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        size = runs[i].end() - runs[i].start()
        pairs[i] = following.get(size, -1)
        following[size] = i
    out, at, i = [], 0, 0
    paragraphs = [m.start() for m in re.finditer("\n\n", text)]
    while i < len(runs):
        j = pairs[i]
        if j > 0 and bisect_left(paragraphs, runs[i].end()) == bisect_left(paragraphs, runs[j].start()):
            out.append(text[at : runs[i].start()])
            at, i = runs[j].end(), j + 1
        else:
            i += 1
    return " ".join([*out, text[at:]])


def running_text(text: str) -> str:
    """The text without code, comments, quotations, cited and logged lines."""
    text = _INDENTED.sub(" ", _FENCE.sub(" ", without_markup(text)))
    text = without_inline_code(text)
    for pattern in (_LOG, _CITED, _QUOTED):
        text = pattern.sub(" ", text)
    return text


def placeholder(text: str) -> str | None:
    """The first placeholder left in the running text."""
    if not _MAYBE.search(text):
        return None
    running = running_text(text.replace("\r\n", "\n"))
    m = PLACEHOLDERS.search(running)
    if m:
        return m.group()
    for m in _LOWER_TAG.finditer(running):
        if f"</{m.group(1)}" not in text:
            return m.group()
    return None


def blocks(text: str) -> list[str]:
    """The visible blocks of a body: lines of text, headings of markup, messages of a Json reply."""
    stripped = text.strip()
    if stripped[:1] == "{" and stripped[-1:] == "}":
        try:
            parsed = json.loads(stripped)
            strings = [v for v in parsed.values() if isinstance(v, str) and re.search(r"\s", v.strip()) or (isinstance(v, str) and len(v) > 12 and not v.isascii())]
            return [b for s in strings for b in blocks(s)] or [stripped]
        except (ValueError, RecursionError, AttributeError):
            pass
    if _TAG.search(text) and re.search(r"</\w+>", text):
        visible = without_markup(text, ("!--", "script", "style"))
        visible = html.unescape(re.sub(r"</?(?:b|i|a|em|strong|span|u|small|code)\b[^<>]*>", "", visible, flags=_I))
        text = _TAG.sub("\n", visible)
    return list(dict.fromkeys(b for b in (line.strip(" \t\r#*_=->") for line in text.split("\n")) if any(c.isalnum() for c in b)))


def terms(text: str) -> list[str]:
    text = text.lower()
    return _WORD.findall(text) if _CJK.search(text) else _PLAIN_WORD.findall(text)


def terms_of_skeleton(block: str) -> list[str]:
    """The terms of a block without numbers, identifiers and case, for comparison between documents."""
    out = re.sub(r"\d+", "0", block.lower())
    out = re.sub(r"\(\w+\)|\b(?:ray|id|ref\w*|trace|référence|vorgang|referencia|referência|номер|kod|kód)\.?:? \w+|\b\w+\.(?:example|test|invalid|com|org|net)\b|/[\w./-]+", "*", out)
    return terms(out)


def skeleton(block: str) -> str:
    return " ".join(terms_of_skeleton(block))


def _brief(said: str, found: list[str]) -> bool:
    """Whether a block is short and in short sentences, as notices are (texts without spaces count by their marks)."""
    return len(found) <= NOTICE_WORDS and all(len(terms(x)) <= SENTENCE_WORDS or any("\u3040" <= c <= "\u9fff" for c in x) for x in _SENTENCE.split(said))


def kind_of(block: str, latin: float = 0.25) -> str:
    """'notice', 'filler', 'chrome', or own content: 'syntax' (calls, options, release notes) or ''.

    `latin` is the share of filler vocabulary from which a block is filler.
    """
    if _CHROME.match(block):
        return "chrome"
    if _SYNTAX.search(block):
        return "syntax"
    found = terms(block)
    said = _QUOTED.sub(" ", without_inline_code(block))
    if FILLER_WORDING.search(said) and _brief(said, found):
        return "filler"
    distinct = set(found)
    if len(found) >= 6 and len(distinct) <= len(found) // 3 and not distinct & {"0", "1"}:
        return "filler"
    if len(found) >= 4 and sum(w in LATIN_FILLER for w in found) >= latin * len(found):
        return "filler"
    if (ERROR_WORDING.search(said) or (SCRIPT_WORDING.search(said) and SCRIPT_VERBS.search(said))) and _brief(said, found):
        return "notice"
    if len(found) <= 3 and not re.search(r"[.!?。:]$", block):
        return "chrome"
    return ""


class Vocabulary:
    """The terms that aren't rare, as a sorted array of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.known: dict[str, bool] = {}

    @staticmethod
    def hash(term: str) -> int:
        """The first 15 hexadecimal digits of the MD5."""
        return int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)

    def __contains__(self, term: str) -> bool:
        found = self.known.get(term)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            h = self.hash(term)
            at = int(np.searchsorted(self.hashes, h))
            found = self.known[term] = term == "0" or (at < len(self.hashes) and int(self.hashes[at]) == h)
        return found


def vocabulary(texts: DataFrame) -> np.ndarray:
    """Hashes of the terms in at least RARE_DOCS documents and RARE_SHARE of all; there are at most as many of them as the
    average number of distinct terms of a document over RARE_SHARE."""
    least = max(RARE_DOCS, RARE_SHARE * texts.count())
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(JAVA_WORD), F.lit(0)))).alias("term"))
    often = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.select(F.conv(F.substring(F.md5(F.encode("term", "utf-8")), 1, 15), 16, 10).cast("long").alias("h")).toPandas()["h"].to_numpy(dtype=np.int64)


SENTENCES = ArrayType(StructType().add("s", LongType()).add("terms", IntegerType()))
FEATURES = (
    StructType().add("doc_id", LongType()).add("host", StringType()).add("left", StringType()).add("junk", IntegerType()).add("own", IntegerType()).add("body", StringType()).add("mismatch", BooleanType()).add("need", IntegerType())
    .add("alone", BooleanType()).add("sentences", SENTENCES)
)


def features(doc_id: int, text: str, source: str | None, path: str | None, known: Vocabulary) -> tuple:
    """What one document shows by itself: the placeholder left, the number of junk blocks, whether a block has content of
    its own (the rest is then not judged by wording), the skeleton of the whole body, code included, whether it lacks the
    terms of the address, how many documents must have it (0 for a few plain blocks, else the number of its distinct
    terms, as documents with more to say are copied too, but never so often), whether its sentences are all it says, and
    the sentences, by the hash of their terms that aren't rare."""
    unquoted = text.replace("\r\n", "\n")
    left = placeholder(text)
    kept = _FENCE.sub("\n", _INDENTED.sub("\n", unquoted)) if "```" in unquoted or "~~~" in unquoted or "    " in unquoted or "\t" in unquoted else unquoted
    own = int(len(kept.strip()) < len(unquoted.strip()) or bool(_LOG.search(unquoted)))
    junk, judged, syntax, body = 0, True, False, []
    parts = blocks(kept)
    latin = 0.1 if _LOREM.search(kept) else 0.25  # beside a known filler less is enough
    for b in parts:
        if not judged:
            if not _CHROME.match(b) and (len(terms(b)) > 3 or re.search(r"[.!?。:]$", b)):
                body.append(b)
            continue
        kind = kind_of(b, latin)
        junk += kind in ("notice", "filler")
        own += kind in ("", "syntax")
        if kind != "chrome":
            body.append(b)
        syntax |= kind == "syntax"
        judged = not (own and (len(body) > 3 or len(parts) > 8))
    plain = len(kept.strip()) == len(unquoted.strip())
    whole = " / ".join(body) if plain else unquoted
    brief = plain and len(body) <= 3 and len(parts) <= 8 and len(whole) <= 1000 and not (own and junk) and not syntax
    title = _TITLE.search(text)
    slug = re.split(r"[/.]", path)[-2] if path and "." in path else (path or "")
    address = {w for w in re.split(r"[\W\d_]+", f"{slug} {title.group(1) if title and own else ''}".lower()) if len(w) > 2}
    said = [terms_of_skeleton(x) for b in body for x in _SENTENCE.split(b)] if plain else []
    mismatch = not address & {w for x in said for w in x} if plain else not address & set(terms(whole))
    skeletons = [" ".join(x) for x in said] if plain else [skeleton(whole)]
    whole_body = " / ".join(skeletons)
    found: dict[int, int] = {}
    for x in said:
        often = [w for w in x if w in known]
        if often:
            found[Vocabulary.hash(" ".join(often))] = len(set(often))
    alone = plain and mismatch and not syntax and 0 < len(found) <= RESPONSE_SENTENCES
    need = 0 if brief or not mismatch else len({w for x in said for w in x} if plain else set(terms(whole)))
    return doc_id, source, left, junk, own, whole_body if mismatch and whole_body else None, mismatch, need, alone, [{"s": h, "terms": n} for h, n in found.items()]


_VOCABULARIES: dict[str, Vocabulary] = {}


def _features(shared, token: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _VOCABULARIES:
            _VOCABULARIES.clear()
            _VOCABULARIES[token] = Vocabulary(shared.value)
        known = _VOCABULARIES[token]
        for batch in batches:
            rows = [features(*r, known) for r in zip(batch["doc_id"], batch["text"], batch["source"], batch["path"])]
            out = pd.DataFrame(rows, columns=FEATURES.names)
            out["body"] = [hashlib.md5(b.encode("utf-8", "surrogatepass")).hexdigest() if b else None for b in out["body"]]
            yield out

    return work


def responses(judged: DataFrame, docs: int, hosts: int) -> DataFrame:
    """Sentences (s) that are responses: all that documents of several hosts say, and rarely part of more.

    `strong` where documents and hosts are enough without wording. Counted per host first, with map-side combine.
    """
    alone = F.col("alone").cast("int")
    rows = judged.where(F.col("left").isNull()).select("host", "alone", F.explode("sentences").alias("x")).select("host", "x.s", "x.terms", alone.alias("alone"))
    per_host = rows.groupBy("s", "host").agg(F.sum("alone").alias("alone"), F.sum(1 - F.col("alone")).alias("within"), F.max("terms").alias("terms"))
    sums = per_host.groupBy("s").agg(F.sum("alone").alias("n"), F.sum("within").alias("within"), F.count_if(F.col("alone") > 0).alias("hosts"), F.max("terms").alias("terms"))
    need = F.greatest(F.lit(docs), F.when(F.col("terms") > LITTLE, F.col("terms")).otherwise(0))
    kept = sums.where((F.col("n") >= THIN) & (F.col("hosts") >= THIN) & (F.col("n") > DOMINANCE * F.col("within")))
    return kept.select("s", "n", ((F.col("n") >= need) & (F.col("hosts") >= hosts)).alias("strong"))


def residue(documents: DataFrame, repeated_docs: int = REPEATED_DOCS, repeated_hosts: int = REPEATED_HOSTS, repeated_share: float = REPEATED_SHARE) -> DataFrame:
    """doc_id and reason ('placeholder', 'repeated response' or 'wording') of the documents to leave out.

    Repeated responses are found by their sentences and by their whole bodies; both are counted with map-side combine and
    joined back by hash. All documents take part whose body has no term of their address. A body on fewer hosts than
    `repeated_hosts` is repeated if it is the body of `repeated_docs` documents and of `repeated_share` of all documents of
    one host. A body with more than a few plain blocks needs as many documents as it has distinct terms. A document may
    have several reasons, one row each. Null texts and rows without doc_id give no row; an empty text is no residue. Null
    sources count as one host. Repeated doc_ids are judged each.
    """
    texts = documents.select("doc_id", "text", "source", "path").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(texts))
    kept = texts.mapInPandas(_features(shared, uuid.uuid4().hex), FEATURES)
    key = F.when(F.col("left").isNull() & ((F.col("own") > 0) | (F.col("junk") == 0)) & F.col("mismatch"), F.col("body"))
    judged = cut(kept.select("doc_id", "host", "left", "junk", "own", "need", key.alias("key"), "alone", "sentences"))
    per_host = judged.where(F.col("key").isNotNull()).groupBy("key", "host").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    enough = per_host.groupBy("key").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.count(F.lit(1)).alias("hosts")).where((F.col("n") >= F.greatest(F.lit(repeated_docs), "need")))
    often = judged.where(F.col("key").isNotNull()).groupBy("key", "host", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "host").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= repeated_docs)
    of_host = texts.groupBy(F.col("source").alias("_host")).agg(F.count_distinct("doc_id").alias("all"))
    shared_bodies = often.join(of_host, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("docs") >= repeated_share * F.col("all"))
    by_share = enough.where(F.col("hosts") < repeated_hosts).join(shared_bodies.select("key").distinct(), "key", "left_semi")
    repeated = cut(enough.where(F.col("hosts") >= repeated_hosts).unionByName(by_share).select("key", "n"))
    hot = hot_keys(repeated, "key")
    again = spread(judged.where(F.col("key").isNotNull()), "key", F.col("doc_id"), hot).join(replicate(repeated.select("key"), "key", hot), ["key", "_part"], "left_semi")
    said = cut(responses(judged, repeated_docs, repeated_hosts))
    hot_said = hot_keys(said, "s")
    worded = (F.col("own") == 0) & (F.col("junk") > 0)
    bare = judged.where(F.col("alone") & F.col("left").isNull()).select("doc_id", worded.alias("worded"), F.xxhash64("sentences").alias("h"), F.size("sentences").alias("k"), F.explode("sentences.s").alias("s"))
    met = spread(bare, "s", F.col("doc_id"), hot_said).join(replicate(said.select("s", "strong"), "s", hot_said), ["s", "_part"]).where(F.col("worded") | F.col("strong"))
    by_sentences = met.groupBy("doc_id", "h", "k").agg(F.count_distinct("s").alias("n")).where(F.col("n") == F.col("k")).select("doc_id")
    by_itself = judged.where(F.col("left").isNotNull() | worded).select("doc_id", F.when(F.col("left").isNotNull(), "placeholder").otherwise("wording").alias("reason"))
    return by_itself.unionByName(again.select("doc_id").unionByName(by_sentences).distinct().withColumn("reason", F.lit("repeated response")))
