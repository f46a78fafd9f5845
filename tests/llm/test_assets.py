import datetime as dt
import io
import json
import random

import pytest

from sitegrove.llm.copies import Canonical, collapse, format_copies, reduced
from sitegrove.llm.grammars import accepts
from sitegrove.llm.mojibake import READ, WORD, WRITTEN, View, garbled_records, lost_letters, misread_utf16
from sitegrove.llm.splitting import boundaries, file_range, oversized_assets, split_assets, split_files, split_texts, text_ranges
from sitegrove.llm.unparsable import judge, parse_rates, parse_verdicts, ranking

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id string, type string, site_id int, text string, raw_src binary, encoding string, content_type string, parse_tree array<struct<kind:string,start_char:int,end_char:int>>, ingested_at timestamp_ntz, v string, key string, n int"


def assets(spark, *rows):
    names = [f.split()[0] for f in SCHEMA.replace("struct<kind:string,start_char:int,end_char:int>", "x").split(", ")]
    return spark.createDataFrame([tuple(({"ingested_at": T0, "site_id": 1} | r).get(n) for n in names) for r in rows], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


VALID = {
    "JavaScript": ["", "a=b/c/d", "x=/[/]\\//g.test(y)", "`a${`b${c}`}`", "async()=>{for await(const x of y);}", "class A{#x=1;static{this.#x}get y(){return #x in this}}", "import a,{b as c} from 'd';export default a", "({a=1}={})=>a", "l:for(;;){continue l}", "a\n++b", "let async;async\nfunction f(){}", "if(a)function f(){}", "0x1_fn;08.5;1e3", "<!-- old", "({__proto__:a,'b':1,[c]:2,get d(){return 1},async*e(){}})", "a??(b||c)", "new.target?.x" if False else "function f(){new.target}", " var ünï=1"],
    "Css": ["", "a{}", "@charset 'x';@import url(a) print;", "a>b+c~d ||e,f:not(.g,h)::before[i='j' i]{color:red!important;--x:{a;b}}", "@media (min-width:1px) and (x:y){a{b:c}}", "@font-face{src:url('a')format('b'),url(c)}", "@keyframes k{from{a:b}50%,to{a:c}}", "a{b:c;&:hover{d:e}> f{g:h}}", "<!-- a{b:url(data:x;y,z)} -->", "a:nth-child(2n + 1 of b){c:d/e}", "@supports not (a:b){c{d:e}}", "/* x */a{b:'\\'}'}", ".a\\:b{c:1.5e3px -1 calc(1px + (2 * 3%))}"],
    "Json": ["1", ' {"a":[null,true,-0.1e+5,"\\u00e9"]} ', "[]", "9" * 5000],
    "Xml": ["<a/>", "<?xml version='1.0' encoding='utf-16'?><!DOCTYPE a><a b='c'><![CDATA[<]]>&amp;<!-- x --></a>", "<x:a/>"],
}
INVALID = {
    "JavaScript": ["a b", "let a;let a", "return", "'x", "`${a", "/(/", "f(", "class A{m(){this.#y}}", "a=>{}()", "({a=1})", "export{x}", "<<<<<<< HEAD\na\n=======", "{\"a\":1}", "a{b:c}", "break", "for(let x of a,b);", "function f(){", "var a = ;", "1_", "<a></a>", "let x: number = 1", "function*g(a=yield){}", "async function f(a=await 1){}", "class A{static{await 1}}", "class A{static{for await(a of b);}}", "({async*m(a=yield){}})"],
    "Css": ["a{", "a{b}", "a{b:}", "{}", "a{b:c}}", "/* x", "a{b:'c}", "a,{b:c}", "a > {b:c}", "a{b:c d:e}", ".1{a:b}", "a[b{c:d}", "@import;", "@media x{a{b:c}", "<<<<<<< HEAD\na{b:c}", "$a: b;", "// x\na{b:c}", "a{b:url(c d)}", "@keyframes k{x{a:b}}", "a::{b:c}", "a{b:c!ie}"],
    "Json": ["", "{a:1}", "[1,]", "'a'", '{"a":1', "NaN", "01", "[1]x", '"\t"', "﻿1"],
    "Xml": ["", "<a>", "<a b=c/>", "<a/><b/>", "<a>&nbsp;</a>", "<A></a>", "text"],
}


@pytest.mark.parametrize("name", accepts)
def test_grammars(name):
    assert [t for t in VALID[name] if not accepts[name](t)] == []
    assert [t for t in INVALID[name] if accepts[name](t)] == []


def test_deep_and_long_texts():
    n = 30_000
    assert accepts["JavaScript"]("(" * n + "1" + ")" * n) and accepts["Json"]("[" * n + "]" * n) and not accepts["Json"]("[" * n + "]" * (n - 1) + "}")
    assert not accepts["JavaScript"]("(" * 2 * n) and not accepts["Css"]("a{" * 5 * n) and accepts["Css"]("a{" * n + "}" * n) and accepts["JavaScript"]("a?b:" * n + "!" * n + "c")
    assert accepts["Css"]("a{" + "b:c;" * n + "}") and not accepts["Css"]("a{" + "b:c;" * n)


def test_json_without_recursion_agrees():
    from sitegrove.llm.grammars.markup import _nested_json

    assert all(_nested_json(t) for t in VALID["Json"]) and not any(_nested_json(t) for t in INVALID["Json"])


def test_verdicts(spark):
    df = assets(spark, {"id": "a", "type": "JavaScript", "text": "a=1"}, {"id": "b", "type": "JavaScript", "text": '{"a":1}'}, {"id": "c", "type": "Css", "text": "a{"}, {"id": "d", "type": "Svg", "text": None, "raw_src": "<a>é</a>".encode("latin-1"), "encoding": "iso-8859-1"}, {"id": "e", "type": "Html", "text": "<"}, {"id": "f", "type": "Json"}, {"id": "g", "type": None, "text": "x"}, {"id": "h", "type": "Atom", "text": ""}, {"id": "i", "type": "Css", "text": "x{", "ingested_at": T0}, {"id": "i", "type": "Css", "text": "x{}", "ingested_at": T0 + dt.timedelta(1)}, {"id": None, "type": "Css", "text": "x{"})
    got = {r.id: (r.verdict, r.language) for r in parse_verdicts(df).collect()}
    assert got == {"a": ("valid", "JavaScript"), "b": ("wrong extension", "Json"), "c": ("corrupt", got["c"][1]), "d": ("valid", "Xml"), "h": ("corrupt", got["h"][1]), "i": ("valid", "Css")}
    sites = spark.createDataFrame([(1, "repo"), (1, "repo")], "site_id int, repo string")
    assert sorted((r.repo, r.type, r.judged, r.rate) for r in parse_rates(parse_verdicts(df), sites).collect()) == [("repo", "Atom", 1, 1.0), ("repo", "Css", 2, 0.5), ("repo", "JavaScript", 2, 0.5), ("repo", "Svg", 1, 0.0)]
    assert parse_verdicts(df.limit(0)).count() == 0
    assert judge("Css", '{"a": [1, true]}') == ("wrong extension", "Json") and ranking("const a = () => 1; import b")[0] == "JavaScript"


def test_pieces_are_the_content_again(spark):
    rng = random.Random(5)
    words = ["alpha", "βήτα", "{", "}\n", "\n\n", "; ", "x" * 90, "é" * 40, "\r\n", "<b>", "</b>\n", "。"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(12)] + ["", "y" * 5000, None]
    for size, overlap in ((100, 0), (100, 50), (64, 10), (60, 45)):
        rows = [(str(i), t, size, overlap, [rng.randrange(0, 4000) for _ in range(20)] if i % 2 else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "id string, content string, max_size int, overlap int, node_ends array<int>")
        pieces = {}
        for r in split_texts(df, "id", range_pieces=3).orderBy("id", "piece_no").collect():
            pieces.setdefault(r.id, []).append(r)
        assert set(pieces) == {str(i) for i, t in enumerate(texts) if t is not None and len(t) > size}
        for id_, ps in pieces.items():
            text = texts[int(id_)]
            assert [p.piece_no for p in ps] == list(range(len(ps)))
            assert "".join(p.text[overlap if k else 0 :] for k, p in enumerate(ps)) == text
            assert all(p.text == text[p.start : p.end] and 0 < len(p.text) <= size for p in ps)
            assert all(q.start == p.end - overlap for p, q in zip(ps, ps[1:]))


def test_cuts_are_natural(spark):
    df = spark.createDataFrame([("a", "one two\n" * 30, 50, 5, None), ("b", "x" * 40 + "y" * 40, 60, 0, [40])], "id string, content string, max_size int, overlap int, node_ends array<int>")
    got = split_texts(df, "id").collect()
    assert {r.cut for r in got if r.id == "a"} == {"line", "end"}
    assert [r.cut for r in got if r.id == "b"] == ["hard", "end"]  # a node's end within a word is outdated
    odd = spark.createDataFrame([("a", "abcde", 3, 9, None), ("b", "abcde", 0, 0, None), ("c", "abc", 2, None, []), ("d", "abc", None, 1, None), (None, "abc", 1, 0, None), ("e", "abc", 1, -3, [None, 1])], "id string, content string, max_size int, overlap int, node_ends array<int>")
    got = {}
    for r in split_texts(odd, "id").orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {"a": ["abc", "bcd", "cde"], "c": ["ab", "c"], "e": ["a", "b", "c"]}


def test_no_row_holds_a_giant_item(spark):
    """The ranges of an item are bounded whatever its length, the boundary table holds no text, and prefix sums go by blocks."""
    text = "".join(f"line {i}\n" for i in range(120_000))
    rows = spark.createDataFrame([("a", text, None, None, 20, 3, None)], "id string, text string, raw binary, encoding string, max_size int, overlap int, node_ends array<int>")
    ranges = text_ranges(rows, ["id"], 8).cache()
    assert ranges.count() > 4096 and ranges.selectExpr("max(length(_left) + length(_body)) as n").first().n <= 9 * 20
    table = boundaries(ranges, "id")
    assert "string" not in {f.dataType.simpleString() for f in table.drop("id").schema}
    from sitegrove.llm.splitting import emitted

    got = emitted(ranges, table, "id").orderBy("piece_no").collect()
    assert "".join(r.text[3 if k else 0 :] for k, r in enumerate(got)) == text and [r.piece_no for r in got] == list(range(len(got)))
    ranges.unpersist()


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.f, self.read_bytes = io.BytesIO(data), 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        out = self.f.read(n)
        self.read_bytes += len(out)
        return out


def test_bytes_read_of_a_range():
    data = ("é日" * 200_000).encode()
    f = Counting(data)
    left, body, last = file_range(f, len(data), 7, 10_000, 100)
    assert f.read_bytes < 10_000 + 4 * 100 + 20 and len(left) == 100 and not last


def test_oversized_assets(spark):
    limits = spark.createDataFrame([("assets", "Text", 5, 1), ("documents", None, 3, 0), ("assets", "Html", None, None), (None, "Html", 1, 0)], "target_table string, type string, max_size int, overlap int")
    df = assets(spark, {"id": "a", "type": "Text", "text": "123456"}, {"id": "a", "type": "Text", "text": "123456"}, {"id": "b", "type": "Text", "text": "12345"}, {"id": "c", "type": "Html", "text": "1234567"}, {"id": "d", "type": "Text", "raw_src": "ééééééé".encode("utf-16-le"), "encoding": "utf-16le"}, {"id": "e", "type": "Text"}, {"id": "f", "type": "Text", "text": "1234567"}, {"id": "f", "type": "Text", "text": "1", "ingested_at": T0 + dt.timedelta(1)})
    assert sorted((r.id, r.pieces, r.n_chars) for r in oversized_assets(df, limits).collect()) == [("a", 2, 6), ("d", 2, 7)]
    assert sorted((r.id, r.piece_no, r.text) for r in split_assets(df, limits).collect()) == [("a", 0, "12345"), ("a", 1, "56"), ("d", 0, "ééééé"), ("d", 1, "ééé")]
    assert oversized_assets(df.limit(0), limits).count() == 0


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(rng.choice(["é", "日本", "a", " ", "\n", "😀"]) for _ in range(20_000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "small.txt").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    rows = split_files(spark, [str(tmp_path)], 200, 20, range_bytes=1500).orderBy("path", "piece_no").collect()
    big = [r for r in rows if r.path.endswith("big.txt")]
    assert "".join(p.text[20 if k else 0 :] for k, p in enumerate(big)) == text
    assert all(len(p.text) <= 200 and text[p.start : p.end] == p.text for p in big) and [p.piece_no for p in big] == list(range(len(big)))
    assert [r.text for r in rows if r.path.endswith("small.txt")] == ["x"] and not any("empty" in r.path for r in rows)


def test_format_copies(spark):
    a = {"type": "Text"}
    df = assets(spark, a | {"id": "2", "text": "Hello, World 1"}, a | {"id": "1", "text": "hello world1"}, {"id": "3", "type": "Html", "text": "hello world 1"}, a | {"id": "4", "text": "HELLO\tWORLD-1!"}, a | {"id": "5", "text": "..."}, a | {"id": "6", "text": "!"}, a | {"id": "7"}, {"id": "8", "type": "Json", "text": '{"a": 1, "b": ["X y", null]}'}, {"id": "9", "type": "Json", "text": '{"B":["xY",null],"A":1}'}, {"id": "A", "type": "Json", "text": '{"a": 1, "b": [null, "xy"]}'}, {"id": "B", "type": "Json", "text": '{"a": "1", "b": ["xy", null]}'}, {"id": "C", "type": "Json", "text": "{a 1"}, {"id": "D", "type": "Json", "text": "a:1"}, a | {"id": "E", "raw_src": b"hello world 1", "encoding": None}, {"id": "F", "type": None, "text": "hello world 1"}, a | {"id": "G", "text": "ΤΟ ΤΕΛΟΣ ΤΟΥ"}, a | {"id": "H", "text": "το τέλος του".replace("έ", "ε")})
    rows = sorted((r.id, r.keeper, r.copies) for r in format_copies(df, hot_rows=2).collect())
    assert rows == [("1", "1", 4), ("2", "1", 4), ("4", "1", 4), ("8", "8", 2), ("9", "8", 2), ("C", "C", 2), ("D", "C", 2), ("E", "1", 4), ("G", "G", 2), ("H", "G", 2)]
    assert sorted((r.keeper, r.copies) for r in collapse(format_copies(df)).collect()) == [("1", 4), ("8", 2), ("C", 2), ("G", 2)]
    assert format_copies(df.limit(0)).count() == 0


def test_random_json_copies(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [rng.randrange(3), rng.choice(["a b", "A-B", "c"]), rng.choice([None, True, 1.5]), "", [value(depth - 1) for _ in range(rng.randrange(3))] if depth else 0, {rng.choice("xyz") + str(i): value(depth - 1) for i in range(rng.randrange(3))} if depth else 0][kind]

    def canonical(v):
        if isinstance(v, dict):
            return "o", tuple(sorted((reduced(k), repr(canonical(x))) for k, x in v.items()))
        return ("a", tuple(map(canonical, v))) if isinstance(v, list) else ("s", reduced(v)) if isinstance(v, str) else ("c", repr(v))

    values = [value(2) for _ in range(150)]
    texts = [json.dumps(v, indent=rng.choice([None, 2])) for v in values]
    groups = {}
    for i, (v, t) in enumerate(zip(values, texts)):
        if reduced(t):
            groups.setdefault(canonical(v), []).append(f"{i:03}")
    expected = {(i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    df = assets(spark, *[{"id": f"{i:03}", "type": "Json", "text": t} for i, t in enumerate(texts)])
    assert {(r.id, r.keeper, r.copies) for r in format_copies(df).collect()} == expected


def test_nested_json_without_recursion():
    """The parser with its own stack gives the fields that the recursive one gives, and refuses what it refuses."""
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        return [rng.randrange(-3, 3), "a B\n", rng.choice([None, True, False, 1.5e10, -0.0]), "", {}, [value(depth - 1) for _ in range(rng.randrange(4))] if depth else 0, {rng.choice("xyX") + str(i % 2): value(depth - 1) for i in range(rng.randrange(4))} if depth else 0][kind]

    for _ in range(400):
        text = json.dumps(value(4), indent=rng.choice([None, 1]))
        assert sorted(Canonical().nested(text)) == sorted(Canonical().members(text)), text
        broken = text[: rng.randrange(len(text))] + rng.choice(["", ",", "}", "]", ":", "x"])
        try:
            json.loads(broken, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            with pytest.raises(ValueError):
                Canonical().nested(broken)
        else:
            Canonical().nested(broken)


def test_deep_json_copies(spark):
    deep = lambda inner: '{"a":' * 30_000 + inner + "}" * 30_000
    rows = [{"id": "a", "text": deep('{"x":1,"y":2}')}, {"id": "b", "text": deep('{"y": 2, "X": 1}')}, {"id": "c", "text": deep('{"x":2,"y":1}')}]
    assert [(r.id, r.keeper) for r in format_copies(assets(spark, *[r | {"type": "Json"} for r in rows])).orderBy("id").collect()] == [("a", "a"), ("b", "a")]


CLEAN = ["Größe über alle Menüs für Schlüssel", "Le modèle générique relie la clé à l'icône", "Příští měsíc přesuneme úložiště k písmo", "Проверьте, нужен ли заголовок и таблица стилей", "La compilación añadió la versión pequeña", "今回の更新で画像と書体を分けました", "A função não depende do botão até você vê-la"]


def test_garbled_records(spark):
    rng = random.Random(1)
    rows = [{"id": f"c{i}", "type": "Text", "site_id": i % 5, "text": " ".join(rng.sample(t.split(" "), len(t.split(" "))))} for i, t in enumerate(CLEAN * 40)]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("utf-8", "mac-roman"), ("cp1252", "mac-roman"), ("utf-8", "utf-16-le")]
    bad = {}
    for i, t in enumerate(CLEAN):
        for k, (x, y) in enumerate(chains):
            try:
                data = t.encode(x)
                text = (data[: len(data) // 2 * 2] if y == "utf-16-le" else data).decode(y)
            except UnicodeError:
                continue
            if text == t:
                continue
            bad[f"g{i}{k}"] = t
            rows.append({"id": f"g{i}{k}", "type": "Text", "site_id": i % 5, "text": text, "raw_src": t.encode("utf-8") if k % 2 else None})
    rows += [{"id": "lost", "type": "Text", "text": "Gr��e", "raw_src": "Größe".encode("latin-1")}, {"id": "gone", "type": "Text", "text": "Gr��e"}, {"id": "ascii", "type": "Text", "text": "plain"}, {"id": "null", "type": None, "site_id": None}, {"id": "mark", "type": "Text", "text": "﻿“Größe” – für 5\xa0€"}]
    df = assets(spark, *rows)
    got = {r.id: r.restored for r in garbled_records(df, "site_id", "type").collect()}
    assert set(got) == {*bad, "lost", "gone"}
    assert got["lost"] == "Größe" and got["gone"] is None
    right = [i for i, t in bad.items() if got[i] is not None and got[i].strip() == t[: len(got[i].strip())]]
    assert len(right) >= 0.9 * len(bad)
    assert garbled_records(df.limit(0), "site_id", "type").count() == 0


def test_words_and_utf16():
    assert WORD.findall("a " + "b" * 100_000 + " Größe x\xa0y là\xa0l") == ["Größe", "là\xa0l"]
    assert misread_utf16("今回の更新で画像と書体を分けました") is None and misread_utf16("ひらがなだけのぶんしょう") is None
    assert misread_utf16("<!DOCTYPE html>\n<p>é".encode().decode("utf-16-le", "ignore")).startswith("<!DOCTYPE html>")


def test_view_of_written_out_characters():
    for text, shown in (("m&#195;&#169;moire &lt;b&gt;", "mÃ©moire &lt;b&gt;"), ("&amp;#xC3;&eacute;", "Ãé"), (r"caf\u00e9 \x41 \\u00e9", r"café \x41 \\u00e9"), ("can&#146;t", "can’t"), ("plain & simple \\ \\n", "plain & simple \\ \\n"), ("", "")):
        view = View(text)
        assert view.shown == shown
        assert view.replaced({}) == text
    assert View("a &#233; m&#195;&#169;moire&#33;").replaced({"mÃ©moire": "mémoire"}) == "a &#233; mémoire&#33;"
    assert View("m&#195;&#169;m m&#195;&#169;m").replaced({"mÃ©m": "mém"}) == "mém mém"


def test_lost_letters():
    assert lost_letters("Gr??e", "Größe".encode("cp1252"), ("windows-1252", None))
    assert lost_letters("Gr????e", "Größe".encode("utf-8"), ("nonsense", None))
    assert not lost_letters("Wie?", b"Wie?", (None, None)) and not lost_letters("¿Qué? _", "¿Qué? _".encode("latin-1"), ("latin-1", None)) and not lost_letters("other?", "Größe".encode(), (None,))


def test_garbling_hidden_in_ascii(spark):
    rows = [{"id": f"c{i}", "type": "Html", "site_id": i % 5, "text": t} for i, t in enumerate(CLEAN * 40)]
    garbled = CLEAN[1].encode().decode("latin-1")
    refs = "".join(c if c.isascii() else f"&#{ord(c)};" for c in garbled)
    rows += [{"id": "refs", "type": "Html", "text": f"<p>{refs}</p>"}, {"id": "json", "type": "Json", "text": json.dumps({"a": garbled})}]
    rows += [{"id": "marks", "type": "Text", "text": CLEAN[0].encode("ascii", "replace").decode(), "raw_src": CLEAN[0].encode("cp1252"), "encoding": "windows-1252"}]
    rows += [{"id": "seven", "type": "Text", "text": "Gr+APYA3w-e"}, {"id": "nul", "type": "Text", "text": "G\x00r\x00"}]
    rows += [{"id": "fine1", "type": "Html", "text": "<p>modèle g&#233;n&#xE9;rique ic&ocirc;ne 1+2-3</p>"}, {"id": "fine2", "type": "Json", "text": json.dumps(CLEAN[5])}, {"id": "fine3", "type": "Text", "text": "Who? a_b", "raw_src": b"Who? a_b"}]
    got = {r.id: r.restored for r in garbled_records(assets(spark, *rows), "site_id", "type").collect()}
    assert set(got) == {"refs", "json", "marks", "seven", "nul"}
    assert got["refs"] == f"<p>{CLEAN[1]}</p>" and json.loads(got["json"])["a"] == CLEAN[1] and got["marks"] == CLEAN[0]


def test_garbled_words_that_recur(spark):
    """The same garbling in many records doesn't make its words known."""
    rows = [{"id": f"c{i}", "type": "Text", "site_id": i % 5, "text": t} for i, t in enumerate(CLEAN * 300)]
    rows += [{"id": f"g{i}", "type": "Text", "site_id": i % 5, "text": CLEAN[2].encode("cp1250").decode("cp1252")} for i in range(40)]
    rows += [{"id": f"h{i}", "type": "Html", "site_id": i % 5, "text": CLEAN[4].encode("cp1252").decode("cp1250")} for i in range(40)]
    assert {r.id for r in garbled_records(assets(spark, *rows), "site_id", "type").collect()} == {f"{x}{i}" for x in "gh" for i in range(40)}


def test_recall_of_each_chain(spark):
    """Texts garbled by every pair of writing and reading, each text once: nearly all are found, and no clean one is."""
    rows = [{"id": f"c{i}", "type": "Text", "site_id": i % 5, "text": t} for i, t in enumerate(CLEAN * 200)]
    planted = {}
    for x in WRITTEN:
        for y in READ:
            for i, t in enumerate(CLEAN):
                try:
                    text = t.encode(x).decode(y)
                    text.encode(y).decode(x)
                except UnicodeError:
                    continue
                if text != t and text.isprintable() and not text.isascii() and text not in planted.values():
                    planted[f"{x}|{y}|{i}"] = text
    rows += [{"id": k, "type": "Text", "site_id": n % 5, "text": t} for n, (k, t) in enumerate(planted.items())]
    got = {r.id for r in garbled_records(assets(spark, *rows), "site_id", "type").collect()}
    assert not [k for k in got if k not in planted]
    chains = {}
    for k in planted:
        chains.setdefault(k.rsplit("|", 1)[0], []).append(k in got)
    print({c: sum(f) / len(f) for c, f in sorted(chains.items()) if not all(f)})
    assert sum(map(sum, chains.values())) >= 0.95 * len(planted)
