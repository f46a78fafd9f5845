from pyspark.sql import functions as F

from sitegrove.functions import text as X
from sitegrove.functions.content import decode


def test_small_texts(spark):
    row = spark.createDataFrame([("a.png 1x, b 2x", "x@2x.png", b'<meta charset="UTF-8">', "<?xml version='1.0'?><a/>", '{"b":1,"a":{"d":2,"c":[{"z":1,"y":2}]}}')], "s string, f string, h binary, x string, j string")
    got = row.select(X.srcset_text(X.srcset_entries(F.col("s"))), X.device_pixel_ratio(F.col("f")), X.sniffed_charset(F.col("h")), X.xml_declaration(F.col("x")), X.canonical_json("j")).first()
    assert tuple(got) == ("a.png 1x, b 2x", 2.0, "utf-8", "<?xml version='1.0'?>", '{"a":{"c":[{"y":2,"z":1}],"d":2},"b":1}')


def test_source_map_positions():
    assert X.decode_mappings('{"version":3,"sources":["a.js"],"names":["n"],"mappings":"AAAAA,CAAC;EAED"}') == [(1, 0, "a.js", 1, 0, "n"), (1, 1, "a.js", 1, 1, None), (2, 2, "a.js", 3, 0, None)]
    assert X.decode_mappings("{") == [] and X.decode_mappings("[]") == []


def test_conditions():
    assert X.parse_conditions("a: 'x', b: ['y', 'z']") == {"a": ["x"], "b": ["y", "z"]}
    assert X.stringify_conditions({"a": ["x"], "b": ["y", "z"]}) == "a: 'x', b: ['y', 'z']"
    assert X.parse_conditions("a x") is None and X.parse_conditions("") == {}


def test_decoding():
    assert decode(b"\xe9", "ISO-8859-1") == "é" and decode(b"\xe9", None) == "é" and decode("é".encode(), None) == "é" and decode(b"a", "nope") == "a" and decode(None, "x") is None and decode(b"\x8e", "macintosh") == "é" and decode(b"\xff", "utf-8") == "�"


def test_svg_namespaces(spark):
    rows = spark.createDataFrame([("<svg><use xlink:href='#a'/></svg>",), ("<svg xmlns='x'/>",), ("<p>",)], "t string")
    assert [r[0] for r in rows.select(X.with_svg_namespaces(F.col("t"))).collect()] == ['<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><use xlink:href=\'#a\'/></svg>', "<svg xmlns='x'/>", "<p>"]


def test_compressed_scripts():
    from sitegrove.extract.javascript import compressed

    assert compressed("var a = 1 ; // x\n/* y */ if ( a ) {\n  b ( + + a , 'c  d' )\n}\nreturn /  \\/ / . test ( a )\nc\n++d") == "var a=1;if(a){b(+ +a,'c  d')}\nreturn/  \\/ /.test(a)\nc\n++d"
