import random
import re

import numpy as np
import pytest

from sitegrove.llm.leaks import Index, leaked, words
from sitegrove.llm.packing import SumOfSquares, containers, oversized_documents, pack_documents
from sitegrove.llm.residue import Vocabulary, features, placeholder, residue, running_text

DOCS = "doc_id long, text string, source string, path string, tokens int, n int"


def docs(spark, *texts, path="x/own-1.md"):
    return spark.createDataFrame([(i, t, f"h{i % 4}", path, 0, 0) for i, t in enumerate(texts)], DOCS)


def test_packing(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(300)] + ["a-b " * 100, "", None, "x " * 50, "x\xa0y​z­" * 3]
    df = docs(spark, *texts)
    packed = pack_documents(df, 50, pack_rows=100)
    rows = packed.collect()
    n = {i: len(re.findall(r"\w+|[^\w\s]+", t)) for i, t in enumerate(texts) if t}
    totals = {}
    for r in rows:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.tokens
    assert totals == n
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append(r)
    assert all(sum(x.tokens for x in xs) == xs[0].used <= 50 for xs in by.values())
    assert all(r.whole == (n[r.doc_id] <= 50) for r in rows) and all(len([x for x in rows if x.doc_id == r.doc_id]) == 1 for r in rows if r.whole)
    assert sorted(r.doc_id for r in oversized_documents(packed).collect()) == sorted(i for i, k in n.items() if k > 50)
    assert sum(n.values()) / (50 * containers(packed).count()) > 0.93
    assert pack_documents(df.limit(0), 50).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, 0)


def test_sum_of_squares_rule():
    rng = random.Random(6)
    packer, gaps = SumOfSquares(12), []
    for _ in range(300):
        size = rng.randrange(1, 13)

        def after(k):
            out = list(gaps)
            if k == len(out):
                out.append(12)
            out[k] -= size
            counts = [out.count(g) for g in range(1, 12)]
            return sum(c * c for c in counts)

        options = [k for k, g in enumerate(gaps) if g >= size] + [len(gaps)]
        best = min(after(k) for k in options)
        k = packer.place(size)
        assert k in options and after(k) == best
        if k == len(gaps):
            gaps.append(12)
        gaps[k] -= size


def item(i, passage, question="What is it?", answer="42"):
    return i, passage, question, answer


PASSAGES = [" ".join(f"{a}{b}" for a in "velvet amber orphaned hollow quoted".split() for b in "abcd"), " ".join(f"w{i}" for i in range(30)), "the cat sat on the mat and the dog sat on the rug with a bone"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [item(i, p, answer="short" if i else " ".join(f"answer{k}" for k in range(14))) for i, p in enumerate(PASSAGES)] + [item(9, PASSAGES[0])]
    pool = [w for p in PASSAGES for w in words(p)] + ["noise", "other"]
    texts = []
    for _ in range(200):
        p = words(rng.choice(PASSAGES))
        a = rng.randrange(len(p))
        part = p[a : a + rng.randrange(8, 20)]
        texts.append(" ".join([rng.choice(pool) for _ in range(rng.randrange(30))] + part + [rng.choice(pool) for _ in range(rng.randrange(30))]))
    texts += [PASSAGES[1].upper().replace(" ", ",  "), PASSAGES[1].replace("w", "w­"), "ｗ０ " + " ".join(f"w{i}" for i in range(1, 13)), None, "", " ".join(f"answer{k}" for k in range(14)), (PASSAGES[1] + " ") * 50]
    expected = set()
    for d, t in enumerate(texts):
        w = words(t)
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, passage, _, answer in items:
            for field in (passage, answer):
                x = words(field)
                if any(tuple(x[k : k + 13]) in grams for k in range(len(x) - 12)):
                    expected.add((d, i))
    frame = spark.createDataFrame([(*x, "suite", 1) for x in items], "item_id int, passage string, question string, answer string, suite string, doc_id int")
    for size in (1 << 20, 300):
        got = leaked(docs(spark, *texts), frame, index_bytes=size).select("doc_id", "item_id").distinct().collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected
    assert leaked(docs(spark, *texts), frame.limit(0)).count() == 0 and leaked(docs(spark), frame).count() == 0


def test_block_max_wand_returns_all_above_threshold():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    index = Index([item(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(13, 40)))) for i in range(300)])
    for _ in range(40):
        query = set(rng.sample(vocabulary, rng.randrange(1, 40)))
        scores = {}
        for w in query:
            if w in index.lists:
                for e, x in zip(*index.lists[w][:2]):
                    scores[e] = scores.get(e, 0) + x
        for threshold in (2.0, 8.0, 20.0):
            got = dict(index.retrieve(query, threshold))
            assert all(abs(x - scores[e]) < 1e-9 for e, x in got.items())
            assert {e for e, x in scores.items() if x > threshold + 1e-9} <= set(got) <= {e for e, x in scores.items() if x > threshold - 1e-9}


def test_block_max_wand_skips():
    """With a threshold as high as leaks have it, hardly any posting of the query's words is touched."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    index = Index([item(i, " ".join(vocabulary[int(rng.random() ** 2 * 400)] for _ in range(30))) for i in range(4000)])
    passage = index.entries[1234][2][:20]
    threshold = 0.9 * sum(index.lower[w] for w in set(passage))
    total = sum(len(index.lists[w][0]) for w in set(passage))
    index.touched = 0
    assert 1234 in dict(index.retrieve(set(passage), threshold))
    assert index.touched < 0.5 * total
    index.touched = 0
    assert index.retrieve(set(passage), 10 * threshold) == [] and index.touched <= len(passage)


def test_nulls_in_items(spark):
    frame = spark.createDataFrame([(1, None, None, None), (2, " ".join(map(str, range(20))), None, None)], "item_id int, passage string, question string, answer string")
    assert [(r.doc_id, r.item_id, r.shared_words) for r in leaked(docs(spark, " ".join(map(str, range(3, 18)))), frame).collect()] == [(0, 2, 15)]


PLACEHOLDERS = ["Dear {{ name }},", "Hello ${user.name}!", "# About [INSERT NAME]", "* __FIRST_NAME__: x", "Mail %LAST_NAME% now", "Written by @@AUTHOR@@.", "On *|DATE:NOW|* we", "For <your company name> only", "Version TBD: fix", "By XXXX on", "{%= user %} said", "<%= user %> said", "{heading} of", "See $FIRST_NAME$", "{{#a}}{{/a}}", "[Company Name here] is"]
MENTIONS = ["A template such as `{{ name }}` is fine.", "```\n${a}\n```\nText.", "    {{ indented }}\n", "the string \"%LAST_NAME%\" shows", "<!-- TBD: x --> text", "<code>{{a}}</code> text", "> {{ cited }}", "12:00:01 INFO {{ x }}", "call __init__ and /users/{id}/x", "a 100% of 5% rate", "$5 and $6", "[link](http://x) [1]", "<b>bold</b> <my-tag>x</my-tag>", "\\begin{table}"]


@pytest.mark.parametrize("text", PLACEHOLDERS)
def test_placeholders(text):
    assert placeholder(text) is not None


@pytest.mark.parametrize("text", MENTIONS)
def test_mentions_are_no_placeholders(text):
    assert placeholder(text) is None


RESIDUE = ["404 Not Found", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please enable JavaScript to view this page.\n\nHome / x", "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", '{"ok": false, "message": "Access denied for this page"}', "Zugriff verweigert.", "Страница не найдена.", "お探しのページは見つかりませんでした。", "text text text text text text text", "Coming soon. Content to follow.", "Nav | Home | Cart\n\nSession has expired. Log in again.\n\nBack", "Texto de relleno. Sustituir antes de publicar."]
CONTENT = ["# How to handle 404 errors\n\nIf the server says 404 Not Found, retry the request after a pause and note the address in the report.", "The `noscript` element may say \"please enable JavaScript\"; we show the menu anyway.\n\nEnough.", "fix: handle it\n\nThe order matters here for all of the pages.", "", "12:00:01 WARN 404 Not Found\n12:00:02 INFO ok", "Use lorem ipsum only in drafts. The build warns about the rest of it."]


def test_residue(spark):
    frame = docs(spark, *RESIDUE, *CONTENT, None, *PLACEHOLDERS[:2])
    rows = [(r.doc_id, r.reason) for r in residue(frame).collect()]
    got = dict(rows)
    assert {i for i, r in rows if r == "wording"} >= set(range(len(RESIDUE))) and len(set(rows)) == len(rows)
    n = len(RESIDUE)
    assert not set(got) & set(range(n, n + 5)) and n + len(CONTENT) not in got
    assert got[n + len(CONTENT) + 1] == got[n + len(CONTENT) + 2] == "placeholder"
    assert residue(frame.limit(0)).count() == 0


def test_repeated_responses(spark):
    same = [f"The moon office is closed today, visitor {i}." for i in range(6)]
    rows = [(i, t, f"host{i % 3}", "a/ticket-1.md") for i, t in enumerate(same)] + [(10, "The ticket office is closed today.", "host1", "a/ticket-1.md"), (11, "A sentence of its own, said once.", "host1", "a/x.md")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    assert sorted(r.doc_id for r in residue(frame).collect()) == list(range(6))
    assert residue(frame.where("source = 'host1'")).count() == 0


@pytest.mark.parametrize("within", [0, 8])
def test_sentences_of_several_hosts(spark, within):
    """Unlisted wording is found by its sentences, in whatever order and with whatever navigation, unless richer texts use it."""
    said = ["The moon office has nothing for you here.", "Kindly return on another evening."]
    rows = [(i, f"Home | Shop | Item {i}\n\n{said[i % 2]} {said[1 - i % 2]}\n\nref. q{'xyz'[i % 3]}{i}w", f"host{i % 4}", f"a/ticket-{i}.md") for i in range(8)]
    rows += [(100 + i, " ".join([*said, "Tickets are sold at dusk.", f"A rider came for number {i}.", "Bring a lantern.", "The gate is low."]), f"host{i % 4}", "a/gate.md") for i in range(within)]
    rows += [(200 + i, f"Bring {w} to the gate.", f"host{i % 4}", "a/gate.md") for i, w in enumerate(["bread", "a rope", "salt", "two coins", "nothing", "a dog"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    assert sorted((r.doc_id, r.reason) for r in residue(frame).collect()) == ([] if within else [(i, "repeated response") for i in range(8)])


def test_long_texts_are_linear():
    for text in ("`x " * 50_000, "`x\n\n" * 50_000, "\"x 'y " * 50_000, "<% x " * 50_000, "<code> " * 50_000, "{{ " * 50_000, "(a " * 50_000):
        features(1, text, None, None, Vocabulary(np.array([], dtype=np.int64)))
    assert running_text("a ``b`c`` d `e") == "a   d `e"


def test_rows_without_ids(spark):
    big = 2**60 + 1
    frame = spark.createDataFrame([(None, "404 Not Found", None, None), (big, "404 Not Found " + " ".join(map(str, range(20))), None, None), (big + 2, "Dear {{ name }}", None, None)], "doc_id long, text string, source string, path string")
    assert {r.doc_id for r in residue(frame).collect()} == {big + 2}
    assert {r.doc_id for r in pack_documents(frame, 10).collect()} == {big, big + 2}
    assert pack_documents(frame, None).count() == 0
    items = spark.createDataFrame([(None, "x " * 20, None, None), (5, " ".join(map(str, range(14))), None, None)], "item_id int, passage string, question string, answer string")
    assert [(r.doc_id, r.item_id) for r in leaked(frame, items).collect()] == [(big, 5)]
