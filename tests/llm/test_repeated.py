import pytest

from sitegrove.llm.residue import residue

LONG = " ".join(f"{a}{b}{c}" for a in "amber birch cedar dune elm".split() for b in "fox goat heron ibis jay".split() for c in "lantern harbour meadow".split()) + "."
BODIES = {
    "long": LONG,
    "blocks": "\n\n".join(f"The moon office has closed {w} door for good today." for w in "first second third fourth fifth sixth seventh eighth ninth tenth".split()),
    "own and junk": "404 Not Found\n\nThe moon office has nothing behind this door and never had.",
}


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("hosts", [1, 2, 4])
def test_any_repeated_body(spark, body, hosts):
    rows = [(i, BODIES[body], f"host{i % hosts}", f"a/ticket-{i}.md") for i in range(80)]
    rows += [(100 + i, f"Visitors find page {w} about tickets here, written once.", "host0", "a/ticket-1.md") for i, w in enumerate("apple pear plum fig".split())]
    rows += [(200 + i, f"{BODIES[body]}\n\nThis ticket is valid.", "host0", f"a/ticket-{i}.md") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    assert sorted((r.doc_id, r.reason) for r in residue(frame).collect()) == [(i, "repeated response") for i in range(80)]


def test_share_of_the_host(spark):
    rows = [(i, "The moon office is closed today.", "large" if i < 6 else None, f"a/ticket-{i}.md") for i in range(9)]
    rows += [(100 + i, f"Own text of ticket {i}.", "large", f"a/ticket-{i}.md") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    assert residue(frame).count() == 0
    assert residue(frame, repeated_share=0.008).count() == 9
    assert residue(frame, repeated_docs=3).count() == 9


def test_copies_of_a_document_are_content(spark):
    frame = spark.createDataFrame([(i, LONG, f"host{i}", f"a/ticket-{i}.md") for i in range(7)], "doc_id long, text string, source string, path string")
    assert residue(frame).count() == 0
