"""Elements of pages in every markup, held-out accuracy, clean text."""

import random

import numpy as np
import pytest

from foliospark.llm import markup

TEXTS = [f"The {a} {b} of the {c} was moved to the upper floor in {n}." for a in ("old", "new", "red") for b in ("pump", "valve", "gauge") for c in ("plant", "site") for n in ("May", "June")]


@pytest.fixture(scope="module")
def model():
    return markup.train(TEXTS)


def count(model, text):
    out = {}
    for _, y in markup.label_pages([text], model)[0]:
        if y in markup.ELEMENTS:
            out[y] = out.get(y, 0) + 1
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("", {}),
        (" \n\n ", {}),
        ("# One\n\ntext\n\n## Two ##\n\nThree\n=====\n", {"heading": 3}),
        ("== One ==\n\n# a\n# b\n#c\n\n'''x''' text", {"heading": 1, "list_item": 3}),
        ("- a\n- b\n\ncost ($5 each, $9 in all) and \\$4 or `$x$`", {"list_item": 2}),
        ("text $a^2$ and \\(b\\)\n\n$$\nc\n$$\n", {"formula": 3}),
        ("```\n# no\n- no\n$$ no $$\n```\n\nDone.", {"code_block": 1}),
        ("<h2>A</h2><ul><li>x<li>y</ul><pre>1. no</pre><!-- <h2>no</h2> -->", {"heading": 1, "list_item": 2, "code_block": 1}),
        ("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n% \\section{no}\n\\begin{tabular}{l}\na & b \\\\\n\\end{tabular}", {"heading": 1, "list_item": 1, "table": 1}),
        ("| a | b |\n|---|---|\n| 1 | $x$ |\n\nDone.", {"table": 1, "formula": 1}),
    ],
)
def test_elements(model, text, want):
    assert count(model, text) == want


def test_held_out_accuracy(model):
    r = random.Random(123)
    right = total = 0
    for _ in range(200):
        text, ls, y = markup.labelled(markup.make_page(r, TEXTS))
        if ls:
            got = model.label([markup.features(text, ls)], [np.array([markup.ATOMS[x.atom] for x in ls])])[0]
            right, total = right + int((got == y).sum()), total + len(y)
    assert right / total > 0.985


def test_clean_keeps_structure(model):
    text = "## A **b**\n\n<b>x</b> &amp; y $z$\n\n- one\n- [two](http://a)\n\n```py\nv = 1\n```"
    got = markup.clean(text, markup.label_pages([text], model)[0])
    assert got == "# A b\n\nx & y $z$\n\n- one\n- two\n\n```\nv = 1\n```"


def test_rows():
    assert len(markup.table_leaves(["<TABLE><TR><TH>a<TR><td>b</tr></TABLE>", None, "<tr><td>c"])) == 3
    assert markup.table_leaves([]) == []


def test_context_tells_marks_apart(model):
    assert count(model, "Acme | Scope\n## Method\n\nThe version of\n5. March lacks a form.\n2. Second point of a list.") == {"heading": 1, "list_item": 1}
    assert count(model, "1. Only one item here") == {"list_item": 1}
    assert count(model, "M. Smith put the bolts away.") == {}
