"""The two Markdown readers against each other."""

from __future__ import annotations

import random

import pytest

from corpuswright.operators import markdown

PARTS = ["```", "~~~ ", "  ```Py ", "```\t", "# h", "### h", "#no", "   ## x", "    # four", "|a|", " | b", ">q", "  > q", "- a", "\t- b", " \t1. c", "   * d", "12) e", "1.no", "-no", "", "  ", "\t", "　", "body", "text with ```", "\x1c", "a\x85b", "x y", "1．z", "١. w", "\x1f- v", "`~", "tail "]
ENDS = ["\n", "\r\n", "\r", "\x0b", "\n\n"]
FIXED = [None, "", "\n", "```", "```\na", "a\n```\nb\n```\nc", "> a\n```\nx\n```\n> b\n> c\nd\n> e", "# a\nb\n|c|\nd\n\ne", "- a\n  - b\n\t- c\n    - d", "a\r\nb\r", "> q\n\n> r", "x " * 20_000, "\n".join(["line"] * 3000)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return FIXED + ["".join(rng.choice(PARTS) + rng.choice(ENDS) for _ in range(rng.randrange(1, 40))) + rng.choice(["", "end"]) for _ in range(600)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)


def test_lines_are_those_of_the_loop(frame, texts):
    got = {}
    for r in markdown.line_table(frame, "id", "text").collect():
        got.setdefault(r.key, []).append(r.asDict())
    for k, text in enumerate(texts):
        own = [{n: v for n, v in r.items() if n != "key"} for r in sorted(got.get(k, []), key=lambda r: r["pos"])]
        assert own == markdown.lines_of(text), repr(text)[:400]


def test_decompositions_are_those_of_the_loop(frame, texts):
    got = {r.id: r.md.asDict() for r in markdown.decomposed(frame, "text").collect()}
    for k, text in enumerate(texts):
        assert got[k] == markdown.decompose(text), repr(text)[:400]


def test_no_python_in_the_plan(frame):
    plan = markdown.line_table(frame, "id", "text")._jdf.queryExecution().executedPlan().toString() + markdown.decomposed(frame, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
