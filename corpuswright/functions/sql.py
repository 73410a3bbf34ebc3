"""The library's operators in SQL: scalar functions, which are native expressions, and table functions for LATERAL joins.

Table functions read a row's text in Python; where a query is written with DataFrames, ``operators.markdown`` does the same
without. Patterns and their names are an argument of the query, and become columns of its result."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import rules as R

SCALARS = {
    "solid_length(x STRING)": ("INT", r"length(regexp_replace(x, r'(?U)\s', ''))"),
    "mora(x STRING)": ("INT", r"length(regexp_replace(x, r'(?U)[\sゃゅょャュョ]', ''))"),
    "per_thousand(n DOUBLE, chars DOUBLE)": ("DOUBLE", "n / nullif(chars, 0) * 1000"),
    "clean_inline(x STRING)": ("STRING", f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, r'{R.IMAGE}', ''), r'{R.LINK}', '$1'), r'{R.INLINE_CODE}', ''), r'{R.HTML_TAG}', ''), r'{R.EMPHASIS}', '')"),
    "full_weight(n INT)": ("DOUBLE", f"least(1.0D, n / {float(R.FULL_WEIGHT)}D)"),
    "sentences_of(x STRING, stops STRING, commas STRING)": ("ARRAY<STRING>", r"filter(transform(split(regexp_replace(x, concat('(?U)([', commas, r'])\s*\R\s*'), '$1'), concat('(?<=[', stops, r'])|\R')), s -> regexp_replace(s, r'(?U)^\s+|\s+$', '')), s -> s <> '')"),
}


class MdLines:
    """The lines of a Markdown text, as ``operators.markdown.line_table`` has them."""

    def eval(self, text: str) -> Iterator[tuple]:
        from ..operators.markdown import lines_of

        for r in lines_of(text):
            yield tuple(r.values())


class MdCode:
    """Closed code blocks: number, language, text and lines."""

    def eval(self, text: str) -> Iterator[tuple]:
        from ..operators.markdown import lines_of

        blocks: dict[int, list[dict]] = {}
        for r in lines_of(text):
            if r["kind"] == "code" and r["closed"]:
                blocks.setdefault(r["block"], []).append(r)
        for block, rows in blocks.items():
            yield block, rows[0]["lang"], "\n".join(r["line"] for r in rows), len(rows)


class MdCells:
    """The cells of table rows, without rules between head and body: place of the line, column from 0, text."""

    def eval(self, text: str) -> Iterator[tuple]:
        from ..operators.markdown import lines_of

        for r in lines_of(text):
            cells = [x.strip() for x in r["line"].strip().strip("|").split("|")] if r["kind"] == "table" else []
            if not all(re.fullmatch(":?-+:?", x) for x in cells):
                for k, cell in enumerate(cells):
                    yield r["pos"], k, cell


class PatternCounts:
    """How often each of the patterns, a JSON object of names and regular expressions, occurs: a column for each name."""

    @staticmethod
    def analyze(text: AnalyzeArgument, patterns: AnalyzeArgument) -> AnalyzeResult:
        if patterns.value is None:
            raise ValueError("the patterns must be a constant JSON object of names and regular expressions")
        found = StructType()
        for name, pattern in json.loads(patterns.value).items():
            re.compile(pattern)
            found = found.add(name, LongType())
        return AnalyzeResult(found)

    def eval(self, text: str, patterns: str) -> Iterator[tuple]:
        if getattr(self, "known", None) != patterns:
            self.known, self.compiled = patterns, [re.compile(p) for p in json.loads(patterns).values()]
        yield tuple(sum(1 for _ in p.finditer(text or "")) for p in self.compiled)


TABLES = {
    "md_lines": (MdLines, "pos int, line string, kind string, level int, ordered boolean, paragraph int, block int, lang string, closed boolean"),
    "md_code": (MdCode, "block int, lang string, code string, n_lines int"),
    "md_cells": (MdCells, "pos int, cell int, text string"),
    "pattern_counts": (PatternCounts, None),
}


def register_functions(spark: SparkSession) -> None:
    """Makes all functions known to the session."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, (own, shape) in TABLES.items():
        spark.udtf.register(name, udtf(own, returnType=shape) if shape else udtf(own))
