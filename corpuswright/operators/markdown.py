"""Markdown decomposition, without a shuffle.

Two readers give the same lines: a state machine in Python, which says what is meant, and expressions over arrays, which
the queries use. The latter never walk from line to line with a state: fences cut a document's lines into stretches, every
other one code; headings and blank lines cut what is outside into paragraphs, other lines cut it into runs of quotes. Each
cut is a list of places and a slice between neighbours, so the work is in proportion to the lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import let as _let
from .once import once

_fence, _heading, _item, _table, _quote = (re.compile(p) for p in (R.FENCE, R.HEADING, R.LIST_ITEM, R.TABLE_ROW, R.QUOTE))
LINES = 20_000  # lines that are put into one batch, or those of one document
LINE = "pos int, line string, kind string, level int, ordered boolean, paragraph int, block int, lang string, closed boolean"


def lines_of(text: str | None) -> list[dict]:
    """The lines of a document. kind: fence, code, heading, table, quote, list, blank or body. paragraph: of body lines.
    block: of code lines the code block, of quote lines the run of quote lines (a fence does not end it). lang and
    closed: of a code block's lines."""
    out: list[dict] = []
    paragraph = block = code = 0
    open_, in_code, in_quote, lang, start = False, False, False, "", 0
    for pos, line in enumerate((text or "").splitlines()):
        row = {"pos": pos, "line": line, "kind": "body", "level": None, "ordered": None, "paragraph": None, "block": None, "lang": None, "closed": None}
        if _fence.match(line):
            row["kind"] = "fence"
            if in_code:
                for x in out[start:]:
                    if x["kind"] == "code":
                        x["closed"] = True
            else:
                code, start, lang = code + 1, len(out), line.strip()[3:].strip().lower()
            in_code = not in_code
        elif in_code:
            row |= {"kind": "code", "block": code, "lang": lang, "closed": False}
        else:
            quoted = False
            if hit := _heading.match(line):
                row |= {"kind": "heading", "level": len(hit[1])}
                open_ = False
            elif _table.match(line):
                row["kind"] = "table"
            elif _quote.match(line):
                row["kind"], quoted = "quote", True
                block += not in_quote
                row["block"] = block
            elif hit := _item.match(line):
                row |= {"kind": "list", "level": len(hit[1].expandtabs(2)) // 2, "ordered": hit[2][0].isdigit()}
            elif not line.strip():
                row["kind"], open_ = "blank", False
            else:
                paragraph += not open_
                open_, row["paragraph"] = True, paragraph
            in_quote = quoted
        out.append(row)
    return out


def line_table_by_loop(df: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`line_table` by the state machine."""
    kind = df.schema[key].dataType.simpleString()
    names = ["pos", "line", "kind", "level", "ordered", "paragraph", "block", "lang", "closed"]
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                own = lines_of(text.as_py())
                rows += own
                at += [k] * len(own)
                if len(rows) > LINES or rows and k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]], names=["key", *names])
                    at, rows = [], []

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {LINE}")


#: White space and digits as Python's patterns have them, for Java's.
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD_BREAKS = "\\x0b-\\r\\x1c-\\x1e\\x85\\u2028\\u2029"


def _java(pattern: str) -> str:
    return pattern.replace("\\s", f"[{SPACES}]").replace("\\d", "\\p{Nd}")


def _lines(text: Column) -> Column:
    """The lines of a text as (pos, line), without an empty last one; a null text has none."""
    usual = F.when(text.rlike(f"[{ODD_BREAKS}]"), F.regexp_replace(text, f"\\r\\n|[{ODD_BREAKS}]", "\n")).otherwise(F.coalesce(text, F.lit("")))
    some = _let(F.split(usual, "\n"), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    return F.transform(some, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))


def _cuts(items: Column, is_cut: Callable[[Column], Column]) -> Column:
    """Places of the items that cut, with one before the first item and one behind the last."""
    return F.concat(F.array(F.lit(-1)), F.array_compact(F.transform(items, lambda x, i: F.when(is_cut(x), i))), F.array(F.size(items)))


def _between(items: Column, is_cut: Callable[[Column], Column]) -> Column:
    """The stretches of an array between the items that cut it."""
    return _let(_cuts(items, is_cut), lambda at: F.transform(F.slice(at, F.lit(2), F.size(at) - 1), lambda b, k: F.slice(items, F.get(at, k) + 2, b - F.get(at, k) - 1)))


def _kind(line: Column) -> Column:
    """What a line outside of code is."""
    is_ = lambda p: line.rlike(_java(p))
    # most lines begin like none of the others, which one look tells
    return F.when(~is_("^\\s*([-#|>*+]|\\d|$)"), "body").when(is_(R.HEADING), "heading").when(is_(R.TABLE_ROW), "table").when(is_(R.QUOTE), "quote").when(is_(R.LIST_ITEM), "list").when(is_(f"^[{SPACES}]*$"), "blank").otherwise("body")


def _parted(df: DataFrame, text: str) -> DataFrame:
    """Adds _lines (pos, line), _at (places of fences, with both ends) and _out (pos, line, kind of lines outside of code)."""
    one = df.withColumn("_lines", _lines(F.col(text)))
    two = one.withColumn("_at", _cuts(F.col("_lines"), lambda x: (x["line"].contains("```") | x["line"].contains("~~~")) & x["line"].rlike(_java(R.FENCE))))
    at, stretch = F.col("_at"), F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2))
    outside = F.flatten(F.transform(stretch, lambda k: F.slice("_lines", F.get(at, k) + 2, F.get(at, k + 1) - F.get(at, k) - 1)))
    return once(two.withColumn("_out", F.transform(outside, lambda x: F.struct(x["pos"], x["line"], _kind(x["line"]).alias("kind")))), "_lines", "_at", "_out")


def _coded() -> Column:
    """Numbers k of the stretches of code, of which fence k opens and fence k + 1 may close."""
    return F.when(F.size("_at") > 2, F.sequence(F.lit(1), F.size("_at") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))


def _lang(k: Column) -> Column:
    """What stands behind fence k."""
    spaces = f"^[{SPACES}]+|[{SPACES}]+$"
    return F.lower(F.regexp_replace(F.substring(F.regexp_replace(F.get("_lines", F.get("_at", k))["line"], spaces, ""), 4, 1 << 30), spaces, ""))


def _ends_paragraph(x: Column) -> Column:
    return x["kind"].isin("heading", "blank")


def _filled(stretches: Column, kind: str) -> Column:
    """Of each stretch the lines of a kind, without the stretches that have none."""
    return F.filter(F.transform(stretches, lambda s: F.filter(s, lambda x: x["kind"] == kind)), lambda s: F.size(s) > 0)


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line of every document: key and the columns of LINE, in no order. A null text has no lines."""

    def row(x: Column, kind: Column, **more: Column) -> Column:
        parts = {"level": "int", "ordered": "boolean", "paragraph": "int", "block": "int", "lang": "string", "closed": "boolean"}
        return F.struct(x["pos"].alias("pos"), x["line"].alias("line"), kind.alias("kind"), *[more.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts.items()])

    numbered = lambda stretches, kind, name: F.flatten(F.transform(_filled(stretches, kind), lambda s, k: F.transform(s, lambda x: row(x, x["kind"], **{name: k + 1}))))
    indent = lambda x: F.regexp_extract(x["line"], _java(R.LIST_ITEM), 1)

    def level(x: Column) -> Column:  # tabs go to even columns
        return F.when(x["kind"] == "heading", F.length(F.regexp_extract(x["line"], _java(R.HEADING), 1))).when(x["kind"] == "list", F.regexp_count(indent(x), F.lit("\\t|[^\\t][\\s\\S]")))

    ordered = lambda x: F.when(x["kind"] == "list", F.regexp_extract(x["line"], _java(R.LIST_ITEM), 2).rlike("^\\p{Nd}"))
    others = F.transform(F.filter("_out", lambda x: x["kind"].isin("heading", "table", "list", "blank")), lambda x: row(x, x["kind"], level=level(x), ordered=ordered(x)))
    at = F.col("_at")
    within = lambda k: F.slice("_lines", F.get(at, k) + 2, F.get(at, k + 1) - F.get(at, k) - 1)
    code = F.flatten(F.transform(_coded(), lambda k: _let(_lang(k), lambda name: F.transform(within(k), lambda x: row(x, F.lit("code"), block=F.floor((k + 1) / 2), lang=name, closed=F.get(at, k + 1) < F.size("_lines"))))))
    fences = F.transform(F.slice(at, F.lit(2), F.size(at) - 2), lambda p: row(F.get("_lines", p), F.lit("fence")))
    rows = F.concat(others, numbered(_between(F.col("_out"), _ends_paragraph), "body", "paragraph"), numbered(_between(F.col("_out"), lambda x: x["kind"] != "quote"), "quote", "block"), code, fences)
    return _parted(df.select(F.col(key).alias("key"), F.col(text).alias("_text")), "_text").select("key", F.explode(rows).alias("z")).select("key", "z.*")


def decompose(text: str | None) -> dict:
    """Body lines, headings, list items, table rows, code lines, quote lines, and paragraphs as lists of lines."""
    rows = lines_of(text)
    of = lambda *kinds: [r["line"] for r in rows if r["kind"] in kinds]
    paragraphs: dict[int, list[str]] = {}
    for r in rows:
        if r["paragraph"] is not None:
            paragraphs.setdefault(r["paragraph"], []).append(r["line"])
    return {"body_lines": of("body"), "headings": of("heading"), "list_items": of("list"), "table_rows": of("table"), "code_lines": of("code", "fence"), "quote_lines": of("quote"), "paragraphs": list(paragraphs.values())}


DECOMPOSED = "body_lines array<string>, headings array<string>, list_items array<string>, table_rows array<string>, code_lines array<string>, quote_lines array<string>, paragraphs array<array<string>>"


def decomposed_by_loop(df: DataFrame, text: str) -> DataFrame:
    """:func:`decomposed` by the state machine."""

    @F.pandas_udf(DECOMPOSED)
    def split(column):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([decompose(x) for x in column], columns=[c.split()[0] for c in DECOMPOSED.split(", ")])

    return df.withColumn("md", split(F.col(text)))


def _codes() -> Column:
    """lang, code (the lines put together) and n_lines of the closed code blocks that have lines."""
    within = lambda k: F.slice("_lines", F.get("_at", k) + 2, F.get("_at", k + 1) - F.get("_at", k) - 1)
    lines = F.filter(F.transform(_coded(), lambda k: F.struct(k.alias("k"), within(k)["line"].alias("lines"))), lambda z: (F.get("_at", z["k"] + 1) < F.size("_lines")) & (F.size(z["lines"]) > 0))
    return F.transform(lines, lambda z: F.struct(_lang(z["k"]).alias("lang"), F.array_join(z["lines"], "").alias("code"), F.size(z["lines"]).alias("n_lines")))


def coded(df: DataFrame, text: str) -> DataFrame:
    """Adds ``codes``, what :func:`code_texts` says of a text's code blocks, as an array."""
    return _parted(df, text).withColumn("codes", _codes()).drop("_lines", "_at", "_out")


def decomposed(df: DataFrame, text: str, codes: bool = False) -> DataFrame:
    """Adds ``md``, the decomposition of a text as a struct, and if asked for ``codes``, its code blocks."""
    at = F.col("_at")
    of = lambda kind: F.filter("_out", lambda x: x["kind"] == kind)["line"]
    code = F.flatten(F.transform(_coded(), lambda k: F.slice("_lines", F.get(at, k) + 1, F.get(at, k + 1) - F.get(at, k) + 1)["line"]))
    paragraphs = F.transform(_filled(_between(F.col("_out"), _ends_paragraph), "body"), lambda s: s["line"])
    md = F.struct(of("body").alias("body_lines"), of("heading").alias("headings"), of("list").alias("list_items"), of("table").alias("table_rows"), code.alias("code_lines"), of("quote").alias("quote_lines"), paragraphs.alias("paragraphs"))
    return _parted(df, text).withColumns({"md": md} | ({"codes": _codes()} if codes else {})).drop("_lines", "_at", "_out")


def code_blocks(lines: DataFrame) -> DataFrame:
    """key, block, lang and n_lines of closed code blocks."""
    return lines.where("kind = 'code' and closed").groupBy("key", "block").agg(F.max("lang").alias("lang"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def code_texts(lines: DataFrame) -> DataFrame:
    """key, block, lang, code (the lines put together) and n_lines of closed code blocks, empty ones among them."""
    inner = lines.where("kind = 'code' and closed").groupBy("key", "block").agg(F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("z"), F.count(F.lit(1)).alias("n_lines"))
    return inner.select("key", "block", "lang", F.array_join("z.line", "").alias("code"), "n_lines")


def structure(lines: DataFrame) -> DataFrame:
    """Counts of each kind of line by document."""
    n = lambda condition: F.count_if(F.expr(condition))
    return lines.groupBy("key").agg(
        n("kind = 'heading'").alias("headings"), n("kind = 'heading' and level >= 4").alias("deep_headings"), n("kind = 'list'").alias("list_items"), n("kind = 'list' and level >= 1").alias("nested_items"),
        n("kind = 'list' and ordered").alias("ordered_items"), n("kind = 'table'").alias("table_rows"), n("kind = 'quote'").alias("quote_lines"), n("kind in ('code', 'fence')").alias("code_lines"),
        n("kind = 'body'").alias("body_lines"), F.countDistinct(F.expr("case when kind = 'quote' then block end")).alias("quote_blocks"), F.countDistinct("paragraph").alias("paragraphs"),
    )
