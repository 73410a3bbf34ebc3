"""Measures of a Markdown document: its prose is taken apart, cleaned and measured, each value in a column of its own.

Every step is a projection, so that what later measures share (cleaned text, sentences, their lengths, sums) is worked
out once. The split into lines is the one step in Python, in Arrow batches.

Defined results: a null text has no lines, zero counts and null ratios; input columns keep their names, and a measure
replaces one of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.rules import JA, Rules
from . import markdown

#: Measures that are rounded in their own right, with their digits.
DIGITS = {"bold_per_1k": 3, "list_ratio": 4, "mean_chars": 2, "sd_chars": 2, "mean_mora": 2, "sd_mora": 2, "burstiness": 4, "ten_per_sentence": 3, "dash_per_1k": 3, "kanji_ratio": 4, "polite_ratio": 4, "plain_ratio": 4, "paragraph_mean": 2, "paragraph_cv": 4, "images_per_1k": 3}
MEASURES = (
    "chars_body", "n_sentences", "n_paragraphs", "n_headings", "n_list_items", "n_code_lines", "n_table_rows", "bold_per_1k", "list_ratio", "mean_chars", "sd_chars", "cv_chars", "mean_mora", "sd_mora", "burstiness",
    "ten_per_sentence", "dash_per_1k", "kanji_ratio", "polite_ratio", "plain_ratio", "paragraph_mean", "paragraph_cv", "has_closing", "n_images", "n_links", "images_per_1k",
)


def prose(df: DataFrame, text: str, codes: bool = False) -> DataFrame:
    """Adds md (the decomposition), raw (its body lines) and clean (those without inline markup), and if asked for codes."""
    return markdown.decomposed(df, text, codes).withColumn("raw", F.array_join("md.body_lines", "\n")).withColumn("clean", T.clean_inline(F.col("raw")))


def sums(values: Column) -> Column:
    """n, sum and sum of squares of an array of numbers, in one pass."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["total"] + x).alias("total"), (a["squares"] + x * x).alias("squares")))


def _moments(df: DataFrame, values: str, mean: str, sd: str) -> DataFrame:
    """Adds the mean (null of none) and population SD (null of one or none) of an array column."""
    n = F.nullif(F.size(values), F.lit(0))
    out = df.withColumn("_sums", sums(F.col(values))).withColumn(mean, F.col("_sums.total") / n)
    spread = F.sqrt(F.greatest(F.col("_sums.squares") / n - F.col(mean) * F.col(mean), F.lit(0.0)))
    return out.withColumn(sd, F.when(F.size(values) > 1, spread)).drop("_sums")


def measured(df: DataFrame, text: str, rules: Rules = JA) -> DataFrame:
    """Adds MEASURES of a Markdown column, unrounded, but for cv_chars, which is taken of the rounded mean and SD."""
    rows = prose(df, text).withColumn("sents", T.sentences(F.col("clean"), rules)).withColumn("chars_body", T.solid_length(F.col("clean")))
    size = lambda c: F.when(F.col("md").isNotNull(), F.size(c)).otherwise(0)
    rows = rows.withColumns({
        "char_lengths": F.transform("sents", lambda x: T.solid_length(x).cast("double")), "mora_lengths": F.transform("sents", lambda x: T.mora(x).cast("double")), "n_sentences": F.size("sents"),
        "n_paragraphs": size("md.paragraphs"), "n_headings": size("md.headings"), "n_list_items": size("md.list_items"), "n_code_lines": size("md.code_lines"), "n_table_rows": size("md.table_rows"),
        "paragraph_lengths": F.filter(F.transform("md.paragraphs", lambda p: F.size(T.sentences(T.clean_inline(F.array_join(p, "\n")), rules)).cast("double")), lambda n: n > 0),
        "n_images": F.coalesce(T.count_of(F.col(text), R.IMAGE), F.lit(0)), "all_links": F.coalesce(T.count_of(F.col(text), R.LINK), F.lit(0)),
    })
    for values, mean, sd in (("char_lengths", "mean_chars", "sd_chars"), ("mora_lengths", "mean_mora", "sd_mora"), ("paragraph_lengths", "paragraph_mean", "paragraph_sd")):
        rows = _moments(rows, values, mean, sd)
    clean, n, chars, both = F.col("clean"), F.nullif(F.col("n_sentences"), F.lit(0)), F.col("chars_body"), F.size("md.body_lines") + F.size("md.list_items")
    m, s, many = F.col("mean_mora"), F.col("sd_mora"), F.size("paragraph_lengths") >= 3
    return rows.withColumns({
        "bold_per_1k": T.per_thousand(T.count_of(F.col("raw"), R.BOLD), chars), "list_ratio": F.col("n_list_items") / F.nullif(both, F.lit(0)),
        "cv_chars": F.round(F.round("sd_chars", 2) / F.nullif(F.round("mean_chars", 2), F.lit(0.0)), 4), "burstiness": (s - m) / F.nullif(s + m, F.lit(0.0)),
        "ten_per_sentence": T.count_of(clean, f"[{rules.commas[:1]}]") / n, "dash_per_1k": T.per_thousand(T.count_of(clean, rules.dash), chars), "kanji_ratio": T.count_of(clean, rules.ideograph) / F.nullif(chars, F.lit(0)),
        "polite_ratio": T.share_like(F.col("sents"), rules.polite), "plain_ratio": T.share_like(F.col("sents"), rules.plain),
        "paragraph_cv": F.when(many, F.col("paragraph_sd") / F.col("paragraph_mean")), "paragraph_mean": F.when(many, F.col("paragraph_mean")),
        "has_closing": F.coalesce(T.closing_heading(F.col("md.headings"), rules), F.lit(False)), "n_links": F.col("all_links") - F.col("n_images"), "images_per_1k": T.per_thousand(F.col("n_images"), chars),
    })


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """The keys and MEASURES with the digits a report shows."""
    return df.select(*keys, *[F.round(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in MEASURES])
