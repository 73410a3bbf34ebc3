"""Text expressions: built-in functions over columns, which stay in the JVM, but for ``class_counts`` and ``counts_of``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .rules import Rules

SPACE = "(?U)\\s"
#: The characters that it stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def solid_length(text: Column) -> Column:
    """Characters that are no white space, in the Unicode sense."""
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


def mora(text: Column) -> Column:
    """Approximate morae: characters without white space and small y-kana."""
    return F.length(F.regexp_replace(text, "(?U)[\\sゃゅょャュョ]+", ""))


def per_thousand(n: Column, chars: Column) -> Column:
    return n / F.nullif(chars, F.lit(0)) * 1000


def count_of(text: Column, pattern: str, needs: str = "") -> Column:
    """How many hits a pattern has; ``needs``: what stands in every hit, which is looked for first. Those of
    one class of characters are what is gone without them, as ``regexp_count`` makes a string of each hit."""
    if re.fullmatch(r"\[[^\[\]\\&]+\]", pattern):
        return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))
    hits = F.regexp_count(text, F.lit(pattern))
    return F.when(~F.contains(text, F.lit(needs)), 0).otherwise(hits) if needs else hits


def class_counts(text: Column, classes: Sequence[str]) -> Column:
    """Array of how many characters of each class, like ``[0-9a-f]`` without escapes, a text has. All are looked up
    in one pass over the characters as an array; classes are of the basic plane and may overlap."""
    masks = np.zeros(1 << 16, np.uint32)
    for k, pattern in enumerate(classes):
        inner = re.fullmatch(r"\[([^\[\]\\&^]+)\]", pattern)
        for a, b in re.findall(r"(?s)(.)(?:-(.))?", inner[1]):
            if ord(b or a) >= 1 << 16:
                raise ValueError(pattern)
            masks[ord(a) : ord(b or a) + 1] |= np.uint32(1 << k)
    kinds, of = np.unique(masks, return_inverse=True)
    of, has = of.astype(np.uint8), (kinds[:, None] >> np.arange(len(classes), dtype=np.uint32)) & 1

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            units = (None if x is None else np.frombuffer(x.encode("utf-16-le"), np.uint16) for x in column)
            yield pd.Series([None if x is None else (np.bincount(of[x], minlength=len(has)) @ has).astype(np.int32) for x in units], dtype=object)

    return counts(text)


#: Patterns that mean the same to Java and Python: letters, digits, some signs, classes, groups, counts, looks around.
_COMMON = re.compile(r"(?:\(\?(?::|<?!)|\((?!\?)|[)|?+]|\{\d+,\d+\}|\[\^?(?:[^\[\]\\&^]|\\n)+\]|\\[*]|[^\W]|[、。 ])+")


def _compiled(pattern: str) -> re.Pattern | None:
    """A pattern for Python, if it means the same there and no empty text is a hit."""
    try:
        found = re.compile(pattern) if _COMMON.fullmatch(pattern) else None
    except re.error:  # a look back of several lengths
        return None
    return None if found is None or found.search("") else found


def _is_class(pattern: str) -> bool:
    """Whether :func:`class_counts` can count a pattern."""
    return bool(re.fullmatch("\\[[^\\[\\]\\\\&^]+\\]", pattern)) and max(pattern) <= "\uffff"


def counts_of(text: Column, patterns: Sequence[str], needs: Callable[[str], str] = lambda _: "") -> list[Column]:
    """:func:`count_of` for each of some patterns. Those that Python reads the same are counted there, all as a text passes
    once: its search looks for the first letters of a hit, where Java's tries each place, and it makes fewer strings."""
    classes = {p: k for k, p in enumerate(dict.fromkeys(p for p in patterns if _is_class(p)))}
    own = {p: (needs(p), _compiled(p)) for p in dict.fromkeys(patterns) if p not in classes}
    own = {p: (need, found) for p, (need, found) in own.items() if found}

    @F.pandas_udf("array<int>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def count(x: str) -> list[int]:
            return [x.count(p) if p.isalnum() else len(found.findall(x)) if need in x else 0 for p, (need, found) in own.items()]

        for column in batches:
            yield pd.Series([None if x is None else count(x) for x in column], dtype=object)

    of_class, of_own, at = class_counts(text, list(classes)), hits(text), {p: k for k, p in enumerate(own)}
    return [F.get(of_class, F.lit(classes[p])) if p in classes else F.get(of_own, F.lit(at[p])) if p in at else count_of(text, p, needs(p)) for p in patterns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_words(text: Column) -> tuple[Column, Column]:
    """English words inside of inline code, and outside of it."""
    inside = F.array_join(F.regexp_extract_all(text, F.lit(R.INLINE_CODE), F.lit(0)), " ")
    return count_of(inside, R.ENGLISH), count_of(F.regexp_replace(text, R.INLINE_CODE, " "), R.ENGLISH)


def clean_inline(text: Column) -> Column:
    """Prose of a line: images, inline code, tags and emphasis go, links leave their text."""
    for pattern, to in ((R.IMAGE, ""), (R.LINK, "$1"), (R.INLINE_CODE, ""), (R.HTML_TAG, ""), (R.EMPHASIS, "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def sentences(text: Column, rules: Rules) -> Column:
    """Array of sentences: a line that ends in a comma goes on in the next; the rest ends at lines and after stops."""
    joined = F.regexp_replace(text, f"(?U)([{rules.commas}])\\s*\\R\\s*", "$1")
    parts = F.split(F.regexp_replace(joined, f"[{rules.stops}]", "$0\n"), "[\\n-\\r\\x85\\u2028\\u2029]+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers; null if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def spread_of(values: Column) -> Column:
    """Population SD of an array of numbers, by its sums."""
    n = F.nullif(F.size(values), F.lit(0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))


def burstiness(lengths: Column) -> Column:
    """(sd - mean) / (sd + mean) of at least two lengths; null if both are zero."""
    m, s = mean_of(lengths), spread_of(lengths)
    return F.when(F.size(lengths) >= 2, (s - m) / F.nullif(s + m, F.lit(0.0)))


def type_token_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) / F.nullif(F.size(tokens), F.lit(0))


def _factors(tokens: Column) -> Column:
    state = F.struct(F.lit(0.0).alias("f"), F.expr("cast(array() as array<string>)").alias("types"), F.lit(0).alias("n"))

    def step(a: Column, token: Column) -> Column:
        types = F.when(F.array_contains(a["types"], token), a["types"]).otherwise(F.array_append(a["types"], token))
        n = a["n"] + 1
        full = F.size(types) / n <= R.MTLD_FACTOR
        return F.struct(F.when(full, a["f"] + 1).otherwise(a["f"]).alias("f"), F.when(full, F.expr("cast(array() as array<string>)")).otherwise(types).alias("types"), F.when(full, 0).otherwise(n).alias("n"))

    rest = lambda a: F.when(a["n"] > 0, a["f"] + (1 - F.size(a["types"]) / a["n"]) / (1 - R.MTLD_FACTOR)).otherwise(a["f"])
    return F.aggregate(tokens, state, step, rest)


def mtld(tokens: Column) -> Column:
    """Measure of textual lexical diversity, forward and backward; null under 50 tokens. A factor's types are few (its
    ratio falls to 0.72 soon), so a step is short; for texts whose types never repeat use ``operators.tokens.mtld``."""
    n = F.size(tokens)
    one = lambda t: F.when(_factors(t) > 0, n / _factors(t)).otherwise(n)
    return F.when(n >= R.MTLD_TOKENS, (one(tokens) + one(F.reverse(tokens))) / 2)


def closing_heading(headings: Column, rules: Rules) -> Column:
    return F.exists(headings, lambda h: h.rlike(rules.closing))


def share_like(items: Column, pattern: str) -> Column:
    """Share of an array's strings that match."""
    return F.size(F.filter(items, lambda s: s.rlike(pattern))) / F.nullif(F.size(items), F.lit(0))


def cut_at_stop(text: Column, limit: int, stop: str = "。") -> Column:
    """At most ``limit`` characters, back to the last stop if that stands in their second half."""
    head = F.substring(text, 1, limit)
    at = F.instr(F.reverse(head), stop)
    return F.when(F.length(text) <= limit, text).when((at > 0) & (F.length(head) - at > limit // 2), F.substring(head, F.lit(1), F.length(head) - at + 1)).otherwise(head)


def weight(sentence_count: Column) -> Column:
    return F.least(F.lit(1.0), sentence_count / F.lit(float(R.FULL_WEIGHT)))


def first_domain(tags: Column, domains: Mapping[str, Sequence[str]], other: str) -> Column:
    """The first domain, in the order given, of which a tag is one."""
    low = F.transform(tags, F.lower)
    return F.coalesce(*[F.when(F.arrays_overlap(low, F.array(*[F.lit(t.lower()) for t in names])), F.lit(d)) for d, names in domains.items()], F.lit(other))


def exclusion_reason(text: Column, title: Column, private: Column, slide: Column, rules: Rules) -> Column:
    """The first reason to leave an article out, or null."""
    chars, letters = solid_length(text), count_of(text, rules.letters)
    kana = count_of(text, rules.kana)
    return (
        F.when(private, "private").when(slide, "slide_mode").when(F.coalesce(F.regexp_replace(text, SPACE, ""), F.lit("")) == "", "empty_body")
        .when(chars < R.MIN_CHARS, "short_body").when(letters < R.MIN_SHARE * chars, "other_script").when(letters < R.MIN_LETTERS, "few_letters")
        .when(kana < R.MIN_KANA * chars, "low_kana").when(title.rlike("(?iu)^(memo|メモ|備忘録)"), "memo_post").when(F.size(sentences(text, rules)) < R.MIN_SENTENCES, "few_sentences")
    )


def edit_delay(created: Column, updated: Column) -> Column:
    """same, quick (under an hour, negative delays too) or later; null if either time is."""
    delay = F.unix_timestamp(updated) - F.unix_timestamp(created)
    return F.when(delay == 0, "same").when(delay < 3600, "quick").when(delay >= 3600, "later")


def percentile_of(value: Column, p10: Column, p25: Column, p50: Column, p75: Column, p90: Column, compat: bool = False) -> Column:
    """Place of a value in a reference distribution, piecewise linear from 10 to 90; 95 above, and below p10 what is
    left of p10, clamped to 0..10 unless ``compat``."""
    low = F.when(p10 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 10 * value / p10))
    out = F.when(value <= p10, low if compat else F.least(low, F.lit(10.0))).when(value >= p90, F.lit(95.0))
    for a, b, x, y in ((p10, p25, 10, 25), (p25, p50, 25, 50), (p50, p75, 50, 75), (p75, p90, 75, 90)):
        out = out.when(value <= b, F.when(b == a, F.lit(float(x))).otherwise(x + (value - a) / F.nullif(b - a, F.lit(0.0)) * (y - x)))
    return out


def deviation(percentile: Column, direction: Column) -> Column:
    """0..1: how far a percentile is from the middle in the watched direction (low, high or two)."""
    return F.when(direction == "low", F.greatest(F.lit(0.0), 50 - percentile) / 50).when(direction == "high", F.greatest(F.lit(0.0), percentile - 50) / 50).otherwise(F.abs(percentile - 50) / 50)


def position_label(value: Column, p10: Column, p25: Column, _p50: Column, p75: Column, p90: Column) -> Column:
    """Where a value stands in a distribution, in words; a value on an edge is outside it."""
    return F.when(value <= p10, "far below").when(value <= p25, "below").when(value >= p90, "far above").when(value >= p75, "above").otherwise("usual")


def spark_line(value: Column, low: Column, high: Column) -> Column:
    """One of eight bars for a value between the extremes of its series."""
    step = F.when(high > low, F.floor((value - low) / (high - low) * 7)).otherwise(3)
    return F.substring(F.lit("▁▂▃▄▅▆▇█"), F.least(F.lit(7), step).cast("int") + 1, F.lit(1))
