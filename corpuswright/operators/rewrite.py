"""Rewrites: which words a round trip loses and gains, with an injectable translator."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replaced(text: Column, pairs: Mapping[str, str]) -> Column:
    """A text after each plain replacement in turn. It goes through Python once, where a search skips ahead; Spark's
    compares at each byte, for each of the words."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for x in column:
                if x is not None:
                    for a, b in pairs.items():
                        x = x.replace(a, b)  # noqa: PLW2901
                out.append(x)
            yield pd.Series(out, dtype=object)

    return run(text)


def translated(text: Column, pairs: Mapping[str, str], letters: str, to: str) -> Column:
    """:func:`replaced`, then each of ``letters`` by that in its place in ``to`` or, if there is none, by nothing. All are
    of the basic plane. Characters are looked up as an array; Spark's ``translate`` makes a string of each."""
    table, stays = np.arange(1 << 16, dtype=np.uint16), np.ones(1 << 16, bool)
    for k in range(len(letters) - 1, -1, -1):  # the first of equal ones decides
        table[ord(letters[k])], stays[ord(letters[k])] = (ord(to[k]) if k < len(to) else 0), k < len(to)

    @F.pandas_udf("string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for x in column:
                if x is not None:
                    for a, b in pairs.items():
                        x = x.replace(a, b)  # noqa: PLW2901
                    units = np.frombuffer(x.encode("utf-16-le"), np.uint16)
                    x = table[units[stays[units]]].tobytes().decode("utf-16-le")  # noqa: PLW2901
                out.append(x)
            yield pd.Series(out, dtype=object)

    return translate(text)


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Which of some words a text contains, in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def eligible(sentences: DataFrame, sentence: str, words: Sequence[str], low: int = 25, high: int = 90, most_ascii: float = 0.3) -> DataFrame:
    """Sentences of a fitting length with exactly one of the words and few ASCII characters; adds target_word."""
    s = F.col(sentence)
    found = words_in(s, words)
    ascii_share = F.regexp_count(s, F.lit("[\\x21-\\x7e]")) / F.nullif(F.length(s), F.lit(0))
    return sentences.where(F.length(s).between(low, high) & (F.size(found) == 1) & (ascii_share <= most_ascii)).withColumn("target_word", F.get(found, F.lit(0)))


def balanced(jobs: DataFrame, year: str, article: str, sentence: str, per_year: int, seed: int = 42) -> DataFrame:
    """A sampling operator: so many sentences of each year, one of an article and none twice, in an order fixed by a hash."""
    order = F.xxhash64(F.col(sentence), F.lit(seed))
    one = jobs.dropDuplicates([sentence]).withColumn("_k", F.row_number().over(Window.partitionBy(article).orderBy(order, sentence))).where("_k = 1")
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(year).orderBy(order, article))).where(F.col("_k") <= per_year).drop("_k")


class Refused(Exception):
    """A service asks to come back later."""


def patient(call: Callable[[str], str | None], tries: int = 6, first: float = 3.0, most: float = 45.0, jitter: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """``call``, tried again while it is refused: each time 1.8 times as long a wait, up to ``most`` seconds, and a random
    part on top, so that workers who were refused together don't come back together. None after the last try."""

    def run(text: str) -> str | None:
        wait = first
        for _ in range(tries):
            try:
                return call(text)
            except Refused:
                sleep(wait + random.random() * jitter)  # noqa: S311
                wait = min(wait * 1.8, most)
        return None

    return run


def round_trip(jobs: DataFrame, text: str, translate: Callable[[str], str | None], workers: int = 3) -> DataFrame:
    """Adds ``after``, the text's round trip, and ``state``. ``workers`` bounds how many calls run at once; a call that is
    refused is tried again (:func:`patient`), one that gives None or fails is a failed row, to be claimed again."""
    translate = patient(translate)

    @F.pandas_udf("after string, state string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for x in column:
                try:
                    y = None if x is None else translate(x)
                except Exception:  # noqa: BLE001
                    y = None
                rows.append((y, "failed" if y is None else "done"))
            yield pd.DataFrame(rows, columns=["after", "state"])

    out = jobs.repartition(workers).withColumn("_r", run(F.col(text)))
    return out.withColumns({"after": F.col("_r.after"), "state": F.col("_r.state")}).drop("_r")


def changes(done: DataFrame, before: str, after: str, words: Sequence[str]) -> DataFrame:
    """Adds lost and gained: words that only one side contains."""
    a, b = words_in(F.col(before), words), words_in(F.col(after), words)
    return done.withColumns({"lost": F.array_except(a, b), "gained": F.array_except(b, a), "kept_words": F.array_intersect(a, b)})


def survival(changed: DataFrame, least: int = 5) -> DataFrame:
    """Of each word: how often it was there, how often it stayed."""
    seen = changed.select(F.explode(F.array_union("lost", "kept_words")).alias("word"), "kept_words")
    out = seen.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.array_contains("kept_words", F.col("word"))).alias("stayed"))
    return out.where(F.col("seen") >= least).withColumn("survival_pct", 100.0 * F.col("stayed") / F.col("seen"))


def replacements(changed: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pairs of a lost and a gained word of the same concept, counted, by the table ``concepts`` (word, concept). Both
    sides look their concept up first, so only words of one concept in one rewrite are paired."""
    rows = changed.withColumn("_r", F.monotonically_increasing_id())
    side = lambda name: rows.select("_r", F.explode(name).alias("word")).join(concepts, "word").select("_r", "concept", F.col("word").alias(name))
    return side("lost").join(side("gained"), ["_r", "concept"]).groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("n"))


def vanished(changed: DataFrame, n: int = 15) -> DataFrame:
    """A top-n report: words that most rewrites lost without a word that came."""
    gone = changed.where(F.size("gained") == 0).select(F.explode("lost").alias("word"))
    return gone.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n)
