"""Token-level operators. The tokenizer is pluggable: anything that gives (surface, lemma, pos1, pos3, goshu) a token."""

from __future__ import annotations

import multiprocessing
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

TOKEN = "array<struct<surface:string,lemma:string,pos1:string,pos3:string,goshu:string>>"
Tokenizer = Callable[[str], list[tuple[str, str, str, str, str]]]
#: Runs of one script; hiragana by the particles and endings that it is written with, the longest first.
PARTICLES, ENDINGS = ("から", "まで", "より", "は", "が", "を", "に", "で", "と", "へ", "の", "も", "や"), ("ました", "ません", "でした", "でしょう", "します", "ます", "です", "した", "ない", "だ", "た")
_word = re.compile(f"[一-鿿々]+|[ァ-ヶー]+|{'|'.join(ENDINGS)}|{'|'.join(PARTICLES)}|[ぁ-ん]|[^\\W\\d_ぁ-んァ-ヶー一-鿿々]+|\\d+|[^\\w\\s]")


def simple_tokenizer(text: str) -> list[tuple[str, str, str, str, str]]:
    """The default backend: runs of one script, numbers and signs. Parts of speech are by look: particles and endings that
    it knows, other hiragana is of an unknown kind, the rest are nouns. For real ones use an analyser."""
    out = []
    for surface in _word.findall(text):
        hiragana = "ぁ" <= surface[0] <= "ん"
        kind = "助詞" if surface in PARTICLES else "助動詞" if surface in ENDINGS else "未知語" if hiragana else "名詞" if surface[0].isalpha() else "数詞" if surface[0].isdigit() else "補助記号"
        out.append((surface, surface.lower(), kind, "", ""))
    return out


def morphological_tokenizer() -> Tokenizer:
    """A backend with parts of speech, where the optional analyser is installed."""
    import fugashi

    tagger = fugashi.Tagger()
    return lambda text: [(w.surface, w.feature.lemma or w.surface, w.feature.pos1, w.feature.pos3, w.feature.goshu or "") for w in tagger(text)]


def isolated(factory: Callable[[], Tokenizer], text: str, timeout: float) -> list:
    """The tokens of a text from a process of its own, so that neither a crash nor an endless run takes the worker along."""
    context = multiprocessing.get_context("fork")
    ours, theirs = context.Pipe(duplex=False)

    def work() -> None:
        try:
            theirs.send((factory()(text), None))
        except Exception as error:  # noqa: BLE001
            theirs.send((None, type(error).__name__))

    child = context.Process(target=work, daemon=True)
    child.start()
    theirs.close()
    try:
        if not ours.poll(timeout):
            raise TimeoutError(f"no tokens after {timeout} s")
        found, error = ours.recv()
    except EOFError:
        raise ChildProcessError("the tokenizer's process ended without an answer") from None
    finally:
        child.kill()
        child.join()
        ours.close()
    if error:
        raise RuntimeError(error)
    return found


def tokenized(df: DataFrame, text: str, factory: Callable[[], Tokenizer] = lambda: simple_tokenizer, limit: int = 100_000, stop: str = "。", isolate: int = 50_000, timeout: float = 60.0) -> DataFrame:
    """Adds ``tokens`` and ``tokens_error``. A text over the limit is cut at its last stop before it; one of more than
    ``isolate`` characters is worked on in a process of its own for ``timeout`` seconds at most; a text on which the
    tokenizer fails has null tokens and the error's name, so that the row can be reported and not lost."""
    from ..functions.text import cut_at_stop

    @F.pandas_udf(f"tokens {TOKEN}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenize = factory()  # one a worker
        for column in batches:
            rows = []
            for x in column:
                try:
                    found = None if x is None else isolated(factory, x, timeout) if len(x) > isolate else tokenize(x)
                    rows.append((found and [dict(zip(("surface", "lemma", "pos1", "pos3", "goshu"), t, strict=True)) for t in found], None))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["tokens", "error"])

    out = df.withColumn("_t", run(cut_at_stop(F.col(text), limit, stop)))
    return out.withColumns({"tokens": F.col("_t.tokens"), "tokens_error": F.col("_t.error"), "pos_truncated": F.length(text) > limit}).drop("_t")


def _diversity(codes: np.ndarray) -> float:
    """Tokens per factor of integer-coded tokens. A token is new in the factor that began at ``begin`` if it stood last
    before that; the factor ends at the first place where its new tokens make up a share of MTLD_FACTOR at most."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)  # where each token stood last
    again = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
    before[order[again + 1]] = order[again]
    factors, begin, stretch = 0.0, 0, 256
    while begin < n:
        upto = min(n, begin + stretch)
        share = np.cumsum(before[begin:upto] < begin) / np.arange(1, upto - begin + 1)
        ends = np.flatnonzero(share <= R.MTLD_FACTOR)
        if len(ends):
            factors, begin, stretch = factors + 1, begin + int(ends[0]) + 1, 256
        elif upto == n:
            factors += (1 - float(share[-1])) / (1 - R.MTLD_FACTOR)
            break
        else:
            stretch *= 4
    return n / factors if factors > 0 else float(n)


def mtld_of(tokens: list[str]) -> float | None:
    if len(tokens) < R.MTLD_TOKENS:
        return None
    codes = pd.factorize(np.array(tokens, dtype=object))[0]
    return (_diversity(codes) + _diversity(codes[::-1])) / 2


def mtld(tokens: Column | str) -> Column:
    """Lexical diversity in linear time, for tokens as an array of strings."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else mtld_of(list(x)))

    return run(tokens)


def pos_shares(tokens: Column) -> dict[str, Column]:
    """Shares of parts of speech and of verbal nouns, of Sino-Japanese among words of known origin, and per 1000 tokens
    the verbal nouns that follow another, that take する, and that take が or を."""
    n = F.nullif(F.size(tokens), F.lit(0))
    share = lambda test: F.size(F.filter(tokens, test)) / n
    verbal = lambda t: t["pos3"] == "サ変可能"
    after = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = lambda test: F.size(F.filter(F.zip_with(F.slice(tokens, F.lit(1), F.size(after)), after, lambda a, b: verbal(a) & test(b)), lambda x: x)) / n * 1000
    kinds = ("名詞", "動詞", "助詞", "助動詞", "形容詞", "副詞", "接続詞")
    is_kind = lambda k: lambda t: t["pos1"] == k
    origins = F.nullif(F.size(F.filter(tokens, lambda t: t["goshu"].isin("漢", "和", "外", "混"))), F.lit(0))
    return {f"pos_{k}_ratio": share(is_kind(k)) for k in kinds} | {
        "sahen_noun_ratio": share(verbal), "kango_ratio": F.size(F.filter(tokens, lambda t: t["goshu"] == "漢")) / origins, "sahen_chain_per_1000": pairs(verbal),
        "sahen_verb_per_1000": pairs(lambda t: t["lemma"].isin("為る", "する")), "sahen_case_per_1000": pairs(lambda t: t["surface"].isin("が", "を") & (t["pos1"] == "助詞")),
    }


#: Marks of tokens: a run of kanji (a verbal noun from two on, else another noun), of katakana, of Latin letters.
VERBAL, SINO, KATAKANA, LATIN = "0", "1", "2", "3"


def script_marks(text: Column) -> Column:
    """A text whose tokens are runs of one script as a string of one character a token, in their order: the marks above,
    and hiragana, each of which is a token, as they are; all else is between tokens. Shares of :func:`pos_shares` follow
    from it without a row for each token."""
    for pattern, to in (("[^一-鿿ァ-ヶーぁ-んA-Za-z]+", " "), ("[A-Za-z]+", LATIN), ("[一-鿿]{2,}", VERBAL), ("[一-鿿]", SINO), ("[ァ-ヶー]+", KATAKANA), (" ", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def mark_counts(marks: Column) -> dict[str, Column]:
    """Of :func:`script_marks`: tokens, verbal nouns, Sino-Japanese words and words of known origin, which Latin ones are
    not, verbal nouns that follow another, and that take が or を."""
    count = lambda p: F.regexp_count(marks, F.lit(p))
    gone = lambda p: F.length(marks) - F.length(F.regexp_replace(marks, p, ""))
    return {"n": F.length(marks), "sahen": gone(f"{VERBAL}+"), "kango": gone(f"[{VERBAL}{SINO}]+"), "known": F.length(F.regexp_replace(marks, f"{LATIN}+", "")), "chains": count(f"{VERBAL}(?={VERBAL})"), "cases": count(f"{VERBAL}[がを]")}


def mark_shares(marks: Column) -> dict[str, Column]:
    """Those of :func:`pos_shares` that :func:`script_marks` tell."""
    c = mark_counts(marks)
    n = F.nullif(c["n"], F.lit(0))
    return {"sahen_noun_ratio": c["sahen"] / n, "kango_ratio": c["kango"] / F.nullif(c["known"], F.lit(0)), "sahen_chain_per_1000": c["chains"] / n * 1000, "sahen_case_per_1000": c["cases"] / n * 1000}


def is_target(lemma: Column, stopwords: Column, pos1: Column | None = None, kinds: tuple[str, ...] = ("名詞", "動詞", "形容詞", "副詞"), ascii_too: bool = False) -> Column:
    """Content words: of these parts of speech where they are known, of two characters at least, no stopword, not of digits
    only, and unless ``ascii_too`` not of ASCII only."""
    out = (F.length(lemma) >= 2) & ~F.array_contains(stopwords, lemma) & ~lemma.rlike("^[0-9]+$")
    if not ascii_too:
        out = out & ~lemma.rlike("^[\\x00-\\x7F]+$")
    return out if pos1 is None else out & pos1.isin(*kinds)


def words_of(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pos, word) of the lower-cased words that match a pattern."""
    return df.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1))).alias("pos", "word"))


def frequencies(words: DataFrame, *by: str) -> DataFrame:
    """freq and doc_freq of each word. Words are counted by document first, so the second step counts rows."""
    each = words.groupBy(*by, "key", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by, "word").agg(F.sum("n").alias("freq"), F.count(F.lit(1)).alias("doc_freq"))


def log_odds(a: DataFrame, b: DataFrame, prior_scale: float = 0.01) -> DataFrame:
    """z-score of each word's log odds between two corpora (word, freq), with an informative Dirichlet prior."""
    both = a.select("word", F.col("freq").alias("fa")).join(b.select("word", F.col("freq").alias("fb")), "word", "full_outer").fillna(0, ["fa", "fb"])
    totals = both.agg(F.sum("fa").alias("na"), F.sum("fb").alias("nb"))
    x = both.crossJoin(F.broadcast(totals)).withColumn("n", F.col("na") + F.col("nb"))
    a0 = F.lit(prior_scale) * F.col("n")
    prior = a0 * (F.col("fa") + F.col("fb")) / F.col("n")
    odds = lambda f, n: F.ln((F.col(f) + prior) / (F.col(n) + a0 - F.col(f) - prior))
    z = (odds("fb", "nb") - odds("fa", "na")) / F.sqrt(1 / (F.col("fa") + prior) + 1 / (F.col("fb") + prior))
    return x.select("word", F.col("fa").alias("freq_a"), F.col("fb").alias("freq_b"), z.alias("z"))


def lexical_window(df: DataFrame, key: str, text: str, pattern: str, size: int, most: int) -> DataFrame:
    """Of documents with size..most words: share of the top word, of words that occur once, and types, over the first
    ``size`` words (that window is the measure). Only those words leave a row."""
    found = df.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1)).alias("t")).where(F.size("t").between(size, most))
    counts = found.select("key", F.explode(F.slice("t", 1, size)).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("key").agg((F.max("c") / size).alias("top_share"), (F.count_if(F.col("c") == 1) / F.count(F.lit(1))).alias("hapax_share"), (F.count(F.lit(1)) / size).alias("ttr"))
