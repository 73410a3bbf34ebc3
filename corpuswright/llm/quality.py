"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; a policy
is a versioned bitmask, so a verdict, a change of policy or an ablation is a bitwise operation on the ledger and
never reads a text again.

Defined results: a null text has no words; a null doc_id is kept as it is; repeated rows each get their own row;
an empty table gives an empty ledger; a column of the input that bears the name of an output is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words_of

HASH = -1  # bits of a window's hash that are used
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")



def rules() -> dict[str, Column]:
    """The rules in bit order, over the columns in MEASURES."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "too_many_words": c("n_words") > 1_000_000,
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "symbols": 100 * c("n_symbols") > 10 * c("n_words"),
        "duplicate_lines": (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "digits": 100 * c("n_digits") > 50 * c("word_chars"),
    }


#: Policy version -> names of the rules that reject a document.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("too_few_words", "repeated_windows"),
    2: ("too_few_words", "repeated_windows", "too_many_words", "word_length", "symbols", "duplicate_lines", "digits"),
}


def mask_of(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in names)


def _without(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _fixed(value: Column) -> Column:
    """The value, marked as one that a later filter must not compute again in its own place: pushed below the
    projections it would repeat each of their expressions as often as the next one names it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds MEASURES. A 3-word window is known by a hash with its place in the low bits: sorting brings equal
    windows together, and the words of neighbours are compared before two are called equal. Where a neighbour has the
    same hash but other words, the window is compared with all of that hash."""
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    one = df.withColumn("_cw_w", words_of(F.col(text))).withColumn("_cw_lines", lines)
    n = F.size("_cw_w")
    one = one.withColumns({
        "_cw_low": F.length(F.bin(n.cast("long"))),
        "n_words": n.cast("long"),
        "word_chars": (F.length(full) - _without(full, BLANKS)).cast("long"),
        "n_symbols": _without(full, "#*$%&|<>").cast("long"),
        "n_digits": _without(full, "0123456789").cast("long"),
        "n_lines": F.size("_cw_lines").cast("long"),
        "n_dup_lines": (F.size("_cw_lines") - F.size(F.array_distinct("_cw_lines"))).cast("long"),
    })
    word = lambda i: F.get(F.col("_cw_w"), i)
    low = F.expr("shiftleft(1L, _cw_low) - 1")
    two = one.withColumn("_cw_mask", F.coalesce(low, F.lit(0).cast("long")))
    keyed = F.transform(
        F.sequence(F.lit(0).cast("long"), n.cast("long") - 3),
        lambda i: F.xxhash64(word(i.cast("int")), word(i.cast("int") + 1), word(i.cast("int") + 2)).bitwiseAND(F.lit(HASH)).bitwiseAND(F.bitwise_not("_cw_mask")).bitwiseOR(i),
    )
    three = two.withColumn("_cw_s", F.when(n >= 3, F.sort_array(keyed)).otherwise(F.array().cast("array<bigint>")))

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("_cw_mask")) == 0, F.lit(False))

    def same(x: Column, y: Column) -> Column:
        p, q = (v.bitwiseAND(F.col("_cw_mask")).cast("int") for v in (x, y))
        return alike(x, y) & (word(p) == word(q)) & (word(p + 1) == word(q + 1)) & (word(p + 2) == word(q + 2))

    def repeats(x: Column, i: Column) -> Column:
        after, before = F.get("_cw_s", i + 1), F.when(i > 0, F.get("_cw_s", i - 1))
        near = alike(x, after) | alike(x, before)  # of most windows, no other has the hash
        beside = same(x, after) | F.coalesce(same(x, before), F.lit(False))
        return F.when(near, beside | F.exists("_cw_s", lambda y: (x != y) & same(x, y))).otherwise(False)

    again = F.filter("_cw_s", repeats)
    four = three.withColumn("_cw_p", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("_cw_mask")))))
    reach = F.transform("_cw_p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_cw_p", i + 1) - p, F.lit(3).cast("long"))))
    five = four.withColumn("n_repeat_words", _fixed(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)))
    return five.drop("_cw_w", "_cw_lines", "_cw_low", "_cw_mask", "_cw_s", "_cw_p")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns, the measurements, and ``failed_bits``: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, fails in enumerate(rules().values()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return _measured(df, text).withColumn("failed_bits", _fixed(bits))


def judged(book: DataFrame, policy: int = 2) -> DataFrame:
    """Adds ``base_failed`` and ``kept``: the verdict of the policy on each row of the ledger."""
    hit = lambda names: F.col("failed_bits").bitwiseAND(F.lit(mask_of(names)).cast("long")) != 0
    base = hit(POLICIES[1])
    return book.withColumns({"base_failed": base, "kept": ~base & ~hit(POLICIES[policy]), "policy": F.lit(policy)})


def ablation(book: DataFrame, policy: int = 2) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that fail nothing else of the policy (so that dropping
    the rule would keep them), and all rules seen to fail together with it, as bits."""
    mask = mask_of(POLICIES[policy])
    seen = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    order = list(rules())
    patterns = book.groupBy(seen.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    each = patterns.withColumn("rule", F.explode(F.array(*[F.lit(x) for x in POLICIES[policy]])))
    bit = F.element_at(F.create_map(*[v for x in POLICIES[policy] for v in (F.lit(x), F.lit(1 << order.index(x)).cast("long"))]), F.col("rule"))
    own = F.col("bits").bitwiseAND(bit) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0).cast("long")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0).cast("long")).alias("failed_alone"),
        F.coalesce(F.bit_or(F.when(own, F.col("bits"))), F.lit(0).cast("long")).alias("together_bits"),
    )


def op9(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements, base_failed, kept, failed_bits and policy of every document."""
    book = judged(ledger(documents.select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", "policy")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
g AS (
  SELECT rid, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
v AS (SELECT rid, count(DISTINCT p + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS u_lines,
    len(regexp_extract_all(t, '[0-9]'))::BIGINT AS n_digits,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN v USING (rid)),
b AS (
  SELECT *, n_lines - u_lines AS n_dup_lines,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 10 * n_words THEN 16 ELSE 0 END
     + CASE WHEN n_lines - u_lines >= 3 AND 100 * (n_lines - u_lines) > 30 * n_lines THEN 32 ELSE 0 END
     + CASE WHEN 100 * n_digits > 50 * word_chars THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits, 2 AS policy
FROM b
"""
