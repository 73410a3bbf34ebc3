"""Sentences that end in a noun (``functions.japanese.is_nominal``), and what stands around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

def contexts(sentences: DataFrame) -> DataFrame:
    """Adds to rows (key, paragraph, pos, sentence): mora, neighbours and place in the paragraph."""
    w = Window.partitionBy("key", "paragraph").orderBy("pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "paragraph"))
    mora, at = T.mora(F.col("sentence")), F.row_number().over(w)
    rows = sentences.withColumn("mora", mora)
    return rows.withColumns({
        "prev": F.lag("sentence").over(w), "next": F.lead("sentence").over(w), "prev_mora": F.lag("mora").over(w), "next_mora": F.lead("mora").over(w),
        "position": F.when(at == 1, "first").when(at == n, "last").otherwise("middle"), "para_sentences": n,
    })


def summary(found: DataFrame, flag: str = "nominal") -> DataFrame:
    """Share of flagged sentences, their length against all, how many are shorter than the one before, and positions."""
    hit = F.col(flag)
    pct = lambda c: 100.0 * F.count_if(hit & c) / F.nullif(F.count_if(hit), F.lit(0))
    return found.agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(hit).alias("flagged"), F.avg(F.when(hit, F.col("mora"))).alias("mean_mora"), F.avg("mora").alias("mean_mora_all"),
        pct(F.col("mora") < F.col("prev_mora")).alias("shorter_pct"), pct(F.col("position") == "first").alias("first_pct"), pct(F.col("position") == "last").alias("last_pct"),
    )


def tails(found: DataFrame, tail: str, n: int, flag: str = "nominal") -> DataFrame:
    """A top-n report: the words that most flagged sentences end in."""
    return found.where(F.col(flag)).groupBy(F.col(tail).alias("tail")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tail").limit(n)
