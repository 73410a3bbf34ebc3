"""Batteries over several measures, trends that turn, ranked effects, and words that come, go or mark a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import panel as P
from .panel_queries import PANEL, A, B, panel, rounded
from .registry import register
from .text_queries import LEXICON, CONTROL, documents, words

#: Measures of an article beside its value, by expressions that both engines know.
MEASURES = {"value": "value", "likes": "likes", "per_like": "value / (likes + 1)", "day": "day(created)", "rest": "id % 100", "tag_length": "length(tag)"}
FIELDS = MEASURES | {"root": "sqrt(value)", "log_value": "ln(value)", "month_number": "month(created)", "half": "value / 2", "parity": "id % 2", "thirds": "id % 3"}


def measured(spark: SparkSession, sf_dir: str, fields: dict[str, str]) -> DataFrame:
    return panel(spark, sf_dir).withColumns({k: F.expr(e) for k, e in fields.items() if k not in ("value", "likes")})


_cells = " UNION ALL ".join(f"SELECT '{k}' AS metric, ({e})::DOUBLE AS x, period, author, created, id, tag, likes FROM q" for k, e in MEASURES.items())
_cases = {
    "all": "true", "off topic": "tag <> '1-URGENT'", "one per author": "k = 1", "light authors": "n < 3", "returning": "period = 'a' OR e = 1", "likes 0-9": "likes < 10", "likes 10+": "likes >= 10",
}


@register(f"""WITH {PANEL}, q AS (SELECT *, CASE WHEN year = 1996 THEN 'a' ELSE 'b' END AS period FROM p WHERE year IN (1996, 2000)), x AS ({_cells}),
w AS (SELECT *, count(*) OVER (PARTITION BY metric, author, period) AS n, row_number() OVER (PARTITION BY metric, author, period ORDER BY created, id) AS k, max((period = 'a')::INT) OVER (PARTITION BY metric, author) AS e FROM x),
c AS ({' UNION ALL '.join(f"SELECT '{n}' AS c, metric, period, x FROM w WHERE {e}" for n, e in _cases.items())}),
g AS (SELECT metric, c, count(*) FILTER (period = 'a') AS n_a, count(*) FILTER (period = 'b') AS n_b, median(x) FILTER (period = 'a') AS median_a, median(x) FILTER (period = 'b') AS median_b FROM c GROUP BY 1, 2)
SELECT g.metric, g.c AS "case", g.n_a, g.n_b, round(g.median_a, 6) AS median_a, round(g.median_b, 6) AS median_b, round(g.median_b - g.median_a, 6) AS diff, round(100 * (g.median_b - g.median_a) / nullif(o.median_b - o.median_a, 0), 6) AS kept_pct FROM g JOIN g AS o ON o.metric = g.metric AND o.c = 'all'""")
def confound_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sub-populations by six measures."""
    rows = measured(spark, sf_dir, MEASURES)
    return rounded(P.confounds(rows, A(), B(), F.col("tag") == "1-URGENT", metrics=list(MEASURES)), "median_a", "median_b", "diff", "kept_pct")


@register(f"""WITH {PANEL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created, id) AS k FROM p) WHERE k = 1)
SELECT substr(month, 1, 4) AS year, count(*) AS authors, {', '.join(f'round(avg({e}), 6) AS {k}' for k, e in FIELDS.items())} FROM f GROUP BY 1""")
def debut_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve fields of the first articles, by year of debut."""
    return rounded(P.debut_fields(measured(spark, sf_dir, FIELDS), list(FIELDS)), *FIELDS)


@register(f"""WITH {PANEL}, m AS (SELECT month, avg(value) AS m, (substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT - 1) AS at FROM p GROUP BY 1),
g AS (SELECT m.m - (q.m + n.m) / 2 AS gap FROM m JOIN m AS q ON q.at = m.at - 1 JOIN m AS n ON n.at = m.at + 1 WHERE m.at % 12 = 11)
SELECT count(*) AS years, round(avg(gap), 6) AS gap, round(avg(gap) / (SELECT stddev_pop(m) FROM m WHERE m.at % 12 = 11), 6) AS in_own_sd, round(avg(gap) / (SELECT stddev_pop(m) FROM m WHERE m.at % 12 <> 11), 6) AS in_other_sd,
 CASE WHEN avg(gap) > 0 THEN count(*) FILTER (gap > 0) WHEN avg(gap) < 0 THEN count(*) FILTER (gap < 0) ELSE 0 END AS same_sign FROM g""")
def december_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.seasonal_spreads(panel(spark, sf_dir), 12), "gap", "in_own_sd", "in_other_sd")


@register(f"""WITH {PANEL} SELECT year, count(*) AS n, round(coalesce(sum(value * likes) / nullif(sum(likes), 0), avg(value)), 6) AS weighted_mean FROM p GROUP BY 1""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"), P.weighted_mean(F.col("value"), F.col("likes")).alias("weighted_mean"))
    return rounded(out, "weighted_mean")


@register(f"""WITH {PANEL}, y AS (SELECT tag, year, median(value) AS v FROM p GROUP BY 1, 2),
e AS (SELECT tag, min_by(v, year) FILTER (year <= 1996) v0, min(year) FILTER (year <= 1996) y0, max_by(v, year) FILTER (year <= 1996) v1, max(year) FILTER (year <= 1996) y1, max_by(v, year) FILTER (year > 1996) v3, max(year) FILTER (year > 1996) y3 FROM y GROUP BY 1),
s AS (SELECT tag, (v1 - v0) / nullif(y1 - y0, 0) AS pre, (v3 - v1) / nullif(y3 - y1, 0) AS post FROM e)
SELECT tag, round(pre, 6) AS pre_slope, round(post, 6) AS post_slope, round(abs(post) / nullif(abs(pre), 0), 6) AS ratio, CASE WHEN pre * post < 0 THEN 'reversed' WHEN pre = 0 AND post <> 0 OR abs(post) / nullif(abs(pre), 0) > 2 THEN 'faster' WHEN abs(post) / nullif(abs(pre), 0) < 0.5 THEN 'slower' WHEN pre IS NOT NULL AND post IS NOT NULL THEN 'same' END AS label FROM s""")
def slope_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the yearly medians before and after a year, their ratio, and what became of the trend."""
    yearly = panel(spark, sf_dir).groupBy("tag", "year").agg(F.median("value").alias("v"))
    out = P.slopes(yearly, 1996, by=("tag",)).select("tag", "pre_slope", "post_slope")
    pre, post = F.col("pre_slope"), F.col("post_slope")
    return rounded(out.withColumns({"ratio": F.abs(post) / F.nullif(F.abs(pre), F.lit(0.0)), "label": P.reversal(pre, post)}), "pre_slope", "post_slope", "ratio")


@register(f"""WITH {PANEL}, e AS (SELECT tag, (avg(value) FILTER (year = 2000) - avg(value) FILTER (year = 1996)) / nullif(stddev_pop(value) FILTER (year = 1996), 0) AS effect FROM p GROUP BY 1 UNION ALL SELECT 'none', NULL)
SELECT row_number() OVER (ORDER BY abs(effect) DESC NULLS LAST, tag) AS place, tag, round(effect, 6) AS effect FROM e""")
def ranked_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the size of their effect, those without one last; a row a group."""
    value = lambda p: F.when(p, F.col("value"))
    effects = panel(spark, sf_dir).groupBy("tag").agg(((F.avg(value(B())) - F.avg(value(A()))) / F.nullif(F.stddev_pop(value(A())), F.lit(0.0))).alias("effect"))
    effects = effects.unionByName(spark.range(1).select(F.lit("none").alias("tag"), F.lit(None).cast("double").alias("effect")))
    order = Window.orderBy(F.abs("effect").desc_nulls_last(), "tag")  # a row a group
    return rounded(effects.select(F.row_number().over(order).alias("place"), "tag", "effect"), "effect")


_w = "w AS (SELECT DISTINCT doc_id, substr(source, 4)::INT AS year, lang = 'en' AS topic, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)"


@register(f"""WITH {_w}, t AS (SELECT count(*) FILTER (lang = 'en') AS on_topic, count(*) FILTER (lang <> 'en') AS off_topic, count(*) FILTER (substr(source, 4)::INT < 10) AS early, count(*) FILTER (substr(source, 4)::INT >= 10) AS late FROM documents),
c AS (SELECT word, count(*) FILTER (year < 10) AS before, count(*) FILTER (year >= 10) AS after, count(*) FILTER (topic) AS hit, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 10)
SELECT word, round(100.0 * before / early, 6) AS before_pct, round(100.0 * after / late, 6) AS after_pct, round(100.0 * hit / n, 6) AS topic_pct, round(100.0 * (n - hit) / off_topic, 6) AS false_positive_pct FROM c, t WHERE after::DOUBLE / late > 1.3 * before / early""")
def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that grew: of the documents that have them the share on the topic, and of those off it the share that would
    be taken for it."""
    year = F.substring("source", 4, 9).cast("int")
    each = words(spark, sf_dir).select("key", year.alias("year"), (F.col("lang") == "en").alias("topic"), "word").distinct()
    docs = documents(spark, sf_dir, "lang", "source").agg(
        F.count_if(F.col("lang") != "en").alias("off"), F.count_if(year < 10).alias("early"), F.count_if(year >= 10).alias("late")
    )  # one row
    c = each.groupBy("word").agg(F.count_if(F.col("year") < 10).alias("before"), F.count_if(F.col("year") >= 10).alias("after"), F.count_if("topic").alias("hit"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    c = c.crossJoin(F.broadcast(docs)).where(F.col("after") / F.col("late") > 1.3 * F.col("before") / F.col("early"))
    pct = lambda a, b: 100.0 * a / F.col(b)
    out = c.select("word", pct(F.col("before"), "early").alias("before_pct"), pct(F.col("after"), "late").alias("after_pct"), pct(F.col("hit"), "n").alias("topic_pct"), pct(F.col("n") - F.col("hit"), "off").alias("false_positive_pct"))
    return rounded(out, "before_pct", "after_pct", "topic_pct", "false_positive_pct")


_terms = " UNION ALL ".join(f"SELECT '{w}' AS word, {'true' if w in CONTROL else 'false'} AS control, year, len(regexp_extract_all(text, '{w}')) AS n, length(text) AS chars FROM d" for w in LEXICON + CONTROL)


@register(f"""WITH d AS (SELECT substr(source, 4)::INT AS year, lower(text) AS text FROM documents), l AS ({_terms}), r AS (SELECT word, control, 1000.0 * sum(n) FILTER (year < 10) / nullif(sum(chars) FILTER (year < 10), 0) AS a, 1000.0 * sum(n) FILTER (year >= 10) / nullif(sum(chars) FILTER (year >= 10), 0) AS b FROM l GROUP BY 1, 2)
SELECT control, count(*) AS words, count(*) FILTER (b > a) AS grew, control AND count(*) FILTER (b > a) >= 0.8 * count(*) AS warning FROM r GROUP BY 1""")
def control_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a lexicon's words and of the control words grew; a warning if four fifths of the controls did."""
    rows = documents(spark, sf_dir, "source", "text").select(F.substring("source", 4, 9).cast("int").alias("year"), F.lower("text").alias("text"))
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(w in CONTROL).alias("control"), F.regexp_count("text", F.lit(w)).alias("n")) for w in LEXICON + CONTROL]))
    each = rows.select("year", F.length("text").alias("chars"), cells.alias("z"))
    rate = lambda c: 1000.0 * F.sum(F.when(c, F.col("z.n"))) / F.nullif(F.sum(F.when(c, F.col("chars"))), F.lit(0))
    r = each.groupBy("z.word", "z.control").agg(rate(F.col("year") < 10).alias("a"), rate(F.col("year") >= 10).alias("b"))
    grew = F.count_if(F.col("b") > F.col("a"))
    return r.groupBy("control").agg(F.count(F.lit(1)).alias("words"), grew.alias("grew"), F.coalesce(F.max("control") & (grew >= 0.8 * F.count(F.lit(1))), F.lit(False)).alias("warning"))


@register(f"""WITH {_w}, s AS (SELECT word, max(year) AS last, count(DISTINCT year) AS years, count(*) AS docs FROM w GROUP BY 1) SELECT word, docs, years, last FROM s WHERE last < 10 AND docs >= 2 ORDER BY docs DESC, word LIMIT 15""")
def vanished_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-15 report: words of the earlier years that no later year has."""
    each = words(spark, sf_dir).select("key", F.substring("source", 4, 9).cast("int").alias("year"), "word").distinct()
    by_year = each.groupBy("word", "year").agg(F.count(F.lit(1)).alias("n"))
    s = by_year.groupBy("word").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("years"), F.max("year").alias("last"))
    return s.where("last < 10 and docs >= 2").orderBy(F.desc("docs"), "word").limit(15)
