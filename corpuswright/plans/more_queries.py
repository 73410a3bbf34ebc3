"""Analyses that are reported as tables: mentions, usage, exclusion rates, lists, headings, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import markdown
from ..sources.tables import table
from .panel_queries import PANEL, panel, rounded
from .registry import register
from .text_queries import MARKED, REASON, documents, marked, reasons

TOPIC = "(?i)thing|tion "


@register("""WITH m AS (SELECT lang, regexp_matches(substr(text, 1, 1500), '(?i)thing|tion ') AS broad, regexp_matches(substr(text, 1, 60), '(?i)thing|tion ') AS narrow FROM documents)
SELECT lang, count(*) AS n, round(100 * avg(narrow::INT), 6) AS narrow_pct, round(100 * avg(broad::INT), 6) AS broad_pct FROM m GROUP BY 1""")
def topic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic rule on the title only, and on the title and the first 1,500 characters; that window is the rule."""
    rows = documents(spark, sf_dir, "lang", "text").select("lang", F.substring("text", 1, 60).rlike(TOPIC).alias("narrow"), F.substring("text", 1, 1500).rlike(TOPIC).alias("broad"))
    pct = lambda c: 100 * F.avg(F.col(c).cast("int"))
    return rounded(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), pct("narrow").alias("narrow_pct"), pct("broad").alias("broad_pct")), "narrow_pct", "broad_pct")


@register("""WITH u AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\bthe [a-z]+')) AS u FROM documents), k AS (SELECT lang, CASE WHEN regexp_matches(u, 'the th') THEN 'the th' WHEN regexp_matches(u, 'tion$') THEN 'noun' WHEN regexp_matches(u, 'ing$') THEN 'gerund' WHEN regexp_matches(u, 'ed$') THEN 'participle' ELSE 'other' END AS usage FROM u)
SELECT lang, usage, count(*) AS n FROM k GROUP BY 1, 2""")
def usage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of one word by what follows it, the first class that fits."""
    use = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(\\bthe [a-z]+)"), F.lit(1)))
    rows = documents(spark, sf_dir, "lang", "text").select("lang", use.alias("u"))
    kind = F.when(F.col("u").rlike("the th"), "the th").when(F.col("u").rlike("tion$"), "noun").when(F.col("u").rlike("ing$"), "gerund").when(F.col("u").rlike("ed$"), "participle").otherwise("other")
    return rows.groupBy("lang", kind.alias("usage")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {REASON}, g AS (SELECT CASE WHEN substr(source, 4)::INT < 10 THEN 'before' ELSE 'after' END AS period, reason FROM r)
SELECT period, count(*) AS fetched, count(*) FILTER (reason IS NULL) AS kept, round(100.0 * count(*) FILTER (reason IS NOT NULL) / count(*), 6) AS excluded_pct FROM g GROUP BY 1""")
def exclusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.substring("source", 4, 9).cast("int") < 10, "before").otherwise("after")
    out = reasons(spark, sf_dir).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("reason").isNull()).alias("kept"))
    return rounded(out.withColumn("excluded_pct", 100.0 * (F.col("fetched") - F.col("kept")) / F.col("fetched")), "excluded_pct")


@register(f"""WITH {MARKED}, d AS (SELECT source, doc_id, count(*) FILTER (kind = 'list') AS items, count(*) FILTER (kind = 'heading') AS heads FROM k GROUP BY 1, 2)
SELECT source, round(median(items) FILTER (items > 0), 6) AS median_items, round(100 * avg((items > 0)::INT), 6) AS with_lists_pct, round(median(heads), 6) AS median_headings FROM d GROUP BY 1""")
def list_heading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir)
    each = markdown.structure(markdown.line_table(rows, "doc_id", "md")).select("key", "list_items", "headings").join(rows.select(F.col("doc_id").alias("key"), "source"), "key")
    out = each.groupBy("source").agg(F.median(F.when(F.col("list_items") > 0, F.col("list_items"))).alias("median_items"), (100 * F.avg((F.col("list_items") > 0).cast("int"))).alias("with_lists_pct"), F.median("headings").alias("median_headings"))
    return rounded(out, "median_items", "with_lists_pct", "median_headings")


@register(f"""WITH {MARKED} SELECT doc_id % 10 AS grp, count(*) AS headings, round(median(length(line)), 6) AS median_length, round(100 * avg(regexp_matches(line, '[?]')::INT), 6) AS question_pct FROM k WHERE kind = 'heading' GROUP BY 1""")
def heading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = markdown.line_table(marked(spark, sf_dir), "doc_id", "md").where("kind = 'heading'").select("key", F.regexp_replace("line", "^\\s{0,3}#{1,6}\\s", "").alias("t"))
    out = heads.groupBy((F.col("key") % 10).alias("grp")).agg(F.count(F.lit(1)).alias("headings"), F.median(F.length("t")).alias("median_length"), (100 * F.avg(F.col("t").rlike("[?]").cast("int"))).alias("question_pct"))
    return rounded(out, "median_length", "question_pct")


@register(f"""WITH {PANEL}, r AS (SELECT *, percent_rank() OVER (PARTITION BY year ORDER BY likes) AS pr FROM p)
SELECT year, CASE WHEN pr >= 0.98 THEN 'top' WHEN likes <= 1 THEN 'bottom' ELSE 'middle' END AS band, count(*) AS n, round(median(value), 6) AS median_value FROM r GROUP BY 1, 2""")
def like_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most liked 2% of a year, those with one like at most, and the rest. Ranks come from counts by likes, so no
    task sorts a year's articles."""
    rows = panel(spark, sf_dir)
    counts = rows.groupBy("year", "likes").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("year").orderBy("likes")
    ranks = counts.select("year", "likes", (F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.greatest(F.sum("c").over(Window.partitionBy("year")) - 1, F.lit(1))).alias("pr"))
    band = F.when(F.col("pr") >= 0.98, "top").when(F.col("likes") <= 1, "bottom").otherwise("middle")
    return rounded(rows.join(ranks, ["year", "likes"]).groupBy("year", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, m AS (SELECT year, month(created) AS mo, avg(value) AS v FROM p GROUP BY 1, 2), d AS (SELECT year, max(v) FILTER (mo = 12) AS dec, avg(v) FILTER (mo <> 12) AS rest FROM m GROUP BY 1)
SELECT year, round(dec / rest, 6) AS december_ratio FROM d WHERE dec IS NOT NULL""")
def december_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = panel(spark, sf_dir).groupBy("year", F.month("created").alias("mo")).agg(F.avg("value").alias("v"))
    out = m.groupBy("year").agg((F.max(F.when(F.col("mo") == 12, F.col("v"))) / F.avg(F.when(F.col("mo") != 12, F.col("v")))).alias("december_ratio"))
    return rounded(out.where("december_ratio is not null"), "december_ratio")


@register(f"""WITH {PANEL}, m AS (SELECT month, median(value) AS m FROM p GROUP BY 1), l AS (SELECT month, m, min(m) OVER () AS lo, max(m) OVER () AS hi FROM m)
SELECT month, least(7, floor((m - lo) / (hi - lo) * 7))::INT AS level FROM l""")
def timeline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly medians on the scale of a sparkline, 0 to 7."""
    from ..operators.panel import monthly_medians

    m = monthly_medians(panel(spark, sf_dir))
    ends = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return m.crossJoin(F.broadcast(ends)).select("month", F.least(F.lit(7), F.floor((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 7)).cast("int").alias("level"))


@register("""SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total, max((props::JSON ->> '$.k')::BIGINT) AS max_k FROM events GROUP BY 1, 2""")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day files of each user, with a field out of their JSON."""
    rows = table(spark, sf_dir, "events", "user_id", "ts", "value", "props").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("max_k")), "total", to=4)


@register("""WITH d AS (SELECT DISTINCT date_trunc('week', ts)::DATE::VARCHAR AS week, ts::DATE AS day FROM events), r AS (SELECT *, dense_rank() OVER (PARTITION BY week ORDER BY day) AS k FROM d)
SELECT week, count(*) AS n FROM events JOIN r ON r.day = events.ts::DATE WHERE k <= 3 GROUP BY 1""")
def first_days_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first three existing days of each week are read: the scan's own limit."""
    from ..sources.ingest import first_days

    week = F.date_format(F.date_trunc("week", F.col("ts")), "yyyy-MM-dd")
    rows = first_days(table(spark, sf_dir, "events", "ts"), week, F.to_date("ts"), 3)
    return rows.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
