"""Longitudinal queries. The tables' orders stand for articles: customer = author, date = creation, price = metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import panel as P
from ..operators import resample
from ..operators.ranks import percent_ranked, ranked
from ..sources.tables import table
from .registry import register

PANEL = """p AS (
  SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS created, strftime(o_orderdate, '%Y-%m') AS month,
         year(o_orderdate)::INT AS year, o_totalprice AS value, floor(o_totalprice)::BIGINT % 50 AS likes, o_orderpriority AS tag
  FROM orders)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("created"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), (F.floor("o_totalprice") % 50).cast("long").alias("likes"), F.col("o_orderpriority").alias("tag"),
    )


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in columns})




def A() -> Column:  # noqa: N802
    return F.col("year") == 1996


def B() -> Column:  # noqa: N802
    return F.col("year") == 2000


def MA() -> Column:  # noqa: N802
    return F.col("month") == "1996-08"


def MB() -> Column:  # noqa: N802
    return F.col("month") == "2000-08"


MEDIAN2 = "median(CASE WHEN year = 1996 THEN value END) AS ma, median(CASE WHEN year = 2000 THEN value END) AS mb"


@register(f"""WITH {PANEL} SELECT month, count(*) AS n, round(median(value), 6) AS median_value, count(DISTINCT created::DATE) AS days_present,
max(day(last_day(created::DATE)))::BIGINT AS days_in_month FROM p GROUP BY 1""")
def timeline_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.timeline(panel(spark, sf_dir)), "median_value")


@register(f"""WITH {PANEL}, m AS (SELECT month, count(DISTINCT created::DATE) AS present, max(day(last_day(created::DATE)))::BIGINT AS days FROM p GROUP BY 1)
SELECT month, present, days, present = days AS complete, round(100.0 * present / days, 6) AS pct FROM m""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.timeline(panel(spark, sf_dir)).select("month", F.col("days_present").alias("present"), F.col("days_in_month").alias("days"))
    return rounded(found.withColumns({"complete": F.col("present") == F.col("days"), "pct": 100.0 * F.col("present") / F.col("days")}), "pct")


@register("""SELECT printf('%04d-W%02d', isoyear(ts), week(ts)) AS week, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n,
round(median(value), 6) AS median_value FROM events GROUP BY 1, 2 HAVING count(*) >= 300""")
def weekly_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.weekly(table(spark, sf_dir, "events", "ts", "value")), "median_value")


CHANGE = """m AS (SELECT month, median(value) AS m FROM p GROUP BY 1), b AS (SELECT avg(m) AS base, max(m) - min(m) AS r FROM m WHERE month < '1997-01'),
x AS (SELECT k, r * k AS threshold, month, CASE WHEN r * k > 0 THEN abs(m - base) > r * k ELSE m <> base END AS over_ FROM m, b, (VALUES {ks}) AS s(k) WHERE month >= '1997-01')
SELECT k::DOUBLE AS k, round(max(threshold), 6) AS threshold, count(*) FILTER (over_) AS breaches, min(month) FILTER (over_) AS first_month FROM x GROUP BY 1"""


@register(f"WITH {PANEL}, {CHANGE.format(ks='(0.5)')}")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.first_breaches(panel(spark, sf_dir), F.col("month") < "1997-01", (0.5,)), "threshold")


@register(f"WITH {PANEL}, {CHANGE.format(ks='(0.25), (0.5), (1), (2), (3), (5), (10)')}")
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.first_breaches(panel(spark, sf_dir), F.col("month") < "1997-01", (0.25, 0.5, 1, 2, 3, 5, 10)), "threshold")


@register(f"""WITH {PANEL}, m AS (SELECT month, median(value) AS m FROM p GROUP BY 1)
SELECT count(*) AS months, round(avg(m), 6) AS base_mean, round(min(m), 6) AS base_min, round(max(m), 6) AS base_max, round(3 * (max(m) - min(m)), 6) AS threshold FROM m WHERE month < '1997-01'""")
def baseline_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("month") < "1997-01"
    medians = P.monthly_medians(panel(spark, sf_dir))
    found = P.thresholds(medians, early).crossJoin(F.broadcast(medians.where(early).agg(F.count(F.lit(1)).alias("months"))))
    return rounded(found, "base_mean", "base_min", "base_max", "threshold")


SLOPES = """y AS (SELECT year, median(value) AS v FROM p GROUP BY 1), e AS (SELECT
 min_by(v, year) FILTER (year <= 1998) v0, min(year) FILTER (year <= 1998) y0, max_by(v, year) FILTER (year <= 1998) v1, max(year) FILTER (year <= 1998) y1,
 min_by(v, year) FILTER (year > 1998) v2, min(year) FILTER (year > 1998) y2, max_by(v, year) FILTER (year > 1998) v3, max(year) FILTER (year > 1998) y3 FROM y)"""


@register(f"""WITH {PANEL}, {SLOPES} SELECT round((v1 - v0) / nullif(y1 - y0, 0), 6) AS pre_slope, round((v3 - v1) / nullif(y3 - y1, 0), 6) AS post_slope,
 round((v3 - v2) / nullif(y3 - y2, 0), 6) AS post_slope_unbridged, round(v0, 6) AS first_v, round(v3, 6) AS last_v FROM e""")
def yearly_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = panel(spark, sf_dir).groupBy("year").agg(F.median("value").alias("v"))
    loose = P.slopes(yearly, 1998, bridge=False).select(F.col("post_slope").alias("post_slope_unbridged"))
    return rounded(P.slopes(yearly, 1998).crossJoin(loose), "pre_slope", "post_slope", "post_slope_unbridged", "first_v", "last_v")


WITHIN = f"""m AS (SELECT author, {MEDIAN2} FROM p GROUP BY 1), d AS (SELECT *, mb - ma AS d FROM m WHERE ma IS NOT NULL AND mb IS NOT NULL), o AS (SELECT {MEDIAN2} FROM p)"""


@register(f"""WITH {PANEL}, {WITHIN} SELECT round(max(o.mb - o.ma), 6) AS overall, count(*) AS authors, round(median(d), 6) AS median_shift,
round(100 * avg((sign(o.mb - o.ma) * d > 0)::INT), 6) AS same_way, round(100.0 * count(*) FILTER (sign(o.mb - o.ma) * d > 0) / count(*) FILTER (d <> 0), 6) AS same_way_of_movers FROM d, o""")
def within_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.within_author(panel(spark, sf_dir), A(), B()), "overall", "median_shift", "same_way", "same_way_of_movers")


@register(f"""WITH {PANEL}, {WITHIN}, f AS (SELECT author, min(month) AS debut FROM p GROUP BY 1)
SELECT CASE WHEN debut < '1995-07' THEN 'early 1995' WHEN debut < '1996-01' THEN 'late 1995' ELSE 'later' END AS cohort, count(*) AS authors, round(median(d), 6) AS median_shift,
round(100.0 * count(*) FILTER (d > 0) / nullif(count(*) FILTER (d <> 0), 0), 6) AS up_share FROM d JOIN f USING (author) GROUP BY 1""")
def within_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = F.when(F.col("debut") < "1995-07", "early 1995").when(F.col("debut") < "1996-01", "late 1995").otherwise("later")
    return rounded(P.cohort_within(panel(spark, sf_dir), A(), B(), cohort), "median_shift", "up_share")


@register(f"""WITH {PANEL}, w AS (SELECT * FROM (VALUES (1), (2), (4)) AS s(span)),
m AS (SELECT span, author, median(value) FILTER (year = 1996) AS ma, median(value) FILTER (year = 1996 + span) AS mb FROM p, w GROUP BY 1, 2),
o AS (SELECT span, median(value) FILTER (year = 1996) AS oa, median(value) FILTER (year = 1996 + span) AS ob FROM p, w GROUP BY 1)
SELECT span, count(*) AS authors, round(100 * avg((sign(ob - oa) * (mb - ma) > 0)::INT), 6) AS same_way FROM m JOIN o USING (span) WHERE ma IS NOT NULL AND mb IS NOT NULL GROUP BY 1""")
def window_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    found = [P.within_author(rows, A(), F.col("year") == 1996 + k).select(F.lit(k).alias("span"), "authors", "same_way") for k in (1, 2, 4)]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), "same_way")


@register(f"""WITH {PANEL}, r AS (SELECT *, CASE WHEN year = 1996 THEN 'a' ELSE 'b' END AS period FROM p WHERE year IN (1996, 2000)),
w AS (SELECT *, count(*) OVER (PARTITION BY author, period) AS n_, row_number() OVER (PARTITION BY author, period ORDER BY created, id) AS k_, max((period = 'a')::INT) OVER (PARTITION BY author) AS e_ FROM r),
c AS (SELECT 'all' AS "case", * FROM w UNION ALL SELECT 'off topic', * FROM w WHERE tag <> '1-URGENT' UNION ALL SELECT 'one per author', * FROM w WHERE k_ = 1 UNION ALL SELECT 'light authors', * FROM w WHERE n_ < 3
 UNION ALL SELECT 'returning', * FROM w WHERE period = 'a' OR e_ = 1 UNION ALL SELECT 'likes 0-9', * FROM w WHERE likes < 10 UNION ALL SELECT 'likes 10+', * FROM w WHERE likes >= 10),
g AS (SELECT "case", count(*) FILTER (period = 'a') AS n_a, count(*) FILTER (period = 'b') AS n_b, median(value) FILTER (period = 'a') AS median_a, median(value) FILTER (period = 'b') AS median_b FROM c GROUP BY 1)
SELECT "case", n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(median_b - median_a, 6) AS diff,
 round(100 * (median_b - median_a) / (SELECT median_b - median_a FROM g WHERE "case" = 'all'), 6) AS kept_pct FROM g""")
def confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.confounds(panel(spark, sf_dir), A(), B(), F.col("tag") == "1-URGENT"), "median_a", "median_b", "diff", "kept_pct")


@register(f"WITH {PANEL} SELECT author, id, month, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created, id) AS k FROM p) WHERE k = 1")
def one_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.one_per_author(panel(spark, sf_dir)).select("author", "id", "month", "value"), "value")


@register(f"""WITH {PANEL} SELECT month, count(*) AS n, count(DISTINCT author) AS authors, round(median(value), 6) AS median_value FROM p
WHERE month = '2000-08' AND author IN (SELECT author FROM p WHERE month = '1996-08') GROUP BY 1""")
def returning_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.returning(panel(spark, sf_dir), MB(), MA())
    return rounded(rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, o AS (SELECT DISTINCT year, author FROM p WHERE month(created) <> 12),
d AS (SELECT p.*, o.author IS NOT NULL AS regular FROM p LEFT JOIN o ON p.author = o.author AND p.year = o.year WHERE month(created) = 12)
SELECT year, regular, count(*) AS n, round(median(value), 6) AS median_value FROM d GROUP BY 1, 2""")
def regular_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    others = rows.where(F.month("created") != 12).select("year", "author").distinct()
    december = rows.where(F.month("created") == 12)
    parts = [december.join(others, ["year", "author"], how).withColumn("regular", F.lit(how == "left_semi")) for how in ("left_semi", "left_anti")]
    return rounded(parts[0].unionByName(parts[1]).groupBy("year", "regular").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, b AS (SELECT *, CASE WHEN month(created) = 11 THEN 'november' WHEN day(created) <= 25 THEN 'december 1-25' ELSE 'december 26-31' END AS band FROM p WHERE month(created) IN (11, 12))
SELECT year, band, count(*) AS n, round(count(*)::DOUBLE / CASE band WHEN 'november' THEN 30 WHEN 'december 1-25' THEN 25 ELSE 6 END, 6) AS per_day, round(median(value), 6) AS median_value FROM b GROUP BY 1, 2""")
def advent_daybands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.month("created") == 11, "november").when(F.day("created") <= 25, "december 1-25").otherwise("december 26-31")
    days = F.when(F.col("band") == "november", 30).when(F.col("band") == "december 1-25", 25).otherwise(6)
    rows = panel(spark, sf_dir).where(F.month("created").isin(11, 12)).withColumn("band", band)
    found = rows.groupBy("year", "band").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value"))
    return rounded(found.withColumn("per_day", F.col("n") / days), "per_day", "median_value")


GAPS = """m AS (SELECT month, avg(value) AS m, (substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT - 1) AS at FROM p GROUP BY 1),
g AS (SELECT m.at % 12 + 1 AS month_number, m.m - (q.m + n.m) / 2 AS gap FROM m JOIN m AS q ON q.at = m.at - 1 JOIN m AS n ON n.at = m.at + 1),
x AS (SELECT month_number, count(*) AS years, avg(gap) / (SELECT stddev_pop(m) FROM m) AS gap_sd, count(*) FILTER (gap > 0) AS up, count(*) FILTER (gap < 0) AS down FROM g GROUP BY 1)
SELECT month_number, years, round(gap_sd, 6) AS gap_sd, CASE WHEN gap_sd > 0 THEN up WHEN gap_sd < 0 THEN down ELSE 0 END AS same_sign FROM x"""


@register(f"WITH {PANEL}, {GAPS}")
def all_months_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.seasonal_gaps(panel(spark, sf_dir)), "gap_sd")


@register(f"WITH {PANEL}, {GAPS} WHERE month_number = 12")
def december_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.seasonal_gaps(panel(spark, sf_dir), 12), "gap_sd")


DEBUT = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created, id) AS k FROM p) WHERE k = 1)"""


@register(f"""WITH {PANEL}, {DEBUT} SELECT substr(month, 1, 4) AS year, count(*) AS authors, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value,
round(100 * avg((likes = 0)::INT), 6) AS zero_pct FROM f GROUP BY 1""")
def debut_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.debut_profile(panel(spark, sf_dir)), "mean_value", "median_value", "zero_pct")


@register(f"""WITH {PANEL}, {DEBUT}, m AS (SELECT month, avg(value) AS m FROM f GROUP BY 1), b AS (SELECT avg(m) AS bm, stddev_pop(m) AS bs FROM m WHERE month < '1996-01'),
y AS (SELECT substr(month, 1, 4) AS year, avg(value) AS v FROM f GROUP BY 1)
SELECT year, round((v - bm) / nullif(bs, 0), 6) AS sds, abs((v - bm) / nullif(bs, 0)) > 3 AS beyond FROM y, b""")
def debut_deviation_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = P.one_per_author(panel(spark, sf_dir))
    base = first.where(F.col("month") < "1996-01").groupBy("month").agg(F.avg("value").alias("m")).agg(F.avg("m").alias("bm"), F.stddev_pop("m").alias("bs"))
    years = first.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.avg("value").alias("v"))
    sds = (F.col("v") - F.col("bm")) / F.nullif(F.col("bs"), F.lit(0.0))
    return rounded(years.crossJoin(F.broadcast(base)).select("year", sds.alias("sds"), (F.abs(sds) > 3).alias("beyond")), "sds")


@register(f"""WITH {PANEL}, f AS (SELECT author, min(month) AS debut FROM p GROUP BY 1)
SELECT month, count(DISTINCT p.author) AS authors, count(DISTINCT p.author) FILTER (debut = month) AS new_authors, round(100.0 * count(DISTINCT p.author) FILTER (debut = month) / count(DISTINCT p.author), 6) AS new_pct
FROM p JOIN f USING (author) GROUP BY 1""")
def new_author_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = panel(spark, sf_dir).select("author", "month").distinct()
    debut = F.min("month").over(Window.partitionBy("author"))
    found = active.withColumn("new", debut == F.col("month")).groupBy("month").agg(F.count(F.lit(1)).alias("authors"), F.count_if("new").alias("new_authors"))
    return rounded(found.withColumn("new_pct", 100.0 * F.col("new_authors") / F.col("authors")), "new_pct")


PRIOR = """c AS (SELECT author, month, count(*) AS c FROM p GROUP BY 1, 2),
q AS (SELECT author, month, coalesce(sum(c) OVER (PARTITION BY author ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
l AS (SELECT p.*, CASE WHEN prior = 0 THEN '0' WHEN prior <= 2 THEN '1-2' WHEN prior <= 9 THEN '3-9' ELSE '10+' END AS layer FROM p JOIN q USING (author, month))"""


@register(f"WITH {PANEL}, {PRIOR} SELECT month, layer, count(*) AS n, round(avg(value), 6) AS mean_value FROM l GROUP BY 1, 2")
def prior_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_prior(panel(spark, sf_dir)).groupBy("month", P.layer_of(F.col("prior")).alias("layer"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")), "mean_value")


@register(f"""WITH {PANEL}, {PRIOR}, x AS (SELECT layer, count(*) FILTER (year = 1996) AS na, count(*) FILTER (year = 2000) AS nb, coalesce(avg(value) FILTER (year = 1996), 0) AS ma, coalesce(avg(value) FILTER (year = 2000), 0) AS mb FROM l WHERE year IN (1996, 2000) GROUP BY 1),
s AS (SELECT ma, mb, na / (SELECT sum(na) FROM x) AS sa, nb / (SELECT sum(nb) FROM x) AS sb FROM x)
SELECT round(sum(sb * mb - sa * ma), 4) AS total, round(sum((sb - sa) * ma), 4) AS comp_a, round(sum((sb - sa) * mb), 4) AS comp_b, round(sum(sa * (mb - ma)), 4) AS within_a, round(sum(sb * (mb - ma)), 4) AS within_b, round(sum((sb - sa) * (mb - ma)), 4) AS interaction FROM s""")
def composition_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.composition(panel(spark, sf_dir), A(), B()), "total", "comp_a", "comp_b", "within_a", "within_b", "interaction", to=4)


VOLUME = "v AS (SELECT *, count(*) OVER (PARTITION BY month, author) AS c FROM p)"


@register(f"""WITH {PANEL}, {VOLUME} SELECT year, CASE WHEN c = 1 THEN '1' WHEN c <= 4 THEN '2-4' WHEN c <= 9 THEN '5-9' ELSE '10+' END AS layer, count(*) AS n, round(median(value), 6) AS median_value FROM v GROUP BY 1, 2""")
def volume_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.count(F.lit(1)).over(Window.partitionBy("month", "author"))
    layer = F.when(F.col("c") == 1, "1").when(F.col("c") <= 4, "2-4").when(F.col("c") <= 9, "5-9").otherwise("10+")
    rows = panel(spark, sf_dir).withColumn("c", c).groupBy("year", layer.alias("layer"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, c AS (SELECT year, author, count(*) AS c FROM p GROUP BY 1, 2)
SELECT year, count(*) AS authors, round(avg(c), 6) AS per_author, round(100 * avg((c = 1)::INT), 6) AS one_post_pct, count(*) FILTER (c >= 4) AS heavy_authors FROM c GROUP BY 1""")
def heavy_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panel(spark, sf_dir).groupBy("year", "author").agg(F.count(F.lit(1)).alias("c"))
    found = c.groupBy("year").agg(F.count(F.lit(1)).alias("authors"), F.avg("c").alias("per_author"), (100 * F.avg((F.col("c") == 1).cast("double"))).alias("one_post_pct"), F.count_if(F.col("c") >= 4).alias("heavy_authors"))
    return rounded(found, "per_author", "one_post_pct")


@register(f"WITH {PANEL} SELECT year, count(*) AS n, round(100 * avg((likes = 0)::INT), 6) AS zero_pct, median(likes) AS median_likes, round(quantile_cont(likes, 0.9), 6) AS p90 FROM p GROUP BY 1")
def zero_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("likes") == 0).cast("double"))).alias("zero_pct"), F.median("likes").alias("median_likes"), F.percentile("likes", F.lit(0.9)).alias("p90"))
    return rounded(found, "zero_pct", "p90")


@register(f"""WITH {PANEL}, r AS (SELECT likes, row_number() OVER (ORDER BY likes DESC, id) AS k, count(*) OVER () AS n FROM p), s AS (SELECT * FROM (VALUES (0.01), (0.1), (0.5)) AS v(share))
SELECT share::DOUBLE AS share, round(100.0 * sum(likes) FILTER (k <= ceil(share * n)) / sum(likes), 6) AS sum_pct FROM r, s GROUP BY 1""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.top_share(panel(spark, sf_dir), "likes", (0.01, 0.1, 0.5)), "sum_pct")


@register(f"""WITH {PANEL}, q AS (SELECT year, likes, ntile(4) OVER (PARTITION BY year ORDER BY value, id)::INT AS quartile FROM p)
SELECT year, quartile, count(*) AS n, round(avg(likes), 6) AS mean_likes FROM q GROUP BY 1, 2""")
def quartile_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of a year's articles as ``ntile`` deals them, by places that no task takes of a whole year."""
    rows = ranked(panel(spark, sf_dir).select("year", "value", "id", "likes"), ["year"], [F.col("value"), F.col("id")], tiles=4)
    return rounded(rows.groupBy("year", F.col("ntile").alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.avg("likes").alias("mean_likes")), "mean_likes")


@register(f"""WITH {PANEL} SELECT year, CASE WHEN likes < 2 THEN '0-1' WHEN likes < 10 THEN '2-9' WHEN likes < 30 THEN '10-29' ELSE '30+' END AS band, count(*) AS n, round(median(value), 6) AS median_value FROM p GROUP BY 1, 2""")
def like_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("likes") < 2, "0-1").when(F.col("likes") < 10, "2-9").when(F.col("likes") < 30, "10-29").otherwise("30+")
    return rounded(panel(spark, sf_dir).groupBy("year", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, r AS (SELECT year, value, likes, percent_rank() OVER (PARTITION BY year ORDER BY likes DESC) AS k FROM p)
SELECT year, CASE WHEN k <= 0.02 THEN 'top 2%' WHEN likes < 2 THEN '0-1' ELSE 'middle' END AS part, count(*) AS n, round(avg(value), 4) AS mean_value FROM r GROUP BY 1, 2""")
def like_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two per cent of a year with the most likes, those with next to none, and the rest."""
    rows = percent_ranked(panel(spark, sf_dir).select("year", "value", "likes"), ["year"], "likes", high_first=True)
    part = F.when(F.col("percent_rank") <= 0.02, "top 2%").when(F.col("likes") < 2, "0-1").otherwise("middle")
    return rounded(rows.groupBy("year", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")), "mean_value", to=4)


@register()
def like_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with ten likes or more against those with at most one: the interval of the difference of means."""
    return rounded(resample.interval(panel(spark, sf_dir), F.col("likes") < 2, F.col("likes") >= 10), "low", "high", to=4)


@register("""WITH t AS (SELECT year(o_orderdate)::INT AS year, o_totalprice AS value, lower(o_orderpriority) AS a, lower(c_mktsegment) AS b FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT year, value, CASE WHEN a = '1-urgent' OR b = 'machinery' THEN 'industry' WHEN b IN ('building', 'furniture') THEN 'housing' WHEN b = 'automobile' THEN 'transport' ELSE 'other' END AS domain FROM t)
SELECT domain, round(median(value) FILTER (year = 1996), 6) AS y1996, round(median(value) FILTER (year = 2000), 6) AS y2000, round(median(value) FILTER (year = 2000) - median(value) FILTER (year = 1996), 6) AS change, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 30""")
def domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import first_domain

    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    domains = {"industry": ("1-urgent", "machinery"), "housing": ("building", "furniture"), "transport": ("automobile",)}
    domain = first_domain(F.array("o_orderpriority", "c_mktsegment"), domains, "other")
    of = lambda y: F.median(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")))
    found = rows.groupBy(domain.alias("domain")).agg(of(1996).alias("y1996"), of(2000).alias("y2000"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    return rounded(found.withColumn("change", F.col("y2000") - F.col("y1996")), "y1996", "y2000", "change")


@register(f"""WITH {PANEL} SELECT CASE WHEN value < 50000 THEN 'short' WHEN value < 150000 THEN 'middle' ELSE 'long' END AS stratum, count(*) FILTER (year = 1996) AS n_a, count(*) FILTER (year = 2000) AS n_b,
round(median(likes) FILTER (year = 2000) - median(likes) FILTER (year = 1996), 6) AS diff FROM p GROUP BY 1""")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    stratum = F.when(F.col("value") < 50000, "short").when(F.col("value") < 150000, "middle").otherwise("long")
    found = panel(spark, sf_dir).groupBy(stratum.alias("stratum")).agg(F.count_if(A()).alias("n_a"), F.count_if(B()).alias("n_b"), (F.median(F.when(B(), F.col("likes"))) - F.median(F.when(A(), F.col("likes")))).alias("diff"))
    return rounded(found, "diff")


@register("""SELECT CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS band, isodow(ts) >= 6 AS weekend, count(*) AS n,
round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, round(median(value), 6) AS median_value FROM events GROUP BY 1, 2""")
def hour_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    band = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    found = table(spark, sf_dir, "events", "ts", "value").groupBy(band.alias("band"), (F.weekday("ts") >= 5).alias("weekend")).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value"))
    whole = found.agg(F.sum("n").alias("whole"))
    return rounded(found.crossJoin(F.broadcast(whole)).withColumn("pct", 100.0 * F.col("n") / F.col("whole")).drop("whole"), "pct", "median_value")


@register(f"""WITH {PANEL}, x AS (SELECT count(*) FILTER (year = 1996) AS n_a, count(*) FILTER (year = 2000) AS n_b, count(DISTINCT author) FILTER (year = 1996) AS authors_a, count(DISTINCT author) FILTER (year = 2000) AS authors_b,
 avg(value) FILTER (year = 1996) AS mean_a, avg(value) FILTER (year = 2000) AS mean_b, stddev_pop(value) FILTER (year = 1996) AS sd_a FROM p)
SELECT n_a, n_b, authors_a, authors_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(sd_a, 4) AS sd_a, round((mean_b - mean_a) / sd_a, 6) AS effect, round(mean_b / mean_a, 6) AS ratio FROM x""")
def std_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(P.std_diff(panel(spark, sf_dir), A(), B()), "mean_a", "mean_b", "sd_a", to=4), "effect", "ratio")


@register(f"""WITH {PANEL}, s AS (SELECT CASE WHEN year = 1996 THEN 'a' ELSE 'b' END AS side, author, sum(value) AS s, count(value) AS c FROM p WHERE year IN (1996, 2000) GROUP BY 1, 2),
d AS (SELECT side, rep, s, c, ('0x' || substr(md5('42-' || side || '-' || rep // 4 || '-' || author), 8 * (rep % 4) + 1, 8))::BIGINT / 4294967296.0 AS u FROM s, range(200) AS r(rep)),
w AS (SELECT *, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.9196986)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT + (u >= 0.99991676)::INT + (u >= 0.99998975)::INT + (u >= 0.99999887)::INT AS w FROM d),
m AS (SELECT rep, sum(w * s) FILTER (side = 'b') / sum(w * c) FILTER (side = 'b') - sum(w * s) FILTER (side = 'a') / sum(w * c) FILTER (side = 'a') AS x FROM w GROUP BY 1),
o AS (SELECT list(x ORDER BY x) AS d FROM m)
SELECT len(d) AS replicates, round(d[1 + floor(0.025 * (len(d) - 1))::INT], 4) AS low, round(d[1 + floor(0.975 * (len(d) - 1))::INT], 4) AS high FROM o""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.bootstrap(panel(spark, sf_dir), A(), B(), 200), "low", "high", to=4)


@register()
def bootstrap_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same interval by draws of authors with replacement; random numbers that SQL does not have."""
    return rounded(resample.interval(panel(spark, sf_dir), A(), B()), "low", "high", to=4)


@register("""WITH c AS (SELECT 'l_quantity' AS field, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT field, count(x) AS valid, count(*) FILTER (x IS NULL) AS nulls, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM c GROUP BY 1""")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("l_quantity", "l_extendedprice", "l_discount")
    return rounded(P.distribution(table(spark, sf_dir, "lineitem", *fields), fields), "p05", "p50", "p95")


@register(f"""WITH {PANEL}, lo AS (SELECT 'low' AS side, id, value FROM p ORDER BY value, id LIMIT 10), hi AS (SELECT 'high' AS side, id, value FROM p ORDER BY value DESC, id LIMIT 10) SELECT * FROM lo UNION ALL SELECT * FROM hi""")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("id", "value").where("value is not null")
    ends = [rows.orderBy(order, "id").limit(10).select(F.lit(side).alias("side"), "id", "value") for side, order in (("low", F.asc("value")), ("high", F.desc("value")))]
    return ends[0].unionByName(ends[1])


@register(f"""WITH {PANEL}, s AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5('42-' || id), id) AS k FROM p) SELECT year, count(*) AS n, round(median(value), 6) AS median_value FROM s WHERE k <= 100 GROUP BY 1""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A() sampling operator: the first 100 articles of each year in an order fixed by a hash of seed and id."""
    order = Window.partitionBy("year").orderBy(F.md5(F.concat_ws("-", F.lit("42"), F.col("id").cast("string"))), "id")
    rows = panel(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 100")
    return rounded(rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median_value")), "median_value")


@register(f"""WITH {PANEL}, w AS (SELECT month, author, count(*) AS c, sum(value) AS s FROM p WHERE year = 1996 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY c DESC, author) AS k FROM w)
SELECT month, sum(c)::BIGINT AS n, round(100.0 * sum(c) FILTER (k <= 1) / sum(c), 6) AS top1_pct, round(100.0 * sum(c) FILTER (k <= 5) / sum(c), 6) AS top5_pct, round(sum(s) FILTER (k > 5) / sum(c) FILTER (k > 5), 4) AS mean_without_top5 FROM r GROUP BY 1""")
def author_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = panel(spark, sf_dir).where(A()).groupBy("month", "author").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("s"))
    ranks = counts.withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("c"), "author")))
    upto = lambda k: 100.0 * F.sum(F.when(F.col("k") <= k, F.col("c"))) / F.sum("c")
    rest = lambda c: F.sum(F.when(F.col("k") > 5, F.col(c)))
    found = ranks.groupBy("month").agg(F.sum("c").alias("n"), upto(1).alias("top1_pct"), upto(5).alias("top5_pct"), (rest("s") / rest("c")).alias("mean_without_top5"))
    return rounded(rounded(found, "top1_pct", "top5_pct"), "mean_without_top5", to=4)


@register(f"""WITH {PANEL}, a AS (SELECT DISTINCT author FROM p WHERE year = 1996), s AS (SELECT author, d FROM a, range(20) AS r(d) WHERE ('0x' || substr(md5(d || '-' || author), 1, 8))::BIGINT % 2 = 0),
m AS (SELECT author, {MEDIAN2} FROM p GROUP BY 1), x AS (SELECT d, 100 * avg((mb > ma)::INT) AS pct FROM s JOIN m USING (author) WHERE ma IS NOT NULL AND mb IS NOT NULL GROUP BY 1)
SELECT count(*) AS draws, round(median(pct), 6) AS median_pct, round(min(pct), 6) AS low, round(max(pct), 6) AS high FROM x""")
def subsample_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A() sampling operator: 20 draws of half the authors, by a hash, and the spread of the share that moved up."""
    rows = panel(spark, sf_dir)
    both = P.author_medians(rows, A()).withColumnRenamed("m", "ma").join(P.author_medians(rows, B()).withColumnRenamed("m", "mb"), "author")
    drawn = both.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(19))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("d").cast("string"), F.col("author").cast("string"))), 1, 8), 16, 10).cast("long")
    pct = drawn.where(digest % 2 == 0).groupBy("d").agg((100 * F.avg((F.col("mb") > F.col("ma")).cast("double"))).alias("pct"))
    return rounded(pct.agg(F.count(F.lit(1)).alias("draws"), F.median("pct").alias("median_pct"), F.min("pct").alias("low"), F.max("pct").alias("high")), "median_pct", "low", "high")
