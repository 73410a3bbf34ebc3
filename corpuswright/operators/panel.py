"""Longitudinal operators over a panel of articles.

A panel has the columns id, author, created (timestamp), month ('yyyy-MM'), value (the metric), likes and tags. Every
operator is a plan of built-in expressions: aggregates are partial before they shuffle, windows are over months, authors
or small aggregates, and medians are exact; those of whole periods are taken by ``quantiles``, which holds no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles, with_median
from .ranks import falling, scanned


def timeline(panel: DataFrame, by: str = "month") -> DataFrame:
    """Median by period, with the days that have articles and the days of the month."""
    day = F.to_date("created")
    found = with_median(panel, [by], "value", "median_value", F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("days_present"), F.max(F.day(F.last_day(day))).cast("long").alias("days_in_month"))
    return found.select(by, "n", "median_value", "days_present", "days_in_month")


def weekly(events: DataFrame, at: str = "ts", value: str = "value", least: int = 300) -> DataFrame:
    """Medians by ISO week, for weeks with at least so many rows."""
    label = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col(at)).cast("int"), F.weekofyear(at))
    start = F.date_format(F.date_trunc("week", F.col(at)), "yyyy-MM-dd")
    rows = events.select(label.alias("week"), start.alias("week_start"), F.col(value).alias("_v"))
    return with_median(rows, ["week", "week_start"], "_v", "median_value", F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def monthly_medians(panel: DataFrame, least: int = 1) -> DataFrame:
    return with_median(panel, ["month"], "value", "m", F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def thresholds(medians: DataFrame, baseline: Column, k: float = 3.0) -> DataFrame:
    """One row: mean, least, greatest and range of the baseline's medians, and the change threshold, k times the range."""
    return medians.where(baseline).agg(F.avg("m").alias("base_mean"), F.min("m").alias("base_min"), F.max("m").alias("base_max")).withColumn("threshold", (F.col("base_max") - F.col("base_min")) * k)


def breach(value: Column, base: Column, threshold: Column) -> Column:
    """Further from the base than the threshold; with a threshold of zero, any change."""
    return F.when(threshold > 0, F.abs(value - base) > threshold).otherwise(value != base)


def first_breaches(panel: DataFrame, baseline: Column, ks: Sequence[float] = (3.0,)) -> DataFrame:
    """For each coefficient: its threshold, the months after the baseline that breach it, and the first of them."""
    medians = monthly_medians(panel)
    base = thresholds(medians, baseline, 1.0).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    met = medians.where(~baseline).crossJoin(F.broadcast(base.withColumn("threshold", F.col("threshold") * F.col("k"))))  # a row for each k
    over = breach(F.col("m"), F.col("base_mean"), F.col("threshold"))
    return met.groupBy("k").agg(F.max("threshold").alias("threshold"), F.count_if(over).alias("breaches"), F.min(F.when(over, F.col("month"))).alias("first_month"))


def slopes(yearly: DataFrame, split: int, bridge: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Change per year before and after ``split`` (the last year of before), from end points of rows (year, v). With
    ``bridge`` the later slope starts at the last earlier year, else at the first later one."""
    early, late = F.col("year") <= split, F.col("year") > split
    ends = yearly.groupBy(*by).agg(
        F.min_by(F.when(early, F.col("v")), F.when(early, F.col("year"))).alias("v0"), F.min(F.when(early, F.col("year"))).alias("y0"),
        F.max_by(F.when(early, F.col("v")), F.when(early, F.col("year"))).alias("v1"), F.max(F.when(early, F.col("year"))).alias("y1"),
        F.min_by(F.when(late, F.col("v")), F.when(late, F.col("year"))).alias("v2"), F.min(F.when(late, F.col("year"))).alias("y2"),
        F.max_by(F.when(late, F.col("v")), F.when(late, F.col("year"))).alias("v3"), F.max(F.when(late, F.col("year"))).alias("y3"),
    )
    rate = lambda a, b, x, y: (F.col(b) - F.col(a)) / F.nullif(F.col(y) - F.col(x), F.lit(0))
    post = rate("v1", "v3", "y1", "y3") if bridge else rate("v2", "v3", "y2", "y3")
    return ends.select(*by, rate("v0", "v1", "y0", "y1").alias("pre_slope"), post.alias("post_slope"), F.col("v0").alias("first_v"), F.col("v3").alias("last_v"))


def verdict(pre: Column, post: Column) -> Column:
    """Trend label of a pair of slopes."""
    return F.when((pre > 0.05) & (post > 2 * pre), "accelerating").when(pre > 0.05, "rising before").when(post > 0.05, "rising after").when(post < -0.05, "falling").otherwise("flat")


def author_medians(panel: DataFrame, period: Column) -> DataFrame:
    return panel.where(period).groupBy("author").agg(F.median("value").alias("m"))


def within_author(panel: DataFrame, a: Column, b: Column) -> DataFrame:
    """Shift of the overall median between two periods, and of the same authors' medians: their median shift and the
    share that moved the overall way, with ties in the denominator and without."""
    both = author_medians(panel, a).withColumnRenamed("m", "ma").join(author_medians(panel, b).withColumnRenamed("m", "mb"), "author").withColumn("d", F.col("mb") - F.col("ma"))
    sides = quantiles(panel.where(a | b).withColumn("side", F.when(a, "a").otherwise("b")), ["side"], "value", [0.5])
    overall = sides.agg((F.max(F.when(F.col("side") == "b", F.col("q0"))) - F.max(F.when(F.col("side") == "a", F.col("q0")))).alias("overall"))
    way = F.signum("overall")
    return with_median(  # one group
        both.crossJoin(F.broadcast(overall)), ["overall"], "d", "median_shift", F.count(F.lit(1)).alias("authors"), (100 * F.avg((way * F.col("d") > 0).cast("double"))).alias("same_way"),
        (100.0 * F.count_if(way * F.col("d") > 0) / F.nullif(F.count_if(F.col("d") != 0), F.lit(0))).alias("same_way_of_movers"),
    )


def debuts(panel: DataFrame) -> DataFrame:
    """The month of each author's first article."""
    return panel.groupBy("author").agg(F.min("month").alias("debut"))


def cohort_within(panel: DataFrame, a: Column, b: Column, cohorts: Column) -> DataFrame:
    """Median shift of the same authors between two periods by debut cohort, and the share of movers that went up.
    ``cohorts`` names a cohort from the column debut; null leaves an author out."""
    both = author_medians(panel, a).withColumnRenamed("m", "ma").join(author_medians(panel, b).withColumnRenamed("m", "mb"), "author").join(debuts(panel), "author")
    d = F.col("mb") - F.col("ma")
    return with_median(
        both.withColumn("d", d).withColumn("cohort", cohorts).where("cohort is not null"), ["cohort"], "d", "median_shift", F.count(F.lit(1)).alias("authors"), (100.0 * F.count_if(d > 0) / F.nullif(F.count_if(d != 0), F.lit(0))).alias("up_share")
    )


def one_per_author(panel: DataFrame) -> DataFrame:
    """Each author's first article; rows without an author all stay."""
    first = Window.partitionBy("author").orderBy("created", "id")
    return panel.where("author is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").unionByName(panel.where("author is null"))


def authors_of(panel: DataFrame, period: Column) -> DataFrame:
    return panel.where(period).select("author").distinct()


def returning(panel: DataFrame, period: Column, other: Column) -> DataFrame:
    """Articles of a period by authors who also wrote in the other."""
    return panel.where(period).join(authors_of(panel, other), "author", "left_semi")


def confounds(panel: DataFrame, a: Column, b: Column, topic: Column, heavy: int = 3, metrics: Sequence[str] = ("value",)) -> DataFrame:
    """Median difference of two periods in sub-populations by metric, and how much of the overall difference each keeps.
    One scan marks the sub-populations of every row; authors' counts come from counts by author and not from windows, so
    rows without an author, each an author of its own, and very busy authors make no large group."""
    rows = panel.where(a | b).withColumn("period", F.when(a, "a").otherwise("b"))
    known = rows.where("author is not null").groupBy("author").agg(
        *[F.count_if(F.col("period") == p).alias(f"_n{p}") for p in "ab"], *[F.min(F.when(F.col("period") == p, F.struct("created", "id"))).alias(f"_first{p}") for p in "ab"]
    )
    rows = rows.join(known, "author", "left")
    own = lambda name: F.when(F.col("period") == "a", F.col(f"_{name}a")).otherwise(F.col(f"_{name}b"))
    alone = F.col("author").isNull()
    cases = {
        "all": F.lit(True), "off topic": ~topic, "one per author": alone | (own("first") == F.struct("created", "id")), "light authors": alone | (own("n") < heavy),
        "returning": (F.col("period") == "a") | (F.col("_na") > 0), "likes 0-9": F.col("likes") < 10, "likes 10+": F.col("likes") >= 10,
    }
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cases.items()]), lambda x: x.isNotNull())
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    each = rows.select("period", names.alias("cases"), cells.alias("z")).select("period", F.explode("cases").alias("case"), "z.metric", "z.x")
    sides = with_median(each, ["metric", "case", "period"], "x", "m", F.count(F.lit(1)).alias("n"))
    side = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    found = sides.groupBy("metric", "case").agg(*[F.coalesce(side(p, "n"), F.lit(0)).alias(f"n_{p}") for p in "ab"], *[side(p, "m").alias(f"median_{p}") for p in "ab"])
    found = found.withColumn("diff", F.col("median_b") - F.col("median_a"))
    base = found.where(F.col("case") == "all").select("metric", F.col("diff").alias("_base"))
    out = found.join(F.broadcast(base), "metric").withColumn("kept_pct", 100 * F.col("diff") / F.nullif(F.col("_base"), F.lit(0.0))).drop("_base")
    return out if len(metrics) > 1 else out.drop("metric")


def seasonal_gaps(panel: DataFrame, month_number: int | None = None) -> DataFrame:
    """How far a month's mean is from the mean of its neighbours, in SDs of the monthly means, by calendar month: mean
    gap, years, and years with the sign of the mean gap. Months without articles have no gap, nor have their neighbours."""
    means = panel.groupBy("month").agg(F.avg("value").alias("m")).withColumn("at", F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int") - 1)
    side = lambda k: means.select((F.col("at") - k).alias("at"), F.col("m").alias(f"m{'p' if k < 0 else 'n'}"))
    gaps = means.join(side(-1), "at").join(side(1), "at").select((F.col("at") % 12 + 1).cast("int").alias("month_number"), (F.col("m") - (F.col("mp") + F.col("mn")) / 2).alias("gap"))
    spread = means.agg(F.stddev_pop("m").alias("sd"))
    out = gaps.crossJoin(F.broadcast(spread)).groupBy("month_number").agg(
        F.count(F.lit(1)).alias("years"), (F.avg("gap") / F.nullif(F.max("sd"), F.lit(0.0))).alias("gap_sd"), F.count_if(F.col("gap") > 0).alias("up"), F.count_if(F.col("gap") < 0).alias("down")
    )
    out = out.withColumn("same_sign", F.when(F.col("gap_sd") > 0, F.col("up")).when(F.col("gap_sd") < 0, F.col("down")).otherwise(F.lit(0))).drop("up", "down")
    return out.where(F.col("month_number") == month_number) if month_number else out


def seasonal_spreads(panel: DataFrame, month_number: int) -> DataFrame:
    """One month's mean gap to its neighbours in SDs of that month's own means over the years, and of all other months'
    means; with the years, and the years that have the sign of the mean gap."""
    means = panel.groupBy("month").agg(F.avg("value").alias("m")).withColumn("at", month_index(F.col("month")) - 1)
    side = lambda k, name: means.select((F.col("at") - k).alias("at"), F.col("m").alias(name))
    here = F.col("at") % 12 + 1 == month_number
    spread = means.agg(F.stddev_pop(F.when(here, F.col("m"))).alias("own"), F.stddev_pop(F.when(~here, F.col("m"))).alias("other"))
    gaps = means.where(here).join(side(-1, "mp"), "at").join(side(1, "mn"), "at").select((F.col("m") - (F.col("mp") + F.col("mn")) / 2).alias("gap"))
    row = gaps.crossJoin(F.broadcast(spread)).agg(F.count(F.lit(1)).alias("years"), F.avg("gap").alias("gap"), F.max("own").alias("own"), F.max("other").alias("other"), F.count_if(F.col("gap") > 0).alias("up"), F.count_if(F.col("gap") < 0).alias("down"))
    same = F.when(F.col("gap") > 0, F.col("up")).when(F.col("gap") < 0, F.col("down")).otherwise(F.lit(0))
    return row.select("years", "gap", (F.col("gap") / F.nullif("own", F.lit(0.0))).alias("in_own_sd"), (F.col("gap") / F.nullif("other", F.lit(0.0))).alias("in_other_sd"), same.alias("same_sign"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weights, of rows that have both; the plain mean where no weight is above zero."""
    both = F.when(value.isNotNull(), weight)
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(both), F.lit(0.0)), F.avg(value))


def reversal(pre: Column, post: Column) -> Column:
    """What became of a trend: reversed, faster or slower by a factor of two, or much the same; null if a slope is."""
    size = F.abs(post) / F.nullif(F.abs(pre), F.lit(0.0))
    return F.when(pre * post < 0, "reversed").when((pre == 0) & (post != 0) | (size > 2), "faster").when(size < 0.5, "slower").when(pre.isNotNull() & post.isNotNull(), "same")


def debut_fields(panel: DataFrame, fields: Sequence[str], least: int = 1) -> DataFrame:
    """First articles by year of debut: authors, and the mean of each field."""
    first = panel.where("author is not null").groupBy("author").agg(F.min_by(F.struct(*fields), F.struct("created", "id")).alias("z"), F.min("month").alias("debut"))
    return first.groupBy(F.substring("debut", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("authors"), *[F.avg(f"z.{f}").alias(f) for f in fields]).where(F.col("authors") >= least)


def debut_profile(panel: DataFrame, least: int = 1) -> DataFrame:
    """First articles by year of debut: authors, mean and median value, share without likes."""
    first = panel.groupBy("author").agg(F.min_by(F.struct("value", "likes"), F.struct("created", "id")).alias("z"), F.min("month").alias("debut"))
    return first.groupBy(F.substring("debut", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("authors"), F.avg("z.value").alias("mean_value"), F.median("z.value").alias("median_value"), (100 * F.avg((F.col("z.likes") == 0).cast("double"))).alias("zero_pct")
    ).where(F.col("authors") >= least)


def layer_of(count: Column) -> Column:
    """Experience from the number of earlier articles."""
    return F.when(count == 0, "0").when(count <= 2, "1-2").when(count <= 9, "3-9").otherwise("10+")


def month_index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def with_prior(panel: DataFrame) -> DataFrame:
    """Adds ``prior``, the author's articles in earlier months: counts per author and month, then a running sum. Rows
    without an author have none."""
    counts = panel.where("author is not null").groupBy("author", "month").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("author").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("author", "month", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("prior"))
    return panel.join(counts, ["author", "month"], "left").fillna(0, ["prior"])


def composition(panel: DataFrame, a: Column, b: Column) -> DataFrame:
    """Shift-share of the mean between two periods over experience layers: composition and within parts with either
    period as base, and the interaction; comp_a + within_b = comp_b + within_a = total."""
    rows = with_prior(panel).where(a | b).withColumn("period", F.when(a, "a").otherwise("b")).withColumn("layer", layer_of(F.col("prior")))
    cells = rows.groupBy("layer").agg(*[f for p in "ab" for f in (F.count_if(F.col("period") == p).alias(f"n{p}"), F.coalesce(F.avg(F.when(F.col("period") == p, F.col("value"))), F.lit(0.0)).alias(f"m{p}"))])
    whole = cells.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    c = cells.crossJoin(F.broadcast(whole)).select("ma", "mb", (F.col("na") / F.col("ta")).alias("sa"), (F.col("nb") / F.col("tb")).alias("sb"))
    sa, sb, ma, mb = (F.col(x) for x in ("sa", "sb", "ma", "mb"))
    return c.agg(
        F.sum(sb * mb - sa * ma).alias("total"), F.sum((sb - sa) * ma).alias("comp_a"), F.sum((sb - sa) * mb).alias("comp_b"),
        F.sum(sa * (mb - ma)).alias("within_a"), F.sum(sb * (mb - ma)).alias("within_b"), F.sum((sb - sa) * (mb - ma)).alias("interaction"),
    )


def std_diff(panel: DataFrame, a: Column, b: Column) -> DataFrame:
    """Difference of means in population SDs of the first period, ratio, and both sides' articles and authors."""
    side = lambda p: F.when(p, F.col("value"))
    row = panel.agg(
        F.count(side(a)).alias("n_a"), F.count(side(b)).alias("n_b"), F.countDistinct(F.when(a, F.col("author"))).alias("authors_a"), F.countDistinct(F.when(b, F.col("author"))).alias("authors_b"),
        F.avg(side(a)).alias("mean_a"), F.avg(side(b)).alias("mean_b"), F.stddev_pop(side(a)).alias("sd_a"),
    )
    return row.withColumns({"effect": (F.col("mean_b") - F.col("mean_a")) / F.nullif(F.col("sd_a"), F.lit(0.0)), "ratio": F.col("mean_b") / F.nullif(F.col("mean_a"), F.lit(0.0))})


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Valid and null counts, p05, p50 and p95 of numeric columns, from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = df.select(cells.alias("z")).select("z.field", "z.x")
    counts = rows.groupBy("field").agg(F.count("x").alias("valid"), F.count_if(F.col("x").isNull()).alias("nulls"))
    found = quantiles(rows, ["field"], "x", [0.05, 0.5, 0.95]).select("field", F.col("q0").alias("p05"), F.col("q1").alias("p50"), F.col("q2").alias("p95"))
    return counts.join(found, "field", "left")


def flag_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Valid and null counts and the share of true of boolean columns, from one scan."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("x")) for c in columns]))
    return df.select(cells.alias("z")).groupBy(F.col("z.field").alias("field")).agg(F.count("z.x").alias("valid"), F.count_if(F.col("z.x").isNull()).alias("nulls"), F.avg(F.col("z.x").cast("double")).alias("true_share"))


#: Cumulative probabilities of a Poisson count of mean 1.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)
LEAST_AUTHORS = 5


def bootstrap(panel: DataFrame, a: Column, b: Column, n: int = 400, seed: int = 42) -> DataFrame:
    """Author-clustered bootstrap interval of the difference of means. Authors are their sums and counts, and an author
    is in a replicate as often as a Poisson count of mean 1 says, drawn by a hash of seed, replicate, side and author:
    no numbering of authors, no join, and sums that are partial before they shuffle. There is no interval with under
    LEAST_AUTHORS on a side, or if under half of the replicates have values on both."""
    rows = panel.where(a | b).withColumn("side", F.when(a, "a").otherwise("b"))
    sums = rows.groupBy("side", "author").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    # a digest of 128 bits serves four replicates
    draws = sums.withColumn("four", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))))
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), "side", F.col("four").cast("string"), F.col("author").cast("string")))
    parts = F.explode(F.array(*[F.struct((4 * F.col("four") + k).alias("rep"), (F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("u")) for k in range(4)]))
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    drawn = draws.withColumn("digest", digest).select("side", "s", "c", parts.alias("z")).select("side", "s", "c", "z.*").where(F.col("rep") < n).withColumn("w", times)
    total = lambda p, x: F.sum(F.when(F.col("side") == p, F.col("w") * F.col(x)))
    means = drawn.groupBy("rep").agg(*[(total(p, "s") / F.nullif(total(p, "c"), F.lit(0))).alias(f"m{p}") for p in "ab"], *[F.count_if(F.col("side") == p).alias(f"k{p}") for p in "ab"])  # each replicate has a row of every author
    ordered = F.sort_array(F.collect_list(F.col("mb") - F.col("ma")))  # n values
    valid = (F.col("authors") >= LEAST_AUTHORS) & (F.size("d") >= n // 2)
    pick = lambda q: F.when(valid, F.get("d", (F.lit(q) * (F.size("d") - 1)).cast("int")))
    return means.agg(ordered.alias("d"), F.least(F.max("ka"), F.max("kb")).alias("authors")).select(F.size("d").cast("long").alias("replicates"), pick(0.025).alias("low"), pick(0.975).alias("high"))


def top_share(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """What part of the sum the top share of rows has; places go by value, then id. Rows are counted by value first, and
    the running sums over distinct values are taken by partitions."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    runs = scanned(counts, [], [falling(F.col(value))], sums={"before": "n"})
    whole = counts.agg(F.sum("n").alias("rows"), F.sum(F.col(value) * F.col("n")).alias("whole"))
    each = runs.crossJoin(F.broadcast(whole)).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    taken = F.least(F.col("n"), F.greatest(F.lit(0), F.ceil(F.col("share") * F.col("rows")) - F.col("before")))
    return each.groupBy("share").agg((100.0 * F.sum(taken * F.col(value)) / F.max("whole")).alias("sum_pct"))
