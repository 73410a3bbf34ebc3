"""Ingest: targets, manifests, raw records, and a paged source read as one partition a day."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

ARTICLES = (
    "id string, title string, body string, created_at string, updated_at string, likes_count bigint, stocks_count bigint, comments_count bigint, private boolean, coediting boolean, slide boolean, "
    "url string, user_id string, user_followees_count bigint, user_followers_count bigint, user_items_count bigint, tags array<string>"
)
MANIFEST = "date string, fetched bigint, api_total_count bigint, complete boolean, truncated_at_10k boolean, fetched_at string"
CEILING = 10_000


def expected_months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row per month from first to last ('yyyy-MM')."""
    months = F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"), F.day(F.last_day("m")).alias("days"))


def target_days(spark: SparkSession, months: Sequence[str]) -> DataFrame:
    """Distinct days of the months asked for, in any order and repeated or not."""
    first = F.to_date(F.concat(F.col("m"), F.lit("-01")))
    rows = spark.range(1).select(F.explode(F.array_distinct(F.array(*[F.lit(m) for m in months]))).alias("m"))
    return rows.select(F.explode(F.sequence(first, F.last_day(first), F.expr("interval 1 day"))).alias("day"))


def days_to_fetch(targets: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Target days without a complete manifest; all of them with ``force``."""
    return targets if force else targets.join(manifests.where("complete").select(F.to_date("date").alias("day")), "day", "left_anti")


def manifest_rollup(days: DataFrame, months: DataFrame) -> DataFrame:
    """Progress by month from rows (date, fetched, complete): complete days, days, fetched, state."""
    done = days.where("complete").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("done"), F.sum("fetched").alias("fetched"))
    state = F.when(F.col("done") == 0, "missing").when(F.col("done") == F.col("days"), "complete").otherwise("partial")
    return months.join(done, "month", "left").fillna(0, ["done", "fetched"]).withColumn("state", state)


def read_articles(spark: SparkSession, *paths: str, label: str | None = None, glob: str | None = None) -> DataFrame:
    """Raw articles from JSON lines (files, folders and patterns; ``glob`` picks files by name), with month and day from
    the file's name where it holds a date, by which a scan is pruned; with ``label``, an ad-hoc period."""
    reader = spark.read.schema(ARTICLES)
    frame = (reader.option("pathGlobFilter", glob) if glob else reader).json(list(paths))
    day = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    frame = frame.withColumn("day", day).withColumn("month", F.substring("day", 1, 7))
    return frame.withColumn("label", F.lit(label)) if label else frame


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, one JSON document a file; those that can't be parsed are left out."""
    # through text, as the reader of JSON drops a column that is read alone
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}).alias("z"))
    return rows.where("z.date is not null").select("z.*")


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, body): a row per Markdown file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON document of settings: a profile, thresholds, a series. It is small by nature and goes to the driver."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one document")
    return json.loads(rows[0][0])


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """metric, p10..p90, zero_ratio and direction (low, high or two) of a reference profile document."""
    way = {"low_is_suspicious": "low", "high_is_suspicious": "high", "two_sided": "two"}
    rows = [(k, *(float(v[p]) for p in ("p10", "p25", "p50", "p75", "p90")), float(v.get("zero_ratio", 0.0)), way.get(v.get("direction", ""), "two")) for k, v in read_config(spark, path)["metrics"].items()]
    return spark.createDataFrame(rows, "metric string, p10 double, p25 double, p50 double, p75 double, p90 double, zero_ratio double, direction string")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """word, year and value of a timeline document (years, and words with their series)."""
    found = read_config(spark, path)
    rows = [(w["word"], str(y), None if v is None else float(v)) for w in found["words"] for y, v in zip(found["years"], w["series"], strict=True)]
    return spark.createDataFrame(rows, "word string, year string, value double")


def read_lexicon(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """(word, rank) of a lexicon in JSON lines, in order of first appearance, each word once."""
    rows = spark.read.schema(f"{column} string").json(path).where(F.col(column).isNotNull()).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy(F.col(column).alias("word")).agg(F.min("_at").alias("rank"))


def write_document(rows: DataFrame, path: str, order: Sequence[str], **head: object) -> None:
    """A JSON result document: the fields of ``head``, and ``rows`` in order. A report of some rows, not a table."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(100_001).collect()]
    if len(found) > 100_000:
        raise ValueError("over 100,000 rows are no document")
    text = json.dumps(head | {"rows": found}, ensure_ascii=False, default=str)
    rows.sparkSession.range(1).select(F.lit(text)).coalesce(1).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Extracted rows as JSON lines; nulls are written, so that every line has every field."""
    rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_log(entries: DataFrame, path: str, batch: str) -> None:
    """Appends entries to a log. Each batch is a folder of its own: one that is written again replaces itself, others are
    never touched, and readers see a batch once it is whole."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch is named by letters, digits, dots and dashes")
    entries.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All entries of a log, with their batch."""
    return spark.read.schema(schema + ", logged_at timestamp, batch string").option("basePath", path).json(f"{path.rstrip('/')}/batch=*")


def register_views(spark: SparkSession, folder: str, names: Sequence[str], prefix: str = "") -> None:
    """Temporary views over the Parquet tables of a folder, for SQL."""
    for name in names:
        spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").createOrReplaceTempView(prefix + name)


def as_of(articles: DataFrame, at: str, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Articles as they could be known at a time: those created by then; what was changed later counts as not changed,
    and ``settled`` says whether a month has passed since creation, before which late edits are still to come."""
    then, made = F.to_timestamp(F.lit(at)), F.to_timestamp(F.col(created))
    seen = articles.where(made <= then)
    changed = F.when(F.to_timestamp(F.col(updated)) <= then, F.col(updated)).otherwise(F.col(created))
    return seen.withColumn(updated, changed).withColumn("settled", made <= then - F.expr("interval 1 month"))


def slim(raw: DataFrame) -> DataFrame:
    """Raw API records to the article schema: the user flattened, tags as names."""
    user = lambda c: F.col(f"user.{c}")
    keep = ("id", "title", "body", "created_at", "updated_at", "likes_count", "stocks_count", "comments_count", "private", "coediting", "slide", "url")
    return raw.select(*keep, user("id").alias("user_id"), user("followees_count").alias("user_followees_count"), user("followers_count").alias("user_followers_count"), user("items_count").alias("user_items_count"), F.transform("tags", lambda t: t["name"]).alias("tags"))


def manifests_of(articles: DataFrame, totals: DataFrame) -> DataFrame:
    """A manifest a day from articles and rows (date, api_total_count)."""
    n = articles.groupBy(F.substring("created_at", 1, 10).alias("date")).agg(F.count(F.lit(1)).alias("fetched"))
    out = totals.join(n, "date", "left").fillna(0, ["fetched"])
    return out.withColumns({"truncated_at_10k": F.col("api_total_count") >= CEILING, "complete": F.col("fetched") >= F.least(F.col("api_total_count"), F.lit(CEILING)), "fetched_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def first_days(df: DataFrame, period: Column, day: Column, days: int = 8) -> DataFrame:
    """Rows of the first ``days`` existing days of each period (not of the calendar)."""
    known = df.select(period.alias("_p"), day.alias("_d")).distinct().withColumn("_k", F.dense_rank().over(Window.partitionBy("_p").orderBy("_d"))).where(F.col("_k") <= days).select("_p", "_d")
    return df.withColumns({"_p": period, "_d": day}).join(known, ["_p", "_d"], "left_semi").drop("_p", "_d")


def monthly_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is a plain month, without derived ones."""
    return df.where(F.col(label).rlike(r"^\d{4}-\d{2}$"))


def write_split(df: DataFrame, reason: str, folder: str) -> None:
    """Kept and excluded rows (part=kept, part=excluded) in one scan, each partitioned by month; a month that is written
    again is replaced."""
    part = F.when(F.col(reason).isNull(), "kept").otherwise("excluded")
    df.withColumn("part", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "month").parquet(folder)


def wait_of(status: int, headers: dict[str, str], attempt: int, now: float, reserve: int = 50) -> float:
    """Seconds to wait after a response: until the quota's reset when it is refused or nearly used up, longer each time
    after a fault, else none."""
    reset = max(0.0, float(headers.get("rate-reset", now)) - now) + 1
    if status in (403, 429):
        return reset
    if status >= 500:
        return min(45.0, 3 * 1.8**attempt)
    return reset if int(headers.get("rate-remaining", reserve + 1)) <= reserve else 0.0


def http_page(url: str, token: str | None) -> tuple[int, dict[str, str], list[dict]]:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.status, {k.lower(): v for k, v in answer.headers.items()}, json.load(answer)
    except urllib.error.HTTPError as error:
        return error.code, {k.lower(): v for k, v in error.headers.items()}, []
    except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError):
        return 599, {}, []  # as a fault of the server: tried again


class Truncated(Exception):
    """A day has more records than the source hands out."""


def fetch_day(day: dt.date, page: Callable[[dt.date, int], tuple[int, dict[str, str], list[dict]]], per_page: int = 100, pages: int = 100, tries: int = 5, sleep: Callable[[float], None] = time.sleep, told: dict | None = None) -> Iterator[dict]:
    """All records of a day, page by page, until an empty or short page or the source's last (a Link header without a
    next page). A day that goes on beyond ``pages`` raises Truncated after its last record, so that nobody takes it for
    whole. ``told`` gets the total that the first answer states, if it does."""
    for number in range(1, pages + 1):
        for attempt in range(tries):
            status, headers, items = page(day, number)
            pause = wait_of(status, headers, attempt, time.time())
            if pause:
                sleep(pause)
            if status == 200:
                break
        else:
            raise OSError(f"{day}: page {number} failed {tries} times")
        if told is not None and "total" not in told and str(headers.get("total-count", "")).isdigit():
            told["total"] = int(headers["total-count"])
        yield from items
        if len(items) < per_page or "link" in headers and 'rel="next"' not in headers["link"]:
            return
    raise Truncated(f"{day}: more than {pages} pages")


class Day(InputPartition):
    def __init__(self, day: str) -> None:
        super().__init__(day)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first, last = (dt.date.fromisoformat(self.options[k]) for k in ("first", "last"))
        return [Day((first + dt.timedelta(k)).isoformat()) for k in range((last - first).days + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        address, token = self.options["address"], self.options.get("token")
        page = lambda day, n: http_page(address.format(day=day.isoformat(), next=(day + dt.timedelta(1)).isoformat(), page=n), token)
        n = 0
        pause = float(self.options.get("pause", 0)) * int(self.options.get("workers", 1))  # the quota is everybody's

        def paced(day: dt.date, number: int) -> tuple[int, dict[str, str], list[dict]]:
            time.sleep(pause)
            return page(day, number)

        told: dict[str, int] = {}
        try:
            for item in fetch_day(dt.date.fromisoformat(partition.value), paced, tries=int(self.options.get("tries", 5)), told=told):
                n += 1
                yield partition.value, json.dumps(item, ensure_ascii=False), None
            error = None
        except Truncated:
            error = "truncated"
        except OSError as fault:  # the other days go on; this one is incomplete
            error = str(fault)
        total = told.get("total")
        yield partition.value, None, json.dumps({"fetched": n, "api_total_count": total, "complete": error is None and n >= (total or 0), "truncated_at_10k": error == "truncated" or (total or 0) >= CEILING, "error": error})


class PagedSource(DataSource):
    """A paged HTTP API: options address (with {day}, {next} and {page}), first, last, token, pause (seconds between the
    requests of all workers together) and workers (tasks that run at once). A row per record, and one a day with its
    outcome: how many were fetched, whether that is all, and the fault if not."""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "day string, record string, outcome string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options))
