"""The stream of days and its committing sink, against a small HTTP server."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from corpuswright.sources import days
from corpuswright.sources.ingest import ARTICLES

RECORDS = {"2024-01-01": 3, "2024-01-02": 250, "2024-01-03": 0, "2024-01-04": 100, "2024-01-05": 7}


@pytest.fixture
def api():
    """Serves RECORDS by pages of 100; ``hides[day]``: that many of its records are held back, though the total counts them."""
    hides, asked = {}, Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            query = parse_qs(urlparse(self.path).query)
            day, page = query["day"][0], int(query["page"][0])
            asked[day, page] += 1
            n = RECORDS.get(day, 0)
            there = [{"id": f"{day}-{k}", "title": f"t\n{k}", "created_at": f"{day}T00:00:00Z"} for k in range(n - hides.get(day, 0))]
            body = json.dumps(there[100 * (page - 1) : 100 * page]).encode()
            self.send_response(200)
            self.send_header("Total-Count", str(n))
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/?day={{day}}&next={{next}}&page={{page}}", hides, asked
    server.shutdown()


def test_days_are_fetched_once_and_incomplete_ones_again(spark, tmp_path, api):
    address, hides, asked = api
    folder, options = str(tmp_path / "raw"), {"address": address, "first": "2024-01-01", "last": "2024-01-03", "per_batch": "2", "days_tried": "3"}
    hides["2024-01-02"] = 40
    days.fetch_all(spark, folder, str(tmp_path / "cp"), **options)
    told = {r.date: r for r in days.read_day_manifests(spark, folder).collect()}
    assert {d: (r.fetched, r.api_total_count, r.complete, r.tries) for d, r in told.items()} == {"2024-01-01": (3, 3, True, 1), "2024-01-02": (210, 250, False, 3), "2024-01-03": (0, 0, True, 1)}
    rows = days.read_days(spark, folder, ARTICLES)
    assert {(r.day, r.complete): r["count"] for r in rows.groupBy("day", "complete").count().collect()} == {("2024-01-01", True): 3, ("2024-01-02", False): 210}

    # stopped, more days asked for, and the missing records there now
    hides.clear()
    days.fetch_all(spark, folder, str(tmp_path / "cp"), **(options | {"last": "2024-01-05", "days_tried": "5"}))
    rows = days.read_days(spark, folder, ARTICLES)
    assert {r.day: r["count"] for r in rows.groupBy("day").count().collect()} == {d: n for d, n in RECORDS.items() if n}
    assert rows.select("id").distinct().count() == rows.count() == 360
    assert rows.where("not complete").count() == 0
    assert asked["2024-01-01", 1] == 1  # never again
    assert asked["2024-01-04", 1] == 1
    days.fetch_all(spark, folder, str(tmp_path / "cp"), **(options | {"last": "2024-01-05"}))
    assert asked["2024-01-05", 1] == 1


def test_a_batch_that_fails_leaves_the_old_days(spark, tmp_path):
    folder = str(tmp_path / "raw")
    rows = spark.createDataFrame([("2024-01-01", "1", "a"), ("2024-01-02", "2", "b")], "day string, id string, title string")
    days.save_days(rows, folder)
    fails = rows.withColumn("title", F.when(F.col("id") == "2", F.raise_error(F.lit("lost"))).otherwise("new")).repartition(2, "id")
    with pytest.raises(Exception, match="lost"):
        days.save_days(fails, folder)
    read = lambda: {(r.day, r.id, r.title) for r in days.read_days(spark, folder, "id string, title string").collect()}
    assert read() == {("2024-01-01", "1", "a"), ("2024-01-02", "2", "b")}

    # all tasks done, the driver gone before the commit
    writer = days.DayWriter(folder)
    lost = writer.write(iter([{"day": "2024-01-01", "record": json.dumps({"id": "9", "title": "x"}), "outcome": None}]))
    assert lost.fetched == {"2024-01-01": 1}
    assert read() == {("2024-01-01", "1", "a"), ("2024-01-02", "2", "b")}
    own = days.Folder(folder)
    assert len(own.versions("2024-01-01")) == 2
    days.save_days(rows.where("id = '1'").withColumn("title", F.lit("c")), folder)
    assert read() == {("2024-01-01", "1", "c"), ("2024-01-02", "2", "b")}
    assert len(own.versions("2024-01-01")) == 1  # what nobody names is gone


def test_only_the_days_asked_for_are_opened(spark, tmp_path):
    folder = str(tmp_path / "raw")
    days.save_days(spark.createDataFrame([(f"2024-01-{d:02d}", str(d)) for d in range(1, 21)], "day string, id string"), folder)
    some = days.read_days(spark, folder, "id string", ["2024-01-03", "2024-01-04", "2030-01-01"])
    assert {(r.day, r.id) for r in some.collect()} == {("2024-01-03", "3"), ("2024-01-04", "4")}
    assert len(some.inputFiles()) == 2
    assert days.read_days(spark, folder, "id string", []).count() == 0
    assert days.read_days(spark, str(tmp_path / "nowhere"), "id string").count() == 0


def test_a_writer_takes_back_what_it_wrote(tmp_path):
    writer = days.DayWriter(str(tmp_path))
    put = writer.write(iter([{"day": "d", "record": "{}", "outcome": None}, {"day": "d", "record": None, "outcome": '{"complete": false, "api_total_count": 12000}'}]))
    writer.abort([put, None])
    assert days.Folder(str(tmp_path)).versions("d") == []
    again = days.DayWriter(str(tmp_path))
    again.commit([again.write(iter([{"day": "d", "record": "{}", "outcome": '{"complete": false, "api_total_count": 12000}'}])), None])
    own = days.Folder(str(tmp_path)).manifest("d")
    assert (own["fetched"], own["complete"], own["truncated_at_10k"], own["tries"]) == (1, False, True, 1)
