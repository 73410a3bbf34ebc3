"""Streams: weekly windows, incremental ingest, and the state of a work queue."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.days import read_days, save_days
from ..sources.ingest import ARTICLES

STALE_S = 900
#: Monday weeks: the epoch is a Thursday.
MONDAY = "4 days"


def weekly_stream(events: DataFrame, at: str = "ts", value: str = "value", delay: str = "7 days", accuracy: int = 10_000) -> DataFrame:
    """Counts, sums and approximate medians by Monday week; a week closes when the watermark has passed it. Exact
    medians need all values of a week and are for batches (``operators.panel.weekly``)."""
    week = F.window(at, "7 days", "7 days", MONDAY)
    grouped = events.withWatermark(at, delay).groupBy(week.alias("week"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.percentile_approx(value, 0.5, accuracy).alias("median_value")).select(F.date_format("week.start", "yyyy-MM-dd").alias("week_start"), "n", "total", "median_value")


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Sessions of each user: an extension, for streams of events."""
    return events.withWatermark(at, delay).groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """New day files into a folder of days (``sources.days``). What a day holds already stays: of the records of one id the
    newest by updated_at is kept, so a day may come in parts, and a repeated batch leaves the same days. A day is replaced
    as a whole when its merged version is written; whoever reads in between, or after a failure, sees the one before."""

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("day", F.substring("created_at", 1, 10)).where(F.col("day").isNotNull())
        names = [r.day for r in new.select("day").distinct().collect()]  # the days of one batch
        if not names:
            return
        there = read_days(spark, target, ARTICLES, names).drop("complete")
        whole = F.struct(*[F.col(c) for c in new.columns])
        newest = new.withColumn("_late", F.lit(1)).unionByName(there.withColumn("_late", F.lit(0))).groupBy("id").agg(F.max_by(whole, F.struct(F.coalesce("updated_at", F.lit("")), "_late")).alias("z")).select("z.*")
        save_days(newest, target)

    return spark.readStream.schema(ARTICLES).json(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


JOB = "job string, state string, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Follow(StatefulProcessor):
    """Keeps a job's newest entry, and a timer while it is claimed."""

    def __init__(self, stale_s: int, by_event: bool, forget_s: int | None) -> None:
        self.stale_ms, self.by_event, self.forget_s = stale_s * 1000, by_event, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.forget_s is None else self.forget_s * 1000
        self.best = handle.getValueState("best", "state string, at timestamp", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.best.get() if self.best.exists() else None
        known = best
        for frame in rows:
            for state, at in zip(frame["state"], frame["at"], strict=True):
                if pd.notna(at) and (best is None or (at, state) > (pd.Timestamp(best[1]), best[0])):
                    best = (state, at.to_pydatetime())
        if best == known or best is None:
            return
        self.best.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[0] == "claimed":
            now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(max(_ms(best[1]) + self.stale_ms, now + 1))
        yield pd.DataFrame({"job": [key[0]], "state": [best[0]], "at": [best[1]]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the time of the claim stays, so that an older entry that comes late does not win
        at = self.best.get()[1]
        self.best.update(("pending", at))
        yield pd.DataFrame({"job": [key[0]], "state": ["pending"], "at": [at]})

    def close(self) -> None:
        pass


def _ms(at: datetime) -> int:
    """Milliseconds of a time; state and batches hold times without a zone, in that of the process."""
    return int(at.timestamp() * 1000)


def job_states(log: DataFrame, clock: str | None = None, delay: str = "0 seconds", stale_s: int = STALE_S, forget_s: int | None = None) -> DataFrame:
    """The present state of each job from a stream (job, state, at) of claimed, done and failed. The newest entry of a job
    counts, however late it comes, and a claim without news for ``stale_s`` goes back to pending.

    The clock by which claims expire is apart from the times of the entries: the wall clock, or a column ``clock`` of the
    times at which entries arrived. Of the latter, rows more than ``delay`` behind the newest are dropped, so it must not go
    back by more. With the wall clock, jobs without news for ``forget_s`` are dropped from the state.

    Defined results: entries without a time are ignored; equal entries count once; of entries of one time the last by name
    counts; a claim that is already stale when it comes is claimed until the clock next moves on."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store that has timers
    rows = log.withWatermark(clock, delay) if clock else log
    follow = _Follow(stale_s, clock is not None, forget_s)
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=follow, outputStructType=JOB, outputMode="Update", timeMode="EventTime" if clock else "ProcessingTime")


def pending_jobs(jobs: DataFrame, log: DataFrame, now: str | None = None, stale_s: int = STALE_S) -> DataFrame:
    """Jobs that a worker may claim, from a batch of the log: without an entry, failed, or claimed too long ago. Claims
    are exclusive because workers take disjoint hash parts of this table (:func:`part_of`)."""
    latest = log.groupBy("job").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))
    clock = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    busy = latest.where((F.col("state") == "done") | (F.col("state") == "claimed") & (F.unix_timestamp(clock) - F.unix_timestamp("at") <= stale_s))
    return jobs.join(busy.select("job"), "job", "left_anti")


def part_of(jobs: DataFrame, worker: int, workers: int) -> DataFrame:
    return jobs.where(F.pmod(F.xxhash64("job"), F.lit(workers)) == worker)
