"""Queries over streams, run to their end on the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..scratch import fresh
from ..sources.tables import table
from ..streaming import jobs
from .panel_queries import rounded
from .registry import register


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream comes to when it has read all there is: each batch's updates are written to a folder of their own
    beside the checkpoint, in the shared folder, and read together with the batch's number."""
    spark = stream.sparkSession
    root = fresh(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@register("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's weekly windows: the newest row of each week."""
    rows = _drained(jobs.weekly_stream(_events(spark, sf_dir)))
    return rounded(rows.groupBy("week_start").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")), "total", to=4)


@register("""SELECT user_id::VARCHAR AS job, max_by(CASE event_id % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'done' ELSE 'failed' END, (ts, CASE event_id % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'done' ELSE 'failed' END)) AS state FROM events GROUP BY 1""")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each job in an append-only log; failed jobs stay claimable."""
    state = F.when(F.col("event_id") % 3 == 0, "claimed").when(F.col("event_id") % 3 == 1, "done").otherwise("failed")
    log = table(spark, sf_dir, "events", "event_id", "user_id", "ts").select(F.col("user_id").cast("string").alias("job"), state.alias("state"), F.col("ts").alias("at"))
    return log.groupBy("job").agg(F.max_by("state", F.struct("at", "state")).alias("state"))


@register("""WITH e AS (SELECT user_id::VARCHAR AS job, CASE event_id % 3 WHEN 0 THEN 'claimed' WHEN 1 THEN 'done' ELSE 'failed' END AS state, ts FROM events), l AS (SELECT job, max_by(state, (ts, state)) AS state, max(ts) AS newest FROM e GROUP BY 1)
SELECT job, CASE WHEN state = 'claimed' AND epoch_us(newest) // 1000 + 900000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) THEN 'pending' ELSE state END AS state, epoch_us(newest) AS at_us FROM l""")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream with state and timers: each job's state when all has been read, its stale claims pending."""
    state = F.when(F.col("event_id") % 3 == 0, "claimed").when(F.col("event_id") % 3 == 1, "done").otherwise("failed")
    log = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("job"), state.alias("state"), F.col("ts").alias("at"), "ts")
    rows = _drained(jobs.job_states(log, clock="ts")).groupBy("job").agg(F.max_by(F.struct("state", "at"), "batch").alias("z"))
    return rows.select("job", "z.state", F.unix_micros("z.at").alias("at_us"))
