"""Streams that run over several batches."""

from __future__ import annotations

import json
import os
import time


from corpuswright.streaming import jobs

LOG = "job string, state string, at timestamp, seen timestamp"


def followed(spark, tmp_path, log, **more):
    """The states of each job in the order they came, entries arriving one a batch."""
    for k, (job, state, at, seen) in enumerate(log):
        path = tmp_path / f"in{k}.json"
        path.write_text(json.dumps({"job": job, "state": state, "at": at and f"2024-01-01T{at}Z", "seen": f"2024-01-01T{seen}Z"}))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    out = []

    def put(batch, number):
        out.extend((r.job, r.state, r.at and r.at.strftime("%H:%M")) for r in batch.collect())

    jobs.job_states(stream, **more).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_claims_expire_and_late_entries_win(spark, tmp_path):
    log = [
        ("A", "done", "10:00:00", "10:00:00"), ("C", "claimed", "11:00:00", "11:00:00"), ("E", "claimed", "11:30:00", "11:30:00"),
        ("B", "done", "09:00:00", "11:40:00"),  # hours late by its own time
        ("A", "failed", "10:30:00", "11:41:00"), ("A", "claimed", "10:15:00", "11:42:00"), ("E", "done", "11:35:00", "11:43:00"), ("G", None, None, "11:44:00"), ("D", "claimed", "11:59:00", "12:00:00"),
        ("C", "done", "10:59:00", "12:01:00"),  # older than the claim that went stale
    ]
    got = followed(spark, tmp_path, log, clock="seen")
    latest = {job: state for job, state, _ in got}
    assert latest == {"A": "failed", "B": "done", "C": "pending", "D": "claimed", "E": "done"}
    assert [s for j, s, _ in got if j == "C"] == ["claimed", "pending"]
    assert [s for j, s, _ in got if j == "E"] == ["claimed", "done"]  # its timer is gone
    assert [s for j, s, _ in got if j == "A"] == ["done", "failed"]


def test_a_pending_job_is_claimed_again(spark, tmp_path):
    log = [("A", "claimed", "10:00:00", "10:00:00"), ("B", "done", "10:20:00", "10:20:00"), ("B", "done", "10:20:30", "10:20:30"), ("A", "claimed", "10:21:00", "10:21:00"), ("A", "claimed", "10:21:00", "10:22:00"), ("B", "failed", "10:30:00", "10:30:00")]
    got = [s for j, s, _ in followed(spark, tmp_path, log, clock="seen") if j == "A"]
    assert got == ["claimed", "pending", "claimed"]


def test_claims_expire_by_the_wall_clock(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LOG).json(str(tmp_path / "in"))
    (tmp_path / "in/0.json").write_text(json.dumps({"job": "A", "state": "claimed", "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}))
    out = []
    query = jobs.job_states(stream, stale_s=2).writeStream.foreachBatch(lambda b, n: out.extend(r.state for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 90
    while time.time() < until and "pending" not in out:
        time.sleep(0.5)
    query.stop()
    assert out == ["claimed", "pending"]
