"""Days of records, fetched as a stream and kept with a commit of their own.

The sink writes a day's records aside, under a version's name, and only when all tasks of a write are done does the driver
write the days' manifests, each by a rename: a manifest says which version of its day counts, how many records it has, how
many the source stated and whether that is all. A job that dies before leaves the old manifests and with them the old days,
whole; versions that no manifest names are removed by the next commit of their day.

The source reads the same manifests: its next batch is the first target days that have no complete one, so an incomplete
day comes again until it is complete or was tried often enough, and a restart begins where the manifests stand.

Folders are local ones or any that pyarrow's file systems know (file, hdfs, s3, gs); all executors and the driver reach
them. There is a manifest a day, so what the driver lists grows with days and not with records.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from .ingest import CEILING, MANIFEST, Day, PagedReader

TRIES = 5
PER_BATCH = 7


class Folder:
    """A folder of days, on any file system."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.files, self.root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def manifest(self, day: str) -> dict | None:
        try:
            with self.files.open_input_stream(f"{self.root}/manifests/{day}.json") as stream:
                return json.loads(stream.read())
        except FileNotFoundError:
            return None

    def manifests(self) -> dict[str, dict]:
        found = self.files.get_file_info(pafs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        days = sorted(f.base_name[:-5] for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
        return {day: own for day in days if (own := self.manifest(day))}

    def put(self, name: str, lines: list[str]) -> None:
        folder = f"{self.root}/{name}".rpartition("/")[0]
        self.files.create_dir(folder, recursive=True)
        with self.files.open_output_stream(f"{self.root}/{name}") as stream:
            stream.write("".join(x + "\n" for x in lines).encode())

    def put_whole(self, name: str, text: str) -> None:
        """A file that is seen whole or not at all."""
        folder, _, base = name.rpartition("/")
        aside = f"{folder}/.{base}.{uuid.uuid4().hex}"
        self.put(aside, [text])
        self.files.move(f"{self.root}/{aside}", f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/{name}").type != pafs.FileType.NotFound:
            self.files.delete_dir(f"{self.root}/{name}")

    def versions(self, day: str) -> list[str]:
        return [f.base_name for f in self.files.get_file_info(pafs.FileSelector(f"{self.root}/days/{day}", allow_not_found=True))]


@dataclass
class Put(WriterCommitMessage):
    """What one task has written: records by day, and the outcomes of days."""

    version: str = ""
    fetched: dict[str, int] = field(default_factory=dict)
    outcomes: dict[str, dict] = field(default_factory=dict)


class DayWriter(DataSourceWriter):
    """Writes (day, record, outcome): records as lines of their day's version; an outcome is the day's manifest to be."""

    LINES = 10_000

    def __init__(self, path: str) -> None:
        self.path, self.version = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Put:
        folder, done, held = Folder(self.path), Put(self.version), {}

        def out(day: str) -> None:
            lines = held.pop(day)
            folder.put(f"days/{day}/{self.version}/{uuid.uuid4().hex}.jsonl", lines)
            done.fetched[day] = done.fetched.get(day, 0) + len(lines)

        for row in iterator:
            if row["outcome"] is not None:
                done.outcomes[row["day"]] = json.loads(row["outcome"])
            if row["record"] is not None:
                held.setdefault(row["day"], []).append(row["record"].replace("\n", " "))
                if len(held[row["day"]]) >= self.LINES:
                    out(row["day"])
                elif sum(map(len, held.values())) >= 10 * self.LINES:
                    for day in list(held):
                        out(day)
        for day in list(held):
            out(day)
        return done

    def commit(self, messages: list[Put | None], batch: int | None = None) -> None:
        folder = Folder(self.path)
        fetched: dict[str, int] = {}
        outcomes: dict[str, dict] = {}
        versions: dict[str, set[str]] = {}  # the tasks' own, as who commits may be another copy of the writer
        for message in filter(None, messages):
            for day, n in message.fetched.items():
                fetched[day] = fetched.get(day, 0) + n
                versions.setdefault(day, set()).add(message.version)
            outcomes |= message.outcomes
        for day in sorted({*fetched, *outcomes}):
            before, told = folder.manifest(day) or {}, outcomes.get(day, {})
            n, total = fetched.get(day, 0), told.get("api_total_count")
            own = {
                "date": day, "fetched": n, "api_total_count": total, "complete": bool(told.get("complete", True)), "truncated_at_10k": (total or 0) >= CEILING or bool(told.get("truncated_at_10k")),
                "fetched_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S%z"), "versions": sorted(versions.get(day, ())), "tries": before.get("tries", 0) + 1, "batch": batch, "error": told.get("error"),
            }
            folder.put_whole(f"manifests/{day}.json", json.dumps(own))
            for version in folder.versions(day):
                if version not in own["versions"]:
                    folder.drop(f"days/{day}/{version}")

    def abort(self, messages: list[Put | None]) -> None:
        folder = Folder(self.path)
        for message in filter(None, messages):
            for day in message.fetched:
                folder.drop(f"days/{day}/{message.version}")


class DayStreamWriter(DataSourceStreamWriter):
    """The same for each batch of a stream; a batch that runs again writes a version of its own."""

    def __init__(self, path: str) -> None:
        self.one = DayWriter(path)

    def write(self, iterator: Iterator[Row]) -> Put:
        return self.one.write(iterator)

    def commit(self, messages: list[Put | None], batchId: int) -> None:  # noqa: N803
        self.one.commit(messages, batchId)

    def abort(self, messages: list[Put | None], batchId: int) -> None:  # noqa: N803
        self.one.abort(messages)


class DayFolder(DataSource):
    """A folder of days as a sink: ``write.format("day_folder")`` and ``writeStream``, option path."""

    @classmethod
    def name(cls) -> str:
        return "day_folder"

    def schema(self) -> str:
        return "day string, record string, outcome string"

    def writer(self, schema, overwrite: bool) -> DayWriter:  # noqa: ANN001
        return DayWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DayStreamWriter:  # noqa: ANN001, N802
        return DayStreamWriter(self.options["path"])


class DayStreamReader(DataSourceStreamReader):
    """An offset names the days of the batch that ends with it, each with the times it was tried before. It follows from
    the manifests alone: the same until a batch is committed, and without days when all are done."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"days": []}

    def latestOffset(self) -> dict:  # noqa: N802
        done = Folder(self.options["path"]).manifests()
        first, last = (dt.date.fromisoformat(self.options[k]) for k in ("first", "last"))
        days = ((first + dt.timedelta(k)).isoformat() for k in range((last - first).days + 1))
        tries = int(self.options.get("days_tried", TRIES))
        left = [[day, done.get(day, {}).get("tries", 0)] for day in days if not done.get(day, {}).get("complete") and done.get(day, {}).get("tries", 0) < tries]
        left.sort(key=lambda x: (x[1], x[0]))  # new days go before those that failed
        return {"days": left[: int(self.options.get("per_batch", PER_BATCH))]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Day(day) for day, _ in end["days"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return PagedReader(self.options).read(partition)


class DaysSource(DataSource):
    """The paged API of ``PagedSource`` as a stream of days, with the options path (the folder whose manifests tell what is
    done), per_batch (days a batch) and days_tried (how often an incomplete day is fetched)."""

    @classmethod
    def name(cls) -> str:
        return "paged_days"

    def schema(self) -> str:
        return "day string, record string, outcome string"

    def streamReader(self, schema) -> DayStreamReader:  # noqa: ANN001, N802
        return DayStreamReader(dict(self.options))


def fetch(spark: SparkSession, folder: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Fetches the days that ``folder`` lacks until none is left to try; runs on after any stop."""
    for source in (DaysSource, DayFolder):
        spark.dataSource.register(source)
    stream = spark.readStream.format("paged_days").options(path=folder, **options).load()
    return stream.writeStream.format("day_folder").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def fetch_all(spark: SparkSession, folder: str, checkpoint: str, **options: str) -> None:
    """:func:`fetch`, stopped when no day is left to try."""
    query, reader = fetch(spark, folder, checkpoint, **options), DayStreamReader({"path": folder, **options})
    try:
        while query.isActive and reader.latestOffset()["days"]:
            query.awaitTermination(1)
    finally:
        failed = query.exception()
        query.stop()
    if failed:
        raise failed


def save_days(rows: DataFrame, folder: str, day: str = "day", complete: bool = True) -> None:
    """Rows as days of a folder: each day that occurs is replaced as a whole. ``complete``: what its manifest says."""
    rows.sparkSession.dataSource.register(DayFolder)
    record = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != day]), {"ignoreNullFields": "false"})
    lean = rows.select(F.col(day).cast("string").alias("day"), record.alias("record"), (F.lit(None).cast("string") if complete else F.lit('{"complete": false}')).alias("outcome"))
    lean.write.format("day_folder").option("path", folder).mode("append").save()


def read_days(spark: SparkSession, folder: str, schema: str, days: list[str] | None = None) -> DataFrame:
    """The records of the days that count (of ``days`` only, if given: no other file is opened), with day and whether the
    day is complete."""
    own = Folder(folder)
    known = own.manifests() if days is None else {d: m for d in days if (m := own.manifest(d))}
    paths = [f"{folder.rstrip('/')}/days/{day}/{version}" for day, m in known.items() for version in m["versions"]]
    shape = f"{schema}, day string, complete boolean"
    if not paths:
        return spark.createDataFrame([], shape)
    flags = spark.createDataFrame([(day, m["complete"]) for day, m in known.items()], "day string, complete boolean")  # a row a day
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/days/([^/]+)/", 1)
    return spark.read.schema(schema).json(paths).withColumn("day", name).join(F.broadcast(flags), "day").select(*spark.createDataFrame([], shape).columns)


def read_day_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The manifests of a folder of days."""
    rows = [json.dumps(m) for m in Folder(folder).manifests().values()]
    shape = f"{MANIFEST}, versions array<string>, tries int, batch bigint, error string"
    return spark.createDataFrame([(x,) for x in rows], "value string").select(F.from_json("value", shape).alias("z")).select("z.*")
