"""Size-tiered compaction of immutable shards under a versioned manifest [native].

Arrivals are appended as small Parquet shards that never change. Shards of similar size form a tier (powers of FAN);
a tier with FAN shards or more is read and written again as shards of about TARGET bytes, without a shuffle: the scan
packs whole shards into tasks of that size. A manifest lists the live shards of a version. It is written aside and
becomes the next version by one rename that fails where that version exists, so a writer commits wholly or not at all,
and two writers cannot both make a version. What a failed job leaves is in no manifest.

Defined results: rows are kept as they are, with nulls, repeats and any columns; an empty arrival adds no shard but a
version; a store without shards reads as an empty table of the schema asked for.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch, spare

TARGET = 128 << 20
FAN = 4
UNIT = 1 << 20  # shards below this are of the lowest tier
ENTRY = "file string, bytes bigint, rows bigint"


class ShardStore:
    """Shards and manifests under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan: int = FAN, unit: int = UNIT) -> None:
        self.spark, self.folder, self.target, self.fan, self.unit = spark, folder.rstrip("/"), target, fan, unit
        self.hadoop = spark._jvm.org.apache.hadoop
        self.root = self.hadoop.fs.Path(self.folder)
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.root.getFileSystem(self.conf)
        self.files.mkdirs(self.hadoop.fs.Path(f"{self.folder}/manifest"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        found = self.files.listStatus(self.hadoop.fs.Path(f"{self.folder}/manifest"))
        names = (re.fullmatch(r"v(\d+)", x.getPath().getName()) for x in found)
        return max((int(n[1]) for n in names if n), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, bytes and rows of the live shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.range(0).select(F.lit("").alias("file"), F.col("id").alias("bytes"), F.col("id").alias("rows"))
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest/v{version:010d}")

    def _commit(self, entries: DataFrame, after: int) -> int:
        """Makes ``entries`` the version after ``after``, or fails if there is one."""
        aside = f"{self.folder}/manifest/_new-{uuid.uuid4().hex}"
        entries.select("file", "bytes", "rows").repartition(1).write.parquet(aside)
        context = self.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context.rename(context.makeQualified(self.hadoop.fs.Path(aside)), context.makeQualified(self.hadoop.fs.Path(f"{self.folder}/manifest/v{after + 1:010d}")), options)
        return after + 1

    def described(self, folder: str) -> DataFrame:
        """file, bytes and rows of the shards in a folder, from what the scan knows of its files."""
        meta = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).select("_metadata.file_path", "_metadata.file_size")
        return meta.groupBy(F.col("file_path").alias("file"), F.col("file_size").cast("long").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))

    def append(self, arrival: DataFrame) -> int:
        """Writes an arrival as new shards and commits them."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(folder)
        return self.adopt(folder)

    def adopt(self, folder: str) -> int:
        """Commits the shards in a folder, which belongs to the store from then on."""
        now = self.version()
        return self._commit(self.manifest(now).unionByName(self.described(folder)), now)

    def tiers(self, version: int | None = None) -> DataFrame:
        """The manifest with ``tier``; shards above half the target are done and have none."""
        tier = F.floor(F.log(F.greatest(F.col("bytes") / F.lit(float(self.unit)), F.lit(1.0))) / F.log(F.lit(float(self.fan)))).cast("int")
        return self.manifest(version).withColumn("tier", F.when(2 * F.col("bytes") <= self.target, tier))

    def _packing(self) -> SparkSession:
        """A session whose scans put whole shards together up to the target."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return session

    def compact(self) -> int:
        """Merges tiers until none has FAN shards; each merge commits a version. Returns the newest."""
        stuck: set[int] = set()
        while True:
            now = self.version()
            due = self.tiers(now).where("tier is not null").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.collect_list("file").alias("files"))
            # the names of one tier's files: the scan's planner holds the same list on the driver
            due = [r for r in due.where(F.col("n") >= self.fan).orderBy("tier").collect() if r.tier not in stuck]
            if not due:
                return now
            row = due[0]
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            self._packing().read.parquet(*row.files).write.option("compression", "zstd").parquet(folder)
            made = self.described(folder)
            n, rows = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
            if rows != row.rows:
                raise RuntimeError(f"merging {row.n} shards of {row.rows} rows gave {rows} rows")
            if n >= row.n:  # the session's own limits keep the scan from packing
                stuck.add(row.tier)
                self.files.delete(self.hadoop.fs.Path(folder), True)
                continue
            stays = self.tiers(now).where(~F.col("tier").eqNullSafe(F.lit(row.tier))).drop("tier")
            self._commit(stays.unionByName(made), now)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards that none of the last ``keep`` versions names; returns how many."""
        now = self.version()
        live = {r.file for v in range(max(1, now - keep + 1), now + 1) for r in self.manifest(v).select("file").toLocalIterator()}
        known = {r.file for v in range(1, now - keep + 1) if self.files.exists(self.hadoop.fs.Path(f"{self.folder}/manifest/v{v:010d}")) for r in self.manifest(v).select("file").toLocalIterator()}
        for file in known - live:
            self.files.delete(self.hadoop.fs.Path(file), False)
        for v in range(1, now - keep + 1):
            self.files.delete(self.hadoop.fs.Path(f"{self.folder}/manifest/v{v:010d}"), True)
        return len(known - live)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        files = [r.file for r in self.manifest(version).select("file").toLocalIterator()]
        if not files:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.spark.read.schema(schema).parquet(*files)


def compacted(df: DataFrame, arrivals: int = 4, target: int = TARGET, folder: str | None = None) -> ShardStore:
    """A store to which the rows came in so many arrivals, with compaction after each."""
    folder = folder or scratch(df.sparkSession, "shards")
    store = ShardStore(df.sparkSession, folder, target)
    inbox = f"{folder}/data/inbox"
    batch = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(arrivals)).cast("int")
    (arrival,) = spare(df, "_arrival")
    df.withColumn(arrival, batch).write.option("compression", "zstd").partitionBy(arrival).parquet(inbox)
    for k in range(arrivals):
        part = f"{inbox}/{arrival}={k}"
        if store.files.exists(store.hadoop.fs.Path(part)):
            store.adopt(part)
            store.compact()
            store.vacuum()
    return store


def op6(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars and text_md5 of every document as read from the newest version, and how often that version's
    manifest lists the row's shard."""
    store = compacted(documents)
    version = store.version()
    rows = store.read(documents.schema, version).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), (F.col("_metadata.file_path") if version else F.lit("")).alias("shard"))
    entries = store.manifest(version).groupBy(F.col("file").alias("shard")).agg(F.count(F.lit(1)).alias("listed"))
    return rows.join(entries, "shard", "left").select("doc_id", "n_chars", "text_md5", F.coalesce("listed", F.lit(0)).alias("listed"))


OP6_SQL = "SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, 1::BIGINT AS listed FROM documents"
