"""What the operators of this package share: words, scratch tables, safe one-time evaluation."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
TOKENIZERS = "/opt/tokenizers"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it
    unset, and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpuswright-")
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def vocabulary(spark: SparkSession, name: str) -> str:
    """The path of a public tokenizer's file; spark.corpuswright.tokenizers names its folder."""
    return f"{spark.conf.get('spark.corpuswright.tokenizers', TOKENIZERS)}/{name}"


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/corpuswright/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: object) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and survives the loss of executors. ``options``: of the writer."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")  # the shuffles of a table that is written go at once, not when the driver collects garbage
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of tables made by :func:`written`."""
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them from those of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in ``column`` have some ``most`` bytes together, or are single."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


#: Bytes of rows that go to Python at once: its buffers are outside the JVM's heap, two a task. Spark's default is 64 MB.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def through_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
    """``df.mapInArrow`` for rows with texts: in small batches, unless the session has a size of its own, and with what a
    task has freed given back to the system at its end, since workers live on and stand idle while other stages run."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, kinds)


def give_back() -> None:
    """Memory that this process has freed, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The next draws of 64-bit counters: step and finaliser of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
