"""What the corpus operators share: shared-folder tables, identity of rows, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a batch sent to Python; texts may be long, so batches are kept short.
ARROW_ROWS = 512
#: Bytes of rows that an operator works on at once, at most, but for a longer row.
BATCH_BYTES = 8_000_000


def tuned(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches short enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, in the folder that driver and executors share.

    A folder of our own, below the warehouse, only where none is set and no other machine needs it. The tables go when
    the application ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "stemma_checkpoints")
        if not spark.sparkContext.master.startswith("local") and urlsplit(found).scheme in ("", "file"):
            raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is on this machine alone")
    folder = f"{found.rstrip('/')}/stemma-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


_folders: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stemma_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def before(df: DataFrame, order: list[str | Column], keys: list[str], name: str, **sums: Column) -> DataFrame:
    """A written table of df with, for each of `sums`, its sum over the rows that come before in `order`, by `keys`.

    Rows are dealt out by ranges of keys and order, summed up inside their range and then over ranges, so no task needs
    all rows of a key. The table of ranges has a row for each key of each partition at most.
    """
    part = fresh(df, "__part")[0]
    held = written(df.withColumns({f"__{n}": c for n, c in sums.items()}).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), name)
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranges = held.groupBy(part, *keys).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    ranges = ranges.select(F.col(part).alias("__range"), *(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(zero(F.sum(f"__{n}").over(earlier)).alias(f"__all_{n}") for n in sums))
    same = F.col(part) == F.col("__range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    out = held.withColumns({f"__{n}": zero(F.sum(f"__{n}").over(inside)) for n in sums}).join(ranges, same)
    return out.withColumns({n: F.col(f"__{n}") + F.col(f"__all_{n}") for n in sums}).select(*(F.col(f"`{c}`") for c in df.columns), *sums)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a batch, nulls as empty."""
    return [x or "" for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, halved until they have `most` bytes or one row: what is made of them is bounded."""
    for b in rows:
        todo = [b]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


#: What operators hold in a worker from task to task; each adds its own.
HELD: list[dict] = []


def release(*kept: dict) -> None:
    """Give memory back at the end of a task: Python workers live on, and later stages need it.

    What other operators hold is dropped, all of `HELD` but `kept`.
    """
    for held in HELD:
        if not any(held is k for k in kept):
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
