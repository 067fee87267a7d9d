"""Intermediate tables in the shared folder."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir; it goes when the application ends.

    Where that isn't set, it is below the warehouse, unless the warehouse is on this machine alone and others need it.
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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder.

    This cuts the lineage, survives lost executors, and gives later plans true sizes: checkpoint() would keep the
    estimates of joins, whose products explode in loops. Plans take a file's bytes for its rows' and broadcast what seems
    small, so dictionaries are off: with them millions of rows of few values are some hundred kilobytes. No _SUCCESS is
    left: for each file that the driver makes, Hadoop starts a process that shares the driver's memory until it runs.
    """
    spark = df.sparkSession
    path = new_path(spark, "held")
    df.write.option("parquet.enable.dictionary", "false").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """A written table of df with each row's number in `order`, from 0: inside ranges of rows, and over the ranges.

    No task needs all rows; the table of ranges has a row for each partition. Ties are broken as they come.
    """
    part = f"{name}_part"
    ranged = held(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), part).withColumn(name, inside + F.col("start")).drop(part, "start")
