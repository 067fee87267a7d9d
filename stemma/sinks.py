"""Writers: results, array files, maps and trees as JSON, summaries, event bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.scalar import SIGNIFICANCE
from stemma.sources.newick import write

#: Columns of a protocol that only matter for details.
DETAILS = [
    "relative_loss_positions", "loss_blocks", "loss_blocks_normalised", "presence_offsets", "fs_presence", "ls_presence", "fes_presence", "les_presence", "global_fes_presence", "global_les_presence",
    "branch_lengths", "kept_tokens", "rec_gains", "rec_losses", "tree", "topological_order", "arrays", "combined_arrays", "leaf_lengths", "alpha_precise", "lnl_precise", "significance_level", "chi2_quantile",
]


def write_results(protocol: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """The protocol as CSV without its detail columns; nested columns as JSON."""
    out = protocol.drop(*(DETAILS if drop is None else drop))
    nested = [f.name for f in out.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    out.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def write_by_status(protocol: DataFrame, path: str) -> None:
    """Main, trivial and skipped groups in one write."""
    protocol.write.mode("overwrite").partitionBy("status").parquet(path)


def array_lines(arrays: DataFrame) -> DataFrame:
    """group_id, array_id, record: each array as a header and its tokens."""
    from stemma.operators.arrays import packed

    return packed(arrays).select("group_id", "array_id", F.concat(F.lit(">"), F.col("array_id").cast("string"), F.lit("\n"), F.array_join(F.col("tokens").cast("array<string>"), ", ")).alias("record"))


def write_arrays(arrays: DataFrame, path: str, small: int = 0) -> None:
    """A folder for each group, under `small_groups` if it has up to `small` arrays."""
    lines = array_lines(arrays)
    sizes = lines.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select("group_id", F.when(F.col("n") <= small, "small_groups").otherwise("groups").alias("kind"))
    lines.join(sizes, "group_id").select("kind", "group_id", "array_id", "record").repartition("kind", "group_id").sortWithinPartitions("kind", "group_id", "array_id").drop("array_id").write.mode("overwrite").partitionBy("kind", "group_id").text(path)


def rename_files(spark: SparkSession, path: str, names: DataFrame) -> None:
    """Give the one file of each partition folder below path its name; names: folder, name, both relative to path.

    A table of Spark's writer becomes files as other programs name them. Only names go to the driver, a row for a file.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, name in names.select("folder", "name").distinct().collect():
        found = files.globStatus(hadoop.Path(f"{path}/{folder}/part-*"))
        if len(found) != 1:
            raise ValueError(f"{len(found)} files in {folder}")
        target = hadoop.Path(f"{path}/{name}")
        files.mkdirs(target.getParent())
        files.rename(found[0].getPath(), target)
    for top in {r[0].split("/")[0] for r in names.select("folder").distinct().collect()}:
        files.delete(hadoop.Path(f"{path}/{top}"), True)


def write_fasta(arrays: DataFrame, path: str) -> None:
    """A file for each group, named after it: a header and a line of tokens for each array."""
    lines = array_lines(arrays).withColumn("group", F.col("group_id").cast("string"))
    lines.select("group", "array_id", "record").repartition("group").sortWithinPartitions("group", "array_id").drop("array_id").write.mode("overwrite").partitionBy("group").text(path)
    rename_files(arrays.sparkSession, path, lines.select(F.concat(F.lit("group="), "group").alias("folder"), F.concat("group", F.lit(".fa")).alias("name")))


def as_json_map(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """by and one JSON object from keys to values, keys in order."""
    return rows.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v")))))).alias("json"))


def newick(trees: DataFrame) -> DataFrame:
    """group_id, newick from nodes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, None if p is None or p != p else p, None if b is None or b != b else float(b)) for n, p, b in zip(frame.node_id, frame.parent_id, frame.branch_length, strict=True)]
        return pd.DataFrame({"group_id": [frame.group_id.iloc[0]], "newick": [write(rows)]})

    return trees.select("group_id", "node_id", "parent_id", "branch_length").groupBy("group_id").applyInPandas(run, f"group_id {trees.schema['group_id'].dataType.simpleString()}, newick string")


def event_bundle(states: DataFrame, events: DataFrame, order: DataFrame, trees: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """group_id and JSON of profiles, gains, losses, the order of tokens and, where given, duplicate events and tree."""
    profile = states.where(F.col("state") == 1).groupBy("group_id", "node_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    lists = lambda kind: events.where(F.col("kind") == kind).groupBy("group_id", "node_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    out = order.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("order"))
    for name, rows in (("profiles", profile), ("gains", lists("gain")), ("losses", lists("loss"))):
        out = out.join(as_json_map(rows, "node_id", "tokens", "group_id").withColumnRenamed("json", name), "group_id", "left")
    if duplicates is not None:
        named = duplicates.groupBy("group_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("kind", "token"))).alias("events"))
        out = out.join(as_json_map(named, "node_id", "events", "group_id").withColumnRenamed("json", "duplicates"), "group_id", "left")
    return out if trees is None else out.join(newick(trees).withColumnRenamed("newick", "tree"), "group_id", "left")


def summary_lines(protocol: DataFrame, level: float = SIGNIFICANCE) -> DataFrame:
    """group_id, line: a sentence on each group with its test, also the statistic and the level, and what was found."""
    text = F.format_string("%s: %s preferred (statistic %.4f, level %.2f), loss rate %.4f, block length %.4f", F.col("group_id").cast("string"), "model", "lrt", F.lit(float(level)), F.when(F.col("model") == "BDM", F.col("rho_bdm")).otherwise(F.col("rho_idm")), "alpha")
    return protocol.select("group_id", text.alias("line"))
