"""Filters on arrays, groups and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.scalar import EVIDENCE, nearest_distance

NEAR = 10_000


def by_evidence(rows: DataFrame, least: int = EVIDENCE, exact: bool = False) -> DataFrame:
    level = F.col("evidence_level")
    return rows.where(level == least if exact else level >= least)


def with_gene_distance(rows: DataFrame) -> DataFrame:
    """Adds distance from array_start and array_end to the nearest of genes; null where anything is missing."""
    known = F.col("array_start").isNotNull() & F.col("array_end").isNotNull() & (F.size("genes") > 0)
    return rows.withColumn("distance", F.when(known, nearest_distance(F.col("array_start"), F.col("array_end"), F.col("genes"))))


def near_genes_or_typed(rows: DataFrame, most: int = NEAR) -> DataFrame:
    """Arrays near a gene, or with a known type. A distance of 0 doesn't count as near, as where none is known."""
    near = F.coalesce((F.col("distance") <= most) & (F.col("distance") != 0), F.lit(False))
    return rows.where(near | (F.size(F.filter("types", lambda t: t.isNotNull())) > 0))


def without_arrays(arrays: DataFrame, names: DataFrame) -> DataFrame:
    return arrays.join(names.select("array_id").distinct(), "array_id", "left_anti").select(*arrays.columns)


def only_arrays(arrays: DataFrame, names: DataFrame) -> DataFrame:
    return arrays.join(names.select("array_id").distinct(), "array_id", "left_semi").select(*arrays.columns)


def with_losses(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Groups with a block of losses; the others are trivial."""
    return groups.join(blocks.select("group_id").distinct(), "group_id", "left_semi")


def common_categories(rows: DataFrame, value: str, least: int) -> DataFrame:
    """Rows whose value occurs often enough."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(value)
    return rows.join(counts, value, "left_semi").select(*rows.columns)


def without_value(rows: DataFrame, column: str, value: int = 3) -> DataFrame:
    """Rows whose array has no such element."""
    return rows.where(~F.array_contains(column, value))


def old_tokens(events: DataFrame, tree: DataFrame) -> DataFrame:
    """group_id, token: what the root has."""
    root = tree.where(F.col("parent_id").isNull()).select("node_id")
    return events.where(F.col("kind") == "gain").join(root, "node_id", "left_semi").select("group_id", "token").distinct()


def old_tokens_by_group(events: DataFrame, trees: DataFrame) -> DataFrame:
    """The same where every group has its tree."""
    root = trees.where(F.col("parent_id").isNull()).select("group_id", "node_id")
    return events.where(F.col("kind") == "gain").join(root, ["group_id", "node_id"], "left_semi").select("group_id", "token").distinct()


def blocks_with(block_tokens: DataFrame, tokens: DataFrame, all_of_them: bool = False) -> DataFrame:
    """Blocks that contain one of the tokens, or consist of them only; rows of their tokens."""
    own = ["group_id", "node_id", "block"]
    if all_of_them:
        strangers = block_tokens.join(tokens, ["group_id", "token"], "left_anti").select(*own).distinct()
        return block_tokens.join(strangers, own, "left_anti").select(*block_tokens.columns)
    touched = block_tokens.join(tokens, ["group_id", "token"], "left_semi").select(*own).distinct()
    return block_tokens.join(touched, own, "left_semi").select(*block_tokens.columns)
