"""The data behind drawings: order graphs, leaf rows, pooled event labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tree import ancestors, keys_of, leaf_counts

COLOURS = 12


def order_graph(edges: DataFrame, rank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with a colour number, edges)."""
    return rank.withColumn("colour", (F.col("rank") - 1) % COLOURS), edges


def leaf_rows(states: DataFrame, tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """group_id, node_id, token, glyph: the token if present, X if an ancestor had it, - otherwise."""
    keys = keys_of(tree)
    above = ancestors(tree).where(F.col("steps") > 0).join(leaves.select(*keys, "node_id"), [*keys, "node_id"]).select(*keys, "node_id", "ancestor")
    had = states.where(F.col("state") == 1).select("group_id", F.col("node_id").alias("ancestor"), "token").join(above, [*keys, "ancestor"]).select("group_id", "node_id", "token").distinct().withColumn("had", F.lit(True))
    own = states.join(leaves.select(*keys, "node_id"), [*keys, "node_id"])
    return own.join(had, ["group_id", "node_id", "token"], "left").select("group_id", "node_id", "token", F.when(F.col("state") == 1, F.col("token").cast("string")).when(F.col("had"), "X").otherwise("-").alias("glyph"))


def event_labels(events: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, node_id, kind, label: more than three tokens are the first, a dash and the last."""
    lists = events.join(rank, ["group_id", "token"]).groupBy("group_id", "node_id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"].cast("string")).alias("t"))
    return lists.select("group_id", "node_id", "kind", F.when(F.size("t") > 3, F.concat_ws(" ", F.element_at("t", 1), F.lit("-"), F.element_at("t", -1))).otherwise(F.array_join("t", " ")).alias("label"))


def age_sorted(events: DataFrame, tree: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, token, place: the order of display, oldest first.

    Nodes go by the leaves below them, then by name; a token stands where the first of them gains it, there by rank.
    Tokens that no node gains come last, as the youngest.
    """
    keys = keys_of(tree)
    counts = leaf_counts(tree).select(*keys, "node_id", "n_leaves")
    gains = events.where(F.col("kind") == "gain").join(counts, [*keys, "node_id"])
    first = gains.groupBy("group_id", "token").agg(F.min(F.struct((-F.col("n_leaves")).alias("n"), "node_id")).alias("at"))
    w = Window.partitionBy("group_id").orderBy(F.col("at").asc_nulls_last(), "rank", "token")
    return rank.join(first, ["group_id", "token"], "left").select("group_id", "token", F.row_number().over(w).alias("place"))


def plain_gains(events: DataFrame, contradictions: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Gains that are neither contradictions nor duplicates."""
    own = ["group_id", "node_id", "token"]
    return events.where(F.col("kind") == "gain").join(contradictions.select(*own).unionByName(duplicates.select(*own)), own, "left_anti")


def column_widths(rows: DataFrame, label: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.length(label)).alias("width"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """node_id, line: names indented by depth, in pre-order."""
    return tree.orderBy("pre_ord").select("node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("node_id")).alias("line"))
