"""Clusters of similar sequences and groups of overlapping arrays.

Single linkage and connected components don't depend on order; the greedy forms do, so they need a declared one, and
scan each group's items in it inside one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _held


def similar_pairs(rows: DataFrame, value: str, most: int) -> DataFrame:
    """a, b, distance for values a < b at an edit distance up to `most`.

    Values meet by pieces: cut into most + 1 parts, one part of the shorter must stand in the longer unchanged, shifted
    by `most` at most. Values too short to be cut meet by length alone.
    """
    v = rows.select(F.col(value).alias("v")).where(F.col("v").isNotNull()).distinct().withColumn("n", F.length("v"))
    if most == 0:
        return v.limit(0).select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0).alias("distance"))
    k = most + 1
    bounds = lambda i: F.floor(F.col("n") * i / k).cast("int")
    parts = F.array(*(F.struct(F.lit(i).alias("i"), bounds(i).alias("at"), F.substring("v", bounds(i) + 1, bounds(i + 1) - bounds(i)).alias("piece")) for i in range(k)))
    long_enough = F.col("n") >= k
    short = v.where(long_enough).select(F.col("v").alias("x"), F.col("n").alias("nx"), F.explode(parts).alias("p")).select("x", "nx", F.col("p.i").alias("i"), F.col("p.at").alias("at"), F.col("p.piece").alias("piece"))
    # Of the longer one: the same part for each length the shorter can have, at each shift.
    lengths = F.explode(F.sequence(F.greatest(F.lit(k), F.col("n") - most), F.col("n")))
    longer = v.select(F.col("v").alias("y"), "n", lengths.alias("nx")).select("y", "n", "nx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    at, end = F.floor(F.col("nx") * F.col("i") / k), F.floor(F.col("nx") * (F.col("i") + 1) / k)
    longer = longer.select("y", "nx", "i", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), at - most), F.least(F.col("n") - (end - at), at + most))).alias("begin"), (end - at).alias("size"))
    longer = longer.select("y", "nx", "i", F.substring("y", F.col("begin").cast("int") + 1, F.col("size").cast("int")).alias("piece")).distinct()
    met = short.join(longer, ["nx", "i", "piece"]).select("x", "y")
    tiny = v.where(~long_enough)
    near = tiny.select(F.col("v").alias("x"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") + most)).alias("n"))
    met = met.unionByName(near.join(v.select(F.col("v").alias("y"), "n"), "n").select("x", "y"))
    pairs = met.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where(F.col("distance") >= 0)


def connected(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component: the smallest node reachable; edges: keys, a, b; nodes: keys, node."""
    both = _held(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _held(nodes.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        owner = labels.select(*keys, F.col("node").alias("low"), F.col("component").alias("owned"))
        moved = _held(low.join(owner, [*keys, "low"], "left").select(*keys, "node", "was", F.least("low", "owned").alias("component")))
        labels = moved.select(*keys, "node", "component")
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            return labels


def single_linkage(rows: DataFrame, value: str, most: int) -> DataFrame:
    """value, representative: transitive clusters, named by their smallest member."""
    nodes = rows.select(F.col(value).alias("node")).distinct()
    return connected(similar_pairs(rows, value, most), nodes, []).select(F.col("node").alias(value), F.col("component").alias("representative"))


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def greedy_leader(rows: DataFrame, value: str, most: int, by: str = "repeat", order: str = "ord") -> DataFrame:
    """by, value, representative: scanned in order, a value joins the first cluster with a member within `most`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[str]] = []
        for x in frame.sort_values([order, value])[value].drop_duplicates():
            for members in clusters:
                if any(edit_distance(x, y, most) <= most for y in members):
                    members.append(x)
                    break
            else:
                clusters.append([x])
        return pd.DataFrame([(frame[by].iloc[0], x, c[0]) for c in clusters for x in c], columns=[by, value, "representative"])

    return rows.select(by, value, order).groupBy(by).applyInPandas(run, f"{by} string, {value} string, representative string")


def overlap_components(arrays: DataFrame) -> DataFrame:
    """group_id, array_id, component: arrays linked by shared tokens, through stars around each token's first array."""
    first = arrays.groupBy("group_id", "token").agg(F.min("array_id").alias("a"))
    edges = arrays.join(first, ["group_id", "token"]).select("group_id", "a", F.col("array_id").alias("b")).distinct()
    return connected(edges, arrays.select("group_id", F.col("array_id").alias("node")), ["group_id"]).select("group_id", F.col("node").alias("array_id"), "component")


def greedy_overlap(arrays: DataFrame) -> DataFrame:
    """group_id, array_id, cluster: in the order of array_id, an array joins the first cluster that shares a token."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[set, list]] = []
        for a, part in frame.groupby("array_id", sort=True):
            tokens = set(part["token"])
            for held, members in clusters:
                if held & tokens:
                    held |= tokens
                    members.append(a)
                    break
            else:
                clusters.append((tokens, [a]))
        return pd.DataFrame([(frame["group_id"].iloc[0], a, f"g_{k}") for k, (_, members) in enumerate(clusters) for a in members], columns=["group_id", "array_id", "cluster"])

    kinds = {f.name: f.dataType.simpleString() for f in arrays.schema.fields}
    return arrays.select("group_id", "array_id", "token").groupBy("group_id").applyInPandas(run, f"group_id {kinds['group_id']}, array_id {kinds['array_id']}, cluster string")


def by_repeat(arrays: DataFrame) -> DataFrame:
    """Arrays (repeat, direction, tokens as sequences) under one reading: on the minus strand all is turned around."""
    from stemma.functions.scalar import reverse_complement

    minus = F.col("direction") == "-"
    return arrays.withColumn("tokens", F.when(minus, F.reverse(F.transform("tokens", reverse_complement))).otherwise(F.col("tokens"))).withColumn("repeat", F.when(minus, reverse_complement(F.col("repeat"))).otherwise(F.col("repeat")))
