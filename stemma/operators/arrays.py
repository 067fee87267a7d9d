"""Operators on arrays in long form: group_id, array_id, pos, token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.tables import held as _held
from stemma.tables import numbered_rows

ARRAY = ["group_id", "array_id"]


def packed(arrays: DataFrame) -> DataFrame:
    """group_id, array_id, tokens: one row for each array."""
    return arrays.groupBy(*ARRAY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(*ARRAY, F.posexplode("tokens").alias("pos", "token"))


def edges(arrays: DataFrame) -> DataFrame:
    """Order graph: group_id, src (younger), dst (older) for neighbouring tokens."""
    follows = F.lead("token").over(Window.partitionBy(*ARRAY).orderBy("pos"))
    return arrays.select("group_id", F.col("token").alias("src"), follows.alias("dst")).where(F.col("dst").isNotNull()).distinct()


class CycleError(ValueError):
    """A token precedes itself."""


def closure(graph: DataFrame, check_cycles: bool = True, src: str = "src", dst: str = "dst") -> DataFrame:
    """group_id, younger, older: transitive closure by squaring, log2(longest path) rounds."""
    held, n = _held(graph.select("group_id", F.col(src).alias("younger"), F.col(dst).alias("older")).distinct()), -1
    while True:
        now = held.count()
        if now == n:
            break
        n = now
        left, right = held.alias("l"), held.alias("r")
        longer = left.join(right, (F.col("l.group_id") == F.col("r.group_id")) & (F.col("l.older") == F.col("r.younger"))).select("l.group_id", "l.younger", "r.older")
        held = _held(held.unionByName(longer).distinct())
    if check_cycles and not held.where(F.col("younger") == F.col("older")).isEmpty():
        raise CycleError("the arrays' order contains a cycle")
    return held


def topological_rank(arrays: DataFrame, order: DataFrame) -> DataFrame:
    """group_id, token, rank: a linear extension of the order, oldest first; ties go by token."""
    known = arrays.select("group_id", "token").distinct()
    below = order.groupBy("group_id", F.col("younger").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    ranked = known.join(below, ["group_id", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.select("group_id", "token", F.row_number().over(Window.partitionBy("group_id").orderBy("n", "token")).alias("rank"))


def presence(arrays: DataFrame, order: DataFrame) -> DataFrame:
    """group_id, array_id, token, present: 0 or 1 for every array and token of its group."""
    every = arrays.select(*ARRAY).distinct().join(order.select("group_id", "token").distinct(), "group_id")
    return every.join(arrays.select(*ARRAY, "token").distinct().withColumn("present", F.lit(1)), [*ARRAY, "token"], "left").withColumn("present", F.coalesce("present", F.lit(0)))


def align_on_order(arrays: DataFrame, rank: DataFrame) -> DataFrame:
    """group_id, array_id, col, token: columns follow the order, youngest first; a gap is a missing row."""
    n = rank.groupBy("group_id").agg(F.max("rank").alias("width"))
    columns = rank.join(n, "group_id").select("group_id", "token", (F.col("width") - F.col("rank")).alias("col"))
    return arrays.join(columns, ["group_id", "token"]).select(*ARRAY, "col", "token")


def dedup(arrays: DataFrame) -> DataFrame:
    """group_id, representative, members, n: equal arrays, the first by array_id stands for the others."""
    return packed(arrays).groupBy("group_id", "tokens").agg(F.min("array_id").alias("representative"), F.sort_array(F.collect_list("array_id")).alias("members"), F.count(F.lit(1)).alias("n")).select("group_id", "representative", "members", "n", "tokens")


def unique_in_order(arrays: DataFrame) -> DataFrame:
    """Each token's first place in its array only, places closed up."""
    first = arrays.withColumn("k", F.row_number().over(Window.partitionBy(*ARRAY, "token").orderBy("pos"))).where(F.col("k") == 1)
    return first.select(*ARRAY, (F.row_number().over(Window.partitionBy(*ARRAY).orderBy("pos")) - 1).alias("pos"), "token")


def first_seen_ids(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """value, id: numbers from 1 by first occurrence, over all groups."""
    first = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("at"))
    return numbered_rows(first, "id", "at", value).select(value, (F.col("id") + 1).alias("id"))


def relabelled(rows: DataFrame, ids: DataFrame, value: str = "token") -> DataFrame:
    """rows with the numbers of `first_seen_ids` instead of their values."""
    return rows.join(ids, value).withColumn(value, F.col("id")).select(*rows.columns)


def names_back(rows: DataFrame, ids: DataFrame, value: str = "token", gap: str = "-") -> DataFrame:
    """The inverse: values as text; a number without one is a gap."""
    back = ids.select(F.col("id").alias("__id"), F.col(value).cast("string").alias("__name"))
    return rows.join(back, F.col(value) == F.col("__id"), "left").withColumn(value, F.coalesce("__name", F.lit(gap))).select(*rows.columns)


def numbered(arrays: DataFrame, rank: DataFrame) -> DataFrame:
    """Tokens renamed to L ... 1 from the youngest to the oldest."""
    return arrays.join(rank.select("group_id", "token", F.col("rank").alias("number")), ["group_id", "token"]).select(*ARRAY, "pos", "token", "number")


def duplicate_names(arrays: DataFrame) -> DataFrame:
    """Copies of a token inside an array get suffixes A, B, ..., AA; single tokens keep their names."""
    from stemma.functions.scalar import duplicate_suffix

    w = Window.partitionBy(*ARRAY, "token")
    k, n = F.row_number().over(w.orderBy("pos")) - 1, F.count(F.lit(1)).over(w)
    return arrays.withColumn("k", k).withColumn("n", n).select(*ARRAY, "pos", "token", F.when(F.col("n") > 1, F.concat(F.col("token").cast("string"), duplicate_suffix(F.col("k")))).otherwise(F.col("token").cast("string")).alias("name"))


def duplicate_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and n of what occurs more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def reversed_arrays(arrays: DataFrame) -> DataFrame:
    n = F.max("pos").over(Window.partitionBy(*ARRAY))
    return arrays.withColumn("last", n).select(*ARRAY, (F.col("last") - F.col("pos")).alias("pos"), "token")


def never_seen(known: DataFrame, arrays: DataFrame) -> DataFrame:
    """Tokens of known (group_id, token) that no array has."""
    return known.select("group_id", "token").distinct().join(arrays.select("group_id", "token").distinct(), ["group_id", "token"], "left_anti")


def observed_only(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """The rows whose token some leaf has."""
    return rows.join(leaves.select("group_id", "token").distinct(), ["group_id", "token"], "left_semi")


def group_selection(arrays: DataFrame, criteria: list[tuple[str, object]], types: DataFrame | None = None) -> DataFrame:
    """group_id, n_arrays, n_unique, skip_reason: the first criterion that a group fails, null if none."""
    per_array = packed(arrays)
    facts = per_array.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_arrays"), F.countDistinct("tokens").alias("n_unique"), F.max(F.size("tokens")).alias("longest"))
    if types is not None:
        facts = facts.join(types.select("group_id", "crispr_type"), "group_id", "left")
    fails = {
        "maximum_unique_array_number": lambda p: F.col("n_unique") > p, "maximum_array_number": lambda p: F.col("n_arrays") > p, "minimum_array_number": lambda p: F.col("n_arrays") < p,
        "empty_arrays": lambda p: F.col("longest") == 0, "crispr_type": lambda p: ~F.lower("crispr_type").isin(*p), "selection of groups": lambda p: ~F.col("group_id").isin(*p), "selection not in groups": lambda p: F.col("group_id").isin(*p),
    }
    reason: Column = F.lit(None).cast("string")
    for name, parameter in reversed([c for c in criteria if c[0] is not None]):
        if name not in fails:
            raise ValueError(f"unknown criterion {name}")
        reason = F.when(fails[name](parameter), name).otherwise(reason)
    return facts.select("group_id", "n_arrays", "n_unique", reason.alias("skip_reason"))


def majority_type(rows: DataFrame) -> DataFrame:
    """group_id, type, n_types: the commonest type, the first by `ord` among equals; rows: group_id, ord, type."""
    counts = rows.groupBy("group_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("group_id").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("type"), F.count("type").alias("n_types"))


def location_label(rows: DataFrame) -> DataFrame:
    """group_id, label from the texts of `location`: c, p, c + p or not available."""
    low = F.lower("location")
    c, p = F.count_if(low.contains("chromosome")), F.count_if(low.contains("plasmid") & ~low.contains("chromosome"))
    return rows.groupBy("group_id").agg(F.when((c > 0) & (p > 0), "c + p").when(c > 0, "c").when(p > 0, "p").otherwise("not available").alias("label"))


def joined_values(rows: DataFrame, value: str, separator: str = " + ") -> DataFrame:
    """group_id and all distinct values in order, joined."""
    return rows.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def pair_counts(alignment: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair (a, b) of arrays of a group: column of the first equal token, gains, kept tokens, deletion runs.

    Left of that column every token is a gain. From it on, a token that only the other array has belongs to a run of
    deletions, which a token of the array itself ends; columns that neither has are passed over.
    """
    x = alignment.select("group_id", F.col("array_id").alias("a"), "col", F.col("token").alias("ta"))
    y = alignment.select("group_id", F.col("array_id").alias("b"), "col", F.col("token").alias("tb"))
    left = pairs.join(x, ["group_id", "a"])
    right = pairs.join(y, ["group_id", "b"])
    both = left.join(right, ["group_id", "a", "b", "col"], "full_outer")
    w = Window.partitionBy("group_id", "a", "b")
    both = both.withColumn("fes", F.min(F.when(F.col("ta") == F.col("tb"), F.col("col"))).over(w))
    older = F.coalesce(F.col("col") >= F.col("fes"), F.lit(False))
    both = both.withColumn("older", older)
    so_far = w.orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("ra", F.count("ta").over(so_far)).withColumn("rb", F.count("tb").over(so_far))
    counts = both.groupBy("group_id", "a", "b").agg(
        F.first("fes").alias("fes"), F.count_if(~F.col("older") & F.col("ta").isNotNull()).alias("gains_a"), F.count_if(~F.col("older") & F.col("tb").isNotNull()).alias("gains_b"),
        F.count_if(F.col("older") & F.col("ta").isNotNull()).alias("keeps_a"), F.count_if(F.col("older") & F.col("tb").isNotNull()).alias("keeps_b"),
    )

    def runs(token: str, run: str, name: str) -> DataFrame:
        each = both.where(F.col("older") & F.col(token).isNull()).groupBy("group_id", "a", "b", run).agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("group_id", "a", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct(run, "n"))), lambda s: s["n"]).alias(name))

    none = F.array().cast("array<bigint>")
    out = counts.join(runs("ta", "ra", "runs_a"), ["group_id", "a", "b"], "left").join(runs("tb", "rb", "runs_b"), ["group_id", "a", "b"], "left")
    return out.withColumn("runs_a", F.coalesce("runs_a", none)).withColumn("runs_b", F.coalesce("runs_b", none))


def leaf_action(n: Column, kinds: Column) -> Column:
    """What becomes of a leaf with n arrays of so many kinds: keep, split into several, prune; missing without any."""
    return F.when(n.isNull(), "missing").when(n == 1, "keep").when(kinds == 1, "split").otherwise("prune")


def combine_duplicate_leaves(leaves: DataFrame, arrays: DataFrame) -> DataFrame:
    """node_id, action: how a leaf meets its arrays by accession: keep, split into several, prune or missing."""
    held = packed(arrays).select("group_id", F.col("array_id").alias("node_id"), "tokens")
    facts = held.groupBy("group_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tokens").alias("kinds"))
    return leaves.join(facts, ["group_id", "node_id"], "left").select("group_id", "node_id", F.coalesce("n", F.lit(0)).alias("n"), leaf_action(F.col("n"), F.col("kinds")).alias("action"))
