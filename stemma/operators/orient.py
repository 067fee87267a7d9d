"""Orientation: which reading direction explains the arrays better."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.scalar import BOUNDARY, decision, flip

LABELS = {"forward": "Forward", "reverse": "Reverse", "nd": "ND"}


def compare(forward: DataFrame, backward: DataFrame, lnl: str = "lnl_bdm", boundary: float = BOUNDARY, keep: list[str] | None = None) -> DataFrame:
    """One row for each group of forward: both likelihoods, the recommendation, the label, and the chosen run's values."""
    keep = keep or [c for c in forward.columns if c not in ("group_id", lnl)]
    f = forward.select("group_id", F.col(lnl).alias("lnl_forward"), *(F.col(c).alias(f"f_{c}") for c in keep))
    b = backward.select("group_id", F.col(lnl).alias("lnl_backward"), *(F.col(c).alias(f"b_{c}") for c in keep))
    both = f.join(b, "group_id", "left").withColumn("difference", F.col("lnl_forward") - F.col("lnl_backward"))
    both = both.withColumn("recommendation", decision(F.col("difference"), boundary))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("recommendation")]
    chosen = [F.when(F.col("recommendation") == "reverse", F.col(f"b_{c}")).otherwise(F.col(f"f_{c}")).alias(c) for c in keep]
    return both.select("group_id", "lnl_forward", "lnl_backward", "difference", "recommendation", label.alias("orientation"), *chosen)


def chosen_rows(decisions: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """All rows of each group from the run that its decision names."""
    d = decisions.select("group_id", "recommendation")
    one = forward.join(d.where(F.col("recommendation") != "reverse"), "group_id", "left_semi")
    return one.unionByName(backward.join(d.where(F.col("recommendation") == "reverse"), "group_id", "left_semi"))


def by_strand(rows: DataFrame) -> DataFrame:
    return rows.withColumn("strand", flip(F.col("strand"), F.col("recommendation")))


def fixed_repeats(groups: DataFrame, repeat: str = "repeat") -> DataFrame:
    """Groups whose repeats are reverse complements of each other under one name, the smaller one."""
    from stemma.functions.scalar import reverse_complement

    other = reverse_complement(F.col(repeat))
    return groups.withColumn("strand", F.when(F.col(repeat) <= other, "+").otherwise("-")).withColumn(repeat, F.least(F.col(repeat), other))


def merged_protocols(main: DataFrame, trivial: DataFrame) -> DataFrame:
    """Rows of both; a union by name."""
    return main.unionByName(trivial, allowMissingColumns=True)


def summary(protocol: DataFrame) -> DataFrame:
    """A row for each decision with its groups."""
    return protocol.groupBy("recommendation").agg(F.count(F.lit(1)).alias("groups"), F.avg("difference").alias("mean_difference"))
