"""The analysis layer: histograms, shares, quantiles, sweeps, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.scalar import digitize
from stemma.tables import numbered_rows


def histogram(rows: DataFrame, value: str, width: float, *keys: str) -> DataFrame:
    """keys, bin (its lower end), n, share of the keys' rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)]))))


def value_shares(rows: DataFrame, by: str, value: str) -> DataFrame:
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def category_counts(rows: DataFrame, value: str) -> DataFrame:
    """value, n, place: the commonest first."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return numbered_rows(counts, "place", F.desc("n"), value).withColumn("place", F.col("place") + 1)


def two_way_counts(rows: DataFrame, x: str, hue: str, values: list | None = None) -> DataFrame:
    """A row for each x, a column for each value of hue."""
    return rows.groupBy(x).pivot(hue, values).agg(F.count(F.lit(1))).na.fill(0)


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.75)).alias("q3"), F.max(value).alias("high"))


def below_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The rows whose value is below the quantile q of all."""
    return rows.crossJoin(F.broadcast(rows.agg(F.percentile(value, F.lit(q)).alias("__cut")))).where(F.col(value) < F.col("__cut")).drop("__cut")


def threshold_sweep(rows: DataFrame, difference: str, thresholds: DataFrame) -> DataFrame:
    """threshold, decided (share of rows beyond it either way), precision (share of the decided that are positive)."""
    each = rows.crossJoin(F.broadcast(thresholds))
    d, t = F.col(difference), F.col("threshold")
    decided, right = F.count_if(F.abs(d) > t), F.count_if(d > t)
    return each.groupBy("threshold").agg((decided / F.count(F.lit(1))).alias("decided"), F.when(decided > 0, right / decided).alias("precision"))


def binned_loss_frequency(losses: DataFrame, parents: DataFrame, bounds: list[float]) -> DataFrame:
    """bin, lost, places, frequency: losses in a bin of positions over all places of parents in that bin.

    losses has `position`; parents `n`, the tokens of each branch's parent.
    """
    lost = losses.groupBy(digitize(F.col("position"), bounds).alias("bin")).agg(F.count(F.lit(1)).alias("lost"))
    at = F.when(F.col("n") == 1, 1.0).otherwise(F.col("k") / (F.col("n") - 1))
    places = parents.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    places = places.groupBy(digitize(at, bounds).alias("bin")).agg(F.sum("c").alias("places"))
    return places.join(lost, "bin", "left").select("bin", F.coalesce("lost", F.lit(0)).alias("lost"), "places", (F.coalesce("lost", F.lit(0)) / F.col("places")).alias("frequency"))


def length_bucket(length: Column, bounds: list[float]) -> Column:
    """(low, high] ranges as labels; null outside."""
    out = None
    for low, high in zip(bounds, bounds[1:], strict=False):
        case, label = (length > low) & (length <= high), f"({low:g}, {high:g}]"
        out = F.when(case, label) if out is None else out.when(case, label)
    return out


def explicit_order(value: Column, labels: list[str]) -> Column:
    """Place of a value in a list of labels; behind them all if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, labels)), value)
    return F.when(place > 0, place).otherwise(len(labels) + 1)


def delta_columns(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """New columns: estimate minus truth."""
    return rows.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


def renamed(rows: DataFrame, names: dict[str, str], back: bool = False) -> DataFrame:
    return rows.withColumnsRenamed({v: k for k, v in names.items()} if back else names)
