"""Statistics and spatial operators over numeric layout columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode(df: DataFrame, group: list[str], value: str, largest: bool) -> DataFrame:
    """The most frequent value of each group; a tie goes to the largest or the smallest value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    rank = F.struct("n", F.col(value) if largest else -F.col(value))
    return counts.groupBy(*group).agg(F.max_by(value, rank).alias(value), F.max("n").alias("n"))


def gap_clusters(df: DataFrame, group: list[str], start: str, end: str, max_gap: float, out: str = "cluster", ties: list[str] = ()) -> DataFrame:
    """Number of the cluster of each interval: a new one begins where the gap to all before it is not at most ``max_gap``.

    Intervals stand by start, end and ``ties``, nulls last; one without a start, or behind intervals without an end alone, is a cluster of its own.
    """
    order = Window.partitionBy(*group).orderBy(*[F.asc_nulls_last(c) for c in (start, end, *ties)])
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) - reach <= max_gap, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_intervals(df: DataFrame, group: list[str], start: str, end: str, max_gap: float = 0.0, ties: list[str] = ()) -> DataFrame:
    """The merged intervals of each group with their number of parts."""
    clustered = gap_clusters(df, group, start, end, max_gap, "_c", ties)
    return clustered.groupBy(*group, "_c").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_c")


def leader_clusters(df: DataFrame, group: list[str], value: str, tolerance: float) -> DataFrame:
    """(group, leader, n): distinct values in order join the last cluster if they are within ``tolerance`` of its first value.

    Only the distinct values with their counts are folded, so a group's array is as long as its value range allows.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    items = counts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("n").alias("n")))).alias("items"))
    kind = "array<struct<leader:double,n:bigint>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["leader"].alias("leader"), (last["n"] + x["n"]).alias("n"))))
        return F.when((F.size(done) > 0) & (x["v"] - F.try_element_at(done, F.lit(-1))["leader"] <= tolerance), joined).otherwise(F.concat(done, F.array(F.struct(x["v"].alias("leader"), x["n"].alias("n")))).cast(kind))

    folded = items.select(*group, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("c"))
    return folded.select(*group, "c.leader", "c.n")


def support(df: DataFrame, group: list[str], value: str, tolerance: float, out: str = "support") -> DataFrame:
    """(group, value, n, out): each distinct value with its rows and the rows of the group within ``tolerance`` of it.

    Rows are counted by value first, so the range frame runs over distinct values.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    frame = Window.partitionBy(*group).orderBy(value).rangeBetween(-tolerance, tolerance)
    return counts.withColumn(out, F.sum("n").over(frame))


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part over the length of the second interval; 0 if that has none or they only touch."""
    common = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when((b1 <= b0) | (common <= 0), 0.0).otherwise(common / (b1 - b0))


def largest_remainder(df: DataFrame, group: list[str], items: list[str], weight: str, total: int) -> DataFrame:
    """Whole shares of ``total`` by weight: floors of at least 1, the rest to the largest fractions in item order."""
    whole = Window.partitionBy(*group)
    exact = F.col(weight) * total / F.sum(weight).over(whole)
    base = df.withColumn("_exact", exact).withColumn("_floor", F.greatest(F.floor("_exact"), F.lit(1)))
    base = base.withColumn("_left", F.lit(total) - F.sum("_floor").over(whole)).withColumn("_fraction", F.round(F.col("_exact") - F.floor("_exact"), 9))
    rank = F.row_number().over(whole.orderBy(F.desc("_fraction"), *items))
    return base.withColumn("span", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_left", "_fraction")
