"""Values carried along ordered groups of any size, and joins to the last row before another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null among the rows of the group up to each row, by ``order``.

    Rows are dealt by ranges of (group, order) and written once, so a group may span any number of tasks. Each partition
    carries within itself; only the first group of a partition can have begun before, so one value for each partition is
    all that is handed on, and that is what is broadcast. Null keys are a group; rows that ``order`` does not tell apart may
    see each other or not.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy(*group, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"), F.count("*").alias("_n"))
    # groups that are in several partitions: at most two for each partition
    spans = ends.groupBy(*group).agg(F.count("*").alias("_parts"), F.collect_list(F.struct("_part", "_end")).alias("_ends")).where("_parts > 1")
    spans = spans.select(*group, F.explode("_ends").alias("_e")).select(*group, F.col("_e._part").alias("_part"), F.col("_e._end").alias("_end"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("_start", F.last("_end", True).over(before)).where("_start IS NOT NULL").drop("_end")
    names = [f"_of_{k}" for k in range(len(group) + 1)]
    starts = starts.select(*group, "_part", "_start").toDF(*names, "_start")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*group, "_part"], names)])
    carried = ranged.withColumn(out, F.last("_value", True).over(own)).join(F.broadcast(starts), same, "left")
    return carried.withColumn(out, F.coalesce(out, "_start")).drop("_value", "_part", "_start", *names)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, ties: list[str]) -> DataFrame:
    """``left`` with ``asof``: a struct of the row of ``right`` with its keys that is latest at or before its time, null if there is none.

    Of several at one time the greatest by ``ties`` (columns of ``right``) counts. Rows with a null key or time stay without
    a match; ``right`` rows with one are not looked at. A key may hold any share of the rows of either side.
    """
    key = [f"_key_{k}" for k in range(len(on))]
    usable = lambda df, time: reduce(lambda x, y: x & y, [df[c].isNotNull() for c in [*on, time]])
    rows, known = F.struct(*[left[f"`{c}`"] for c in left.columns]), F.struct(*[right[f"`{c}`"] for c in right.columns])
    a = left.select(*[F.when(usable(left, left_time), left[c]).alias(n) for c, n in zip(on, key)], F.when(usable(left, left_time), left[left_time]).alias("_at"), F.lit(1).alias("_side"), rows.alias("_row"), F.lit(None).cast(right.select(known.alias("k")).schema["k"].dataType).alias("_known"), F.lit(None).cast(right.select(F.struct(*ties).alias("t")).schema["t"].dataType).alias("_tie"))
    b = right.where(usable(right, right_time)).select(*[right[c].alias(n) for c, n in zip(on, key)], right[right_time].alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(rows.alias("r")).schema["r"].dataType).alias("_row"), known.alias("_known"), F.struct(*[right[t] for t in ties]).alias("_tie"))
    carried = carry_last(a.unionByName(b), key, ["_at", "_side", "_tie"], F.col("_known"), "asof").where("_side = 1")
    return carried.select("_row.*", F.when(reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in key]), F.col("asof")).alias("asof"))
