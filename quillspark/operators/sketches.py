"""Sketches that are stored once for the finest groups and merged for all coarser ones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Theta sketches keep 2^16 hashes: counts are exact up to that many values and then off by 1 in 256 (one standard error).
THETA_LG = 16
#: KLL sketches keep enough values that ranks are off by less than 0.1 %; up to that many values they are exact.
KLL_K = 8_000
#: Exact quantiles are sought this far in rank on either side of the sketch's, ten times what it may be off.
BRACKET = 0.01


def sketch_cells(df: DataFrame, dims: list[str], item: str, number: str) -> DataFrame:
    """(dims, n, items, numbers): for each finest group its rows, a theta sketch of ``item`` and a KLL sketch of ``number``.

    Sketches are built within tasks and merged by the shuffle, so a hot group costs no more than others. Nulls are not counted.
    """
    sketches = {"items": f"theta_sketch_agg({item}, {THETA_LG})", "numbers": f"kll_sketch_agg_double({number}, {KLL_K})"}
    return df.groupBy(*dims).agg(F.count("*").alias("n"), *[F.expr(e).alias(c) for c, e in sketches.items()])


def merged(cells: DataFrame, sets: list[list[str]], dims: list[str]) -> DataFrame:
    """The cells of each grouping set, from stored ones alone: (dims, null where not in the set, grouping, n, items, numbers).

    ``grouping`` is the number of the set. A set's rows come from merged sketches; no row of the source is read again.
    """
    out = None
    for k, kept in enumerate(sets):
        part = cells.groupBy(*kept).agg(F.sum("n").alias("n"), F.expr(f"theta_union_agg(items, {THETA_LG})").alias("items"), F.expr(f"kll_merge_agg_double(numbers, {KLL_K})").alias("numbers"))
        part = part.select(*[F.col(c) if c in kept else F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in dims], F.lit(k).alias("grouping"), "n", "items", "numbers")
        out = part if out is None else out.unionByName(part)
    return out


def estimates(cells: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Cells with ``distinct`` and a column for each quantile in place of the sketches."""
    found = [F.expr(f"kll_sketch_get_quantile_double(numbers, {q}D)").alias(name) for name, q in quantiles.items()]
    return cells.select(*[c for c in cells.columns if c not in ("items", "numbers")], F.expr("theta_sketch_estimate(items)").alias("distinct"), *found)


def of_set(df: DataFrame, kept: list[str], dims: list[str], place: int) -> DataFrame:
    """``df`` with the dims that a set does not keep null, and the set's number."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in dims if c not in kept}).withColumn("grouping", F.lit(place))


def of_sets(df: DataFrame, sets: list[list[str]], dims: list[str]) -> DataFrame:
    """The rows of ``df`` once for each set."""
    out = of_set(df, sets[0], dims, 0)
    for k, kept in enumerate(sets[1:], 1):
        out = out.unionByName(of_set(df, kept, dims, k))
    return out


def same_group(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined by ``keys``, where a null is a key like others."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    condition = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return left.join(renamed, condition, how).drop(*[f"_of_{c}" for c in keys])


def exact_rollup(df: DataFrame, sets: list[list[str]], dims: list[str], item: str, number: str, quantiles: dict[str, float]) -> DataFrame:
    """(dims, grouping, n, distinct, quantiles) of each grouping set, exact at any size.

    Merged sketches tell for each quantile between which values it lies. Values are counted once per finest group; those below the bracket are
    summed, and only those within it are put in order. A bracket that counting finds wrong is opened to all values of its group.
    """
    keys = [*dims, "grouping"]
    groups = merged(sketch_cells(df, dims, item, number), sets, dims).drop("items")
    some = F.expr("kll_sketch_get_n_double(numbers)") > 0  # sketches leave NaN out, counts do not
    get = lambda q: F.when(some, F.expr(f"kll_sketch_get_quantile_double(numbers, {min(max(q, 0.0), 1.0)}D)"))
    sought = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(Decimal(str(q))).cast("decimal(18,9)").alias("q"), get(q - BRACKET).alias("low"), get(q + BRACKET).alias("high")) for name, q in quantiles.items()])
    # sketches differ from run to run, so brackets are kept; they are a row for each group
    groups = groups.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), sought.alias("sought")).checkpoint()
    sought = groups.select(*keys, F.inline("sought"))

    counts = df.where(F.col(number).isNotNull()).groupBy(*dims, F.col(number).alias("v")).agg(F.count("*").alias("c"))
    counts = of_sets(counts, sets, dims)
    part = lambda condition: F.sum(F.when(condition, F.col("c")).otherwise(0))
    held = same_group(counts, sought, keys, "inner").groupBy(*keys, "name").agg(part(F.col("v") < F.col("low")).alias("below"), part(F.col("v") <= F.col("high")).alias("upto"), F.sum("c").alias("all"))
    sought = same_group(sought, held, [*keys, "name"], "inner").withColumn("rank", F.greatest(F.ceil(F.col("all").cast("decimal(20,0)") * F.col("q")), F.lit(1)).cast("long"))
    right = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    sought = sought.select(*keys, "name", "rank", *[F.when(right, F.col(c)).alias(c) for c in ("low", "high")], F.when(right, F.col("below")).otherwise(0).alias("below"))
    within = same_group(counts, sought, keys, "inner").where(F.col("low").isNull() | F.col("v").between(F.col("low"), F.col("high")))
    within = within.groupBy(*keys, "name", "rank", "below", "v").agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*keys, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = within.withColumn("upto", F.col("below") + F.sum("c").over(order)).where(F.col("upto") >= F.col("rank"))
    found = found.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles])

    items = df.where(F.col(item).isNotNull()).select(*dims, F.col(item).alias("_item")).distinct()
    items = of_sets(items, sets, dims).distinct().groupBy(*keys).agg(F.count("*").alias("distinct"))
    out = same_group(same_group(groups.drop("sought"), items, keys), found, keys)
    return out.select(*keys, "n", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), *quantiles)
