"""Comparison of two sets of texts or rows: coverage, differences, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each distinct value with the place where it was seen first."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def missing_values(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key ``present`` lacks; nulls in ``present`` hide nothing."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


#: Needles, and their characters, of one block of ``contained_values``.
BLOCK_NEEDLES, BLOCK_CHARS = 50_000, 20_000_000


def contained_values(needles: DataFrame, hay: DataFrame, key: str) -> DataFrame:
    """(key): the values of ``needles`` that are part of some value of ``hay``, whose column has the same name.

    Needles are the smaller, stated side: they go to the tasks in blocks of a bounded size, one scan of ``hay`` for each.
    An automaton finds all needles of a block in one pass over a value; a task reports each needle that it met once.
    """

    def blocks():
        held, size = [], 0
        for row in needles.select(key).where(F.col(key).isNotNull()).distinct().toLocalIterator():
            if held and (len(held) >= BLOCK_NEEDLES or size + len(row[0]) > BLOCK_CHARS):
                yield held
                held, size = [], 0
            held.append(row[0])
            size += len(row[0])
        if held:
            yield held

    out = None
    for held in blocks():

        def run(batches, held=held):
            import ahocorasick
            import pyarrow as pa

            machine, met = ahocorasick.Automaton(), set()
            for k, needle in enumerate(held):
                if needle:
                    machine.add_word(needle, k)
                else:
                    met.add(k)
            machine.make_automaton()
            for batch in batches:
                if len(machine):
                    for text in batch.column(0).to_pylist():
                        met.update(k for _, k in machine.iter(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([held[k] for k in sorted(met)], pa.string())], [key])

        part = hay.select(key).mapInArrow(run, f"`{key}` string")
        out = part if out is None else out.unionByName(part)
    return needles.select(key).limit(0) if out is None else out.distinct()


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side holds."""
    a, b = (d.select(key).distinct() for d in (left, right))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def ratio_or_one(part: Column, whole: Column) -> Column:
    """part / whole, and 1 where there is nothing to count."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(1.0))


def group_pairs(df: DataFrame, group: str, item: str, *values: str) -> DataFrame:
    """Ordered pairs of items of one group (a group is small by construction: languages, states, variants)."""
    left = df.select(group, F.col(item).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    right = df.select(group, F.col(item).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, group).where("a < b")
