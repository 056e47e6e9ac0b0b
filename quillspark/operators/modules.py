"""Ordered analysis modules over a node table: each claims some of the nodes that no module before it claimed.

A module is a condition on a node's own columns, a function of all free nodes, or windows over the nodes. Conditions that follow each
other become one expression without a join; a function's claims come back by one join on the node's key; windows need neither a join
nor a second reading of the nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowModule:
    """Claims the free nodes for which ``kind`` is not null."""

    name: str
    kind: Column


@dataclass(frozen=True)
class SetModule:
    """Claims the nodes that ``claims`` returns of all free nodes: the key columns and ``kind``; of two kinds of a key the lesser counts."""

    name: str
    claims: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MarkModule:
    """Claims the free nodes that ``marks`` gives a kind: it adds ``_claim`` to nodes that say by ``_free`` whether they are free, and keeps them all."""

    name: str
    marks: Callable[[DataFrame], DataFrame]


def run_modules(nodes: DataFrame, modules: Iterable[RowModule | SetModule | MarkModule], keys: list[str], cut_after: int = 2, unique: bool = False) -> DataFrame:
    """``nodes`` with ``module`` and ``kind`` of the first module that claims each, null where none does.

    A set module's plan holds that of all before it twice, so after every ``cut_after`` of them the nodes are written to the checkpoint folder.
    Rows that share a key are claimed together; where none do (``unique``), marks need not be compared by key.
    """
    sets = 0
    done = nodes.withColumns({"module": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")})
    for m in modules:
        if isinstance(m, RowModule):
            kind = m.kind
        elif isinstance(m, MarkModule):
            done = m.marks(done.withColumn("_free", F.col("module").isNull()))
            if not unique:
                done = done.withColumn("_claim", F.min(F.when(F.col("_free"), F.col("_claim"))).over(Window.partitionBy(*keys)))
            kind = F.col("_claim")
        else:
            # one claim for each key, whatever a module returns; a null is a key like others, so repeated rows are claimed together
            claims = m.claims(done.where("module IS NULL").drop("module", "kind")).groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("kind").alias("_claim"))
            same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
            sets += 1
            done, kind = done.join(claims, same, "left").drop(*[f"_of_{k}" for k in keys]), F.col("_claim")
        hit = F.col("module").isNull() & kind.isNotNull()
        done = done.withColumns({"module": F.when(hit, m.name).otherwise(F.col("module")), "kind": F.when(hit, kind).otherwise(F.col("kind"))}).drop("_claim", "_free")
        if isinstance(m, SetModule) and sets % cut_after == 0:
            done = done.checkpoint()
    return done


def repeated_nodes(group: str, item: str, text: str, keys: list[str], share: float = 0.05, least: int = 2) -> Callable[[DataFrame], DataFrame]:
    """Claims of texts that stand in at least a ``share`` of a group's items, and in ``least``: headers and footers of its pages.

    Texts are counted by hash with partial sums, so a group of any size is no task of its own; only hashes are joined.
    """

    def claims(free: DataFrame) -> DataFrame:
        hashed = free.select(group, item, *[k for k in keys if k not in (group, item)], F.md5(text).alias("_h"))
        items = hashed.select(group, item).distinct().groupBy(group).agg(F.count("*").alias("_all"))
        often = hashed.select(group, item, "_h").distinct().groupBy(F.col(group).alias("_group"), "_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        often = often.join(items, F.col("_group").eqNullSafe(F.col(group))).where(F.col("_n") >= F.col("_all") * share).select("_group", F.col("_h").alias("_of"))
        return hashed.join(often, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_h") == F.col("_of")), "left_semi").select(*keys, F.lit("repeated").alias("kind"))

    return claims
