"""Ordered-sequence operators: folds, islands and alignment kernels.

The kernels at the end are plain functions over Python lists; plans run them with ``applyInPandas`` or ``mapInPandas``
per pair, and every pair is independent of all others.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: list[str], order: list[str], value: Column, out: str = "island") -> DataFrame:
    """Number of the run of equal consecutive values that each row is in."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.lag(value).over(w)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(before.eqNullSafe(value), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(out, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in its group by ``order``.

    Rows are dealt by ranges of (group, order) and written once, so that a group of any size spans many partitions; each
    partition numbers its own rows, and the rows of a group in the partitions before it are added. ``order`` must tell
    the rows of a group apart.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    keys = [*group, "_part"]
    starts = starts.toDF(*[f"_of_{c}" for c in keys], "_start")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])  # a null group is a group
    placed = ranged.withColumn("_own", own).join(starts, same)
    return placed.withColumn(out, (F.col("_own") + F.col("_start")).cast("long")).drop("_own", "_start", "_part", *[f"_of_{c}" for c in keys])


def ema(values: Column, start: float = 1.0, keep: float = 0.7, low: float = 1.0, high: float = 8.0) -> Column:
    """Running calibration over an ordered array: clamped exponential mean, kept in whole thousandths."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    step = lambda s, x: F.floor(F.round(clamp(s * keep + clamp(x) * (1 - keep)) * 1000, 6)) / 1000
    return F.aggregate(values, F.lit(start), step)


def levels(sizes: Column) -> Column:
    """Heading levels of an ordered array: a size not seen before goes one below the last level, at most; first seen is 1.

    Returns an array of (size, level) in order. A known size keeps its level.
    """
    kind = "struct<seen:map<int,int>,last:int,out:array<struct<size:int,level:int>>>"
    empty = F.struct(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("seen"), F.lit(0).alias("last"), F.array().cast("array<struct<size:int,level:int>>").alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        level = F.coalesce(F.least(F.try_element_at(s["seen"], x), s["last"] + 1), s["last"] + 1)
        seen = F.when(F.map_contains_key(s["seen"], x), s["seen"]).otherwise(F.map_concat(s["seen"], F.create_map(x, level)))
        return F.struct(seen.alias("seen"), level.alias("last"), F.concat(s["out"], F.array(F.struct(x.alias("size"), level.alias("level")))).alias("out")).cast(kind)

    return F.aggregate(sizes, empty, step, lambda s: s["out"])


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence, by bit vectors (one step per element of ``b``)."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def lcs_weighted(a: list, b: list, score, key=None) -> float:
    """Greatest total score of an order-preserving matching; pairs count only with a positive score.

    Items score nothing with items of another ``key``, where one is given. Each two distinct items are scored once, and a row of the
    table is a few array steps over the places that score; items that score nowhere leave it as it is.
    """
    import numpy as np

    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(key(y) if key else None, {}).setdefault(y, []).append(j)
    gains: dict = {}
    row = np.zeros(len(b) + 1)
    for x in a:
        if x not in gains:
            scored = [(j, s) for y, js in places.get(key(x) if key else None, {}).items() if (s := score(x, y)) > 0 for j in js]
            gains[x] = scored and (np.array([j for j, _ in scored]), np.array([s for _, s in scored], dtype=float))
        if gains[x]:
            at, s = gains[x]
            best = row.copy()
            best[at + 1] = np.maximum(best[at + 1], row[at] + s)
            row = np.maximum.accumulate(best)
    return float(row[-1])


def lis_length(values: list) -> int:
    """Length of a longest strictly increasing subsequence, by patience sorting."""
    from bisect import bisect_left

    tails: list = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of one longest common subsequence: the first that a walk from the front finds.

    A row for each suffix of ``a`` is one number with a bit for each item of ``b`` from its end; its zeros among the lowest
    bits count the common subsequence of both suffixes, so the rows of two lists of 20,000 items take 50 MB.
    """
    at: dict = {}
    for k, y in enumerate(reversed(b)):
        at[y] = at.get(y, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows = [full]
    for x in reversed(a):
        hit = rows[-1] & at.get(x, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    rows.reverse()
    common = lambda i, j: len(b) - j - (rows[i] & (1 << len(b) - j) - 1).bit_count()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif common(i + 1, j) == common(i, j):  # this item of a is not needed
            i += 1
        else:
            j += 1
    return out


def increasing(values: list) -> list[int]:
    """Places of one longest strictly increasing subsequence, by patience sorting with links back."""
    from bisect import bisect_left

    tails: list = []
    last: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
        last[at : at + 1] = [k]
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def anchored_alignment(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """(segments, matched places): items that stand once in each list and keep their order are anchors; what lies between
    two of them is aligned on its own, so long lists cost the squares of their segments only."""
    from collections import Counter

    once_a, once_b = Counter(a), {x: k for k, x in enumerate(b)}
    many_b = Counter(b)
    shared = [(i, once_b[x]) for i, x in enumerate(a) if once_a[x] == 1 and many_b.get(x) == 1]
    anchors = [shared[k] for k in increasing([j for _, j in shared])]
    matched, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        matched += [(i + p, j + q) for p, q in lcs_pairs(a[i:x], b[j:y])]
        if x < len(a):
            matched.append((x, y))
        i, j = x + 1, y + 1
    return len(anchors) + 1, matched


def similarity(a: list, b: list) -> float:
    """Common subsequence over the mean length; 1 for two empty lists, 0 for one."""
    if not a and not b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def common_runs(lists: list[list], least: int = 3) -> list[list]:
    """Runs of the first list, ``least`` long or more, that all other lists hold in the same order.

    Items that each alignment with the first list matches are kept; a run goes on while the place in every list does.
    """
    first, *others = lists
    places: list[dict] = []
    shared = list(range(len(first)))
    for other in others:
        at = dict(lcs_pairs(first, other))
        shared = [i for i in shared if i in at]
        if not shared:
            return []
        places.append({i: at[i] for i in shared})
    moves = groupby(enumerate(shared), key=lambda e: (e[1] - e[0], *[p[e[1]] - e[1] for p in places]))
    runs = [[first[i] for _, i in run] for _, run in moves]
    return [r for r in runs if len(r) >= least]


def set_cover(target: frozenset, sets: dict) -> list | None:
    """Fewest disjoint sets that make up ``target``, by a depth-first search over bit masks; None if there are none."""
    order = sorted(target)
    bit = {x: 1 << k for k, x in enumerate(order)}
    masks = sorted(((sum(bit[x] for x in s), name) for name, s in sets.items() if s and s <= target), key=lambda m: (-m[0].bit_count(), m[1]))
    full, best = (1 << len(order)) - 1, None

    def search(covered: int, chosen: list):
        nonlocal best
        if covered == full:
            best = list(chosen)
            return
        if best is not None and len(chosen) + 1 >= len(best):
            return
        lowest = ~covered & (covered + 1)
        for mask, name in masks:
            if mask & lowest and not mask & covered:
                search(covered | mask, [*chosen, name])

    search(0, [])
    return best
