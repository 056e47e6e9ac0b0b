"""Modules over the boxes of a page: groups of marks, labels, tables, grids, repeated rows and columns.

Nodes have ``page``, ``node``, ``x``, ``y``, ``w``, ``h``, ``kind`` and ``_free``. A module sees the nodes that are still free and marks several at once: it
adds ``_claim``, null for all others. All are windows within a page, whose nodes must fit a task, so nodes that ``deal`` has brought together by
page move no more; nodes without a place are never claimed by geometry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.operators import layout as lo

Marks = Callable[[DataFrame], DataFrame]

#: Nodes of one page have both in common; each window starts with them, and ``deal`` goes by them.
WITHIN = ("page", "_loose")

#: Nodes of one task on average; what its sorts hold in memory goes with them.
TASK_ROWS = 500_000


def deal(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` brought together by page, over partitions that grow in number with the ``rows`` and not in size."""
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_loose(nodes).repartition(max(least, -(-rows // TASK_ROWS)), *WITHIN)


def with_loose(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``_loose``: null on a page; nodes without one, which see no others, are spread by it."""
    return nodes.withColumn("_loose", F.when(F.col("page").isNull(), F.xxhash64("node")))


def marked(marks: Marks) -> Marks:
    """``marks`` without the columns that it needs on the way."""

    def run(nodes: DataFrame) -> DataFrame:
        return marks(nodes if "_loose" in nodes.columns else with_loose(nodes)).select(*nodes.columns, "_claim")

    return run


def among(nodes: DataFrame, of: Column | None = None) -> DataFrame:
    """``nodes`` with ``_in``: free, with a place, and ``of`` holds."""
    there = F.expr("_free AND page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
    return nodes.withColumn("_in", there if of is None else F.coalesce(there & of, F.lit(False)))


def over(*keys: str) -> WindowSpec:
    """The nodes of a page that are in question, by further columns."""
    return Window.partitionBy(*WITHIN, "_in", *keys)


def claim(nodes: DataFrame, which: Column, kind: str) -> DataFrame:
    return nodes.withColumn("_claim", F.when(F.col("_in") & which, kind))


def with_clusters(nodes: DataFrame, values: dict[str, str], tolerance: float) -> DataFrame:
    """``nodes`` with the number of the cluster that each value (out: value) of its page falls into: distinct values in order join the last cluster
    if they are within ``tolerance`` of its first value. They are folded at one node of a page, which hands the first values to the others.
    """
    page = over().orderBy(*values.values(), "node")
    every = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumns({f"_{out}": F.collect_set(F.col(value).cast("double")).over(every) for out, value in values.items()} | {"_nth": F.row_number().over(page)})
    firsts = lambda those: F.aggregate(
        F.sort_array(those), F.array().cast("array<double>"), lambda done, v: F.when((F.size(done) > 0) & (v - F.try_element_at(done, F.lit(-1)) <= tolerance), done).otherwise(F.concat(done, F.array(v)))
    )
    nodes = nodes.withColumns({f"_{out}": F.when(F.col("_in") & (F.col("_nth") == 1), firsts(F.col(f"_{out}"))) for out in values})
    nodes = nodes.withColumns({f"_{out}": F.max(f"_{out}").over(over()) for out in values})
    at = lambda out, value: F.size(F.filter(f"_{out}", lambda v: v <= F.col(value)))
    return nodes.withColumns({out: at(out, value) for out, value in values.items()}).drop("_nth", *[f"_{out}" for out in values])


def column_runs(of: str, kind: str, most_gap: float, least: int = 2) -> Marks:
    """Nodes of one kind below each other: the same ``x``, gaps of at most ``most_gap``, at least ``least`` in a run."""

    def marks(nodes: DataFrame) -> DataFrame:
        nodes = among(nodes, F.col("kind") == of).withColumn("_end", F.col("y") + F.col("h"))
        runs = lo.gap_clusters(nodes, [*WITHIN, "_in", "x"], "y", "_end", most_gap, "_run")
        return claim(runs.withColumn("_n", F.count("*").over(over("x", "_run"))), F.col("_n") >= least, kind)

    return marked(marks)


def before_field(along: str, across: str, size: str, kind: str, most_gap: float) -> Marks:
    """Texts right before a field ``along`` one axis, at the same place ``across``: nothing in between, ``most_gap`` away at most."""

    def marks(nodes: DataFrame) -> DataFrame:
        w = over(across).orderBy(along, "node")
        nodes = among(nodes).withColumns({"_next": F.lead("kind").over(w), "_gap": F.lead(along).over(w) - F.col(along) - F.col(size)})
        return claim(nodes, (F.col("kind") == "text") & (F.col("_next") == "field") & F.col("_gap").between(0, most_gap), kind)

    return marked(marks)


def tables(of: Column, kind: str, tolerance: float, least_rows: int = 2, least_columns: int = 2) -> Marks:
    """Nodes at the crossings of rows and columns: each row holds nodes in several columns and each column in several rows.

    Rows and columns are clusters of coordinates; a node stays if both its row and its column are long enough.
    """

    def marks(nodes: DataFrame) -> DataFrame:
        nodes = with_clusters(among(nodes, of), {"_col": "x", "_row": "y"}, tolerance)
        nodes = nodes.withColumn("_high", F.size(F.collect_set("_row").over(over("_col"))))
        nodes = nodes.withColumn("_wide", F.size(F.collect_set("_col").over(over("_row"))))
        return claim(nodes, (F.col("_wide") >= least_columns) & (F.col("_high") >= least_rows), kind)

    return marked(marks)


def repeated_rows(kind: str, tolerance: float, least: int = 2, least_nodes: int = 2) -> Marks:
    """Rows that follow each other with the same nodes: equal kinds at equal ``x``, ``least`` or more in a run, ``least_nodes`` or more each.

    A row's structure is the hash of its sorted kinds and places, so runs compare hashes and not nodes.
    """

    def marks(nodes: DataFrame) -> DataFrame:
        nodes = with_clusters(among(nodes), {"_row": "y"}, tolerance)
        spot = F.concat_ws("@", F.coalesce("kind", F.lit("")), F.col("x").cast("string"))
        row, page = over("_row").orderBy("node"), over().orderBy("_row", "node")
        every = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nodes = nodes.withColumns({"_spots": F.collect_list(F.when(F.col("_in"), spot)).over(every), "_n": F.count("*").over(every), "_nth": F.row_number().over(row)})
        shape = F.sha2(F.array_join(F.sort_array("_spots"), ";"), 256)
        nodes = nodes.withColumn("_shape", F.when(F.col("_in") & (F.col("_nth") == 1), shape)).drop("_spots", "_nth").withColumn("_shape", F.max("_shape").over(every))
        nodes = nodes.withColumns({"_before": F.lag("_row").over(page), "_alike": F.lag("_shape").over(page) == F.col("_shape")})
        new = F.col("_before").isNull() | (F.col("_before") != F.col("_row"))
        nodes = nodes.withColumn("_new", new.cast("int")).withColumn("_fresh", F.when(F.col("_alike"), 0).otherwise(F.col("_new"))).drop("_shape", "_before", "_alike")
        nodes = nodes.withColumn("_run", F.sum("_fresh").over(page.rowsBetween(Window.unboundedPreceding, 0)))
        nodes = nodes.withColumn("_long", F.sum("_new").over(over("_run")))
        return claim(nodes, (F.col("_long") >= least) & (F.col("_n") >= least_nodes), kind)

    return marked(marks)


def dominant_columns(kind: str, share: float, least: int = 3) -> Marks:
    """Nodes whose left edge is that of at least a ``share`` of the page's free nodes, and of ``least``."""

    def marks(nodes: DataFrame) -> DataFrame:
        nodes = among(nodes).withColumn("_n", F.count("*").over(over("x"))).withColumn("_all", F.count("*").over(over()))
        return claim(nodes, (F.col("_n") >= least) & (F.col("_n") >= F.col("_all") * share), kind)

    return marked(marks)


def line_blocks(of: str, kind: str, most_gap: float) -> Marks:
    """Nodes of one kind beside each other on one line, at most ``most_gap`` apart, two or more."""

    def marks(nodes: DataFrame) -> DataFrame:
        nodes = among(nodes, F.col("kind") == of).withColumn("_end", F.col("x") + F.col("w"))
        runs = lo.gap_clusters(nodes, [*WITHIN, "_in", "y"], "x", "_end", most_gap, "_run")
        return claim(runs.withColumn("_n", F.count("*").over(over("y", "_run"))), F.col("_n") >= 2, kind)

    return marked(marks)
