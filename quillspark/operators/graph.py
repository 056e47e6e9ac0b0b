"""Graph and tree operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node reaches over undirected edges (a, b).

    Labels spread to neighbours and then jump to their label's label, so a chain of n nodes takes about log n rounds.
    Each round is written to the checkpoint folder. ``spark.checkpoint.dir`` must be set beforehand on a cluster.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old").checkpoint()
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def reachable(edges: DataFrame, starts: DataFrame, most_depth: int = 100) -> DataFrame:
    """(start, node, depth): what each start reaches over directed edges (a, b), with the least depth; cycles end.

    The result has a row for each start and node that it reaches. A closure deeper than ``most_depth`` is an error.
    """
    seen = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct().checkpoint()
    for depth in range(1, most_depth + 1):
        step = frontier.join(edges.select(F.col("a").alias("node"), "b"), "node").select("start", F.col("b").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"the closure is deeper than {most_depth}")


def fixpoint_prune(rules: DataFrame, most_rounds: int = 50, steps: int = 2) -> DataFrame:
    """Rules (id, depends_on) left when rules whose dependency is missing are dropped until none is.

    ``steps`` drops run between two checkpoints; each is one join of what is left with its own ids.
    """
    left = rules.checkpoint()
    n = left.count()
    for _ in range(most_rounds):
        for _ in range(steps):
            known = left.select(F.col("id").alias("_known")).distinct()
            held = left.join(known, F.col("depends_on") == F.col("_known"), "left").where("depends_on IS NULL OR _known IS NOT NULL")
            left = held.select(*rules.columns)
        left = left.checkpoint()
        if (now := left.count()) == n:
            return left
        n = now
    raise RuntimeError("pruning did not settle")


def hoist(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """(level, node, value): values that all branches of a node hold are moved up to it, from the deepest level to the root.

    ``levels`` are columns from the root to the leaves that hold ``value`` (null where a leaf has none). A node is named
    by its path. Each step is one count by parent and value, so no branch's values have to fit into one task.
    """
    path = lambda depth: F.concat_ws("/", *[F.col(c).cast("string") for c in levels[:depth]])
    branches = df.select(*levels).distinct()
    held = df.where(F.col(value).isNotNull()).select(*levels, value).distinct()
    out = None
    for depth in range(len(levels), 0, -1):
        part = held
        if depth > 1:
            up = levels[: depth - 1]
            whole = branches.select(*levels[:depth]).distinct().groupBy(*up).agg(F.count("*").alias("_all"))
            common = held.groupBy(*up, value).agg(F.count("*").alias("_n")).join(whole, up).where("_n = _all").select(*up, value)
            part, held = held.join(common, [*up, value], "left_anti"), common
        rows = part.select(F.lit(levels[depth - 1]).alias("level"), path(depth).alias("node"), value)
        out = rows if out is None else out.unionByName(rows)
    return out
