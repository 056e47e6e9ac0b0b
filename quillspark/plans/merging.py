"""Merging of versions: nodes that an alignment left over, and trees of many states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import merge
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.plans.registry import query
from quillspark.session import table


def line_nodes(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, line, kind, text, condition): the lines of conversations as form nodes.

    Lines of a user are fields, of others paragraphs; a short line of an assistant is a conditional on its first letter.
    """
    lines = talks.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    short = (F.col("role") == "assistant") & F.length("text").between(1, 60)
    kind = F.when(F.col("role") == "user", "field").when(short, "conditional").otherwise("paragraph")
    return lines.select("conv_id", "turn", "line", kind.alias("kind"), "text", F.when(short, F.lower(F.substring("text", 1, 1))).alias("condition"))


def aligned_nodes(talks: DataFrame) -> DataFrame:
    """Each conversation beside the next one: nodes at the same turn and line, of one kind and one shape, are matched."""
    nodes = line_nodes(talks)
    left = nodes.withColumnRenamed("text", "left_text")
    right = nodes.select((F.col("conv_id") - 1).alias("conv_id"), "turn", "line", F.col("kind").alias("r_kind"), F.col("text").alias("right_text"), F.col("condition").alias("r_condition"))
    met = left.join(right, ["conv_id", "turn", "line"], "full")
    known = talks.select("conv_id").distinct()
    met = met.join(known, "conv_id", "left_semi").join(known.select((F.col("conv_id") - 1).alias("conv_id")), "conv_id", "left_semi")
    same = (F.col("kind") == F.col("r_kind")) & F.col("condition").eqNullSafe(F.col("r_condition")) & merge.same_shape(F.col("left_text"), F.col("right_text"))
    side = lambda s, kind, left, right, condition: F.struct(F.lit(s).alias("side"), F.col(kind).alias("kind"), left.alias("left_text"), right.alias("right_text"), F.col(condition).alias("condition"))
    none = F.lit(None).cast("string")
    matched = F.array(side("both", "kind", F.col("left_text"), F.col("right_text"), "condition"))
    apart = F.array(side("left", "kind", F.col("left_text"), none, "condition"), side("right", "r_kind", none, F.col("right_text"), "r_condition"))
    split = met.select("conv_id", "turn", "line", F.posexplode(F.filter(F.when(same, matched).otherwise(apart), lambda e: e["kind"].isNotNull())).alias("rank", "e"))
    pos = F.col("turn") * 2_000_000 + F.col("line") * 2 + F.col("rank")
    return split.select("conv_id", pos.cast("long").alias("pos"), "e.*", F.when((F.col("e.side") == "both") & (F.col("e.kind") == "field"), F.col("turn").cast("string")).alias("anchor"))


@query("orphan_consolidation")
def orphan_consolidation(spark, sf_dir):
    """Conversations merged with the next one: all nodes after the five passes, and the pass that completed each."""
    ensure_checkpoint_dir(spark)
    merged = merge.consolidate(aligned_nodes(table(spark, sf_dir, "conversations")), ["conv_id"])
    digest = lambda c: F.md5(F.coalesce(c, F.lit("-")))
    return merged.select("conv_id", "pos", "side", "kind", "via", F.size("members").alias("n_members"), F.array_join(F.array_sort("members"), ",").alias("members"), digest("left_text").alias("left_md5"), digest("right_text").alias("right_md5"))


@query(
    "recursive_state_merge",
    """
    WITH o AS (SELECT DISTINCT o_orderstatus AS s1, o_orderpriority AS s2, r_name AS a, n_name AS b, c_mktsegment AS c
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT DISTINCT '' AS path, 0 AS depth, NULL AS up, s1, s2 FROM o UNION SELECT a, 1, '', s1, s2 FROM o UNION SELECT a || '/' || b, 2, a, s1, s2 FROM o UNION SELECT a || '/' || b || '/' || c, 3, a || '/' || b, s1, s2 FROM o),
    u AS (SELECT path, depth, up, s1, s2, 0 AS level, 'all' AS prefix FROM p UNION ALL SELECT path, depth, up, s1, s2, 1, s1 FROM p UNION ALL SELECT path, depth, up, s1, s2, 2, s1 || '/' || s2 FROM p),
    n AS (SELECT path, depth, up, level, prefix, any_value(s1) AS s1, count(*) AS n FROM u GROUP BY path, depth, up, level, prefix),
    f AS (SELECT x.path, x.depth, x.level, x.prefix, x.s1, x.n FROM n x JOIN n y ON y.path = x.up AND y.prefix = x.prefix AND x.n = y.n),
    m AS (SELECT * FROM f WHERE level = 0 OR (level = 1 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.path = f.path AND z.level = 0))
          OR (level = 2 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.path = f.path AND (z.level = 0 OR (z.level = 1 AND z.prefix = f.s1)))))
    SELECT path, depth, CASE WHEN level = 0 THEN 'common' ELSE 'conditional' END AS kind, level, prefix AS condition, n AS n_states FROM m
    """,
)
def recursive_state_merge(spark, sf_dir):
    """Trees of region, nation and segment, one for each order status and priority, as one tree of common and conditional nodes."""
    ensure_checkpoint_dir(spark)
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", "n_name")
    customers = table(spark, sf_dir, "customer").join(places, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.array("r_name", "n_name", "c_mktsegment").alias("path"))
    states = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").join(customers, "o_custkey")
    merged = merge.merge_states(states, ["o_orderstatus", "o_orderpriority"], "path")
    return merged.select(F.array_join("path", "/").alias("path"), "depth", "kind", "level", F.when(F.col("level") == 0, "all").otherwise(F.array_join("condition", "/")).alias("condition"), "n_states")
