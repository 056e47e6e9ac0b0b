"""Hybrid search: cosine top-k, literal and pattern search, joined by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import cosine
from quillspark.plans.registry import query
from quillspark.session import table

THRESHOLD = 0.4
DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def scored(spark, sf_dir, probe: int = 0):
    """Cosine of every vector with one query vector; the query is one row."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where(F.col("vec_id") == probe).select(F.col("embedding").alias("q")).limit(1)
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query(
    "semantic_topk",
    f"SELECT e.vec_id, round({DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round({DOT}, 6) >= {THRESHOLD} ORDER BY score DESC, vec_id LIMIT 10",
)
def semantic_topk(spark, sf_dir, k: int = 10):
    """The k nearest vectors at the threshold or above; ties by id."""
    return scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)


@query(
    "semantic_best",
    f"""
    SELECT label, vec_id, score FROM (SELECT e.label, e.vec_id, round({DOT}, 6) AS score, row_number() OVER (PARTITION BY e.label ORDER BY round({DOT}, 6) DESC, e.vec_id DESC) AS rn
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round({DOT}, 6) >= 0.0) WHERE rn = 1
    """,
)
def semantic_best(spark, sf_dir, threshold: float = 0.0):
    """Each label's best match; on a tie the last one wins."""
    best = F.max(F.struct("score", "vec_id"))
    return scored(spark, sf_dir).where(F.col("score") >= threshold).groupBy("label").agg(best.alias("b")).select("label", "b.vec_id", "b.score")


@query(
    "hybrid_search",
    f"""
    WITH sem AS (SELECT e.vec_id AS ref_id, 1 AS prio FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round({DOT}, 6) >= {THRESHOLD} ORDER BY round({DOT}, 6) DESC, e.vec_id LIMIT 10),
         hits AS (SELECT ref_id, prio FROM sem UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT page_id, 3 FROM pages WHERE contains(lower(html), 'license'))
    SELECT ref_id, min(prio) AS prio FROM hits GROUP BY ref_id
    """,
)
def hybrid_search(spark, sf_dir, needle: str = "license"):
    """Semantic hits, then descriptions, then packages that hold the text; one row per reference by the best signal."""
    semantic = semantic_topk(spark, sf_dir).select(F.col("vec_id").alias("ref_id"), F.lit(1).alias("prio"))
    described = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit(needle))).select(F.col("doc_id").alias("ref_id"), F.lit(2).alias("prio"))
    packaged = table(spark, sf_dir, "pages").where(F.contains(F.lower("html"), F.lit(needle))).select(F.col("page_id").alias("ref_id"), F.lit(3).alias("prio"))
    return semantic.unionByName(described).unionByName(packaged).groupBy("ref_id").agg(F.min("prio").alias("prio"))
