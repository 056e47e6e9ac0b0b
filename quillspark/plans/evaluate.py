"""Corpus evaluation: groups, ratios, pair similarities, totals and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import cosine
from quillspark.operators.compare import group_pairs, ratio_or_one
from quillspark.plans.registry import query
from quillspark.session import table

LANGUAGES = ("de", "en", "es", "fr")
PAIR_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query(
    "discover_groups",
    "SELECT split_part(name, '_', 1) AS code, list_sort(list(DISTINCT split_part(name, '_', 3))) AS langs, count(*) AS n FROM (SELECT upper(source) || '_' || (doc_id % 7) || '_' || upper(lang) AS name FROM documents) WHERE len(string_split(name, '_')) = 3 GROUP BY code",
)
def discover_groups(spark, sf_dir):
    """Names of the form CODE_VERSION_LANG grouped by code."""
    name = F.concat_ws("_", F.upper("source"), (F.col("doc_id") % 7).cast("string"), F.upper("lang"))
    parts = table(spark, sf_dir, "documents").select(F.split(name, "_").alias("p")).where(F.size("p") == 3)
    return parts.groupBy(F.col("p")[0].alias("code")).agg(F.array_sort(F.collect_set(F.col("p")[2])).alias("langs"), F.count("*").alias("n"))


LABELLED = "SELECT d.source, count(l.doc_id) AS labelled, count(*) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"


def labelled_by_source(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("hit").alias("labelled"), F.count("*").alias("total"))


@query("labelled_ratio", f"SELECT source, round(CASE WHEN total = 0 THEN 1.0 ELSE labelled / total END, 6)::DOUBLE AS ratio FROM ({LABELLED})")
def labelled_ratio(spark, sf_dir):
    """Share of labelled documents; 1 for none."""
    return labelled_by_source(spark, sf_dir).select("source", F.round(ratio_or_one(F.col("labelled"), F.col("total")), 6).alias("ratio"))


SLOTS = "SELECT source, round(1.0 - (4 - count(DISTINCT lang)) / 4.0, 6)::DOUBLE AS score FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY source"


@query("missing_slot_ratio", SLOTS)
def missing_slot_ratio(spark, sf_dir):
    """One minus the share of (source, language) slots without a text."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin(*LANGUAGES))
    missing = F.lit(len(LANGUAGES)) - F.count_distinct("lang")
    return docs.groupBy("source").agg(F.round(1.0 - missing / F.lit(float(len(LANGUAGES))), 6).alias("score"))


def variant_vectors(spark, sf_dir):
    """One vector per (source, language): that of the smallest document id."""
    docs = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("vec_id"))
    return docs.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")


VARIANTS = "SELECT source, lang, embedding FROM (SELECT source, lang, min(doc_id) AS vec_id FROM documents GROUP BY source, lang) v JOIN embeddings USING (vec_id)"
PAIRS = f"SELECT a.source, a.lang AS a, b.lang AS b, least(greatest({PAIR_DOT}, 0.0), 1.0) AS score FROM ({VARIANTS}) a JOIN ({VARIANTS}) b ON a.source = b.source AND a.lang < b.lang"


def language_pairs(spark, sf_dir):
    pairs = group_pairs(variant_vectors(spark, sf_dir), "source", "lang", "embedding")
    score = F.least(F.greatest(cosine(F.col("embedding_a"), F.col("embedding_b")), F.lit(0.0)), F.lit(1.0))
    return pairs.select("source", "a", "b", score.alias("score"))


@query("pairwise_similarity", f"SELECT source, a, b, round(score, 6) AS score FROM ({PAIRS})")
def pairwise_similarity(spark, sf_dir):
    """Cosine of each pair of language variants, clamped to [0, 1]."""
    return language_pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("group_cosine_mean", f"SELECT s.source, round(coalesce(avg(score), 1.0), 5) AS score FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN ({PAIRS}) p ON s.source = p.source GROUP BY s.source")
def group_cosine_mean(spark, sf_dir):
    """Mean over the pairs of each source; 1 without pairs."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.join(language_pairs(spark, sf_dir), "source", "left").groupBy("source").agg(F.round(F.coalesce(F.avg("score"), F.lit(1.0)), 5).alias("score"))


SCORES = f"""
    SELECT l.source, CASE WHEN l.total = 0 THEN 1.0 ELSE l.labelled / l.total END AS labelled, m.score AS missing, g.score AS semantic,
           round((CASE WHEN l.total = 0 THEN 1.0 ELSE l.labelled / l.total END) * m.score * g.score, 5)::DOUBLE AS total
    FROM ({LABELLED}) l JOIN ({SLOTS}) m ON l.source = m.source
    JOIN (SELECT s.source, round(coalesce(avg(score), 1.0), 5) AS score FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN ({PAIRS}) p ON s.source = p.source GROUP BY s.source) g ON l.source = g.source
"""


def scores(spark, sf_dir):
    """Per source: three ratios and their product."""
    labelled = labelled_by_source(spark, sf_dir).select("source", ratio_or_one(F.col("labelled"), F.col("total")).alias("labelled"))
    missing = missing_slot_ratio(spark, sf_dir).withColumnRenamed("score", "missing")
    semantic = group_cosine_mean(spark, sf_dir).withColumnRenamed("score", "semantic")
    joined = labelled.join(missing, "source").join(semantic, "source")
    return joined.withColumn("total", F.round(F.col("labelled") * F.col("missing") * F.col("semantic"), 5))


@query(
    "judge_scores",
    f"""
    WITH s AS ({SCORES})
    SELECT source, round(labelled, 3)::DOUBLE AS labelled, round(missing, 3)::DOUBLE AS missing, round(semantic, 3)::DOUBLE AS semantic, round(total, 3)::DOUBLE AS total FROM s
    UNION ALL SELECT 'AVERAGE', round(avg(labelled), 3)::DOUBLE, round(avg(missing), 3)::DOUBLE, round(avg(semantic), 3)::DOUBLE, round(avg(total), 3)::DOUBLE FROM s
    """,
)
def judge_scores(spark, sf_dir):
    """The score table with its average row: one rollup over a key that is unique."""
    metrics = ("labelled", "missing", "semantic", "total")
    rolled = scores(spark, sf_dir).rollup("source").agg(*[F.round(F.avg(m), 3).alias(m) for m in metrics])
    return rolled.withColumn("source", F.coalesce("source", F.lit("AVERAGE")))


@query(
    "baseline_diff",
    """
    WITH h AS (SELECT o_orderpriority AS k, year(o_orderdate) < 1995 AS base, o_totalprice AS p FROM orders),
         g AS (SELECT k, avg(p) FILTER (WHERE base) / 1e5 AS old, avg(p) FILTER (WHERE NOT base) / 1e5 AS new FROM h GROUP BY k)
    SELECT k, round(new - old, 6) AS delta, CASE WHEN abs(new - old) <= 0.0005 THEN 'same' WHEN new > old THEN 'improved' ELSE 'regressed' END AS change FROM g
    """,
)
def baseline_diff(spark, sf_dir):
    """Mean order value of each priority after 1994 against before, with a tolerance of 0.0005."""
    base = F.year("o_orderdate") < 1995
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"))
    means = by.agg((F.avg(F.when(base, F.col("o_totalprice"))) / 1e5).alias("old"), (F.avg(F.when(~base, F.col("o_totalprice"))) / 1e5).alias("new"))
    delta = F.col("new") - F.col("old")
    return means.select("k", F.round(delta, 6).alias("delta"), F.when(F.abs(delta) <= 0.0005, "same").when(delta > 0, "improved").otherwise("regressed").alias("change"))


@query(
    "translation_pivot",
    "SELECT source, min(md5(text)) FILTER (WHERE lang = 'de') AS de, min(md5(text)) FILTER (WHERE lang = 'en') AS en, min(md5(text)) FILTER (WHERE lang = 'es') AS es, min(md5(text)) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source",
)
def translation_pivot(spark, sf_dir):
    """One row per source with a text per language; missing ones are null."""
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", list(LANGUAGES)).agg(F.min(F.md5("text")))


@query(
    "translation_conflicts",
    "SELECT role AS master, conv_id % 4 AS lang, count(DISTINCT md5(text)) AS n_texts, arg_max(md5(text), {'c': conv_id, 't': turn}) AS winner FROM conversations GROUP BY ALL HAVING count(DISTINCT md5(text)) > 1",
)
def translation_conflicts(spark, sf_dir):
    """Keys with more than one text; the last writer wins."""
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("master"), (F.col("conv_id") % 4).alias("lang"), F.md5("text").alias("t"), F.struct("conv_id", "turn").alias("ord"))
    return rows.groupBy("master", "lang").agg(F.count_distinct("t").alias("n_texts"), F.max_by("t", "ord").alias("winner")).where("n_texts > 1")


@query("collect_langs", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source")
def collect_langs(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


@query("first_non_null", "SELECT source, arg_min(lang, doc_id) FILTER (WHERE n_chars > 1000) AS header FROM documents GROUP BY source")
def first_non_null(spark, sf_dir):
    """The first header that is not empty."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by(F.when(F.col("n_chars") > 1000, F.col("lang")), F.when(F.col("n_chars") > 1000, F.col("doc_id"))).alias("header"))
