"""The relational dump: six tables built from orders, their checks, and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.compare import missing_values
from quillspark.plans.registry import query
from quillspark.session import table


def dump(spark, sf_dir) -> dict:
    """Assets are orders, versions their lines by language, ownerships customers, relations parts of lines."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    language = F.element_at(F.array(*map(F.lit, ("de", "en", "fr"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return {
        "assets": orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("asset_type")),
        "asset_version": items.select(F.col("l_orderkey").alias("asset_fk_id"), language.alias("language"), F.col("l_linenumber").alias("version")),
        "documents": orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("form_path")),
        "document_version": orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_fk_id"), F.lit(1).alias("version")),
        "ownerships": orders.select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("object_id")),
        "relations": items.select(F.col("l_partkey").alias("relates_to"), F.col("l_orderkey").alias("object_id")),
    }


LANGS = "SELECT l_orderkey AS a, ['de', 'en', 'fr'][l_linenumber % 3 + 1] AS language FROM lineitem"


@query(
    "language_completeness",
    f"""
    SELECT l.language, (SELECT count(*) FROM orders) AS n_assets, count(DISTINCT v.a) AS n_versions, count(DISTINCT v.a) = (SELECT count(*) FROM orders) AS complete
    FROM (SELECT unnest(['de', 'en', 'fr', 'it']) AS language) l LEFT JOIN ({LANGS}) v ON v.language = l.language GROUP BY l.language
    """,
)
def language_completeness(spark, sf_dir):
    """Per configured language: assets that have a version in it against all assets."""
    parts = dump(spark, sf_dir)
    languages = spark.createDataFrame([(x,) for x in ("de", "en", "fr", "it")], "language string")
    have = parts["asset_version"].groupBy("language").agg(F.count_distinct("asset_fk_id").alias("n_versions"))
    total = parts["assets"].agg(F.count("*").alias("n_assets"))  # one row
    joined = languages.join(have, "language", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n_versions", F.lit(0))
    return joined.select("language", "n_assets", n.alias("n_versions"), (n == F.col("n_assets")).alias("complete"))


@query("dangling_refs", "SELECT DISTINCT o_custkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_refs(spark, sf_dir):
    """Owners that the table of valid owners lacks."""
    owners = dump(spark, sf_dir)["ownerships"].select(F.col("owner_id").alias("ref")).distinct()
    valid = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ref"))
    return missing_values(owners, valid, "ref")


@query(
    "dump_validation",
    """
    SELECT 'assets_without_version' AS rule, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'dangling_relation', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'asset_without_owner', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'empty_documents', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') = 0 THEN 1 ELSE 0 END
    """,
)
def dump_validation(spark, sf_dir):
    """Violations by rule."""
    parts = dump(spark, sf_dir)
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    assets, versions = parts["assets"].withColumnRenamed("id", "k"), parts["asset_version"].withColumnRenamed("asset_fk_id", "k")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("relates_to"))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"))
    out = count(missing_values(assets, versions, "k"), "assets_without_version")
    out = out.unionByName(count(missing_values(parts["relations"], part, "relates_to"), "dangling_relation"))
    out = out.unionByName(count(missing_values(parts["ownerships"], owner, "owner_id"), "asset_without_owner"))
    empty = parts["documents"].agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("empty_documents").alias("rule"), "n")
    return out.unionByName(empty)


@query("component_counts", "SELECT o_orderpriority AS style, count(*) AS n FROM orders GROUP BY style")
def component_counts(spark, sf_dir):
    return dump(spark, sf_dir)["assets"].groupBy(F.col("asset_type").alias("style")).agg(F.count("*").alias("n"))
