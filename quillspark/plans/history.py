"""Versioned edit history and reference store: conversations stand for sessions, their turns for numbered edits;
documents stand for references, pages for their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.upsert import latest_by_key, upsert
from quillspark.plans.registry import query
from quillspark.session import table


@query(
    "session_list",
    """
    SELECT conv_id AS session_id, count(*) AS n_edits, max(turn) AS last_seq
    FROM conversations GROUP BY conv_id ORDER BY last_seq DESC, session_id
    """,
)
def session_list(spark, sf_dir):
    """Sessions with their edit counts, longest history first."""
    edits = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id"))
    return edits.agg(F.count("*").alias("n_edits"), F.max("turn").alias("last_seq")).orderBy(F.desc("last_seq"), "session_id")


@query("next_seq", "SELECT conv_id AS session_id, coalesce(max(turn) + 1, 0) AS next_seq FROM conversations GROUP BY conv_id")
def next_seq(spark, sf_dir):
    """The number that a session's next edit gets."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.coalesce(F.max("turn") + 1, F.lit(0)).alias("next_seq"))


@query("latest_per_key", "SELECT conv_id AS session_id, max(turn) AS seq, arg_max(role, turn) AS action, arg_max(md5(text), turn) AS snapshot FROM conversations GROUP BY conv_id")
def latest_per_key(spark, sf_dir):
    """Each session's newest edit."""
    edits = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("snapshot"))
    return latest_by_key(edits, ["conv_id"], "turn").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("action"), "snapshot")


@query(
    "snapshot_as_of",
    "SELECT conv_id AS session_id, max(turn) AS seq, arg_max(md5(text), turn) AS snapshot FROM conversations WHERE turn <= 2 GROUP BY conv_id",
)
def snapshot_as_of(spark, sf_dir, seq: int = 2):
    """Each session as it stood after edit ``seq``."""
    edits = table(spark, sf_dir, "conversations").where(F.col("turn") <= seq)
    return edits.groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("seq"), F.max_by(F.md5("text"), "turn").alias("snapshot"))


@query(
    "upsert_latest",
    """
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.n_chars ELSE o.n_chars END AS n_chars,
           CASE WHEN n.doc_id IS NOT NULL THEN 'new' ELSE 'old' END AS origin
    FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) o
    FULL JOIN (SELECT doc_id, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 2 = 0) n ON o.doc_id = n.doc_id
    """,
)
def upsert_latest(spark, sf_dir):
    """Insert, or update where the key exists: the newer row of each key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old = docs.where("doc_id % 3 <> 0").withColumn("origin", F.lit("old"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") * 2).alias("n_chars"), F.lit("new").alias("origin"))
    return upsert(old, new, ["doc_id"])


@query(
    "ref_files_join",
    """
    SELECT r.doc_id AS ref_id, r.source AS profile, p.url AS path, length(p.html) AS size
    FROM pages p JOIN documents r ON r.doc_id = p.page_id WHERE r.lang = 'en'
    """,
)
def ref_files_join(spark, sf_dir):
    """Files of the references of one profile class."""
    refs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("ref_id"), F.col("source").alias("profile"))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ref_id"), F.col("url").alias("path"), F.length("html").cast("long").alias("size"))
    return files.join(refs, "ref_id").select("ref_id", "profile", "path", "size")


@query(
    "ref_import_upsert",
    """
    WITH imported AS (SELECT doc_id, 'imported' AS profile, md5(text) AS label FROM documents WHERE lang = 'de'),
         own AS (SELECT doc_id, source AS profile, md5(text) AS label FROM documents WHERE doc_id % 2 = 0)
    SELECT * FROM imported UNION ALL SELECT * FROM own WHERE doc_id NOT IN (SELECT doc_id FROM imported)
    """,
)
def ref_import_upsert(spark, sf_dir):
    """Another store's references taken over under a stamped profile; imported rows replace own ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("profile"), F.md5("text").alias("label"), "lang")
    imported = docs.where("lang = 'de'").withColumn("profile", F.lit("imported")).drop("lang")
    return upsert(docs.where("doc_id % 2 = 0").drop("lang"), imported, ["doc_id"])


@query(
    "ref_export",
    """
    SELECT page_id AS ref_id, '' AS profile, url AS path FROM pages
    WHERE page_id IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1'))
    """,
)
def ref_export(spark, sf_dir):
    """Child rows of the exported references, with a blank profile."""
    chosen = table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1")).select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").join(chosen, "page_id", "left_semi").select(F.col("page_id").alias("ref_id"), F.lit("").alias("profile"), F.col("url").alias("path"))


@query(
    "content_hash",
    "SELECT source, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS content_hash, count(*) AS n_files FROM documents GROUP BY source",
)
def content_hash(spark, sf_dir):
    """A hash of each source's files that does not depend on their order."""
    digests = F.collect_list(F.sha2("text", 256))
    return table(spark, sf_dir, "documents").groupBy("source").agg(tx.content_hash(digests).alias("content_hash"), F.count("*").alias("n_files"))
