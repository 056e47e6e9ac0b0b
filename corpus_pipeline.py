"""Corpus pipeline: drops toxic documents, near copies and contaminated documents, redacts and packs what is left.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last returns the placement of every token piece. ``run`` writes each stage's documents as Parquet into
the shared folder, reads them again for the next, and deletes what the stage before wrote once the next is written.

Null texts are empty: they are clean, equal to one another, hold no benchmark item, and stay null until they are packed as
one terminator. Rows that share an id are one document from the near-duplicate stage on; rows with a null id all stay.
Of documents that tie, the smallest id stays. Nulls in other columns pass through. Texts of any length are read whole. An
empty table of labels makes every document clean, an empty benchmark contaminates none, and empty documents give an empty
result. Other columns, whatever their names, stay until packing, which returns the columns of pieces alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_dedup, packing, pii, toxicity
from quillspark.llm.common import documents, fold_mod, named, remove, shared_dir, unused
from quillspark.llm.queries import VOCABULARY

#: The toxicity model and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below one half."""
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), ~fold_mod(F.col("doc_id"), 5, 0))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    spans = unused(docs, "pii_spans")
    out = pii.redact(pii.find_pii(docs, spans=spans), spans=spans)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*named(docs)[1])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path(VOCABULARY), 2048)


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("decontamination", uncontaminated), ("pii", redacted), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents table."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
