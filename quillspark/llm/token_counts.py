"""Token counts by a digest cache: only texts whose digest the cache lacks are encoded, once each.

Nulls count as the empty text. Repeated rows and equal texts share one digest and are encoded once; every input row
comes back with its own count. Texts of any length are encoded whole, in slabs of bounded size. An empty table gives an
empty result, and other columns, whatever their names, pass through untouched; only ``n_tokens`` is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, shared_dir, slabs, small_batches, unused
from quillspark.llm.tokenization import encoder, file_version

#: Fewer misses than this (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_MISSES = 20_000
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def content_digest(text):
    """SHA-256 of the text with runs of blanks and line ends as one blank, which no white-space-free id can notice."""
    return F.unhex(F.sha2(F.regexp_replace(text, "[ \\n\\r\\t]+", " "), 256))


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(df: DataFrame, text: str, tokenizer: str, cache: str | None = None, collapse: bool | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, by the cache at ``cache`` (a fresh one in the shared folder if None).

    ``collapse`` digests runs of blanks as one blank. By default it is used only for vocabularies whose tokens never
    depend on the amount of white space.
    A digest that concurrent runs appended twice has the same count in both rows, so one is taken.
    """
    spark = df.sparkSession
    small_batches(spark)
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    version = file_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    collapse = encoder(tokenizer).by_word if collapse is None else collapse
    digest = content_digest(body) if collapse else F.unhex(F.sha2(body, 256))
    stored = read_cache(spark, cache).where(F.col("version") == version)
    texts = df.select(digest.alias("digest"), body.alias("body"))
    misses = cut(texts.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti"))
    n = misses.count()
    if n:
        if n <= BROADCAST_MISSES:
            todo = texts.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("body").alias("body"))
        else:
            # an inner join (misses are distinct) stays above the aggregate, so copies are dropped before the shuffle
            todo = texts.groupBy("digest").agg(F.first("body").alias("body")).join(misses, "digest")

        def encode(batches):
            import pyarrow as pa

            own = encoder(tokenizer)
            for batch in batches:
                bodies = batch.column("body").to_numpy(zero_copy_only=False)
                counts = [c for _, held in slabs(bodies) for c in own.counts(held).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

        todo.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    key = unused(df, "digest")
    counts = read_cache(spark, cache).where(F.col("version") == version).groupBy(F.col("digest").alias(key)).agg(F.max("n_tokens").alias("n_tokens"))
    keyed = df.drop("n_tokens").withColumn(key, digest)
    return keyed.join(counts, key).drop(key)
