"""Shared plumbing of the training-data operators: tables, checkpoints, text slabs and word hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; with slabs below, it bounds what a Python worker holds.
ARROW_ROWS = 400
#: Characters of text that Python-side kernels hold as words at a time.
SLAB_CHARS = 4_000_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, a temporary one."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written for intermediate rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name like ``stem`` that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def named(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[list[T.StructField], list[Column]]:
    """(fields, columns) of ``df`` but for those named, quoted so that any name can be selected."""
    gone = {c.lower() for c in without}
    fields = [f for f in df.schema.fields if f.name.lower() not in gone]
    return fields, [F.col("`" + f.name.replace("`", "``") + "`") for f in fields]


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def map_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` of columns with any names: Spark looks them up by name, which fails at a dot, so ``run`` has them by place."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def slabs(texts: Iterable[str | None], chars: int = SLAB_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) runs of about ``chars`` characters; None becomes the empty text."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > chars:
            yield first, held
            first, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply) over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_hashes(words) -> np.ndarray:
    """64-bit hash of each word of an Arrow string array."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of an Arrow string array, computed once per distinct word."""
    coded = words.dictionary_encode()
    if not len(words):
        return np.zeros(0, np.uint64)
    return distinct_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by position of the first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix64(out)


def within(rows: DataFrame, drawn: DataFrame, chars: int) -> list:
    """Rows (id, body, ...) of the drawn ids, one for each, in the order of a hash of the ids, whose texts have at most ``chars``
    characters together; a text that does not fit is skipped.

    Of an id with several texts that with the least hash counts, and of rows with one text that with the least other
    columns, so the result does not hang on partitions. Lengths come first: the driver gets one number for each drawn
    id, whose count the caller bounds, and then no more text than ``chars``.
    """
    digest = F.xxhash64("body").alias("digest")
    near = rows.join(F.broadcast(drawn.select("id").distinct()), "id")
    first = near.groupBy("id").agg(F.min(F.struct(digest, F.length("body").alias("size"))).alias("text")).select("id", "text.*").collect()
    order = lambda r: (r.id * 0x9E3779B97F4A7C15 % 2**64, r.id)
    left, taken = chars, []
    for r in sorted(first, key=order):
        if r.size <= left:
            left -= r.size
            taken.append((r.id, r.digest))
    if not taken:
        return []
    chosen = rows.sparkSession.createDataFrame(taken, T.StructType([drawn.schema["id"], T.StructField("digest", T.LongType())]))
    whole = near.withColumn("digest", digest).join(F.broadcast(chosen), ["id", "digest"]).drop("digest")
    others = [c for c in whole.columns if c != "id"]
    got = whole.groupBy("id").agg(F.min(F.struct(*others)).alias("row")).select("id", "row.*").collect()
    return sorted(got, key=order)


def fold_mod(column, modulus: int, remainder: int):
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder)
