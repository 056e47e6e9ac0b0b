"""Vector code compression: product codes of integer vectors, with segment-mean lower bounds ahead of exact distances.

Each part of a vector meets the entries of its codebook coarse to fine. For a segment of m components with sum s and
residual norm r (the length of the rest after its mean is taken off), the squared distance of two vectors is, over all
segments, at least (s1 - s2)^2 / m + (r1 - r2)^2: equal means leave the residuals, and those differ by at least the
difference of their lengths. Segments are halved from level to level. An entry stays as long as its bound, lowered by
more than all rounding, does not pass the exact distance to the entry with the least first bound; survivors are measured
in integers. Codes therefore equal those of a full search.

Vectors that are null or empty, hold a null or a non-finite component, or have another length than that of the first row
(the least id; a length that the parts do not divide counts as none) are dropped. Of rows with one id, the lesser vector
comes first; a null id is coded but never starts a codebook. Equal distances go to the lower index. Components must be small
enough for exact 64-bit sums (within 32,768 for 64 components); others raise an error. A table without vectors gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, map_arrow, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def limit(size: int) -> float:
    """Largest component of a vector of ``size``: the squares of differences of two such, added up, stay below 2^62."""
    return (2**62 / size) ** 0.5 / 2 / SCALE


def quantised(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows kept, their components as integers, one row each) of an array of lists."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64)
    fits = np.flatnonzero(lengths == size)
    rows = values[starts[fits][:, None] + np.arange(size)]
    finite = np.isfinite(rows).all(1)
    rows = rows[finite]
    if rows.size and np.abs(rows).max() > limit(size):
        raise ValueError(f"components beyond {limit(size)} are not coded")
    return fits[finite], np.floor(rows * SCALE).astype(np.int64)


def levels(width: int) -> list[int]:
    """Numbers of segments that the width allows, from one up to pairs of components."""
    out = [1]
    while width % (out[-1] * 2) == 0 and width // (out[-1] * 2) >= 2:
        out.append(out[-1] * 2)
    return out


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(means scaled by the root of the segment's size, residual norms) of each row's segments."""
    cut_up = x.reshape(len(x), count, -1).astype(np.float64)
    mean = cut_up.mean(2)
    return mean * np.sqrt(cut_up.shape[2]), np.sqrt(((cut_up - mean[:, :, None]) ** 2).sum(2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, exact squared distance, distances measured) of each row's nearest entry; the lower index wins ties."""
    width = x.shape[1]
    alive = np.ones((len(x), len(book)), bool)
    best = None
    for count in levels(width):
        mean_x, rest_x = segments(x, count)
        mean_b, rest_b = segments(book, count)
        bound = np.zeros(alive.shape)
        for k in range(count):
            bound += (mean_x[:, k, None] - mean_b[None, :, k]) ** 2 + (rest_x[:, k, None] - rest_b[None, :, k]) ** 2
        # rounding: products of values up to 2^29 in 53 bits, a few of them added
        bound = bound * (1 - 1e-9) - 1e-3 * (1 + np.abs(mean_x).max(initial=0) + rest_x.max(initial=0))
        if best is None:
            first = bound.argmin(1)
            best = ((x - book[first]) ** 2).sum(1)
        alive &= bound <= best[:, None]
    row, entry = np.nonzero(alive)
    exact = ((x[row] - book[entry]) ** 2).sum(1)
    # rows come in order, entries ascending within each: the first least one wins
    start = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(exact, start) if len(x) else exact
    at = np.flatnonzero(exact == least[row])
    _, one = np.unique(row[at], return_index=True)
    return entry[at[one]], least, len(row) + len(x)


def start_books(vectors: DataFrame) -> np.ndarray | None:
    """Parts of the first vectors by id: (part, entry, component), or None if there are none."""
    usable = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v))  # the array is not null
    ordered = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & usable)
    first = ordered.select("vec_id", "embedding").orderBy("vec_id", "embedding").limit(1).collect()
    if not first:
        return None
    size = len(first[0].embedding)
    rows = ordered.where(F.size("embedding") == size).select("vec_id", "embedding").orderBy("vec_id", "embedding").limit(ENTRIES).collect()
    _, ints = quantised(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), size)
    return ints.reshape(len(ints), PARTS, -1).transpose(1, 0, 2)


def assigned(ints: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), one column for each part."""
    cut_up = ints.reshape(len(ints), PARTS, -1)
    found = [nearest(cut_up[:, p], books[p])[:2] for p in range(PARTS)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts; sums are added in Spark, one row for each entry."""
    size = PARTS * books.shape[2]

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            _, ints = quantised(batch.column(0), size)
            if not len(ints):
                continue
            index, _ = assigned(ints, books)
            for p in range(PARTS):
                part = ints.reshape(len(ints), PARTS, -1)[:, p]
                for c in range(part.shape[1]):
                    # 53 bits are enough for a batch: 2^27 times its rows
                    sums[p, :, c] += np.bincount(index[:, p], part[:, c], books.shape[1]).astype(np.int64)
                counts[p] += np.bincount(index[:, p], minlength=books.shape[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})

    parts = map_arrow(vectors.select("embedding"), run, "part int, entry int, n long, sums array<long>")
    totals = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(c)).cast("decimal(38,0)")).alias(f"s{c}") for c in range(books.shape[2])])
    out = books.copy()
    for row in totals.collect():  # one row for each entry of each part
        out[row.part, row.entry] = [int(row[f"s{c}"]) // row.n for c in range(books.shape[2])]
    return out


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label) of all vectors that are kept."""
    size = PARTS * books.shape[2]

    def run(batches):
        for batch in batches:
            kept, ints = quantised(batch.column(1), size)
            if not len(kept):
                continue
            index, distance = assigned(ints, books)
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(codes), pa.array(distance.sum(1)), rows.column(2)], names=["vec_id", "code", "error", "label"])

    fields = vectors.select("vec_id", "label").schema
    return map_arrow(vectors.select("vec_id", "embedding", "label"), run, fields_of(fields))


def fields_of(schema):
    from pyspark.sql import types as T

    return T.StructType([schema["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), schema["label"]])


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of all vectors that are kept, after ``rounds`` of refinement."""
    small_batches(vectors.sparkSession)
    books = start_books(vectors)
    if books is None:
        books = np.zeros((PARTS, 0, 1), np.int64)
        rows = vectors.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label")
    else:
        for _ in range(rounds):
            books = refined(vectors, books)
        rows = cut(coded(vectors, books))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    errors = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    found = rows.join(errors, F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
