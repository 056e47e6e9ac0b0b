"""Source divergence audit: how far the term distributions of the sources of each language lie apart.

Terms are counted by language and source, and each kept term becomes the sparse vector of its counts by source. Terms with
equal vectors are one vector with a multiplicity, so a pair of sources is evaluated once for each distinct vector and
multiplied; original terms come back only for the ranks.

The sum of |p - q| over all terms of a language is V * |p0 - q0| (as if no term occurred in either source) plus a
correction for each vector that has a count in one of the two. Blocks of vectors yield matrices of corrections, source
by source, and matrices add up; no task emits pairs of terms or of documents.

Null texts have no terms; null languages and sources are the empty string; every row is a document, so repeated rows count
as often as they stand there. Texts are read whole. Empty tables give an empty result, other columns are ignored, and ties
of a value go to the item with the lesser bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, map_arrow, slabs, small_batches

#: Distinct vectors of one block, and sources of one tile of its matrix of corrections.
BLOCK_VECTORS, TILE = 8_000, 256
#: Groups up to this number, which is counted, are broadcast to the vectors; more are joined by shuffles.
BROADCAST_GROUPS = 50_000
#: Counted terms that a task holds before it passes them on.
HELD = 1_000_000
SCALE, PRIOR = 1_000_000_000, 5

#: Every byte of a text as its term character, or 0 between terms: letters in lower case, and all bytes of longer code points.
LETTER = np.zeros(256, np.uint8)
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, number of the text of each)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LETTER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = data != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8)])))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
    firsts = np.cumsum([0, *[len(t) + 1 for t in raw]])
    return terms, np.searchsorted(firsts, starts, "right") - 1


def counted(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and documents of each term, summed within each task."""
    small_batches(rows.sparkSession)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())], ["lang", "source"])
            keys: dict = {}
            group = np.fromiter((keys.setdefault((g["lang"], g["source"]), len(keys)) for g in groups.to_pylist()), np.int64, len(groups))
            for first, texts in slabs(batch.column(2).to_pylist()):
                terms, doc = terms_of(texts)
                coded = terms.dictionary_encode()
                size = max(len(coded.dictionary), 1)
                in_doc, n = np.unique(doc * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of_group, back = np.unique(group[first + in_doc // size] * size + in_doc % size, return_inverse=True)
                names = list(keys)
                lang, source = (pa.array([names[g][k] for g in of_group // size], pa.string()) for k in (0, 1))
                sums = np.bincount(back, n, len(of_group)).astype(np.int64), np.bincount(back, minlength=len(of_group))
                held.append(pa.table([lang, source, coded.dictionary.take(pa.array(of_group % size)), *map(pa.array, sums)], ["lang", "source", "term", "n", "docs"]))
                total += len(of_group)
                if total > HELD:
                    yield from summed(held)
                    held, total = [], 0
        yield from summed(held)

    return map_arrow(rows, run, "lang string, source string, term string, n long, docs long")


def summed(held: list[pa.Table]):
    """Record batches of the sums of counted terms."""
    if held:
        added = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        yield from added.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact at any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms)) + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for arrays of counts and of totals with the prior in them; in two steps, so that 64 bits are enough."""
    whole, rest = np.divmod(counts + PRIOR, totals)
    high, rest = np.divmod(rest * 100_000, totals)
    return 1 + whole * SCALE + high * 10_000 + rest * 10_000 // totals


def vectors(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, vector) of terms in at least ``least_docs`` documents of their language; a vector is an array of (source, n).

    An array has one entry for each source of a language, whose pairs are rows of the result.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    sums = counted(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def corrections(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, delta): what the vectors of a language add to V * |p0 - q0| for each pair of its sources.

    Each block of vectors meets all sources of its language in one task. A source with a count in a vector looks at all
    partners there; the vectors in which the partner has none count for the partner's side too.
    """
    blocks = max(-(-distinct.count() // BLOCK_VECTORS), 1)
    left = distinct.select("lang", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"), F.col("vector.source").alias("sources"), F.col("vector.n").alias("counts"), "times")
    right = groups.join(left.select("lang", F.col("block").alias("of_block")).distinct(), "lang").select("lang", "of_block", "source", "total", "terms")

    def run(key, block, known):
        import pandas as pd

        known = known.sort_values("source")  # by code points, which is the order of bytes
        names, totals = known["source"].to_numpy(), (known["total"] + PRIOR * known["terms"]).to_numpy(np.int64)
        none, times = shares(np.zeros(len(names), np.int64), totals), block["times"].to_numpy(np.int64)
        vector = np.repeat(np.arange(len(block)), block["sources"].map(len).to_numpy())
        source = np.searchsorted(names, np.concatenate(block["sources"].to_list()))
        p = shares(np.concatenate(block["counts"].to_list()).astype(np.int64), totals[source])
        order = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[order], np.arange(len(names) + 1))
        for at in range(0, len(names), TILE):
            wide = none[at : at + TILE]
            here = (source >= at) & (source < at + TILE)
            tile, absent = np.tile(wide, (len(block), 1)), np.ones((len(block), len(wide)), bool)
            tile[vector[here], source[here] - at] = p[here]
            absent[vector[here], source[here] - at] = False
            for s in range(len(names)):
                own = order[bounds[s] : bounds[s + 1]]
                v = vector[own]
                gap = (np.abs(p[own][:, None] - tile[v]) - np.abs(none[s] - wide)) * times[v][:, None]
                alone = (gap * absent[v]).sum(0)
                yield pd.DataFrame({"lang": key[0], "source": names[s], "item": names[at : at + TILE], "delta": gap.sum(0)})
                yield pd.DataFrame({"lang": key[0], "source": names[at : at + TILE], "item": names[s], "delta": alone})

    schema = "lang string, source string, item string, delta long"
    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "of_block")).applyInPandas(lambda key, block, known: together(run(key, block, known)), schema)
    return parts.groupBy("lang", "source", "item").agg(F.sum("delta").alias("delta"))


def together(frames):
    """One frame of many; a block has at least one vector, so there is at least one."""
    import pandas as pd

    return pd.concat(frames)


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources of the language, and the terms that stand out most."""
    kept = cut(vectors(docs, least_docs))
    distinct = cut(kept.groupBy("lang", "vector").agg(F.count("*").alias("times")))
    counts = distinct.select("lang", "times", F.inline("vector"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    per_lang = distinct.groupBy("lang").agg(F.sum("times").alias("terms"), F.sum(F.col("times") * F.aggregate("vector", F.lit(0).cast("long"), lambda t, e: t + e["n"])).alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum(F.col("times") * F.col("n")).alias("total"))
    groups = named.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = cut(groups)
    return pairs(distinct, groups).unionByName(standing_out(kept, distinct, groups, top))


def pairs(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of part ``pair``; sources of a language meet, as every two of them are a row of the result."""
    own = groups.select("lang", "source", "terms", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0).alias("p"))
    other = own.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    met = own.join(other, "lang").where(F.col("source") != F.col("item"))
    value = F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("delta", F.lit(0))
    valued = met.join(corrections(distinct, groups), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def standing_out(kept: DataFrame, distinct: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The rows of part ``term``: vectors are valued once and ranked; of those in front, the first terms come back and are ranked."""
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda t, e: t + e["n"])
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    entries = distinct.select("lang", "vector", total.alias("lang_n"), F.inline("vector")).join(known, ["lang", "source"])
    valued = entries.withColumn("value", share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    front = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    ahead = valued.withColumn("place", F.rank().over(front)).where(F.col("place") <= top).select("lang", "source", "vector", "value")
    first = Window.partitionBy("lang", "vector").orderBy("term")
    terms = kept.join(ahead.select("lang", "vector").distinct(), ["lang", "vector"], "left_semi").withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).drop("place")
    listed = ahead.join(terms, ["lang", "vector"])
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
