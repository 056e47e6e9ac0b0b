"""Near-duplicate classes by minwise hashing, banding and exact verification.

Texts are compared as sets of five-word shingles (lower case, split at white space); a text of fewer words is one
shingle, and all empty texts are equal. For each distinct shingle a Poisson process of rate 1 deals arrivals to the
registers of the text's signature, each register keeps its earliest arrival, and a shingle stops as soon as its next
arrival comes after the latest register. All shingles weigh the same, however often they occur, so two registers agree
with the set Jaccard similarity that is verified. Registers are banded into buckets.

A bucket's texts are paired with one leader, not with all others, and at first each text only with the first of its
leaders (that of most of its buckets). Pairs are verified on the shingle sets and links are joined to components. Buckets
that then hold several components are compared completely across components: small ones by rows of pairs, larger ones in
blocks of texts, each block within one task, which returns only the links that join components. So every pair that shares
a bucket is verified, or its texts are already in one class. Classes are components.

A null text is the empty text. Equal texts share a class whatever their number; only one of them takes part in the
search. Rows that share an id are one document, whose text is the one with the least digest; a row with a null id takes
the class of a row with an id and its text, or has none. Ties go to the smallest id. Texts of any length are shingled
whole, in slabs of bounded size. An empty table gives an empty result. Only the named columns are read, so other columns
may have any names; ``keep_first`` keeps them all.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, gram_hashes, mix64, remove, shared_dir, slabs, small_batches, unused, word_hashes
from quillspark.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 5 registers: at similarity 0.8 a pair shares no bucket with probability 5e-5.
BANDS, ROWS = 25, 5
#: Buckets of up to so many texts are compared by rows of pairs, larger ones in blocks.
SMALL_BUCKET = 12
#: Texts and characters of each side of a block, and shingles that a block counts at a time.
CHUNK, CHUNK_CHARS, COLUMNS = 512, 4_000_000, 4096


def shingles(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the word shingles of each text, with repeats, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(pa.array([" ".join(t.lower().split()) if t[:1].isspace() or t[-1:].isspace() else t.lower() for t in texts], pa.large_string()))
    hashes, ends = word_hashes(split.values), np.asarray(split.offsets)
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= size:
            out.append(grams[a : b - size + 1])
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(1, np.uint64))
    return out


def signatures(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """For each text's shingles the winners of its registers, repeats aside: (texts, registers) of 64-bit hashes."""
    d = len(sets)
    owner = np.repeat(np.arange(d), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.lexsort((every, owner))
    owner, every = owner[order], every[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (every[1:] != every[:-1]))))
    owner, element = owner[first], every[first]
    when = np.full(d * registers, np.inf)
    winner = np.zeros(d * registers, np.uint64)
    clock, k = np.zeros(len(element)), 0
    while len(element):
        k += 1
        draw = mix64(element + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        slot = owner * registers + (((mix64(draw ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(clock < when[slot])
        better = better[np.argsort(-clock[better], kind="stable")]  # of several arrivals at a register the earliest is written last
        when[slot[better]] = clock[better]
        winner[slot[better]] = element[better]
        texts, inverse = np.unique(owner, return_inverse=True)
        latest = when.reshape(d, registers)[texts].max(axis=1)
        on = clock < latest[inverse]
        owner, element, clock = owner[on], element[on], clock[on]
    return winner.reshape(d, registers)


def band_hashes(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    parts = winners.reshape(len(winners), bands, rows)
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(winners), 0)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def _banded(docs: DataFrame) -> DataFrame:
    """(node, bands) of each row of (node, body); equal texts of a slab are hashed once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for _, held in slabs(batch.column("body").to_numpy(zero_copy_only=False)):
                place = {t: k for k, t in enumerate(dict.fromkeys(held))}
                bands = band_hashes(signatures(shingles(list(place)), BANDS * ROWS), BANDS, ROWS)
                rows.append(bands[[place[t] for t in held]])
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "bands"])

    return docs.mapInArrow(run, "node long, bands array<long>")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts (node, body) have a shingle-set Jaccard similarity of ``threshold`` or more."""
    wanted = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    texts = wanted.join(docs, "node").groupBy("a", "b").agg(F.collect_list("body").alias("bodies"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            bodies = batch.column("bodies")
            flat = bodies.flatten().to_numpy(zero_copy_only=False)
            sets: list[np.ndarray] = []
            for _, held in slabs(flat):
                sets += [np.unique(s) for s in shingles(held)]
            ends = np.asarray(bodies.offsets) - bodies.offsets[0].as_py()
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                one, two = sets[x], sets[y - 1]
                same = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(same >= threshold * (len(one) + len(two) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(run, "a long, b long")


def _priority(seed: int, node: str = "node"):
    """An order of nodes that all buckets share, so that one text tends to lead in all of them."""
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("rank"), F.col(node).alias("node"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node, component, n, main) of the buckets that hold several components; ``main`` is a largest one."""
    named = buckets.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main"))
    return cut(named.join(mixed.where("parts > 1").drop("parts"), "bucket"))


def _inside(rows: DataFrame) -> DataFrame:
    """All pairs of texts of different components in the open buckets of up to ``SMALL_BUCKET`` texts."""
    small = rows.where(F.col("n") <= SMALL_BUCKET)
    left, right = (small.select("bucket", F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return left.join(right, "bucket").where("a < b AND ca <> cb").select("a", "b").distinct()


def joining_links(left: list[np.ndarray], right: list[np.ndarray], c_left: list[int], c_right: list[int], threshold: float) -> list[tuple[int, int]]:
    """Positions of pairs of shingle sets at ``threshold`` or more that join the components of two sides to the same
    classes as all such pairs do."""
    sets = [*left, *right]
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kept = times[code] > 1
    column = (np.cumsum(times > 1) - 1)[code[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[kept][order], column[order]
    same = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        same += held[: len(left)] @ held[len(left) :].T
    sizes = np.array([len(x) for x in sets], np.float64)
    met = same >= threshold * (sizes[: len(left), None] + sizes[None, len(left) :] - same) - 1e-9
    met &= np.array(c_left)[:, None] != np.array(c_right)[None, :]
    parent: dict[int, int] = {}

    def find(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    out = []
    for x, y in np.argwhere(met).tolist():
        one, two = find(c_left[x]), find(c_right[y])
        if one != two:
            parent[two] = one
            out.append((x, y))
    return out


def _across(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of each open bucket of more than ``SMALL_BUCKET`` texts.

    The texts outside the main component and those inside are dealt into chunks, and every chunk outside meets every
    chunk in a block. A bucket of one chunk is one block. Rows are the members times the chunks that they meet.
    """
    large = rows.where(F.col("n") > SMALL_BUCKET)
    sized = large.join(texts.select("node", F.length("body").alias("chars")).groupBy("node").agg(F.first("chars").alias("chars")), "node")
    chunks = lambda n, chars: F.greatest(F.ceil(n / CHUNK), F.ceil(chars / CHUNK_CHARS), F.lit(1)).cast("int")
    out = F.col("component") != F.col("main")
    total = sized.groupBy("bucket").agg(F.count("*").alias("all"), F.sum("chars").alias("size"), F.count(F.when(out, 1)).alias("far"), F.coalesce(F.sum(F.when(out, F.col("chars"))), F.lit(0)).alias("far_size"))
    total = total.select("bucket", chunks(F.col("all"), F.col("size")).alias("whole"), chunks(F.col("far"), F.col("far_size")).alias("outer"), chunks(F.col("all") - F.col("far"), F.col("size") - F.col("far_size")).alias("inner"))
    dealt = large.join(total, "bucket").withColumn("rank", F.xxhash64("node", F.lit(7)))
    own = F.when(F.col("whole") == 1, 0).when(out, F.pmod("rank", "outer")).otherwise(F.col("outer") + F.pmod("rank", "inner")).cast("int")
    meets = F.when(F.col("whole") == 1, F.array(F.lit(0))).when(out, F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    placed = dealt.select("bucket", "node", "component", out.alias("out"), own.alias("own"), F.explode(meets).alias("other"))
    placed = placed.select("bucket", "node", "component", "out", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = placed.join(texts.dropDuplicates(["node"]), "node")

    def run(table):
        import pyarrow as pa

        names = ("node", "component", "out", "own", "i", "j")
        node, component, far, own, i, j = (table.column(n).to_pylist() for n in names)
        sets: list[np.ndarray] = []
        for _, held in slabs(table.column("body").to_pylist()):
            sets += [np.unique(x) for x in shingles(held)]
        left = [k for k in range(len(node)) if far[k] and own[k] == i[k]]
        right = [k for k in range(len(node)) if own[k] == j[k]]
        found = joining_links([sets[k] for k in left], [sets[k] for k in right], [component[k] for k in left], [component[k] for k in right], threshold) if left and right else []
        pairs = [sorted((node[left[x]], node[right[y]])) for x, y in found]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return placed.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _digest(text):
    """SHA-256 of the words of a text, in lower case with one blank between."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\s+", " ")), 256))


def _repeated(df: DataFrame, own: Column) -> DataFrame:
    """The ids that several rows have."""
    return cut(df.where(own.isNotNull()).groupBy(own.alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node"))


def one_row_each(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with one row of each id, that of the text with the least digest; rows with a null id stay.

    Only ids are counted over all rows. Rows move only if some id repeats, and then only the rows of such ids.
    """
    own = F.col(doc_id)
    again = _repeated(df, own)
    if again.isEmpty():
        return df
    key, least, digest = (unused(df, x) for x in ("node", "least", "digest"))
    again = again.toDF(key)
    few = df.join(again, own == F.col(key)).withColumn(digest, _digest(F.col(text)))
    first = few.groupBy(F.col(key).alias(f"{key}1")).agg(F.min(digest).alias(least))
    few = few.join(first, (F.col(key) == F.col(f"{key}1")) & (F.col(digest) == F.col(least))).drop(key, f"{key}1", least, digest).dropDuplicates([doc_id])
    return df.join(again, own == F.col(key), "left_anti").unionByName(few)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the smallest id of its class, and links of its distinct text by which
    the class was joined (no pair within a class is verified once it is whole)."""
    spark = df.sparkSession
    small_batches(spark)
    keyed = cut(df.select(F.col(doc_id).cast("long").alias("node"), _digest(F.col(text)).alias("digest")))
    # a document's rows count once, with the least of its digests
    again = _repeated(keyed, F.col("node"))
    docs = df.select(F.col(doc_id).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if not again.isEmpty():
        again = cut(keyed.join(again, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("least")))
        keyed = cut(keyed.join(again, "node", "left").select("node", F.coalesce("least", "digest").alias("digest")))
        docs = docs.join(again, "node", "left").where(F.col("least").isNull() | (_digest(F.col("body")) == F.col("least"))).drop("least")
    groups = cut(keyed.groupBy("digest").agg(F.min("node").alias("node")))
    banded = cut(_banded(docs).join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    rows = banded.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(_priority(0))["node"].alias("leader")).where("n > 1").drop("n")
    buckets = cut(rows.join(shared, "bucket"))
    folder = f"{shared_dir(spark)}/candidates-{uuid.uuid4().hex}"
    try:
        # only texts that share a bucket are kept for verification; later steps move no others
        docs.join(buckets.select("node").distinct(), "node", "left_semi").write.parquet(folder)
        texts = spark.read.schema(docs.schema).parquet(folder)
        # at first every text meets one leader, the one with which it shares most buckets; most classes are whole after that
        led = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
        firsts = led.groupBy("node").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader"))
        tested = cut(firsts.select(*_pair("leader", "node")).distinct())
        links = cut(verify(tested, texts, threshold))
        labels = cut(components(links))
        rows = _open_buckets(buckets, labels)
        pairs = cut(_inside(rows).join(tested, ["a", "b"], "left_anti"))
        new = cut(verify(pairs, texts, threshold).unionByName(_across(rows, texts, threshold)).distinct())
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = cut(components(links))
    finally:
        remove(spark, folder)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = groups.join(labels, "node", "left").join(degree, "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return keyed.join(named, "digest").select(F.col("node").alias("doc_id"), "class_id", "n_links")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each class, the one with the smallest id, in one row; rows with a null id stay."""
    gone = unused(df, "gone")
    others = near_duplicates(df, doc_id, text).where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct()
    return one_row_each(df, doc_id, text).join(others, F.col(doc_id) == F.col(gone), "left_anti")
