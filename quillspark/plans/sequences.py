"""Ordered sequences: runs, folds, windows of turns, and alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import sequences as sq
from quillspark.plans.registry import query
from quillspark.session import table

def by_turn():
    """Turns of a conversation in order."""
    return Window.partitionBy("conv_id").orderBy("turn")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


#: Rows of one task of a sort; what it holds in memory goes with them.
TASK_ROWS = 2_000_000


def spread(df, key: str, rows: int):
    """``df`` dealt by ``key`` over partitions that grow in number, not in size, with its ``rows``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), key)


@query(
    "consecutive_repeats",
    """
    WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS d FROM events)
    SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM e GROUP BY user_id, event_type, d HAVING count(*) >= 3
    """,
)
def consecutive_repeats(spark, sf_dir, least: int = 3):
    """Runs of the same event kind, at least three long."""
    events = sq.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return events.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


@query(
    "adjacent_run_merge",
    """
    WITH t AS (SELECT *, length(text) > 300 AS big FROM conversations), f AS (SELECT *, CASE WHEN big = lag(big) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM t),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT conv_id, min(turn) AS first_turn, count(*) AS n, md5(string_agg(text, ' ' ORDER BY turn)) AS merged FROM i GROUP BY conv_id, island
    """,
)
def adjacent_run_merge(spark, sf_dir):
    """Neighbouring blocks of the same kind fused; the first one's id stays."""
    runs = sq.islands(turns(spark, sf_dir), ["conv_id"], ["turn"], F.length("text") > 300)
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ")
    return runs.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.md5(merged).alias("merged")).drop("island")


@query(
    "list_runs",
    """
    WITH l AS (SELECT l_orderkey AS page, l_linenumber AS k, l_quantity AS x, l_partkey AS p FROM lineitem), f AS (SELECT *, CASE WHEN abs(x - lag(x) OVER (PARTITION BY page ORDER BY k, x, p)) <= 5 THEN 0 ELSE 1 END AS fresh FROM l),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY k, x, p ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT page, min(k) AS first_item, count(*) AS n FROM i GROUP BY page, run HAVING count(*) > 1
    """,
)
def list_runs(spark, sf_dir, tolerance: float = 5.0):
    """Runs of list items whose indent stays within the tolerance from one to the next."""
    w = Window.partitionBy("page").orderBy("k", "x", "p")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("p"))
    items = spread(items, "page", items.count())
    fresh = F.when(F.abs(F.col("x") - F.lag("x").over(w)) <= tolerance, 0).otherwise(1)
    runs = items.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page", "run").agg(F.min("k").alias("first_item"), F.count("*").alias("n")).where("n > 1").drop("run")


@query(
    "evict_stale_turns",
    """
    SELECT conv_id, turn, CASE WHEN a > 1 AND d > 2 AND length(text) > 200 THEN '[evicted]' ELSE md5(text) END AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations)
    """,
)
def evict_stale_turns(spark, sf_dir, keep_recent: int = 2, text_over: int = 200):
    """Long texts between the first turn and the last ones replaced by a stub."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    placed = turns(spark, sf_dir).withColumns({"a": F.row_number().over(by_turn()), "d": F.row_number().over(last)})
    stale = (F.col("a") > 1) & (F.col("d") > keep_recent) & (F.length("text") > text_over)
    return placed.select("conv_id", "turn", F.when(stale, "[evicted]").otherwise(F.md5("text")).alias("body"))


@query(
    "budget_window",
    """
    SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
    WHERE a = 1 OR used <= 1000
    """,
)
def budget_window(spark, sf_dir, budget: int = 1000):
    """The first turn and as many recent ones as the budget holds."""
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    placed = turns(spark, sf_dir).withColumns({"a": F.row_number().over(by_turn()), "used": used})
    return placed.where((F.col("a") == 1) | (F.col("used") <= budget)).select("conv_id", "turn")


@query(
    "ema_calibration",
    """
    WITH RECURSIVE v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS s FROM events UNION ALL
      SELECT r.user_id, v.k, floor(round(least(greatest(r.s * 0.7::DOUBLE + least(greatest(v.x, 1.0::DOUBLE), 8.0::DOUBLE) * (1 - 0.7::DOUBLE), 1.0::DOUBLE), 8.0::DOUBLE) * 1000, 6)) / 1000 FROM r JOIN v ON v.user_id = r.user_id AND v.k = r.k + 1)
    SELECT user_id, arg_max(s, k) AS calibration FROM r GROUP BY user_id
    """,
)
def ema_calibration(spark, sf_dir):
    """Each user's running calibration after all events."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("v")).select("user_id", sq.ema(F.col("v")).alias("calibration"))


@query("lag_inherit", "SELECT conv_id, turn, CASE WHEN length(text) < 200 AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) ELSE md5(text) END AS label FROM conversations")
def lag_inherit(spark, sf_dir):
    """A short entry takes the text of a user turn right before it."""
    take = (F.length("text") < 200) & (F.lag("role").over(by_turn()) == "user")
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(F.when(take, F.lag("text").over(by_turn())).otherwise(F.col("text"))).alias("label"))


@query(
    "lead_prefix_move",
    "SELECT conv_id, turn, split_part(text, ' ', 1) || ' ' || coalesce(split_part(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ', 1), '') AS heading FROM conversations WHERE true",
)
def lead_prefix_move(spark, sf_dir):
    """The first word of the next row moved behind this row's first word."""
    word = lambda c: F.substring_index(c, " ", 1)
    return turns(spark, sf_dir).select("conv_id", "turn", F.concat_ws(" ", word(F.col("text")), F.coalesce(word(F.lead("text").over(by_turn())), F.lit(""))).alias("heading"))


@query("heading_parent", """
    SELECT h.page, h.k, max(p.k) AS parent FROM (SELECT DISTINCT l_orderkey AS page, l_linenumber AS k, l_linenumber * 7 % 4 AS level FROM lineitem) h
    LEFT JOIN (SELECT DISTINCT l_orderkey AS page, l_linenumber AS k, l_linenumber * 7 % 4 AS level FROM lineitem) p ON p.page = h.page AND p.k < h.k AND p.level < h.level GROUP BY h.page, h.k
    """)
def heading_parent(spark, sf_dir):
    """The nearest earlier heading with a smaller level; one last-value window per level, no self-join."""
    headings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k")).distinct().withColumn("level", F.col("k") * 7 % 4)
    before = Window.partitionBy("page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    last = {v: F.last(F.when(F.col("level") == v, F.col("k")), ignorenulls=True).over(before) for v in range(3)}
    smaller = F.greatest(*[F.when(F.col("level") > v, last[v]) for v in last])
    return headings.select("page", "k", smaller.alias("parent"))


@query(
    "level_fold",
    """
    WITH RECURSIVE h AS (SELECT l_orderkey AS page, list(CAST(floor(l_quantity / 10) AS INT) ORDER BY l_linenumber, floor(l_quantity / 10)) AS h FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT page, h, 0 AS i, []::INT[] AS keys, []::INT[] AS lv, 0 AS level FROM h UNION ALL
      SELECT page, h, i + 1, CASE WHEN list_contains(keys, x) THEN keys ELSE list_append(keys, x) END, CASE WHEN list_contains(keys, x) THEN lv ELSE list_append(lv, now) END, now FROM (
        SELECT *, CASE WHEN list_contains(keys, x) THEN least(lv[list_position(keys, x)], level + 1) ELSE level + 1 END AS now FROM (SELECT *, h[i + 1] AS x FROM r WHERE i < len(h))))
    SELECT page, i - 1 AS place, h[i] AS size, level FROM r WHERE i > 0
    """,
)
def level_fold(spark, sf_dir):
    """Levels of headings by size: never more than one deeper than the heading before."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") / 10).cast("int").alias("size")))).alias("h"))
    return rows.select("page", F.posexplode(sq.levels(F.transform("h", lambda x: x["size"]))).alias("place", "x")).select("page", "place", "x.size", "x.level")


@query(
    "neighbourhood_score",
    """
    SELECT conv_id, turn, round(CASE WHEN a + b = 0 THEN 0.0 ELSE (a + b) / 6.0 END, 6)::DOUBLE AS score FROM (SELECT conv_id, turn,
      count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM conversations)
    """,
)
def neighbourhood_score(spark, sf_dir):
    """Anchors among the three rows before and after, over six."""
    hits = [F.count(F.when(F.col("role") == "user", 1)).over(by_turn().rowsBetween(*frame)) for frame in ((-3, -1), (1, 3))]
    return turns(spark, sf_dir).select("conv_id", "turn", F.round((hits[0] + hits[1]) / 6.0, 6).alias("score"))


@query(
    "common_prefix_suffix",
    """
    WITH p AS (SELECT source, doc_id, string_split(text, ' ') AS w FROM documents), t AS (SELECT source, count(*) AS docs, min(len(w)) AS shortest FROM p GROUP BY source),
    e AS (SELECT source, unnest(w) AS x, generate_subscripts(w, 1) AS k, len(w) AS n FROM p),
    f AS (SELECT source, k, count(DISTINCT x) AS d, count(*) AS m FROM e GROUP BY source, k), b AS (SELECT source, n - k + 1 AS k, count(DISTINCT x) AS d, count(*) AS m FROM e GROUP BY source, n - k + 1),
    a AS (SELECT t.source, t.shortest, coalesce((SELECT min(f.k) FROM f WHERE f.source = t.source AND (f.d > 1 OR f.m < t.docs)) - 1, t.shortest) AS prefix,
      coalesce((SELECT min(b.k) FROM b WHERE b.source = t.source AND (b.d > 1 OR b.m < t.docs)) - 1, t.shortest) AS suffix FROM t)
    SELECT source, prefix, least(suffix, greatest(shortest - prefix, 0)) AS suffix FROM a
    """,
)
def common_prefix_suffix(spark, sf_dir):
    """How many words all texts of a source share at their beginnings, and behind those at their ends."""
    return shared_ends(table(spark, sf_dir, "documents"))


def shared_ends(docs):
    """(source, prefix, suffix): words that all texts of a source share at their beginnings, and then at their ends.

    What the least and the greatest word list have in common, all lists between them have too.
    """
    words = docs.select("source", F.split("text", " ").alias("w")).withColumn("r", F.reverse("w"))
    sides = words.groupBy("source").agg(*[f(c).alias(f"{c}_{n}") for c in "wr" for n, f in (("least", F.min), ("most", F.max))], F.min(F.size("w")).alias("shortest"), (F.count("w") == F.count("*")).alias("whole"))

    def shared(c: str):
        unequal = F.array_position(F.zip_with(f"{c}_least", f"{c}_most", lambda a, b: a.eqNullSafe(b)), False)
        return F.when(F.col("whole"), F.when(unequal > 0, unequal - 1).otherwise(F.size(f"{c}_least"))).otherwise(0).cast("long")

    ends = sides.select("source", "shortest", shared("w").alias("prefix"), shared("r").alias("suffix"))
    return ends.select("source", "prefix", F.least("suffix", F.greatest(F.col("shortest") - F.col("prefix"), F.lit(0))).cast("long").alias("suffix"))


PAIRS = r"""SELECT conv_id, turn, a, b FROM (SELECT conv_id, turn, w AS a, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, string_split_regex(lower(text), '\s+') AS w FROM conversations)) WHERE b IS NOT NULL"""
LIS = "list_append(best, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] THEN best[j] ELSE 0 END)), 0))"


@query(
    "unique_anchor_join",
    f"""
    WITH RECURSIVE p AS ({PAIRS}), x AS (SELECT conv_id, turn, unnest(a) AS word, generate_subscripts(a, 1) AS k FROM p), y AS (SELECT conv_id, turn, unnest(b) AS word, generate_subscripts(b, 1) AS k FROM p),
    u AS (SELECT conv_id, turn, word, min(k) AS k FROM x GROUP BY ALL HAVING count(*) = 1), w AS (SELECT conv_id, turn, word, min(k) AS k FROM y GROUP BY ALL HAVING count(*) = 1),
    v AS (SELECT u.conv_id, u.turn, list(w.k ORDER BY u.k) AS v FROM u JOIN w ON u.conv_id = w.conv_id AND u.turn = w.turn AND u.word = w.word WHERE u.word <> '' GROUP BY u.conv_id, u.turn),
    r AS (SELECT conv_id, turn, v, 0 AS i, []::BIGINT[] AS best FROM v UNION ALL SELECT conv_id, turn, v, i + 1, {LIS} FROM r WHERE i < len(v))
    SELECT conv_id, turn, CAST(len(v) AS BIGINT) AS n_anchors, list_max(best) AS n_ordered FROM r WHERE i = len(v)
    """,
)
def unique_anchor_join(spark, sf_dir):
    """Words that stand exactly once in a turn and once in the next, and how many of them keep their order."""
    words = lambda side: pairs.select("conv_id", "turn", F.posexplode(side).alias("k", "word")).where("word <> ''").groupBy("conv_id", "turn", "word").agg(F.min("k").alias("k"), F.count("*").alias("n")).where("n = 1").drop("n")
    pairs = neighbours(spark, sf_dir)
    both = words("a").withColumnRenamed("k", "ka").join(words("b").withColumnRenamed("k", "kb"), ["conv_id", "turn", "word"])
    lists = both.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("ka", "kb"))), lambda x: x["kb"]).alias("v"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "n_anchors": [len(v) for v in batch["v"]], "n_ordered": [sq.lis_length(list(v)) for v in batch["v"]]})

    return lists.mapInPandas(run, "conv_id long, turn long, n_anchors long, n_ordered long")


#: Rows of an Arrow batch of word lists, which are Python objects in a task as long as the batch lasts.
LIST_ROWS = 400


def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(LIST_ROWS))


def neighbours(spark, sf_dir):
    """(conv_id, turn, a, b): the words of a turn and of the next."""
    small_batches(spark)
    words = F.split(F.lower("text"), "\\s+")
    return turns(spark, sf_dir).select("conv_id", "turn", words.alias("a"), F.lead(words).over(by_turn()).alias("b")).where("b IS NOT NULL")


def per_pair(spark, sf_dir, name: str, kind: str, fn):
    """``fn`` over each pair of neighbouring turns, in Arrow batches."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], name: [fn(list(a), list(b)) for a, b in zip(batch["a"], batch["b"])]})

    return neighbours(spark, sf_dir).mapInPandas(run, f"conv_id long, turn long, {name} {kind}")


LCS = """
    b AS (SELECT {key}, unnest(b) AS y, generate_subscripts(b, 1) AS j FROM p),
    r AS (SELECT {key}, 0 AS i, j, {zero} AS v FROM b UNION ALL
      SELECT {key}, i + 1, j, max(cand) OVER (PARTITION BY {key} ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
        SELECT r.*, greatest(r.v, coalesce(lag(r.v) OVER (PARTITION BY {rkey} ORDER BY r.j), 0) + {gain}) AS cand
        FROM r JOIN p USING ({key}) JOIN b USING ({key}, j) WHERE r.i < len(p.a))),
    m AS (SELECT {key}, max(v) AS v FROM r GROUP BY ALL)
    """
EQUAL = LCS.replace("{zero}", "0::BIGINT").replace("{gain}", "CASE WHEN p.a[r.i + 1] = b.y THEN 1 ELSE 0 END")
BY_TURN = lambda q: q.replace("{key}", "conv_id, turn").replace("{rkey}", "r.conv_id, r.turn")
BY_PAIR = lambda q: q.replace("{key}", "conv_id, i0, j0").replace("{rkey}", "r.conv_id, r.i0, r.j0")
PREFIX = "len(list_filter(range(1, least(length(p.a[r.i + 1]), length(b.y)) + 1), lambda k: p.a[r.i + 1][1:k] = b.y[1:k]))"
WEIGHTED = LCS.replace("{zero}", "0::DOUBLE").replace("{gain}", f"CASE WHEN {PREFIX} > 1 THEN 2::DOUBLE * {PREFIX} / (length(p.a[r.i + 1]) + length(b.y)) ELSE 0 END")


@query("lcs_length", f"WITH RECURSIVE p AS ({PAIRS}), {BY_TURN(EQUAL)} SELECT conv_id, turn, v AS lcs FROM m")
def lcs_length(spark, sf_dir):
    """Longest common subsequence of the words of neighbouring turns."""
    return per_pair(spark, sf_dir, "lcs", "long", sq.lcs_length)


@query("structural_similarity", f"WITH RECURSIVE p AS ({PAIRS}), {BY_TURN(EQUAL)} SELECT conv_id, turn, 2::DOUBLE * v / (len(a) + len(b)) AS similarity FROM m JOIN p USING (conv_id, turn)")
def structural_similarity(spark, sf_dir):
    """Common subsequence over the mean length."""
    return per_pair(spark, sf_dir, "similarity", "double", sq.similarity)


@query("lcs_weighted", f"WITH RECURSIVE p AS ({PAIRS}), {BY_TURN(WEIGHTED)} SELECT conv_id, turn, round(v, 6) AS score FROM m")
def lcs_weighted(spark, sf_dir):
    """Weighted alignment of the words of neighbouring turns; words score by their common beginning."""

    def score(x, y):
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return 2 * n / (len(x) + len(y)) if x and y and n > 1 else 0.0

    return per_pair(spark, sf_dir, "score", "double", lambda a, b: sq.lcs_weighted(a, b, score, key=lambda x: x[:2])).withColumn("score", F.round("score", 6))


@query(
    "score_matrix",
    rf"""
    WITH RECURSIVE w AS (SELECT conv_id, turn, string_split_regex(lower(text), '\s+') AS w FROM conversations), p AS (SELECT x.conv_id, x.turn AS i0, y.turn AS j0, x.w AS a, y.w AS b FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.turn < y.turn),
    {BY_PAIR(EQUAL)} SELECT conv_id, i0 AS i, j0 AS j, round(2::DOUBLE * v / (len(a) + len(b)), 6) AS score FROM m JOIN p USING (conv_id, i0, j0)
    """,
)
def score_matrix(spark, sf_dir):
    """Similarity of every two turns of a conversation; conversations are short."""
    small_batches(spark)
    words = F.split(F.lower("text"), "\\s+")
    left = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("i"), words.alias("a"))
    right = turns(spark, sf_dir).select("conv_id", F.col("turn").alias("j"), words.alias("b"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"conv_id": batch["conv_id"], "i": batch["i"], "j": batch["j"], "score": [sq.similarity(list(a), list(b)) for a, b in zip(batch["a"], batch["b"])]})

    scored = left.join(right, "conv_id").where("i < j").mapInPandas(run, "conv_id long, i long, j long, score double")
    return scored.withColumn("score", F.round("score", 6))


@query(
    "lis_length",
    f"""
    WITH RECURSIVE v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
    r AS (SELECT user_id, v, 0 AS i, []::BIGINT[] AS best FROM v UNION ALL SELECT user_id, v, i + 1, {LIS} FROM r WHERE i < len(v))
    SELECT user_id, list_max(best) AS lis FROM r WHERE i = len(v)
    """,
)
def lis_length(spark, sf_dir):
    """Longest increasing subsequence of each user's event values."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("v"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"user_id": batch["user_id"], "lis": [sq.lis_length(list(v)) for v in batch["v"]]})

    return rows.mapInPandas(run, "user_id long, lis long")


@query("anchored_segments")
def anchored_segments(spark, sf_dir):
    """Neighbouring turns aligned between the words that anchor both: segments, and words aligned in all of them."""

    def run(batches):
        for batch in batches:
            found = [sq.anchored_alignment(list(a), list(b)) for a, b in zip(batch["a"], batch["b"])]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "n_segments": [n for n, _ in found], "n_aligned": [len(m) for _, m in found]})

    return neighbours(spark, sf_dir).mapInPandas(run, "conv_id long, turn long, n_segments long, n_aligned long")


@query("anchored_alignment")
def anchored_alignment(spark, sf_dir):
    """Neighbouring turns aligned between the words that anchor both: each matched pair of places, from 0."""

    def run(batches):
        for batch in batches:
            for conv, turn, a, b in zip(batch["conv_id"], batch["turn"], batch["a"], batch["b"]):
                matched = sq.anchored_alignment(list(a), list(b))[1]
                yield pd.DataFrame({"conv_id": conv, "turn": turn, "a_place": [i for i, _ in matched], "b_place": [j for _, j in matched]}).astype({"a_place": "int64", "b_place": "int64"})

    return neighbours(spark, sf_dir).mapInPandas(run, "conv_id long, turn long, a_place long, b_place long")


@query("common_runs")
def common_runs(spark, sf_dir):
    """Runs of three or more words that all turns of a conversation hold in order."""
    small_batches(spark)
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.split(F.lower("text"), "\\s+").alias("w")))), lambda t: t["w"]).alias("lists"))

    def run(batches):
        for batch in batches:
            runs = [sq.common_runs([list(x) for x in lists]) for lists in batch["lists"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "n_runs": [len(r) for r in runs], "longest": [max(map(len, r), default=0) for r in runs]})

    return rows.mapInPandas(run, "conv_id long, n_runs long, longest long")


@query(
    "set_cover",
    """
    WITH RECURSIVE b AS (SELECT a || '-' || z AS name, range(a, z + 1) AS s, row_number() OVER (ORDER BY z - a DESC, a || '-' || z) AS rank FROM range(1, 8) t(a), range(1, 8) u(z) WHERE z BETWEEN a AND least(a + 2, 7)),
    o AS (SELECT l_orderkey AS row_id, list_sort(list(DISTINCT l_linenumber::BIGINT)) AS s FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT DISTINCT s, []::BIGINT[] AS done, []::BIGINT[] AS ranks, []::VARCHAR[] AS names FROM o UNION ALL
      SELECT r.s, list_concat(r.done, b.s), list_append(r.ranks, b.rank), list_append(r.names, b.name) FROM r JOIN b ON list_contains(b.s, list_min(list_filter(r.s, lambda x: NOT list_contains(r.done, x))))
        AND len(list_intersect(b.s, r.s)) = len(b.s) AND len(list_intersect(b.s, r.done)) = 0),
    k AS (SELECT s, names FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY len(ranks), ranks) AS n FROM r WHERE len(done) = len(s)) WHERE n = 1)
    SELECT row_id, array_to_string(list_sort(k.names), ',') AS cover FROM o LEFT JOIN k ON o.s = k.s
    """,
)
def set_cover(spark, sf_dir):
    """For each order the fewest disjoint bundles that make up its line numbers; null where none do."""
    bundles = {f"{a}-{b}": frozenset(range(a, b + 1)) for a in range(1, 8) for b in range(a, min(a + 2, 7) + 1)}
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_set("l_linenumber").alias("s"))

    def run(batches):
        for batch in batches:
            covers = [sq.set_cover(frozenset(int(x) for x in s), bundles) for s in batch["s"]]
            yield pd.DataFrame({"row_id": batch["row_id"], "cover": [None if c is None else ",".join(sorted(c)) for c in covers]})

    return rows.mapInPandas(run, "row_id long, cover string")


@query(
    "state_merge",
    r"""
    WITH w AS (SELECT DISTINCT role, conv_id, word FROM (SELECT role, conv_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM conversations)),
    n AS (SELECT role, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT role, count(DISTINCT conv_id) AS m FROM conversations GROUP BY role)
    SELECT role, count(*) FILTER (WHERE n = m) AS hoisted, count(*) FILTER (WHERE n < m) AS conditional FROM n JOIN s USING (role) GROUP BY role
    """,
)
def state_merge(spark, sf_dir):
    """States of a role path merged: words that every state has are hoisted, the rest stays conditional."""
    words = turns(spark, sf_dir).select("role", "conv_id", F.explode(F.array_distinct(F.split(F.lower("text"), "\\s+"))).alias("word"))
    states = turns(spark, sf_dir).groupBy("role").agg(F.count_distinct("conv_id").alias("n_states"))
    counts = words.groupBy("role", "word").agg(F.count_distinct("conv_id").alias("n"))
    return counts.join(states, "role").groupBy("role").agg(F.count(F.when(F.col("n") == F.col("n_states"), 1)).alias("hoisted"), F.count(F.when(F.col("n") < F.col("n_states"), 1)).alias("conditional"))


@query(
    "lang_guess",
    r"""
    SELECT doc_id, list_sort([{'n': len(list_filter(w, lambda x: x IN ('der', 'die', 'das', 'und', 'den', 'von', 'ist'))), 'l': 'de'}, {'n': len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'in', 'is', 'that'))), 'l': 'en'},
      {'n': len(list_filter(w, lambda x: x IN ('de', 'la', 'que', 'el', 'en', 'los', 'las'))), 'l': 'es'}, {'n': len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des', 'du', 'une', 'est'))), 'l': 'fr'}], 'DESC')[1].l AS guess
    FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}]+') AS w FROM documents)
    """,
)
def lang_guess(spark, sf_dir):
    """Language of visible text by counts of frequent words; ties go to the last in order."""
    common = {"de": "der die das und den von ist", "en": "the and of to in is that", "es": "de la que el en los las", "fr": "le la les des du une est"}
    words = F.split(F.lower("text"), "[^\\p{L}]+")
    scores = []
    for lang, listed in common.items():
        scores.append(F.struct(F.size(F.filter(words, _in(listed.split()))).alias("n"), F.lit(lang).alias("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_max(F.array(*scores))["lang"].alias("guess"))


def _in(listed: list[str]):
    return lambda w: w.isin(listed)


@query(
    "uuid5",
    """
    SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS id
    FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
    """,
)
def uuid5(spark, sf_dir):
    """Version-5 identifiers of page addresses in the namespace of addresses; null without one."""
    return table(spark, sf_dir, "pages").select("page_id", tx.uuid5(F.col("url")).alias("id"))
