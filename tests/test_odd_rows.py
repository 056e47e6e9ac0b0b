"""Queries against their SQL on tables that the test data lacks: nulls, ties, wide value ranges."""

import math
import os
import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quillspark.operators import sequences, sketches
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.plans import catalog
from quillspark.plans import sequences as plans

LINES = "l_orderkey long, l_linenumber int, l_quantity double"


def against_sql(spark, folder, name, rows, schema, source):
    """(rows of the query, rows of its SQL), each sorted, over one table."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{source}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(f'''\"{c}\"''' for c in df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want))


#: Places without a start, without an end, without either, repeated, and equal up to the node.
EXTENTS = [(1, 1, None), (1, 2, None), (1, 1, 4.0), (1, None, 4.0), (1, None, 4.0), (1, 2, 5.0), (1, 3, 40.0), (1, 3, 40.0), (2, None, 7.0), (2, 1, 7.0), (2, 1, 7.5), (3, 2, math.nan), (3, 1, 1.0), (None, 1, 1.0), (None, 2, 3.0)]


def test_gap_clusters_without_extents(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "gap_cluster", EXTENTS, LINES, "lineitem")
    assert got == want


def test_merged_intervals_without_extents(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "merge_intervals", EXTENTS, LINES, "lineitem")
    assert got == want


def test_rollup_beyond_the_sketches(spark, tmp_path):
    """More users and values than the sketches hold, repeated values, nulls in each column, a group without values."""
    rng = random.Random(3)
    day = datetime(2024, 1, 1)
    rows = [(k, day + timedelta(days=k % 3), k if k % 50 else None, None if k % 7 == 0 else "ab"[k % 2], None if k % 11 == 0 else 5.0 if k % 9 == 0 else rng.random()) for k in range(90_000)]
    rows += [(k, None, 1, "none", None) for k in range(5)] + [(k, day, 2, "one", math.nan if k else 1.0) for k in range(3)]
    got, want = against_sql(spark, tmp_path, "sketch_rollup", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "events")
    assert got == want


def test_wrong_brackets_are_opened(spark, monkeypatch):
    """Brackets that miss their quantile, here those of the sketch's median shifted away, cost time but no result."""
    ensure_checkpoint_dir(spark)
    df = spark.range(50_001).select(F.lit("x").alias("a"), F.col("id").alias("item"), F.col("id").cast("double").alias("number"))
    monkeypatch.setattr(sketches, "BRACKET", -0.2)
    assert [tuple(r) for r in sketches.exact_rollup(df, [["a"], []], ["a"], "item", "number", {"median": 0.5}).orderBy("grouping").collect()] == [("x", 0, 50_001, 50_001, 25_000.0), (None, 1, 50_001, 50_001, 25_000.0)]
    empty = sketches.exact_rollup(df.where("false"), [["a"], []], ["a"], "item", "number", {"median": 0.5}).collect()
    assert [tuple(r) for r in empty] == [(None, 1, 0, 0, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_path_expressions_do_not_gather_names(spark):
    """Elements of one name, a hot key, are not shuffled together, and pages are parsed once."""
    found = plan(catalog.QUERIES["path_expressions"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning" not in found and found.count("MapInArrow") == 1


def parses(monkeypatch, name, spark):
    """How often the plan of a query and the checkpoints that it writes parse the pages."""
    plans, write = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **k: (plans.append(plan(df)), write(df, *a, **k))[1])
    plans.append(plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")))
    return sum(p.count("MapInArrow") for p in plans)


def test_scope_walk_parses_once(spark, monkeypatch):
    assert parses(monkeypatch, "scope_walk", spark) == 1


def test_violations_parse_once(spark, monkeypatch):
    assert parses(monkeypatch, "xml_violations", spark) == 1


def test_weighted_alignment_scores_few_pairs():
    """The table of all pairs, with each two distinct words that share their key scored once."""
    rng = random.Random(4)
    score = lambda x, y: 2 * n / (len(x) + len(y)) if (n := len(os.path.commonprefix([x, y]))) > 1 else 0.0
    for _ in range(60):
        a, b = ([rng.choice(["", "a", "ab", "abc", "abcd", "bc", "bcd", "bd"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + score(x, y))
        assert sequences.lcs_weighted(a, b, score) == sequences.lcs_weighted(a, b, score, key=lambda x: x[:2]) == table[-1][-1]
    calls = []
    a, b = ([f"w{k % 5}" for k in range(200)], [f"{'wv'[k % 2]}{k % 5}" for k in range(200)])
    assert sequences.lcs_weighted(a, b, lambda x, y: calls.append(1) or score(x, y), key=lambda x: x[:1]) > 0 and len(calls) == 25  # not 40,000


def test_word_lists_come_in_small_batches(spark, monkeypatch):
    """What a task holds as Python objects does not grow with its rows."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name in ("score_matrix", "common_runs", "lcs_length"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 400
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_common_runs_stop_at_the_first_list_without_any(monkeypatch):
    calls, align = [], sequences.lcs_pairs
    monkeypatch.setattr(sequences, "lcs_pairs", lambda a, b: (calls.append(1), align(a, b))[1])
    assert sequences.common_runs([list("abc"), list("xyz"), *[list("abc")] * 50]) == [] and len(calls) == 1


def test_list_runs_spread_with_their_rows(spark, monkeypatch):
    """Tasks grow in number with the input, so that none sorts more than its share."""
    monkeypatch.setattr(plans, "TASK_ROWS", 500)
    df = catalog.QUERIES["list_runs"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(page#" in plan(df) and f", {-(-spark.read.parquet('/root/testdata/sf0.001/lineitem.parquet').count() // 500)}), REPARTITION_BY_NUM" in plan(df)
