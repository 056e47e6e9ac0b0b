"""Cases that went wrong before: repeated and null keys, ties in rounding, null addresses."""

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.modules import RowModule, SetModule, repeated_nodes, run_modules


def test_modules_claim_repeated_and_null_keys_once(spark):
    rows = [(1, 1, "s", "x"), (1, 1, "s", "x"), (1, 1, "s", "x"), (2, 1, "s", "x"), (None, 1, "s", "x"), (3, 1, "s", "y")]
    nodes = spark.createDataFrame(rows, "doc_id int, n int, source string, line string")
    done = run_modules(nodes, [SetModule("furniture", repeated_nodes("source", "doc_id", "line", ["doc_id", "n"])), RowModule("rest", F.lit("text"))], ["doc_id", "n"])
    got = sorted(((r.doc_id, r.module) for r in done.collect()), key=str)
    assert got == sorted([(1, "furniture")] * 3 + [(2, "furniture"), (None, "furniture"), (3, "rest")], key=str)


def test_modules_with_a_null_group(spark):
    nodes = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "s", "x")], "doc_id int, source string, line string")
    done = run_modules(nodes, [SetModule("furniture", repeated_nodes("source", "doc_id", "line", ["doc_id"]))], ["doc_id"])
    assert {r.doc_id: r.module for r in done.collect()} == {1: "furniture", 2: "furniture", 3: None}


def test_uuid5_equals_the_library(spark):
    names = ["http://a.example/", "", "é", "x" * 500, None]
    got = spark.createDataFrame([(n,) for n in names], "url string").select(tx.uuid5(F.col("url"))).collect()
    assert [r[0] for r in got] == [n if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_edits_of_repeated_and_null_ids(spark, tmp_path):
    from quillspark.plans import catalog

    rows = [(3, "s", "de"), (3, "s", "de"), (7, "s", "en"), (None, "s", "fr"), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["path_replace"](spark, str(tmp_path)).select("source", "doc_id", "value", "ord").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("s", 3, "replaced", 1), ("s", 3, "replaced", 2), (None, 5, None, 1)], key=str)


def test_scores_round_ties_up(spark, tmp_path):
    from quillspark.plans import catalog

    a, b = " ".join(f"a{k}" for k in range(128)), " ".join(["a0", *[f"b{k}" for k in range(127)]])
    spark.createDataFrame([(1, 0, "user", a), (1, 1, "user", b)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.score for r in catalog.QUERIES["score_matrix"](spark, str(tmp_path)).collect()] == [0.007813]
