"""Micro cases of the operators and functions."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedding as em
from quillspark.functions import text as tx
from quillspark.operators import graph, layout, sequences
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.sources import files
from quillspark.streaming import windows


def one(spark, fn, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in rows.select("k", fn(F.col("t")).alias("v")).orderBy("k").collect()]


def test_text_functions(spark):
    assert one(spark, tx.is_placeholder, "...............", "  ..........  ", "………", "——————————", "..", "-", "Name: ...........", "   ") == [True] * 4 + [False] * 4
    assert one(spark, tx.inline_date, "Löschung ab: 01..1", "01. .", "Date: 01.12.2024") == ["01..1", "01. .", ""]
    assert one(spark, tx.name_prefix, "TXT_FirstName_ab12cd34", "bareName") == ["TXT", "bareName"]
    assert one(spark, lambda t: tx.contact_kind(t, F.lit("")), "E-Mail / Telefon", "Telefonnummer privat", "Mobiltelefon", "Telefon") == ["email", "none", "none", "phone"]
    assert one(spark, tx.list_marker, "- a", "1. a", "1) a", "1.2.3 a", "a. a", "iv. a", "(i) a", "(b) a", "word") == ["bullet", "numeric", "numeric", "multilevel", "letter", "roman", "paren_roman", "paren", "none"]
    assert one(spark, tx.normalize, "a <b>b</b>  c<unclosed", "x > y") == ["a b c", "x y"]
    assert one(spark, tx.sql_quote, "it's", "a\tb\\") == ["'it''s'", "e'a\\tb\\\\'"]
    assert one(spark, tx.dimension_points, "10mm", "1in", "5", "x") == [pytest.approx(28.34645669291339), 72.0, 5.0, None]
    assert one(spark, em.fix_mojibake, "â‚¬ 100.000", "clean") == ["€ 100.000", "clean"]
    assert one(spark, em.jcr_list, "[a\\,b, c,,d]", "x") == [["a,b", "c", "d"], ["x"]]


def test_blob_round_trip(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = rows.select(em.from_blob(F.concat(em.to_blob("v"), F.lit(b"x"))).alias("v")).collect()
    assert [r.v for r in got] == [[1.5, -2.0], None]


@pytest.mark.parametrize("weights,spans", [([100, 200], [4, 8]), ([100, 100, 200], [3, 3, 6]), ([50, 150], [3, 9]), ([100, 100, 100, 300], [2, 2, 2, 6]), ([10, 590], [1, 11])])
def test_largest_remainder(spark, weights, spans):
    rows = spark.createDataFrame([(1, k, float(w)) for k, w in enumerate(weights)], "g int, k int, w double")
    assert [r.span for r in layout.largest_remainder(rows, ["g"], ["k"], "w", 12).orderBy("k").collect()] == spans


def test_leader_and_gap_clusters(spark):
    rows = spark.createDataFrame([(1, float(v), v + 1.0) for v in (0, 4, 6, 20)], "g int, v double, e double")
    assert [(r.leader, r.n) for r in layout.leader_clusters(rows, ["g"], "v", 5.0).orderBy("leader").collect()] == [(0.0, 2), (6.0, 1), (20.0, 1)]
    assert [r.n for r in layout.merge_intervals(rows, ["g"], "v", "e", 3.0).orderBy("v").collect()] == [3, 1]


def test_sequences(spark):
    assert sequences.lcs_length(list("ABCBDAB"), list("BDCABA")) == 4 and sequences.lcs_length([], [1]) == 0
    assert sequences.lis_length([3, 1, 2, 2, 5, 4]) == 3
    assert sequences.similarity([], []) == 1.0 and sequences.similarity([1], []) == 0.0
    assert sequences.lcs_weighted([1, 2], [2, 1], lambda a, b: float(a == b)) == 1.0
    assert sequences.common_runs([list("xabcy"), list("abcz"), list("qabc")]) == [list("abc")]
    assert sequences.set_cover(frozenset({1, 2, 3}), {"a": frozenset({1, 2}), "b": frozenset({3}), "c": frozenset({2, 3})}) == ["a", "b"]
    assert sequences.set_cover(frozenset({1, 2}), {"a": frozenset({1})}) is None
    rows = spark.createDataFrame([([20, 16, 12, 16, 12, 10],)], "v array<int>")
    assert [x.level for x in rows.select(sequences.levels(F.col("v")).alias("x")).first().x] == [1, 2, 3, 2, 3, 4]


def test_sequences_of_whole_texts(spark, tmp_path):
    from quillspark.plans import catalog

    lead, tail = [f"p{k}" for k in range(60)], [f"s{k}" for k in range(70)]
    texts = [("a", [*lead, "x", *tail]), ("a", [*lead, "y", "z", *tail]), ("b", lead), ("b", lead + lead), ("c", lead), ("c", None), ("d", ["only"]), ("e", ["q"]), ("e", ["r"])]
    rows = [(k, s, None if t is None else " ".join(t)) for k, (s, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    shared = {r.source: (r.prefix, r.suffix) for r in catalog.QUERIES["common_prefix_suffix"](spark, str(tmp_path)).collect()}
    assert shared == {"a": (60, 70), "b": (60, 0), "c": (0, 0), "d": (1, 0), "e": (0, 0)}
    first, second = [f"u{k}" for k in range(130)], [f"v{k}" for k in range(130)]
    turns = [(1, k, "user", " ".join([*own, "one", "two", "three", "four"])) for k, own in enumerate((first, second))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert catalog.QUERIES["common_runs"](spark, str(tmp_path)).select("n_runs", "longest").first() == (1, 4)
    assert catalog.QUERIES["lcs_weighted"](spark, str(tmp_path)).first().score == 4.0


def test_graph(spark):
    ensure_checkpoint_dir(spark)
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(10, 9)], "a long, b long")
    got = dict(graph.connected_components(nodes, edges).collect())
    assert got[8] == 0 and got[10] == 9 and got[11] == 11
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    reach = {(r.node, r.depth) for r in graph.reachable(cycle, nodes.where("node = 1")).collect()}
    assert reach == {(2, 1), (3, 2)}


def test_sources(spark, tmp_path):
    for name in ("ABCD_001_DE.pdf", "ABCD_001_EN.pdf", "odd.pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r.form, r.languages) for r in files.discover_forms(spark, str(tmp_path)).collect()] == [("ABCD", ["DE", "EN"])]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a/b.txt", "hello")
    assert [(r.member, bytes(r.content)) for r in files.read_zip_members(spark, str(tmp_path)).collect()] == [("a/b.txt", b"hello")]
    scores = spark.createDataFrame([("A", "ok", 1.0, 1.0, 1.0, 0.5, 0.5), ("B", "failed", 0.0, 0.0, 0.0, 0.0, 0.0)], "form_code string, status string, translation_rating double, missing_translation_score double, semantic_match_score double, labelled_fields_score double, total_score double")
    files.write_scores(scores, str(tmp_path / "scores"))
    assert {r.form_code: r.total_score for r in files.read_scores(spark, str(tmp_path / "scores")).collect()} == {"A": 0.5, "B": 0.0, "AVERAGE": 0.25}


def test_streams_match_batch(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    os.symlink("/root/testdata/sf0.001/events.parquet", tmp_path / "in/events.parquet")
    stream = windows.event_stream(spark, str(tmp_path / "in"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    got = windows.run_to_table(windows.tumbling_counts(stream), "tumbling", "complete", str(tmp_path / "c1"))
    assert sorted((r.window.start, r.event_type, r.n) for r in got.collect()) == sorted((r.window.start, r.event_type, r.n) for r in windows.tumbling_counts(batch).collect())
    from quillspark.plans.stream import repeat_watch

    got = windows.run_to_table(windows.repeat_watch(stream), "watch", "append", str(tmp_path / "c2"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in repeat_watch(spark, "/root/testdata/sf0.001").select("user_id", "event_id", "event_type").collect())
    windows.run_to_files(windows.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
