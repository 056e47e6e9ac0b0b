"""Alignment between anchors, hoisting, ordered modules, numbering and containment against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import compare, graph, modules
from quillspark.operators import sequences as sq
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.plans import catalog


def lcs(a, b):
    best = 0
    for n in range(len(a), 0, -1):
        for take in itertools.combinations(range(len(a)), n):
            rest = iter(b)
            if all(any(x == y for y in rest) for x in (a[k] for k in take)):
                return n
    return best


def test_alignment_kernels():
    rng = random.Random(8)
    for _ in range(150):
        a = [rng.choice("abcde") for _ in range(rng.randrange(8))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(8))]
        pairs = sq.lcs_pairs(a, b)
        assert len(pairs) == lcs(a, b) == sq.lcs_length(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        values = [rng.randrange(6) for _ in range(rng.randrange(9))]
        chosen = sq.increasing(values)
        assert len(chosen) == sq.lis_length(values) and all(values[p] < values[q] and p < q for p, q in zip(chosen, chosen[1:]))


def test_anchored_alignment():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
        segments, matched = sq.anchored_alignment(a, b)
        assert all(a[i] == b[j] for i, j in matched) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(matched, matched[1:]))
        assert segments - 1 <= len(matched) <= sq.lcs_length(a, b)
    assert sq.anchored_alignment(list("xaybz"), list("1a2b3")) == (3, [(1, 1), (3, 3)])
    assert sq.anchored_alignment([], ["a"]) == (1, [])


def test_hoist(spark):
    rows = [("r", "a", "x", 1), ("r", "a", "y", 1), ("r", "b", "z", 1), ("r", "a", "x", 2), ("r", "b", "z", 3), ("r", "b", "w", None)]
    got = {tuple(r) for r in graph.hoist(spark.createDataFrame(rows, "root string, mid string, leaf string, v int"), ["root", "mid", "leaf"], "v").collect()}
    # 1 stands in x and y of a, so it is a's; in b the leaf w lacks it, so it stays with z and does not reach the root
    assert got == {("mid", "r/a", 1), ("leaf", "r/a/x", 2), ("leaf", "r/b/z", 1), ("leaf", "r/b/z", 3)}
    alone = graph.hoist(spark.createDataFrame(rows[:3], "root string, mid string, leaf string, v int"), ["root", "mid", "leaf"], "v")
    assert {tuple(r) for r in alone.collect()} == {("root", "r", 1)}


def test_modules_claim_in_order(spark):
    nodes = spark.createDataFrame([(1, 1, "s", "head"), (1, 2, "s", "note"), (2, 1, "s", "head"), (2, 2, "s", None)], "doc long, n int, src string, line string")
    chain = [
        modules.RowModule("first", F.when(F.col("line") == "note", "a")),
        modules.SetModule("repeats", modules.repeated_nodes("src", "doc", "line", ["doc", "n"])),
        modules.RowModule("rest", F.when(F.col("line").isNotNull(), "b")),
    ]
    got = {(r.doc, r.n): (r.module, r.kind) for r in modules.run_modules(nodes, chain, ["doc", "n"]).collect()}
    assert got == {(1, 1): ("repeats", "repeated"), (2, 1): ("repeats", "repeated"), (1, 2): ("first", "a"), (2, 2): (None, None)}
    assert modules.run_modules(nodes.limit(0), chain, ["doc", "n"]).count() == 0


def test_number_rows_over_many_partitions(spark):
    ensure_checkpoint_dir(spark)
    rows = [("hot", k * 7919 % 3000) for k in range(3000)] + [("cold", 5), ("cold", 2), (None, 1)]
    got = sq.number_rows(spark.createDataFrame(rows, "g string, k int").repartition(7), ["g"], ["k"], "place").collect()
    want = {}
    for g in ("hot", "cold", None):
        want |= {(g, k): n for n, k in enumerate(sorted(k for x, k in rows if x == g), 1)}
    assert {(r.g, r.k): r.place for r in got} == want and len(got) == len(rows)


def test_contained_values(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK_NEEDLES", 2)
    needles = spark.createDataFrame([("ab",), ("b c",), ("zz",), ("",), (None,), ("ab",)], "t string")
    hay = spark.createDataFrame([("xaby",), ("b c",), (None,), ("",)], "t string")
    assert {r.t for r in compare.contained_values(needles, hay, "t").collect()} == {"ab", "b c", ""}
    assert compare.contained_values(needles.limit(0), hay, "t").count() == 0


def test_deep_closures_are_an_error(spark):
    ensure_checkpoint_dir(spark)
    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(chain, start).count() == 6
    with pytest.raises(RuntimeError):
        graph.reachable(chain, start, most_depth=3)


def test_buckets_of_names_are_all_met(spark):
    got = {r.bucket for r in catalog.QUERIES["naming_bucket"](spark, "/root/testdata/sf0.01").select("bucket").distinct().collect()}
    assert got == {"ok", "wrong_prefix", "raw"}
