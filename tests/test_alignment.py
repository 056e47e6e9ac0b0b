"""Alignment kernels against full tables, and the queries over them against the kernels of a plain table."""

import random
import re

from quillspark.operators import sequences as sq
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def walked(a, b):
    """Matched places by a full table of suffix lengths, walked from the front; what a has more of goes first."""
    n = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            n[i, j] = 1 + n[i + 1, j + 1] if a[i] == b[j] else max(n[i + 1, j], n[i, j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif n[i + 1, j] >= n[i, j + 1]:
            i += 1
        else:
            j += 1


def runs_by_position(lists, least=3):
    """Runs by trying every start of the first list."""
    found = [dict(walked(lists[0], other)) for other in lists[1:]]
    kept = [i for i in range(len(lists[0])) if all(i in f for f in found)]
    out, k = [], 0
    while k < len(kept):
        n = 1
        while k + n < len(kept) and kept[k + n] == kept[k] + n and all(f[kept[k] + n] == f[kept[k]] + n for f in found):
            n += 1
        if n >= least:
            out.append(lists[0][kept[k] : kept[k] + n])
        k += n
    return out


def test_pairs_and_runs_equal_full_tables():
    rng = random.Random(1)
    for _ in range(600):
        lists = [[rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 4))]
        assert sq.lcs_pairs(lists[0], lists[-1]) == list(walked(lists[0], lists[-1]))
        assert sq.common_runs(lists) == runs_by_position(lists) and sq.common_runs(lists, 1) == runs_by_position(lists, 1)


def test_long_lists_need_little_memory():
    import tracemalloc

    rng = random.Random(2)
    a, b = ([rng.randrange(300) for _ in range(6_000)] for _ in range(2))
    tracemalloc.start()
    pairs = sq.lcs_pairs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == sq.lcs_length(a, b) and peak < 20_000_000  # a table of numbers takes 36 million entries


def conversations(spark):
    out = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.turn, re.split(r"\s+", r.text.lower())))
    return out


def test_query_of_common_runs(spark):
    got = {r.conv_id: (r.n_runs, r.longest) for r in catalog.QUERIES["common_runs"](spark, SF).collect()}
    want = {c: runs_by_position([w for _, w in turns]) for c, turns in conversations(spark).items()}
    assert got == {c: (len(runs), max(map(len, runs), default=0)) for c, runs in want.items()}


def test_query_of_anchored_alignment(spark):
    """Segments between words that stand once on both sides, in the longest order, are aligned one by one."""
    got, counts = {}, {(r.conv_id, r.turn): r.n_aligned for r in catalog.QUERIES["anchored_segments"](spark, SF).collect()}
    for r in catalog.QUERIES["anchored_alignment"](spark, SF).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.a_place, r.b_place))
    for c, turns in conversations(spark).items():
        for (turn, a), (_, b) in zip(turns, turns[1:]):
            pairs = sorted(got.get((c, turn), []))
            assert len(pairs) == counts[c, turn] and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
            kept = [p for p in once if p in pairs]
            assert len(kept) == sq.lis_length([j for _, j in once])  # a longest run of anchors is in the alignment
            edges = [(-1, -1), *kept, (len(a), len(b))]
            for (i, j), (x, y) in zip(edges, edges[1:]):
                inside = [(p - i - 1, q - j - 1) for p, q in pairs if i < p < x]
                assert inside == list(walked(a[i + 1 : x], b[j + 1 : y]))
