import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.queries import op1_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Brute force: the fewest bins, by trying every assignment of small instances."""
    for n in range(1, len(lengths) + 1):
        for where in itertools.product(range(n), repeat=len(lengths)):
            fill = [0] * n
            for size, b in zip(lengths, where):
                fill[b] += size
            if max(fill) <= capacity:
                return n
    return 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 13, rng.integers(1, 7))
        best = fewest(lengths.tolist(), 12)
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 12)
        assert packing.lower_bound(lengths, 12) <= best <= len(fill) and fill.max() <= 12 and fill.sum() == lengths.sum()
        for b in range(len(fill)):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
    assert packing.lower_bound(np.full(5, 7), 12) == 5 and packing.lower_bound(np.array([5] * 5), 12) == 3


def check(rows, capacity):
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    rows = op1_packing(spark, sf).collect()
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(own) == len(docs)
    for d in docs:
        ids = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(own[d.doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in parts] == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert check(rows, 2048) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_groups_exchange_gaps(spark):
    rng = np.random.default_rng(9)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 60, 3000))]
    items = spark.createDataFrame(rows, packing.PIECES)
    alone = packing.pack_pieces(items, 100, rounds=0, group_tokens=5_000).collect()
    better = packing.pack_pieces(items, 100, group_tokens=5_000).collect()
    assert len(better) == 3000 and check(better, 100) <= check(alone, 100)
    assert check(better, 100) <= packing.lower_bound(np.array([r[3] for r in rows]), 100) + 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "a b", 7), (3, "same words", 7), (3, "same words", 7), (4, "long " * 5000, 7)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, "doc_id", "text", PATH).collect()
    assert check(rows, 2048) == 3
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id in (1, 2, 3)) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert sum(r.length for r in rows if r.doc_id == 4) == 5001
    assert packing.pack_documents(docs.limit(0), "doc_id", "text", PATH).count() == 0


def test_exchange_saves_where_the_bound_leaves_room():
    saved = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        for low, high, n in ((1, 2049, 200), (300, 1200, 100), (300, 1200, 1_500)):
            lengths = rng.integers(low, high, n)
            bins, _, fill = packing.best_fit_decreasing(lengths, 2048)
            bound = packing.lower_bound(lengths, 2048)
            again = packing.exchange(lengths, bins, 2048, bound)
            offsets, filled = packing.placed(lengths, again)
            assert bound <= len(filled) <= len(fill) and filled.max() <= 2048 and set(again) == set(range(len(filled)))
            for b in range(len(filled)):  # gapless from 0
                at = np.flatnonzero(again == b)
                at = at[np.argsort(offsets[at])]
                assert offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
            assert (packing.exchange(lengths, bins, 2048, bound) == again).all()  # the same each time
            saved += len(fill) - len(filled)
    assert saved >= 10


def test_fullest_sets_equal_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(7)
    for _ in range(200):
        lengths = rng.integers(1, 20, rng.integers(1, 9))
        bins = packing.fullest(lengths, 30, np.argsort(-lengths, kind="stable"))
        first = [k for k in range(len(lengths)) if bins[k] == 0]
        head, rest = int(lengths.max()), np.delete(lengths, int(np.argsort(-lengths, kind="stable")[0])).tolist()
        best = max(sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if head + sum(c) <= 30)
        assert lengths[first].sum() == head + best


def test_exchange_of_nothing_and_of_full_sequences():
    none = np.zeros(0, np.int64)
    assert len(packing.exchange(none, none, 10, 0)) == 0 and [len(x) for x in packing.placed(none, none)] == [0, 0]
    full = np.full(5, 10)
    assert packing.exchange(full, np.arange(5), 10, 5).tolist() == [0, 1, 2, 3, 4]


def test_other_columns_repeated_rows_and_empty_tables(spark):
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id long, text string, Piece int, `a.b` string")
    rows = packing.pack_documents(df, "doc_id", "text", tokenizer).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.pack_documents(df.where("false"), "doc_id", "text", tokenizer).collect() == []
