import itertools

import numpy as np

from quillspark.llm import near_dedup
from quillspark.llm.components import components
from quillspark.llm.queries import op5_minhash_dedup


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def classes(texts):
    """Brute force: smallest id of each component of pairs at 0.8 or more."""
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {k: grams(t or "") for k, t in texts.items()}
    index = {}
    for k, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(k)
    seen = set()
    for ids in index.values():
        for a, b in itertools.combinations(ids, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                same = len(sets[a] & sets[b])
                if same >= 0.8 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: find(k) for k in texts}


def test_documents_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in op5_minhash_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == classes(texts)


def test_chain_of_near_copies_and_edges(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):  # each differs from its neighbour, the ends have little in common
        words = words[3:] + [f"n{k}_{j}" for j in range(3)]
        rows.append((100 + k, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "a b"), (4, "A  b "), (5, "a c"), (None, "a b"), (3, "a b")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, class_id int")
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()}
    assert {c for d, c in got if d and d >= 100} == {100}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, 3)} <= got
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_first(df).collect()) == [0, 1, 3, 5, 100]


def family(rng, many, pairs, size=400, own=6):
    """Texts that each replace ``own`` places of one base, so that no two are near copies, and near copies of a few."""
    base = [f"b{k}" for k in range(size)]
    texts = {}
    for k in range(many):
        words = list(base)
        for p in rng.choice(size // 6, own, replace=False):
            words[6 * p] = f"u{k}_{p}"
        texts[k] = words
    for k in range(pairs):  # a lighter edit, of the last words of text k
        texts[1000 + k] = texts[k][:-42] + [f"e{k}_{j}" for j in range(42)]
    return {k: " ".join(w) for k, w in texts.items()}


def test_every_pair_of_a_partly_similar_family_is_verified(spark, monkeypatch):
    texts = family(np.random.default_rng(4), 90, 40)
    want = classes(texts)
    assert 40 <= sum(want[k] != k for k in want) < 100
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == want
    if hasattr(near_dedup, "CHUNK_CHARS"):  # the same in many blocks
        monkeypatch.setattr(near_dedup, "CHUNK", 5)
        assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = np.concatenate((base[:250], rng.integers(0, 2**63, 50).astype(np.uint64)))
    a, b = near_dedup.signatures([base, other], 2000)
    assert abs((a == b).mean() - 250 / 350) < 0.04


def test_repeated_lines_do_not_hide_near_copies():
    rng = np.random.default_rng(8)
    missed = 0
    for times in (10, 100):
        for _ in range(150):
            base = rng.integers(0, 2**63, 300).astype(np.uint64)
            other = np.concatenate((base[:272], rng.integers(0, 2**63, 28).astype(np.uint64)))  # set similarity 0.83
            repeated = np.concatenate((base, np.repeat(base[:60], times - 1)))
            bands = near_dedup.band_hashes(near_dedup.signatures([repeated, other], near_dedup.BANDS * near_dedup.ROWS), near_dedup.BANDS, near_dedup.ROWS)
            missed += not (bands[0] == bands[1]).any()
    assert missed <= 1


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(100, 7), (200, 201), (300, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got[30] == 1 and got[100] == 1 and got[201] == 200 and 300 not in got


def test_rows_that_share_an_id_are_one_document(spark):
    same = "one two three four five six seven"
    rows = [(5, same), (5, same), (5, same), (7, "alpha beta gamma delta epsilon zeta"), (7, "other words of the same document id"), (8, same + " "), (None, same), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, gone int, node int, digest int, least int")
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, 5)] * 3 + [(7, 7)] * 2 + [(8, 5), (None, 5), (None, None)], key=repr)
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 5, 7]
    assert {r.text for _ in range(2) for r in near_dedup.keep_first(df.repartition(3)).collect() if r.doc_id == 7} <= {rows[3][1], rows[4][1]}


def test_recall_on_a_hot_family(spark):
    """Distinct near copies of one text in a few hot buckets; every link that brute force has must be found."""
    rng = np.random.default_rng(12)
    texts = family(rng, 2100, 300, size=120, own=4)
    base = {k: texts[k] for k in list(texts)[:2100]}
    for k in range(300):
        words = base[k].split()
        words[-1] = f"z{k}"  # a near copy of text k alone
        base[10_000 + k] = " ".join(words)
    sets = {k: grams(t) for k, t in base.items()}
    want = {k for k in range(300) if len(sets[k] & sets[10_000 + k]) >= 0.8 * len(sets[k] | sets[10_000 + k])}
    df = spark.createDataFrame(list(base.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert len(want) == 300 and sum(got[10_000 + k] == got[k] for k in want) >= 0.99 * len(want)


def test_very_long_text_in_slabs(spark):
    words = [f"w{k}" for k in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1000], *["z"] * 1000])), (3, "short text of six words only")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
