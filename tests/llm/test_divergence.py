"""The source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quillspark.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, top=50):
    """Rows (lang, source, part, item, value, rank) of (lang, source, text)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def audited(spark, rows, **kind):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(map(tuple, divergence.audit(df, **kind).collect()))


def corpus(seed, n, n_sources, words):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "Äxyzé" for b in words]
    rows = []
    for _ in range(n):
        s = rng.randrange(n_sources)
        rows.append((rng.choice(["en", "de", None]), f"s{s}", " ".join(rng.choice(vocabulary[s % 7 :]) for _ in range(rng.randint(0, 12)))))
    return rows


@pytest.mark.parametrize("block, tile", [(8_000, 256), (7, 3)])
def test_random_corpora(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK_VECTORS", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(1, 400, 9, "abcdefgh") + [("en", None, "Xa-xA1xa_xa"), ("fr", "lone", None), ("fr", "s1", ""), ("", "s0", "xa\x00xb")] * 3
    assert audited(spark, rows, least_docs=5, top=4) == brute(rows, 5, 4)


def test_groups_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = corpus(2, 200, 4, "abc")
    assert audited(spark, rows, least_docs=5, top=4) == brute(rows, 5, 4)


def test_no_terms_no_rows_and_long_texts(spark):
    assert audited(spark, []) == []
    rows = [("en", "a", "1 2"), ("en", "b", None), (None, None, "x")]
    assert audited(spark, rows) == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    rows = [("en", s, "alpha BETA gamma " * 200_000) for s in "ab"] + [("en", "b", "beta")] * 3
    assert audited(spark, rows, least_docs=2) == brute(rows, 2)


def test_terms_with_equal_vectors_are_ranked_one_by_one(spark):
    rows = [("en", s, " ".join(f"{s}{a}{b}" for a in "abcdefghij" for b in "abcdefghij")) for s in "xy"] * 30
    got = audited(spark, rows)
    assert got == brute(rows) and sum(r[2] == "term" for r in got) == 100
    kept = divergence.vectors(spark.createDataFrame(rows, "lang string, source string, text string"), 30)
    assert kept.count() == 200 and kept.select("lang", "vector").distinct().count() == 2


def test_other_columns_are_ignored(spark):
    rows = corpus(3, 100, 3, "ab")
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, `a.b` int, vector int")
    assert sorted(map(tuple, divergence.audit(df, 5).collect())) == brute(rows, 5)


def test_exact_shares_of_large_counts(spark):
    import numpy as np

    rng = random.Random(4)
    cases = [(rng.randrange(10**11), rng.randrange(10**11, 10**13), rng.randrange(1, 10**8)) for _ in range(200)] + [(0, 0, 1), (5, 5, 1)]
    want = [1 + 1_000_000_000 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want
    c, n, v = np.array(cases).T
    assert divergence.shares(c, n + 5 * v).tolist() == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.SQL['op12_source_divergence']})").fetchall()
    got = queries.QUERIES["op12_source_divergence"](spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1_000
