"""Product codes against plain loops: integers, bounds, ties, rows that are dropped."""

import math
import random

import duckdb
import numpy as np
import pytest

from quillspark.llm import queries, vector_codes
from quillspark.llm.vector_codes import levels, nearest, segments


def brute(rows, rounds=6, parts=8, entries=16):
    """{place: (code, error)} and the codebooks of (vec_id, vector) rows."""
    usable = [(i, v, k) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((u for u in usable if u[0] is not None and len(u[1]) % parts == 0), key=lambda u: (u[0], u[1]))
    if not order:
        return {}, []
    size = len(order[0][1])
    ints = {k: [math.floor(4096 * x) for x in v] for _, v, k in usable if len(v) == size}
    w = size // parts
    first = [u for u in order if len(u[1]) == size][:entries]
    books = [[ints[k][p * w : p * w + w] for _, _, k in first] for p in range(parts)]

    def assign():
        return {k: [min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for k, v in ints.items()}

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [ints[k][p * w : p * w + w] for k in ints if found[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    return {k: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for k, f in assign().items()}, books


def compared(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.label: (r.code, r.error) for r in vector_codes.compress(df).collect()}
    want, _ = brute([(i, v and [x if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows])
    assert got == want
    return got


def test_random_vectors_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k if k % 9 else None, [rng.choice([-1, 0, 0.25, 0.5]) + rng.gauss(0, 0.01) * (k % 3) for _ in range(32)]) for k in range(120)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (500, None), (501, []), (502, [0.0] * 31 + [None]), (503, [float("nan")] * 32), (-5, [float("inf")] * 32), (504, [0.5] * 16), (-9, [0.1] * 30)]
    got = compared(spark, rows)
    assert len(got) == 122


def test_few_rows_equal_rows_and_one_component_parts(spark):
    compared(spark, [(1, [0.5] * 8)])
    compared(spark, [(k, [0.25] * 16) for k in range(40)], "double")
    compared(spark, [(k, [k / 7] * 8) for k in range(20)], "double")


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [])]):
        df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
        found = vector_codes.compress(df)
        assert found.collect() == [] and found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_are_exact_or_refused(spark):
    rng = random.Random(6)
    compared(spark, [(k, [rng.uniform(-32_000, 32_000) for _ in range(64)]) for k in range(60)], "double")
    with pytest.raises(Exception, match="not coded"):
        compared(spark, [(1, [1e9] * 64)], "double")


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    for scale in (3, 800, 2**27):
        x, book = rng.integers(-scale, scale, (500, 8)), rng.integers(-scale, scale, (16, 8))
        exact = ((x[:, None] - book[None]) ** 2).sum(2)
        for count in levels(8):
            (mx, rx), (mb, rb) = segments(x, count), segments(book, count)
            bound = ((mx[:, None] - mb[None]) ** 2 + (rx[:, None] - rb[None]) ** 2).sum(2)
            assert (bound * (1 - 1e-9) - 1 <= exact).all()
        index, least, measured = nearest(x, book)
        assert (index == exact.argmin(1)).all() and (least == exact.min(1)).all()
        assert measured < 0.8 * exact.size  # of noise; every row measures two entries at least
    near = book[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 8))
    assert nearest(near, book)[2] < 0.2 * 500 * 16


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.SQL['op11_vector_codes']})").fetchall()
    got = queries.QUERIES["op11_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
