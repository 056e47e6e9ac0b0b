"""Every query with SQL gives the rows that DuckDB gives for its SQL."""

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries without SQL, and the tests that compare their rows with plain code.
BRUTE_FORCE = {
    "anchored_alignment": "test_alignment.py",
    "anchored_segments": "test_alignment.py",
    "common_runs": "test_alignment.py",
    "orphan_consolidation": "test_merging.py",
    "rule_table": "test_derive.py",
    "schema_derivation": "test_derive.py",
    "tree_edit_batches": "test_trees.py",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got and name in BRUTE_FORCE  # the rows themselves are tested there
        return
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
