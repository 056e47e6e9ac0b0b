import re

from test_near_dedup import classes
from test_pii import base_spans

import corpus_pipeline


def test_stages_match_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]

    def after(name, before):
        out = stages[name](spark, before, sf)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = after("toxicity", docs)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in one.collect()}
    assert sum(d in kept for d, t in label.items() if t == 0) >= 0.98 * sum(t == 0 for t in label.values())
    two = after("near_dedup", one)
    texts = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id for r in two.collect()} == set(classes(texts).values())
    three = after("decontamination", two)
    bare = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    items = [bare(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in three.collect()}
    for r in two.collect():
        assert (r.doc_id in left) == (not any(f" {i} " in f" {bare(r.text)} " for i in items))
    four = after("pii", three)
    assert four.count() == three.count()
    assert not any("email:" in base_spans(r.text) or "ip:" in base_spans(r.text) for r in four.collect())
    five = after("packing", four)
    assert {r.doc_id for r in five.collect()} == left
    fill = five.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 2048 and len(fill) == -(-sum(r[1] for r in fill) // 2048)


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, pii_spans string, `a.b` int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing names, against the documents that have to stay."""
    item = "which river crosses the old town of the northern valley before it meets the grey sea at dusk"
    long = " ".join(f"w{k}" for k in range(60_000))
    plain = "mail me at jo@example.org about the green garden by the quiet lake where we met last summer with all of them"
    rows = [(5, plain), (3, plain), (3, plain), (7, None), (8, ""), (None, None), (None, "a short note"), (9, long), (10, long + " end"), (11, f"well {item} indeed"), (12, "one more line of its own")]
    docs = [(i, t, None, None, None, "x", 1) for i, t in rows]
    sf = tables(spark, str(tmp_path), docs, [(3, None, None), (None, 1, 0), (5, 1, 0), (12, 1, 0)], [(1, item), (2, None), (3, "")])
    seen = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == seen.columns
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
    left = [tuple(r) for r in seen.select("doc_id", "text", "n_chars", "pii_spans", "`a.b`").collect()]
    assert sorted((r[0] for r in left), key=lambda i: (i is None, i or 0)) == [3, 7, 9, 12, None, None]
    assert all(r[2] == (None if r[1] is None else len(r[1])) and r[3:] == ("x", 1) for r in left)
    assert {r[0]: r[1] for r in left if r[0]}[3] == plain.replace("jo@example.org", "[EMAIL]")
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {3, 7, 9, 12, None}
    assert sum(r.doc_id == 7 and r.length == 1 for r in packed) == 1
    assert sum(r.length for r in packed if r.doc_id == 9) > 60_000


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
