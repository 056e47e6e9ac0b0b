"""The bounded sample of labelled texts: one text for each id, whatever the rows."""

import random

from quillspark.llm import toxicity
from quillspark.llm.common import within


def sample(spark, rows, ids, chars):
    df = spark.createDataFrame(rows, "id long, body string, label string")
    return [tuple(r) for r in within(df, spark.createDataFrame([(i,) for i in ids], "id long"), chars)]


def test_an_id_with_many_texts_hides_no_other(spark):
    rows = [(1, f"text {k}", "a") for k in range(50)] + [(2, "two", "b"), (3, "three", "c")]
    got = sample(spark, rows, [1, 2, 3], 1_000)
    assert sorted(r[0] for r in got) == [1, 2, 3]


def test_order_partitions_and_repeats_do_not_matter(spark):
    rows = [(k % 40, f"text {k}" * (k % 7 + 1), random.Random(k).choice("xyz")) for k in range(200)]
    first = sample(spark, rows, range(40), 600)
    again = rows * 2
    random.Random(1).shuffle(again)
    assert sample(spark, again, [*range(40)] * 2, 600) == first and sum(len(r[1]) for r in first) <= 600


def test_a_text_that_does_not_fit_is_skipped(spark):
    assert [r[0] for r in sample(spark, [(1, "x" * 99, "a"), (2, "y", "a"), (3, "", "b")], [1, 2, 3], 10)] == sorted([2, 3], key=lambda i: i * 0x9E3779B97F4A7C15 % 2**64)
    assert sample(spark, [(1, "x", "a")], [], 10) == sample(spark, [], [1], 10) == []


def test_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"you {'zorgish' if k % 2 else 'lovely'} people number {k}") for k in range(120)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(120)]
    plain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("zorgish".startswith(w) for w in [*plain.words, *plain.stems])
    both = toxicity.fit(docs, spark.createDataFrame([*labels, *[(k, 1 - y) for k, y in labels]], "doc_id long, toxic int"))
    assert both.words == toxicity.Model().words and both.beta == toxicity.Model().beta
    assert toxicity.learn(["a b c", "a b c"], [0, 1]).words == toxicity.Model().words
