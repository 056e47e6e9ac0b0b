import re
from collections import Counter

from quillspark.llm import quality
from quillspark.llm.queries import op7_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a", "x y z\nx y z\n\n \nx y z", "é 😀# <b>|\r\nq", "a b c d a b c e b c d a", "w " * 3000]
    rows = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality.with_statistics(rows).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(texts[r.doc_id] or ""), texts[r.doc_id]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = 0
    for r in op7_quality_rules(spark, sf).collect():
        n, chars, symbols, dup, rep = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
        right += r.doc_id in label and (r.rule == 0) == (label[r.doc_id] == 1)
    assert right / len(label) > 0.9


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality.judge(docs, labels)
    assert rules.rules == [] and judged.count() == 2
    assert quality.judge(docs.limit(0), labels)[0].count() == 0


def test_verdict_matches_brute_force(spark):
    """The list's rules applied row by row in Python, to the features of the same rows."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    judged, rules = quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules.rules
    for r in judged.collect():
        met = [all((r[c.feature] > c.threshold) == c.above for c in rule) for rule in rules.rules]
        number = met.index(True) + 1 if True in met else 0
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (number, failed, not failed and number == 0)


def test_clashing_names_repeats_and_ties(spark):
    rows = [(k % 30, "word " * (5 + k % 30), "q") for k in range(60)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, quality string, _id int, _s int, per_row int")
    labels = spark.createDataFrame([(k, int(k > 15)) for k in range(30)], "doc_id long, quality int")
    judged, rules = quality.judge(docs, labels)
    again = quality.judge(docs, labels)[1]
    assert judged.count() == 60 and str(rules) == str(again)
    assert {(r.quality, r._id, r._s, r.per_row) for r in judged.collect()} == {("q", 1, 2, 3)}


def test_names_that_clash_in_another_case_or_need_quotes(spark):
    rows = spark.createDataFrame([(1, "a b c a b c", 1, 2, 3, 4)], "doc_id long, text string, N_Words int, `Words` int, `x.y` int, per_row int")
    out = quality.with_statistics(rows)
    assert [c for c in out.columns if c in ("x.y", "per_row", "N_Words", "Words")] == ["x.y", "per_row"]
    row = out.first()
    assert (row.n_words, row["x.y"], row.per_row) == (6, 3, 4)
    judged, _ = quality.judge(rows, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert judged.count() == 1
