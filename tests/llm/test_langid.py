import zlib

import numpy as np

from quillspark.llm import langid
from quillspark.llm.queries import op3_language_id


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    accuracy = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    confidence = np.mean([r.score for r in held])
    print(accuracy, confidence)
    assert accuracy > 0.93


def test_batches_do_not_matter():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.DIM, 2)).astype(np.float32), np.zeros(2))
    texts = ["one two", "", "Ünïcode 😀 text", "x", "İstanbul"]
    together = model.logits(texts)
    assert np.allclose(together, np.concatenate([model.logits([t]) for t in texts]))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "12 !", None, "s"), (None, "abc", "en", "s"), (3, "abc abc", "en", "s"), (3, "abc abc", "en", "s")], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    got = [(r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert sorted(got) == [(0, "en"), (1, "und"), (2, "und"), (3, "en"), (3, "en")]
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), none).count() == 0


def test_one_long_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 2000)
    rows = [(0, "long " * 1000, "xx")] + [(k, ("the small house of words " if k % 2 else "das kleine haus der worte ") * 2, ("en", "de")[k % 2 == 0]) for k in range(1, 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")  # id 0 is first in the order
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id > 0"), model).collect()}
    assert got == {k: ("en", "de")[k % 2 == 0] for k in range(1, 31)}


def test_letters():
    assert not any(map(langid.has_letter, ["", "12 !", "²½", "Ⅷ ①", "_", "٣"])) and all(map(langid.has_letter, ["a", "1ß", "é", "日", "ª", "² x"]))


def test_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "the small house " * 300_000, "en", 1, 2, 3), (2, "das kleine haus " * 10, "de", 1, 2, 3)], "doc_id long, text string, lang string, _id int, _body int, body int")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert [(r._id, r._body, r.body) for r in rows] == [(1, 2, 3)] * 2 and {r.lang_pred for r in rows} <= {"en", "de"}


def test_scores_match_brute_force(spark):
    """Probabilities again from the model's weights, n-gram by n-gram."""
    rng = np.random.default_rng(9)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.DIM, 3)).astype(np.float32), rng.normal(size=3), 0.7)
    texts = ["Hello, wörld", "x", "ab 12 cd", "ññ ÀÉ", "the quick brown fox"]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        plain = "".join(" " if ord(c) < 65 else c for c in text.lower())
        padded, total, n = " " + plain + " " * 4, np.zeros(3), 0
        for k in langid.ORDERS:
            for p in range(len(plain) + 1):
                h = 0
                for j in range(k):
                    h = (h * 0x9E3779B97F4A7C15 + ord(padded[p + j]) + j + 1) % 2**64
                total += model.weights[int(langid.mix64(np.array([h], np.uint64))[0]) & (langid.DIM - 1)]
                n += 1
        z = (total / n + model.bias) / 0.7
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == model.labels[int(want.argmax())] and abs(score - want.max()) < 1e-6


def test_ties_go_to_the_first_label():
    model = langid.Model(["a", "b"], np.zeros((langid.DIM, 2), np.float32), np.zeros(2))
    assert model.predict(["x"])[0] == ["a"] and model.predict(["x"])[1][0] == 0.5
