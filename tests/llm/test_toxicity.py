import random

import numpy as np

from quillspark.llm import toxicity as tx
from quillspark.llm.queries import op9_toxicity


def clause(text, model=None):
    model = model or tx.Model()
    entries = [model.entry(w) for w in text.split()]
    return tx.clause_score([e[0] for e in entries], [e[1] for e in entries])


def test_grammar_paths():
    plain = clause("that idiot")
    assert clause("you idiot") > plain > clause("he said idiot") * 0.9
    assert clause("you are not an idiot") < plain
    assert clause("not one of all those is idiot") == plain  # out of the negation's reach
    assert clause("you kill") > clause("kill time")
    assert clause("the quiet river") == 0


def test_learned_stems():
    texts = [f"filler{k} words zorkling{k} here" if k // 3 % 2 else f"filler{k} plain words here{k}" for k in range(120)]
    toxic = [k // 3 % 2 for k in range(120)]
    model = tx.learn(texts, toxic)
    got = model.score(model.features(["new zorklingxyz text", "new text", ""]))
    assert got[0] > 0.5 > got[1] >= 0 and 0 <= got[2] < 0.5


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op9_toxicity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == 10_000 and all(0 <= s <= 1 for _, _, s in held)
    hit = sum(p and y for p, y, _ in held)
    precision, recall = hit / max(1, sum(p for p, _, _ in held)), hit / sum(y for _, y, _ in held)
    print(precision, recall, len(held))
    assert precision > 0.9 and recall > 0.75


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "you idiot", 0.0), (2, "you idiot", 0.0)], "doc_id long, text string, score double")
    model = tx.fit(docs, spark.createDataFrame([(1, None), (9, 1)], "doc_id long, toxic int"))
    out = tx.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert tx.score(docs.limit(0), model).count() == 0


def test_one_long_text_does_not_end_the_sample(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(tx, "learn", lambda texts, toxic: learned.append((texts, toxic)))
    rows = [(0, "long " * 1000)] + [(k, f"short {k}") for k in range(1, 31)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(31)], "doc_id long, toxic int")
    tx.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sorted(learned[0][0]) == sorted(f"short {k}" for k in range(1, 31)) and sum(learned[0][1]) == 15


def plainly(tags, weights):
    """The grammar again, word by word and without machines."""
    total = 0.0
    for k, tag in enumerate(tags):
        if tag not in (tx.INSULT, tx.THREAT):
            continue
        before, behind, factor = tags[:k], tags[k + 1 :], 1.0
        if tx.TARGET in before or tx.TARGET in behind:
            factor *= tx.TARGET_FACTOR
        if tx.REPORT in before or tx.REPORT in behind:
            factor *= tx.REPORT_FACTOR
        if tx.NEGATION in before[-tx.REACH :]:
            factor *= tx.NEGATION_FACTOR
        if tag == tx.THREAT and tx.TARGET not in behind[: tx.REACH] and not (not behind and tx.TARGET in before):
            factor *= tx.IDLE_THREAT
        total += weights[k] * factor
    return total


def test_grammar_matches_brute_force():
    rng = random.Random(4)
    for _ in range(3000):
        tags = [rng.choice((tx.OTHER, tx.OTHER, *tx.TAGS)) for _ in range(rng.randrange(12))]
        weights = [rng.random() for _ in tags]
        assert abs(tx.clause_score(tags, weights) - plainly(tags, weights)) < 1e-12


def test_features_match_brute_force():
    rng = random.Random(6)
    words = [*tx.INSULTS, *tx.THREATS, *tx.TARGETS, *tx.NEGATIONS, *tx.REPORTS, *["river", "house", "green"] * 30]
    model = tx.Model()
    texts = ["", "...", "-"]
    for _ in range(300):
        texts.append(" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", '",', "!", ":"]) for _ in range(rng.randrange(60))))
    got = model.features(texts)
    for text, row in zip(texts, got):
        clauses, now = [], []
        for raw in text.lower().split():
            tag, weight, ends = model.entry(raw)
            now.append((tag, weight))
            if ends:
                clauses.append(now)
                now = []
        scores = [plainly([t for t, _ in c], [w for _, w in c]) for c in [*clauses, now]]
        assert np.allclose(row, [1, np.log1p(sum(scores)), max(scores), 100 * sum(scores) / (len(text.split()) + 20)])


def test_threats_need_someone():
    assert clause("i will kill you") > clause("you should kill weeds")
    assert clause("we will hurt them all") > clause("they hurt a knee")
    assert clause("they will hang") > clause("hang the coat")


def text_score(text):
    return tx.Model().features([text])[0, 2]


def test_reported_speech_on_either_side():
    assert text_score('"you idiot", he said') == text_score('he said, "you idiot"') == text_score("he said: you idiot") < text_score("you idiot!")
    assert text_score("he said so. you idiot") == text_score("you idiot")


def test_learned_threats():
    rng = random.Random(3)
    texts, toxic = [], []
    for k in range(240):
        body = [rng.choice(["river", "house", "stone", "light"]) for _ in range(12)]
        if k % 2:
            body[4:4] = ["zorkling", "them"] if k % 4 == 1 else ["them", "are", "blorp"]
        texts.append(f"doc{k} " + " ".join(body))
        toxic.append(k % 2)
    model = tx.learn(texts, toxic)
    assert ("zorkling", True) in model.threats and ("blorp", True) not in model.threats
    assert model.entry("zorkling")[0] == tx.THREAT and model.entry("blorp")[0] == tx.INSULT


def test_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "you idiot " + "quiet river " * 400_000, 1, 2, 3), (2, "quiet river", 1, 2, 3)], "doc_id long, text string, _id int, _body int, body int")
    model = tx.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    rows = tx.score(docs, model).collect()
    assert [(r._id, r._body, r.body) for r in rows] == [(1, 2, 3)] * 2 and tx.keep_clean(docs, model).columns == docs.columns


def test_ties_are_stable():
    texts, toxic = [f"word{k % 9} bad{k % 3}" for k in range(90)], [k % 3 == 0 for k in range(90)]
    assert tx.learn(texts, toxic) == tx.learn(texts, toxic)
