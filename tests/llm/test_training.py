"""Training of the language model against plain loops: one coordinate after the other, and temperatures on a grid."""

import math

import numpy as np

from quillspark.llm import langid


def plain_ftrl(rows, y, classes, epochs):
    """FTRL-Proximal by its definition, a dictionary for each class; the bias is one more coordinate that is always 1."""
    z, n = [{} for _ in range(classes)], [{} for _ in range(classes)]

    def weight(c, i):
        v = z[c].get(i, 0.0)
        if abs(v) <= langid.L1:
            return 0.0
        return -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[c].get(i, 0.0))) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows)).tolist()
        for first in range(0, len(rows), langid.BATCH):
            part, gradient = order[first : first + langid.BATCH], [{} for _ in range(classes)]
            for k in part:
                features = [*zip(rows[k][0].tolist(), rows[k][1].tolist()), ("bias", 1.0)]
                logits = [sum(weight(c, i) * x for i, x in features) for c in range(classes)]
                top = max(logits)
                e = [math.exp(v - top) for v in logits]
                for c in range(classes):
                    error = e[c] / sum(e) - (y[k] == c)
                    for i, x in features:
                        gradient[c][i] = gradient[c].get(i, 0.0) + error * x / len(part)
            for c in range(classes):
                old = {i: weight(c, i) for i in gradient[c]}
                for i, g in gradient[c].items():
                    before = n[c].get(i, 0.0)
                    z[c][i] = z[c].get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA * old[i]
                    n[c][i] = before + g * g
    return lambda i, c: weight(c, i)


def test_ftrl_equals_plain_loops():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 90)
    rows = []
    for label in y.tolist():
        at = np.unique(np.concatenate([rng.integers(0, 40, 6), rng.integers(40 + 10 * label, 50 + 10 * label, 4)]))
        rows.append((at.astype(np.int32), rng.random(len(at)).astype(np.float32)))
    weights, bias = langid.ftrl(rows, y, 3, epochs=3)
    plain = plain_ftrl(rows, y.tolist(), 3, 3)
    assert np.allclose(weights[:70], [[plain(i, c) for c in range(3)] for i in range(70)], atol=1e-9)
    assert np.allclose(bias, [plain("bias", c) for c in range(3)], atol=1e-9)
    assert not weights[70:].any() and (weights[:70] == 0).any()  # the first penalty leaves exact zeros
    hits = [(weights[at].T @ x + bias).argmax() == label for (at, x), label in zip(rows, y.tolist())]
    assert np.mean(hits) > 0.9


def test_temperature_is_the_best_on_a_grid():
    rng = np.random.default_rng(2)
    for sharp in (0.2, 1.0, 7.0):
        y = rng.integers(0, 4, 400)
        logits = sharp * (3 * np.eye(4)[y] + rng.normal(0, 2, (400, 4)))

        def loss(t):
            e = np.exp(logits / t - (logits / t).max(1, keepdims=True))
            return -np.log((e / e.sum(1, keepdims=True))[np.arange(400), y] + 1e-12).mean()  # noqa: B023

        found = langid.calibrate(logits, y)
        assert loss(found) <= min(loss(t) for t in np.exp(np.linspace(-4, 4, 801))) + 1e-6


def test_frequencies_of_all_texts(spark):
    texts = ["ab ab", "b", "", "ABC", "ab"]
    df, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    held = []
    for t in texts:
        codes, begin = langid.grams([t])
        held.append({int(c) for code in codes for c in code[begin[0] : langid.text_ends(begin)[0]]})
    assert n == len(texts) and all(df[b] == sum(b in h for h in held) for b in set().union(*held)) and df.sum() == sum(map(len, held))
