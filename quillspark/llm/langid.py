"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader under an elastic net, then temperature-calibrated.

Character 1- to 4-grams of the lower-case text, with word ends marked, are hashed into ``DIM`` buckets. A bucket's term
frequency is its share of the text's n-grams; its inverse document frequency comes from all usable documents. Weights
are learned on a bounded sample, four fifths for FTRL-Proximal (the L1 part keeps them sparse) and one fifth for the
temperature.

A null text, and one without a letter (a character of a Unicode category L), is ``und`` with score 0. Null labels teach
nothing. With no labels at all every text is ``und``; with one label every text with a letter gets it. Ties go to the
first label in order. Repeated rows score alike. Texts of any length are read whole, in slabs of bounded size. Empty
tables give a model without labels and an empty result. Other columns pass through, whatever their names; only
``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, map_arrow, mix64, named, slabs, small_batches, unused, within

ORDERS, DIM = (1, 2, 3, 4), 1 << 17
#: Labelled texts in the training sample, and the characters that they may have in all; a text that does not fit is not taken.
SAMPLE_TEXTS, SAMPLE_CHARS = 3_000, 12_000_000
#: FTRL-Proximal: learning rate, its offset, L1 and L2 strength; passes over the sample and rows per step.
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 0.002, 0.0005, 6, 32
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]+")
CHUNK_CHARS = 1_000_000


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode category L; numbers such as ² and Ⅷ are not."""
    return any(c.isalpha() for run in LETTER.finditer(text) for c in run.group())


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each order the bucket of the n-gram at each position, the position at which each text begins).

    Texts are joined by blanks, as many as no n-gram can cross; a text's positions run from the blank before it to its
    last character.
    """
    low, gap = [t.lower() for t in texts], " " * ORDERS[-1]
    joined = gap + gap.join(low) + gap
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code[(code < 65) & (code != 32)] = 32  # digits and ASCII punctuation are blanks
    begin = len(gap) - 1 + np.concatenate(([0], np.cumsum([len(t) + len(gap) for t in low], dtype=np.int64)))
    out, h = [], np.zeros(len(code), np.uint64)
    for k in range(1, ORDERS[-1] + 1):
        shifted = np.concatenate((code[k - 1 :], np.full(k - 1, 32, np.uint64)))
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(k)
        if k in ORDERS:
            out.append((mix64(h) & np.uint64(DIM - 1)).astype(np.int64))
    return out, begin


def text_ends(begin: np.ndarray) -> np.ndarray:
    """The position after the last character of each text."""
    return begin[1:] - ORDERS[-1] + 1


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(texts that hold each bucket, texts): partial sums in the tasks, ``DIM`` sums to the driver."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, held in slabs(batch.column("body").to_numpy(zero_copy_only=False), CHUNK_CHARS):
                codes, begin = grams(held)
                n += len(held)
                for a, b in zip(begin[:-1].tolist(), text_ends(begin).tolist()):
                    total[np.unique(np.concatenate([c[a:b] for c in codes]))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    counts = docs.select(F.col(text).alias("body")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, at = np.zeros(DIM, np.int64), counts["bucket"].to_numpy()
    df[at[at >= 0]] = counts["n"].to_numpy()[at >= 0]
    return df, int(counts["n"].to_numpy()[at < 0].sum())


@dataclass
class Model:
    """Labels, weights per bucket (inverse document frequency included), biases and temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        codes, begin = grams(texts)
        size = text_ends(begin) - begin[:-1]
        out = np.zeros((len(texts), len(self.labels)))
        for c in codes:
            summed = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(self.weights[c], axis=0, dtype=np.float64)))
            out += summed[text_ends(begin)] - summed[begin[:-1]]
        return out / (len(codes) * size)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.labels else []
        if known:
            p = softmax(self.logits([texts[k] for k in known]) / self.temperature)
            for k, row in zip(known, p):
                best = int(row.argmax())
                names[k], score[k] = self.labels[best], round(float(row[best]), 9)
        return names, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-Proximal with an elastic net over sparse rows (buckets, values); returns (weights, biases)."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at):
        zz = z[at]
        shrunk = np.where(np.abs(zz) <= L1, 0.0, zz - np.sign(zz) * L1)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(7)
    target = np.eye(classes)[y]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            part = order[first : first + BATCH]
            at, inverse = np.unique(np.concatenate([rows[k][0] for k in part] + [[DIM]]), return_inverse=True)
            w = weights(at)
            owner = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            value, place = np.concatenate([rows[k][1] for k in part]), inverse[:-1]
            logits = np.zeros((len(part), classes))
            np.add.at(logits, owner, w[place] * value[:, None])
            error = softmax(logits + w[-1]) - target[part]
            g = np.zeros_like(w)
            np.add.at(g, place, error[owner] * value[:, None])
            g[-1] = error.sum(axis=0)
            g /= len(part)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(DIM + 1))
    return every[:-1], every[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by a golden-section search on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learn(texts: list[str], labels: list[str], df: np.ndarray, n: int) -> Model:
    """A model from labelled texts and the document frequencies of ``n`` texts."""
    names = sorted(set(labels))
    idf = np.log((n + 1) / (df + 1)) + 1.0
    if len(names) < 2:
        return Model(names, np.zeros((DIM, len(names)), np.float32), np.zeros(len(names)))
    y = np.array([names.index(x) for x in labels])
    train = [k for k in range(len(texts)) if k % 5 and has_letter(texts[k])]
    rest = [k for k in range(len(texts)) if k % 5 == 0 and has_letter(texts[k])]
    scale = 20.0  # the shares of n-grams are small numbers; FTRL steps suit values near 1
    rows = []
    for k in train:
        codes, begin = grams([texts[k]])
        at, count = np.unique(np.concatenate([c[begin[0] : text_ends(begin)[0]] for c in codes]), return_counts=True)
        rows.append((at.astype(np.int32), (scale * idf[at] * count / count.sum()).astype(np.float32)))
    weights, bias = ftrl(rows, y[train], len(names))
    model = Model(names, (scale * idf[:, None] * weights).astype(np.float32), bias)
    if rest:
        model.temperature = calibrate(np.concatenate([model.logits(held) for _, held in slabs([texts[k] for k in rest], CHUNK_CHARS // 4)]), y[rest])
    return model


def fit(docs: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the usable rows with a text and a label: frequencies from all, weights from a bounded sample.

    The sample takes documents in the order of a hash of their ids: ids first, then the lengths of their texts, and only
    texts that fit the sample together come to the driver. Of an id with several texts or languages one text and language
    counts. ``usable`` is a condition on the columns of ``docs``.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    small_batches(docs.sparkSession)
    df, n = document_frequencies(rows, text)
    rows = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.col(lang).alias("label"))
    drawn = cut(rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS))
    got = within(rows, drawn, SAMPLE_CHARS)
    return learn([r.body for r in got], [r.label for r in got], df, n)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without its text, with lang_pred and score."""
    small_batches(df.sparkSession)
    fields, columns = named(df, (text, "lang_pred", "score"))
    names = [f.name for f in fields] + ["lang_pred", "score"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, score = [], []
            for _, held in slabs(batch.columns[-1].to_numpy(zero_copy_only=False), CHUNK_CHARS):
                a, b = model.predict(held)
                found += a
                score.append(b)
            out = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(out, names)

    return map_arrow(df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(unused(df, "body"))), run, schema)
