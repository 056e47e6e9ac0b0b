"""Line breaking against a plain loop over the words."""

import random

from pyspark.sql import functions as F

from quillspark.functions import wrapping


def size(text):
    return sum(1 if c in wrapping.NARROW else 3 if c in wrapping.WIDE else 2 for c in text)


def plain(text, most):
    words, part = [], max(most // 3 - 1, 1)
    for w in (text or "").split():
        pieces = [w] if size(w) <= most else [w[k : k + part] + ("-" if k + part < len(w) else "") for k in range(0, len(w), part)]
        words += pieces
    lines = []
    for w in words:
        if lines and size(lines[-1]) + 1 + size(w) <= most:
            lines[-1] += " " + w
        else:
            lines.append(w)
    return lines


def test_lines_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "W" * 100, "i" * 500, "ä" * 61, "a\tb\nc"]
    texts += [" ".join("".join(rng.choice("aifWm.é") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts.append("word and more " * 20_000)
    for most in (12, 40, 200):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", wrapping.words_to_wrap(F.col("text"), most).alias("w"))
        df = df.withColumn("lines", wrapping.line_numbers(F.col("w"), most)).select("k", wrapping.wrapped(F.col("w"), F.col("lines")).alias("out"))
        got = {r.k: r.out for r in df.collect()}
        assert [got[k] for k in range(len(texts))] == ["\n".join(plain(t, most)) for t in texts]
        assert all(size(line) <= most for out in got.values() for line in out.split("\n"))
