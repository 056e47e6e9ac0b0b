"""Widths of words and greedy line breaking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of one unit and of three; all others take two.
NARROW, WIDE = "fijlrtI.,;:!'|()[] ", "mwMW@%&"
#: Words of one block of the fold.
BLOCK = 64


def width(text: Column) -> Column:
    """Width of a text in units."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.length(text) * 2 - count(NARROW) + count(WIDE)


def words_to_wrap(text: Column, most: int) -> Column:
    """The words of a text; one that is wider than a line of ``most`` units is cut into parts that fit at any width, with a hyphen.

    A null or blank text has none.
    """
    part = max(most // 3 - 1, 1)
    plain = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    cut = lambda w: F.when(width(w) <= most, F.array(w)).otherwise(F.split(F.regexp_replace(w, f"(.{{{part}}})(?=.)", "$1-\n"), "\n"))
    return F.flatten(F.transform(plain, cut))


def line_numbers(words: Column, most: int) -> Column:
    """The line of each word, from 1: a word goes on as long as it fits behind the ones before and a blank.

    The fold runs in blocks, as it copies its state at each step and must not hold an array that grows.
    """
    kind = "struct<line:int,used:int,out:array<int>>"

    def step(s: Column, w: Column) -> Column:
        fits = (s["line"] > 0) & (s["used"] + 1 + width(w) <= most)
        line = F.when(fits, s["line"]).otherwise(s["line"] + 1)
        used = F.when(fits, s["used"] + 1 + width(w)).otherwise(width(w))
        return F.struct(line.alias("line"), used.alias("used"), F.concat(s["out"], F.array(line)).alias("out")).cast(kind)

    def block(s: Column, words_of: Column) -> Column:
        start = F.struct(s["line"].alias("line"), s["used"].alias("used"), F.array().cast("array<int>").alias("out")).cast(kind)
        inner = F.element_at(F.transform(F.array(F.aggregate(words_of, start, step)), lambda x: F.struct(x["line"].alias("line"), x["used"].alias("used"), F.concat(s["out"], F.array(x["out"])).alias("out"))), 1)
        return inner.cast("struct<line:int,used:int,out:array<array<int>>>")

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int")), lambda k: F.slice(words, k * BLOCK + 1, BLOCK))
    empty = F.struct(F.lit(0).alias("line"), F.lit(0).alias("used"), F.array().cast("array<array<int>>").alias("out")).cast("struct<line:int,used:int,out:array<array<int>>>")
    return F.when(F.size(words) > 0, F.flatten(F.aggregate(blocks, empty, block)["out"])).otherwise(F.array().cast("array<int>"))


def wrapped(words: Column, lines: Column) -> Column:
    """The text of ``words`` broken at ``lines``, their line numbers."""
    before = lambda k: F.when(k == 0, "").when(F.get(lines, k) > F.get(lines, k - 1), "\n").otherwise(" ")
    return F.array_join(F.transform(words, lambda w, k: F.concat(before(k), w)), "")
