"""License scan: ordered signature rules over the words of a text, all in column expressions.

The text becomes its words between single blanks. A keyword prefilter decides which rules may match; each of those marks its
matches in one pass, and positions are running totals of words. Detections are ordered by start, longest first, then
by priority, then by rule; one that lies within an earlier detection of at least its own priority is suppressed. Since
every detection that holds another comes before it in this order, a running maximum of ends for each priority settles
all of them in time linear in their number.

A null or empty text has no words and no detections. Texts of any length are read whole. Repeated rows are scanned one by one,
ties between rules go to the earlier rule, an empty table gives an empty one, and other columns pass through whatever
their names are.
"""

from __future__ import annotations

import json
import string
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unused
from quillspark.llm.license_rules import Rule, rules
from quillspark.llm.pii import bound, running

#: The phrases that are always reported, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"
RULE = "order int, label string, priority int, confidence double, keywords array<string>, pattern string"
DETECTION = "start int, end int, label string, priority int, confidence double, rule int"


def struct_type(fields: str) -> str:
    """The struct type of "name type, name type"."""
    return "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


def worded(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each between single blanks; one blank if there are none."""
    body = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(F.translate(body, string.ascii_uppercase, string.ascii_lowercase))  # equal; the first is faster
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")


def blanks(text: Column) -> Column:
    """How many blanks a text holds."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def present(words: Column, listed: list[Rule]) -> Column:
    """The keywords of the rules that begin a word of the text, found in one pass."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted({k for r in listed for k in r.keywords}):
        by_letter.setdefault(k[0], []).append(k)
    some = [f"(?=[{''.join(letters)}])(?:{'|'.join(k for x in letters for k in by_letter[x])})" for letters in batched(by_letter, 5)]
    return F.array_distinct(F.regexp_extract_all(words, F.lit(f" ({'|'.join(some)})"), F.lit(1)))


def base_places(words: Column) -> Column:
    """(n, first, last) of the base phrases and their labels: array of (label, n, first, last), one for each phrase that occurs."""
    total = blanks(words) - 1

    def places(phrase: str, label: str) -> Column:
        made = lambda gaps: F.struct(
            F.lit(label).alias("label"),
            (F.size(gaps) - 1).cast("long").alias("n"),
            (blanks(F.element_at(gaps, 1)) - 1).cast("long").alias("first"),
            (total - (blanks(F.element_at(gaps, -1)) - 1) - len(phrase.split())).cast("long").alias("last"),
        )
        return F.when(F.contains(words, F.lit(f" {phrase} ")), bound(F.split(words, f"(?<= ){phrase}(?= )", -1), made))

    return F.filter(F.array(*[places(p, label) for p, label in BASE.items()]), lambda p: p.isNotNull())


def matches(words: Column, found: Column, listed: list[Rule]) -> Column:
    """All matches of the rules whose keywords are all among those ``found``, unordered: detections, places in words, end exclusive."""
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in listed])), f"array<{struct_type(RULE)}>")

    def of_rule(r: Column) -> Column:
        marked = F.split(F.regexp_replace(words, r["pattern"], F.lit(f"{MARK}$0{MARK}")), MARK, -1)  # odd places hold the matches

        def located(parts: Column) -> Column:
            sizes = F.transform(parts, blanks)
            detection = lambda at: lambda k: F.struct(
                F.get(at, k).alias("start"), (F.get(at, k) + blanks(F.get(parts, k))).alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["order"].alias("rule")
            )
            hits = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1)
            return bound(bound(sizes, lambda x: running(x, lambda a, b: a + b)), lambda at: F.transform(hits, detection(at)))

        return bound(marked, located)

    return F.flatten(F.transform(F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(found, k))), of_rule))


def unsuppressed(found: Column, priorities: list[int]) -> Column:
    """Detections in order without those that lie within an earlier one of at least their priority."""
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("neg_end"), (-d["priority"]).alias("neg_priority"), d["rule"].alias("rule"), d.alias("d")))),
        lambda o: o["d"],
    )

    def kept(x: Column) -> Column:
        # for each priority the furthest end of the detections before with that or a higher one
        ends = lambda p: F.transform(x, lambda d: F.when(d["priority"] >= p, d["end"]).otherwise(0))
        reach = F.transform(F.array(*map(ends, priorities)), lambda e: running(e, lambda a, b: F.greatest(a, b)))
        return bound(reach, lambda before: F.filter(x, lambda d, k: F.get(F.get(before, F.array_position(F.lit(priorities), d["priority"]).cast("int") - 1), k) < d["end"]))

    return bound(ordered, kept)


def scan(df: DataFrame, text: str = "text", listed: list[Rule] | None = None, out: str = "license_scan") -> DataFrame:
    """``df`` with ``out``: struct of n_words, base (label, n, first, last of each base phrase found) and detections (those kept)."""
    listed = rules() if listed is None else listed
    words, keywords = unused(df, "words"), unused(df, "keywords")
    body, found = F.col(words), F.col(keywords)
    none = F.array().cast(f"array<{struct_type(DETECTION)}>")
    kept = lambda m: F.when(F.size(m) > 0, unsuppressed(m, sorted({r.priority for r in listed}))).otherwise(none)
    detections = F.when(F.size(found) > 0, bound(matches(body, found, listed), kept)).otherwise(none)
    made = F.struct((blanks(body) - 1).cast("long").alias("n_words"), base_places(body).alias("base"), detections.alias("detections"))
    prepared = df.withColumn(words, worded(F.col(text))).withColumn(keywords, present(body, listed))
    return prepared.withColumn(out, made).drop(words, keywords)
