"""Quality rules by learned decision lists, from DataFrame functions only.

Text statistics are native expressions over each row. Rules for low-quality texts are learned by sequential covering:
a rule is a conjunction of thresholds, grown on one part of the labelled rows while it gains information, pruned on the
rest, and kept while it is right more often than not; rows that it covers leave, and the next rule is grown. Each step is
one aggregate over all labelled rows. The list is emitted as one ordered CASE expression.

A null text has no words. Texts without words have zero statistics and ratios of 0. Labels that are null, and labelled
ids without a document, teach nothing; without any labels the list is empty and every text is kept. Repeated rows count
as often as they occur, ties between conditions go to the first in a fixed order. Texts of any length are measured whole,
in one row. An empty table gives an empty result. Other columns pass through, whatever their names; only the text and
the columns of the result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, named, unused

#: What separates words; and the characters that count as symbols. Fixed values of the result's contract.
BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Numbers that rules may test.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "distinct_ratio", "stop_ratio")
#: Thresholds tried for each feature: this many quantiles of the labelled rows.
QUANTILES = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule must be right this often on the pruning part, on this many of its rows.
MIN_PRECISION, MIN_ROWS = 0.75, 4


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helpers, as expressions over a non-null text."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    solid = F.translate(text, BLANK, "")
    return {
        "words": words,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")),
        "n_digits": F.length(F.regexp_replace(text, "[^0-9]+", "")),
    }


def _named(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a one-element transform binds it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    Windows are compared by a 64-bit hash. Only texts with a repeated window pay for the second step: windows are sorted
    by hash and position, those with an equal neighbour are kept, and each kept window adds the words that the kept
    window before it does not cover.
    """
    n = F.size(words) - 2
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def kept(keyed: Column) -> Column:
        here = lambda i: F.get(keyed, i)["h"]
        same = lambda i: F.coalesce(here(i) == here(i - 1), F.lit(False)) | F.coalesce(here(i) == here(i + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(keyed) - 1), same), lambda i: F.get(keyed, i)["p"]))

    def covered(p: Column) -> Column:
        adds = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.coalesce(F.least(F.get(p, i + 1) - F.get(p, i), F.lit(3)), F.lit(3)))
        return F.aggregate(adds, F.lit(0), lambda s, x: s + x)

    def of(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _named(_named(keyed, kept), covered)).otherwise(0)

    return F.when(n >= 2, _named(hashes, of)).otherwise(0).cast("long")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the statistics of the contract and the features of the rules; the text and columns of their names are dropped."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = text_statistics(body)
    per_row = F.struct(
        F.size("words").cast("long").alias("n_words"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("n_short"),
    )
    _, others = named(df, (*counts, *FEATURES, "n_repeat_words", "n_distinct", "n_short", text))
    made = df.select(*others, *[c.alias(k) for k, c in counts.items()])
    both = unused(made, "per_row")
    made = made.withColumn(both, per_row).select(*named(made, ("words",))[1], f"{both}.*")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    made = made.withColumns({
        "mean_word": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"), "digit_ratio": ratio("n_digits", "word_chars"),
        "distinct_ratio": ratio("n_distinct", "n_words"), "stop_ratio": ratio("n_short", "n_words"),
    })
    return made.drop("n_upper", "n_digits", "n_distinct", "n_short")


@dataclass(frozen=True)
class Condition:
    """feature <= threshold, or feature > threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; a row is rejected by the first that it meets and kept if it meets none."""

    rules: list[list[Condition]] = field(default_factory=list)

    def number(self) -> Column:
        """The number (from 1) of the first rule met, else 0: one ordered CASE expression."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            met = conjunction(rule)
            out = F.when(met, k) if out is None else out.when(met, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{k}: " + " and ".join(map(str, rule)) for k, rule in enumerate(self.rules, 1))


def conjunction(rule: list[Condition]) -> Column:
    met = F.lit(True)
    for condition in rule:
        met = met & condition.column()
    return met


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained by going from (p0, n0) to (p, n) covered rows of the sought and the other label."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, bad: Column, features: tuple[str, ...] = FEATURES, max_rules: int = MAX_RULES) -> DecisionList:
    """Rules for the rows where ``bad`` holds, from all rows of ``labelled`` (doc_id and the features).

    Every feature is replaced by the number of thresholds below it, so one count by (feature, number, label) gives the
    covered rows of all conditions of a growing step.
    """
    known = labelled.select("doc_id", *features, bad.alias("bad")).where("bad IS NOT NULL")
    cuts = known.agg(*[F.percentile_approx(f, [k / QUANTILES for k in range(QUANTILES)] + [1.0], 20_000).alias(f) for f in features]).first()
    steps = {f: sorted({float(t) for t in cuts[f] or ()}) for f in features}

    def passed(feature: str) -> Column:
        limits = F.array(*map(F.lit, steps[feature])) if steps[feature] else F.array().cast("array<double>")
        return F.size(F.filter(limits, lambda t: t < F.col(feature)))

    below = [passed(f).alias(f) for f in features]
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    rows = cut(known.select(grow.alias("grow"), "bad", *below))
    found, numbered = DecisionList(), []

    def met(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            at = steps[c.feature].index(c.threshold) + 1
            out = out & (F.col(c.feature) >= at if c.above else F.col(c.feature) < at)
        return out

    def covered(part: Column) -> dict[Condition, tuple[int, int]]:
        """Bad and good rows of every condition among the rows of ``part``; None stands for all rows."""
        table: dict[tuple[int, bool], dict[int, int]] = {}
        for r in rows.where(part).select("bad", F.posexplode(F.array(*features))).groupBy("pos", "col", "bad").count().collect():
            table.setdefault((r["pos"], r["bad"]), {})[r["col"]] = r["count"]
        out = {None: tuple(sum(table.get((0, side), {}).values()) for side in (True, False))}
        for k, f in enumerate(features):
            for at, t in enumerate(steps[f], 1):
                high = tuple(sum(n for b, n in table.get((k, side), {}).items() if b >= at) for side in (True, False))
                out[Condition(f, True, t)] = high
                out[Condition(f, False, t)] = (out[None][0] - high[0], out[None][1] - high[1])
        return out

    while len(found.rules) < max_rules:
        left = F.lit(True)
        for past in numbered:
            left = left & ~past
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            got = covered(F.col("grow") & left & met(rule))
            p0, n0 = got.pop(None)
            if p0 < MIN_ROWS or n0 == 0 or not got:
                break
            best = max(got, key=lambda c: _gain(*got[c], p0, n0))  # of equal ones the first
            if _gain(*got[best], p0, n0) <= 1e-9 or got[best] == (p0, n0):
                break
            rule.append(best)
        if not rule:
            break
        tests = [met(rule[: k + 1]) for k in range(len(rule))]
        sums = rows.where(~F.col("grow") & left).agg(*[F.count_if(t & (F.col("bad") == side)).alias(f"c{k}_{side}") for k, t in enumerate(tests) for side in (True, False)]).first()
        got = [(sums[f"c{k}_True"], sums[f"c{k}_False"]) for k in range(len(rule))]
        keep = max(range(len(rule)), key=lambda k: ((got[k][0] - got[k][1]) / max(1, sum(got[k])), got[k][0], -k))
        p, n = got[keep]
        if p < MIN_ROWS or p / (p + n) < MIN_PRECISION:
            break
        found.rules.append(rule[: keep + 1])
        numbered.append(met(found.rules[-1]))
    return found


def judge(df: DataFrame, labels: DataFrame, text: str = "text", max_rules: int = MAX_RULES) -> tuple[DataFrame, DecisionList]:
    """(statistics of every row with base_failed, rule and kept, the learned list). ``labels``: doc_id, quality (1 is good)."""
    stats = cut(with_statistics(df, text))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = learn(stats.select("doc_id", *FEATURES).join(known, "doc_id"), F.col("bad"), max_rules=max_rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", rules.number())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
