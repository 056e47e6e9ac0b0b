"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become tags: insult, threat, target, negation, reported speech, other. Insults and threats carry weights: whole
words and word beginnings whose document frequencies in a bounded sample of labelled texts speak for toxicity, beside a
few fixed words. A learned word is a threat if the toxic texts use it like one, with a target right behind it more often
than right before it, else an insult. Five small transducers (insult, threat, target, negation, reported speech) read a
clause from both sides: a state that runs forwards and one that runs backwards meet at each insult or threat and scale
what it adds. Their product, compiled once, is the grammar:

* an insult counts whole;
* a threat counts whole with a target among the ``REACH`` words behind it, or with a target anywhere before it when it
  ends its clause (``they will hang``), else little (``kill weeds``);
* a target anywhere in the clause raises both;
* a negation among the ``REACH`` words before lowers both, and so does reported speech anywhere in the clause.

A quotation's closing comma and the comma or colon behind a word of speech do not end a clause, so that what is said and
who says it are read together. A text's score is a logistic function of its matched clauses, fitted on the part of the
sample that did not choose the words.

Null and empty texts match nothing and score the base of the logistic function. Labels that are null, or whose document
is missing, teach nothing; without labels of both kinds the fixed words keep default weights. Repeated rows score alike;
ties in the choice of words go to the shorter, then the first in order. Texts of any length are read whole, in slabs of
bounded size. Empty tables give the default model and an empty result. Other columns pass through, whatever their names;
only ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, map_arrow, named, slabs, small_batches, unused, within

#: Labelled texts in the sample from which words and weights are learned, and the characters that they may have in all; a
#: text that does not fit is not taken.
SAMPLE_TEXTS, SAMPLE_CHARS = 8_000, 60_000_000
#: Most learned words and beginnings, the least number of toxic texts that hold one, and the least log odds.
MOST_ENTRIES, LEAST_TEXTS, LEAST_ODDS = 2_000, 6, 2.0
#: Lengths of learned word beginnings.
STEMS = range(4, 9)
#: Words with a fixed role. Insults and threats among them get learned weights when the sample holds them.
INSULTS = "idiot moron stupid loser trash scum clown worthless pathetic disgusting dumb fool jerk idiota estúpido imbécile crétin dummkopf trottel".split()
THREATS = "kill hurt destroy beat shoot stab burn hang matar töten umbringen tuer frapper".split()
TARGETS = "you your yours u he she they him her them his their people everyone du dich dir ihr euch sie er tu toi te vous ton ta tes il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never none without isn't aren't don't doesn't won't can't nicht kein keine nie ne pas jamais ni nunca jamás sin".split()
REPORTS = "said says say told tells wrote writes called calls claimed quoted according sagte sagt schrieb dit disait écrit dijo dice escribió".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = TAGS = range(6)
REACH, NEGATION_FACTOR, REPORT_FACTOR, TARGET_FACTOR, IDLE_THREAT, DEFAULT_WEIGHT = 3, 0.3, 0.5, 1.25, 0.4, 1.0
#: Characters of a slab; words and tags of a slab are held together.
SLAB = 1_000_000
#: A clause ends with a word that ends with one of these.
CLAUSE_END = ".!?;:,"
QUOTES = "\"'”’»"
PUNCTUATION = ".,;:!?\"'()[]{}<>|*%$#&~_-…–—“”„«»¡¿"


@dataclass
class Transducer:
    """A deterministic weighted transducer over tags that reads a clause from both sides.

    ``ahead`` and ``back``: (state, tag) -> next state of the reading forwards and backwards; missing arcs loop. A word's
    factor is ``weigh(state before it, tag, state behind it)``.
    """

    ahead: dict[tuple, object] = field(default_factory=dict)
    back: dict[tuple, object] = field(default_factory=dict)
    start: tuple = (0, 0)
    weigh: object = lambda left, tag, right: 1.0


def _reachable(machines: list[Transducer], side: int) -> tuple[tuple, dict]:
    """Start and arcs of the product of the machines' readings from one side; only reachable states are built."""
    start = tuple(m.start[side] for m in machines)
    todo, seen, arcs = [start], {start}, {}
    while todo:
        state = todo.pop()
        for tag in TAGS:
            after = tuple((m.ahead, m.back)[side].get((s, tag), s) for m, s in zip(machines, state))
            arcs[state, tag] = after
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return start, arcs


def compose(machines: list[Transducer]) -> Transducer:
    """The product machine: states are tuples, factors multiply and are tabulated for insults and threats."""
    (left, ahead), (right, back) = _reachable(machines, 0), _reachable(machines, 1)
    table = {}
    for a in {left, *ahead.values()}:
        for b in {right, *back.values()}:
            for tag in (INSULT, THREAT):
                table[a, tag, b] = math.prod(m.weigh(x, tag, y) for m, x, y in zip(machines, a, b))
    return Transducer(ahead, back, (left, right), lambda a, tag, b: table[a, tag, b])


def _within_reach(tag: int) -> dict[tuple, int]:
    """Arcs of a countdown that ``tag`` starts at REACH and that every other word lowers."""
    return {(left, t): REACH if t == tag else max(0, left - 1) for left in range(REACH + 1) for t in TAGS}


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech composed."""
    insult = Transducer()
    # forwards: a target was met; backwards: words until a target is out of reach, or "end" where nothing was read yet
    object_behind = _within_reach(TARGET) | {("end", t): REACH if t == TARGET else 0 for t in TAGS}

    def threat_weight(left, tag, right):
        if tag != THREAT or right not in ("end", 0):
            return 1.0
        return 1.0 if right == "end" and left else IDLE_THREAT

    threat = Transducer({(0, TARGET): 1}, object_behind, (0, "end"), threat_weight)
    target = Transducer({(0, TARGET): 1}, {(0, TARGET): 1}, weigh=lambda left, _, right: TARGET_FACTOR if left or right else 1.0)
    negation = Transducer(_within_reach(NEGATION), weigh=lambda left, *_: NEGATION_FACTOR if left else 1.0)
    report = Transducer({(0, REPORT): 1}, {(0, REPORT): 1}, weigh=lambda left, _, right: REPORT_FACTOR if left or right else 1.0)
    return compose([insult, threat, target, negation, report])


GRAMMAR = grammar()


def clause_score(tags: list[int], weights: list[float], machine: Transducer = GRAMMAR) -> float:
    """What the insults and threats of one clause add up to where its two readings meet."""
    state, behind = machine.start[1], []
    for tag in reversed(tags):
        behind.append(state)
        state = machine.back[state, tag]
    state, total = machine.start[0], 0.0
    for tag, weight, right in zip(tags, weights, reversed(behind)):
        if tag in (INSULT, THREAT):
            total += weight * machine.weigh(state, tag, right)
        state = machine.ahead[state, tag]
    return total


def ends_clause(raw: str, tag: int) -> bool:
    """Whether a clause ends with this word and its punctuation."""
    bare = raw.rstrip("*%$#&|()[]")
    last = bare.rstrip(QUOTES)
    if not last.rstrip(CLAUSE_END):
        return True  # only punctuation
    if "," in bare[-2:] and any(q in bare[-2:] for q in QUOTES):
        return False  # a quotation goes on to who says it
    if tag == REPORT and last[-1:] in ",:":
        return False
    return last[-1:] in CLAUSE_END


@dataclass
class Model:
    """Weights of words and word beginnings, and the logistic function of the clause features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: frozenset[tuple[str, bool]] = frozenset()
    beta: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.0)

    def __post_init__(self):
        fixed = [(REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)]
        self.fixed = {w: tag for group, tag in fixed for w in group}
        self.known: dict[str, tuple[int, float, bool]] = {}

    def entry(self, raw: str) -> tuple[int, float, bool]:
        """(tag, weight, whether a clause ends here) of one lower-case word with its punctuation."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            word, tag, weight = raw.strip(PUNCTUATION), OTHER, 0.0
            if word in self.words:
                tag, weight = self.fixed.get(word, OTHER), self.words[word]
                if tag not in (INSULT, THREAT):
                    tag = THREAT if (word, True) in self.threats else INSULT
            elif word in self.fixed:
                tag = self.fixed[word]
                weight = DEFAULT_WEIGHT if tag in (INSULT, THREAT) else 0.0
            else:
                weight, stem = max(((self.stems.get(word[:k], 0.0), word[:k]) for k in STEMS if len(word) >= k), default=(0.0, ""))
                if weight > 0:
                    tag = THREAT if (stem, False) in self.threats else INSULT
            found = self.known[raw] = (tag, weight, ends_clause(raw, tag))
        return found

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: 1, log of the clause total, the heaviest clause, the total per 100 words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded, ends = split.values.dictionary_encode(), np.asarray(split.offsets)
        entries = [self.entry(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1.0
        if not entries:
            return out
        number = coded.indices.to_numpy(zero_copy_only=False)
        tag = np.array([e[0] for e in entries], np.int8)[number]
        weight = np.array([e[1] for e in entries])[number]
        closes = np.array([e[2] for e in entries], bool)[number]
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
        begins = np.concatenate(([True], closes[:-1] | (text_of[1:] != text_of[:-1])))
        clause = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        last = np.concatenate((first[1:], [len(tag)]))
        total, top = np.zeros(len(texts)), np.zeros(len(texts))
        for c in np.unique(clause[weight > 0]).tolist():
            a, b = first[c], last[c]
            score = clause_score(tag[a:b].tolist(), weight[a:b].tolist())
            t = text_of[a]
            total[t] += score
            top[t] = max(top[t], score)
        out[:, 1], out[:, 2] = np.log1p(total), top
        out[:, 3] = 100 * total / (np.diff(ends) + 20)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(self.beta), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _keys(text: str) -> set[tuple[str, bool]]:
    """Whole words (True) and word beginnings (False) of a text."""
    words = {w.strip(PUNCTUATION) for w in text.lower().split()}
    return {(w, True) for w in words if len(w) >= 3} | {(w[:k], False) for w in words for k in STEMS if len(w) > k}


def _threats(texts: list[str], chosen: set[tuple[str, bool]]) -> frozenset[tuple[str, bool]]:
    """Of the chosen words and beginnings those that toxic texts follow with a target more often than they lead them with one."""
    behind, before = Counter(), Counter()
    targets = set(TARGETS)
    for text in texts:
        words = [w.strip(PUNCTUATION) for w in text.lower().split()]
        at = {k for k, w in enumerate(words) if w in targets}
        if not at:
            continue
        for k, w in enumerate(words):
            keys = [key for key in [(w, True), *[(w[:n], False) for n in STEMS if len(w) > n]] if key in chosen]
            if keys:
                behind.update(keys if any(k + j in at for j in range(1, REACH + 1)) else ())
                before.update(keys if any(k - j in at for j in range(1, REACH + 1)) else ())
    return frozenset(key for key, n in behind.items() if n >= LEAST_TEXTS and n >= 2 * before[key])


def learn(texts: list[str], toxic: list[int]) -> Model:
    """Words from two thirds of the texts, the logistic function from the rest; equal texts count once, and not at all if their labels differ."""
    kinds: dict[str, set] = {}
    for text, y in zip(texts, toxic):
        kinds.setdefault(text, set()).add(y)
    rows = [(text, *ys) for text, ys in kinds.items() if len(ys) == 1]
    choose = [r for k, r in enumerate(rows) if k % 3]
    count = [sum(not y for _, y in choose), sum(bool(y) for _, y in choose)]
    if not all(count):
        return Model()
    bad, good = Counter(), Counter()
    for text, y in choose:
        if y:
            bad.update(_keys(text))
    often = {key for key, n in bad.items() if n >= LEAST_TEXTS}  # only these are counted in the other texts
    for text, y in choose:
        if not y:
            good.update(_keys(text) & often)
    odds = {}
    for key in often:
        n = bad[key]
        value = math.log((n + 0.5) / (count[1] + 1)) - math.log((good[key] + 0.5) / (count[0] + 1))
        spread = math.sqrt(1 / (n + 0.5) + 1 / (good[key] + 0.5))
        if value - spread > LEAST_ODDS:
            odds[key] = value - spread
    words, stems = {}, {}
    for (key, whole), value in sorted(odds.items(), key=lambda x: (-x[1], len(x[0][0]), x[0]))[:MOST_ENTRIES]:
        (words if whole else stems)[key] = round(value, 6)
    chosen = {*((w, True) for w in words), *((w, False) for w in stems)}
    model = Model(words, stems, _threats([t for t, y in choose if y], chosen))
    rest = [r for k, r in enumerate(rows) if k % 3 == 0]
    x, y = model.features([t for t, _ in rest]), np.array([float(v) for _, v in rest])
    if 0 < y.sum() < len(y):
        model.beta = tuple(_logistic(x, y).tolist())
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from a sample of at most ``SAMPLE_TEXTS`` labelled documents, taken in the order of a hash of their ids.

    Ids come first, then the lengths of their texts, and only texts that fit the sample together come to the driver. An id
    with labels of both kinds teaches nothing; of one with several texts, that with the least hash stands for it.
    ``usable`` is a condition on the columns of ``labels`` (doc_id, toxic).
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("toxic").cast("int")).alias("most")).where("toxic = most").drop("most")
    drawn = cut(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    got, label = within(rows, drawn, SAMPLE_CHARS), {r.id: r.toxic for r in drawn.collect()}
    return learn([r.body for r in got], [label[r.id] for r in got])


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` without its text, with score and predicted."""
    small_batches(df.sparkSession)
    fields, columns = named(df, (text, "score", "predicted"))
    names = [f.name for f in fields] + ["score", "predicted"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [model.score(model.features(held)) for _, held in slabs(batch.columns[-1].to_numpy(zero_copy_only=False), SLAB)]
            p = np.round(np.concatenate(parts), 9) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names)

    return map_arrow(df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(unused(df, "body"))), run, schema)


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all their columns."""
    small_batches(df.sparkSession)
    names, at = df.columns, df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [model.score(model.features(held)) for _, held in slabs(batch.column(at).to_numpy(zero_copy_only=False), SLAB)]
            if parts:
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(np.round(np.concatenate(parts), 9) < threshold)).columns, names)

    return map_arrow(df, run, df.schema)
