"""Personal data in whole texts by DataFrame functions only: patterns propose, checksums confirm, context scores.

Every kind has a pattern, a validator and a score. Base kinds (email, ip, card, phone) keep every match that passes
their validator. Added kinds (iban, ssn) keep a match when its score, raised by a checksum and by context words in the
characters before it, reaches the threshold. Positions are code points, end exclusive.

A null text is the empty text and has no spans. Repeated rows are independent, since nothing crosses rows; spans of
different kinds may overlap, and redaction replaces them together. Texts of any length are read whole, in one
row; the work grows with the length of a text and its spans, not with their product. An empty table gives an empty
result. Other columns pass through, and only the result columns named here are replaced.

The patterns find the same matches as the plain ones in ``PLAIN`` but never scan a run of characters twice: a run can
only match from its first character (or from the end of the match before), and quantifiers are possessive where the
next part cannot begin with what they hold. The account number is the exception: it is cut to the length of its country
where it ends there, so that capitals behind it stay outside, and else backtracks over its 30 characters at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain forms of the base patterns, for tests and for reading.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters of an account number by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
#: Characters before a match in which context words count.
CONTEXT_CHARS = 40
#: Score that an added kind needs: a checksum or context words must stand beside the pattern.
THRESHOLD = 0.5
SPAN = "struct<kind:string,start:int,end:int,score:double>"


@dataclass(frozen=True)
class Kind:
    """One kind: a pattern, a cheap test that a text can hold it, its scores, and words that make it likelier."""

    name: str
    pattern: str
    guard: str
    base: bool
    prior: float
    context: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", True, 0.6, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", "", True, 0.7, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, "phone|tel|call|mobil|fax"),
    Kind("iban", IBAN, "", False, 0.3, "iban|account|konto|bank|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, "ssn|social|security|insurance"),
)
BONUS_CHECKSUM, BONUS_CONTEXT = 0.2, 0.3


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_valid(match: Column) -> Column:
    """The digits of ``match`` pass the Luhn check."""
    digits = F.reverse(digits_of(match))

    def step(total: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        doubled = d * 2
        return total + F.when(k % 2 == 1, d).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97_valid(match: Column) -> Column:
    """The account number passes ISO 7064 mod 97-10: country and check digits moved behind, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, k: Column) -> Column:
        c = F.ascii(F.substring(moved, k, F.lit(1)))
        return F.when(c < 58, (rest * 10 + (c - 48)) % 97).otherwise((rest * 100 + (c - 55)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of ``kind``."""
    n = F.length(digits_of(match))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(match, "\\."), lambda part: F.length(F.ltrim(part, F.lit("0"))).isin(0, 1, 2) | ((F.length(F.ltrim(part, F.lit("0"))) == 3) & (F.ltrim(part, F.lit("0")) <= "255"))),
        "card": n.between(13, 19) & luhn_valid(match),
        "phone": n.between(9, 15),
        "iban": mod97_valid(match),
        "ssn": ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000"),
    }[kind]


#: Values of one block of a running total, and characters of one piece of a text.
BLOCK, PIECE = 64, 4096


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a one-element transform binds it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op) -> Column:
    """For each of an array of integers the total of those before it, 0 for the first; ``op`` is a sum or a maximum.

    Totals run in blocks, since a fold copies its state at each step and must not hold an array that grows.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))

    def over(b: Column) -> Column:
        def within(totals: Column) -> Column:
            inside = lambda x, k: bound(F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), op), lambda base: F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j), base, op)))
            return F.flatten(F.transform(b, inside))

        return bound(F.transform(b, lambda x: F.aggregate(x, F.lit(0), op)), within)

    return F.when(F.size(values) > 0, bound(blocks, over)).otherwise(F.array().cast("array<int>"))


def cut_up(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, so that any part of it is found without a walk from its start."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def between(pieces: Column, a: Column, b: Column) -> Column:
    """Characters ``a`` to ``b`` of the text that was cut up."""
    first = F.floor(a / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(near, a - first * PIECE + 1, b - a)).otherwise("")


def kind_spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score), by start."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(parts: Column, at: Column) -> Column:
        def span(match: Column, k: Column) -> Column:
            begin = F.get(at, k) + F.length(F.get(parts["gaps"], k))
            before = between(parts["pieces"], F.greatest(begin - CONTEXT_CHARS, F.lit(0)), begin)
            score = F.lit(kind.prior) + F.lit(BONUS_CHECKSUM if kind.name in ("card", "iban") else 0.0)
            score = F.least(score + F.when(F.lower(before).rlike(rf"(?<!\p{{L}})(?:{kind.context})"), BONUS_CONTEXT).otherwise(0.0), F.lit(1.0))
            made = F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), (begin + F.length(match)).alias("end"), F.round(score, 6).alias("score"))
            return F.when(confirmed(kind.name, match), made)

        found = F.filter(F.transform(parts["matches"], span), lambda s: s.isNotNull())
        return found if kind.base else F.filter(found, lambda s: s["score"] >= THRESHOLD)

    def located(parts: Column) -> Column:
        sizes = F.transform(parts["matches"], lambda m, k: F.length(m) + F.length(F.get(parts["gaps"], k)))
        return bound(bound(sizes, lambda x: running(x, lambda a, b: a + b)), lambda at: spans(parts, at))

    parts = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"), cut_up(text).alias("pieces"))
    possible = F.contains(text, F.lit(kind.guard)) if kind.guard else F.lit(True)
    return F.when(possible & text.rlike(kind.pattern), bound(parts, located)).otherwise(none)


def find_pii(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, spans: str = "pii_spans") -> DataFrame:
    """``df`` with ``spans``: all spans of all kinds, in the order of ``kinds`` and then by start."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(spans, F.concat(*[kind_spans(body, k) for k in kinds]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``df`` (from ``find_pii``, with its column ``spans``) with each span replaced by its kind in brackets; spans that overlap are replaced together,
    by the kind of the first, of several with one start by that of the longest. A null text stays null."""
    body = F.col(text)
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))

    def replaced(x: Column) -> Column:
        # x: the spans by start, and before each of them the furthest end so far
        ordered, reach = x["spans"], x["reach"]
        fresh = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.get(ordered, k)["start"] >= F.get(reach, k))
        part = lambda at, k: F.concat(between(x["pieces"], F.get(reach, at), F.get(ordered, at)["start"]), F.lit("["), F.upper(F.get(ordered, at)["kind"]), F.lit("]"))
        last = F.array_max(F.transform(ordered, lambda s: -s["neg_end"]))
        return F.concat(F.array_join(F.transform(fresh, part), ""), between(x["pieces"], last, F.length(body)))

    reach = lambda ordered: bound(F.transform(ordered, lambda s: -s["neg_end"]), lambda ends: running(ends, lambda a, b: F.greatest(a, b)))
    found = bound(by_start, lambda ordered: F.struct(ordered.alias("spans"), reach(ordered).alias("reach"), cut_up(body).alias("pieces")))
    return df.withColumn(text, F.when(F.size(spans) > 0, bound(found, replaced)).otherwise(body))
