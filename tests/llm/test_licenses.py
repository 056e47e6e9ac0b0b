"""The license scan against a brute force over all rules without keywords and over all pairs of detections."""

import random
import re

from quillspark.llm import licenses
from quillspark.llm.license_rules import LEVELS, Rule, rules

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, listed):
    """(n_words, {label: starts}, kept detections) by trying every rule at every word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    base = {}
    for phrase, label in PHRASES.items():
        want = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(want)] == want]
        if at:
            base[label] = at
    line, found = " " + " ".join(words) + " ", []
    for r in listed:
        for m in re.finditer(r.pattern, line):
            start = line[: m.start()].count(" ")
            found.append((start, start + m.group().count(" "), r))
    found.sort(key=lambda d: (d[0], -d[1], -d[2].priority, d[2].order))
    kept = [d for k, d in enumerate(found) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2].priority >= d[2].priority for e in found[:k])]
    return len(words), base, [(s, e, r.label, r.order) for s, e, r in kept]


def sample(pattern, rng):
    """A text that the pattern matches, drawn from its alternatives."""
    import re._constants as kinds
    import re._parser as parser

    def draw(tree):
        out = ""
        for op, arg in tree:
            if op is kinds.LITERAL:
                out += chr(arg)
            elif op is kinds.IN:
                first, code = arg[0]
                out += "x" if first in (kinds.NEGATE, kinds.CATEGORY) else chr(rng.choice([c for k, c in arg if k is kinds.LITERAL])) if first is kinds.LITERAL else chr(code[0])
            elif op is kinds.MAX_REPEAT:
                out += "".join(draw(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            elif op is kinds.SUBPATTERN:
                out += draw(arg[-1])
            elif op is kinds.BRANCH:
                out += draw(rng.choice(arg[1]))
        return out

    return draw(parser.parse(pattern))


def scanned(spark, texts, listed=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {}
    for r in licenses.scan(df, listed=listed).select("doc_id", "license_scan").collect():
        base = {p.label: (p.n, p.first, p.last) for p in r.license_scan.base}
        rows[r.doc_id] = r.license_scan.n_words, base, [(d.start, d.end, d.label, d.rule) for d in r.license_scan.detections]
    return [rows[k] for k in range(len(texts))]


def expected(texts, listed):
    for text in texts:
        n, base, kept = brute(text, listed)
        yield n, {label: (len(at), min(at), max(at)) for label, at in base.items()}, kept


def test_rules_are_many_and_no_keyword_hides_a_match(spark):
    listed, rng = rules(), random.Random(3)
    assert len(listed) > 200 and len({r.pattern for r in listed}) == len(listed)
    words = {k for r in listed for k in r.keywords}
    assert not [(a, b) for a in words for b in words if a != b and b.startswith(a)]
    texts = []
    for r in listed:
        for _ in range(6):
            text = sample(r.pattern, rng)
            if re.search(r.pattern, f"{text} "):
                assert all(f" {k}" in text for k in r.keywords), (r, text)
                texts.append(text)
    mixed = ["\n// ".join(rng.sample(texts, 4)).title() for _ in range(300)]
    assert scanned(spark, mixed) == list(expected(mixed, listed))


def test_odd_texts(spark):
    texts = [None, "", "...", "MIT License mit-license (MIT) License", "GNU General Public License", "Ünder the mit license", "mit licenses", "mitlicense", "a\x00mit\x7flicense", "mit license " * 30, "all rights reserved"]
    texts += ["Apache License, Version 2.0 " + "word " * 400_000 + " General Public License", "licensed under cc by-nc 4.0. " * 3_000]
    assert scanned(spark, texts) == list(expected(texts, rules()))


def test_overlaps_priorities_and_ties(spark):
    order = iter(range(99))
    rule = lambda label, level, pattern: Rule(next(order), label, *LEVELS[level], ["a"], f" (?:{pattern})(?= )")
    listed = [rule("short", "text", "a b"), rule("long", "name", "a b c"), rule("same", "name", "a b c"), rule("over", "mention", "b c d"), rule("sure", "tag", "c d"), rule("inner", "mention", "b")]
    texts = ["a b c d", "x a b c", "a b", "b c d a", "a b c d a b c a b"]
    got = scanned(spark, texts, listed)
    assert got == list(expected(texts, listed))
    assert [d[2] for d in got[0][2]] == ["long", "short", "over", "sure"]  # a longer name does not hide a surer passage


def test_many_overlaps_by_brute_force(spark):
    rng = random.Random(8)
    listed = [Rule(k, f"l{k}", *LEVELS[rng.choice(list(LEVELS))], ["a"], " (?:" + " ".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + ")(?= )") for k in range(12)]
    texts = ["a " + " ".join(rng.choice("aab") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    assert scanned(spark, texts, listed) == list(expected(texts, listed))


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    df = spark.createDataFrame([(1, "MIT License", 7, "x"), (1, "MIT License", 7, "x"), (None, None, None, None)], "doc_id int, text string, Words int, `key.words` string")
    rows = licenses.scan(df).collect()
    assert sorted(str(r.Words) for r in rows) == ["7", "7", "None"] and licenses.scan(df).columns == [*df.columns, "license_scan"]


def test_query_of_small_tables(spark):
    """All documents of the smallest data set, against brute force."""
    from quillspark.llm import queries

    sf, listed = "/root/testdata/sf0.001", rules()
    got = {r.doc_id: r for r in queries.QUERIES["op13_license_scans"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, base, kept = brute(d.text, listed)
        r, starts = got[d.doc_id], [s for at in base.values() for s in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted({*base, *[k[2] for k in kept]}))
        assert r.score == max([listed[k[3]].confidence for k in kept], default=0.0)
