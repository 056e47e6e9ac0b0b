"""Unique names, schemas and rule findings against plain code."""

import random
import re
from xml.etree import ElementTree

import pytest

from quillspark.operators import derive
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.plans import catalog
from quillspark.plans import trees as plans
from quillspark.sources import markup

SF = "/root/testdata/sf0.001"


def one_by_one(names, reserved):
    used, out = set(), []
    for name in names:
        k, made = 2, name
        while made in used or (made != name and made in reserved):
            made, k = f"{name}{k}", k + 1
        used.add(made)
        out.append(made)
    return out


def test_first_free_suffix():
    assert derive.first_free(["a", "a", "a2"]) == ["a", "a2", "a22"]
    assert derive.first_free(["a", "a", "a2"], True) == ["a", "a3", "a2"]
    assert derive.first_free([]) == [] and derive.first_free(["a"] * 3) == ["a", "a2", "a3"]
    rng = random.Random(1)
    for _ in range(500):
        names = [rng.choice(["a", "a2", "a22", "b", "a3"]) for _ in range(rng.randint(0, 12))]
        assert derive.first_free(names) == one_by_one(names, set())
        assert derive.first_free(names, True) == one_by_one(names, set(names)) and len(set(derive.first_free(names))) == len(names)


def schema_of(nodes):
    """{root: schema} and {pre: reference} by recursion."""
    refs, schemas = {}, {}

    def kind(text):
        t = text.strip(" ")
        for pattern, name in (("[+-]?[0-9]{1,18}", "integer"), (r"[+-]?[0-9]+\.[0-9]+", "decimal"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "date"), ("true|false", "boolean")):
            if re.fullmatch(pattern, t):
                return f"xs:{name}"
        return "xs:string"

    def element(n, name, above):
        refs[n["pre"]] = f"{above}/{name}"
        below = [m for m in nodes if m["parent"] == n["pre"]]
        if not below:
            return f'<xs:element name="{name}" type="{kind("".join(n["text"]))}"/>'
        inner = "".join(element(m, x, refs[n["pre"]]) for m, x in zip(below, one_by_one([m["name"] for m in below], set())))
        return f'<xs:element name="{name}"><xs:complexType><xs:sequence>{inner}</xs:sequence></xs:complexType></xs:element>'

    roots = [n for n in nodes if n["parent"] is None]
    for n, x in zip(roots, one_by_one([n["name"] for n in roots], set())):
        schemas[n["pre"]] = f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{element(n, x, "")}</xs:schema>'
    return schemas, refs


def test_schemas_equal_recursion(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(2)
    texts = [(k if k else None, "".join(rng.choice(["<a>", "<b>", "<a2>", "</a>", "</b>", "12", "x", " 1.5", "true", "2020-01-02", "</a2>"]) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    table = markup.node_table(spark.createDataFrame([t for t in texts if t[0] is not None] + [(99, None)], "doc int, html string"), ["doc"], "html")
    schemas, refs = derive.derive_schemas(table, ["doc"])
    got, got_refs = {(r.doc, r.root): r.schema for r in schemas.collect()}, {(r.doc, r.pre): r.reference for r in refs.collect()}
    want, want_refs = {}, {}
    for doc, text in texts:
        if doc is not None:
            s, f = schema_of(markup.nodes_of(text))
            want |= {(doc, k): v for k, v in s.items()}
            want_refs |= {(doc, k): v for k, v in f.items()}
    assert got == want and got_refs == want_refs
    for schema in got.values():
        ElementTree.fromstring(schema)


def test_schema_query(spark):
    rows = catalog.QUERIES["schema_derivation"](spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert sorted((r.page_id, r.n_elements) for r in rows if r.root == 0) == sorted((p.page_id, len(markup.nodes_of(p.html))) for p in pages) and any(r.n_renamed for r in rows)


def findings(pages, rules):
    out = []
    for page, html in pages:
        html = html or ""
        for rule, scope, element, attribute, pattern, unless, absent, least, severity in rules:
            if scope == "text":
                n = len(re.findall(pattern, html)) if pattern else 1
                if ((n >= least) != absent) and not (unless and re.search(unless, html)):
                    out.append((page, None, rule, severity, str(n)))
                continue
            for node in markup.nodes_of(html):
                if element and not re.fullmatch(element, node["name"]):
                    continue
                values = [a["value"] for a in node["attributes"] if a["name"] == attribute] if attribute else ["".join(node["text"])]
                hits = [v for v in values if not pattern or re.search(pattern, v)]
                if (bool(hits) != absent) and not (unless and any(re.search(unless, f"{a['name']}={a['value']}") for a in node["attributes"])):
                    out.append((page, node["pre"], rule, severity, hits[0] if hits else ""))
    return sorted(out, key=str)


def test_rules_equal_plain_search(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in catalog.QUERIES["rule_table"](spark, SF).select("page_id", "pre", "rule", "severity", "detail").collect()), key=str)
    assert len(plans.PAGE_RULES) >= 20 and got == findings(pages, plans.PAGE_RULES) and len({g[2] for g in got}) >= 8


def test_rule_sweep_is_a_special_case(spark):
    rules = spark.createDataFrame(plans.PAGE_RULES[:4], plans.RULE_SCHEMA)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    assert sorted(map(tuple, derive.text_findings(pages, "html", rules).select("rule", "page_id").collect())) == sorted(map(tuple, catalog.QUERIES["rule_sweep"](spark, SF).select("rule", "page_id").collect()))


def test_rules_of_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "<a>x</a><a href=''>y</a>"), (3, "<p id='1'>z</p><p>"), (None, "<H1>#</H1><div class='x ad'>")]
    rules = [*plans.PAGE_RULES, ("any", "element", None, None, None, None, False, 1, "info"), ("short", "text", None, None, None, "<", False, 1, "info")]
    frame = spark.createDataFrame(rules, plans.RULE_SCHEMA)
    df = spark.createDataFrame(pages, "page_id int, html string")
    texts = derive.text_findings(df, "html", frame)
    got = [(r.page_id, None, r.rule, r.severity, str(r.n)) for r in texts.collect()]
    got += [tuple(r) for r in derive.element_findings(markup.node_table(df, ["page_id"], "html"), ["page_id"], frame).select("page_id", "pre", "rule", "severity", "detail").collect()]
    assert sorted(got, key=str) == findings(pages, rules)
    none = spark.createDataFrame([], plans.RULE_SCHEMA)
    assert derive.text_findings(df, "html", none).count() == 0
    with pytest.raises(ValueError):
        derive.rule_array(spark.createDataFrame([rules[0]] * 2_001, plans.RULE_SCHEMA))
