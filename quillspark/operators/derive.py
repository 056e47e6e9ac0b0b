"""What follows from node tables: unique names, schema texts, and findings of a table of rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_free(names: list[str], keep_natural: bool = False) -> list[str]:
    """Names in their order, each as it is if free, else with the first free suffix from 2 on.

    With ``keep_natural`` all given names are taken from the start, so that the first of each keeps it: ``a, a, a2`` gives ``a, a3, a2``, and
    without ``a, a2, a22``.
    """
    natural = set(names) if keep_natural else set()
    used, following, out = set(), {}, []
    for name in names:
        if name in used:
            k = following.get(name, 2)
            while f"{name}{k}" in used or f"{name}{k}" in natural:
                k += 1
            following[name], name = k + 1, f"{name}{k}"
        used.add(name)
        out.append(name)
    return out


def unique_names(nodes: DataFrame, keys: list[str], keep_natural: bool = False) -> DataFrame:
    """(keys, pre, unique): a name for each node that no sibling has.

    Siblings without a clash keep theirs in column expressions; only lists with one go through Python, and the children of
    one node must fit a task.
    """
    parent = F.try_element_at("ancestors", F.lit(-1))
    lists = nodes.groupBy(*keys, parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("pre", "name"))).alias("children"))
    names = F.transform("children", lambda c: c["name"])
    lists = lists.select(*keys, F.transform("children", lambda c: c["pre"]).alias("pres"), names.alias("names"), (F.size(F.array_distinct(names)) < F.size("children")).alias("clash"))

    @F.pandas_udf("array<string>")
    def freed(column):
        return column.map(lambda xs: first_free(list(xs), keep_natural))

    plain = lists.where("NOT clash").select(*keys, F.arrays_zip("pres", F.col("names").alias("given")).alias("z"))
    mended = lists.where("clash").select(*keys, F.arrays_zip("pres", freed("names").alias("given")).alias("z"))
    return plain.unionByName(mended).select(*keys, F.explode("z").alias("z")).select(*keys, F.col("z.pres").alias("pre"), F.col("z.given").alias("unique"))


def type_of(text: Column) -> Column:
    """The schema type of a leaf's text."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain.rlike("^[+-]?[0-9]{1,18}$"), "xs:integer").when(plain.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), "xs:decimal").when(plain.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "xs:date").when(plain.isin("true", "false"), "xs:boolean").otherwise("xs:string")


def derive_schemas(nodes: DataFrame, keys: list[str], keep_natural: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one schema text for each root, the reference of each node): nested elements with unique names, leaves with a type.

    A text is the concatenation of what each node opens, at its ``pre``, and closes, behind the last of its subtree, the deepest first:
    one sorted aggregate for each document, whatever its depth. References are paths of unique names.
    """
    named = nodes.join(unique_names(nodes, keys, keep_natural), [*keys, "pre"]).checkpoint()
    leaf = F.col("pre") == F.col("last")
    tag = F.concat(F.lit('<xs:element name="'), F.col("unique"), F.lit('"'))
    opened = F.when(leaf, F.concat(tag, F.lit(' type="'), type_of(F.col("text")), F.lit('"/>'))).otherwise(F.concat(tag, F.lit("><xs:complexType><xs:sequence>")))
    closed = F.when(~leaf, F.lit("</xs:sequence></xs:complexType></xs:element>"))
    root = F.coalesce(F.try_element_at("ancestors", F.lit(1)), F.col("pre"))
    pieces = named.select(*keys, root.alias("root"), F.explode(F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("up"), opened.alias("text")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("up"), closed.alias("text")))).alias("p"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "")
    schemas = pieces.where("p.text IS NOT NULL").groupBy(*keys, "root").agg(F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'), body, F.lit("</xs:schema>")).alias("schema"))
    line = named.select(*keys, "pre", F.posexplode(F.concat("ancestors", F.array("pre"))).alias("step", "of"))
    labels = named.select(*keys, F.col("pre").alias("of"), F.concat(F.lit("/"), F.col("unique")).alias("label"))
    refs = line.join(labels, [*keys, "of"]).groupBy(*keys, "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "label"))), lambda s: s["label"]), "").alias("reference"))
    return schemas, refs


#: Columns of a rule table; null patterns hold always, ``least`` is how many matches a text needs.
RULE_FIELDS = ("rule", "scope", "element", "attribute", "pattern", "unless", "absent", "least", "severity")
MOST_RULES = 2_000


def rule_array(rules: DataFrame) -> Column:
    """A table of rules as one constant array; there are at most ``MOST_RULES``, more raise an error."""
    rows = rules.select(*RULE_FIELDS).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rows = sorted((r.asDict() for r in rows), key=lambda r: json.dumps(r, sort_keys=True))
    schema = "array<struct<rule:string,scope:string,element:string,attribute:string,pattern:string,unless:string,absent:boolean,least:int,severity:string>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def text_findings(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """``df``'s other columns with (rule, severity, n) of each rule of scope ``text`` that a text breaks, all in one scan.

    A rule is broken by ``least`` or more matches of its pattern, or, if ``absent``, by fewer; never by a text that matches ``unless``. A null text is empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    listed = F.filter(rule_array(rules), lambda r: r["scope"] == "text")

    def judged(r: Column) -> Column:
        n = F.when(r["pattern"].isNull(), F.lit(1)).otherwise(F.size(F.regexp_extract_all(body, r["pattern"], F.lit(0))))
        enough = n >= F.coalesce(r["least"], F.lit(1))
        excepted = F.coalesce(F.regexp_like(body, r["unless"]), F.lit(False))
        return F.when((enough != F.coalesce(r["absent"], F.lit(False))) & ~excepted, F.struct(r["rule"].alias("rule"), r["severity"].alias("severity"), n.cast("long").alias("n")))

    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*others, F.explode(F.filter(F.transform(listed, judged), lambda f: f.isNotNull())).alias("found")).select(*others, "found.*")


def element_findings(nodes: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """(keys, pre, rule, severity, detail) of each rule of scope ``element`` that an element breaks, all in one scan of the nodes.

    A rule looks at elements whose whole name matches ``element`` (null: all). It is broken if ``attribute`` is there and its value matches ``pattern``, or, if
    ``absent``, if no such attribute is there; without an attribute the pattern is that of the element's own text. ``unless`` excepts
    elements with some attribute, as ``name=value``, that matches.
    """
    listed = F.filter(rule_array(rules), lambda r: r["scope"] == "element")
    pairs = F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"]))
    own_text = F.coalesce("text", F.lit(""))

    def judged(r: Column) -> Column:
        fits = lambda v: F.coalesce(F.regexp_like(v, r["pattern"]), F.lit(True))
        values = F.when(r["attribute"].isNull(), F.array(own_text)).otherwise(F.transform(F.filter("attributes", lambda a: a["name"] == r["attribute"]), lambda a: a["value"]))
        hits = F.filter(values, fits)
        applies = F.coalesce(F.regexp_like("name", F.concat(F.lit("^(?:"), r["element"], F.lit(")$"))), F.lit(True))
        excepted = F.coalesce(F.exists(pairs, lambda p: F.regexp_like(p, r["unless"])), F.lit(False))
        broken = applies & ((F.size(hits) > 0) != F.coalesce(r["absent"], F.lit(False))) & ~excepted
        return F.when(broken, F.struct(r["rule"].alias("rule"), r["severity"].alias("severity"), F.coalesce(F.get(hits, F.lit(0)), F.lit("")).alias("detail")))

    found = nodes.select(*keys, "pre", F.explode(F.filter(F.transform(listed, judged), lambda f: f.isNotNull())).alias("found"))
    return found.select(*keys, "pre", "found.*")
