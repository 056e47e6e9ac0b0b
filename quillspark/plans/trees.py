"""Queries over the node tables of pages: nodes, paths, scopes, faults and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import derive, trees
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.plans.registry import query
from quillspark.session import table
from quillspark.sources.markup import node_table

#: What the checks of pages ask for: attributes of elements, and where elements may stand.
REQUIRED = {"html": ["lang"], "a": ["href"], "meta": ["charset"], "img": ["src", "alt"]}
INSIDE = {"li": ["ul", "ol"], "title": ["head"], "article": ["body"], "p": ["article", "body", "div", "td"], "h1": ["article"]}
EXPRESSIONS = ["$", "$.body.article.h1", "$.body..a", "ul.li[*]", "ul.li[2].a", "article..b", "p[1]", "a[3]", "$.head.meta[0]", "body.article.p[0]", "li[1]..a", "$..footer", "nav..ul..li[0]", "b.p", "$.body.*", "a."]


#: SQL for the same nodes: tokens of each page, a recursion that carries the open elements, then places, paths and intervals.
NODES = r"""
    t AS (SELECT page_id, token, k FROM (SELECT page_id, unnest(x) AS token, generate_subscripts(x, 1) AS k FROM (SELECT page_id,
            list_filter(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->|<(?:script|style)[^<>]*>.*?</(?:script|style)[^<>]*>|<[!?][^>]*>|</[A-Za-z_][^<>]*>|<[A-Za-z_](?:[^<>"'']|"[^"]*"|''[^'']*'')*>'), lambda s: NOT regexp_matches(s, '^<[!?]')) AS x FROM pages))),
    c AS (SELECT page_id, k, regexp_extract(token, '^<[^>]*>') AS tag, lower(regexp_extract(token, '^</?([A-Za-z_][^\s<>/]*)', 1)) AS name, starts_with(token, '</') AS shut,
            regexp_matches(token, '^<(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)[\s/>]|/>$|^<(?:script|style)') AS bare FROM t),
    r AS (SELECT page_id, 0::BIGINT AS k, 0 AS made, []::STRUCT(name VARCHAR, pre INT)[] AS open, NULL::INT AS parent, 0 AS depth, NULL::VARCHAR AS name, NULL::INT AS pre, NULL::VARCHAR AS tag, []::INT[] AS gone, NULL::INT AS stray FROM pages
      UNION ALL
      SELECT page_id, k, made + CASE WHEN shut THEN 0 ELSE 1 END,
             CASE WHEN shut THEN CASE WHEN found = 0 THEN open ELSE open[1:found - 1] END WHEN bare THEN open ELSE list_append(open, {'name': name, 'pre': made}) END,
             CASE WHEN NOT shut AND len(open) > 0 THEN open[len(open)].pre END, len(open), CASE WHEN NOT shut THEN name END, CASE WHEN NOT shut THEN made END, tag,
             CASE WHEN shut AND found > 0 THEN list_transform(open[found + 1:], lambda s: s.pre) ELSE [] END, CASE WHEN shut AND found = 0 AND len(open) > 0 THEN open[len(open)].pre END
      FROM (SELECT c.page_id, c.k, c.tag, c.name, c.shut, c.bare, r.open, r.made, coalesce(list_max(list_transform(range(1, len(r.open) + 1), lambda i: CASE WHEN r.open[i].name = c.name THEN i ELSE 0 END)), 0) AS found
            FROM r JOIN c ON c.page_id = r.page_id AND c.k = r.k + 1)),
    e AS (SELECT page_id, pre, parent, depth::INT AS depth, name, regexp_extract_all(tag, '[^\s="''/<>]+="[^"]*"') AS attributes, (row_number() OVER (PARTITION BY page_id, parent, name ORDER BY pre) - 1)::INT AS ord, (row_number() OVER (PARTITION BY page_id, name ORDER BY pre) - 1)::INT AS nth FROM r WHERE pre IS NOT NULL),
    p AS (SELECT page_id, pre, '/' || name || '#' || ord AS path, []::INT[] AS above FROM e WHERE parent IS NULL UNION ALL SELECT e.page_id, e.pre, p.path || '/' || e.name || '#' || e.ord, list_append(p.above, p.pre) FROM p JOIN e ON e.page_id = p.page_id AND e.parent = p.pre),
    b AS (SELECT page_id, a AS pre, max(pre) AS last FROM (SELECT page_id, pre, unnest(list_append(above, pre)) AS a FROM p) GROUP BY page_id, a),
    n AS MATERIALIZED (SELECT e.page_id, e.pre, b.last::INT AS last, e.parent, e.depth, e.name, e.ord, e.nth, p.path, p.above, e.attributes FROM e JOIN p ON e.page_id = p.page_id AND e.pre = p.pre JOIN b ON b.page_id = e.page_id AND b.pre = e.pre)
"""
NODES = f"WITH RECURSIVE {NODES.strip()}"


def page_nodes(spark, sf_dir, columns: list[str] | None = None):
    return node_table(table(spark, sf_dir, "pages"), ["page_id"], "html", columns=columns)


@query("xml_nodes", rf"""{NODES} SELECT page_id, pre, last, parent, depth, name, ord, nth, path, replace(array_to_string(attributes, ' '), '"', '') AS attributes FROM n""")
def xml_nodes(spark, sf_dir):
    """All elements of all pages, with their intervals, paths and attributes."""
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), " ")
    return page_nodes(spark, sf_dir).select("page_id", "pre", "last", "parent", "depth", "name", "ord", "nth", "path", attributes.alias("attributes"))


@query(
    "xml_violations",
    rf"""
    {NODES},
    d AS (SELECT page_id, arg_max(open, k) AS open FROM r GROUP BY page_id),
    u AS (SELECT page_id, unnest(gone) AS pre FROM r UNION ALL SELECT page_id, unnest(list_transform(open, lambda s: s.pre)) FROM d),
    a AS (SELECT page_id, pre, name, unnest(attributes) AS x FROM n),
    needed(name, attr) AS (VALUES ('html', 'lang'), ('a', 'href'), ('meta', 'charset'), ('img', 'src'), ('img', 'alt')),
    allowed(name, parents) AS (VALUES ('li', ['ul', 'ol']), ('title', ['head']), ('article', ['body']), ('p', ['article', 'body', 'div', 'td']), ('h1', ['article']))
    SELECT u.page_id, u.pre, 'unclosed' AS rule, n.name AS detail FROM u JOIN n ON n.page_id = u.page_id AND n.pre = u.pre
    UNION ALL SELECT page_id, stray, 'stray_close', 'stray_close' FROM r WHERE stray IS NOT NULL
    UNION ALL SELECT page_id, pre, 'second_root', name FROM n WHERE depth = 0 AND pre > 0
    UNION ALL SELECT page_id, pre, 'duplicate_attribute', regexp_extract(x, '^[^=]+') FROM a GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT n.page_id, n.pre, 'missing_attribute', attr FROM n JOIN needed ON needed.name = n.name WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = n.page_id AND a.pre = n.pre AND starts_with(x, attr || '=') AND trim(x[length(attr) + 2:], ' "') <> '')
    UNION ALL SELECT n.page_id, n.pre, 'wrong_parent', n.name || ' in ' || coalesce(m.name, 'nothing') FROM n JOIN allowed ON allowed.name = n.name LEFT JOIN n m ON m.page_id = n.page_id AND m.pre = n.parent WHERE NOT coalesce(list_contains(parents, m.name), false)
    """,
)
def xml_violations(spark, sf_dir):
    """Faults in the markup of all pages: broken nesting, missing and repeated attributes, misplaced elements, undeclared prefixes."""
    ensure_checkpoint_dir(spark)
    nodes = page_nodes(spark, sf_dir, ["pre", "last", "depth", "name", "path", "attributes", "issues"])
    return trees.violations(nodes, ["page_id"], REQUIRED, INSIDE)


@query(
    "path_expressions",
    rf"""
    {NODES},
    x(expr_id, fits, place) AS (VALUES (0, '^/[^/]+$', NULL), (1, '^/[^/]+/body#\d+/article#\d+/h1#\d+$', NULL), (2, '^/[^/]+/body#\d+(/.+)?/a#\d+$', NULL), (3, '(^|/)ul#\d+/li#\d+$', NULL), (4, '(^|/)ul#\d+/li#2/a#\d+$', NULL),
      (5, '(^|/)article#\d+(/.+)?/b#\d+$', NULL), (6, '(^|/)p#\d+$', 1), (7, '(^|/)a#\d+$', 3), (8, '^/[^/]+/head#\d+/meta#0$', NULL), (9, '(^|/)body#\d+/article#\d+/p#0$', NULL), (10, '(^|/)li#1(/.+)?/a#\d+$', NULL),
      (11, '^/[^/]+(/.+)?/footer#\d+$', NULL), (12, '(^|/)nav#\d+(/.+)?/ul#\d+(/.+)?/li#0$', NULL), (13, '(^|/)b#\d+/p#\d+$', NULL))
    SELECT page_id, expr_id, pre, path FROM n JOIN x ON regexp_matches(path, fits) AND (place IS NULL OR nth = place)
    """,
)
def path_expressions(spark, sf_dir):
    """All elements of all pages that fit each of a table of path expressions."""
    expressions = spark.createDataFrame(list(enumerate(EXPRESSIONS)), "expr_id int, expr string")
    # a list of this file: a join by shuffle would bring all elements of a name into one task
    return trees.resolve_paths(page_nodes(spark, sf_dir, ["pre", "depth", "name", "nth", "path"]), F.broadcast(expressions)).select("page_id", "expr_id", "pre", "path")


@query(
    "scope_walk",
    rf"""
    {NODES},
    q AS (SELECT page_id, pre AS context, above, unnest(['h1', 'p', 'title', 'li', 'table']) AS wanted FROM n WHERE name IN ('b', 'a', 'div')),
    g AS (SELECT page_id, context, wanted, unnest(list_reverse(above)) AS under, generate_subscripts(above, 1) AS level FROM q),
    f AS (SELECT g.page_id, context, wanted, [level, CASE WHEN c.pre = under THEN 1 ELSE 0 END, c.pre] AS found FROM g JOIN n c ON c.page_id = g.page_id AND c.name = wanted AND (c.parent = under OR c.pre = under OR c.above[len(c.above) - 1] = under)
      UNION ALL SELECT q.page_id, context, wanted, [0, 0, c.pre] FROM q JOIN n c ON c.page_id = q.page_id AND c.name = wanted AND c.parent = context
      UNION ALL SELECT q.page_id, context, wanted, [-1, 0, min(c.pre)] FROM q JOIN n c ON c.page_id = q.page_id AND c.name = wanted GROUP BY q.page_id, context, wanted HAVING count(*) = 1
      UNION ALL SELECT q.page_id, context, wanted, [CASE WHEN bool_or(c.depth = 0) THEN 1000000 ELSE 1000001 END, 0, coalesce(min(c.pre) FILTER (WHERE c.depth = 0), min(c.pre))] FROM q JOIN n c ON c.page_id = q.page_id AND c.name = wanted GROUP BY q.page_id, context, wanted),
    m AS (SELECT page_id, context, wanted, min(found) AS best FROM f GROUP BY page_id, context, wanted)
    SELECT q.page_id, q.context, q.wanted, best[3]::INT AS target, best[1]::INT AS level FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.context = q.context AND m.wanted = q.wanted
    """,
)
def scope_walk(spark, sf_dir):
    """For each bold or linked element of a page the nearest heading, paragraph and title in scope."""
    ensure_checkpoint_dir(spark)
    nodes = page_nodes(spark, sf_dir, ["pre", "ancestors", "depth", "name"]).checkpoint()  # parsed once
    wanted = F.explode(F.array(*map(F.lit, ["h1", "p", "title", "li", "table"])))
    asked = nodes.where(F.col("name").isin("b", "a", "div")).select("page_id", F.col("pre").alias("context"), wanted.alias("wanted"))
    asked = asked.withColumn("ref_id", F.concat_ws(":", "context", "wanted"))
    return trees.resolve_scopes(nodes, asked, ["page_id"]).select("page_id", "context", "wanted", "target", "level")


def edit_log(nodes):
    """Edits of every page: new headings and texts, list items removed, paragraphs added; some batches hold a fault."""
    edit = lambda rows, seq, op, name, text: rows.select("page_id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "path", F.lit(name).cast("string").alias("name"), F.lit(text).cast("string").alias("text"))
    of = lambda name, at=0: nodes.where((F.col("name") == name) & (F.col("nth") == at))
    log = [
        edit(of("h1"), 1, "replace", "h2", "A new heading"),
        edit(of("li", 1), 2, "remove", None, None),
        edit(of("title"), 3, "set", None, "A new title"),
        edit(of("p"), 4, "insert_before", "p", "First"),
        edit(of("li", 1), 5, "insert_after", "li", "Instead"),
        edit(of("ul"), 6, "insert_child", "li", "Last"),
        edit(of("nav").where("page_id % 4 = 1"), 7, "remove", None, None),  # with its items, two of which have edits
        edit(of("html").where("page_id % 4 = 2").withColumn("path", F.lit("/html#0/nowhere#0")), 8, "set", None, "x"),
    ]
    out = log[0]
    for more in log[1:]:
        out = out.unionByName(more)
    return out


@query("tree_edit_batches")
def tree_edit_batches(spark, sf_dir):
    """All pages after their batches of edits: batches with a fault leave their page as it was."""
    ensure_checkpoint_dir(spark)
    nodes = page_nodes(spark, sf_dir).checkpoint()
    tree, verdicts = trees.apply_edits(nodes, edit_log(nodes), ["page_id"])
    return tree.join(verdicts, "page_id", "left").select("page_id", "pre", "last", "depth", "path", F.md5("text").alias("text_md5"), F.coalesce("accepted", F.lit(False)).alias("edited"), "faults")


@query("schema_derivation")
def schema_derivation(spark, sf_dir):
    """A schema for the tree of every page, and how many of its elements needed a suffix."""
    ensure_checkpoint_dir(spark)
    nodes = page_nodes(spark, sf_dir).checkpoint()
    schemas, refs = derive.derive_schemas(nodes, ["page_id"])
    renamed = refs.join(nodes.select("page_id", "pre", "name"), ["page_id", "pre"]).where(F.element_at(F.split("reference", "/"), -1) != F.col("name"))
    counts = nodes.groupBy("page_id").agg(F.count("*").alias("n_elements")).join(renamed.groupBy("page_id").agg(F.count("*").alias("n_renamed")), "page_id", "left").na.fill(0, ["n_renamed"])
    return schemas.join(counts, "page_id").select("page_id", "root", F.md5("schema").alias("schema_md5"), F.length("schema").alias("n_chars"), "n_elements", "n_renamed")


#: Rules of pages: rule, scope, element, attribute, pattern, unless, absent, least, severity.
PAGE_RULES = [
    ("script", "text", None, None, "<script", None, False, 1, "warning"),
    ("no_lang", "text", None, None, "<html[^>]* lang=", None, True, 1, "error"),
    ("comment", "text", None, None, "<!--", None, False, 1, "info"),
    ("double_h1", "text", None, None, "<h1[ >]", None, False, 2, "error"),
    ("many_links", "text", None, None, "<a[ >]", '<html lang="de"', False, 6, "info"),
    ("no_footer", "text", None, None, "<footer", None, True, 1, "warning"),
    ("entities", "text", None, None, "&amp;&amp;", None, False, 1, "info"),
    ("relative_link", "element", "a", "href", "^/", None, False, 1, "info"),
    ("outside_link", "element", "a", "href", "^https?://", None, False, 1, "info"),
    ("comma_link", "element", "a", "href", ",$", None, False, 1, "warning"),
    ("no_target", "element", "a", "href", None, None, True, 1, "error"),
    ("no_charset", "element", "meta", "charset", "^(?:utf|UTF)-8$", None, True, 1, "error"),
    ("foreign_page", "element", "html", "lang", "^(?:de|fr|es)$", None, False, 1, "info"),
    ("no_page_lang", "element", "html", "lang", "^[a-z]{2}$", None, True, 1, "error"),
    ("advert", "element", "div", "class", "(?:^| )ad(?: |$)", None, False, 1, "warning"),
    ("unclassed", "element", "div|p", "class", None, "^id=", True, 1, "info"),
    ("symbols", "element", "h1|title", None, "[#*%$]", None, False, 1, "warning"),
    ("empty_heading", "element", "h1", None, "^\\s*$", None, False, 1, "error"),
    ("long_heading", "element", "h[1-6]", None, ".{60,}", None, False, 1, "warning"),
    ("inline_style", "element", None, "style", None, None, False, 1, "warning"),
    ("click_handler", "element", None, "onclick", None, None, False, 1, "error"),
    ("tracking", "element", "script", None, "track\\(", None, False, 1, "warning"),
    ("bold_start", "element", "b", None, "^[A-Z]", None, False, 1, "info"),
]
RULE_SCHEMA = "rule string, scope string, element string, attribute string, pattern string, unless string, absent boolean, least int, severity string"


@query("rule_table")
def rule_table(spark, sf_dir):
    """Findings of a table of rules over the texts and the elements of all pages."""
    rules = spark.createDataFrame(PAGE_RULES, RULE_SCHEMA)
    whole = derive.text_findings(table(spark, sf_dir, "pages").select("page_id", "html"), "html", rules)
    parts = derive.element_findings(page_nodes(spark, sf_dir), ["page_id"], rules)
    return whole.select("page_id", F.lit(None).cast("int").alias("pre"), "rule", "severity", F.col("n").cast("string").alias("detail")).unionByName(parts.select("page_id", "pre", "rule", "severity", "detail"))
