"""The ordered analysis of documents: their lines are nodes, and modules claim them one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import form_modules as fm
from quillspark.operators.modules import MarkModule, RowModule, SetModule, repeated_nodes, run_modules
from quillspark.plans.registry import query
from quillspark.plans.scalars import LINES
from quillspark.session import table


def line_modules() -> list[RowModule | SetModule]:
    """The modules in their order: what is not printed or empty, page furniture, then content from the surest sign down."""
    line = F.col("line")
    marker = tx.list_marker(line)
    return [
        RowModule("no_print", F.when(F.trim(line) == "", "blank")),
        SetModule("master_page", repeated_nodes("source", "doc_id", "line", ["doc_id", "n"])),
        RowModule("footnote", F.when(line.rlike("^(\\*|[0-9]+\\)) "), "footnote")),
        RowModule("placeholder", F.when(tx.is_placeholder(line), "placeholder")),
        RowModule("inline_date", F.when(tx.inline_date(line) != "", "date")),
        RowModule("list", F.when(marker != "none", marker)),
        RowModule("heading", F.when((F.length(line) <= 40) & ~line.rlike("[.!?:;,]$"), "heading")),
        RowModule("text_block", F.lit("text")),
    ]


@query(
    "analysis_modules",
    rf"""
    WITH l AS (SELECT d.doc_id, d.source, x.n, x.line FROM documents d JOIN ({LINES}) x ON d.doc_id = x.doc_id), f AS (SELECT * FROM l WHERE trim(line) <> ''),
    t AS (SELECT source, count(DISTINCT doc_id) AS m FROM f GROUP BY source), o AS (SELECT f.source, f.line FROM f JOIN t ON f.source = t.source GROUP BY f.source, f.line, m HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) >= m * 0.05),
    k AS (SELECT l.doc_id, l.n, CASE WHEN trim(l.line) = '' THEN 'no_print' WHEN o.line IS NOT NULL THEN 'master_page' WHEN regexp_matches(l.line, '^(\*|[0-9]+\)) ') THEN 'footnote'
      WHEN regexp_matches(trim(l.line), '^[._…\-–—]{{3,}}$') THEN 'placeholder' WHEN regexp_matches(l.line, '\d{{1,2}}\.\s*\.\s*\d*') THEN 'inline_date'
      WHEN regexp_matches(l.line, '^[-•–*] |^[0-9]{{1,2}}(\.[0-9]{{1,2}}){{1,3}}\.? |^[0-9]{{1,3}}[.)] |^\(([ivxlc]+|[IVXLC]+)\) |^\([A-Za-z0-9]\) |^([ivxlc]{{2,}}|[IVXLC]{{2,}})[.)] |^[A-Za-z][.)] ') THEN 'list'
      WHEN length(l.line) <= 40 AND NOT regexp_matches(l.line, '[.!?:;,]$') THEN 'heading' ELSE 'text_block' END AS module FROM l LEFT JOIN o ON o.source = l.source AND o.line = l.line)
    SELECT doc_id, module, count(*) AS n_lines, min(n) AS first_line FROM k GROUP BY ALL
    """,
)
def analysis_modules(spark, sf_dir):
    """Lines of each document by the module that claims them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))
    claimed = run_modules(lines, line_modules(), ["doc_id", "n"])
    return claimed.groupBy("doc_id", "module").agg(F.count("*").alias("n_lines"), F.min("n").alias("first_line"))


def form_modules() -> list[RowModule | MarkModule]:
    """Modules of boxes in their order: groups of marks before single ones, fields with their names, tables, repeats, then what is left."""
    kind = F.col("node_kind")
    return [
        MarkModule("radio_group", named(fm.column_runs("radio", "group", 8.0))),
        RowModule("radio", F.when(kind == "radio", "single")),
        MarkModule("checkbox_group", named(fm.column_runs("checkbox", "group", 8.0))),
        RowModule("checkbox", F.when(kind == "checkbox", "single")),
        MarkModule("inline_label", named(fm.before_field("x", "y", "w", "left", 25.0))),
        MarkModule("caption", named(fm.before_field("y", "x", "h", "above", 6.0))),
        MarkModule("field_table", named(fm.tables(F.col("kind") == "field", "cell", 4.0))),
        MarkModule("repeat", named(fm.repeated_rows("row", 1.0))),
        MarkModule("grid", named(fm.tables(F.col("kind").isNotNull(), "cell", 2.0, 3, 3))),
        MarkModule("text_block", named(fm.line_blocks("text", "line", 30.0))),
        MarkModule("column_layout", named(fm.dominant_columns("column", 0.2))),
        RowModule("field", F.when(kind == "field", "single")),
        RowModule("text", F.lit("single")),
    ]


def named(marks):
    """The marks of a module that calls the kind of a node ``kind``, which the runner keeps for its own."""
    return lambda nodes: marks(nodes.withColumnsRenamed({"kind": "_kind", "node_kind": "kind"})).withColumnsRenamed({"kind": "node_kind", "_kind": "kind"})


def form_boxes(spark, sf_dir, dealt: bool = False):
    """Line items as boxes of the page of their part: marks, fields and texts by their flags; of items with one number the least box.

    Items can be ``dealt`` by page before, for modules that look at pages.
    """
    node_kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "checkbox").otherwise("radio")).when((F.col("l_returnflag") == "A") | (F.col("l_linenumber") % 3 == 0), "field").otherwise("text")
    node_kind = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 5 == 0), "radio").otherwise(node_kind)
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"), node_kind.alias("node_kind"),
        F.round(F.col("l_discount") * 500).alias("x"), (F.floor(F.col("l_quantity") / 5) * 6).cast("double").alias("y"), (F.round(F.col("l_tax") * 200) + 4).alias("w"), F.lit(5.0).alias("h"),
    )
    keys = ["page", "node"]
    if dealt:
        boxes, keys = fm.deal(boxes, boxes.count()), [*fm.WITHIN, "node"]
    return boxes.groupBy(*keys).agg(F.min(F.struct("node_kind", "x", "y", "w", "h")).alias("box")).select(*keys, "box.*")


def form_modules_sql() -> str:
    """SQL of the same modules: for each one the nodes that it claims, and those that stay free."""
    runs = lambda kind, line, start, size, gap: f"""SELECT page, node FROM (SELECT *, count(*) OVER (PARTITION BY page, {line}, run) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY page, {line} ORDER BY {start}, {start} + {size}, node ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN {start} - max({start} + {size}) OVER (PARTITION BY page, {line} ORDER BY {start}, {start} + {size}, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM free WHERE k = '{kind}'))) WHERE n >= 2"""  # noqa: E731
    label = lambda along, across, size, gap: f"""SELECT page, node FROM (SELECT *, lead(k) OVER w AS next_k, lead({along}) OVER w - {along} - {size} AS gap FROM free WINDOW w AS (PARTITION BY page, {across} ORDER BY {along}, node))
        WHERE k = 'text' AND next_k = 'field' AND gap BETWEEN 0 AND {gap}"""  # noqa: E731
    leaders = lambda v, tolerance: f"""(SELECT page, list_reduce(list_transform(list_sort(list(DISTINCT {v})), lambda a: [a]), lambda done, a: CASE WHEN a[1] - done[len(done)] > {tolerance} THEN list_concat(done, a) ELSE done END) AS firsts FROM g GROUP BY page)"""
    first = "list_max(list_filter({}.firsts, lambda a: a <= g.{}))"
    cross = lambda where, tolerance, rows, columns: f"""WITH g AS (SELECT * FROM free WHERE {where}), z AS (SELECT g.page, g.node, {first.format("p", "y")} AS r, {first.format("q", "x")} AS c FROM g JOIN {leaders("y", tolerance)} p ON p.page = g.page JOIN {leaders("x", tolerance)} q ON q.page = g.page)
        SELECT page, node FROM z WHERE (page, r) IN (SELECT (page, r) FROM z GROUP BY page, r HAVING count(DISTINCT c) >= {columns}) AND (page, c) IN (SELECT (page, c) FROM z GROUP BY page, c HAVING count(DISTINCT r) >= {rows})"""  # noqa: E731
    repeat = f"""WITH g AS (SELECT * FROM free), z AS (SELECT g.page, g.node, g.k || '@' || g.x AS s, {first.format("p", "y")} AS r FROM g JOIN {leaders("y", 1)} p ON p.page = g.page), t AS (SELECT page, r, list_sort(list(s)) AS shape, count(*) AS n FROM z GROUP BY page, r),
        u AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY r) AS run FROM (SELECT *, CASE WHEN lag(shape) OVER (PARTITION BY page ORDER BY r) = shape THEN 0 ELSE 1 END AS fresh FROM t)),
        v AS (SELECT page, r FROM (SELECT *, count(*) OVER (PARTITION BY page, run) AS long FROM u) WHERE long >= 2 AND n >= 2) SELECT z.page, z.node FROM z JOIN v ON v.page = z.page AND v.r = z.r"""
    single = lambda kind: f"SELECT page, node FROM free WHERE k = '{kind}'"
    steps = [
        ("radio_group", "group", runs("radio", "x", "y", "h", 8)), ("radio", "single", single("radio")), ("checkbox_group", "group", runs("checkbox", "x", "y", "h", 8)), ("checkbox", "single", single("checkbox")),
        ("inline_label", "left", label("x", "y", "w", 25)), ("caption", "above", label("y", "x", "h", 6)), ("field_table", "cell", cross("k = 'field'", 4, 2, 2)), ("repeat", "row", repeat), ("grid", "cell", cross("true", 2, 3, 3)),
        ("text_block", "line", runs("text", "y", "x", "w", 30)), ("column_layout", "column", "SELECT page, node FROM (SELECT *, count(*) OVER (PARTITION BY page, x) AS n, count(*) OVER (PARTITION BY page) AS every FROM free) WHERE n >= 3 AND n >= every * 0.2"),
        ("field", "single", single("field")), ("text", "single", "SELECT page, node FROM free"),
    ]
    ctes = [
        """f0 AS MATERIALIZED (SELECT page, node, b.k, b.x, b.y, b.w, b.h FROM (SELECT page, node, min({'k': k, 'x': x, 'y': y, 'w': w, 'h': h}) AS b FROM (
           SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS node, CASE WHEN l_linestatus = 'O' AND l_linenumber % 5 = 0 THEN 'radio' WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'checkbox' ELSE 'radio' END
             WHEN l_returnflag = 'A' OR l_linenumber % 3 = 0 THEN 'field' ELSE 'text' END AS k, round(l_discount * 500) AS x, (floor(l_quantity / 5) * 6)::DOUBLE AS y, round(l_tax * 200) + 4 AS w, 5::DOUBLE AS h FROM lineitem) GROUP BY page, node))"""
    ]
    for k, (_, _, claims) in enumerate(steps):
        ctes.append(f"c{k} AS MATERIALIZED (WITH free AS (SELECT * FROM f{k}) {'SELECT * FROM (' + claims + ')'})")
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} WHERE (page, node) NOT IN (SELECT (page, node) FROM c{k}))")
    found = " UNION ALL ".join(f"SELECT f0.page, f0.node, f0.k AS node_kind, '{m}' AS module, '{kind}' AS kind FROM f0 JOIN c{k} ON c{k}.page = f0.page AND c{k}.node = f0.node" for k, (m, kind, _) in enumerate(steps))
    return f"WITH {', '.join(ctes)} {found}"


@query("form_modules", form_modules_sql())
def form_modules_query(spark, sf_dir):
    """Boxes of every page by the module that claims them."""
    claimed = run_modules(form_boxes(spark, sf_dir, dealt=True), form_modules(), ["page", "node"], unique=True)
    return claimed.select("page", "node", "node_kind", "module", "kind")
