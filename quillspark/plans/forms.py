"""Small questions of forms: nodes by kind and access, languages of a source, labels right of a mark."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import wrapping
from quillspark.plans.analysis import form_boxes
from quillspark.plans.layout import BOXES, boxes
from quillspark.plans.registry import query
from quillspark.session import table

KIND = """CASE WHEN l_linestatus = 'O' AND l_linenumber % 5 = 0 THEN 'radio' WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'checkbox' ELSE 'radio' END WHEN l_returnflag = 'A' OR l_linenumber % 3 = 0 THEN 'field' ELSE 'text' END"""


@query(
    "kind_filter",
    f"""
    WITH n AS (SELECT page, node, min({{'k': k, 'x': x, 'y': y, 'w': w, 'h': 5}}).k AS k FROM (SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS node, {KIND} AS k, round(l_discount * 500) AS x, floor(l_quantity / 5) * 6 AS y, round(l_tax * 200) + 4 AS w FROM lineitem) GROUP BY page, node)
    SELECT page, k AS node_kind, count(*) AS n, min(node) AS first_node, max(node) AS last_node FROM n WHERE k IN ('radio', 'checkbox') GROUP BY page, k
    """,
)
def kind_filter(spark, sf_dir, kinds: tuple[str, ...] = ("radio", "checkbox")):
    """Nodes of the asked kinds on each page."""
    nodes = form_boxes(spark, sf_dir).where(F.col("node_kind").isin(*kinds))
    return nodes.groupBy("page", "node_kind").agg(F.count("*").alias("n"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))


@query(
    "interactive_items",
    """
    SELECT l_orderkey AS page, l_linenumber AS node, a AS access, a = 'open' AS interactive
    FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_returnflag = 'A' THEN 'readOnly' WHEN l_returnflag = 'N' THEN 'protected' ELSE 'nonInteractive' END AS a FROM lineitem)
    """,
)
def interactive_items(spark, sf_dir):
    """Whether each item takes input: only one with open access does."""
    access = F.when(F.col("l_linestatus") == "O", "open").when(F.col("l_returnflag") == "A", "readOnly").when(F.col("l_returnflag") == "N", "protected").otherwise("nonInteractive")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("node"), access.alias("access"), (access == "open").alias("interactive"))


@query(
    "source_languages",
    """
    SELECT source, array_to_string(CASE WHEN count(lang) > 0 THEN list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL AND contains(text, '***'))) END, ',') AS marked,
      array_to_string(coalesce(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL AND contains(text, '***'))), ['en', 'de']), ',') AS languages
    FROM documents GROUP BY source
    """,
)
def source_languages(spark, sf_dir, configured: tuple[str, ...] = ("en", "de")):
    """Languages that the marked texts of a source have; a source without any keeps the configured ones."""
    found = F.array_sort(F.collect_set(F.when(F.contains("text", F.lit("***")), F.col("lang"))))
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(found.alias("found"))
    some = F.size("found") > 0
    return docs.select("source", F.when(some, F.array_join("found", ",")).alias("marked"), F.array_join(F.when(some, F.col("found")).otherwise(F.array(*map(F.lit, configured))), ",").alias("languages"))


@query(
    "label_on_right",
    f"""
    WITH n AS ({BOXES}), m AS (SELECT page, node, arg_min(b, [b.x, b.y, b.w, b.h]) AS b FROM (SELECT page, node, {{'x': x, 'y': y, 'w': w, 'h': h}} AS b FROM n) GROUP BY page, node),
    p AS (SELECT f.page, f.node AS mark, l.node AS label, l.b.x - (f.b.x + f.b.w) AS gap, abs((f.b.y + f.b.h / 2) - (l.b.y + l.b.h / 2)) AS off, greatest(f.b.h, l.b.h) / 2 + 2 AS line, f.b.x + f.b.w / 2 < l.b.x + l.b.w / 2 AS right_of
          FROM m f JOIN m l ON f.page = l.page AND f.node % 2 = 0 AND l.node % 2 = 1),
    c AS (SELECT page, mark, list({{'label': label, 'gap': greatest(gap, 0), 'off': off}} ORDER BY label) AS c FROM p WHERE off <= line AND (gap BETWEEN 0 AND 60 OR (gap >= -2 AND gap < 0 AND right_of)) GROUP BY page, mark)
    SELECT page, mark, b.label AS label, round(b.gap, 6) AS gap, round(b.off, 6) AS off FROM (SELECT page, mark, list_reduce(c, lambda best, x: CASE WHEN CASE WHEN abs(x.gap - best.gap) <= 1 THEN x.off < best.off ELSE x.gap < best.gap END THEN x ELSE best END) AS b FROM c)
    """,
)
def label_on_right(spark, sf_dir, most: float = 60.0, tolerance: float = 2.0):
    """The label right of each mark, on its line: the nearest, and of those whose gaps differ by 1 at most the one closest to the line.

    Labels are compared one after the other, as that rule is no order; those of a page stand in one array beside its marks.
    """
    one = boxes(spark, sf_dir).groupBy("page", "node").agg(F.min(F.struct("x", "y", "w", "h")).alias("b"))
    arrays = [F.array_sort(F.collect_list(F.when(F.col("node") % 2 == k, F.struct("node", "b.x", "b.y", "b.w", "b.h")))).alias(n) for k, n in ((0, "marks"), (1, "labels"))]
    pages = one.groupBy("page").agg(*arrays).select("page", F.explode("marks").alias("f"), "labels")
    f = F.col("f")

    def seen(label):
        gap, off = label["x"] - (f["x"] + f["w"]), F.abs((f["y"] + f["h"] / 2) - (label["y"] + label["h"] / 2))
        right = f["x"] + f["w"] / 2 < label["x"] + label["w"] / 2
        fits = (off <= F.greatest(f["h"], label["h"]) / 2 + tolerance) & (gap.between(0, most) | ((gap >= -tolerance) & (gap < 0) & right))
        return F.when(fits, F.struct(label["node"].alias("label"), F.greatest(gap, F.lit(0.0)).alias("gap"), off.alias("off")))

    near = F.filter(F.transform("labels", seen), lambda s: s.isNotNull())
    better = lambda best, x: F.when(F.when(F.abs(x["gap"] - best["gap"]) <= 1, x["off"] < best["off"]).otherwise(x["gap"] < best["gap"]), x).otherwise(best)
    found = pages.select("page", f["node"].alias("mark"), near.alias("near")).where(F.size("near") > 0)
    best = found.select("page", "mark", F.aggregate(F.slice("near", F.lit(2), F.size("near")), F.element_at("near", 1), better).alias("best"))
    return best.select("page", "mark", "best.label", F.round("best.gap", 6).alias("gap"), F.round("best.off", 6).alias("off"))


@query(
    "wrapped_lines",
    r"""
    WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS para FROM conversations),
    q AS (SELECT conv_id, turn, para, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM p),
    w AS (SELECT conv_id, turn, para, flatten(list_transform(w, lambda x: CASE WHEN 2 * length(x) - length(regexp_replace(x, '[^fijlrtI.,;:!''|()\[\] ]', '', 'g')) + length(regexp_replace(x, '[^mwMW@%&]', '', 'g')) <= 40 THEN [x]
      ELSE list_transform(range(0, (length(x) + 11) // 12), lambda k: x[k * 12 + 1:k * 12 + 12] || CASE WHEN k * 12 + 12 < length(x) THEN '-' ELSE '' END) END)) AS w FROM q),
    z AS (SELECT *, list_transform(w, lambda x: 2 * length(x) - length(regexp_replace(x, '[^fijlrtI.,;:!''|()\[\] ]', '', 'g')) + length(regexp_replace(x, '[^mwMW@%&]', '', 'g'))) AS s FROM w WHERE len(w) > 0),
    r AS (SELECT conv_id, turn, para, w, s, 1 AS k, 1 AS line, s[1] AS used, w[1] AS text, s[1] AS widest FROM z UNION ALL
      SELECT conv_id, turn, para, w, s, k + 1, line + CASE WHEN used + 1 + s[k + 1] <= 40 THEN 0 ELSE 1 END, CASE WHEN used + 1 + s[k + 1] <= 40 THEN used + 1 + s[k + 1] ELSE s[k + 1] END,
        text || CASE WHEN used + 1 + s[k + 1] <= 40 THEN ' ' ELSE chr(10) END || w[k + 1], greatest(widest, CASE WHEN used + 1 + s[k + 1] <= 40 THEN used + 1 + s[k + 1] ELSE s[k + 1] END) FROM r WHERE k < len(w))
    SELECT conv_id, turn, para, line AS n_lines, CAST(widest AS INT) AS widest, md5(text) AS wrapped FROM r WHERE k = len(w)
    """,
)
def wrapped_lines(spark, sf_dir, most: int = 40):
    """The paragraphs of all turns broken into lines of at most ``most`` units."""
    paras = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("para", "t"))
    words = paras.select("conv_id", "turn", (F.col("para") + 1).cast("long").alias("para"), wrapping.words_to_wrap(F.col("t"), most).alias("words")).where(F.size("words") > 0)
    lines = words.withColumn("lines", wrapping.line_numbers(F.col("words"), most)).withColumn("text", wrapping.wrapped(F.col("words"), F.col("lines")))
    widest = F.array_max(F.transform(F.split("text", "\n"), wrapping.width))
    return lines.select("conv_id", "turn", "para", F.element_at("lines", -1).alias("n_lines"), widest.alias("widest"), F.md5("text").alias("wrapped"))
