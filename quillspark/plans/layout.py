"""Layout statistics and spatial matching; line items and parts stand for nodes, their numbers for coordinates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import geometry as geo
from quillspark.operators import layout as lo
from quillspark.plans.registry import query
from quillspark.session import table


def sized(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v"))


@query("value_mode_largest", "SELECT g, v, n FROM (SELECT l_returnflag AS g, l_quantity AS v, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity DESC) AS rn FROM lineitem GROUP BY l_returnflag, l_quantity) WHERE rn = 1")
def value_mode_largest(spark, sf_dir):
    """Mode per group; the largest value wins a tie."""
    return lo.mode(sized(spark, sf_dir), ["g"], "v", largest=True)


@query("value_mode_smallest", "SELECT g, v, n FROM (SELECT l_returnflag AS g, l_quantity AS v, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS rn FROM lineitem GROUP BY l_returnflag, l_quantity) WHERE rn = 1")
def value_mode_smallest(spark, sf_dir):
    """Mode per group; the smallest value wins a tie."""
    return lo.mode(sized(spark, sf_dir), ["g"], "v", largest=False)


@query("median_value", "SELECT l_returnflag AS g, quantile_cont(l_quantity, 0.5)::DOUBLE AS median FROM lineitem GROUP BY g")
def median_value(spark, sf_dir):
    return sized(spark, sf_dir).groupBy("g").agg(F.percentile("v", 0.5).alias("median"))


@query("top_share", "SELECT g, round(max(n) / sum(n), 6)::DOUBLE AS share FROM (SELECT l_returnflag AS g, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY g")
def top_share(spark, sf_dir):
    """Share of the most common style."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_linestatus").agg(F.count("*").alias("n"))
    return counts.groupBy("g").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("style_buckets", "SELECT DISTINCT p_size AS size, p_brand < 'Brand#3' AS bold, p_type LIKE '%STEEL' AS lined FROM part WHERE p_size >= 40 ORDER BY size DESC, bold DESC, lined DESC")
def style_buckets(spark, sf_dir):
    """Distinct styles: large first, bold first, lined first."""
    styles = table(spark, sf_dir, "part").where("p_size >= 40").select(F.col("p_size").alias("size"), (F.col("p_brand") < "Brand#3").alias("bold"), F.col("p_type").endswith("STEEL").alias("lined"))
    return styles.distinct().orderBy(F.desc("size"), F.desc("bold"), F.desc("lined"))


@query(
    "dominant_value",
    """
    SELECT g, arg_min(v, k) AS v, round(min(-support) / -max(total), 6)::DOUBLE AS share FROM (
      SELECT g, v, support, total, row_number() OVER (PARTITION BY g ORDER BY support DESC, v) AS k FROM (
        SELECT p_brand AS g, p_size AS v, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS support, count(*) OVER (PARTITION BY p_brand) AS total FROM part)) WHERE k = 1 GROUP BY g
    """.replace("round(min(-support) / -max(total), 6)::DOUBLE", "round(-min(-support) / max(total), 6)::DOUBLE"),
)
def dominant_value(spark, sf_dir, tolerance: int = 2):
    """The value with most others within the tolerance, and their share; a tie goes to the smallest."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("v"))
    near = lo.support(nodes, ["g"], "v", tolerance)
    return near.groupBy("g").agg(F.max(F.struct("support", -F.col("v"))).alias("m"), F.sum("n").alias("total")).select("g", (-F.col("m.col2")).alias("v"), F.round(F.col("m.support") / F.col("total"), 6).alias("share"))


@query(
    "significant_clusters",
    "SELECT DISTINCT p_brand AS g, p_size AS v, support FROM (SELECT p_brand, p_size, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS support FROM part) WHERE support >= 3",
)
def significant_clusters(spark, sf_dir, tolerance: int = 1, least: int = 3):
    """Values with enough points around them."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("v"))
    return lo.support(nodes, ["g"], "v", tolerance).where(F.col("support") >= least).select("g", "v", "support")


SPANS = "SELECT l_orderkey AS page, l_linenumber AS node, l_quantity AS y0, l_quantity + l_linenumber * 2 AS y1 FROM lineitem"


def spans(spark, sf_dir):
    """Nodes of a page with a vertical extent."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("node"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + F.col("l_linenumber") * 2).alias("y1"))


@query("interval_overlap", f"SELECT a.page, a.node AS a, b.node AS b FROM ({SPANS}) a JOIN ({SPANS}) b ON a.page = b.page AND a.node < b.node AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def interval_overlap(spark, sf_dir):
    """Pairs of nodes of a page whose extents meet; touching counts."""
    left, right = (spans(spark, sf_dir).toDF("page", x, f"{x}0", f"{x}1") for x in "ab")
    return left.join(right, "page").where("a < b AND a0 <= b1 AND b0 <= a1").select("page", "a", "b")


@query(
    "overlap_fraction",
    f"SELECT a.page, a.node AS a, b.node AS b, round(CASE WHEN least(a.y1, b.y1) - greatest(a.y0, b.y0) <= 0 THEN 0.0 ELSE (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / (b.y1 - b.y0) END, 6)::DOUBLE AS fraction FROM ({SPANS}) a JOIN ({SPANS}) b ON a.page = b.page AND a.node < b.node",
)
def overlap_fraction(spark, sf_dir):
    """How much of a later node's extent an earlier one covers."""
    left, right = (spans(spark, sf_dir).toDF("page", x, f"{x}0", f"{x}1") for x in "ab")
    both = left.join(right, "page").where("a < b")
    return both.select("page", "a", "b", F.round(lo.overlap_fraction(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), 6).alias("fraction"))


@query(
    "nearest_match",
    f"SELECT page, field, label, gap FROM (SELECT f.page, f.node AS field, l.node AS label, round(f.y0 - l.y1, 6) AS gap, row_number() OVER (PARTITION BY f.page, f.node ORDER BY f.y0 - l.y1, l.node) AS rn FROM ({SPANS}) f JOIN ({SPANS}) l ON f.page = l.page AND f.node % 2 = 0 AND l.node % 2 = 1 AND l.y1 <= f.y0) WHERE rn = 1",
)
def nearest_match(spark, sf_dir):
    """The nearest label above each field: the last label that ends at or before the field's top, by one sorted pass."""
    nodes = spans(spark, sf_dir)
    label, field = F.col("node") % 2 == 1, F.col("node") % 2 == 0
    # labels stand at their ends, before fields at the same place; of labels that end together the smallest comes last
    order = Window.partitionBy("page").orderBy("at", "is_field", F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)
    placed = nodes.select("page", "node", field.alias("is_field"), F.when(label, F.col("y1")).otherwise(F.col("y0")).alias("at"))
    near = F.last(F.when(~F.col("is_field"), F.struct("at", "node")), ignorenulls=True).over(order)
    found = placed.withColumn("near", near).where("is_field AND near IS NOT NULL")
    best = found.groupBy("page", F.col("node").alias("field")).agg(F.min(F.struct((F.col("at") - F.col("near.at")).alias("gap"), F.col("near.node").alias("label"))).alias("m"))
    return best.select("page", "field", "m.label", F.round("m.gap", 6).alias("gap"))


@query(
    "majority_vote",
    f"""
    WITH v AS (SELECT l_orderkey % 50 AS form, CASE WHEN l_quantity < 15 THEN 'above' WHEN l_quantity < 30 THEN 'left' ELSE 'right' END AS side FROM lineitem)
    SELECT form, side, n FROM (SELECT form, side, count(*) AS n, row_number() OVER (PARTITION BY form ORDER BY count(*) DESC, side DESC) AS rn FROM v GROUP BY form, side) WHERE rn = 1
    """,
)
def majority_vote(spark, sf_dir):
    """The side that most fields of a form vote for; the greatest wins a tie."""
    side = F.when(F.col("l_quantity") < 15, "above").when(F.col("l_quantity") < 30, "left").otherwise("right")
    votes = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("form"), side.alias("side")).agg(F.count("*").alias("n"))
    return votes.groupBy("form").agg(F.max(F.struct("n", "side")).alias("m")).select("form", "m.side", "m.n")


@query(
    "gap_cluster",
    f"SELECT page, node, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY y0, y1, node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, y1, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS fresh FROM ({SPANS}))",
)
def gap_cluster(spark, sf_dir, max_gap: float = 3.0):
    """Clusters of nodes of a page with at most the gap between them."""
    return lo.gap_clusters(spans(spark, sf_dir), ["page"], "y0", "y1", max_gap, ties=["node"]).select("page", "node", "cluster")


@query(
    "merge_intervals",
    f"SELECT page, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY y0, y1, node ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, y1, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM ({SPANS}))) GROUP BY page, c",
)
def merge_intervals(spark, sf_dir):
    """Merged extents of each page."""
    return lo.merge_intervals(spans(spark, sf_dir), ["page"], "y0", "y1", ties=["node"])


@query(
    "leader_cluster",
    """
    WITH RECURSIVE s AS (SELECT p_brand AS g, p_size AS v, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part GROUP BY p_brand, p_size),
    f AS (SELECT g, k, v AS leader, n FROM s WHERE k = 1 UNION ALL SELECT s.g, s.k, CASE WHEN s.v - f.leader <= 5 THEN f.leader ELSE s.v END, s.n FROM f JOIN s ON s.g = f.g AND s.k = f.k + 1)
    SELECT g, leader::DOUBLE AS leader, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL
    """,
)
def leader_cluster(spark, sf_dir, tolerance: float = 5.0):
    """Rows by the first value of their cluster."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("v"))
    return lo.leader_clusters(nodes, ["g"], "v", tolerance)


@query(
    "largest_remainder",
    """
    WITH w AS (SELECT l_orderkey AS grid, l_linenumber AS col, l_quantity AS w FROM lineitem),
         e AS (SELECT grid, col, w, w * 12 / sum(w) OVER (PARTITION BY grid) AS x FROM w),
         b AS (SELECT grid, col, w, greatest(floor(x), 1) AS fl, round(x - floor(x), 9) AS fr FROM e),
         r AS (SELECT grid, col, fl, 12 - sum(fl) OVER (PARTITION BY grid) AS l, row_number() OVER (PARTITION BY grid ORDER BY fr DESC, col, w) AS k FROM b)
    SELECT grid, col, CAST(fl + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS span FROM r
    """,
)
def largest_remainder(spark, sf_dir):
    """Column widths as spans of a 12-column grid."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grid"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("w"))
    return lo.largest_remainder(cells, ["grid"], ["col", "w"], "w", 12).select("grid", "col", "span")


@query("reading_order", "SELECT l_orderkey AS page, l_linenumber AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity / 4, 0) * 4, l_extendedprice, l_linenumber) AS place FROM lineitem")
def reading_order(spark, sf_dir):
    """Place of each node by bands of y, then x."""
    order = Window.partitionBy("page").orderBy(F.bround(F.col("l_quantity") / 4, 0) * 4, F.asc_nulls_last("l_extendedprice"), "node")
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("node"), "l_quantity", "l_extendedprice")
    return nodes.select("page", "node", F.row_number().over(order).cast("long").alias("place"))


@query(
    "repeated_lines",
    """
    WITH p AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM p GROUP BY source)
    SELECT p.source, md5(p.line) AS line, count(DISTINCT p.doc_id) AS n FROM p JOIN n ON p.source = n.source WHERE line <> '' GROUP BY p.source, p.line, pages HAVING count(DISTINCT p.doc_id) * 20 >= pages AND count(DISTINCT p.doc_id) > 1
    """,
)
def repeated_lines(spark, sf_dir, share: float = 0.05):
    """Lines that stand in at least a share of a source's documents, and in two."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    pages = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"))
    counts = rows.groupBy("source", F.md5("line").alias("line")).agg(F.count("*").alias("n"))  # a line stands once per document by now
    return counts.join(pages, "source").where((F.col("n") >= F.col("pages") * share) & (F.col("n") > 1)).select("source", "line", "n")


BOXES = "SELECT l_orderkey AS page, l_linenumber::INT AS node, (l_discount * 1000)::DOUBLE AS x, l_quantity::DOUBLE AS y, (l_tax * 500 + 5)::DOUBLE AS w, (l_linenumber * 4)::DOUBLE AS h FROM lineitem"


def boxes(spark, sf_dir):
    """Nodes of a page as boxes."""
    x, w, h = F.col("l_discount") * 1000, F.col("l_tax") * 500 + 5, F.col("l_linenumber") * 4
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("node"), *[v.cast("double").alias(n) for v, n in ((x, "x"), (F.col("l_quantity"), "y"), (w, "w"), (h, "h"))])


@query(
    "box_relations",
    f"""
    WITH n AS ({BOXES}), p AS (SELECT a.page, a.node, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS \"by\", b.w AS bw, b.h AS bh FROM n a JOIN n b ON a.page = b.page AND b.node = a.node + 1)
    SELECT page, node, CASE WHEN bx >= ax + aw THEN round(bx - (ax + aw), 6) END AS gap_x, CASE WHEN \"by\" >= ay + ah THEN round(\"by\" - (ay + ah), 6) END AS gap_y,
      abs((ay + ah / 2) - (\"by\" + bh / 2)) <= greatest(ah, bh) / 2 + 1 AS same_line, ax + aw >= bx AND ax <= bx + bw AS overlap_x, ay + ah >= \"by\" AND ay <= \"by\" + bh AS overlap_y,
      ay + ah <= \"by\" AS above, \"by\" + bh <= ay AS below, ax + aw <= bx AS left_of, bx + bw <= ax AS right_of,
      round(CASE WHEN least(ax + aw, bx + bw) > greatest(ax, bx) AND least(ay + ah, \"by\" + bh) > greatest(ay, \"by\") THEN (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, \"by\" + bh) - greatest(ay, \"by\")) / (bw * bh) ELSE 0 END, 6) AS inside,
      round((greatest(ax + aw, bx + bw) - least(ax, bx)) * (greatest(ay + ah, \"by\" + bh) - least(ay, \"by\")), 4) AS union_area, greatest(aw, ah) / least(aw, ah) - 1 <= 0.25 AS square, aw <= 20 AND ah <= 20 AS small FROM p
    """.replace('\\"', '"'),
)
def box_relations(spark, sf_dir):
    """How each box of a page stands to the next."""
    nodes = boxes(spark, sf_dir)
    first = nodes.select("page", "node", F.struct("x", "y", "w", "h").alias("a"))
    second = nodes.select("page", (F.col("node") - 1).alias("node"), F.struct("x", "y", "w", "h").alias("b"))
    a, b = geo.Box.of(F.col("a")), geo.Box.of(F.col("b"))
    around = geo.union(a, b)
    found = {
        "gap_x": F.round(geo.gap(a, b, "x"), 6), "gap_y": F.round(geo.gap(a, b, "y"), 6), "same_line": geo.same_line(a, b, 1.0),
        "overlap_x": geo.overlaps(a, b, "x"), "overlap_y": geo.overlaps(a, b, "y"), "above": geo.before(a, b, "y"), "below": geo.before(b, a, "y"),
        "left_of": geo.before(a, b, "x"), "right_of": geo.before(b, a, "x"), "inside": F.round(geo.share_inside(a, b), 6),
        "union_area": F.round(around.w * around.h, 4), "square": geo.is_square(a, 0.25), "small": geo.fits(a, 20),
    }
    return first.join(second, ["page", "node"]).select("page", "node", *[c.alias(n) for n, c in found.items()])


SIDES = ("above", "below", "left", "right")


@query(
    "label_by_side",
    f"""
    WITH n AS ({BOXES}), p AS (SELECT f.page, f.node AS field, l.node AS label, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh, l.x AS lx, l.y AS ly, l.w AS lw, l.h AS lh FROM n f JOIN n l ON f.page = l.page AND f.node % 2 = 0 AND l.node % 2 = 1),
    c AS (SELECT page, field, label, fx + fw >= lx - 2 AND fx <= lx + lw + 2 AS col, abs((fy + fh / 2) - (ly + lh / 2)) <= greatest(fh, lh) / 2 + 2 AS line,
      fy - (ly + lh) AS up, ly - (fy + fh) AS down, fx - (lx + lw) AS l, lx - (fx + fw) AS r, (fx + fw / 2) - (lx + lw / 2) AS mx, (fy + fh / 2) - (ly + lh / 2) AS my FROM p),
    s AS (SELECT page, field, label, 'above' AS side, CASE WHEN up >= 0 THEN up WHEN -up <= 2 AND my > 0 THEN 0 END AS gap FROM c WHERE col
      UNION ALL SELECT page, field, label, 'below', CASE WHEN down >= 0 THEN down WHEN -down <= 2 AND my < 0 THEN 0 END FROM c WHERE col
      UNION ALL SELECT page, field, label, 'left', CASE WHEN l >= 0 THEN l WHEN -l <= 2 AND mx > 0 THEN 0 END FROM c WHERE line
      UNION ALL SELECT page, field, label, 'right', CASE WHEN r >= 0 THEN r WHEN -r <= 2 AND mx < 0 THEN 0 END FROM c WHERE line)
    SELECT page, field, side, label, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY page, field, side ORDER BY gap, label) AS k FROM s WHERE gap <= 30) WHERE k = 1
    """,
)
def label_by_side(spark, sf_dir, most: float = 30.0, tolerance: float = 2.0):
    """The nearest label of each field on each of four sides; the smaller number wins a tie.

    The labels of a page stand in one array beside its fields, so no pair becomes a row.
    """
    nodes = boxes(spark, sf_dir).select("page", "node", F.struct("node", "x", "y", "w", "h").alias("box"))
    fields, labels = (F.array_sort(F.collect_list(F.when(F.col("node") % 2 == k, F.col("box")))).alias(n) for k, n in ((0, "fields"), (1, "labels")))
    pages = nodes.groupBy("page").agg(fields, labels).where("size(fields) > 0 AND size(labels) > 0").select("page", F.explode("fields").alias("f"), "labels")

    def nearest(side):
        def one(label):
            return F.struct(geo.beside(geo.Box.of(F.col("f")), geo.Box.of(label), side, most, tolerance).alias("gap"), label["node"].alias("label"))

        return F.struct(F.lit(side).alias("side"), F.array_min(F.filter(F.transform("labels", one), lambda c: c["gap"].isNotNull())).alias("m"))

    found = pages.select("page", F.col("f.node").alias("field"), F.explode(F.array(*map(nearest, SIDES))).alias("s")).where("s.m IS NOT NULL")
    found = found.groupBy("page", "field", "s.side").agg(F.min("s.m").alias("m"))  # fields that share a number are one
    return found.select("page", "field", "side", "m.label", F.round("m.gap", 6).alias("gap"))


@query(
    "greedy_headers",
    f"""
    WITH RECURSIVE n AS ({BOXES}), f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY node, x, y, w, h) AS k, count(*) OVER (PARTITION BY page) AS m FROM n WHERE node % 2 = 0),
    c AS (SELECT page, k, m, field, list(header ORDER BY gap, header) AS near FROM (
        SELECT f.page, f.k, f.m, f.node AS field, l.node AS header, min(f.y - (l.y + l.h)) AS gap FROM f JOIN n l ON l.page = f.page AND l.node % 2 = 1
        WHERE f.y >= l.y + l.h AND f.y - (l.y + l.h) <= 40 AND f.x + f.w >= l.x - 20 AND f.x <= l.x + l.w + 20 GROUP BY ALL) GROUP BY page, k, m, field),
    s AS (SELECT page, k, m, [near[1]] AS used, [field] AS fields FROM c WHERE k = 1
      UNION ALL SELECT s.page, c.k, s.m, list_append(s.used, list_filter(c.near, lambda h: NOT list_contains(s.used, h))[1]), list_append(s.fields, c.field)
      FROM s JOIN c ON c.page = s.page AND c.k = s.k + 1 WHERE len(list_filter(c.near, lambda h: NOT list_contains(s.used, h))) > 0)
    SELECT page, unnest(fields) AS field, unnest(used) AS header FROM s WHERE k = m
    """,
)
def greedy_headers(spark, sf_dir, most: float = 40.0, tolerance: float = 20.0):
    """Fields of each page with the nearest header above that no field before took; no rows if one field finds none.

    A page is one row with its boxes in arrays; its fields are folded in order.
    """
    nodes = boxes(spark, sf_dir).select("page", "node", F.struct("node", "x", "y", "w", "h").alias("box"))
    fields, headers = (F.array_sort(F.collect_list(F.when(F.col("node") % 2 == k, F.col("box")))).alias(n) for k, n in ((0, "fields"), (1, "headers")))
    pages = nodes.groupBy("page").agg(fields, headers).where("size(fields) > 0 AND size(headers) > 0")
    kind = "array<struct<field:int,header:int>>"

    def step(taken, field):
        below = geo.Box.of(field)

        def one(header):
            above = geo.Box.of(header)
            free = ~F.exists(taken, lambda t: t["header"] == header["node"])
            near = F.when(free & geo.overlaps(above, below, "x", tolerance), geo.gap(above, below, "y"))
            return F.struct(near.alias("gap"), header["node"].alias("header"))

        best = F.array_min(F.filter(F.transform("headers", one), lambda c: c["gap"] <= most))
        # a field without a header makes the list null, and it stays null
        return F.when(best.isNotNull(), F.concat(taken, F.array(F.struct(field["node"].alias("field"), best["header"].alias("header"))).cast(kind)))

    folded = pages.select("page", F.aggregate("fields", F.array().cast(kind), step).alias("taken"))
    return folded.select("page", F.explode("taken").alias("t")).select("page", "t.field", "t.header")
