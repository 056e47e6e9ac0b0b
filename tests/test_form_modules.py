"""Modules of boxes, page by page, against plain loops over the nodes."""

import contextlib
import io
import random
from collections import Counter, defaultdict

from pyspark.sql.classic.dataframe import DataFrame

from quillspark.operators import form_modules as fm
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.operators.modules import run_modules
from quillspark.plans import analysis, catalog


def clusters(values, tolerance):
    """{value: first value of its cluster}."""
    out, leader = {}, None
    for v in sorted(set(values)):
        leader = v if leader is None or v - leader > tolerance else leader
        out[v] = leader
    return out


def runs(nodes, line, start, size, gap, least):
    out = set()
    lines = defaultdict(list)
    for n in nodes:
        lines[n[line]].append(n)
    for those in lines.values():
        those.sort(key=lambda n: (n[start], n[start] + n[size]))
        run, reach = [], None
        for n in [*those, None]:
            if n is None or (reach is not None and n[start] - reach > gap):
                out |= {m["node"] for m in run} if len(run) >= least else set()
                run, reach = [], None
            if n is not None:
                run.append(n)
                reach = max(reach if reach is not None else n[start] + n[size], n[start] + n[size])
    return out


def labels(nodes, along, across, size, gap):
    out, lines = set(), defaultdict(list)
    for n in nodes:
        lines[n[across]].append(n)
    for those in lines.values():
        those.sort(key=lambda n: (n[along], n["node"]))
        out |= {a["node"] for a, b in zip(those, those[1:]) if a["kind"] == "text" and b["kind"] == "field" and 0 <= b[along] - a[along] - a[size] <= gap}
    return out


def crossings(nodes, tolerance, rows, columns):
    col, row = clusters([n["x"] for n in nodes], tolerance), clusters([n["y"] for n in nodes], tolerance)
    cells = {(row[n["y"]], col[n["x"]]) for n in nodes}
    wide, high = Counter(r for r, _ in cells), Counter(c for _, c in cells)
    return {n["node"] for n in nodes if wide[row[n["y"]]] >= columns and high[col[n["x"]]] >= rows}


def repeats(nodes, tolerance):
    row = clusters([n["y"] for n in nodes], tolerance)
    shapes = defaultdict(list)
    for n in nodes:
        shapes[row[n["y"]]].append((n["kind"] or "", n["x"]))
    order = sorted(shapes)
    out, k = set(), 0
    while k < len(order):
        j = k
        while j < len(order) and sorted(shapes[order[j]]) == sorted(shapes[order[k]]):
            j += 1
        if j - k >= 2 and len(shapes[order[k]]) >= 2:
            out |= set(order[k:j])
        k = j
    return {n["node"] for n in nodes if row[n["y"]] in out}


def columns(nodes):
    n_at = Counter(n["x"] for n in nodes)
    return {n["node"] for n in nodes if n_at[n["x"]] >= 3 and n_at[n["x"]] >= 0.2 * len(nodes)}


def by_hand(page):
    """{node: module} of one page."""
    done = {}
    free = lambda: [n for n in page if n["node"] not in done]
    put = lambda name, nodes: done.update({k: name for k in nodes if k not in done})
    there = lambda: [n for n in free() if None not in (n["x"], n["y"], n["w"], n["h"], n["page"])]
    of = lambda kind: [n for n in there() if n["kind"] == kind]
    for mark in ("radio", "checkbox"):
        put(f"{mark}_group", runs(of(mark), "x", "y", "h", 8.0, 2))
        put(mark, [n["node"] for n in free() if n["kind"] == mark])
    put("inline_label", labels(there(), "x", "y", "w", 25.0))
    put("caption", labels(there(), "y", "x", "h", 6.0))
    put("field_table", crossings(of("field"), 4.0, 2, 2))
    put("repeat", repeats(there(), 1.0))
    put("grid", crossings([n for n in there() if n["kind"]], 2.0, 3, 3))
    put("text_block", runs(of("text"), "y", "x", "w", 30.0, 2))
    put("column_layout", columns(there()))
    put("field", [n["node"] for n in free() if n["kind"] == "field"])
    put("text", [n["node"] for n in free()])
    return done


SCHEMA = "page long, node long, node_kind string, x double, y double, w double, h double"


def expected(rows):
    pages = defaultdict(list)
    for page, node, kind, x, y, w, h in rows:
        pages[page].append({"page": page, "node": node, "kind": kind, "x": x, "y": y, "w": w, "h": h})
    return {(p, node): module for p, nodes in pages.items() for node, module in by_hand(nodes).items()}


def test_random_pages(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(3)
    rows = []
    for page in [*range(60), None]:
        for node in range(rng.randint(0, 40)):
            spot = [float(rng.randrange(0, 60, 5)), float(rng.randrange(0, 60, 6)), float(rng.randint(2, 12)), 5.0]
            if rng.random() < 0.03:
                spot[rng.randrange(4)] = None
            rows.append((page, node, rng.choice(["text", "text", "field", "radio", "checkbox", None]), *spot))
    rows += [(99, 10 * line + k, kind, 30.0 * k, 10.0 * line, 5.0, 5.0) for line in range(3) for k, kind in enumerate(["text", None])]  # rows that repeat
    done = run_modules(spark.createDataFrame(rows, SCHEMA), analysis.form_modules(), ["page", "node"], cut_after=1).collect()
    assert {(r.page, r.node): r.module for r in done} == expected(rows) and len(done) == len(rows)
    assert len({r.module for r in done}) == 13


def test_no_nodes_and_repeated_nodes(spark):
    ensure_checkpoint_dir(spark)
    assert run_modules(spark.createDataFrame([], SCHEMA), analysis.form_modules(), ["page", "node"], cut_after=1).collect() == []
    rows = [(1, 1, "radio", 0.0, 0.0, 5.0, 5.0)] * 3 + [(1, 2, "text", 50.0, 0.0, 5.0, 5.0)]
    done = run_modules(spark.createDataFrame(rows, SCHEMA), analysis.form_modules(), ["page", "node"], cut_after=1).collect()
    assert len(done) == 4 and {r.module for r in done if r.node == 1} == {"radio_group"}


def test_query_of_line_items(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("page", "node", "node_kind", "x", "y", "w", "h")) for r in analysis.form_boxes(spark, sf).collect()]
    got = {(r.page, r.node): r.module for r in catalog.QUERIES["form_modules"](spark, sf).collect()}
    assert got == expected(rows) and len(set(got.values())) >= 8


def test_boxes_move_once(spark, monkeypatch):
    """One exchange brings the boxes of a page together for all modules; none writes them, and tasks grow in number with them."""
    written = []
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *_: written.append(1) or df)
    monkeypatch.setattr(fm, "TASK_ROWS", 500)
    df = catalog.QUERIES["form_modules"](spark, "/root/testdata/sf0.001")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert not written and plan.getvalue().count("Exchange") == 1 and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan.getvalue()


def test_dealt_boxes(spark):
    """Dealt or not, pages without a number, rows without a place and places that are zeros of both signs or no numbers give the same claims."""
    rng = random.Random(8)
    rows = []
    for page in [*range(20), None]:
        for node in range(rng.randint(20, 40)):
            spot = [rng.choice([0.0, -0.0, 5.0, 30.0, 33.0, None]), rng.choice([-6.0, 0.0, 6.0, 12.0, None]), 5.0, 5.0]
            rows.append((page, node, rng.choice(["text", "field", "field", "radio", None]), *spot))
    nodes = spark.createDataFrame(rows, SCHEMA)
    dealt = fm.deal(nodes, len(rows))
    got = {(r.page, r.node): r.module for r in run_modules(dealt, analysis.form_modules(), ["page", "node"], unique=True).collect()}
    assert got == expected(rows) == {(r.page, r.node): r.module for r in run_modules(nodes, analysis.form_modules(), ["page", "node"]).collect()}
    assert fm.deal(spark.range(8000).selectExpr("CAST(NULL AS long) page", "id node"), 8000).selectExpr("spark_partition_id() p").distinct().count() == 4


def test_rows_of_one_key_are_claimed_together(spark):
    """A row that a window would leave follows one with its key, unless it was claimed before."""
    rows = [(1, 1, "radio", 0.0, 0.0, 5.0, 5.0), (1, 2, "radio", 0.0, 6.0, 5.0, 5.0), (1, 2, "radio", 90.0, 6.0, 5.0, 5.0), (1, 2, "field", 50.0, 6.0, 5.0, 5.0)]
    done = run_modules(spark.createDataFrame(rows, SCHEMA), analysis.form_modules(), ["page", "node"]).collect()
    assert [r.module for r in done] == ["radio_group"] * 4
