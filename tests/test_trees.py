"""Node tables against a second parser, paths and scopes against walks over the nodes."""

import random
import re

from quillspark.operators import trees
from quillspark.sources import markup

PIECES = ["<a>", "</a>", "<b x='1' x=\"2\">", "</b>", "<br>", "<c/>", "text ", "<!-- <a> -->", "<![CDATA[<b>]]>", "<d y=z>", "</d>", "<n:e q='{Long}x'>", "</n:e>", "<script>if (a < b) '</b>'</script>", "<", ">", "<a href=''", "&amp;", "</zz>", "<!DOCTYPE x>", "<A B>"]


def second_parser(text, html=True):
    """[(name, attributes, parent, last, issues)] by the standard library's tokenizer-like walk, written apart: one character scan."""
    out, stack, i = [], [], 0
    while i < len(text):
        if text.startswith("<!--", i):
            j = text.find("-->", i + 4)
            i = len(text) if j < 0 else j + 3
        elif text.startswith("<![CDATA[", i):
            j = text.find("]]>", i)
            i = len(text) if j < 0 else j + 3
        elif text[i] == "<" and i + 1 < len(text) and text[i + 1] in "!?":
            j = text.find(">", i)
            i = i + 1 if j < 0 else j + 1
        elif text[i] == "<" and re.match(r"</[A-Za-z_]", text[i : i + 3]):
            m = re.match(r"</([A-Za-z_][^\s<>/]*)[^<>]*>", text[i:])
            if not m:
                i += 1
                continue
            i += m.end()
            name = m[1].lower() if html else m[1]
            if name in [out[s][0] for s in stack]:
                while out[stack[-1]][0] != name:
                    out[stack[-1]][4].append("unclosed")
                    out[stack.pop()][3] = len(out) - 1
                out[stack.pop()][3] = len(out) - 1
            elif stack:
                out[stack[-1]][4].append("stray_close")
        elif text[i] == "<" and re.match(r"<[A-Za-z_]", text[i : i + 2]):
            j, quote = i + 1, None
            while j < len(text) and (quote or text[j] not in "<>"):
                quote = None if quote == text[j] else quote if quote else text[j] if text[j] in "\"'" and j > i + 1 else None
                j += 1
            if j >= len(text) or text[j] == "<" or quote:
                i += 1
                continue
            name = re.match(r"[^\s<>/]+", text[i + 1 :])[0]
            rest = text[i + 1 + len(name) : j]
            name = name.lower() if html else name
            attributes = [(m[1].lower() if html else m[1], m[2] or m[3] or m[4] or "") for m in re.finditer(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", rest)]
            out.append([name, attributes, stack[-1] if stack else None, len(out), []])
            i = j + 1
            if not (rest.endswith("/") or (html and name == "br")):
                stack.append(len(out) - 1)
                if html and name == "script":
                    m = re.search(r"(?i)</script[\s>/]", text[i:])
                    i = i + m.start() if m else len(text)
        else:
            i += 1
    for s in stack:
        out[s][3] = len(out) - 1
        out[s][4].append("unclosed")
    return [tuple(n) for n in out]


def test_parser_equals_a_second_one():
    rng = random.Random(2)
    for _ in range(4_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        if text.count("'") % 2 or text.count('"') % 2:
            continue  # open quotes: only that nothing breaks
        for html in (True, False):
            got = markup.nodes_of(text, html)
            if not html and "script" in text:
                continue
            assert [(n["name"], [(a["name"], a["value"]) for a in n["attributes"]], n["parent"], n["last"], n["issues"]) for n in got] == second_parser(text, html), text


def test_intervals_places_and_paths():
    rng = random.Random(3)
    for _ in range(300):
        nodes = markup.nodes_of("".join(rng.choice(PIECES) for _ in range(40)))
        for n in nodes:
            inside = [m["pre"] for m in nodes if n["pre"] in m["ancestors"]]
            assert inside == list(range(n["pre"] + 1, n["last"] + 1)) and n["depth"] == len(n["ancestors"])
            same = [m for m in nodes if m["name"] == n["name"] and m["pre"] < n["pre"]]
            assert n["nth"] == len(same) and n["ord"] == sum(m["parent"] == n["parent"] for m in same)
            assert n["path"] == "".join(f"/{nodes[a]['name']}#{nodes[a]['ord']}" for a in [*n["ancestors"], n["pre"]])


def test_long_and_hostile_texts():
    for text in ("<a " * 50_000, "<!--" * 50_000, "<a '" * 50_001, "</a" * 50_000, "<a>x</a>" * 20_000):
        markup.nodes_of(text)
    assert markup.nodes_of("") == [] == markup.nodes_of("no markup")


def walk(steps, rooted, nodes):
    """Nodes that a path fits, step by step."""
    if rooted:
        at = [n for n in nodes if n["depth"] == 0]
    elif len(steps) == 1:
        _, name, place = steps[0]
        return [n for n in nodes if n["name"] == name and (place in ("", "*") or n["nth"] == int(place))]
    else:
        at, steps = None, steps
    for axis, name, place in steps:
        fits = lambda n: n["name"] == name and (place in ("", "*") or n["ord"] == int(place))  # noqa: B023, E731
        if at is None:
            at = [n for n in nodes if fits(n)]
        elif axis == "..":
            at = [n for n in nodes if fits(n) and any(a["pre"] in n["ancestors"] for a in at)]
        else:
            at = [n for n in nodes if fits(n) and any(a["pre"] == n["parent"] for a in at)]
    return at


def test_paths_equal_walks(spark):
    rng = random.Random(5)
    texts = {k: "".join(rng.choice(["<a>", "<b>", "<c>", "</a>", "</b>", "</c>"]) for _ in range(rng.randint(0, 40))) for k in range(25)}
    table = markup.node_table(spark.createDataFrame([*texts.items(), (99, None)], "doc int, html string"), ["doc"], "html")
    paths = []
    for _ in range(120):
        rooted = rng.random() < 0.4
        steps = [(rng.choice([".", ".."]) if k or rooted else "", rng.choice("abc"), rng.choice(["", "", "*", "0", "1"])) for k in range(rng.randint(0 if rooted else 1, 3))]
        paths.append((("$" if rooted else "") + "".join(f"{x}{n}[{p}]" if p else f"{x}{n}" for x, n, p in steps), rooted, steps))
    wrong = ["", "a.", "..a", "$a", "a[x]", "a b", "$..", None, "ab[1"]
    rows = [*[p for p, _, _ in paths], *wrong]
    found = trees.resolve_paths(table, spark.createDataFrame(list(enumerate(rows)), "expr_id int, expr string")).collect()
    got = sorted((r.doc, r.expr_id, r.pre) for r in found)
    want = sorted((doc, k, n["pre"]) for doc, text in texts.items() for k, (_, rooted, steps) in enumerate(paths) for n in walk(steps, rooted, markup.nodes_of(text)))
    assert got == want and len(want) > 1_000


def nearest(nodes, context, wanted):
    named = [n for n in nodes if n["name"] == wanted]
    if not named:
        return None
    if len(named) == 1:
        return named[0]["pre"]
    children = lambda p: [n for n in nodes if n["parent"] == p]
    for n in children(context):
        if n["name"] == wanted:
            return n["pre"]
    at = context
    while nodes[at]["parent"] is not None:
        up = nodes[at]["parent"]
        for sibling in children(up):
            for n in (sibling, *children(sibling["pre"])):
                if n["name"] == wanted:
                    return n["pre"]
        if nodes[up]["name"] == wanted:
            return up
        at = up
    return next((n["pre"] for n in named if n["depth"] == 0), named[0]["pre"])


def test_scopes_equal_walks(spark):
    rng = random.Random(6)
    texts = {k if k else None: "".join(rng.choice(["<a>", "<b>", "<c>", "<d>", "</a>", "</b>", "</c>"]) for _ in range(rng.randint(5, 40))) for k in range(20)}
    table = markup.node_table(spark.createDataFrame(list(texts.items()), "doc int, html string"), ["doc"], "html")
    asked = [(doc, f"{n['pre']}{w}", n["pre"], w) for doc, text in texts.items() if doc for n in markup.nodes_of(text) for w in "abcdz"]
    found = trees.resolve_scopes(table, spark.createDataFrame([*asked, (1, "far", 9_999, "a")], "doc int, ref_id string, context int, wanted string"), ["doc"]).collect()
    want = {(doc, ref): nearest(markup.nodes_of(texts[doc]), at, w) for doc, ref, at, w in asked} | {(1, "far"): None}
    assert {(r.doc, r.ref_id): r.target for r in found} == want and len(found) == len(want)


def faults(nodes, required, inside):
    out = []
    for n in nodes:
        names = [a["name"] for a in n["attributes"]]
        out += [(n["pre"], i, n["name"] if i == "unclosed" else i) for i in n["issues"]]
        if n["depth"] == 0 and n["pre"]:
            out.append((n["pre"], "second_root", n["name"]))
        out += [(n["pre"], "duplicate_attribute", x) for x in sorted(set(names)) if names.count(x) > 1]
        out += [(n["pre"], "missing_attribute", x) for x in required.get(n["name"], []) if not any(a["name"] == x and a["value"].strip(" ") for a in n["attributes"])]
        for a in n["attributes"]:
            v = a["value"]
            if (v.startswith("{Boolean}") and v[9:] not in ("true", "false")) or (v.startswith("{Long}") and not re.fullmatch("[0-9]+", v[6:])) or (v.startswith("[") and not v.endswith("]")):
                out.append((n["pre"], "typed_value", a["name"]))
        if n["name"] in inside:
            parent = nodes[n["parent"]]["name"] if n["parent"] is not None else "nothing"
            if parent not in inside[n["name"]]:
                out.append((n["pre"], "wrong_parent", f"{n['name']} in {parent}"))
        around = {a["name"][6:] for p in [*n["ancestors"], n["pre"]] for a in nodes[p]["attributes"] if a["name"].startswith("xmlns:")}
        used = {x.split(":")[0] for x in [n["name"], *names] if ":" in x and x.split(":")[0] not in ("xml", "xmlns")}
        out += [(n["pre"], "undeclared_prefix", p) for p in used - around]
    return out


def test_violations_equal_plain_checks(spark):
    rng = random.Random(7)
    pieces = [*PIECES, "<f xmlns:n='u' n:k='[1'>", "</f>", "<g h='{Boolean}no' xml:lang='x'>", "<n:e/>", "<m:x m:y=''>"]
    texts = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(90, None), (91, "")]
    required, inside = {"a": ["href", "b"], "d": ["y"]}, {"b": ["a"], "c": ["d", "a"]}
    table = markup.node_table(spark.createDataFrame(texts, "doc int, html string"), ["doc"], "html")
    got = sorted((r.doc, r.pre, r.rule, r.detail) for r in trees.violations(table, ["doc"], required, inside).collect())
    want = sorted((doc, *f) for doc, text in texts for f in faults(markup.nodes_of(text or ""), required, inside))
    assert got == want and len({g[2] for g in got}) == 8


def test_queries_of_pages(spark):
    """The registered queries over the smallest data set, against the same walks."""
    from quillspark.plans import catalog
    from quillspark.plans import trees as plans

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: markup.nodes_of(r.html or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    run = lambda name: catalog.QUERIES[name](spark, sf).collect()
    assert sorted((r.page_id, r.pre, r.last, r.path) for r in run("xml_nodes")) == sorted((p, n["pre"], n["last"], n["path"]) for p, nodes in pages.items() for n in nodes)
    assert sorted((r.page_id, r.pre, r.rule, r.detail) for r in run("xml_violations")) == sorted((p, *f) for p, nodes in pages.items() for f in faults(nodes, plans.REQUIRED, plans.INSIDE))
    scopes = run("scope_walk")
    assert scopes and all(r.target == nearest(pages[r.page_id], r.context, r.wanted) for r in scopes)
    fit = {r.expr_id for r in run("path_expressions")}
    assert {plans.EXPRESSIONS.index(e) for e in ("$", "$.body..a", "ul.li[2].a", "a[3]", "$..footer")} <= fit and plans.EXPRESSIONS.index("a.") not in fit


class Tree:
    """A tree of lists, edited in place."""

    def __init__(self, name, text):
        self.name, self.text, self.children = name, text, []


def grown(nodes):
    made = [Tree(n["name"], "".join(n["text"])) for n in nodes]
    roots = []
    for n, t in zip(nodes, made):
        (made[n["parent"]].children if n["parent"] is not None else roots).append(t)
    return roots, made


def listed(roots):
    out = []

    def visit(trees_, path, depth):
        seen = {}
        for t in trees_:
            k = seen.get(t.name, 0)
            seen[t.name] = k + 1
            here = f"{path}/{t.name}#{k}"
            out.append([here, depth, t.text, len(out), 0])
            row = out[-1]
            visit(t.children, here, depth + 1)
            row[4] = len(out) - 1

    visit(roots, "", 0)
    return [tuple(r) for r in out]


def replayed(nodes, edits):
    """(faults, tree after the batch) by pairs of edits and by hand."""
    at = {n["path"]: n for n in nodes}
    faults = {}
    for e in edits:
        n = at.get(e["path"])
        if e["op"] not in trees.EDITS:
            faults[e["seq"]] = "unknown"
        elif n is None:
            faults[e["seq"]] = "missing"
        elif ((e["op"].startswith("insert") or e["op"] == "replace") and e["name"] is None) or (e["op"] == "set" and e["text"] is None):
            faults[e["seq"]] = "no_value"
        elif n["depth"] == 0 and e["op"] in ("remove", "insert_before", "insert_after"):
            faults[e["seq"]] = "root"
    sound = [e for e in edits if e["seq"] not in faults]
    whole = [e for e in sound if e["op"] in ("replace", "remove")]
    for e in sound:
        n, beside = at[e["path"]], e["op"] in ("insert_before", "insert_after")
        around = [at[w["path"]] for w in whole if at[w["path"]]["pre"] in n["ancestors"]]
        here = [w for w in sound if w["path"] == e["path"] and not w["op"].startswith("insert") and w is not e]
        earlier = [w for w in here if (w["op"] == "set", w["seq"]) < (e["op"] not in ("replace", "remove"), e["seq"])]
        if around or (not beside and e["op"] != "insert_child" and earlier) or (e["op"] == "insert_child" and any(w["op"] in ("replace", "remove") for w in here)):
            faults[e["seq"]] = "overlap"
    roots, made = grown(nodes)
    if faults:
        return faults, listed(roots)
    parent_list = lambda n: made[n["parent"]].children if n["parent"] is not None else roots
    for e in sorted(sound, key=lambda e: (e["op"] == "remove", e["op"] == "insert_child", -e["seq"] if e["op"] == "insert_after" else e["seq"])):
        n = at[e["path"]]
        t, beside = made[n["pre"]], parent_list(n)
        if e["op"] == "set":
            t.text = e["text"]
        elif e["op"] == "replace":
            t.name, t.text, t.children = e["name"], e["text"], []
        elif e["op"] == "remove":
            beside.remove(t)
        elif e["op"] == "insert_child":
            t.children.append(Tree(e["name"], e["text"]))
        else:
            beside.insert(beside.index(t) + (e["op"] == "insert_after"), Tree(e["name"], e["text"]))
    return faults, listed(roots)


def test_batches_equal_a_replay(spark):
    from quillspark.operators.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    rng = random.Random(9)
    texts = {k: "".join(rng.choice(["<a>", "<b>", "<c>", "x", "</a>", "</b>", "</c>"]) for _ in range(rng.randint(1, 40))) for k in range(150)}
    log, want, verdicts = [], {}, {}
    for doc, text in texts.items():
        nodes = markup.nodes_of(text)
        edits = []
        for seq in range(rng.choice([0, 1, 2, 3, 6])):
            path = rng.choice(nodes)["path"] if nodes and rng.random() < 0.97 else "/no#0"
            op = rng.choice(trees.EDITS if rng.random() < 0.98 else ["move", None])
            edits.append({"seq": seq, "op": op, "path": path, "name": rng.choice(["a", "n"]) if rng.random() < 0.97 else None, "text": rng.choice(["t", ""]) if rng.random() < 0.97 else None})
        log += [(doc, *e.values()) for e in edits]
        faults, want[doc] = replayed(nodes, edits)
        if edits:
            verdicts[doc] = (not faults, len(edits), ",".join(f"{s}:{f}" for s, f in sorted(faults.items())))
    table = markup.node_table(spark.createDataFrame(list(texts.items()), "doc int, html string"), ["doc"], "html")
    after, said = trees.apply_edits(table, spark.createDataFrame(log, "doc int, seq long, op string, path string, name string, text string"), ["doc"])
    assert {r.doc: (r.accepted, r.n_edits, r.faults) for r in said.collect()} == verdicts
    got = {doc: [] for doc in texts}
    for r in sorted(after.collect(), key=lambda r: (r.doc, r.pre)):
        got[r.doc].append((r.path, r.depth, r.text, r.pre, r.last))
    assert got == want and 20 < sum(v[0] for v in verdicts.values()) < len(verdicts)


def test_edit_query_of_pages(spark):
    from quillspark.plans import catalog

    rows = catalog.QUERIES["tree_edit_batches"](spark, "/root/testdata/sf0.001").collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.page_id, []).append(r)
    assert all(any(r.path.endswith("/h2#0") for r in page) == page[0].edited for page in by_page.values())
    assert {page[0].edited for page in by_page.values()} == {True, False} and all(("8:missing" in page[0].faults) == (p % 4 == 2) for p, page in by_page.items())
