"""Orphan passes against plain lists, and trees of states against sets."""

import random
import re


from quillspark.operators import merge
from quillspark.operators.checkpoints import ensure_checkpoint_dir


def shape(text):
    return len(re.sub(r"\s+", "", text)), max(len(re.findall(r"[^\W_]+", text)), 1), len(re.findall("[0-9]", text)), len(re.findall(r"[!-/:-@\[-`{-~]", text))


def alike(a, b):
    (ca, wa, da, pa), (cb, wb, db, pb) = shape(a), shape(b)
    if ca == 0 or cb == 0:
        return ca == cb
    return max(ca, cb) <= min(ca, cb) * (3.5 if max(ca, cb) <= 32 else 2.2) and max(wa, wb) <= min(wa, wb) * (4.0 if min(wa, wb) <= 1 else 2.5) and abs(da - db) <= 3 and abs(pa - pb) <= 8


class Node:
    def __init__(self, pos, side, kind, left, right, anchor=None, condition=None):
        self.pos, self.side, self.kind, self.anchor, self.condition, self.via, self.members = pos, side, kind, anchor, condition, None, [pos]
        self.left, self.right = (left or "" if side != "right" else None), (right or "" if side != "left" else None)

    def text(self):
        return self.left if self.side == "left" else self.right

    def take(self, others, via, ahead=False):
        for side in ("left", "right"):
            own, more = getattr(self, side), [getattr(o, side) for o in others]
            texts = [t for t in (*more, own) if t and t.strip(" ")] if ahead else [t for t in (own, *more) if t is not None]
            if texts:
                setattr(self, side, " ".join(texts))
        for o in others:
            self.members += o.members
            self.anchor = self.anchor or o.anchor
        self.via = via
        if not ahead:
            self.side = "both"


def brute(nodes):
    """The five passes, one node after the other."""
    orphan = lambda n: n.side != "both"
    # 1: into the next two-sided paragraph, or the one before
    moves = {}
    for i, n in enumerate(nodes):
        if not (orphan(n) and n.kind == "paragraph" and n.text() != ""):
            continue
        for way in (range(i + 1, len(nodes)), range(i - 1, -1, -1)):
            for j in way:
                m = nodes[j]
                if m.kind != "paragraph":
                    break
                if m.side == "both" and (n.side == "right" or m.left.strip(" ") == ""):
                    moves.setdefault(j, []).append(i)
                    break
            else:
                continue
            if m.kind == "paragraph":
                break
    for j, those in moves.items():
        nodes[j].take([nodes[i] for i in those], "paragraph", True)
    gone = {i for those in moves.values() for i in those}
    nodes = [n for i, n in enumerate(nodes) if i not in gone]
    # 2: runs
    out, i = [], 0
    while i < len(nodes):
        j = i
        while j < len(nodes) and orphan(nodes[j]) and nodes[j].kind == "paragraph":
            j += 1
        run = nodes[i:j]
        sides = {s: [n.text() for n in run if n.side == s] for s in ("left", "right")}
        if run and all(1 <= len(t) <= 5 and " ".join(t).strip(" ") for t in sides.values()) and alike(" ".join(sides["left"]), " ".join(sides["right"])):
            run[0].take(run[1:], "run")
            run = run[:1]
        out += run or nodes[i : i + 1]
        i = max(j, i + 1)
    nodes = out
    # 3: equal conditions
    gone = set()
    for n in nodes:
        if n.side == "left" and n.kind == "conditional" and n.condition is not None:
            for k, m in enumerate(nodes):
                if k not in gone and m.side == "right" and m.kind == "conditional" and m.condition == n.condition:
                    n.take([m], "condition")
                    gone.add(k)
                    break
    nodes = [n for k, n in enumerate(nodes) if k not in gone]
    # 4: labels
    gone, moves = set(), []
    for i, n in enumerate(nodes):
        if not (orphan(n) and n.kind == "field"):
            continue
        for j in (i + 1, i - 1):
            if 0 <= j < len(nodes) and j not in gone:
                m = nodes[j]
                if m.kind == "paragraph" and orphan(m) and m.side != n.side and 1 <= len(m.text().strip(" ")) <= 80:
                    gone.add(j)
                    moves.append((i, j))
                    break
    for i, j in moves:
        nodes[i].take([nodes[j]], "label")
    nodes = [n for k, n in enumerate(nodes) if k not in gone]
    # 5: neighbourhood
    anchors = [n.side == "both" and n.anchor is not None for n in nodes]
    gone, moves, used = set(), [], set()
    for i, n in enumerate(nodes):
        if i in used or not orphan(n) or n.kind is None:
            continue
        for j in range(i + 1, min(i + 7, len(nodes))):
            m = nodes[j]
            if j in used or not orphan(m) or m.side == n.side or m.kind != n.kind:
                continue
            around = min(sum(anchors[:i]), 3) + min(sum(anchors[j + 1 :]), 3)
            if around >= 3 or (around == 0 and j - i <= 2):
                used |= {i, j}
                moves.append((i, j))
                break
    for i, j in moves:
        nodes[i].take([nodes[j]], "neighbourhood")
        gone.add(j)
    return [n for k, n in enumerate(nodes) if k not in gone]


def drawn(rng, n):
    rows = []
    for pos in range(n):
        side = rng.choice(["both", "left", "right", "left", "right"])
        kind = rng.choice(["paragraph"] * 4 + ["field", "conditional", "heading", None])
        text = lambda: rng.choice([None, "", " ", "word", "two words", "a 1 b", "x" * 90, "some longer text with words and, marks."])
        rows.append((pos * 3, side, kind, text(), text(), rng.choice([None, "k"]) if side == "both" else None, rng.choice(["p", "q", None]) if kind == "conditional" else None))
    return rows


def merged(spark, lists):
    rows = [(key, *r) for key, rows in lists for r in rows]
    ensure_checkpoint_dir(spark)
    df = spark.createDataFrame(rows, "key int, pos long, side string, kind string, left_text string, right_text string, anchor string, condition string")
    return sorted(((r.key, r.pos, r.side, r.kind, r.left_text, r.right_text, r.via, tuple(r.members)) for r in merge.consolidate(df, ["key"]).collect()), key=str)


def expected(lists):
    return sorted(((key, n.pos, n.side, n.kind, n.left, n.right, n.via, tuple(n.members)) for key, rows in lists for n in brute([Node(*r) for r in rows])), key=str)


def test_random_lists_equal_plain_passes(spark):
    rng = random.Random(11)
    lists = [(k if k else None, drawn(rng, rng.randint(0, 40))) for k in range(160)]
    got = merged(spark, lists)
    assert got == expected(lists)
    assert {g[6] for g in got} == {None, "paragraph", "run", "condition", "label", "neighbourhood"}
    placed = sorted((g[0], m) for g in got for m in g[7] if g[0] is not None)
    assert placed == sorted((k, r[0]) for k, rows in lists if k is not None for r in rows)  # every node once


def test_long_runs_of_choices_bind_in_order(spark):
    rng = random.Random(12)
    lists = [(1, [(p, rng.choice(["left", "right"]), rng.choice(["field", "heading"]), "a", "b", None, None) for p in range(300)]), (2, [])]
    assert merged(spark, lists) == expected(lists)


def test_no_entries(spark):
    assert merged(spark, []) == []


def test_query_of_conversations(spark):
    """Conversations of the smallest data set: alignment and passes by plain code, and every line of both sides placed once."""
    from quillspark.plans import catalog, merging

    sf = "/root/testdata/sf0.001"
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        for k, line in enumerate((r.text or "").split("\n")):
            short = r.role == "assistant" and 1 <= len(line) <= 60
            talks.setdefault(r.conv_id, {})[r.turn, k] = ("field" if r.role == "user" else "conditional" if short else "paragraph", line, line[:1].lower() if short else None)
    lists = []
    for c in talks:
        if c + 1 not in talks:
            continue
        rows = []
        for turn, line in sorted({*talks[c], *talks[c + 1]}):
            a, b = talks[c].get((turn, line)), talks[c + 1].get((turn, line))
            pos = turn * 2_000_000 + line * 2
            if a and b and a[0] == b[0] and a[2] == b[2] and alike(a[1], b[1]):
                rows.append((pos, "both", a[0], a[1], b[1], str(turn) if a[0] == "field" else None, a[2]))
            else:
                sides = [(s, e) for s, e in (("left", a), ("right", b)) if e]
                rows += [(pos + k, s, e[0], e[1], e[1], None, e[2]) for k, (s, e) in enumerate(sides)]
        lists.append((c, rows))
    got = sorted(((r.conv_id, r.pos, r.side, r.kind, r.via, r.members) for r in catalog.QUERIES["orphan_consolidation"](spark, sf).collect()), key=str)
    assert got == sorted(((k, p, s, kind, via, ",".join(map(str, sorted(m)))) for k, p, s, kind, _, _, via, m in expected(lists)), key=str)
    assert len({g[4] for g in got}) >= 4
    lines = merging.aligned_nodes(spark.read.parquet(f"{sf}/conversations.parquet")).count()
    assert sum(len(g[5].split(",")) for g in got) == lines


def states_by_sets(rows, width):
    """{(path, condition)} of common and conditional nodes, from sets of states."""
    have = {}
    for *choice, leaf in rows:
        if leaf and None not in leaf:
            for k in range(len(leaf) + 1):
                have.setdefault(tuple(leaf[:k]), set()).add(tuple(choice))
    out = set()
    for path, states in have.items():
        if not path:
            continue
        parent, open_states = have[path[:-1]], {()}
        for level in range(width + 1):
            following = set()
            for prefix in open_states:
                under = {s for s in parent if s[:level] == prefix}
                own = {s for s in states if s[:level] == prefix}
                if own == under:
                    out.add((path, prefix, len(own)))
                elif own:
                    following |= {s[: level + 1] for s in own}
            open_states = following
    return out


def test_states_merge_to_common_and_conditional_nodes(spark):
    ensure_checkpoint_dir(spark)
    rng = random.Random(4)
    for n in (0, 3, 60, 400):
        rows = [(rng.choice("ab"), rng.choice(["x", "", None]), rng.choice("12"), [rng.choice("pq") for _ in range(rng.randint(0, 3))] if rng.random() < 0.9 else rng.choice([None, ["p", None]])) for _ in range(n)]
        df = spark.createDataFrame(rows, "s string, t string, u string, path array<string>")
        got = {(tuple(r.path), tuple(r.condition), r.n_states) for r in merge.merge_states(df, ["s", "t", "u"], "path").collect()}
        assert got == states_by_sets(rows, 3)


def test_state_bitmaps_name_the_states(spark):
    rows = [(s, ["a"]) for s in "xyz"] + [(s, ["a", "b"]) for s in "xz"]
    got = {tuple(r.path): (r.kind, r.states) for r in merge.merge_states(spark.createDataFrame(rows, "s string, path array<string>"), ["s"], "path").where("level = 0 OR condition = array('x')").collect()}
    assert got["a",][0] == "common" and list(got["a",][1].values())[0][0] == 0b111
    assert got["a", "b"][0] == "conditional" and list(got["a", "b"][1].values())[0][0] == 0b001
