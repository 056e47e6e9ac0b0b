"""Merging of aligned node lists: passes that give the nodes which an alignment left over a place.

Entries of an aligned list have a key, a position and a side: ``both``, ``left`` or ``right``. Each pass looks at the entries that
are still one-sided, takes some of them into others, and hands the rest on; what a pass may take is decided on the list as
the pass before left it. Passes are windows over a key's entries in order and joins on its positions; only the last, in
which earlier choices bind later ones, folds over a run of neighbours.

Columns: the key, ``pos`` (long), ``side``, ``kind``, ``left_text``, ``right_text``, ``anchor`` (null: not one), ``condition``, ``via`` (the pass
that completed the entry), ``members`` (positions of the original entries in it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the result: nodes of one side in a run that is merged, characters of a label, reach and neighbours of the last pass.
RUN_MOST, LABEL_MOST, REACH, NEIGHBOURS = 5, 80, 6, 3

FIELDS = {"pos": "long", "side": "string", "kind": "string", "left_text": "string", "right_text": "string", "anchor": "string", "condition": "string", "via": "string", "members": "array<long>"}


def same_shape(a: Column, b: Column) -> Column:
    """Two texts have about the same number of characters, words, digits and punctuation marks.

    Fixed values: lengths differ by a factor of 2.2 at most (3.5 up to 32 characters), words by 2.5 (4 if one has a single
    word), digits by 3 and marks by 8.
    """
    count = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    shapes = [(F.length(F.regexp_replace(t, r"\s+", "")), F.greatest(count(t, r"[\p{L}\p{N}]+"), F.lit(1)), count(t, "[0-9]"), count(t, r"[!-/:-@\[-`{-~]")) for t in (a, b)]
    (chars_a, words_a, digits_a, marks_a), (chars_b, words_b, digits_b, marks_b) = shapes
    wide = lambda x, y, factor: F.greatest(x, y) <= F.least(x, y) * factor
    close = wide(chars_a, chars_b, F.when(F.greatest(chars_a, chars_b) <= 32, 3.5).otherwise(2.2))
    close = close & wide(words_a, words_b, F.when(F.least(words_a, words_b) <= 1, 4.0).otherwise(2.5))
    close = close & (F.abs(digits_a - digits_b) <= 3) & (F.abs(marks_a - marks_b) <= 8)
    return F.when((chars_a == 0) & (chars_b == 0), True).when((chars_a == 0) | (chars_b == 0), False).otherwise(close)


def entries_of(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Entries of an aligned list: missing columns are null, each entry is its own member and completed by no pass."""
    have = {c.lower() for c in aligned.columns}
    values = {c: F.col(c) if c in have else F.lit(None) for c in FIELDS} | {"members": F.array(F.col("pos").cast("long")), "via": F.lit(None)}
    for c, other in (("left_text", "right"), ("right_text", "left")):  # a null text is empty; a side that is not there has none
        values[c] = F.when(F.col("side") != other, F.coalesce(values[c].cast("string"), F.lit("")))
    return aligned.select(*key, *[v.cast(FIELDS[c]).alias(c) for c, v in values.items()])


def in_order(key: list[str]):
    return Window.partitionBy(*key).orderBy("pos")


def renumbered(entries: DataFrame, key: list[str]) -> DataFrame:
    """Entries with ``at``, their place in the list as it is now."""
    return entries.withColumn("at", F.row_number().over(in_order(key)))


def null_safe(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def absorbed(entries: DataFrame, moves: DataFrame, key: list[str], via: str, ahead: bool = False) -> DataFrame:
    """Entries after ``moves`` (key, pos, into): each moved entry gives its texts and members to its target and goes.

    Texts of a side are joined in the order of their positions, behind the target's own and making it two-sided; with ``ahead``
    before it, blank ones left out, and the side stays.
    """
    names = [f"m_{c}" for c in key]
    moved = moves.toDF(*names, "m_pos", "m_into")
    joined = entries.join(moved, null_safe([*key, "pos"], [*names, "m_pos"]), "left").drop(*names, "m_pos")
    gone, rest = joined.where("m_into IS NOT NULL"), joined.where("m_into IS NULL").drop("m_into")
    given = [f"g_{c}" for c in key]
    parts = gone.groupBy(*[F.col(c).alias(g) for c, g in zip(key, given)], F.col("m_into").alias("g_pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "left_text", "right_text", "anchor", "members"))).alias("parts"))
    out = rest.join(parts, null_safe([*key, "pos"], [*given, "g_pos"]), "left")
    hit = F.col("parts").isNotNull()

    def text(c: str) -> Column:
        own, more = F.array(F.col(c)), F.transform("parts", lambda p: p[c])
        texts = F.filter(F.concat(more, own) if ahead else F.concat(own, more), lambda t: F.trim(t) != "" if ahead else t.isNotNull())
        return F.when(hit & (F.size(texts) > 0), F.array_join(texts, " ")).otherwise(F.col(c))

    changed = {
        "left_text": text("left_text"),
        "right_text": text("right_text"),
        "side": F.when(hit & F.lit(not ahead), "both").otherwise(F.col("side")),
        "via": F.when(hit, via).otherwise(F.col("via")),
        "anchor": F.coalesce("anchor", F.element_at(F.transform("parts", lambda p: p["anchor"]), 1)),
        "members": F.when(hit, F.concat("members", F.flatten(F.transform("parts", lambda p: p["members"])))).otherwise(F.col("members")),
    }
    return out.select(*key, *[changed.get(c, F.col(c)).alias(c) for c in FIELDS])


def paragraphs_into_neighbours(entries: DataFrame, key: list[str]) -> DataFrame:
    """One-sided paragraphs go to the next two-sided one, or else the one before, with nothing but paragraphs in between.

    Those of the left side only to one whose left text is blank, those of the right to any.
    """
    segment = F.sum(F.when(F.col("kind") == "paragraph", 0).otherwise(1)).over(in_order(key))
    own = F.when(F.col("side") == "left", F.col("left_text")).when(F.col("side") == "right", F.col("right_text"))
    both = (F.col("side") == "both") & (F.col("kind") == "paragraph")
    blank = F.trim(F.coalesce("left_text", F.lit(""))) == ""
    w = Window.partitionBy(*key, "segment").orderBy("pos")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)

    def target(fits: Column) -> Column:
        at = F.when(fits, F.col("pos"))
        return F.coalesce(F.first(at, True).over(after), F.last(at, True).over(before))

    looked = entries.withColumn("segment", segment).withColumns({"for_left": target(both & blank), "for_right": target(both)})
    orphan = (F.col("kind") == "paragraph") & (own != "")
    moves = looked.where(orphan).select(*key, "pos", F.when(F.col("side") == "left", F.col("for_left")).otherwise(F.col("for_right")).alias("into"))
    return absorbed(entries, moves.where("into IS NOT NULL"), key, "paragraph", ahead=True)


def paragraph_runs(entries: DataFrame, key: list[str]) -> DataFrame:
    """A run of one-sided paragraphs becomes one paragraph if both sides are in it, with few nodes each and texts of one shape."""
    orphan = (F.col("kind") == "paragraph") & F.col("side").isin("left", "right")
    run = F.sum(F.when(orphan, 0).otherwise(1)).over(in_order(key))
    rows = entries.withColumn("run", run).where(orphan)
    sizes = Window.partitionBy(*key, "run")
    few = [F.count(F.when(F.col("side") == s, 1)).over(sizes).between(1, RUN_MOST) for s in ("left", "right")]
    rows = rows.withColumn("few", few[0] & few[1]).where("few")  # so that what is gathered is short
    gathered = rows.groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "side", "left_text", "right_text"))).alias("parts"))
    text = lambda side: F.array_join(F.transform(F.filter("parts", lambda p: p["side"] == side), lambda p: F.coalesce(p[f"{side}_text"], F.lit(""))), " ")
    fit = gathered.withColumns({"left": text("left"), "right": text("right")}).where((F.trim("left") != "") & (F.trim("right") != "") & same_shape(F.col("left"), F.col("right")))
    first = F.element_at("parts", 1)["pos"]
    moves = fit.select(*key, first.alias("into"), F.explode("parts").alias("p")).select(*key, F.col("p.pos").alias("pos"), "into").where("pos <> into")
    return absorbed(entries, moves, key, "run")


def equal_conditions(entries: DataFrame, key: list[str]) -> DataFrame:
    """The n-th left conditional of a condition meets the n-th right one of the same condition, wherever they stand."""
    rank = F.row_number().over(Window.partitionBy(*key, "side", "condition").orderBy("pos"))
    rows = entries.where((F.col("kind") == "conditional") & F.col("side").isin("left", "right") & F.col("condition").isNotNull()).withColumn("rank", rank)
    left = rows.where("side = 'left'").select(*[F.col(c).alias(f"l_{c}") for c in [*key, "condition", "rank"]], F.col("pos").alias("into"))
    right = rows.where("side = 'right'").select(*key, "condition", "rank", "pos")
    moves = right.join(left, null_safe([*key, "condition", "rank"], [f"l_{c}" for c in [*key, "condition", "rank"]])).select(*key, "pos", "into")
    return absorbed(entries, moves, key, "condition")


def paragraphs_into_labels(entries: DataFrame, key: list[str]) -> DataFrame:
    """A one-sided field takes a short paragraph of the other side that stands right behind it, or else right before it.

    Fields choose in order. The place behind a field is free when it chooses; the one before may have gone to the field
    before that, so looking two entries back decides.
    """
    w = in_order(key)
    own = F.coalesce(F.when(F.col("side") == "left", F.col("left_text")).when(F.col("side") == "right", F.col("right_text")), F.lit(""))
    short = F.length(F.trim(own)).between(1, LABEL_MOST)
    label = F.coalesce(F.when((F.col("kind") == "paragraph") & F.col("side").isin("left", "right") & short, F.col("side")), F.lit(""))
    field = F.coalesce(F.when((F.col("kind") == "field") & F.col("side").isin("left", "right"), F.col("side")), F.lit(""))
    wants = F.when(field == "left", "right").when(field == "right", "left").otherwise("-")
    rows = entries.withColumns({"label": label, "wants": wants})
    rows = rows.withColumn("takes_next", F.coalesce(F.lead("label").over(w) == F.col("wants"), F.lit(False)))
    before_taken = F.coalesce(F.lag("takes_next", 2).over(w), F.lit(False))
    takes_before = ~F.col("takes_next") & F.coalesce(F.lag("label").over(w) == F.col("wants"), F.lit(False)) & ~before_taken
    rows = rows.withColumns({"taken": F.when(F.col("takes_next"), F.lead("pos").over(w)).when(takes_before, F.lag("pos").over(w))})
    moves = rows.where("taken IS NOT NULL").select(*key, F.col("taken").alias("pos"), F.col("pos").alias("into"))
    return absorbed(entries, moves, key, "label")


def by_neighbourhood(entries: DataFrame, key: list[str]) -> DataFrame:
    """One-sided nodes of one kind and both sides, at most six places apart, meet if enough anchors stand around them.

    Of the anchors before the first and behind the second, three each count at most; three in all are enough. Without any,
    the two may be two places apart. Nodes choose in order, each the nearest that is still free: a fold over each run
    of one-sided nodes with gaps of at most six places, as none can choose beyond such a gap.
    """
    w = in_order(key)
    is_anchor = F.when((F.col("side") == "both") & F.col("anchor").isNotNull(), 1).otherwise(0)
    rows = renumbered(entries, key).withColumns(
        {
            "before": F.least(F.coalesce(F.sum(is_anchor).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(NEIGHBOURS)),
            "behind": F.least(F.coalesce(F.sum(is_anchor).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)), F.lit(NEIGHBOURS)),
        }
    )
    orphans = rows.where(F.col("side").isin("left", "right") & F.col("kind").isNotNull())
    fresh = F.when(F.col("at") - F.lag("at").over(w) <= REACH, 0).otherwise(1)
    orphans = orphans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    runs = orphans.groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "side", "kind", "before", "behind"))).alias("nodes"))
    node = "struct<at:int,pos:bigint,side:string,kind:string,before:bigint,behind:bigint>"
    state = f"struct<open:array<{node}>,pairs:array<struct<pos:bigint,into:bigint>>>"

    def step(s: Column, x: Column) -> Column:
        score = lambda o: o["before"] + x["behind"]
        near = lambda o: (score(o) >= NEIGHBOURS) | ((score(o) == 0) & (x["at"] - o["at"] <= 2))
        free = F.filter(s["open"], lambda o: x["at"] - o["at"] <= REACH)
        fits = F.filter(free, lambda o: (o["side"] != x["side"]) & (o["kind"] == x["kind"]) & near(o))
        first = F.element_at(fits, 1)
        met = F.struct(F.filter(free, lambda o: o["pos"] != first["pos"]).alias("open"), F.concat(s["pairs"], F.array(F.struct(x["pos"].alias("pos"), first["pos"].alias("into")))).alias("pairs"))
        return F.when(F.size(fits) > 0, met.cast(state)).otherwise(F.struct(F.concat(free, F.array(x)).alias("open"), s["pairs"].alias("pairs")).cast(state))

    empty = F.struct(F.array().cast(f"array<{node}>").alias("open"), F.array().cast("array<struct<pos:bigint,into:bigint>>").alias("pairs")).cast(state)
    pairs = runs.select(*key, F.explode(F.aggregate(F.col("nodes").cast(f"array<{node}>"), empty, step)["pairs"]).alias("p"))
    return absorbed(entries, pairs.select(*key, "p.pos", "p.into"), key, "neighbourhood")


PASSES = [paragraphs_into_neighbours, paragraph_runs, equal_conditions, paragraphs_into_labels, by_neighbourhood]


def consolidate(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Entries after all passes; each entry of ``aligned`` is a member of exactly one.

    ``pos`` must tell the entries of a key apart, and the entries of a key, say the nodes of one document, must fit a task;
    null keys are a key. Each pass is written once, so that the next reads what it left.
    """
    entries = entries_of(aligned, key)
    for step in PASSES:
        entries = step(entries, key).checkpoint()
    return entries


def merge_states(leaves: DataFrame, selections: list[str], path: str) -> DataFrame:
    """One tree from the trees of many states: (path, depth, kind, level, condition, n_states, states) for each node and condition.

    A state is a choice for each of ``selections``, the outer first; its tree holds the paths of its leaves (arrays of names) and all their
    beginnings. A node that is in all states of its parent is ``common``. Another is ``conditional``: it stands under each
    condition, a beginning of the choices, that holds all states which the parent has there, and under none within such a
    one. ``states`` is the bitmap of those, by their rank among all. All levels of the tree are merged at once: a node asks only
    its parent. Paths with a null in them or no names are left out; a null choice is a choice; repeated leaves count once.
    """
    width = len(selections)
    choice = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in selections])
    known = F.array(*[F.col(c).isNotNull() for c in selections])  # tells a null choice from an empty one
    rows = leaves.where(F.col(path).isNotNull() & (F.size(path) > 0) & ~F.exists(path, lambda x: x.isNull())).select(choice.alias("choice"), known.alias("known"), F.col(path).alias("leaf")).distinct()
    rank = rows.select("choice", "known").distinct().withColumn("rank", F.row_number().over(Window.orderBy("choice", "known")))  # one row for each state
    nodes = rows.select("choice", "known", F.explode(F.transform(F.sequence(F.lit(0), F.size("leaf")), lambda k: F.slice("leaf", F.lit(1), k))).alias("path")).distinct()
    nodes = nodes.join(rank, ["choice", "known"])
    levels = nodes.select("path", "rank", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("level"), "choice", "known")
    under = levels.select("path", "rank", "level", F.slice("choice", F.lit(1), F.col("level")).alias("choice"), F.slice("known", F.lit(1), F.col("level")).alias("known"))
    # a bitmap covers 32,768 states; more fall into further buckets, which are added up
    bucket = under.groupBy("path", "level", "choice", "known", F.expr("bitmap_bucket_number(rank)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(rank))").alias("bits"))
    counts = bucket.groupBy("path", "level", "choice", "known").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "bits")))).alias("states")).checkpoint()
    parents = counts.select(F.col("path").alias("up"), "level", "choice", "known", F.col("n").alias("of"))
    full = counts.where(F.size("path") > 0).withColumn("up", F.slice("path", F.lit(1), F.size("path") - 1)).join(parents, ["up", "level", "choice", "known"]).where("n = of")
    # drop conditions within a wider one of the same node
    wider = full.select("path", "level", "choice", "known")
    inner = full.select("path", "choice", "known", "level", "n", "states", F.explode_outer(F.when(F.col("level") > 0, F.sequence(F.lit(0), F.col("level") - 1))).alias("above"))
    held = inner.select("path", F.col("level"), "choice", "known", F.col("above").alias("w_level"), F.slice("choice", F.lit(1), F.coalesce("above", F.lit(0))).alias("w_choice"), F.slice("known", F.lit(1), F.coalesce("above", F.lit(0))).alias("w_known"))
    covered = held.where("w_level IS NOT NULL").join(wider.toDF("path", "w_level", "w_choice", "w_known"), ["path", "w_level", "w_choice", "w_known"], "left_semi").select("path", "level", "choice", "known").distinct()
    least = full.join(covered, ["path", "level", "choice", "known"], "left_anti")
    condition = F.transform(F.arrays_zip("choice", "known"), lambda c: F.when(c["known"], c["choice"]))
    return least.select("path", F.size("path").alias("depth"), F.when(F.col("level") == 0, "common").otherwise("conditional").alias("kind"), "level", condition.alias("condition"), F.col("n").alias("n_states"), "states")
