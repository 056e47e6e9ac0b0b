"""State-space exploration, selections, paths and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillspark.operators import graph
from quillspark.operators.checkpoints import ensure_checkpoint_dir
from quillspark.operators.compare import both_ways
from quillspark.operators.sequences import number_rows
from quillspark.plans.registry import query
from quillspark.session import table


@query(
    "state_cross_product",
    """
    SELECT DISTINCT f.x AS flag, s.x AS status, p.x AS priority FROM (SELECT DISTINCT l_returnflag AS x FROM lineitem) f, (SELECT DISTINCT o_orderstatus AS x FROM orders) s, (SELECT DISTINCT o_orderpriority AS x FROM orders) p
    """,
)
def state_cross_product(spark, sf_dir):
    """All combinations of the options of three independent fields; each side is one row per option."""
    fields = (("lineitem", "l_returnflag", "flag"), ("orders", "o_orderstatus", "status"), ("orders", "o_orderpriority", "priority"))
    options = [table(spark, sf_dir, t).select(F.col(c).alias(n)).distinct() for t, c, n in fields]
    return reduce(lambda a, b: a.crossJoin(b), options).distinct()


@query(
    "dedup_representative",
    "SELECT md5(text) AS layout, min(doc_id) AS representative, count(*) AS n, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY md5(text)",
)
def dedup_representative(spark, sf_dir):
    """Identical branches by their layout key: the first stays, with all their values."""
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("layout"))
    return docs.agg(F.min("doc_id").alias("representative"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


SIGNATURE = "SELECT conv_id, string_agg(role || ':' || turn, '->' ORDER BY turn) AS signature FROM conversations GROUP BY conv_id"


def signatures(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.col("turn").cast("string")).alias("s"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "->").alias("signature"))


@query("selection_signature", SIGNATURE)
def selection_signature(spark, sf_dir):
    """The ordered path of choices of each state as one text."""
    return signatures(spark, sf_dir)


@query(
    "signature_mismatch",
    f"""
    WITH s AS ({SIGNATURE}), a AS (SELECT signature FROM s WHERE conv_id % 2 = 0), b AS (SELECT signature FROM s WHERE conv_id % 2 = 1)
    SELECT signature, 'missing' AS side FROM (SELECT signature FROM a EXCEPT SELECT signature FROM b) UNION ALL SELECT signature, 'extra' FROM (SELECT signature FROM b EXCEPT SELECT signature FROM a)
    """,
)
def signature_mismatch(spark, sf_dir):
    """Signatures that only one of two sets of states has."""
    all_of = signatures(spark, sf_dir)
    return both_ways(all_of.where("conv_id % 2 = 0"), all_of.where("conv_id % 2 = 1"), "signature")


@query(
    "pair_by_signature",
    f"SELECT signature, min(conv_id) FILTER (WHERE conv_id % 2 = 0) AS first_id, min(conv_id) FILTER (WHERE conv_id % 2 = 1) AS second_id FROM ({SIGNATURE}) GROUP BY signature HAVING count(DISTINCT conv_id % 2) = 2",
)
def pair_by_signature(spark, sf_dir):
    """States of two languages with the same signature side by side."""
    first, second = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")), F.when(F.col("conv_id") % 2 == 1, F.col("conv_id"))
    return signatures(spark, sf_dir).groupBy("signature").agg(F.min(first).alias("first_id"), F.min(second).alias("second_id")).where("first_id IS NOT NULL AND second_id IS NOT NULL")


def nation_links(spark, sf_dir):
    """Nations linked by suppliers whose nation follows theirs within a region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    right = nation.toDF("b", "n_regionkey")
    return nation.withColumnRenamed("n_nationkey", "a").join(right, "n_regionkey").where("a < b").select("a", "b")


@query("connected_components", "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def connected_components(spark, sf_dir):
    """Components of the nations' links: one per region."""
    ensure_checkpoint_dir(spark)
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.connected_components(nodes, nation_links(spark, sf_dir))


CASCADE = "SELECT n_regionkey + 1000 AS a, n_nationkey AS b FROM nation UNION ALL SELECT n_nationkey, 2000 + s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"


@query(
    "dependents_cascade",
    f"""
    WITH RECURSIVE e AS ({CASCADE}), r AS (SELECT r_regionkey::BIGINT + 1000 AS start, r_regionkey::BIGINT + 1000 AS node, 0 AS depth FROM region UNION SELECT r.start, e.b::BIGINT, r.depth + 1 FROM r JOIN e ON e.a = r.node)
    SELECT start, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY ALL
    """,
)
def dependents_cascade(spark, sf_dir):
    """All nations and suppliers that depend on a region."""
    ensure_checkpoint_dir(spark)
    nation = table(spark, sf_dir, "nation")
    one = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 2000).cast("long").alias("b"))
    starts = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("node"))
    return graph.reachable(one.unionByName(two), starts)


@query(
    "fixpoint_prune",
    """
    WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey - 1 END AS dep FROM part WHERE p_size <> 7),
    k AS (SELECT id FROM r WHERE dep IS NULL UNION ALL SELECT r.id FROM r JOIN k ON r.dep = k.id)
    SELECT id FROM k
    """,
)
def fixpoint_prune(spark, sf_dir):
    """Rules whose chain of dependencies is unbroken."""
    ensure_checkpoint_dir(spark)
    rules = table(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") - 1).alias("depends_on"))
    return graph.fixpoint_prune(rules).select("id")


PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def paths(spark, sf_dir):
    """Pages by their path without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query("path_ancestors", f"SELECT DISTINCT array_to_string(p[1:k], '/') AS ancestor, k AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT string_split({PATH}, '/') AS p FROM pages))")
def path_ancestors(spark, sf_dir):
    """Every prefix of every path."""
    split = paths(spark, sf_dir).select(F.split("path", "/").alias("p"))
    deep = split.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return deep.select(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("ancestor"), F.col("k").cast("long").alias("depth")).distinct()


@query("path_query", f"SELECT page_id, p AS path FROM (SELECT page_id, {PATH} AS p FROM pages) WHERE p LIKE '%.example.com/%/1%' OR p LIKE '%/en/2_'")
def path_query(spark, sf_dir):
    """Paths by descendant and wildcard patterns."""
    p = F.col("path")
    return paths(spark, sf_dir).where(p.like("%.example.com/%/1%") | p.like("%/en/2_"))


@query("prefix_tree_counts", f"SELECT array_to_string(p[1:k], '/') AS prefix, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT string_split({PATH}, '/') AS p FROM pages)) GROUP BY 1")
def prefix_tree_counts(spark, sf_dir):
    """Pages below each node of the trie of paths."""
    split = paths(spark, sf_dir).select(F.split("path", "/").alias("p"))
    deep = split.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return deep.groupBy(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("prefix")).agg(F.count("*").alias("n"))


@query(
    "common_path_prefix",
    f"""
    WITH p AS (SELECT page_id % 5 AS g, string_split({PATH}, '.') AS s FROM pages), e AS (SELECT g, unnest(range(1, len(s) + 1)) AS k, s FROM p),
         l AS (SELECT g, k, count(DISTINCT array_to_string(s[1:k], '.')) AS d, count(*) AS n, min(array_to_string(s[1:k], '.')) AS prefix FROM e GROUP BY g, k), t AS (SELECT g, count(*) AS n FROM p GROUP BY g)
    SELECT t.g, coalesce(arg_max(l.prefix, l.k) FILTER (WHERE l.d = 1 AND l.n = t.n), '') AS prefix FROM t LEFT JOIN l ON l.g = t.g GROUP BY t.g
    """,
)
def common_path_prefix(spark, sf_dir):
    """The longest run of leading segments that all paths of a group share."""
    rows = paths(spark, sf_dir).select((F.col("page_id") % 5).alias("g"), F.split("path", "\\.").alias("s"))
    deep = rows.select("g", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k")).select("g", "k", F.array_join(F.slice("s", 1, F.col("k")), ".").alias("prefix"))
    levels = deep.groupBy("g", "k").agg(F.count_distinct("prefix").alias("d"), F.count("prefix").alias("m"), F.min("prefix").alias("prefix"))
    whole = rows.groupBy("g").agg(F.count("*").alias("n"))
    fits = whole.join(levels, "g", "left").withColumn("fit", (F.col("d") == 1) & (F.col("m") == F.col("n")))
    return fits.groupBy("g").agg(F.coalesce(F.max_by("prefix", F.when(F.col("fit"), F.col("k"))), F.lit("")).alias("prefix"))


@query("tree_flatten", "SELECT r_name AS root, n_name AS parent, s_suppkey AS leaf, r_name || '/' || n_name || '/' || s_suppkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_flatten(spark, sf_dir):
    """Leaves with their path from the root."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("root"))
    nation = table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("parent"), "root")
    leaves = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    return leaves.select("root", "parent", F.col("s_suppkey").alias("leaf"), F.concat_ws("/", "root", "parent", F.col("s_suppkey").cast("string")).alias("path"))


@query(
    "inherited_visibility",
    "SELECT s_suppkey AS node, greatest(n_regionkey % 3, n_nationkey % 4, s_suppkey % 2)::INT AS presence FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def inherited_visibility(spark, sf_dir):
    """The most restrictive presence (visible 0, invisible 1, hidden 2, inactive 3) along the chain of ancestors."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.greatest(F.col("n_regionkey") % 3, F.col("n_nationkey") % 4).alias("above"))
    own = (F.col("s_suppkey") % 2).cast("int")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("node"), F.greatest("above", own).cast("int").alias("presence"))


@query("unreferenced_roots", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_roots(spark, sf_dir):
    """Groups that nothing refers to."""
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(used, "node", "left_anti")


@query("attach_conditions", "SELECT c.c_custkey AS field, coalesce(list_sort(list(o.o_orderkey) FILTER (WHERE o.o_orderkey IS NOT NULL)), []) AS conditions FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
def attach_conditions(spark, sf_dir):
    """Conditions grouped by their trigger and attached to it; an empty list where there are none."""
    conditions = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("field")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("conditions"))
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field"))
    return fields.join(conditions, "field", "left").select("field", F.coalesce("conditions", F.array().cast("array<bigint>")).alias("conditions"))


@query("invert_relation", "SELECT part AS target, list_sort(list(trigger)) AS triggers FROM (SELECT DISTINCT l_partkey AS part, l_suppkey AS trigger FROM lineitem) GROUP BY part")
def invert_relation(spark, sf_dir):
    """trigger -> targets turned into target -> triggers."""
    shows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trigger")).agg(F.collect_set("l_partkey").alias("targets"))
    pairs = shows.select("trigger", F.explode("targets").alias("target"))
    return pairs.groupBy("target").agg(F.array_sort(F.collect_list("trigger")).alias("triggers"))


@query("default_merge", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE n_name END AS kind, n_name AS home FROM customer JOIN nation ON c_nationkey = n_nationkey")
def default_merge(spark, sf_dir):
    """Own attributes over those of a prototype, as maps."""
    proto = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.create_map(F.lit("kind"), "n_name", F.lit("home"), "n_name").alias("proto"))
    own = F.when(F.col("c_acctbal") >= 0, F.create_map(F.lit("kind"), "c_mktsegment")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = table(spark, sf_dir, "customer").withColumn("own", own).join(proto, "c_nationkey")
    merged = F.map_concat(F.map_filter("proto", lambda k, _: ~F.map_contains_key("own", k)), "own")
    return both.select("c_custkey", merged["kind"].alias("kind"), merged["home"].alias("home"))


@query("update_from", "SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'updated' END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def update_from(spark, sf_dir):
    """Rows of a template updated from a packet by key."""
    new = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("updated").alias("new_lang"))
    both = table(spark, sf_dir, "documents").join(new, "doc_id", "left")
    return both.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("new_lang", "lang").alias("lang"))


@query("changed_values", "SELECT o_orderkey AS id, lower(o_orderstatus) AS now, lower(coalesce(l.s, 'visible')) AS before FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey WHERE lower(o_orderstatus) <> lower(coalesce(l.s, 'visible'))")
def changed_values(spark, sf_dir):
    """Values that differ from their initial ones but for case; a missing initial value is visible."""
    initial = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linestatus").alias("s"))
    now, before = F.lower("o_orderstatus"), F.lower(F.coalesce("s", F.lit("visible")))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").join(initial, "id", "left")
    return rows.select("id", now.alias("now"), before.alias("before")).where(F.col("now") != F.col("before"))


#: Labels by type, and by brand where the type has none; what a user would hold as a table of its own.
DICTIONARY = (("type", "ECONOMY", "budget"), ("brand", "Brand#3", "third"), ("brand", "Brand#4", "fourth"))


@query(
    "fallback_lookup",
    """
    WITH d AS (SELECT * FROM (VALUES ('type', 'ECONOMY', 'budget'), ('brand', 'Brand#3', 'third'), ('brand', 'Brand#4', 'fourth')) d(how, k, v))
    SELECT p_partkey, coalesce((SELECT v FROM d WHERE how = 'type' AND k = p_type), (SELECT v FROM d WHERE how = 'brand' AND k = p_brand), 'fd_' || p_name) AS label FROM part
    """,
)
def fallback_lookup(spark, sf_dir):
    """A label by type in a dictionary, else by brand, else made up; both are joins with the dictionary."""
    words = spark.createDataFrame(DICTIONARY, "how string, k string, v string")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    first = words.where("how = 'type'").select(F.col("k").alias("p_type"), F.col("v").alias("first"))
    second = words.where("how = 'brand'").select(F.col("k").alias("p_brand"), F.col("v").alias("second"))
    found = part.join(first, "p_type", "left").join(second, "p_brand", "left")
    return found.select("p_partkey", F.coalesce("first", "second", F.concat(F.lit("fd_"), "p_name")).alias("label"))


SETS = "SELECT l_orderkey AS k, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY l_orderkey"


@query(
    "best_subset_match",
    f"""
    WITH s AS ({SETS}), p AS (SELECT DISTINCT s FROM s WHERE k % 2 = 0), t AS (SELECT s, min(k) AS k FROM s WHERE k % 2 = 1 GROUP BY s),
         m AS (SELECT p.s, t.k AS type, len(list_intersect(p.s, t.s)) AS overlap, row_number() OVER (PARTITION BY p.s ORDER BY len(list_intersect(p.s, t.s)) DESC, len(t.s) DESC, t.k) AS rn FROM p, t WHERE len(list_intersect(p.s, t.s)) * 2 >= len(p.s))
    SELECT s.k AS panel, m.type, m.overlap FROM s JOIN m ON m.s = s.s AND m.rn = 1 WHERE s.k % 2 = 0
    """,
)
def best_subset_match(spark, sf_dir):
    """For each panel the type that shares most of its elements, at least half; larger types, then smaller ids, win ties.

    Panels, and types, of the same elements are matched once: pairs are distinct sets that share an element.
    """
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    panels, types = sets.where("k % 2 = 0"), sets.where("k % 2 = 1").groupBy("s").agg(F.min("k").alias("type"))
    left = panels.select("s").distinct().select("s", F.explode("s").alias("e"))
    right = types.select("type", F.size("s").alias("nt"), F.explode("s").alias("e"))
    overlap = left.join(right, "e").groupBy("s", "type", "nt").agg(F.count("*").alias("overlap")).where(F.col("overlap") * 2 >= F.size("s"))
    best = overlap.groupBy("s").agg(F.max(F.struct("overlap", "nt", (-F.col("type")).alias("low"))).alias("m"))
    return panels.join(best, "s").select(F.col("k").alias("panel"), (-F.col("m.low")).alias("type"), "m.overlap")


@query("relational_division", "SELECT l_orderkey AS row_id FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3")
def relational_division(spark, sf_dir):
    """Rows that have a field under every header."""
    headers = (1, 2, 3)
    cells = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").isin(*headers))
    return cells.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.count_distinct("l_linenumber").alias("n")).where(F.col("n") == len(headers)).select("row_id")


@query("conditional_visibility", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'panel_a' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'panel_b' ELSE 'hidden' END AS shown FROM orders")
def conditional_visibility(spark, sf_dir):
    """What each row's rules show."""
    shown = F.when(F.col("o_orderpriority") == "1-URGENT", "panel_a").when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), "panel_b").otherwise("hidden")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))


@query(
    "nearest_scope",
    """
    SELECT c_custkey AS ref, target, scope FROM (SELECT c.c_custkey, s.s_suppkey AS target, CASE WHEN s.s_nationkey = c.c_nationkey THEN 0 ELSE 1 END AS scope,
      row_number() OVER (PARTITION BY c.c_custkey ORDER BY CASE WHEN s.s_nationkey = c.c_nationkey THEN 0 ELSE 1 END, s.s_suppkey) AS rn
      FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN nation m ON n.n_regionkey = m.n_regionkey JOIN supplier s ON s.s_nationkey = m.n_nationkey) WHERE rn = 1
    """,
)
def nearest_scope(spark, sf_dir):
    """The supplier nearest in scope: of the same nation, else of the region; the smallest id first.

    Each scope is reduced to its first supplier before the join, so nothing multiplies.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    own = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("near"))
    wide = supplier.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("far"))
    scopes = nation.withColumnRenamed("n_nationkey", "c_nationkey").join(own, "c_nationkey", "left").join(wide, "n_regionkey", "left")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), "c_nationkey").join(scopes, "c_nationkey")
    found = rows.select("ref", F.coalesce("near", "far").alias("target"), F.when(F.col("near").isNotNull(), 0).otherwise(1).alias("scope"))
    return found.where("target IS NOT NULL")


@query("path_replace", "SELECT source, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'replaced' ELSE lang END AS value, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents WHERE doc_id % 10 <> 7")
def path_replace(spark, sf_dir):
    """Nodes of each source's tree replaced and removed by key in one batch, then renumbered; a node without a key has no place."""
    ensure_checkpoint_dir(spark)
    left = table(spark, sf_dir, "documents").where("doc_id % 10 <> 7")
    made = left.select("source", "doc_id", F.when(F.col("doc_id") % 10 == 3, "replaced").otherwise(F.col("lang")).alias("value"))
    return number_rows(made, ["source"], ["doc_id"], "ord").select("source", "doc_id", "value", "ord")


@query(
    "hoist_common",
    """
    WITH h AS (SELECT DISTINCT 'all' AS root, r_name AS region, n_name AS nation, c_mktsegment AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    b AS (SELECT region, count(DISTINCT nation) AS m FROM h GROUP BY region), r AS (SELECT region, v FROM h JOIN b USING (region) GROUP BY region, v, m HAVING count(*) = m),
    t AS (SELECT v FROM r GROUP BY v HAVING count(*) = (SELECT count(*) FROM b))
    SELECT 'nation' AS level, 'all/' || region || '/' || nation AS node, v AS segment FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.region = h.region AND r.v = h.v)
    UNION ALL SELECT 'region', 'all/' || region, v FROM r WHERE v NOT IN (SELECT v FROM t) UNION ALL SELECT 'root', 'all', v FROM t
    """,
)
def hoist_common(spark, sf_dir):
    """Market segments that all nations of a region have moved up to it, and those that all regions then have to the root."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    nation = table(spark, sf_dir, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "region")
    held = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("segment")).distinct().join(nation, "c_nationkey")
    return graph.hoist(held.withColumn("root", F.lit("all")), ["root", "region", "nation"], "segment")


@query("structural_hash", "SELECT md5(string_agg(role, '|' ORDER BY turn)) AS shape, count(*) AS n_turns, conv_id FROM conversations GROUP BY conv_id")
def structural_hash(spark, sf_dir):
    """A hash of a conversation's roles that ignores texts."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), "|")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(roles).alias("shape"), F.count("*").alias("n_turns"))


@query("map_merge", "SELECT c_nationkey AS k, coalesce(max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END), min(c_name)) AS label FROM customer GROUP BY c_nationkey")
def map_merge(spark, sf_dir):
    """Two label maps merged; the left one wins."""
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"))
    sides = by.agg(F.create_map(F.lit("x"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")))).alias("l"), F.create_map(F.lit("x"), F.min("c_name")).alias("r"))
    merged = F.map_zip_with("l", "r", lambda _, a, b: F.coalesce(a, b))
    return sides.select("k", merged["x"].alias("label"))


@query("merge_duplicates", "SELECT o_orderpriority || strftime(o_orderdate, ' %Y-%m-%d') AS condition, min(o_orderkey) AS first_at, list_sort(list(DISTINCT o_custkey)) AS content FROM orders GROUP BY 1")
def merge_duplicates(spark, sf_dir):
    """Conditionals with the same condition (a priority on a day) merged at the first one's place."""
    condition = F.concat("o_orderpriority", F.date_format("o_orderdate", " yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").groupBy(condition.alias("condition"))
    return rows.agg(F.min("o_orderkey").alias("first_at"), F.array_sort(F.collect_set("o_custkey")).alias("content"))


@query("unique_suffix", "SELECT p_partkey, CASE WHEN rn = 1 THEN p_brand ELSE p_brand || rn END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)")
def unique_suffix(spark, sf_dir):
    """Names made unique by the suffixes 2, 3, …"""
    ensure_checkpoint_dir(spark)
    part = number_rows(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], "k")
    return part.select("p_partkey", F.when(F.col("k") == 1, F.col("p_brand")).otherwise(F.concat("p_brand", F.col("k").cast("string"))).alias("name"))
