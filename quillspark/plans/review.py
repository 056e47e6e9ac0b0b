"""Fidelity review: which input texts the output covers, and rule sweeps over markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.compare import contained_values, distinct_first_seen, missing_values, ratio_or_one
from quillspark.plans.registry import query
from quillspark.plans.scalars import lines
from quillspark.session import table

NORM = r"trim(regexp_replace(replace(regexp_replace({}, '<[^>]*(>|\z)', '', 'g'), '>', ''), '\s+', ' ', 'g'))"
OUTPUT = f"SELECT DISTINCT {NORM.format('l.line')} AS t FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l"
INPUT = f"""
    SELECT t, m.i AS item_id, m.n AS n FROM (SELECT t, min({{'i': item_id, 'n': n}}) AS m FROM (SELECT {NORM.format("l.line")} AS t, item_id, n FROM (
      SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark) l) WHERE t <> '' GROUP BY t)"""


def norm(column):
    return F.trim(F.regexp_replace(tx.strip_tags(column), "\\s+", " "))


def review_input(spark, sf_dir):
    """Distinct normalised non-empty lines of the items, each with the item and line where it stands first."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.select(norm(F.col("line")).alias("t"), F.struct("item_id", (F.col("n") + 1).cast("long").alias("n")).alias("at")).where("t <> ''")
    return distinct_first_seen(rows, "t", "at").select("t", "at.item_id", "at.n")


def review_output(spark, sf_dir):
    """Normalised lines of the documents."""
    return lines(spark, sf_dir).select(norm(F.col("line")).alias("t"))


@query("distinct_first_seen", INPUT)
def distinct_first_seen_query(spark, sf_dir):
    return review_input(spark, sf_dir)


@query("coverage_missing", f"SELECT item_id, n, t FROM ({INPUT}) WHERE t NOT IN ({OUTPUT}) ORDER BY item_id, n LIMIT 200")
def coverage_missing(spark, sf_dir, cap: int = 200):
    """The first input lines that no output line equals; the report lists at most ``cap``.

    Output lines are first reduced to those that are asked for, so that no others are shuffled.
    """
    wanted = review_input(spark, sf_dir)
    present = review_output(spark, sf_dir).join(wanted.select("t"), "t", "left_semi")
    return missing_values(wanted, present, "t").select("item_id", "n", "t").orderBy("item_id", "n").limit(cap)


@query(
    "coverage_containers",
    f"SELECT item_id, n, t FROM ({INPUT}) i WHERE t NOT IN ({OUTPUT}) AND NOT EXISTS (SELECT 1 FROM ({OUTPUT}) o WHERE contains(o.t, i.t))",
)
def coverage_containers(spark, sf_dir):
    """Input lines that are neither an output line nor part of one.

    The input lines are the stated query set; all of them are looked for at once where an output line is read.
    """
    wanted = review_input(spark, sf_dir)
    return wanted.join(contained_values(wanted, review_output(spark, sf_dir), "t"), "t", "left_anti").select("item_id", "n", "t")


@query(
    "review_report",
    f"""
    WITH i AS ({INPUT}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE t IN ({OUTPUT})) AS hit FROM i)
    SELECT n AS n_input, hit AS n_covered, round(CASE WHEN n = 0 THEN 1.0 ELSE hit / n END, 6)::DOUBLE AS coverage,
           (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM pages) AS n_pages FROM c
    """,
)
def review_report(spark, sf_dir):
    """Coverage and counts in one row."""
    wanted, present = review_input(spark, sf_dir), review_output(spark, sf_dir).distinct().withColumn("hit", F.lit(1))
    covered = wanted.join(present, "t", "left").agg(F.count("*").alias("n_input"), F.count("hit").alias("n_covered"))
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_documents"))
    pages = table(spark, sf_dir, "pages").agg(F.count("*").alias("n_pages"))
    one = covered.crossJoin(docs).crossJoin(pages)  # three rows of one aggregate each
    return one.select("n_input", "n_covered", F.round(ratio_or_one(F.col("n_covered"), F.col("n_input")), 6).alias("coverage"), "n_documents", "n_pages")


@query(
    "review_with_fallback",
    "SELECT source, doc_id, lang FROM documents d WHERE lang = 'de' OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang = 'de')",
)
def review_with_fallback(spark, sf_dir):
    """Bodies in the master language, and all bodies of sources without one."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    master = docs.where("lang = 'de'")
    return master.unionByName(docs.join(master.select("source").distinct(), "source", "left_anti"))


@query(
    "rule_sweep",
    """
    SELECT 'script' AS rule, page_id FROM pages WHERE contains(html, '<script') UNION ALL SELECT 'no_lang', page_id FROM pages WHERE NOT regexp_matches(html, '<html[^>]* lang=')
    UNION ALL SELECT 'comment', page_id FROM pages WHERE contains(html, '<!--') UNION ALL SELECT 'double_h1', page_id FROM pages WHERE len(regexp_extract_all(html, '<h1[ >]')) > 1
    """,
)
def rule_sweep(spark, sf_dir):
    """One row per rule and page that breaks it, in one scan."""
    rules = F.array(
        F.when(F.contains("html", F.lit("<script")), "script"),
        F.when(~F.col("html").rlike("<html[^>]* lang="), "no_lang"),
        F.when(F.contains("html", F.lit("<!--")), "comment"),
        F.when(F.size(F.regexp_extract_all("html", F.lit("<h1[ >]"), F.lit(0))) > 1, "double_h1"),
    )
    return table(spark, sf_dir, "pages").select(F.explode(F.array_compact(rules)).alias("rule"), "page_id")


#: Prefix that the names of a kind must have; kinds without one have raw names.
PREFIXES = (("MEDIUM", "Brand#1"), ("LARGE", "Brand#2"), ("PROMO", "Brand#1"))


@query(
    "naming_bucket",
    """
    SELECT p_partkey, CASE WHEN r.t IS NULL THEN 'raw' WHEN r.t = p_brand[1:7] THEN 'ok' ELSE 'wrong_prefix' END AS bucket
    FROM part LEFT JOIN (VALUES ('MEDIUM', 'Brand#1'), ('LARGE', 'Brand#2'), ('PROMO', 'Brand#1')) r(kind, t) ON r.kind = p_type
    """,
)
def naming_bucket(spark, sf_dir):
    """Names against a table of the prefix of each kind: ok, wrong prefix, or raw where the kind has none."""
    rules = spark.createDataFrame(PREFIXES, "kind string, t string")
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("own"), F.col("p_type").alias("kind"))
    bucket = F.when(F.col("t").isNull(), "raw").when(F.col("t") == F.col("own"), "ok").otherwise("wrong_prefix")
    return part.join(rules, "kind", "left").select("p_partkey", bucket.alias("bucket"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "label_issue",
    rf"""SELECT page_id, CASE WHEN t = '' THEN 'missing' WHEN regexp_matches(t, '^\(.*\)$') THEN 'parenthetical' WHEN contains(t, '&lt;') AND contains(t, '&gt;') THEN 'markup' WHEN contains(t, '"') THEN 'quoted' ELSE 'fine' END AS issue FROM (SELECT page_id, {TITLE} AS t FROM pages)""",
)
def label_issue(spark, sf_dir):
    """What is wrong with a title, by the first rule it meets."""
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    issue = F.when(t == "", "missing").when(t.rlike("^\\(.*\\)$"), "parenthetical").when(F.contains(t, F.lit("&lt;")) & F.contains(t, F.lit("&gt;")), "markup").when(F.contains(t, F.lit('"')), "quoted")
    return table(spark, sf_dir, "pages").select("page_id", issue.otherwise("fine").alias("issue"))


@query("tag_counts", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY ALL")
def tag_counts(spark, sf_dir):
    """Open tags of each page."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >/]"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "duplicate_attrs",
    """
    SELECT page_id, attr, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '([a-z]+="[^"]*")', 1)) AS attr FROM pages) GROUP BY ALL HAVING count(*) > 1
    """,
)
def duplicate_attrs(spark, sf_dir):
    """Attributes that a page gives more than once with the same value."""
    attrs = F.regexp_extract_all("html", F.lit('([a-z]+="[^"]*")'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(attrs).alias("attr")).groupBy("page_id", "attr").agg(F.count("*").alias("n")).where("n > 1")


@query("extract_references", "SELECT page_id, ref FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS ref FROM pages)")
def extract_references(spark, sf_dir):
    """Distinct link targets of each page."""
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(refs).alias("ref"))
