"""Scalar functions over documents, pages, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import geometry as geo
from quillspark.functions import text as tx
from quillspark.plans.registry import query
from quillspark.session import table


@query("text_normalize", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^>]*(>|\z)', '', 'g'), '>', ''), '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM pages")
def text_normalize(spark, sf_dir):
    """Visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.normalize(F.col("html"))).alias("norm"))


@query(
    "html_text_runs",
    r"""
    SELECT page_id, len(runs) AS n_runs, md5(array_to_string(runs, '|')) AS runs FROM (
      SELECT page_id, list_filter(string_split_regex(html, '<[^>]*>'), lambda r: trim(regexp_replace(r, '\s+', ' ', 'g')) <> '') AS runs FROM pages)
    """,
)
def html_text_runs(spark, sf_dir):
    """Untrimmed text runs between tags."""
    runs = table(spark, sf_dir, "pages").select("page_id", tx.html_text_runs(F.col("html")).alias("r"))
    return runs.select("page_id", F.size("r").cast("long").alias("n_runs"), F.md5(F.array_join("r", "|")).alias("runs"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.escape_html(F.col("html"))).alias("escaped"))


@query(
    "sql_quote",
    r"""
    SELECT doc_id, md5(CASE WHEN contains(text, '\') OR contains(text, chr(9)) OR contains(text, chr(10)) OR contains(text, chr(13))
      THEN 'e''' || replace(replace(replace(replace(replace(text, '''', ''''''), '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') || ''''
      ELSE '''' || replace(text, '''', '''''') || '''' END) AS literal FROM documents
    """,
)
def sql_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.sql_quote(F.col("text"))).alias("literal"))


@query(
    "render_insert_sql",
    r"""SELECT r_regionkey, 'INSERT INTO region (id, name) VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' AS statement FROM region""",
)
def render_insert_sql(spark, sf_dir):
    """INSERT statements of a small table."""
    values = F.format_string("INSERT INTO region (id, name) VALUES (%s, %s);", F.col("r_regionkey").cast("string"), tx.sql_quote(F.col("r_name")))
    return table(spark, sf_dir, "region").select("r_regionkey", values.alias("statement"))


@query(
    "search_snippet",
    """
    SELECT doc_id, trim(replace(substr(text, greatest(instr(lower(text), 'the') - 40, 1), 160), chr(10), ' ')) AS snippet
    FROM documents WHERE contains(lower(text), 'the')
    """,
)
def search_snippet(spark, sf_dir):
    """What surrounds the first hit of a word."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return docs.select("doc_id", tx.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query("grep_literal", "SELECT doc_id, instr(lower(text), 'license') AS first_at FROM documents WHERE contains(lower(text), 'license')")
def grep_literal(spark, sf_dir):
    """Case-insensitive literal search."""
    at = F.instr(F.lower("text"), F.lit("license")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", at.alias("first_at")).where("first_at > 0")


@query("grep_regex", "SELECT doc_id, regexp_extract(text, '[A-Z]{3,} [a-z]+', 0) AS hit FROM documents WHERE regexp_matches(text, '[A-Z]{3,} [a-z]+')")
def grep_regex(spark, sf_dir):
    """Case-sensitive pattern search."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Z]{3,} [a-z]+"))
    return docs.select("doc_id", F.regexp_extract("text", "[A-Z]{3,} [a-z]+", 0).alias("hit"))


@query(
    "contact_classify",
    """
    WITH p AS (SELECT page_id, lower(CASE WHEN trim(l) = '' THEN url ELSE l END) AS probe FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS l FROM pages))
    SELECT page_id, CASE WHEN regexp_matches(probe, 'e-?mail|courriel|correo') THEN 'email' WHEN regexp_matches(probe, 'privat|mobiltel') THEN 'none'
      WHEN regexp_matches(probe, 'tel|phone|fax|mobil') THEN 'phone' ELSE 'none' END AS kind FROM p
    """,
)
def contact_classify(spark, sf_dir):
    """Contact kind by title, else by address."""
    label = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", tx.contact_kind(label, F.col("url")).alias("kind"))


@query("inline_date_extract", r"SELECT doc_id, regexp_extract(text, '\d{1,2}\.\s*\.\s*\d*', 0) AS date_blank FROM documents")
def inline_date_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.inline_date(F.col("text")).alias("date_blank"))


@query(
    "date_placeholder",
    r"""
    SELECT event_id, regexp_matches(lower(trim(w)), '^(dd?|tt?|mm?|yyyy|yy?|jjjj|jj?|[0-9]{1,4})[./-] ?(dd?|tt?|mm?|yyyy|yy?|jjjj|jj?|[0-9]{1,4})[./-] ?(dd?|tt?|mm?|yyyy|yy?|jjjj|jj?|[0-9]{1,4})[./-]?$') AS placeholder
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE event_type END AS w FROM events)
    """,
)
def date_placeholder(spark, sf_dir):
    shown = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", tx.is_date_placeholder(shown).alias("placeholder"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents"


def lines(spark, sf_dir):
    """(doc_id, n from 1, line) of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("n"), "line")


@query(
    "list_marker",
    rf"""
    SELECT doc_id, kind, count(*) AS n_lines FROM (SELECT doc_id, CASE WHEN regexp_matches(line, '^[-•–*] ') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]{{1,2}}(\.[0-9]{{1,2}}){{1,3}}\.? ') THEN 'multilevel'
      WHEN regexp_matches(line, '^[0-9]{{1,3}}[.)] ') THEN 'numeric' WHEN regexp_matches(line, '^\(([ivxlc]+|[IVXLC]+)\) ') THEN 'paren_roman' WHEN regexp_matches(line, '^\([A-Za-z0-9]\) ') THEN 'paren'
      WHEN regexp_matches(line, '^([ivxlc]{{2,}}|[IVXLC]{{2,}})[.)] ') THEN 'roman' WHEN regexp_matches(line, '^[A-Za-z][.)] ') THEN 'letter' ELSE 'none' END AS kind FROM ({LINES})) GROUP BY ALL
    """,
)
def list_marker(spark, sf_dir):
    """Lines by kind of list marker."""
    return lines(spark, sf_dir).groupBy("doc_id", tx.list_marker(F.col("line")).alias("kind")).agg(F.count("*").alias("n_lines"))


@query("numeric_prefix", f"SELECT doc_id, n, regexp_extract(line, '^[0-9]+[.)]', 0) AS prefix FROM ({LINES}) WHERE regexp_matches(line, '^[0-9]')")
def numeric_prefix(spark, sf_dir):
    found = lines(spark, sf_dir).where(F.col("line").rlike("^[0-9]"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), tx.numeric_prefix(F.col("line")).alias("prefix"))


@query("placeholder_lines", rf"SELECT doc_id, count(*) AS n_lines FROM ({LINES}) WHERE regexp_matches(trim(line), '^[._…\-–—]{{3,}}$') OR line = '' GROUP BY doc_id")
def placeholder_lines(spark, sf_dir):
    """Blank or fill-character lines of each document."""
    return lines(spark, sf_dir).where(tx.is_placeholder(F.col("line")) | (F.col("line") == "")).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("line_slice", f"SELECT doc_id, n, line FROM ({LINES}) WHERE n > 1 AND n <= 4")
def line_slice(spark, sf_dir, offset: int = 1, limit: int = 3):
    """Lines after ``offset``; a limit of 0 has no end."""
    rows = lines(spark, sf_dir).where(F.col("n") > offset)
    rows = rows.where(F.col("n") <= offset + limit) if limit else rows
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "line")


@query("to_snake_case", "SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'unknown' ELSE lower(array_to_string(w, '_')) END AS snake FROM (SELECT p_partkey, list_filter(string_split_regex(p_type, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM part)")
def to_snake_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.snake_case(F.col("p_type")).alias("snake"))


@query(
    "to_pascal_case",
    """
    SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'Unknown' ELSE array_to_string(list_transform(w, lambda x: CASE WHEN x = upper(x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), '') END AS pascal
    FROM (SELECT p_partkey, list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM part)
    """,
)
def to_pascal_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.pascal_case(F.col("p_name")).alias("pascal"))


@query("name_prefix", "SELECT event_id, split_part(replace(event_type || '_' || user_id, '-', '_'), '_', 1) AS prefix FROM events")
def name_prefix(spark, sf_dir):
    name = F.replace(F.concat_ws("_", "event_type", "user_id"), F.lit("-"), F.lit("_"))
    return table(spark, sf_dir, "events").select("event_id", tx.name_prefix(name).alias("prefix"))


@query("strip_lang_suffix", "SELECT doc_id, regexp_replace(source || '_' || lang, '_(DE|EN|FR|IT|ES|de|en|fr|it|es)$', '') AS form FROM documents")
def strip_lang_suffix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_lang_suffix(F.concat_ws("_", "source", "lang")).alias("form"))


@query(
    "dimension_parse",
    """
    SELECT p_partkey, round(p_size::DOUBLE * CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 72.0 WHEN 2 THEN 2.834645669291339 ELSE 28.34645669291339 END, 6)::DOUBLE AS points FROM part
    """,
)
def dimension_parse(spark, sf_dir):
    """Lengths with units in points."""
    unit = F.element_at(F.array(*map(F.lit, ("", "in", "mm", "cm"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.dimension_points(F.concat(F.col("p_size").cast("string"), unit)), 6).alias("points"))


@query("format_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, strftime(date_trunc('day', ts) + INTERVAL 30 DAY, '%Y-%m-%d') AS due FROM events")
def format_ts(spark, sf_dir):
    """Time stamps to the minute, and a date 30 days on."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"), F.date_format(F.date_add(F.to_date("ts"), 30), "yyyy-MM-dd").alias("due"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("to_json_rows", "SELECT r_regionkey, '{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS json FROM region")
def to_json_rows(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("json"))


@query(
    "map_fallback",
    """
    SELECT source, coalesce(max(CASE WHEN lang = 'it' THEN md5(text) END), arg_min(md5(text), doc_id)) AS chosen FROM documents GROUP BY source
    """,
)
def map_fallback(spark, sf_dir):
    """A source's text in the wished language, else any (the first)."""
    by = table(spark, sf_dir, "documents").groupBy("source")
    wished = F.max(F.when(F.col("lang") == "it", F.md5("text")))
    return by.agg(F.coalesce(wished, F.min_by(F.md5("text"), "doc_id")).alias("chosen"))


@query("b64", "SELECT p_partkey, base64(encode(p_name)) AS encoded FROM part")
def b64(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("encoded"))


@query("template_render", "SELECT c_custkey, 'Dear ' || c_name || ', your balance is ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '.' AS letter FROM customer")
def template_render(spark, sf_dir):
    """{{name}} slots of a template filled from columns."""
    slots = {"name": F.col("c_name"), "balance": F.floor("c_acctbal").cast("string")}
    out = F.lit("Dear {{name}}, your balance is {{balance}}.")
    for slot, value in slots.items():
        out = F.replace(out, F.lit("{{" + slot + "}}"), value)
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("letter"))


@query("bitmask_filter", "SELECT p_partkey FROM part WHERE (p_size & 5) <> 0 AND (p_partkey & 3) <> 0")
def bitmask_filter(spark, sf_dir):
    """Rows whose target and scope bits both meet a mask."""
    part = table(spark, sf_dir, "part")
    return part.where((F.col("p_size").bitwiseAND(5) != 0) & (F.col("p_partkey").bitwiseAND(3) != 0)).select("p_partkey")


@query("token_estimate", "SELECT conv_id, CAST(sum(length(role) + length(text) + 20) AS BIGINT) // 4 AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, sf_dir):
    """Serialised length of a conversation over four."""
    size = F.sum(F.length("role") + F.length("text") + 20)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.floor(size / 4).cast("long").alias("tokens"))


@query("phase_order", "SELECT event_type AS phase, count(*) AS n, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 4 END AS rank FROM events GROUP BY event_type ORDER BY rank, phase")
def phase_order(spark, sf_dir):
    """Event kinds in a fixed order, others last."""
    rank = F.when(F.col("phase") == "view", 0).when(F.col("phase") == "click", 1).when(F.col("phase") == "purchase", 2).otherwise(4)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n")).withColumn("rank", rank).orderBy("rank", "phase")


@query(
    "text_shape",
    r"""
    WITH s AS (SELECT conv_id, turn, length(regexp_replace(text, '\s+', '', 'g')) AS chars, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS punct FROM conversations)
    SELECT a.conv_id, a.turn, CASE WHEN a.chars = 0 AND b.chars = 0 THEN true WHEN a.chars = 0 OR b.chars = 0 THEN false ELSE
      greatest(a.chars, b.chars) <= least(a.chars, b.chars) * (CASE WHEN greatest(a.chars, b.chars) <= 32 THEN 3.5 ELSE 2.2 END)
      AND greatest(a.words, b.words) <= least(a.words, b.words) * (CASE WHEN least(a.words, b.words) <= 1 THEN 4.0 ELSE 2.5 END)
      AND abs(a.digits - b.digits) <= 3 AND abs(a.punct - b.punct) <= 8 END AS compatible
    FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    """,
)
def text_shape(spark, sf_dir):
    """Whether a turn and the next have compatible shapes (lengths, words, digits, punctuation)."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    shape = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.regexp_replace("text", "\\s+", "")).alias("chars"), count("[A-Za-z0-9]+").alias("words"), count("[0-9]").alias("digits"), count("[!-/:-@\\[-`{-~]").alias("punct"))
    nxt = shape.select("conv_id", (F.col("turn") - 1).alias("turn"), *[F.col(c).alias(f"{c}2") for c in ("chars", "words", "digits", "punct")])
    both = shape.join(nxt, ["conv_id", "turn"])
    high, low = (lambda c: F.greatest(c, f"{c}2")), (lambda c: F.least(c, f"{c}2"))
    ok = (high("chars") <= low("chars") * F.when(high("chars") <= 32, 3.5).otherwise(2.2)) & (high("words") <= low("words") * F.when(low("words") <= 1, 4.0).otherwise(2.5))
    ok = ok & (F.abs(F.col("digits") - F.col("digits2")) <= 3) & (F.abs(F.col("punct") - F.col("punct2")) <= 8)
    return both.select("conv_id", "turn", F.when(high("chars") == 0, True).when(low("chars") == 0, False).otherwise(ok).alias("compatible"))


@query("html_fragment", "SELECT conv_id, md5(string_agg('<p class=\"' || role || '\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>', '' ORDER BY turn)) AS html FROM conversations GROUP BY conv_id")
def html_fragment(spark, sf_dir):
    """Conversations as HTML paragraphs."""
    p = F.concat(F.lit('<p class="'), F.col("role"), F.lit('">'), tx.escape_html(F.col("text")), F.lit("</p>"))
    parts = F.array_sort(F.collect_list(F.struct("turn", p.alias("p"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["p"]), "")).alias("html"))


@query("dot_edges", "SELECT r.r_name AS source, n.n_name AS target, '\"' || r.r_name || '\" -> \"' || n.n_name || '\";' AS edge FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def dot_edges(spark, sf_dir):
    """Graph edges in DOT."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("source"))
    both = table(spark, sf_dir, "nation").join(region, "n_regionkey").withColumnRenamed("n_name", "target")
    return both.select("source", "target", F.format_string('"%s" -> "%s";', "source", "target").alias("edge"))


@query("xml_attr_scan", """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, 'href="[^"]*"')) AS n_links FROM pages""")
def xml_attr_scan(spark, sf_dir):
    """Attributes of a page's elements."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).cast("long").alias("n_links"))


@query("array_exists", "SELECT page_id, list_contains(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1), 'table') AS has_table FROM pages")
def array_exists(spark, sf_dir):
    """Whether a page's tags hold a given one."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.exists(tags, lambda t: t == "table").alias("has_table"))


@query(
    "single_sentence_lines",
    rf"""
    WITH b AS (SELECT doc_id, trim(line) AS t, regexp_replace(regexp_replace(regexp_replace(trim(line), '^\p{{L}}{{1,4}}\.', ''), '([0-9])[.!?]', '\1,', 'g'), '[.!?]([0-9])', ',\1', 'g') AS b FROM ({LINES}))
    SELECT doc_id, count(*) AS n_lines FROM b WHERE t <> '' AND CASE len(regexp_extract_all(b, '[.!?]')) WHEN 0 THEN true WHEN 1 THEN regexp_matches(b, '[.!?]\z')
      ELSE NOT regexp_matches(b, '(?s)[.!?]\s*\p{{Lu}}+([!?]|[^.\p{{Lu}}].*[.!?])') END GROUP BY doc_id
    """,
)
def single_sentence_lines(spark, sf_dir):
    """Lines of each document that hold at most one sentence."""
    return lines(spark, sf_dir).where(tx.is_single_sentence(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


PASCAL = "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_type || ' ' || p_brand, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN x = upper(x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), '') AS s FROM part"


@query("truncate_name", f"SELECT p_partkey, CASE WHEN length(s) <= 9 THEN s WHEN regexp_matches(s[1:9], '^.+[A-Z]') THEN regexp_extract(s[1:9], '^(.+)[A-Z]', 1) ELSE s[1:9] END AS short FROM ({PASCAL})")
def truncate_name(spark, sf_dir, most: int = 9):
    """Camel-case names cut at a word."""
    name = tx.pascal_case(F.concat_ws(" ", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.truncate_camel(name, most).alias("short"))


@query("ink_to_rgb", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round((1 - {v}::DOUBLE) * (1 - l_tax::DOUBLE), 6) AS {n}" for v, n in (("l_discount", "red"), ("(l_discount / 2)", "green"), ("(l_tax * 2)", "blue"))) + " FROM lineitem")
def ink_to_rgb(spark, sf_dir):
    """Colours of four inks as red, green and blue."""
    c, k = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    colours = [F.round(v, 6).alias(n) for v, n in zip(geo.rgb(c, c / 2, k * 2, k), ("red", "green", "blue"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *colours)
