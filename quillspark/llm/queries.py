"""Named queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillspark.llm import chat, decontaminate, divergence, langid, licenses, near_dedup, packing, pii, quality, token_counts, toxicity, vector_codes, warc
from quillspark.llm.common import documents, fold_mod

QUERIES, SQL = {}, {}
VOCABULARY = "word_bpe_49k.json"


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


@query("op1_packing")
def op1_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(VOCABULARY), 2048)


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    """Token counts of all documents by a digest cache that starts empty."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    docs = documents(spark, sf_dir).select("doc_id", "text", size.alias("n_bytes"))  # measured here, so that no text follows its key
    counted = token_counts.count_tokens(docs, "text", public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op2_pii")
def op2_pii(spark, sf_dir):
    """Personal data of all documents, with digests of the base spans."""
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii_spans")
    base = [k.name for k in pii.KINDS if k.base]
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    base_spans = F.filter("pii_spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(pii.joined(base_spans), 256).alias("base_sha256"),
        pii.joined(F.col("pii_spans")).alias("spans"),
        *[count(k.name).alias(f"n_{k.name}") for k in pii.KINDS if not k.base],
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    """Quality statistics of all documents and the verdict of the learned decision list."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels")
    judged, _ = quality.judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query(
    "op5_minhash_dedup",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
    SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id
    """,
)
def op5_minhash_dedup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the best window."""
    return decontaminate.find_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    """Toxicity of all documents; learned from labels whose id is not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), ~fold_mod(F.col("doc_id"), 5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold_mod(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    """Language of all documents; learned from documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs, ~fold_mod(F.col("doc_id"), 4, 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold_mod(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query(
    "op8_warc",
    """
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
    FROM pages
    """,
)
def op8_warc(spark, sf_dir):
    """All pages written to archives in ZIP packages and read back."""
    read = warc.round_trip(documents(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op6_chat_formatting",
    """
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations
    ), prefix AS (
      SELECT conv_id, place, string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY place) AS p,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t
    ), whole AS (
      SELECT p, n, min(conv_id) AS conv_id FROM prefix WHERE place = n GROUP BY p, n
    ), kept AS (
      SELECT w.conv_id, w.n FROM whole w WHERE w.p NOT IN (SELECT p FROM prefix WHERE place < n)
    )
    SELECT t.conv_id, CAST((place - 1) // 64 AS INT) AS segment, CAST(k.n AS INT) AS n_turns,
           string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
    FROM t JOIN kept k ON t.conv_id = k.conv_id GROUP BY ALL
    """,
)
def op6_chat_formatting(spark, sf_dir):
    """Maximal conversations rendered with the chat template."""
    return chat.format_chats(documents(spark, sf_dir, "conversations"))


@query("op13_license_scans")
def op13_license_scans(spark, sf_dir):
    """License phrases and signatures of all documents; the score is the confidence of the surest detection left."""
    scanned = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base, kept = F.col("license_scan.base"), F.col("license_scan.detections")
    base_labels = F.transform(base, lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        "license_scan.n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["last"])).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform(kept, lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(kept, lambda d: F.concat_ws(":", d["label"], d["start"], d["end"])), ",").alias("detections"),
    )


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    own AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    p AS MATERIALIZED (SELECT own.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p FROM own JOIN v ON own.lang = v.lang),
    al AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
    q AS (SELECT al.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM al JOIN v ON al.lang = v.lang),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50
    """,
)
def op12_source_divergence(spark, sf_dir):
    """Divergence of the sources of each language, and the terms that set each of them apart."""
    return divergence.audit(documents(spark, sf_dir).select("lang", "source", "text"))


def vector_code_sql(rounds: int = 6) -> str:
    """SQL of the product codes: one pair of tables for each round, all distances measured."""
    steps = [
        """
        v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, label, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS x FROM v, range(8) t(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS b FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))
        """
    ]
    assign = """
        a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(k, d * 16 + k) AS k, min(d) AS d
             FROM (SELECT vec_id, label, x.p, x, k, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} ON x.p = b{r}.p) GROUP BY vec_id, label, p, x)
        """
    move = """
        s{r} AS (SELECT p, k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 1 + (SELECT max(len(b)) FROM b0)) t(j) GROUP BY p, k, j),
        m{r} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS b FROM s{r} GROUP BY p, k),
        b{next} AS MATERIALIZED (SELECT p, k, coalesce(m.b, o.b) AS b FROM b{r} o LEFT JOIN m{r} m USING (p, k))
        """
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, next=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""
        WITH {','.join(steps)},
        c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, k)) AS h FROM b{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM c, h
        """


@query("op11_vector_codes", vector_code_sql())
def op11_vector_codes(spark, sf_dir):
    """Product codes of all vectors, with their errors and those of their labels."""
    coded = vector_codes.compress(documents(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
