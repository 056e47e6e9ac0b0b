import duckdb

from quillspark.llm import chat
from quillspark.llm.queries import SQL, op6_chat_formatting


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(map(tuple, con.execute(SQL["op6_chat_formatting"]).fetchall()))
    got = sorted((r.conv_id, r.segment, r.n_turns, r.rendered) for r in op6_chat_formatting(spark, sf).collect())
    assert got == want


def test_snapshots_and_edges(spark):
    rows = []
    for n in range(1, 5):
        rows += [(n, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(n)]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(4)]  # equal to conversation 4
    rows += [(20, 0, None, None), (21, 1, "user", "t0"), (21, 0, "system", ""), (None, 0, "user", "alone"), (30, 0, "user", "x"), (30, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.format_chats(df, segment_turns=64).collect()}
    assert set(got) == {4, 20, 21, None, 30}
    assert got[4].rendered.startswith("<|user|>\nt0<|end|>\n<|assistant|>\nt1") and got[21].rendered.startswith("<|system|>")
    assert got[30].n_turns == 2
    parts = sorted((r.conv_id, r.segment, r.rendered) for r in chat.format_chats(df.where("conv_id = 4"), segment_turns=3).collect())
    assert [p[1] for p in parts] == [0, 1] and "".join(p[2] for p in parts) == got[4].rendered
    assert chat.format_chats(df.limit(0)).count() == 0


def test_one_conversation_over_many_ranges_and_blocks(spark):
    """A conversation with most of all rows, a snapshot of it, repeated turns and a null id beside small ones."""
    turns = [(k // 2, "user" if k % 3 else "assistant", f"text {k % 5}") for k in range(700)]
    rows = [(7, *t) for t in turns] + [(8, *t) for t in turns[:301]] + [(9, *t) for t in turns[:300]] + [(None, *t) for t in turns[5:]]
    rows += [(100 + k, 0, "user", f"text {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    by_id: dict = {}
    for conv, *t in rows:
        by_id.setdefault(conv, []).append(tuple(t))
    by_id = {c: sorted(t, key=lambda x: (x[0], x[1], x[2])) for c, t in by_id.items()}
    said = {c: tuple((r, x) for _, r, x in t) for c, t in by_id.items()}
    prefixes = {s[:k] for s in said.values() for k in range(1, len(s))}
    want = {c for c, s in said.items() if s not in prefixes and not any(o is not None and c is not None and o < c and said[o] == s for o in said)}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart, however small they are
        for block in (16, 4096):
            kept = {r.conv_id: r.n_turns for r in chat.collapse(df, block_turns=block).collect()}
            assert kept == {c: len(said[c]) for c in want}
        parts = sorted(chat.format_chats(df, segment_turns=10, block_turns=16).where("conv_id = 7").collect(), key=lambda r: r.segment)
        assert len({r for r in chat.dealt(df, "conv_id", "turn", "role", "text")[1].where("conv = 7").collect()}) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "".join(r.rendered for r in parts) == "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in said[7])
