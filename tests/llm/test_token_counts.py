import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import token_counts
from quillspark.llm.queries import op10_token_counts
from quillspark.llm.tokenization import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK, OWN = Tokenizer.from_file(PATH), Encoder(PATH, entries=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aBé'ſßİΣ \t\n.,!123<|endoftxsar>²ñ", max_size=80)), max_size=6))
def test_ids_equal_the_library(texts):
    texts = [*texts, "x<|endoftext|>y <|startoftext|>", "It's we'RE 'S ''s rock'n'roll"]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in OWN.encode(texts)] == want
    assert OWN.counts(texts).tolist() == [len(x) for x in want]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_token_counts(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(TOK.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def test_cache_and_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (None, "a  b\n", b"x"), (3, " a b", b"x"), (3, " a b", b"x")], "doc_id long, text string, digest binary")
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds everything stored
        got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.digest)) for r in token_counts.count_tokens(docs, "text", PATH, cache).collect())
        assert got == [(0, 2, b"x"), (1, 0, b"x"), (2, 0, b"x"), (3, 2, b"x"), (3, 2, b"x")]
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(docs.limit(0), "text", PATH).count() == 0


def test_sentencepiece_vocabulary(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello  world", "héé\n x", "", "Hello  world"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, "text", path).collect()}
    assert got == {k: len(model.encode(t)) for k, t in enumerate(texts)}


def test_white_space_that_counts_is_not_collapsed(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a  b\n\n c", "a b c", "a  b\n\n c", " a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, "text", path).collect()}
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_misses_broadcast_or_shuffled(spark, monkeypatch):
    texts = [f"text {k % 40} again" for k in range(120)] + ["long word " * 200_000]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, _digest string, Digest string")
    want = {k: len(TOK.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    for most in (20_000, 0):
        monkeypatch.setattr(token_counts, "BROADCAST_MISSES", most)
        out = token_counts.count_tokens(docs, "text", PATH)
        assert {r.doc_id: r.n_tokens for r in out.collect()} == want and {*docs.columns} < {*out.columns}
        assert {(r._digest, r.Digest) for r in out.collect()} == {("x", "y")}
