import hashlib
import io
import json
import zipfile

import duckdb
import pytest

from quillspark.llm import warc
from quillspark.llm.queries import SQL, op8_warc


@pytest.mark.parametrize("force64", [False, True])
def test_package_is_a_zip_and_reads_by_ranges(force64):
    raw = warc.in_memory([(1, "http://a", b"x" * 10), (None, "", "é".encode())], force64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]
    members = warc.read_directory(lambda a, n: raw[a : a + n], len(raw))
    data = members[0]
    places = list(warc.walk_records(raw[data.at : data.at + data.size]))
    got = [warc.parse_record(raw[data.at + a : data.at + a + n]) for a, n in places]
    assert [p for _, p in got] == [b"x" * 10, "é".encode()]
    assert got[0][0]["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(b"x" * 10).hexdigest()


def test_foreign_zip_with_comment():
    with zipfile.ZipFile(b := io.BytesIO(), "w", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/i", b"abc")
        z.comment = b"note"
    raw = b.getvalue()
    m = warc.read_directory(lambda a, n: raw[a : a + n], len(raw))[0]
    assert raw[m.at : m.at + m.size] == b"abc"
    with pytest.raises(ValueError):
        warc.read_directory(lambda a, n: b"", 0)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(tuple, con.execute(SQL["op8_warc"]).fetchall()))
    assert sorted(map(tuple, op8_warc(spark, sf).collect())) == want


def test_edges(spark):
    long = "z" * 1500
    rows = [(1, "u", long), (2, "u", long), (3, None, None), (4, "u", ""), (None, "u\nv", long), (5, "u", "é" * 400), (6, "u", "é" * 400), (1, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.round_trip(pages).collect()}
    assert (1, 1500, "revisit", 2, b"") in got and (2, 1500, "response", None, long.encode()) in got
    assert (3, 0, "response", None, b"") in got and (5, 800, "response", None, ("é" * 400).encode()) in got
    assert warc.round_trip(pages).count() == 8 and warc.round_trip(pages.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_payloads(spark, monkeypatch):
    a, b = "a" * 1500, "b" * 1500
    pages = spark.createDataFrame([(1, "u", a), (2, "u", a), (1, "u", b)], "page_id long, url string, html string")
    want = {(1, "revisit", 2, b""), (2, "response", None, a.encode()), (1, "response", None, b.encode())}
    for most in (50_000, 0):  # revisits broadcast and shuffled
        monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
        assert {(r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.round_trip(pages).collect()} == want


def test_addresses_round_trip(spark):
    urls = [None, "", "http://a.example/x y?q=1#f", "u\nv", "u\r\nWARC-Type: x", "é://ü", "http://[broken"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS html", "1 AS n_bytes", "2 AS digest", "3 AS refers_to")
    assert {r.page_id: r.url for r in warc.round_trip(pages).collect()} == dict(enumerate(urls))


def test_index_and_walk_find_the_same_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_RECORDS", 7)
    pages = [(k, f"http://h{k % 5}.example/{k}", bytes([65 + k % 26]) * (k * 37)) for k in range(60)]
    raw = warc.in_memory(pages)
    at = lambda a, n: raw[a : a + n]
    data, index = warc.read_directory(at, len(raw))
    lines = at(index.at, index.size).splitlines()
    assert lines == sorted(lines) and lines[0].startswith(b"example,h0)/0 ")
    walked = sorted(warc.walk_ranges(lambda a, n: at(data.at + a, n), data.size))
    assert walked == sorted((f["offset"], f["length"]) for f in (json.loads(x[x.index(b"{") :]) for x in lines))
    df = spark.createDataFrame([(k, u, p.decode()) for k, u, p in pages], "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "packages")
    got = warc.read_packages(spark, warc.write_packages(df, folder), folder).collect()
    assert {(r.page_id, r.url, r.payload_bytes) for r in got} == {(k, u, len(p)) for k, u, p in pages} and len(got) == 60


def test_very_long_payload(spark):
    text = "long é " * 3_000_000
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.payload_digest) for r in warc.round_trip(pages).drop("payload").collect()}
    digest = hashlib.sha1(text.encode()).hexdigest()
    assert got == {1: (len(text.encode()), "revisit", digest), 2: (len(text.encode()), "response", digest)}


def test_stores_by_their_spark_names_and_out_of_reach(spark):
    try:
        system, path = warc._filesystem("s3a://bucket/folder")
        assert system.type_name == "s3" and path == "bucket/folder"
    except ValueError as error:  # an Arrow without that store says so
        assert "s3a" in str(error)
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(ValueError, match="cannot be kept in nosuch://"):
        warc.write_packages(pages, "nosuch://host/folder")
