"""Web archives in ZIP packages: WARC records written to, and range-read from, stored ZIP members.

Each task writes packages of a bounded size: a stored member with gzip-compressed WARC records, one gzip member each, and
a stored CDXJ index member, in the order of its keys, that gives each record's place. Packages get a classic or a ZIP64
directory as their size asks. The reader opens a package, parses the end record, its ZIP64 form and the central
directory, finds the members' bytes, reads its own range of the index and the records by ranges; nothing is extracted.
Without an index it walks the archive member.

Of pages with the same payload of at least ``LEAST_BYTES`` bytes, the one with the largest id is stored as a response and
the others are revisits without a payload; rows that share an id but not the payload are told apart by its digest. A null
payload is empty. Repeated rows are written once each, all as responses where the id is the largest; a null id is written
as an empty record id, a null address as none, and both read back as null. Addresses with line ends are written in base64
in a header of their own. A payload of any length is one record, held once by its task. Only the named columns are read,
so other columns may have any names. An empty table writes no package and reads back empty. Task attempts write files of
their own names, and only the files in the manifest that Spark commits are read.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, shared_dir, small_batches

LEAST_BYTES = 1000
#: A task starts a new package after so many bytes.
PACKAGE_BYTES = 1 << 28
#: Records that one reading task reads at a time, and most partitions of reads.
READ_RECORDS, READ_PARTITIONS = 2_000, 20_000
#: Up to so many revisits (under 100 bytes each) are broadcast to the payloads; more are joined by a shuffle.
BROADCAST_REVISITS = 50_000
#: Bytes that a walk without an index reads at a time.
WALK_BYTES = 1 << 16
ENCODED_URI = "X-Target-URI-Base64"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


class PackageWriter:
    """A ZIP file of stored members, written front to back to a stream; ``force64`` always writes ZIP64 records."""

    def __init__(self, stream, force64: bool = False):
        self.stream, self.force64, self.at, self.members = stream, force64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Start a member whose size and checksum follow in a data descriptor."""
        raw = name.encode()
        self.now = {"name": raw, "at": self.at, "crc": 0, "size": 0}
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        self.now["data"] = self.at

    def write(self, data: bytes) -> int:
        """Append to the member; returns the offset in it."""
        offset = self.now["size"]
        self.now["crc"] = zlib.crc32(data, self.now["crc"])
        self.now["size"] += len(data)
        self._put(data)
        return offset

    def end(self) -> None:
        m = self.now
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            wide = self.force64 or max(m["size"], m["at"]) >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["at"]) if wide else b""
            size, at = (MAX32, MAX32) if wide else (m["size"], m["at"])
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or max(size, start) >= MAX32 or n >= MAX16:
            here = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", LOCATOR, 0, here, 1))
            size, start, n = MAX32, MAX32, MAX16
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, start, 0))


@dataclass(frozen=True)
class Member:
    """Name, first data byte and stored size of a member."""

    name: str
    at: int
    size: int


def read_directory(read_at, length: int) -> list[Member]:
    """Members of a ZIP file of ``length`` bytes, through ``read_at(offset, size)``; only stored ones are allowed."""
    tail_at = max(0, length - 22 - MAX16)
    tail = read_at(tail_at, length - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, size, start, _ = struct.unpack_from("<4sHHHHIIH", tail, end)
    if n == MAX16 or size == MAX32 or start == MAX32:
        where = tail_at + end - 20
        mark, _, at64, _ = struct.unpack("<4sIQI", read_at(where, 20))
        if mark == LOCATOR:
            mark, _, _, _, _, _, _, n, size, start = struct.unpack("<4sQHHIIQQQQ", read_at(at64, 56))
            if mark != END64:
                raise ValueError("the ZIP64 end record is missing")
    table, p, out = read_at(start, size), 0, []
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, plain, ln, le, lc, _, _, _, at = struct.unpack_from("<4sHHHHHHIIIHHHHHII", table, p)
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name, extra = table[p + 46 : p + 46 + ln].decode(), table[p + 46 + ln : p + 46 + ln + le]
        p += 46 + ln + le + lc
        e = 0
        while e + 4 <= len(extra):
            kind, held = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64 sizes stand in this order, each only where the short field is full
                wide = list(struct.unpack_from(f"<{held // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == MAX32 else plain
                packed = wide.pop(0) if packed == MAX32 else packed
                at = wide.pop(0) if at == MAX32 else at
            e += 4 + held
        if method != 0:
            raise ValueError(f"{name} is compressed; packages hold stored members")
        local = read_at(at, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        ln, le = struct.unpack_from("<HH", local, 26)
        out.append(Member(name, at + 30 + ln + le, packed))
    return out


def record_bytes(kind: str, page_id, url: str, digest: str, payload: bytes, full_length: int, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {full_length}",
    ]
    if url is not None:
        plain = not any(c in url for c in "\r\n")
        head.append(f"WARC-Target-URI: {url}" if plain else f"{ENCODED_URI}: {base64.b64encode(url.encode()).decode()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken record")
    return headers, rest[:size]


def target_uri(headers: dict[str, str]) -> str | None:
    """The address of a record, or None if it has none."""
    if ENCODED_URI in headers:
        return base64.b64decode(headers[ENCODED_URI]).decode()
    return headers.get("WARC-Target-URI")


def walk_records(raw: bytes):
    """(offset, size) of each gzip member of an archive in memory."""
    return walk_ranges(lambda at, size: raw[at : at + size], len(raw))


def walk_ranges(read_at, length: int):
    """(offset, size) of each gzip member of ``length`` bytes, read front to back in small ranges."""
    at, here, held = 0, 0, b""
    while at < length:
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not held:
                held = read_at(here, min(WALK_BYTES, length - here))
                here += len(held)
                if not held:
                    raise ValueError("the archive ends within a record")
            unpacker.decompress(held)
            held = unpacker.unused_data
        end = here - len(held)
        yield at, end - at
        at = end


def url_key(url: str | None) -> str:
    """The sort key of an address in an index: its host from the top level down, then its path."""
    from urllib.parse import quote, urlsplit

    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        host = ""
    key = f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else text
    return quote(key.lower(), safe="/?&=,):;%@+~!*'($.-_") or "-"


def index_line(url: str | None, kind: str, digest: str, offset: int, size: int) -> bytes:
    """One CDXJ line: key, time stamp, and where the record lies."""
    facts = {"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if kind == "revisit" else "text/html", "offset": offset, "length": size, "filename": ARCHIVE.split("/")[-1]}
    return f"{url_key(url)} 19700101000000 {json.dumps(facts, separators=(',', ':'))}\n".encode()


#: Names that Spark gives to stores, and those under which Arrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def _filesystem(folder: str):
    """(file system, path) of a folder URI or plain path; a store that Arrow does not reach is an error that names those it does."""
    import pyarrow as pa
    from pyarrow import fs

    scheme, found, rest = folder.partition("://")
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else f"file://{folder.removeprefix('file:')}"
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError) as error:
        raise ValueError(f"packages cannot be kept in {folder}: ranges are read by Arrow, which needs a folder by file, s3, s3a, gs, abfs, or hdfs with its native library") from error


def plan_records(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(page_id, n_bytes, digest, response_id): the id of the response that stands for the page's payload."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    facts = cut(pages.select(F.col(page_id).cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest")))
    large = facts.where(F.col("n_bytes") >= LEAST_BYTES)
    last = large.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").select("digest", "n_bytes", "response_id")
    return facts.join(last, ["digest", "n_bytes"], "left").select("page_id", "n_bytes", "digest", F.when(F.col("response_id") != F.col("page_id"), F.col("response_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages; returns the manifest (path, n_bytes, n_records, marks) of the packages that count.

    ``marks`` are the places in the index member at which each run of ``READ_RECORDS`` lines begins, and its end.
    """
    _filesystem(folder)  # so that a store out of reach fails here, before any task
    small_batches(pages.sparkSession)
    plan = cut(plan_records(pages, page_id, payload).where("refers_to IS NOT NULL").distinct())
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body).alias("digest"))
    few = plan.count() <= BROADCAST_REVISITS
    joined = rows.join(F.broadcast(plan) if few else plan, ["page_id", "digest", "n_bytes"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        import pyarrow as pa

        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        done, out, index = [], None, []

        def close():
            nonlocal out, index
            if out is None:
                return
            out.end()
            out.begin(INDEX)
            marks = []
            for k, line in enumerate(sorted(index)):
                at = out.write(line)
                if k % READ_RECORDS == 0:
                    marks.append(at)
            marks.append(out.now["size"])
            out.end()
            out.close()
            out.stream.close()
            done.append((path, out.at, len(index), marks))
            out, index = None, []

        for batch in batches:
            for page, link, data, digest, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]):
                if out is not None and out.at > PACKAGE_BYTES:
                    close()
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    out = PackageWriter(system.open_output_stream(path))
                    out.begin(ARCHIVE)
                kind = "response" if refers is None else "revisit"
                record = record_bytes(kind, page, link, digest, data if refers is None else b"", len(data), refers)
                index.append(index_line(link, kind, digest, out.write(record), len(record)))
        close()
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], ["path", "n_bytes", "n_records", "marks"])

    return cut(joined.mapInArrow(run, "path string, n_bytes long, n_records long, marks array<long>"))


def read_packages(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the manifest.

    Payload size and digest of a response are computed from what was read and checked against the record's headers; those
    of a revisit are its headers'.
    """
    small_batches(spark)
    runs = manifest.where("n_records > 0").select("path", "n_records", F.explode(F.sequence(F.lit(0), F.size("marks") - 2)).alias("k"), "marks")
    reads = runs.select("path", (F.col("k") * READ_RECORDS).cast("long").alias("first"), F.get("marks", F.col("k")).alias("begin"), F.get("marks", F.col("k") + 1).alias("end"))
    # a number of partitions that adaptive execution leaves alone: the rows are few and small, what they stand for is not
    parts = max(1, min(reads.count(), READ_PARTITIONS))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        import hashlib

        import pyarrow as pa

        system, _ = _filesystem(folder)
        for batch in batches:
            for path, first, begin, end in zip(*[batch.column(c).to_pylist() for c in ("path", "first", "begin", "end")]):
                with system.open_input_file(path) as file:

                    def read_at(offset, size):
                        file.seek(offset)
                        return file.read(size)

                    members = {m.name: m for m in read_directory(read_at, file.size())}
                    data = next(m for n, m in members.items() if n.endswith(".warc.gz"))
                    index = next((m for n, m in members.items() if n.startswith("indexes/")), None)
                    if index is None:
                        places = islice(walk_ranges(lambda at, size: read_at(data.at + at, size), data.size), first, first + READ_RECORDS)
                    else:
                        facts = (json.loads(x[x.index(b"{") :]) for x in read_at(index.at + begin, end - begin).splitlines())
                        places = ((f["offset"], f["length"]) for f in facts)
                    rows, held = [], 0
                    for offset, size in places:
                        headers, payload = parse_record(read_at(data.at + offset, size))
                        digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                        if headers["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                            raise ValueError(f"record of {headers['WARC-Record-ID']} in {path} is damaged")
                        number = lambda name: int(headers[name][10:-1]) if headers.get(name, "<urn:page:>")[10:-1] else None
                        rows.append((number("WARC-Record-ID"), target_uri(headers), n, digest, headers["WARC-Type"], number("WARC-Refers-To"), payload))
                        held += len(payload)
                        if held > 16_000_000:
                            yield _rows(pa, rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(pa, rows)

    return reads.repartition(parts).mapInArrow(run, schema)


def _rows(pa, rows):
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to packages in ``folder`` (a new one in the shared folder if None) and read them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    return read_packages(spark, write_packages(pages, folder), folder)


def in_memory(pages: list[tuple], force64: bool = False) -> bytes:
    """One package of (page_id, url, payload) responses, for small uses and tests."""
    import hashlib

    out = PackageWriter(stream := io.BytesIO(), force64)
    out.begin(ARCHIVE)
    index = []
    for page, link, data in pages:
        digest = hashlib.sha1(data).hexdigest()
        record = record_bytes("response", page, link, digest, data, len(data), None)
        index.append(index_line(link, "response", digest, out.write(record), len(record)))
    out.end()
    out.begin(INDEX)
    out.write(b"".join(sorted(index)))
    out.end()
    out.close()
    return stream.getvalue()
