"""WARC archives: written by many tasks, read back in byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of a file, searches it for the magic of a gzip member,
and takes a candidate for a record only if it decodes to the headers of one, whole and with the right checksum, and if what follows
it is another member or the file's end; members that are written here hold the magic at their start only. A task owns the records that start in its range and reads on for the last of them, so each
record is read once, however a file is cut. Bytes that belong to no readable record are passed over.

Of the records with equal payloads of `least` bytes or more the one with the largest page_id is a response, the others are
revisits: they carry the digest and the size of the payload and refer to the response, and hold no payload. Rows that repeat the
largest page_id with the same payload are all responses (of one record id). A null page_id is smaller than any other. A null html
is an empty payload, a null url a record without target; in urls blanks and control characters are written as %XX.

Writing tasks put their files under names of their own; only files of tasks that Spark counts as done stay, so a task that is run
again leaves nothing double. No row or an empty table gives an archive without files, which reads as no rows. Other columns than
page_id, url and html aren't read. A record is held in memory as a whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, join_hot, shared_dir

MAGIC, CHUNK = b"\x1f\x8b\x08", 1 << 20
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 1 << 30, 64 << 20, 8 << 20
#: Payloads that repeat: up to so many are broadcast to the rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The one date of all records, as pages have none.
DATE = "1970-01-01T00:00:00Z"
RECORD = "file string, offset long, record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, payload binary"


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path lies in, and the path there."""
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id, url: str | None, html: bytes, digest: str, response: bool, original) -> bytes:
    """A record as a gzip member. The headers are the format's; a revisit also has the size of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + html if response else http
    head = [f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(original, digest)}", f"X-Payload-Length: {len(html)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return member(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """data as a gzip member with the magic only at its start, which makes every find of a reader a true one. Where the compressed
    bytes happen to hold it, in one member of many megabytes, they are flushed at another place."""
    cut = 0
    while True:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out = pack.compress(data[:cut]) + (pack.flush(zlib.Z_FULL_FLUSH) if cut else b"") + pack.compress(data[cut:]) + pack.flush()
        if out.find(MAGIC, 1) < 0:
            return out
        cut = (cut + 997) % len(data)


def with_originals(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """pages (page_id, url, bytes) with response and original, the page_id of the record to refer to."""
    hashed = pages.withColumn("key", F.sha2("bytes", 256))
    large = F.length("bytes") >= least
    groups = hashed.filter(large).groupBy("key").agg(F.count("*").alias("times"), F.max("page_id").alias("original")).filter("times > 1")
    groups = scratch.written(groups)
    if groups.count() <= BROADCAST_ROWS:
        told = hashed.join(F.broadcast(groups), "key", "left")
    else:
        repeats = join_hot(hashed.filter(large), groups, ["key"], "times", hashed.count())
        single = hashed.filter(large).join(groups.select("key"), "key", "left_anti").unionByName(hashed.filter(~large))
        told = repeats.unionByName(single, allowMissingColumns=True)
    response = F.col("times").isNull() | F.col("page_id").eqNullSafe(F.col("original"))
    return told.select("page_id", "url", "bytes", response.alias("response"), "original")


def write_warc(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Files below path, each of up to file_bytes and a record more."""
    spark = pages.sparkSession

    def write(parts):
        fs, folder = open_fs(path)
        out, name, n, held = None, None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"name": name, "records": n}])

        for part in parts:
            for r in part.to_pylist():
                if out is None:
                    name, n, held = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=CHUNK)
                html = r["bytes"]
                made = record(r["page_id"], r["url"], html, hashlib.sha1(html).hexdigest(), r["response"], r["original"])
                out.write(made)
                n, held = n + 1, held + len(made)
                if held >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    fs, folder = open_fs(path)
    fs.create_dir(folder)
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("bytes"))
    with Scratch(spark) as scratch:
        files = scratch.written(with_originals(given, least, scratch).mapInArrow(write, "name string, records long"))
        kept = {r[0] for r in files.select("name").toLocalIterator()}
    for entry in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
        if entry.base_name not in kept:  # of a task that didn't end
            fs.delete_file(entry.path)


class Member:
    """The gzip member at a place of an open file: its bytes, and where it ends; ValueError if there is none."""

    def __init__(self, f, at: int, only_head: bool = False):
        f.seek(at)
        unpack, out, taken, known = zlib.decompressobj(31), [], 0, b""
        while not unpack.eof:
            data = f.read(min(CHUNK, 1 << 16) if not taken else CHUNK)
            if not data:
                raise ValueError("the file ends within a member")
            try:
                out.append(unpack.decompress(data))
            except zlib.error as e:
                raise ValueError(str(e)) from e
            known = known if len(known) >= 5 else (known + out[-1])[:5]
            if known != b"WARC/"[: len(known)]:
                raise ValueError("no record")
            taken += len(data)
            if only_head and len(known) == 5:
                return
        if len(known) < 5:
            raise ValueError("no record")
        self.bytes, self.end = b"".join(out), at + taken - len(unpack.unused_data)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not split or not size.isdigit() or len(rest) < int(size):
        raise ValueError("no record")
    return headers, rest[: int(size)]


def member_at(f, at: int, size: int) -> Member | None:
    """The record's member at a place, if one starts there that another one or the file's end follows."""
    try:
        found = Member(f, at)
        parsed(found.bytes)
        if found.end < size:
            Member(f, found.end, only_head=True)
        return found
    except ValueError:
        return None


def records_in(f, size: int, start: int, end: int, chunk: int = CHUNK):
    """(offset, headers, block) of the records that start in a byte range."""
    at, end = start, min(end, size)
    while at < end:
        f.seek(at)
        data = f.read(min(chunk, end - at) + len(MAGIC) - 1)
        place = data.find(MAGIC)
        if place < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += place
        found = member_at(f, at, size) if at < end else None
        if at < end and found is None:
            at += 1
        while found is not None:
            yield at, *parsed(found.bytes)
            at, found = found.end, None
            if at < end:  # a record behind a record needs no search
                try:
                    found = Member(f, at)
                    parsed(found.bytes)
                except ValueError:
                    found = None


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record of the .warc.gz files below path: file, offset, record_type, record_id, refers_to, target_uri, headers
    (names in lower case), payload (what follows the HTTP headers of a response; null for other types)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    splits = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, min(10_000, files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split_bytes)), F.lit(0))).first()[0]))

    def read(parts):
        def batch(rows):
            names = [c.split(" ")[0] for c in RECORD.split(", ")]
            types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for part in parts:
            for s in part.to_pylist():
                fs, name = open_fs(s["path"])
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for offset, headers, block in records_in(f, s["length"], s["start"], s["start"] + split_bytes):
                        kind = headers.get("warc-type")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        rows.append((s["path"], offset, kind, headers.get("warc-record-id"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), list(headers.items()), payload))
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return splits.repartition(n).mapInArrow(read, RECORD)


def page_of(record_id_column) -> F.Column:
    """The page_id in a record id."""
    return F.regexp_extract(record_id_column, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")


def archived(pages: DataFrame, path: str | None = None, least: int = 1000, file_bytes: int = FILE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the pages below path (of the shared folder, where none is given) and reads them back: read_warc's columns, page_id,
    payload_bytes and payload_digest (SHA-1 in hex) of the full payload, refers_to_page."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least, file_bytes)
    found = read_warc(pages.sparkSession, path, split_bytes)
    told = lambda own, said: F.when(F.col("record_type") == "response", own).otherwise(said)
    return found.select(
        "*",
        page_of(F.col("record_id")).alias("page_id"),
        told(F.length("payload").cast("long"), F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        told(F.sha1("payload"), F.regexp_extract(F.col("headers")["warc-payload-digest"], "^sha1:(.*)$", 1)).alias("payload_digest"),
        page_of(F.col("refers_to")).alias("refers_to_page"),
    )
