"""WARC archives: writing, normalising monolithic gzip files, and reading by a sidecar index.

A monolithic archive is one gzip stream over all its records, so no record can be read alone.
The normaliser inflates such a stream once, piece by piece, writes every record as a gzip
member of its own, and next to the archive a sidecar index (one JSON line per record: offset,
length and the main headers). Readers then seek.

Archives lie in the shared folder and are written through its file system, whatever that is. A
task attempt writes to names of its own and reports them only when complete, so a lost executor
leaves an unreferenced file at most. Archives are rolled at a size, one record is in memory at
a time.

Defined cases: a null payload counts as empty. Records with equal payloads of at least
``least`` bytes refer to the smallest page_id among them (null never is); rows that repeat that
page_id are responses too. If all their page_ids are null, they are all responses. Control
characters in a URL are percent-encoded; a null URL becomes urn:page:<id>.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, ship, stored

#: Bytes of records after which an archive is closed.
ROLL = 64 << 20
LEVEL, PIECE = 4, 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: str, url: str, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response, or a revisit (without payload) if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def headers_of(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; a line that starts with white space continues the last."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(pieces_in: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an inflated stream that arrives in pieces."""
    held = bytearray()

    def fill() -> bool:
        piece = next(pieces_in, b"")
        held.extend(piece)
        return bool(piece)

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[0]
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill():
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            while held[:1] in (b"\r", b"\n"):
                del held[0]
                searched = 0
        if not held.startswith(b"WARC/"):
            raise ValueError("a record does not begin with WARC/")
        head = headers_of(bytes(held[:end]))
        size = end + 4 + int(head["content-length"])
        while len(held) < size + 4 and fill():
            pass
        if len(held) < size:
            raise ValueError("the archive ends within a record's block")
        yield head, bytes(held[:size]) + b"\r\n\r\n"
        del held[:size]


def inflate(source, piece: int = PIECE) -> Iterator[bytes]:
    """Bytes of a gzip file of any number of members, in bounded pieces."""
    unzip, rest = zlib.decompressobj(31), b""
    while rest or (rest := source.read(piece)):
        out = unzip.decompress(rest, piece)
        if out:
            yield out
        rest = unzip.unconsumed_tail
        if unzip.eof:
            rest = unzip.unused_data
            unzip = zlib.decompressobj(31)
    if tail := unzip.flush():
        yield tail


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write_monolithic(folder: str):
    def write(batches):
        files, path = fs.FileSystem.from_uri(folder)
        out = packer = None
        name, count, size, done = "", 0, 0, []

        def close():
            out.write(packer.flush())
            out.close()
            done.append((name, count, size))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, n, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    name, count, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = files.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, url, None if html is None else html.encode(), digest, n, refers_to)
                out.write(packer.compress(data))
                count, size = count + 1, size + len(data)
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "records", "bytes"]
        )

    return write


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to monolithic archives; returns (path, records, bytes) of each.

    Payload digests are joined by equal payload: only digests meet, and a payload that a large
    part of the pages share is split by the join's skew handling.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    firsts = rows.filter(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = firsts.filter("copies > 1 and first is not null").select("sha1", "size", "first")
    joined = rows.join(shared, ["sha1", "size"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    described = joined.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"),
        "url",
        F.when(~other, F.col("html")).alias("html"),
        base32(F.col("sha1")).alias("digest"),
        "size",
        F.when(other, F.col("first").cast("string")).alias("refers_to"),
    )
    folder = new_path(spark, "warc-monolithic")
    made = fs.FileSystem.from_uri(folder)
    made[0].create_dir(made[1], recursive=True)
    return stored(described.mapInArrow(_write_monolithic(folder), "path string, records long, bytes long"), "warc-written")


def base32(sha1_hex):
    """Base32 of 40 hexadecimal digits: 32 characters of five bits each."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 2), 20, "0") for i in range(8)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    places = (F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") for i in range(32))
    return F.concat(*(F.substring(F.lit(letters), p + 1, F.lit(1)) for p in places))


def _normalise(folder: str):
    def run(batches):
        files, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                target = f"{path}/{uuid.uuid4().hex}.warc.gz"
                index, offset, count = f"{target}.cdxj", 0, 0
                with (
                    files.open_input_stream(source, compression=None) as packed,
                    files.open_output_stream(target, compression=None) as out,
                    files.open_output_stream(index, compression=None) as side,
                ):
                    for head, whole in read_records(inflate(packed)):
                        data = member(whole)
                        out.write(data)
                        entry = {"offset": offset, "length": len(data), "type": head.get("warc-type"), "url": head.get("warc-target-uri")}
                        entry |= {"id": head.get("warc-record-id"), "digest": head.get("warc-payload-digest")}
                        side.write(json.dumps(entry).encode() + b"\n")
                        offset, count = offset + len(data), count + 1
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [index], "records": [count]})

    return run


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives with one gzip member per record; returns (path, index, records) of each.

    One task takes one archive, whose size is bounded where it is written.
    """
    spark = archives.sparkSession
    ship(spark)
    folder = new_path(spark, "warc-members")
    made = fs.FileSystem.from_uri(folder)
    made[0].create_dir(made[1], recursive=True)
    spread = archives.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    return stored(spread.mapInArrow(_normalise(folder), "path string, index string, records long"), "warc-normalised")


def _read_indexed(folder: str):
    def run(batches):
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows = []
                with files.open_input_stream(index, compression=None) as side, files.open_input_file(path) as data:
                    for line in side.read().splitlines():
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        whole = zlib.decompress(data.read(entry["length"]), 31)
                        rows.append(_page_row(whole))
                        if len(rows) == 256:
                            yield _page_batch(rows)
                            rows = []
                yield _page_batch(rows)

    return run


def _page_row(whole: bytes) -> tuple:
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = headers_of(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = int(headers_of(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return fields["x-page-id"], size, digest, fields["warc-type"], fields.get("x-refers-to-page")


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    )


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every page record, sought by the sidecar index, with its payload checked against its digest."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    spread = archives.select("path", "index").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(_read_indexed(folder), schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, normalise the archives, and read every record back."""
    made = normalise(write_archives(pages, least))
    back = read_archives(made, new_path(pages.sparkSession, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return back.select(
        F.nullif("page_id", F.lit("")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
