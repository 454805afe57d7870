"""WARC archives: one gzip member per record, written and read in sequence.

Each task writes the pages of its partition to archives of bounded size; a
page whose payload another record already holds becomes a revisit record,
without the payload. The reader takes an archive from front to back: it feeds
blocks of the file to zlib, cuts records by their content length while a
member is still being inflated, and verifies every digest; it never holds more
than one record.

Archives lie below ``spark.checkpoint.dir`` (or a given folder) and are written
through Arrow's file systems, so the folder may be any store that these reach.
A task writes under a name of its own and the manifest lists only archives of
tasks that ended, so a task that is run again leaves no half record to a
reader.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.session import cut_lineage, ensure_checkpoint_dir

ARCHIVE_BYTES = 64_000_000  # compressed; an archive is closed beyond that
READ_BYTES = 1 << 18
LEVEL = 3
MIN_REVISIT = 0  # payloads of fewer bytes are never revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _quote(value: str) -> str:
    """A header value on one line: control characters, blanks and ``%`` as
    percent escapes of their UTF-8 bytes."""
    return "".join(c if c > " " and c not in "%\x7f" and c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def _open(folder: str):
    """(file system, path) of a folder's URI; a bare path is local."""
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member: a response, or a revisit (headers only)
    if ``refers_to`` is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{_digest(block)}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quote(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def read_records(stream):
    """(headers, block) of every record of an archive, front to back.

    Raises ValueError on a truncated record, a missing length, or a digest
    that does not fit."""
    data = b""
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                return
        member, head, block, want = zlib.decompressobj(31), None, bytearray(), None
        held = b""
        while not member.eof:
            if not data:
                data = stream.read(READ_BYTES)
                if not data:
                    raise ValueError("archive ends inside a record")
            held += member.decompress(data, READ_BYTES)
            data = member.unused_data if member.eof else member.unconsumed_tail
            if head is None and b"\r\n\r\n" in held:
                top, _, held = held.partition(b"\r\n\r\n")
                lines = top.decode().split("\r\n")
                head = dict(line.split(": ", 1) for line in lines[1:])
                if not lines[0].startswith("WARC/") or "Content-Length" not in head:
                    raise ValueError("not a WARC record")
                want = int(head["Content-Length"])
            if head is not None and len(block) < want:
                take = want - len(block)
                block += held[:take]
                held = held[take:]
        if head is None or len(block) != want or held != b"\r\n\r\n":
            raise ValueError("record does not fit its content length")
        if head["WARC-Block-Digest"] != "sha1:" + _digest(bytes(block)):
            raise ValueError("block digest does not fit")
        yield head, bytes(block)


def _keyed(pages: DataFrame) -> DataFrame:
    """``pages`` with their payload's key: digest and size."""
    payload = F.coalesce("html", F.lit(""))
    return pages.withColumn("digest", F.unhex(F.sha1(payload.cast("binary")))).withColumn("size", F.octet_length(payload).cast("long"))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, size, refers_to) of the payloads, of at least
    ``min_bytes``, that a page with a larger id has too; the largest is
    referred to. Null ids neither refer nor are referred to."""
    keys = _keyed(pages.filter("page_id is not null")).select("page_id", "digest", "size").filter(F.col("size") >= min_bytes)
    groups = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    # one digest may hold a third of the pages: both sides are salted
    salts = 32
    groups = groups.filter("least < refers_to").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(groups, ["digest", "size", "salt"])
    return own.filter("page_id < refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and returns the
    manifest: path, records, bytes, one row per archive.

    A null html is an empty payload, a null url a record without target, a
    null page_id a response without id. Repeated rows are written once each;
    with one page_id and payload they are all responses or revisits alike, and
    each payload of a page_id goes by itself."""
    spark = pages.sparkSession
    folder = f"{(folder or ensure_checkpoint_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = _keyed(rows).join(revisits(rows, min_bytes), ["page_id", "digest", "size"], "left")

    def run(batches):
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(name, compression=None), 0, 0
                payload = (html or "").encode("utf-8", "replace")
                data = record(page_id, url, payload, _digest(payload), refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [size]})

    # the manifest is kept, so that no reader sees an archive of a later attempt
    manifest = cut_lineage(rows.mapInArrow(run, "path string, records long, bytes long"))
    return manifest.withColumn("folder", F.lit(folder))


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``manifest``: page_id, url, payload
    (null for a revisit), payload_bytes, payload_digest, record_type,
    refers_to. An archive is one task's work, at most ARCHIVE_BYTES."""

    def run(batches):
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def number(value):
            value = (value or "").removeprefix("<urn:page:").removesuffix(">")
            return int(value) if value else None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist()):
                rows, held = [], 0
                with _open(folder)[0].open_input_stream(path, compression=None) as stream:
                    for head, block in read_records(stream):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])["Content-Length"])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != size or _digest(payload) != digest):
                            raise ValueError(f"payload does not fit its digest: {path}")
                        rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), None if revisit else payload, size, digest,
                                     head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                        held += len(block)
                        if held >= 4_000_000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    spread = manifest.select("folder", "path").repartition(max(1, min(manifest.count(), 10_000)))
    return spread.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages and reads them back, one row per page."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
