"""WARC: archives written and read, transactions assembled through concurrent-to identifiers.

Writing (`write_warc`): WARC/1.1, gzip with a member for each record, so each record can be read alone; a warcinfo record
begins each file. Each page gives a request record, a response or revisit record (HTTP messages) and a metadata record
(warc-fields: page-id, payload-bytes, refers-to-page-id); the first and the last name the response's record id in
WARC-Concurrent-To. Of pages with equal payloads of at least `revisit_bytes` bytes the one with the largest id is the response
and the others revisit it by WARC-Refers-To, with the identical-payload profile. Which page is which is decided on digests
alone, aggregated before they are shuffled, so a payload that a third of all pages share is no hot group. A task begins a new
file after `file_bytes` bytes of content; files are written under a name of their own and renamed, and the manifest that
comes back (a row for each file) says what counts, so a task that is lost or runs twice leaves no half archive in it.

Reading (`read_warc`): a file is unpacked as a stream in one task and parsed by Content-Length, so payloads may hold anything.
One row for each record. Memory: one record. Broken records raise ValueError with the name of the file.

`transactions(records)`: the records of a capture meet by the response's id (a record's own, or the one it is concurrent to) in
one aggregate, and give one nested row: response or revisit, request, metadata. A capture whose response is missing still
gives a row, with nulls.

Defined results: null html is an empty payload; null urls are empty target URIs. Null page ids have no page-id field and are
read as null; among equal payloads a null id is smaller than all others. Pages that repeat an id or a whole row get a record
each with an id of its own; if the largest id of a shared payload is repeated, all of its rows are responses, and the
revisits name its page but no record. Very long payloads are held one at a time. Empty tables give no records. Further columns
are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.words import slices
from quillspark.llm.written import written

REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
LEVEL = 6
END = b"\r\n\r\n"

# Names of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUEST, RESPONSE, FIELDS = "application/http;msgtype=request", "application/http;msgtype=response", "application/warc-fields"

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, target_uri string, date string, refers_to_id string, page_id long, "
    "refers_to long, payload_digest string, payload_bytes long, payload binary"
)
_KINDS = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]


def decide(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds to rows with page_id, digest, size: kind, refers_to (of revisits) and named (the response's record has an id that
    follows from the payload)."""
    ids = pages.where(F.col("size") >= revisit_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    head = F.max(F.struct(F.col("page_id"), F.col("n"))).alias("h")
    shared = ids.groupBy("digest").agg(head, F.sum("n").alias("n")).where("n > 1")
    shared = shared.select(F.col("digest").alias("shared_digest"), F.col("h.page_id").alias("head"), (F.col("h.n") == 1).alias("named"))
    # Written first: Spark knows its size and broadcasts it only below spark.sql.autoBroadcastJoinThreshold; beyond, both
    # sides of the join are dealt out by it, so it can split a payload that a large part of all pages share.
    shared = written(shared, "payloads")
    joined = pages.join(shared, (F.col("digest") == F.col("shared_digest")) & (F.col("size") >= revisit_bytes), "left")
    revisit = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return joined.select("*", kind.alias("kind"), F.when(revisit, F.col("head")).alias("refers_to")).drop("head", "shared_digest")


def record(fields: list[tuple[str, str | None]], body: bytes) -> bytes:
    """A whole record; fields without a value are left out."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + END + body + END


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


class Archive:
    """Records of pages, with ids of one write."""

    def __init__(self, write: str, date: str):
        self.space, self.date = uuid.UUID(write), date

    def _id(self, *parts) -> str:
        return f"<urn:uuid:{uuid.uuid5(self.space, ':'.join(map(str, parts)))}>"

    def info(self, name: str) -> bytes:
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", self._id("info", name)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", FIELDS)]
        return record(fields, b"format: WARC File Format 1.1\r\n")

    def capture(self, own: str, page_id: int | None, url: str, html: bytes, digest: str, kind: str, refers_to: int | None, named: bool) -> Iterator[bytes]:
        """Request, response or revisit, metadata. own: a name of the row in this write."""
        shared = self._id("payload", digest)
        main = shared if named and kind == "response" else self._id(own, "response")
        common = [("WARC-Date", self.date), ("WARC-Target-URI", url)]
        host, path = (url.partition("://")[2].partition("/")[::2]) if "://" in url else ("", url)
        yield record(
            [("WARC-Type", "request"), ("WARC-Record-ID", self._id(own, "request")), *common, ("WARC-Concurrent-To", main), ("Content-Type", REQUEST)],
            f"GET /{path} HTTP/1.1\r\nHost: {host}".encode() + END,
        )
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}".encode() + END
        again = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", shared if named else None)] if kind == "revisit" else []
        yield record(
            [("WARC-Type", kind), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), *again, ("Content-Type", RESPONSE)],
            head if kind == "revisit" else head + html,
        )
        notes = [("page-id", page_id), ("payload-bytes", len(html)), ("refers-to-page-id", refers_to)]
        yield record(
            [("WARC-Type", "metadata"), ("WARC-Record-ID", self._id(own, "metadata")), *common, ("WARC-Concurrent-To", main), ("Content-Type", FIELDS)],
            "".join(f"{k}: {v}\r\n" for k, v in notes if v is not None).encode(),
        )


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_warc(
    pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, date: str | None = None,
) -> list[dict]:
    """Writes the archives of a table with page_id, url, html below `path`: the manifest (file, size, records). `date` is the
    WARC-Date of all records, the time of the write by default."""
    where, inner = _open(path)
    where.create_dir(inner, recursive=True)
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(pages["url"].cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"),
    )
    judged = decide(rows, revisit_bytes).select("page_id", "url", "html", "digest", "kind", "refers_to", "named")
    write, date = str(uuid.uuid4()), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, inner = _open(path)
        archive, part = Archive(write, date), TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex[:12]
        out, name, held, files, row = None, "", 0, [], 0

        def close() -> None:
            out.close()
            where.move(f"{inner}/.{name}", f"{inner}/{name}")
            files.append((name, where.get_file_info(f"{inner}/{name}").size, records))

        records = 0
        for b in slices(batches):
            for page in b.to_pylist():
                if out is None:
                    name = f"part-{part:06d}-{len(files):04d}-{attempt}.warc.gz"
                    out, held, records = where.open_output_stream(f"{inner}/.{name}", compression=None), 0, 1
                    out.write(_member(archive.info(name)))
                own = f"{part}-{row}"
                row += 1
                for x in archive.capture(own, page["page_id"], page["url"], page["html"], page["digest"], page["kind"], page["refers_to"], bool(page["named"])):
                    out.write(_member(x))
                    held += len(x)
                    records += 1
                if held > file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*files, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["file", "size", "records"])

    found = judged.mapInArrow(run, "file string, size long, records long").collect()  # a row for each file
    return sorted((r.asDict() for r in found), key=lambda r: r["file"])


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, content) of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields = {}
        while (line := stream.readline()).strip():
            name, sep, value = line.partition(b":")
            if not sep:
                raise ValueError("not a header field")
            fields[name.decode().strip().lower()] = value.decode().strip()
        size = int(fields["content-length"])
        body = stream.read(size)
        if len(body) != size or stream.read(4) != END:
            raise ValueError("a record breaks off")
        yield fields, body


def _row(fields: dict[str, str], body: bytes) -> tuple:
    """A record as a row of RECORD_SCHEMA."""
    kind = fields["warc-type"]
    if fields.get("content-type", "").startswith("application/http"):
        body = body.partition(END)[2] if kind in ("response", "revisit") else body
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if digest is not None and len(digest) == 32:
        digest = base64.b32decode(digest).hex()
    size, notes = len(body), {}
    if kind == "response":
        found = hashlib.sha1(body).hexdigest()
        if digest is not None and digest != found:
            raise ValueError("payload and digest differ")
        digest = found
    elif kind == "metadata" and fields.get("content-type", FIELDS) == FIELDS:
        for line in body.decode().splitlines():
            name, sep, value = line.partition(":")
            notes |= {name.strip().lower(): value.strip()} if sep else {}
        size = int(notes["payload-bytes"]) if "payload-bytes" in notes else size
    number = lambda k: int(notes[k]) if k in notes else None
    return (
        fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
        fields.get("warc-refers-to"), number("page-id"), number("refers-to-page-id"), digest, size, body,
    )


def read_warc(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """A row for each record of the archives below `path` (RECORD_SCHEMA): of `files`, those of a manifest, or of all
    *.warc.gz there."""
    where, inner = _open(path)
    if files is None:
        from pyarrow import fs

        listed = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        files = [x.base_name for x in listed if x.base_name.endswith(".warc.gz") and not x.base_name.startswith(".")]
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, inner = _open(path)
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
        for b in batches:
            for name in b.column(0).to_pylist():
                with where.open_input_stream(f"{inner}/{name}", compression=None) as raw:
                    held, weight = [], 0
                    try:
                        for fields, body in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                            if fields.get("warc-type") == "warcinfo":
                                continue
                            held.append(_row(fields, body))
                            weight += len(body)
                            if weight > 4 << 20 or len(held) >= 3000:
                                yield batch(held)
                                held, weight = [], 0
                    except (KeyError, ValueError, EOFError, OSError) as e:
                        raise ValueError(f"{name}: {e}") from e
                    if held:
                        yield batch(held)

    return names.mapInArrow(read, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture."""
    of = lambda *kinds: F.col("record_type").isin(*kinds)
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    main, notes = of("response", "revisit"), of("metadata")
    own = ("record_type", "target_uri", "date", "refers_to_id", "payload_digest", "payload")
    met = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).groupBy("capture_id").agg(
        *[pick(main, c).alias(f"r_{c}") for c in own],
        *[pick(notes, c).alias(f"m_{c}") for c in ("record_id", "payload", "page_id", "refers_to", "payload_bytes")],
        *[pick(of("request"), c).alias(f"q_{c}") for c in ("record_id", "payload")],
        pick(main, "payload_bytes").alias("r_payload_bytes"),
    )
    size = F.when(F.col("r_record_type").isNotNull(), F.coalesce("m_payload_bytes", "r_payload_bytes")).alias("payload_bytes")
    return met.select(
        "capture_id",
        F.struct(*[F.col(f"r_{c}").alias(c) for c in own], F.col("m_page_id").alias("page_id"), F.col("m_refers_to").alias("refers_to"), size).alias("response"),
        F.struct(F.col("q_record_id").alias("record_id"), F.col("q_payload").alias("payload")).alias("request"),
        F.struct(F.col("m_record_id").alias("record_id"), F.col("m_payload").alias("payload")).alias("metadata"),
    )
