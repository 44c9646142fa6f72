"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the response (or a revisit of an equal earlier payload), its
request and its metadata, both naming it as concurrent.  The reader yields one row per
record; ``transactions`` joins request and metadata records to their response by way of the
concurrent-to identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.shared import settle

#: Bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 20
#: Repeated digests (about 100 bytes each) that are broadcast; more meet the payloads in a shuffle.
MOST_BROADCAST = 200_000

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, headers map<string,string>, payload_length long, block binary"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's URI (or a plain path) names, and the path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {_clean(v)}" for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def capture(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The three records of a capture; with ``refers_to`` the payload is left out."""
    response = f"urn:capture:{name}:response"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = ("WARC-Target-URI", url)
    if refers_to is None:
        main = record("response", response, head + payload, [uri, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")])
    else:
        main = record(
            "revisit",
            response,
            head,
            [uri, ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", f"<urn:capture:{refers_to}:response>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")],
        )
    together = ("WARC-Concurrent-To", f"<{response}>")
    path = "/" + (url or "").partition("://")[2].partition("/")[2]
    asked = record("request", f"urn:capture:{name}:request", f"GET {_clean(path)} HTTP/1.1\r\n\r\n".encode(), [uri, together, ("Content-Type", "application/http; msgtype=request")])
    about = record("metadata", f"urn:capture:{name}:metadata", f"payload-bytes: {len(payload)}\r\n".encode(), [uri, together, ("Content-Type", "application/warc-fields")])
    return main + asked + about


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write (name, url, payload, digest, refers_to) rows as archives below ``folder``; returns (path, captures, bytes).

    Each task attempt writes files of its own and only the rows of successful tasks name them, so
    a lost executor leaves nothing but unnamed files.  ``name`` and ``refers_to`` are strings, payload binary.
    A null url writes no target header, a null payload is empty; repeated rows are written each.  A
    payload is held whole in memory, once, however long; other columns aren't read.  A task without rows writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        task, files, out = TaskContext.get(), 0, None
        path, n, size = "", 0, 0

        def end() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "captures": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz", 0, 0
                    out, files = where.open_output_stream(f"{base}/{path}", compression=None), files + 1
                    size += out.write(record("warcinfo", f"urn:archive:{path}", b"format: WARC File Format 1.1\r\n", [("WARC-Filename", path)])) or 0
                data = capture(row[0], row[1], row[2] or b"", row[3], row[4])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    return captures.select("name", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, captures long, bytes long")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, read piece by piece."""
    waiting = b""
    while True:
        if not waiting and not (waiting := stream.read(_READ)):
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not waiting and not (waiting := stream.read(_READ)):
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(waiting))
            waiting = unpack.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased, the first of a name) and block of one record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    length = int(fields.get("content-length", len(rest)))
    if len(rest) < length:
        raise ValueError("a record is shorter than its Content-Length")
    return fields, rest[:length]


def read_records(paths: DataFrame, with_blocks: bool = True) -> DataFrame:
    """One row per record of the archives named by ``paths.path``, with RECORD's columns.

    An archive is read by one task, record by record, so memory is bounded by the longest record; digests
    and lengths of HTTP payloads are computed from what is read.  ``with_blocks`` false leaves the ``block``
    of responses null.  A path listed twice is read twice, other columns aren't read, and no paths give no
    records.  Fields that a record lacks are null; what isn't a WARC record is an error.
    """
    schema = RECORD + ", payload_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda x: x.strip("<>") if x is not None else None
        arrow = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_length", pa.int64()), ("block", pa.binary()), ("payload_sha256", pa.string())])
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            done, rows, held = rows, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                where, path = filesystem(uri)
                with where.open_input_stream(path, compression=None, buffer_size=_READ) as stream:
                    for raw in members(stream):
                        f, block = parse(raw)
                        http = f.get("content-type", "").startswith("application/http")
                        payload = block.partition(b"\r\n\r\n")[2] if http else block
                        kind = f.get("warc-type")
                        rows.append((bare(f.get("warc-record-id")), kind, bare(f.get("warc-concurrent-to")), bare(f.get("warc-refers-to")), f.get("warc-target-uri"), f.get("warc-payload-digest"), list(f.items()), len(payload), block if with_blocks or not http or kind == "request" else None, hashlib.sha256(payload).hexdigest()))
                        held += len(block) + 500
                        if held > 8 << 20:
                            yield flush()
        if rows:
            yield flush()

    spread = max(1, min(paths.sparkSession.sparkContext.defaultParallelism * 4, 10_000))
    return paths.select("path").repartition(spread, "path").mapInArrow(run, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: record_id, target_uri, response, request, metadata.

    ``request`` and ``metadata`` are the records concurrent to it, null without one; of several the one with
    the smallest record id, with their number in n_requests and n_metadata, so that no identifier,
    however hot, gathers its records in a task.  A request or metadata record whose concurrent-to
    names no response is left out, as are records without an id; repeated response ids give a row
    each; no records give no rows.  The joins are merge joins by hint: a plan can't know how
    many records the archives hold, and would broadcast them.
    """
    body = F.struct("record_id", "type", "headers", "payload_length", "block")

    def side(kind: str, name: str) -> DataFrame:
        some = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return some.groupBy("concurrent_to").agg(F.min_by(body, "record_id").alias(kind), F.count(F.lit(1)).alias(name)).withColumnRenamed("concurrent_to", "record_id")

    main = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull())
    main = main.select("record_id", "target_uri", F.struct("type", "refers_to", "payload_digest", "payload_length", "payload_sha256", "headers", "block").alias("response"))
    joined = main
    for kind, name in (("request", "n_requests"), ("metadata", "n_metadata")):
        joined = joined.join(side(kind, name).hint("merge"), "record_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_requests", "n_metadata")})


def captures_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(name, url, payload, digest, refers_to) of pages: of equal payloads of at least ``least`` bytes the smallest id answers, others refer to it.

    A null payload is empty.  Rows with a null id are named ``null`` and, like smaller payloads, all
    responses.  Where the smallest id itself stands twice, each of those rows is a response.  Other columns
    aren't read; no pages give no captures.  Only ids and digests are shuffled to find equal payloads.  The digests
    found twice are broadcast up to ``most_broadcast`` after they are counted; beyond, payloads of ``least`` bytes
    and more are shuffled by digest, smaller ones never.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    eligible = F.octet_length("payload") >= least
    narrow = rows.where(eligible & F.col("id").isNotNull()).select("id", F.sha2("payload", 256).alias("digest"))
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first")
    firsts = settle(firsts)
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    if firsts.count() <= most_broadcast:
        joined = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        small = rows.where(~eligible).withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
        joined = rows.where(eligible).join(firsts.hint("merge"), "digest", "left").unionByName(small)
    again = eligible & F.col("first").isNotNull() & (F.col("id") != F.col("first"))
    return joined.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("name"), "url", "payload", "digest", F.when(again, F.col("first").cast("string")).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages written as archives below ``folder`` and read back as transactions (without blocks); see the parts for nulls and repeats."""
    written = write_archives(captures_of(pages), folder)
    written.write.parquet(f"{folder}-index")
    # the archives are read once, each kind of record from a table of columns
    read_records(spark.read.parquet(f"{folder}-index"), with_blocks=False).write.parquet(f"{folder}-records")
    return transactions(spark.read.parquet(f"{folder}-records"))
