"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The reader checks every member and record. After a failed check it looks for the next byte at which a whole, valid
member (compressed) or a valid version line (plain) begins, goes on from there, and reports the bytes in between
as a quarantined gap. Files pass through tasks as rows of Spark's ``binaryFile`` source, so any store that Spark
reads will do; the writer keeps files near ``max_bytes``, which bounds what a task holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from arealens.llm.staging import stage_table
from arealens.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 8 << 20
# Fields that every record must have.
MANDATORY = {"warc-record-id", "warc-date", "warc-type", "content-length"}
STEP = 1 << 16
HEAD_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.[01]\r\n")
RECORD_SCHEMA = (
    "kind string, path string, start long, end long, reason string, record_id string, record_type string, uri string,"
    " refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def mark_revisits(
    pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0
) -> DataFrame:
    """key, url, payload, ``record_type`` and ``refers_to`` per page.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest key is the response and the others
    revisit it; repeated rows that share that key are all responses. A NULL payload is empty; a NULL key loses to any
    other and, alone, refers to nothing. Only hashes meet in the grouping, combined before the shuffle, so one very
    frequent payload moves no page to one task; the second join is on the page's own key.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), body.alias("_payload"),
        F.sha1(F.encode(body, "UTF-8")).alias("_sha"), F.octet_length(body).alias("_size"),
    )
    slim = rows.select("_key", "_sha", "_size")
    groups = slim.filter(F.col("_size") >= min_bytes).groupBy("_sha", "_size").agg(F.count(F.lit(1)).alias("_n"), F.max("_key").alias("_last"))
    repeated = groups.filter("_n > 1").select(F.col("_sha").alias("_s"), F.col("_size").alias("_z"), "_last")
    marks = (
        slim.distinct()
        .join(repeated, (F.col("_sha") == F.col("_s")) & (F.col("_size") == F.col("_z")))
        .filter(~F.col("_key").eqNullSafe(F.col("_last")))
        .select(F.col("_key").alias("_k"), F.col("_sha").alias("_s"), F.col("_last").alias("refers_to"))
    )
    joined = rows.join(marks, rows["_key"].eqNullSafe(marks["_k"]) & (rows["_sha"] == marks["_s"]), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("_key", "_url", "_payload", kind.alias("record_type"), "refers_to")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(key, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    """One record with its closing blank lines."""
    name = lambda k: "<urn:x-page:none>" if k is None else f"<urn:x-page:{k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(marked: DataFrame, folder: str, max_bytes: int = FILE_BYTES, compress: bool = True) -> DataFrame:
    """Writes the rows of ``mark_revisits`` below ``folder`` and returns path, records and bytes of each file.

    Every attempt of a task writes under names of its own, and only files of attempts that ended well are in the
    returned list (written once as a table): after a lost executor the files it left are simply not listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, out, done = TaskContext.get().partitionId(), None, []
        suffix = "warc.gz" if compress else "warc"

        def close():
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in batches:
            for key, url, payload, kind, refers in zip(*[c.to_pylist() for c in batch.columns]):
                data = record_bytes(key, url, payload.encode(), kind, refers)
                data = member(data) if compress else data
                if out is None or done[-1][2] + len(data) > max_bytes:
                    close()
                    file = f"part-{part:05d}-{uuid.uuid4().hex}.{suffix}"
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                    done.append([f"{folder.rstrip('/')}/{file}", 0, 0])
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    files = marked.mapInArrow(write, "path string, records long, bytes long")
    return stage_table(files, "warc-files")


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The member that starts at ``at`` and the byte after it; ValueError if it is not whole and sound."""
    if bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
        raise ValueError("no member here")
    unpacker, parts = zlib.decompressobj(31), []
    pos = at
    while not unpacker.eof and pos < len(data):
        try:
            parts.append(unpacker.decompress(data[pos : pos + STEP]))
        except zlib.error as e:
            raise ValueError(f"member: {str(e)[:60]}") from None
        pos = min(pos + STEP, len(data))
    if not unpacker.eof:
        raise ValueError("member is cut short")
    return b"".join(parts), pos - len(unpacker.unused_data)


def parse_record(data: memoryview | bytes, at: int = 0) -> tuple[dict, int]:
    """Header fields, payload and digests of the record at ``at``, and the byte after it; ValueError if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", bytes(data[at : at + 10])):
        raise ValueError("no version line here")
    # to the blank line, however long the header is, but not beyond the next version line
    found = HEAD_END.search(data, at)
    if found is None or found[0] != b"\r\n\r\n":
        raise ValueError("header has no end")
    stop = found.start()
    head = bytes(data[at:stop])
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a name")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or not MANDATORY <= fields.keys():
        raise ValueError("header without a mandatory field")
    start = stop + 4
    end = start + int(length)
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise ValueError("record is cut short or its length is wrong")
    block = bytes(data[start:end])
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http") or not blank:
        http, payload = b"", block
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    whole = fields["warc-type"] != "revisit"
    if whole and said is not None and said != digest(payload):
        raise ValueError("payload digest differs")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_digest": said or (digest(payload) if whole else None),
        "payload_bytes": len(payload) if whole else int(size[1]) if size else None, "payload": payload if whole else None,
    }, end + 4


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one file, in order; together they cover every byte once.

    A member may hold several records; one that fails a check inside makes the whole member a gap unless earlier
    records of it were sound, which are kept. An empty file yields nothing.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    mark = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")

    def gap(end: int) -> dict:
        return {"kind": "gap", "start": bad, "end": end, "reason": why}

    while at < len(view):
        found, end = [], at
        try:
            if view[at] == 0x1F:
                plain, end = inflate(view, at)
                inner = 0
                while inner < len(plain):
                    try:
                        record, inner = parse_record(plain, inner)
                    except ValueError:
                        if not found:
                            raise
                        found.append(None)
                        break
                    found.append(record)
            else:
                record, end = parse_record(view, at)
                found.append(record)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            hit = mark.search(data, at + 1)
            at = hit.start() if hit else len(view)
            continue
        if bad is not None:
            yield gap(at)
            bad = None
        for record in found:
            if record is None:
                yield {"kind": "gap", "start": at, "end": end, "reason": "later records of this member fail their checks"}
            else:
                yield {"kind": "record", "start": at, "end": end, **record}
        at = end
    if bad is not None:
        yield gap(len(view))


def read_archives(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` for every file; see RECORD_SCHEMA. ``payloads=False`` leaves payloads out."""
    names = [x.strip().split(" ")[0] for x in RECORD_SCHEMA.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    row["path"] = path.as_py()
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    if not paths:
        return spark.createDataFrame([], RECORD_SCHEMA)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """Writes every page to archives in the shared folder and returns what the salvage reader finds there."""
    spark = pages.sparkSession
    marked = mark_revisits(pages, key, payload, url, min_bytes)
    files = write_archives(marked, scratch_path(spark, "warc"))
    # names of files, each of about max_bytes, as any Spark reader lists them on the driver
    return read_archives(spark, [r.path for r in files.select("path").collect()], payloads=False)
