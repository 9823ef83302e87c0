"""WARC archives: writing pages as records and reading archives in splits (free style).

Every record is a gzip member of its own, so an archive can be read from any member. A
reading task owns the records that start inside its byte range. It looks for the first
gzip magic in the range whose member decodes to a WARC header, reads on from member to
member past its end of range if need be, and searches again where a member is broken.
A range costs one pass over its bytes, and one record is in memory at a time.

Equal payloads of at least `LEAST` bytes are stored once: the record with the largest id
is the response and the others are revisits of it. Payloads that occur twice are counted
by digest with partial sums; the pages themselves are shuffled only if there are more of
these digests than may be broadcast.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posewatch import session
from posewatch.llm import tables

LEAST = 1000
SPLIT = 8 << 20
ROLL = 256 << 20  # bytes after which a task begins a new archive
CHUNK = 1 << 18
TASKS = 20_000  # reading tasks; beyond it a task reads several ranges
DIGESTS = 500_000  # repeated digests of about 40 bytes that may be sent to every task
MAGIC = b"\x1f\x8b\x08"
# Fixed values of the record format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode()
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Write the pages as archives below `folder`; returns the archives (path, size).

    Only archives of tasks that ended well are listed, so a task that was run again
    leaves at most an unlisted file.
    """
    digest = F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    repeated = (
        pages.where(F.octet_length(payload_col) >= LEAST)
        .groupBy(digest.alias("_digest"))
        .agg(F.max(id_col).alias("_target"), F.count("*").alias("n"))
        .where("n > 1")
        .select("_digest", "_target")
    )
    repeated = session.materialise(repeated, "digests")
    if repeated.count() <= DIGESTS:
        repeated = F.broadcast(repeated)
    rows = pages.join(repeated, digest == F.col("_digest"), "left").select(
        id_col, url_col, payload_col, F.when(~F.col(id_col).eqNullSafe(F.col("_target")), F.col("_target"))
    )

    def archives(it):
        out, path, size, store, done = None, "", 0, None, []
        for batch in it:
            ids, urls, payloads, refers = (batch.column(i).to_pylist() for i in range(4))
            for page in zip(ids, urls, payloads, refers, strict=True):
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root)
                    out, path, size = store.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0
                member = record(page[0], page[1], (page[2] or "").encode(), page[3])
                out.write(member)
                size += len(member)
                if size > ROLL:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "size"]
        )

    tables.bounded(pages.sparkSession)
    return session.materialise(rows.mapInArrow(archives, "path string, size long"), "archives")


def member_at(source, at: int) -> tuple[bytes, int] | None:
    """Whole content of the member at `at` and the place after it; None if there is no
    complete member there that begins with a WARC version line."""
    unpack, out = zlib.decompressobj(31), []
    source.seek(at)
    used = 0
    try:
        while not unpack.eof:
            data = source.read(CHUNK)
            if not data:
                return None
            used += len(data)
            out.append(unpack.decompress(data))
            if not VERSION.startswith(out[0][: len(VERSION)]) or (unpack.eof and not out[0]):
                return None
            if len(out[0]) < len(VERSION):
                out[:] = [b"".join(out)]
    except zlib.error:
        return None
    return b"".join(out), at + used - len(unpack.unused_data)


def members(source, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, stop)."""
    at, held, begin = start, b"", start
    while at < stop:
        # The magic may reach over the end of what is held.
        if not begin <= at < begin + len(held) - len(MAGIC):
            source.seek(at)
            begin, held = at, source.read(min(CHUNK, stop - at + len(MAGIC) - 1))
            if len(held) < len(MAGIC):
                return
        found = held.find(MAGIC, at - begin)
        if found < 0:
            at = begin + len(held) - len(MAGIC) + 1
            continue
        at = begin + found
        if at >= stop:
            return
        member = member_at(source, at)
        if member is None:
            at += 1
        else:
            yield member[0]
            at = member[1]


def parse(content: bytes) -> dict:
    """Fields of a record; of a response the payload is read and hashed."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix(f"<{RECORD}").removesuffix(">")
        return int(text) if text else None

    revisit = fields["WARC-Type"] == "revisit"
    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": stored if revisit else hashlib.sha1(payload).hexdigest(),
        "intact": revisit or (stored == hashlib.sha1(payload).hexdigest() and length == len(payload)),
        "payload": None if revisit else payload,
    }


SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, intact boolean, payload binary"
)


def read(archives: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of the archives (path, size), by ranges of `split` bytes.

    `payload` false leaves that column null. An empty archive has no records; bytes
    that belong to no record are passed over.
    """
    spark: SparkSession = archives.sparkSession
    schema = tables.arrow_schema(spark, SCHEMA)
    n = archives.agg(F.sum(F.ceil(F.col("size") / split)).alias("n")).first().n or 1
    ranges = (
        archives.where("size > 0")
        .select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
        .select("path", "start", F.least(F.col("start") + split, "size").alias("stop"))
        .repartition(min(int(n), TASKS), "path", "start")
    )

    def records(it):
        for batch in it:
            for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_file(name) as source:
                    for content in members(source, start, stop):
                        row = parse(content)
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 1000
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(records, SCHEMA)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages below the shared folder; returns the list of archives.

    A null payload is empty and a null URL an empty one; control characters and spaces of
    a URL are percent-encoded. Of rows with equal id and payload all are responses, or
    all revisits. A null id is smaller than any other; its payload is a response unless
    another id has it too. An empty table gives no archives; other columns are not kept.
    """
    folder = session.scratch_dir(pages.sparkSession, "warc")
    return write(pages, folder, id_col, url_col, payload_col)
