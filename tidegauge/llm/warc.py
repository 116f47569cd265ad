"""WARC archives: a writer of one gzip member per record and a splittable reader.

The reader deals byte ranges of archives to tasks. A task scans its range for the gzip magic, takes a candidate as a member only if its header
(of any length) decodes and its stream opens with a WARC version line, and owns every record whose member starts inside the range, reading
on past the range's end to finish the last. A member may hold several records. No index is needed, and any range can be read again elsewhere if
an executor is lost. Archives are reached by their full URIs through pyarrow's file systems (file, HDFS, S3, GCS, ABFS), or through
what a caller gives for a URI, so any executor can read any range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import few, materialise, scratch_path, tidy, utf8

#: Bytes of a range (a task's share), of one read, and of a step in which a candidate is decoded until it shows whether it is a member.
RANGE, READ, PROBE = 16 << 20, 1 << 20, 4096
#: Tasks that ranges are dealt to at most; beyond, a task reads several.
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are never revisits.
REVISIT_FROM = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {clean}')}>"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    block = _HTTP if revisit else _HTTP + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: Gives the file system of a URI, and the path there.
Locate = Callable[[str], tuple[pafs.FileSystem, str]]


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """By pyarrow; Hadoop's names for S3 are taken too."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def _digest(html: Column) -> Column:
    return F.unhex(F.sha2(html, 256))


def first_of_copies(pages: DataFrame) -> DataFrame:
    """(same, first): the smallest page_id of each payload of REVISIT_FROM bytes or more that several pages have, a row for each payload."""
    html = utf8(F.col("html"))
    each = pages.where(F.length(html) >= REVISIT_FROM).groupBy(_digest(html).alias("same"))
    return each.agg(F.min(F.col("page_id").cast("long")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null").drop("copies")


def write_warc(pages: DataFrame, folder: str, locate: Locate = located) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives below the URI `folder`, a file per task; gives the manifest (path, size, records).

    A payload that a smaller page_id has too becomes a revisit record without a body. Repeated rows of one page_id are responses
    or revisits alike. Payloads aren't shuffled while the table of copied payloads is small enough to be broadcast. A task writes under a
    name of its attempt and renames when done, so a retry leaves whole files only; the manifest lists those of the attempts that counted.
    """
    first = few(materialise(first_of_copies(pages), "copies"))
    html = utf8(F.col("html"))
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), _digest(html).alias("digest"))
    row = row.join(first, row["digest"] == first["same"], "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size = records = 0
        with fs.open_output_stream(f"{root}/{name}.tmp", buffer_size=1 << 20) as out:
            for b in batches:
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = member(_record(url, page_id, payload, digest.hex(), refers, refers is not None))
                    out.write(data)
                    size, records = size + len(data), records + 1
        fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "size", "records"])

    cols = row.select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))
    return materialise(cols.mapInArrow(tidy(write), "path string, size long, records long"), "manifest")


class _Reader:
    """Sequential bytes of an open archive from a place on; what is still needed is held, and dropped when more is read."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.used = file, at, bytearray(), 0
        file.seek(at)

    def __len__(self) -> int:
        return len(self.held) - self.used

    def more(self) -> bool:
        del self.held[: self.used]
        self.used = 0
        got = self.file.read(READ)
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.used, self.at = self.used + n, self.at + n

    def find(self, what: bytes) -> int:
        return max(-1, self.held.find(what, self.used) - self.used)

    def part(self, at: int, n: int) -> bytes:
        return bytes(self.held[self.used + at : self.used + at + n])


def _member_at(r: _Reader) -> bytes | None:
    """The content of the member that begins here, and r behind it; None, with r unmoved, if none that holds a WARC record begins here."""
    z, out, fed = zlib.decompressobj(31), bytearray(), 0
    while len(head := out.lstrip(b"\r\n")) < 5:
        if z.eof or fed == len(r) and not r.more():
            return None
        piece = r.part(fed, PROBE)
        fed += len(piece)
        try:
            out += z.decompress(piece)
        except zlib.error:
            return None
    if not head.startswith(b"WARC/"):
        return None
    place = r.at
    while not z.eof:
        if fed == len(r):
            r.skip(fed)
            fed = 0
            if not r.more():
                raise EOFError(f"the archive ends inside the member at {place}")
        piece = r.part(fed, READ)
        fed += len(piece)
        out += z.decompress(piece)
    r.skip(fed - len(z.unused_data))
    return bytes(out)


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each member that starts in [start, end)."""
    r = _Reader(file, start)
    while r.at < end:
        i = r.find(MAGIC)
        if i < 0:
            r.skip(max(0, len(r) - len(MAGIC) + 1))
            if not r.more():
                return
            continue
        r.skip(i)
        if r.at >= end:
            return
        place, content = r.at, _member_at(r)
        if content is None:
            r.skip(1)
        else:
            yield place, content


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a member: its header fields (lower-case names) and its payload, the HTTP body of an http block, else the block."""
    at = 0
    while True:
        while content[at : at + 1] in (b"\r", b"\n") and at < len(content):
            at += 1
        if at == len(content):
            return
        stop = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or stop < 0:
            raise ValueError("what follows a record of the member is no record")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = stop + 4
        at = min(len(content), begin + int(fields["content-length"])) if "content-length" in fields else len(content)
        block = content[begin:at]
        yield fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def read_warc(manifest: DataFrame, byte_range: int = RANGE, locate: Locate = located) -> DataFrame:
    """One row per record of the archives in manifest(path, size): page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    payload is null for revisits, whose length and digest come from their header; those of responses are the payload's own. Ranges are
    split by the JVM from the manifest's sizes; the archives themselves need not be listed or indexed. path is a full URI or a local path. A revisit
    without the fields that this writer adds has a null payload_bytes, and the digest that it names.
    """
    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(byte_range).cast("long"))).alias("start"))
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                fs, at = locate(path)
                with fs.open_input_file(at) as file:
                    for h, payload in (r for _, content in members(file, start, min(size, start + byte_range)) for r in records(content)):
                        revisit = h.get("warc-type") == "revisit"
                        length = h.get("x-payload-length")
                        n = (int(length) if length else None) if revisit else len(payload)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, h.get("warc-target-uri"), h.get("warc-type"), int(refers) if refers else None, None if revisit else payload, n, digest))
                        held += 0 if revisit else len(payload)
                        if held > 8 << 20 or len(rows) > 5000:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    tasks = manifest.agg(F.sum(F.ceil(F.col("size") / byte_range))).first()[0]
    return ranges.repartition(int(min(max(tasks or 1, 1), MOST_TASKS)), "path", "start").mapInArrow(tidy(run), schema)


def warc_round_trip(pages: DataFrame, byte_range: int = RANGE) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, one row per page.

    Null html counts as empty. A null page_id is written without one; it revisits the smallest id with its payload, or responds if there is
    none. Repeated rows are records like others; a payload of any length is one record. Other columns of any name are ignored; an empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    manifest = write_warc(pages, scratch_path(spark, "warc"))
    return read_warc(manifest, byte_range).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
