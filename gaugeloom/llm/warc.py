"""WARC archives with segmented records, written and read back by Spark.

Writing: every page is a response record, or a revisit if another page has the same
payload. A response carries an HTTP message whose body is chunked; a block longer than
``segment`` bytes is split into a first record and continuation records that name it as
their origin. Each record is a gzip member of its own; members of about ``file_bytes`` make a
.warc.gz file, so no reader holds more than that and a record.

Reading: members are parsed one by one, continuations are grouped by origin and put in
order of segment number, the total length is verified and the chunks are decoded.

Files are written by Spark's text sink, so commits, retries and any file system are
Spark's affair. That sink ends each row with a separator; the last byte of a gzip member
is the top byte of its length, zero below 16 MiB, so the separator is that zero byte and
the row the member without it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import shared_folder

SEGMENT = 1 << 20
CHUNK = 1 << 16
END = b"\r\n"


def page_urn(page: object) -> str:
    """An id of any text, escaped; a null id has a name of its own."""
    return "urn:nopage:" if page is None else f"urn:page:{quote(str(page), safe='')}"


def http_message(payload: bytes) -> bytes:
    """A response with the payload in chunks."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    chunks = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return head + b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in chunks) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Decodes chunked framing; trailers after the last chunk are ignored."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != END:
            raise ValueError("a chunk doesn't end where it should")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_records(page: object, url: str | None, payload: bytes, digest: str, refers: object, segment: int) -> Iterator[tuple[int, bytes]]:
    """(segment number, record) of a page."""
    rid = f"<{page_urn(page)}#{uuid.uuid4().hex}>"  # rows that repeat a page_id are records of their own
    common = [("WARC-Target-URI", "".join((url or "about:blank").split())), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield 1, record("revisit", [("WARC-Record-ID", rid), *common, profile, ("WARC-Refers-To", f"<{page_urn(refers)}>"), ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = http_message(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", "1")] if len(pieces) > 1 else []
    yield 1, record("response", [("WARC-Record-ID", rid), *common, *first, ("Content-Type", "application/http;msgtype=response")], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(pieces) else []
        yield i, record("continuation", [("WARC-Record-ID", f"{rid[:-1]}.{i}>"), ("WARC-Segment-Origin-ID", rid), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", str(i)), *last], piece)


def with_referrals(pages: DataFrame, least: int) -> DataFrame:
    """Adds digest and refers_to. Groups of equal payloads are reduced to their smallest page_id by ids and digests alone; the join with these moves each payload once."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    # every page of at least ``least`` bytes meets one row of firsts; a join splits a digest that many pages share
    joined = p.join(firsts, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, segment: int = SEGMENT, file_bytes: int = 64 << 20) -> None:
    """Writes part files of gzip members, each closed by the record that fills ``file_bytes``."""
    if segment > 8 << 20:
        raise ValueError("a record must stay under 16 MiB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True)
            for page, url, payload, digest, refers in rows:
                # one page at a time: a batch of large pages never lies twice in memory
                values, names = [], []
                for _, data in page_records(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), segment):
                    values.append(member(data)[:-1])
                    names.append(f"{part:06d}-{block:06d}")
                    size += len(values[-1])
                    if size >= file_bytes:
                        block, size = block + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(names, pa.string())], ["value", "block"])

    records = with_referrals(pages, least).mapInArrow(run, "value binary, block string")
    # binary as string: Spark keeps the bytes as they are
    records.select(F.col("value").cast("string").alias("value"), "block").write.partitionBy("block").option("lineSep", "\u0000").text(folder)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:n]


def members(content: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        out, step = [], 1 << 16
        while not z.eof:
            if at >= len(view):
                raise ValueError("the last gzip member is cut off")
            out.append(z.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(z.unused_data)
        yield b"".join(out)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: id, origin, segment, total, type, digest, refers_to, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for data in members(content.as_py()):
                    f, block = parse(data)
                    total = f.get("warc-segment-total-length")
                    rows.append((f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 0)), int(total) if total else None, f["warc-type"], f.get("warc-payload-digest"), f.get("warc-refers-to"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["id", "origin", "segment", "total", "type", "digest", "refers_to", "block"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInArrow(run, "id string, origin string, segment int, total long, type string, digest string, refers_to string, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """id, type, refers_to, payload_bytes, payload_digest: one row a record that isn't a continuation.

    Records in one piece are decoded where they are read; a record's segments meet by
    origin, are put in order and their total length is checked. The decoded payload must
    have the digest that its record gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for kind, digest, blocks, numbers, total in zip(*[batch.column(c) for c in ("type", "digest", "blocks", "numbers", "total")], strict=True):
                parts, want = blocks.as_py(), total.as_py()
                if numbers.as_py() not in ([0], [*range(1, len(parts) + 1)]) or (len(parts) > 1 and want != sum(map(len, parts))):
                    raise ValueError("segments are missing, repeated or of the wrong length")
                if kind.as_py() == "revisit":
                    sizes.append(None), digests.append(digest.as_py().removeprefix("sha256:"))
                    continue
                payload = http_payload(b"".join(parts))
                sizes.append(len(payload)), digests.append(hashlib.sha256(payload).hexdigest())
                if digest.as_py() != f"sha256:{digests[-1]}":
                    raise ValueError("a payload doesn't have its digest")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("type"), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests)], ["id", "type", "refers_to", "payload_bytes", "payload_digest"])

    one = records.where("segment = 0").select("id", "type", "refers_to", "digest", F.array("block").alias("blocks"), F.array("segment").alias("numbers"), "total")
    lead = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    ordered = F.sort_array(F.collect_list(F.struct("segment", "block")))
    many = records.where("segment > 0").groupBy("origin").agg(lead("id"), lead("type"), lead("refers_to"), lead("digest"), ordered.alias("parts"), F.max("total").alias("total"))
    many = many.select("id", "type", "refers_to", "digest", F.col("parts.block").alias("blocks"), F.col("parts.segment").alias("numbers"), "total")
    return one.unionByName(many).mapInArrow(run, "id string, type string, refers_to string, payload_bytes long, payload_digest string")


def read_pages(spark: SparkSession, folder: str, page_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives.

    A revisit has no payload of its own; its length is that of the response it names.
    """
    got = reassemble(read_records(spark, folder))
    page = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.expr(f"try_cast(url_decode(regexp_extract({c}, '^<urn:page:([^#>]*)', 1)) as {page_type})"))
    rows = got.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
    sizes = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_n"))
    return rows.join(sizes, "payload_digest", "left").select("page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 100, segment: int = SEGMENT) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back: one row a page.

    A null html is an empty payload, a null url is about:blank. Payloads under ``least``
    bytes are all responses. Of equal payloads the smallest page_id is the response; a
    null page_id is never smallest and is read back as null, any other id as it was. Rows
    that repeat a page_id whole are each a record. A page of any length is one segment
    after another; its task holds it whole, some three times. Other columns are not read.
    An empty table gives empty archives.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, least, segment)
    return read_pages(spark, folder, pages.schema["page_id"].dataType.simpleString())
