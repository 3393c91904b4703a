"""WARC archives: writing with segments and revisits, reading with reassembly.

A record block longer than a segment is written as a first record and
continuation records.  The reader walks each archive by Content-Length; whole
records are decoded where they are read, and travel on as facts without their
payload.  Segments are grouped by the identifier of their origin, ordered by segment
number, held against the total length, joined, and then freed of chunked transfer
framing.  A revisit is held against the response that it refers to.

Spark's own writer and reader move the archives, so any file system that Spark
knows will do.  A record is at most a segment and a header long and an archive
holds a bounded number of records, so an archive fits in a task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import new_folder, saved

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_ARCHIVE = 2000
#: Repeated payloads are joined by broadcast up to this many rows of about 100 bytes.
BROADCAST_ROWS = 100_000
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; extensions and trailers are passed over.

    Raises ValueError where the framing is broken or ends early.
    """
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(parts)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk shorter than stated")
        parts.append(body[line + 2 : at])
        at += 2


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """(HTTP headers in lower case, decoded payload) of an application/http block."""
    head, _, body = block.partition(END)
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = unchunked(body)
    return headers, body


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [f"{k}: {v}" for k, v in fields]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"])).encode() + END + block


def records_of(page: str, row: int, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    name = f"<urn:page:{page}#{row}>"
    uri = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []
    common = [("WARC-Record-ID", name), *uri, ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = _HTTP + b"Content-Length: %d" % len(payload) + END
        yield record([("WARC-Type", "revisit"), *common, profile, ("WARC-Refers-To", f"<urn:page:{refers_to}>")], block)
        return
    block = _HTTP + b"Transfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common], block)
        return
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], block[:segment])
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == last else []
        own = [("WARC-Record-ID", f"{name[:-1]}/{k}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        yield record([("WARC-Type", "continuation"), *own, *total], block[(k - 1) * segment : k * segment])


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; raises ValueError where the archive is damaged."""
    at = 0
    while at < len(archive):
        head = archive.find(END, at)
        if head < 0 or archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in archive[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        begin = head + 4
        end = begin + int(headers["content-length"])
        if archive[end : end + 4] != END:
            raise ValueError(f"record at byte {at} is not {headers['content-length']} bytes long")
        yield headers, archive[begin:end]
        at = end + 4


def repeated_payloads(pages: DataFrame, least: int = 0) -> DataFrame:
    """(_sha1, _bytes, _response): payloads that several pages have, with the largest page_id."""
    html = F.coalesce(F.col("html"), F.lit(""))
    sums = pages.select("page_id", F.sha1(html.cast("binary")).alias("_sha1"), F.octet_length(html).alias("_bytes")).where(F.col("_bytes") >= least)
    return sums.groupBy("_sha1", "_bytes").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1").drop("_n")


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Archives of all rows of ``pages`` (page_id, url, html) in a new folder ``path``."""
    twice = saved(repeated_payloads(pages, least), "warc-repeated")
    if twice.count() <= BROADCAST_ROWS:
        twice = F.broadcast(twice)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"_sha1": F.sha1(F.col("html").cast("binary")), "_bytes": F.octet_length("html")}).join(twice, ["_sha1", "_bytes"], "left")
    refers = F.when(F.col("page_id") != F.col("_response"), F.col("_response")).cast("long")
    # a page without an id revisits the response of its payload
    refers = F.when(F.col("page_id").isNull(), F.col("_response").cast("long")).otherwise(refers)
    rows = rows.select("page_id", "row", "url", F.col("html").cast("binary").alias("html"), refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                out = []
                for page, row, url, payload, refers_to in zip(*(c.to_pylist() for c in whole.slice(i, 500).columns), strict=True):
                    out += records_of(str(page), row, url, payload, refers_to, segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    # every record closes with two line ends, which are the writer's separator
    records.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


_FACTS = "origin string, kind string, refers_to string, digest string, n long, segment int, total long, block binary"


def read(spark, path: str) -> DataFrame:
    """One row for each page in the archives at ``path``: page_id, payload_bytes,
    payload_digest, record_type, refers_to and ``segments``.

    Fails where a segment is missing, a length or digest differs, or framing is broken.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FACTS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(content.as_py()):
                    kind, number = h["warc-type"], h.get("warc-segment-number")
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if number is not None:
                        total = h.get("warc-segment-total-length")
                        origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                        rows.append((origin, kind, None, stated or None, None, int(number), total and int(total), block))
                    else:
                        rows.append((h["warc-record-id"], kind, h.get("warc-refers-to"), *_checked(kind, stated, block), None, None, None))
                    if len(rows) >= 500:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    grouped = (
        files.mapInArrow(parts, _FACTS)
        .groupBy("origin")
        .agg(
            F.min(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("n").alias("n"),
            F.max("total").alias("total"), F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
        )
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                rows = whole.slice(i, 200).to_pydict()
                sizes, digests = [], []
                for kind, stated, n, total, segments in zip(*(rows[k] for k in ("kind", "digest", "n", "total", "segments")), strict=True):
                    if segments:
                        stated, n = _checked(kind, stated, assembled(segments, total))
                    sizes.append(n)
                    digests.append(stated)
                counts = [max(1, len(s)) for s in rows["segments"]]
                columns = [rows["origin"], sizes, digests, rows["kind"], rows["refers_to"], counts]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
                names = ["origin", "payload_bytes", "payload_digest", "record_type", "target", "segments"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    out = grouped.mapInArrow(joined, "origin string, payload_bytes long, payload_digest string, record_type string, target string, segments int")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:([^#>]*)', 1) AS BIGINT)")
    facts = saved(out.select(number("origin").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("target").alias("refers_to"), "segments"), "warc-read")
    return _held_against_responses(facts)


def _held_against_responses(facts: DataFrame) -> DataFrame:
    """``facts``; fails where the response that a revisit refers to is missing, or has another digest or length."""
    same = F.struct("payload_bytes", "payload_digest")
    # rows that repeat a page_id may be responses of different payloads
    responses = facts.where("record_type = 'response'").groupBy(F.col("page_id").alias("_of")).agg(F.collect_set(same).alias("_payloads"))
    rows = facts.join(responses, F.col("refers_to") == F.col("_of"), "left")
    wrong = F.col("refers_to").isNotNull() & ~F.coalesce(F.array_contains("_payloads", same), F.lit(False))
    message = F.concat(F.lit("revisit without its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return rows.withColumn("payload_bytes", F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.col("payload_bytes"))).select(facts.columns)


def assembled(segments: list[dict], total: int | None) -> bytes:
    """The block of an origin's segments, given in order of their numbers."""
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or total is None:
        raise ValueError("a segment is missing or repeated")
    block = b"".join(s["block"] for s in segments)
    if len(block) != total:
        raise ValueError(f"segments hold {len(block)} bytes of {total}")
    return block


def _checked(kind: str, stated: str | None, block: bytes) -> tuple[str, int]:
    """(digest, bytes) of the full payload of a response or revisit."""
    headers, payload = payload_of(block)
    if kind == "revisit":
        return stated, int(headers["content-length"])
    if (made := digest(payload)) != stated:
        raise ValueError(f"payload digest {made} differs from {stated}")
    return made, len(payload)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all rows of ``pages`` as archives in the shared folder and reads them back.

    * null html is an empty payload; a null url gives no target URI;
    * of equal payloads of at least ``least`` bytes all rows with the largest
      page_id are responses, the others revisit it;
    * rows that repeat a page_id stay apart; a null page_id stays null;
    * an empty table gives no rows.
    """
    path = new_folder(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)
