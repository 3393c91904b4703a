"""MPEG audio columns: frames, tags, variable-bitrate tables and checksums.

``parsed`` reads binary columns that hold MPEG audio.  Frame headers are found
again after junk (a header counts where the next frame, the end or a trailing
tag follows at its length, or where it is like the frame that ends before it), ID3v2
and ID3v1 tags and Xing, Info and VBRI tables are parsed, the CRC of protected frames
of all three layers is verified over the bits that it covers, and durations come from
the frames that are there, not from a bitrate estimate.

``stored`` makes such a column from payloads: a silent layer III stream at 32 kHz
whose frames carry the payload as ancillary data behind empty granules.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import new_folder

# Fixed values of the format: kbit/s by (MPEG 1?, layer), Hz by version.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}

SEEK_EVERY = 64
PAYLOAD_UNIT = 64


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int

    @property
    def kind(self) -> tuple:
        """What does not change from frame to frame of a stream."""
        return self.version, self.layer, self.protected, self.rate, self.mono

    @property
    def side(self) -> int:
        """Bytes of side information of a layer III frame."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free format included)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate_at, rate_of = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or rate_at in (0, 15) or rate_of == 3:
        return None
    kbps, rate, pad = KBPS[version == "1", layer][rate_at], RATES[version][rate_of], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == "1" else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mode = four[3] >> 6
    bound = 4 * (four[3] >> 4 & 3) + 4 if mode == 1 else 32  # from there on both channels share their allocation
    return Header(version, layer, not four[1] & 1, kbps, rate, mode == 3, size, samples, bound)


@cache
def _crc_table() -> tuple[int, ...]:
    table = []
    for value in range(256):
        value <<= 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return tuple(table)


@lru_cache(maxsize=4096)
def crc16(covered: bytes, bits: int | None = None) -> int:
    """The checksum of the first ``bits`` of ``covered``, of all of it by default."""
    table, value = _crc_table(), 0xFFFF
    whole, rest = divmod(8 * len(covered) if bits is None else bits, 8)
    for b in covered[:whole]:
        value = (value << 8 & 0xFF00) ^ table[value >> 8 ^ b]
    for k in range(rest):
        top = value >> 15 ^ covered[whole] >> 7 - k & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


# Fixed values of layer II: bits of the allocation of each run of subbands.
_ALLOCATION_2 = {"full": ((11, 4), (12, 3), (7, 2)), "low": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _allocation_bits(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer I or II frame."""
    if h.layer == 1:
        return [4] * 32
    each = h.kbps // (1 if h.mono else 2)
    if h.version != "1":
        kind, bands = "lsf", 30
    elif each < 56:
        kind, bands = "low", 12 if h.rate == 32000 else 8
    else:
        kind, bands = "full", 30 if each >= 96 and h.rate != 48000 else 27
    return [bits for n, bits in _ALLOCATION_2[kind] for _ in range(n)][:bands]


def covered_bits(h: Header, body: bytes) -> int:
    """How many bits of ``body``, what follows the checksum, it covers."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    value, total, at, used = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512, 0, 0
    for band, bits in enumerate(_allocation_bits(h)):
        shared = band >= h.bound
        for _ in range(1 if shared or channels == 1 else 2):
            code = value >> (total - at - bits) & ((1 << bits) - 1)
            used += (channels if shared else 1) * (code > 0)
            at += bits
    return at + (2 * used if h.layer == 2 else 0)  # layer II: and how scale factors are shared, for what is allocated


def _synchsafe(four: bytes) -> int:
    return (four[0] & 127) << 21 | (four[1] & 127) << 14 | (four[2] & 127) << 7 | four[3] & 127


@dataclass
class Stream:
    """What is in one MPEG audio column value."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_wrong: int = 0
    crc_seen: int = 0
    junk: int = 0
    table: dict[str, int] | None = None
    toc: list[int] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum(n / rate for rate, n in sorted(by_rate.items()))


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The length of the ID3v2 tag at ``at``, 0 if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and len(body) >= 4:  # an extended header: its size counts itself from version 4 on
        p = _synchsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while p + head <= len(body) and body[p] != 0:
        name = body[p : p + wide].decode("latin-1")
        length = body[p + wide : p + 2 * wide]
        n = _synchsafe(length) if major >= 4 else int.from_bytes(length, "big")
        part = body[p + head : p + head + n]
        if major >= 4 and (flags & 0x80 or body[p + 9] & 2):
            part = part.replace(b"\xff\0", b"\xff")
        if major >= 4 and body[p + 9] & 1:
            part = part[4:]  # the length before unsynchronisation
        if name[:1] == "T" and part:
            text = part[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(part[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.rstrip("\0")
        p += head + n
    return 10 + size + (10 if flags & 0x10 and major >= 4 else 0)


def _vbr_table(data: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]] | None:
    """The variable-bitrate table that the frame at ``at`` holds, and its offsets; None for a frame of sound."""
    p = at + 4 + 2 * h.protected + h.side
    number = lambda a, n=4: int.from_bytes(data[a : a + n], "big")
    if (mark := data[p : p + 4]) in (b"Xing", b"Info"):
        flags, table = number(p + 4), {"vbr": int(mark == b"Xing")}
        p += 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[key] = number(p)
                p += 4
        return table, list(data[p : p + 100]) if flags & 4 else []
    if data[at + 36 : at + 40] == b"VBRI":
        p = at + 36
        entries, scale, wide = number(p + 18, 2), number(p + 20, 2), number(p + 22, 2)
        toc, seen = [], 0
        for k in range(entries if 0 < wide <= 4 else 0):
            seen += number(p + 26 + k * wide, wide) * scale
            toc.append(seen)
        return {"vbr": 1, "bytes": number(p + 10), "frames": number(p + 14)}, toc
    return None


def parse(data: bytes) -> Stream:
    """All frames of ``data``; bytes that belong to no frame or tag count as junk."""
    out, n = Stream(), len(data)
    at = _id3v2(data, 0, out.tags)
    end = n
    if n - at >= 128 and data[n - 128 : n - 125] == b"TAG":
        end = n - 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags.setdefault(key, text)
    synced: Header | None = None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end:
            ok = False
        else:
            after = at + h.size
            # before junk no frame follows: then a header counts that is like the one before
            ok = after == end or header(data[after : after + 4]) is not None or (synced is not None and synced.kind == h.kind)
        if not ok:
            synced = None
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.junk += nxt - at
            at = nxt
            continue
        if h.protected:
            out.crc_seen += 1
            body = data[at + 6 : after]
            bits = covered_bits(h, body)
            out.crc_wrong += crc16(data[at + 2 : at + 4] + body[: (bits + 7) // 8], 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not out.offsets and out.table is None and (held := _vbr_table(data, at, h)) is not None:
            out.table, out.toc = held
        else:
            out.offsets.append(at)
            out.headers.append(h)
        at += h.size
        synced = h
    out.junk += max(0, end - at)
    return out


# Writing: MPEG 1 layer III, 32 kHz, mono, CRC on; whole frame lengths at this rate.
_FIXED = 4 + 2 + 17


@cache
def _heads() -> tuple[tuple[int, bytes], ...]:
    """(payload bytes, header with CRC and empty side information), by size."""
    heads = []
    for at, kbps in enumerate(KBPS[True, 3][1:], 1):
        four = bytes((0xFF, 0xFA, at << 4 | 2 << 2, 3 << 6))
        head = four + crc16(four[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)
        heads.append((144 * kbps // 32 - _FIXED, head))
    return tuple(heads)


def write(payload: bytes, unpadded: int) -> bytes:
    """An MPEG stream that carries ``payload``; its length and ``unpadded`` go into a tag."""
    heads = _heads()
    room, largest = heads[-1]
    frames = []
    for i in range(0, len(payload), room):
        part = payload[i : i + room]
        space, head = (room, largest) if len(part) == room else next(x for x in heads if x[0] >= len(part))
        frames.append(head + part.ljust(space, b"\0"))
    total = sum(map(len, frames))
    ends, seen = [], 0
    for f in frames:
        ends.append(seen)
        seen += len(f)
    toc = bytes(min(255, 256 * ends[min(len(ends) - 1, i * len(ends) // 100)] // max(total, 1)) if ends else 0 for i in range(100))
    space, head = next(x for x in heads if x[0] >= 120)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\3payload\0" + f"{len(payload)} {unpadded}".encode()
    frame = b"TXXX" + bytes((0, 0, 0, len(text))) + b"\0\0" + text
    tag = b"ID3\4\0\0" + bytes((0, 0, len(frame) >> 7, len(frame) & 127)) + frame
    last = b"TAG" + b"stored payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return b"".join((tag, head, xing.ljust(space, b"\0"), *frames, last))


def payload_of(data: bytes, stream: Stream) -> tuple[bytes, int]:
    """(payload, unpadded length) of what ``write`` made; raises if bytes are missing."""
    size, unpadded = map(int, stream.tags["payload"].split())
    parts = (data[a + _FIXED : a + h.size] for a, h in zip(stream.offsets, stream.headers, strict=True))
    payload = b"".join(parts)[:size]
    if len(payload) != size or stream.crc_wrong or stream.junk:
        raise ValueError("the stored audio is damaged")
    return payload, unpadded


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b"\0"), len(raw)


def feature(s: Stream) -> str:
    frames = len(s.headers)
    kbps = sum(h.kbps for h in s.headers) / max(frames, 1)
    h = s.headers[0] if frames else None
    kind = f"MPEG-{h.version} layer {h.layer} {h.rate} Hz" if h else "none"
    vbr = int(bool(s.table and s.table["vbr"]))
    return f"{kind}; frames={frames}; seconds={s.seconds:.3f}; kbps={kbps:.1f}; vbr={vbr}; crc={s.crc_seen - s.crc_wrong}/{s.crc_seen}; last_frame={s.offsets[-1] if frames else -1}"


def _map(df: DataFrame, kind: str, fields: list[tuple[str, pa.DataType, str]], of) -> DataFrame:
    """doc_id and what ``of`` makes of the second column, streamed a few rows at a time."""
    schema = pa.schema([pa.field(n, t) for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                rows = [of(x.as_py()) for x in b.column(1)]
                columns = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *schema.names])

    return df.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {s}" for n, _, s in fields)]))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media) with the text of each row as an MPEG stream; a null text is empty."""
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return _map(rows, docs.schema["doc_id"].dataType.simpleString(), [("media", pa.binary(), "binary")], lambda text: (write(*padded(text)),))


SEEK = pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64())]))
SEEK_SQL = "array<struct<sample:long,offset:long>>"


def seek_points(s: Stream) -> tuple[int, list[dict[str, int]]]:
    """(samples in all, (first sample, byte offset) of every ``SEEK_EVERY``-th frame)."""
    samples, seek = 0, []
    for i, (a, h) in enumerate(zip(s.offsets, s.headers, strict=True)):
        if i % SEEK_EVERY == 0:
            seek.append({"sample": samples, "offset": a})
        samples += h.samples
    return samples, seek


def parsed(media: DataFrame) -> DataFrame:
    """One row of facts for each row of ``media`` (doc_id, media); null media is empty.

    ``seek`` holds (first sample, byte offset) of every ``SEEK_EVERY``-th frame.
    """

    def facts(data: bytes | None) -> tuple:
        s = parse(data or b"")
        samples, seek = seek_points(s)
        return len(s.headers), samples, s.seconds, s.crc_seen, s.crc_wrong, s.junk, list(s.tags.items()), seek

    fields = [
        ("frames", pa.int64(), "long"), ("samples", pa.int64(), "long"), ("seconds", pa.float64(), "double"), ("crc_seen", pa.int64(), "long"), ("crc_wrong", pa.int64(), "long"),
        ("junk_bytes", pa.int64(), "long"), ("tags", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("seek", SEEK, SEEK_SQL),
    ]
    return _map(media.select("doc_id", "media"), media.schema["doc_id"].dataType.simpleString(), fields, facts)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text as audio in the shared folder, reads it back and digests it.

    One row for each row of ``docs``; null and empty texts are 64 zero bytes.
    ``samples`` over ``sample_rate`` is the exact duration; ``seek`` as in :func:`parsed`.
    """
    path = new_folder(docs.sparkSession, "mpeg")
    media = stored(docs)
    media.write.option("compression", "zstd").parquet(path)

    def digest(data: bytes) -> tuple:
        s = parse(data)
        payload, unpadded = payload_of(data, s)
        samples, seek = seek_points(s)
        return (
            unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(s),
            len(s.headers), samples, s.headers[0].rate, seek,
        )

    fields = [
        ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"),
        ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"),
        ("frames", pa.int64(), "long"), ("samples", pa.int64(), "long"), ("sample_rate", pa.int64(), "long"), ("seek", SEEK, SEEK_SQL),
    ]
    read = docs.sparkSession.read.schema(media.schema).parquet(path)
    return _map(read, media.schema["doc_id"].dataType.simpleString(), fields, digest)
