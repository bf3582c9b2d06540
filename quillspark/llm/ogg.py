"""Ogg media columns: write, verify, reassemble, demultiplex and time logical streams.

A payload of bytes is kept losslessly as 8-bit samples. It is cut into packets,
dealt in turn to the logical streams of one physical Ogg stream, and read back
from the stored bytes alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

# Fixed values of the format.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
MOST_SEGMENTS = 255

#: The packet that opens a logical stream: mark, version, streams in all, place of this one, samples a second.
OPENING = struct.Struct("<8sBBBI")
MARK = b"PCM8\x00\x00\x00\x00"
RATE, STREAMS, PACKET = 8000, 2, 4000
ALIGN = 64

#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a whole, intact Ogg stream."""


def page_checksum(page: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, most significant bit first, from 0 and without a final inversion.

    zlib's CRC has the same polynomial with bits reversed, so that it runs over reversed bytes.
    """
    got = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(REVERSED), "big")


def lacing(n: int) -> list[int]:
    """Segment sizes of a packet of n bytes: 255 as often as it fits, then the rest (0 to 254)."""
    return [255] * (n // 255) + [n % 255]


def page(serial: int, number: int, flags: int, granule: int, segments: list[int], body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(segments)) + bytes(segments)
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


class Writer:
    """Pages of one logical stream; a page is full at 255 segments, and packets go on over pages."""

    def __init__(self, serial: int):
        self.serial, self.number, self.continued = serial, 0, False
        self.segments: list[int] = []
        self.body: list[bytes] = []
        self.granule = NO_GRANULE

    def flush(self, flags: int = 0) -> bytes:
        out = page(self.serial, self.number, flags | (CONTINUED if self.continued else 0), self.granule, self.segments, b"".join(self.body))
        self.number += 1
        self.continued = bool(self.segments) and self.segments[-1] == 255
        self.segments, self.body, self.granule = [], [], NO_GRANULE
        return out

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        at = 0
        for n in lacing(len(data)):
            if len(self.segments) == MOST_SEGMENTS:
                yield self.flush()
            self.segments.append(n)
            self.body.append(data[at : at + n])
            at += n
        self.granule = granule


def store(payload: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload as an Ogg stream. Packet i goes to logical stream i mod streams; granule positions count the stream's own samples."""
    writers, out, samples = [Writer(i + 1) for i in range(streams)], [], [0] * streams
    for i, w in enumerate(writers):
        out += w.packet(OPENING.pack(MARK, 1, streams, i, rate), 0)
        out.append(w.flush(FIRST))
    for i, at in enumerate(range(0, len(payload), packet)):
        w = writers[i % streams]
        data = payload[at : at + packet]
        samples[i % streams] += len(data)
        out += w.packet(data, samples[i % streams])
        if len(w.segments) > 200:
            out.append(w.flush())
    out += [w.flush(LAST) for w in writers]
    return b"".join(out)


@dataclass
class Logical:
    """A logical stream as read: its packets with the granule position known at their end (or none) and its page count."""

    packets: list[tuple[bytes, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] = field(default_factory=list)
    granule: int = 0


def demultiplex(media: bytes) -> dict[int, Logical]:
    """Verifies every page and reassembles the packets of each logical stream by serial number.

    Raises OggError on a bad capture pattern, version, checksum, page order,
    continuation or a cut-off end. The last packet that ends in a page has its
    granule position; earlier ones of the page have NO_GRANULE.
    """
    at, found = 0, {}
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("cut-off header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        sizes = media[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(sizes)
        if capture != CAPTURE or version or len(sizes) < n or end > len(media):
            raise OggError("bad page")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError("bad checksum")
        if flags & FIRST:
            if serial in found:
                raise OggError("a serial number opens twice")
            found[serial] = Logical()
        s = found.get(serial)
        if s is None or s.ended or s.pages != number or bool(flags & CONTINUED) != bool(s.part):
            raise OggError("pages out of order")
        s.pages, s.ended, last = number + 1, bool(flags & LAST), None
        start = here = body
        for size in sizes:
            here += size
            if size < 255:
                s.packets.append((b"".join([*s.part, media[start:here]]), NO_GRANULE))
                s.part, start, last = [], here, len(s.packets) - 1
        if start < here:
            s.part.append(media[start:here])
        if last is not None and granule != NO_GRANULE:
            s.packets[last] = (s.packets[last][0], granule)
        if granule != NO_GRANULE:
            s.granule = granule
        at = end
    if any(not s.ended or s.part for s in found.values()):
        raise OggError("a stream has no end")
    return found


def codec(opening: bytes) -> tuple[str, int]:
    """Name and granules a second that a stream's first packet tells; ("", 0) where it is of no known kind."""
    if opening.startswith(MARK) and len(opening) == OPENING.size:
        return "pcm8", OPENING.unpack(opening)[4]
    if opening.startswith(b"\x01vorbis") and len(opening) >= 16:
        return "vorbis", struct.unpack_from("<I", opening, 12)[0]
    if opening.startswith(b"OpusHead"):
        return "opus", 48_000
    if opening.startswith(b"Speex   ") and len(opening) >= 40:
        return "speex", struct.unpack_from("<I", opening, 36)[0]
    return "", 0


def packet_times(s: Logical) -> list[tuple[float | None, float | None]]:
    """Start and end second of each packet of a stream, from the granule positions of its pages and its rate.

    A granule position is the time at the end of the last packet that ends in
    its page. A packet of 8-bit samples has as many granules as bytes, so that
    times go backward from there, packet by packet, to the page before; a
    stream may begin at any time. Of other codecs only ends that pages tell are
    known. Headers (granule position 0 and no samples) have no times.
    """
    name, rate = codec(s.packets[0][0]) if s.packets else ("", 0)
    times: list[tuple[float | None, float | None]] = [(None, None)] * len(s.packets)
    if not rate:
        return times
    end = None
    for i in range(len(s.packets) - 1, 0, -1):
        data, granule = s.packets[i]
        if granule != NO_GRANULE:
            if name == "pcm8" and end is not None and end != granule:
                raise OggError("granule positions disagree")
            end = granule
        if end is None:
            continue
        start = end - len(data) if name == "pcm8" else None
        times[i] = (None if start is None else start / rate, end / rate)
        end = start
    return times


def timed(media: bytes) -> tuple[bytes, list[tuple[int, int, float, float]], dict[int, Logical]]:
    """The payload that ``store`` kept, (serial, packet, start and end second) of each packet, and the logical streams.

    The opening packets say in which turn the streams' packets stand; times come from each stream's granule positions.
    """
    streams = demultiplex(media)
    opened = [(OPENING.unpack(s.packets[0][0]), serial) for serial, s in streams.items() if s.packets and codec(s.packets[0][0])[0] == "pcm8"]
    opened.sort(key=lambda x: x[0][3])
    if not opened or [x[0][3] for x in opened] != list(range(len(streams))) or any(x[0][2] != len(streams) for x in opened):
        raise OggError("bad opening packets")
    turns = [list(zip(streams[serial].packets[1:], packet_times(streams[serial])[1:], strict=True)) for _, serial in opened]
    payload, times = [], []
    for i in range(sum(map(len, turns))):
        own = turns[i % len(turns)]
        if i // len(turns) >= len(own):
            raise OggError("a packet is missing")
        (data, _), (start, end) = own[i // len(turns)]
        if end is None:
            raise OggError("a packet has no time")
        times.append((opened[i % len(turns)][1], i // len(turns), start, end))
        payload.append(data)
    return b"".join(payload), times, streams


PACKETS = "array<struct<serial: bigint, packet: bigint, codec: string, bytes: bigint, start: double, end: double, data: binary>>"


def read_media(rows: DataFrame, media_col: str = "media", with_data: bool = True) -> DataFrame:
    """rows with ``packets`` (serial, packet, codec, bytes, start and end second, data) and ``error`` of a binary column of Ogg.

    Any Ogg is read: pages are verified, packets put together and streams told
    apart; ``packet_times`` says which times are known. A row whose bytes are no
    whole, intact Ogg gets the reason in ``error`` and null packets; null bytes
    give null in both. Columns of rows named packets or error are not allowed.
    """
    if {"packets", "error"} & set(rows.columns):
        raise ValueError("rows has a column named packets or error")
    kind = pa.list_(pa.struct([("serial", pa.int64()), ("packet", pa.int64()), ("codec", pa.string()), ("bytes", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("data", pa.binary())]))

    def one(media: bytes | None) -> tuple[list | None, str | None]:
        if media is None:
            return None, None
        try:
            streams = demultiplex(media)
            return [
                {"serial": serial, "packet": i, "codec": codec(s.packets[0][0])[0], "bytes": len(data), "start": start, "end": end, "data": data if with_data else None}
                for serial, s in streams.items()
                for i, ((data, _), (start, end)) in enumerate(zip(s.packets, packet_times(s), strict=True))
            ], None
        except OggError as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                got = [one(x.as_py()) for x in part.column(media_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], pa.string())], names=[*part.schema.names, "packets", "error"])

    own = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"packets {PACKETS}, error string").fields])
    return rows.mapInArrow(run, own)


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % ALIGN or (0 if data else ALIGN))


def features(payload: bytes, times: list, streams: dict[int, Logical]) -> str:
    """Counts of the container, duration and mean, root mean square and crossings of the middle of the samples read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    pages = sum(s.pages for s in streams.values())
    return (
        f"streams={len(streams)};pages={pages};packets={len(times)};seconds={max(t[3] for t in times):.6f};last_start={max(t[2] for t in times):.6f};"
        f"mean={x.mean():.6f};rms={np.sqrt(np.square(x).mean()):.6f};crossings={crossings}"
    )


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def media_column(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each row's text stored as Ogg and what is read back from the stored bytes.

    Null counts as the empty text, whose payload is 64 bytes 0. Equal texts
    give equal values; repeated rows stay. media holds the stored bytes (null
    unless with_media). Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, out = b.slice(at, 500), []
                for data in part.column("utf8"):
                    data = data.as_py()
                    media = store(padded(data))
                    payload, times, streams = timed(media)
                    sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:])
                    out.append((len(data), len(payload), *sums, len(media), hashlib.sha256(media).hexdigest(), features(payload, times, streams), media if with_media else None))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("utf8"))
    return rows.mapInArrow(run, MEDIA_SCHEMA)


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(documents(spark, sf_dir), with_media=False).drop("media")
