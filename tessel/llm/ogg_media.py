"""Ogg media columns: write pages, verify their checksums, reassemble packets, demultiplex streams, derive timestamps.

A container is a run of pages. A page belongs to one logical stream (serial), states how its body divides into packets
by lacing values (a packet ends at the first value below 255 and may go on in the next page of its stream), and carries
the granule position, here the number of samples that the packets ending on it complete.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
RATE = 8000
#: Samples in a packet of the sound stream, and packets that one packet of the index stream describes.
PACKET, INDEX_EVERY = 4000, 16
SOUND, INDEX = 0x534E4431, 0x494E4458
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The container's checksum: polynomial 04C11DB7, most significant bit first, from zero.

    It is the bit mirror of zlib's checksum of the mirrored bytes, with zlib's inversions undone.
    """
    return int(f"{zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Packet:
    data: bytes
    #: Samples completed at its end, or -1 where the stream doesn't tell.
    granule: int = -1


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    #: Packets of which a part is missing.
    broken: int = 0


@dataclass
class Container:
    streams: dict[int, Stream]
    pages: int
    #: Pages whose checksum, version or lacing is wrong, and bytes between pages.
    bad_pages: int
    skipped: int


class Paginator:
    """Turns the packets of one logical stream into pages; a page goes out at 255 lacing values or on flush."""

    def __init__(self, serial: int):
        self.serial, self.seq, self.lacing, self.body, self.granule, self.open, self.carried = serial, 0, [], [], -1, False, False

    def put(self, data: bytes, granule: int) -> Iterator[bytes]:
        at, values = 0, [255] * (len(data) // 255) + [len(data) % 255]
        while values:
            room = 255 - len(self.lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            self.lacing += now
            self.body.append(data[at : at + size])
            at += size
            self.open = bool(values)
            if not values:
                self.granule = granule
            if len(self.lacing) == 255:
                yield self.page()

    def page(self, last: bool = False) -> bytes:
        kind = CONTINUED * self.carried | FIRST * (self.seq == 0) | LAST * last
        rest = bytes(self.lacing) + b"".join(self.body)
        head = _HEAD.pack(CAPTURE, 0, kind, self.granule, self.serial, self.seq, 0, len(self.lacing))
        crc = page_crc(head + rest)
        self.seq, self.lacing, self.body, self.granule, self.carried = self.seq + 1, [], [], -1, self.open
        return head[:22] + struct.pack("<I", crc) + head[26:] + rest


def write_ogg(samples: bytes, rate: int = RATE) -> bytes:
    """A container of two multiplexed streams: the samples, and an index with position and checksum of each stretch."""
    sound, index, out = Paginator(SOUND), Paginator(INDEX), []
    out += sound.put(b"\x01sound8\0" + struct.pack("<II", rate, PACKET), 0)
    out.append(sound.page())
    out += index.put(b"\x01index\0\0" + struct.pack("<I", INDEX_EVERY), 0)
    out.append(index.page())
    step = PACKET * INDEX_EVERY
    for start in range(0, len(samples), step):
        stretch = samples[start : start + step]
        for at in range(0, len(stretch), PACKET):
            out += sound.put(stretch[at : at + PACKET], min(start + at + PACKET, len(samples)))
        end = start + len(stretch)
        out += index.put(struct.pack("<QQI", start, end, zlib.crc32(stretch)), end)
        if end < len(samples):
            out.append(index.page())
    out += [sound.page(last=True), index.page(last=True)]
    return b"".join(out)


def read_ogg(data: bytes) -> Container:
    """Parse a container. A damaged page is left out: reading resumes at the next capture pattern, and packets that
    lost a part count as broken. Empty input has no streams."""
    streams: dict[int, Stream] = {}
    part: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    at = pages = bad = skipped = 0
    while at < len(data):
        found = data.find(CAPTURE, at)
        if found < 0:
            skipped += len(data) - at
            break
        skipped += found - at
        at = found
        if at + 27 > len(data):
            bad += 1
            break
        _, version, kind, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        stream = streams.setdefault(serial, Stream())
        pages += 1
        stream.pages += 1
        held = part.pop(serial, None)
        if held is not None and (expected[serial] != seq or not kind & CONTINUED):
            stream.broken += 1
            held = None
        expected[serial] = seq + 1
        lost = bool(kind & CONTINUED) and held is None
        pieces, pos, size, done = held or [], at + 27 + n, 0, []
        for value in lacing:
            size += value
            if value < 255:
                pieces.append(data[pos : pos + size])
                pos, size = pos + size, 0
                if lost:
                    stream.broken += 1
                    lost = False
                else:
                    done.append(Packet(b"".join(pieces)))
                pieces = []
        if n and lacing[-1] == 255 and not lost:
            part[serial] = [*pieces, data[pos : pos + size]]
        if done and granule >= 0:
            done[-1].granule = granule
        stream.packets += done
        stream.ended |= bool(kind & LAST)
        at = end
    for serial, held in part.items():
        streams[serial].broken += held is not None
    return Container(streams, pages, bad, skipped)


def packet_times(stream: Stream, rate: int = RATE) -> list[tuple[float, float]]:
    """Start and end in seconds of each data packet: positions on pages fix some ends, packet lengths give the rest."""
    ends = [0] * len(stream.packets)
    known = None
    for i in range(len(stream.packets) - 1, -1, -1):
        p = stream.packets[i]
        known = p.granule if p.granule >= 0 else known
        ends[i] = known if known is not None else -1
        known = None if known is None else known - len(p.data)
    at = 0
    for i, p in enumerate(stream.packets):
        ends[i] = ends[i] if ends[i] >= 0 else at + len(p.data)
        at = ends[i]
    return [((e - len(p.data)) / rate, e / rate) for e, p in zip(ends, stream.packets)]


def sound_of(box: Container) -> tuple[bytes, list[tuple[float, float]]]:
    """The samples of the sound stream and the times of its packets, held against the index stream."""
    sound = Stream(box.streams[SOUND].packets[1:]) if SOUND in box.streams else Stream()
    samples = b"".join(p.data for p in sound.packets)
    for p in box.streams[INDEX].packets[1:] if INDEX in box.streams else []:
        start, end, crc = struct.unpack("<QQI", p.data)
        if zlib.crc32(samples[start:end]) != crc:
            raise ValueError(f"samples {start} to {end} differ from the index stream")
    return samples, packet_times(sound)


def features(samples: bytes, box: Container, times: list[tuple[float, float]]) -> str:
    """Whole-number features: pages and packets, length in ms, mean, power, zero crossings, eight envelope means."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    edges = np.arange(8) * len(x) // 8
    envelope = np.add.reduceat(np.abs(x), edges) // max(1, len(x) // 8)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    values = {"pages": box.pages, "packets": sum(len(s.packets) for s in box.streams.values()), "ms": round(times[-1][1] * 1000), "mean": int(x.sum() * 1000 // len(x)), "power": int((x * x).sum() // len(x)), "crossings": crossings}
    return ";".join(f"{k}={v}" for k, v in values.items()) + ";envelope=" + ",".join(map(str, envelope.tolist()))


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long, duration_s double"


def ogg_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = False) -> DataFrame:
    """Store each whole text as 8-bit samples in a container, read the container back and describe it.

    A null or empty text is 64 zero samples. Equal texts give equal values; repeated rows give repeated results, and a
    null key stays null. with_media adds the container as media (binary). Other columns are ignored.
    """
    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    schema = f"k {source.schema['k'].dataType.simpleString()}, {_SCHEMA}" + (", media binary" if with_media else "")

    def row(value: str | None) -> dict:
        payload, n = padded(value)
        media = write_ogg(payload)
        box = read_ogg(media)
        samples, times = sound_of(box)
        out = {"n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(samples, box, times), "bad_pages": box.bad_pages, "duration_s": times[-1][1]}
        return out | ({"media": media} if with_media else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                table = pa.Table.from_pylist([row(t) for t in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("k"), *[c.combine_chunks() for c in table.columns]], ["k", *table.column_names])

    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


def parse_media(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of each container: key, serial, packet number, start and end in seconds (null outside the
    sound stream), data; and the container's pages and damaged pages. A null container has no rows."""
    source = media.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").alias("m")).filter("m IS NOT NULL")
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", source_type), ("serial", pa.int64()), ("packet", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("data", pa.binary()), ("pages", pa.int64()), ("bad_pages", pa.int64())])
        for batch in batches:
            for k, m in zip(batch.column("k").to_pylist(), batch.column("m").to_pylist()):
                box = read_ogg(m)
                for serial, stream in sorted(box.streams.items()):
                    times = [(None, None), *packet_times(Stream(stream.packets[1:]))] if serial == SOUND else [(None, None)] * len(stream.packets)
                    rows = [{"k": k, "serial": serial, "packet": i, "start_s": a, "end_s": b, "data": p.data, "pages": box.pages, "bad_pages": box.bad_pages} for i, (p, (a, b)) in enumerate(zip(stream.packets, times))]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    source_type = to_arrow_type(source.schema["k"].dataType)
    return source.mapInArrow(run, f"k {kind}, serial long, packet long, start_s double, end_s double, data binary, pages long, bad_pages long").withColumnRenamed("k", key)
