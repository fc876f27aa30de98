"""Ogg media columns (operator 9).

Writing: a payload becomes 8-bit samples of one logical stream, whose packets hold PACKET_SAMPLES samples, and a second
logical stream carries a comment packet; their pages are multiplexed. Reading verifies each page's checksum and
sequence number, reassembles packets from lacing values over page borders, separates the streams by serial number,
and takes timestamps from granule positions. Both work on one row's bytes; Spark deals the rows.

Defined results: null counts as empty; the payload is padded with zero bytes to a positive multiple of 64, so an
empty text has 64 of them; equal texts give equal bytes; an empty table gives an empty result; other columns are
ignored. A damaged file raises ValueError with what is wrong.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archlens.llm.common import id_and_text, map_batches, texts_of

#: Samples a second of the stored stream, samples a packet, and lacing values a page.
RATE, PACKET_SAMPLES, PAGE_SEGMENTS = 8000, 4000, 255
AUDIO, COMMENT = 1, 2
UNIT = 64
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
RESULT = "doc_id long, n_bytes long, media binary, payload binary, duration_s double, n_pages long, n_packets long, mean double, rms double, crossings long"


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, not reflected, from 0; the bits are turned so that zlib's reflected one serves."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of a logical stream of (packet, granule position after it)."""
    lacing = b"".join(_lacing(len(p)) for p, _ in packets)
    body = b"".join(p for p, _ in packets)
    ends = np.cumsum([len(p) // 255 + 1 for p, _ in packets])
    granules = [g for _, g in packets]
    pages, at = [], 0
    for number, start in enumerate(range(0, len(lacing), PAGE_SEGMENTS)):
        own = lacing[start : start + PAGE_SEGMENTS]
        size, done = sum(own), int(np.searchsorted(ends, start + len(own), "right"))
        before = int(np.searchsorted(ends, start, "right"))
        inside = start > 0 and lacing[start - 1] == 255
        flags = inside | 2 * (start == 0) | 4 * (start + PAGE_SEGMENTS >= len(lacing))
        pages.append(_page(serial, number, flags, granules[done - 1] if done > before else -1, own, body[at : at + size]))
        at += size
    return pages


def write(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: `payload` as 8-bit samples, and a comment."""
    head = struct.pack("<8sII", b"PCM8\0\0\0\0", RATE, PACKET_SAMPLES)
    packets = [(head, 0)]
    for k in range(0, len(payload), PACKET_SAMPLES):
        part = payload[k : k + PACKET_SAMPLES]
        packets.append((part, k + len(part)))
    audio = _pages(AUDIO, packets)
    comment = _pages(COMMENT, [(b"samples=%d" % len(payload), 0)])
    return b"".join([audio[0], *comment, *audio[1:]])


@dataclass
class Stream:
    """A logical stream: its packets, and for each the granule position of the page that ends it (-1: not the last there)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: list[bytes] = field(default_factory=list)
    ended: bool = False


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise ValueError("a page's header is cut off")
        magic, version, flags, granule, serial, number, checksum, n = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + _HEADER.size : at + _HEADER.size + n]
        start = at + _HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("a page is cut off")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"the page at byte {at} has another checksum")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or stream.ended or bool(flags & 2) != (number == 0):
            raise ValueError(f"stream {serial} has page {number} out of order")
        if bool(flags & 1) != bool(stream.open):
            raise ValueError(f"stream {serial} goes on with a packet that was not begun, or leaves one")
        values = np.frombuffer(lacing, np.uint8)
        stops = np.flatnonzero(values < 255)
        edges = np.cumsum(values, dtype=np.int64)[stops] + start
        for edge in edges.tolist():
            stream.packets.append(b"".join([*stream.open, media[start:edge]]))
            stream.granules.append(-1)
            stream.open, start = [], edge
        if len(stops):
            stream.granules[-1] = granule
        if n and lacing[-1] == 255:
            stream.open.append(media[start:end])
        stream.pages += 1
        stream.ended = bool(flags & 4)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an Ogg file, with what reading the file gives: payload and features of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part, rows = batch.slice(a, 100), []
                for text in texts_of(part.column("text")):
                    media = write(padded(text))
                    streams = read(media)
                    audio = streams[AUDIO]
                    rate = struct.unpack_from("<I", audio.packets[0], 8)[0]
                    payload = b"".join(audio.packets[1:])
                    sample = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                    rows.append((
                        len(text), media, payload, max(audio.granules) / rate, sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()),
                        float(sample.mean()), float(np.sqrt(np.mean(sample.astype(np.float64) ** 2))), int(np.count_nonzero((sample[1:] < 0) != (sample[:-1] < 0))),
                    ))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    return map_batches(id_and_text(docs, id_col, text_col), run, RESULT)

