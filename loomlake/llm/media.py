"""Media columns: MPEG transport streams.

Each payload is muxed into a transport stream of 188-byte packets: a program association table, a program map
table, and one elementary stream of private data whose packetised packets carry a presentation time stamp and,
at their first packet, the random-access flag. Reading goes the other way: tables are parsed to find the
elementary stream, continuity counters are checked, the packets are reassembled, and time stamps with
random-access points are stored as columns.

The work on a document is a few vectorised steps over its own bytes, so a task holds one Arrow batch at a time.

Edge cases: a null text is empty; the padded payload of an empty text is 64 zero bytes; very long texts take
several elementary packets; equal texts give equal streams; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns are ignored. The reader takes streams of several programs, sections over
packet bounds, repeated packets, packets without payload and announced jumps of a counter; it refuses damaged tables
and streams that are out of step. A repeat is one that is equal byte for byte.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, BODY = 188, 0x47, 184
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
CLOCK = 90_000

#: Payload bytes of one elementary packet, and the time that one of them spans at 8-bit samples of 16 kHz.
UNIT, RATE = 16_384, 16_000
#: Elementary-packet header: start code, stream id, length, flags, header length, time stamp.
PES_HEADER = 14

RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@cache
def _crc_table() -> tuple[int, ...]:
    """The MPEG-2 section checksum by byte: polynomial 0x04C11DB7, not reflected."""
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        table.append(crc)
    return tuple(table)


def section_crc(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        crc = crc << 8 & 0xFFFFFFFF ^ table[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A packet's worth of a program table: pointer, header, body, checksum, stuffing."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return (b"\x00" + head + body + section_crc(head + body).to_bytes(4, "big")).ljust(BODY, b"\xff")


@cache
def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    head = lambda pid: bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10"
    return head(PAT_PID) + pat + head(PMT_PID) + pmt


def time_stamp(pts: int) -> bytes:
    """33 bits in five bytes with their marker bits."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def read_time_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 0x07) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream that holds payload."""
    out, counter = [_tables()], 0
    for at in range(0, len(payload), UNIT):
        unit = payload[at : at + UNIT]
        pts = (at * CLOCK // RATE) % (1 << 33)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + time_stamp(pts) + unit
        # The first packet has an adaptation field of two bytes (random access); the last is stuffed to its end.
        n = -(-(len(pes) + 2) // BODY)
        stuffing = n * BODY - len(pes) - 2
        if n > 1 and stuffing == 1:  # one byte is the field's length alone; both forms are legal
            last_field = b"\x00"
        else:
            last_field = bytes([stuffing - 1, 0]) + b"\xff" * (stuffing - 2) if stuffing else b""
        first_field = b"\x01\x40" if n > 1 else bytes([1 + stuffing, 0x40]) + b"\xff" * stuffing
        body = first_field + pes if n == 1 else first_field + pes[: (n - 1) * BODY - 2] + last_field + pes[(n - 1) * BODY - 2 :]
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 4:] = np.frombuffer(body, np.uint8).reshape(n, BODY)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n) & 0x0F)
        packets[0, 3] |= 0x20
        if n > 1 and stuffing:
            packets[-1, 3] |= 0x20
        counter += n
        out.append(packets.tobytes())
    return b"".join(out)


def _fields(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before the payload of each packet (its adaptation field), and the field's flags, zero without."""
    has = (rows[:, 3] & 0x20) != 0
    flags = np.where(has & (rows[:, 4] > 0), rows[:, 5], 0)
    return np.where(has, rows[:, 4].astype(np.int32) + 1, 0), flags


def continuity(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of one stream carry new payload, and how often its counter breaks.

    The counter goes up by one with each packet that has payload and stands still without; one repeat of a packet,
    and a jump that the packet announces, are legal.
    """
    full = (rows[:, 3] & 0x10) != 0
    step = np.diff(rows[:, 3].astype(np.int16) & 0x0F, prepend=0) % 16
    repeat = np.zeros(len(rows), bool)
    still = np.flatnonzero(full & (step == 0))
    still = still[still > 0]
    repeat[still] = (rows[still] == rows[still - 1]).all(axis=1)
    legal = (step == full) | (_fields(rows)[1] & 0x80 != 0) | repeat & ~np.roll(repeat, 1)
    return full & ~repeat, int((~legal[1:]).sum())


def sections(rows: np.ndarray) -> list[bytes]:
    """The program-table sections in the packets of one stream; one may span packets, and a packet may hold several."""
    found, open_section = [], b""

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF:
            n = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < n:
                return data
            if section_crc(data[:n]):
                raise ValueError("checksum of a program table")
            found.append(data[:n])
            data = data[n:]
        return b"" if data[:1] == b"\xff" else data

    rows = rows[continuity(rows)[0]]
    for row, at in zip(rows, _fields(rows)[0], strict=True):
        body = row[4 + at :].tobytes()
        if row[1] & 0x40:
            if open_section:
                take(open_section + body[1 : 1 + body[0]])
            open_section = take(body[1 + body[0] :])
        elif open_section:
            open_section = take(open_section + body)
    return found


def programs(packets: np.ndarray, pids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The elementary streams (type, packet id) of every program, as the tables in force name them."""
    maps, found = {}, {}
    for s in sections(packets[pids == PAT_PID]):
        if s[0] == 0x00 and s[5] & 1:
            entries = [s[k : k + 4] for k in range(8, len(s) - 4, 4)]
            maps.update({int.from_bytes(e[:2], "big"): int.from_bytes(e[2:], "big") & 0x1FFF for e in entries})
    maps.pop(0, None)  # the network's own table
    for pid in dict.fromkeys(maps.values()):
        for s in sections(packets[pids == pid]):
            number = int.from_bytes(s[3:5], "big")
            if s[0] != 0x02 or not s[5] & 1 or maps.get(number) != pid or number in found:
                continue
            at, found[number] = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF), []
            while at < len(s) - 4:
                found[number].append((s[at], int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF))
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
    return {n: found[n] for n in maps if n in found}


def demux(stream: bytes, program: int | None = None, stream_type: int | None = None) -> dict:
    """payload, time stamps, random-access points (packet numbers), packets and continuity errors of a stream.

    The elementary stream is found by way of the program tables, never assumed: the first of its program and type, of
    any where none is named. An elementary packet without time stamp has None.
    """
    if len(stream) % PACKET:
        raise ValueError("a transport stream is a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    named = [pid for n, streams in programs(packets, pids).items() for kind, pid in streams if program in (None, n) and stream_type in (None, kind)]
    if not named:
        raise ValueError("no such program or stream")

    own = np.flatnonzero(pids == named[0])
    new, errors = continuity(packets[own])
    own = own[new]
    rows = packets[own]
    skipped, flags = _fields(rows)
    random = (flags & 0x40) != 0
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    payload, stamps = [], []
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        inside = np.arange(BODY) >= skipped[a:b, None]
        pes = rows[a:b, 4:][inside].tobytes()
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("start code of an elementary packet")
        length = int.from_bytes(pes[4:6], "big")  # zero: up to the next one
        stamps.append(read_time_stamp(pes[9:14]) if pes[7] & 0x80 else None)
        payload.append(pes[9 + pes[8] : 6 + length if length else None])
    return {"payload": b"".join(payload), "stamps": stamps, "random": own[random].tolist(), "packets": len(packets), "errors": errors}


def features(text: str | None) -> tuple:
    """The result's columns of one text, all but its length read back from the stored stream."""
    raw = (text or "").encode()
    stream = mux(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00"))
    read = demux(stream)
    payload = read["payload"]
    level = np.frombuffer(payload, np.uint8).mean()
    feature = f"packets={read['packets']};units={len(read['stamps'])};random={len(read['random'])};first_pts={read['stamps'][0]};last_pts={read['stamps'][-1]};errors={read['errors']};level={level:.3f}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature


def media_features(docs: DataFrame) -> DataFrame:
    """One row of features per document (RESULT)."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, RESULT)


def media_table(docs: DataFrame) -> DataFrame:
    """The stored form: doc_id, stream (binary), time stamps and random-access points as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, stamps, points = [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                streams.append(mux(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")))
                read = demux(streams[-1])
                stamps.append(read["stamps"])
                points.append(read["random"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.binary()), pa.array(stamps, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int64()))], ["doc_id", "stream", "time_stamps", "random_access"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, stream binary, time_stamps array<long>, random_access array<long>")
