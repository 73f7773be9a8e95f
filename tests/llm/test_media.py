import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_round_trip(payload):
    stream = media.mux(payload)
    read = media.demux(stream)
    assert read["payload"] == payload and read["errors"] == 0 and len(stream) % 188 == 0


@pytest.mark.parametrize("n", [*range(1, 400), 16_383, 16_384, 16_385, 50_000, 163_840])
def test_round_trip_of_every_stuffing(n):
    payload = bytes(k * 31 % 256 for k in range(n))
    read = media.demux(media.mux(payload))
    assert read["payload"] == payload
    units = -(-n // media.UNIT)
    assert len(read["stamps"]) == len(read["random"]) == units
    assert read["stamps"] == [k * media.UNIT * media.CLOCK // media.RATE for k in range(units)]


def test_lost_packets_are_counted_and_damage_is_refused():
    stream = media.mux(bytes(5000))
    cut = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.demux(cut)["errors"] == 1
    with pytest.raises(ValueError):
        media.demux(b"\x00" + stream[1:])
    broken = bytearray(stream)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(broken))


def test_checksum_and_time_stamps():
    assert media.section_crc(b"123456789") == 0x0376E6E7
    for pts in (0, 1, 90_000, 2**32, 2**33 - 1):
        assert media.read_time_stamp(media.time_stamp(pts)) == pts


def test_features(spark, odd, none):
    texts = [None, "", "a", "é" * 31, "é" * 32, "x" * 64, "y" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stream = media.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert media.media_features(odd).count() == odd.count() and media.media_features(none).count() == 0
    stored = media.media_table(docs).where("doc_id = 6").first()
    assert len(stored.time_stamps) == len(stored.random_access) == -(-200_000 // media.UNIT)

def packet(pid, counter, body, start=False, field=None, full=True):
    """A hand-made packet: body is filled up behind an adaptation field (flags and more) as need be."""
    room = 184 - (len(body) if full else 0)
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x10 if full else 0) | (0x20 if room else 0) | counter])
    flags = (field if field is not None else b"\x00")[: max(room - 1, 0)]
    return head + (bytes([room - 1]) + flags.ljust(room - 1, b"\xff") if room else b"") + (body if full else b"")


def section(table, number, body):
    data = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return data + media.section_crc(data).to_bytes(4, "big")


def elementary(payload, stamp):
    return b"\x00\x00\x01\xbd\x00\x00" + (b"\x84\x80\x05" + media.time_stamp(stamp) if stamp is not None else b"\x84\x00\x00") + payload


def two_programs(between=b""):
    """A table of two programs behind the network's entry, a map that spans two packets, and one map beside another in a packet."""
    pat = section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x07\xe2\x00" + b"\x00\x09\xe3\x00")
    long = section(2, 7, b"\xe1\x00\xf0\xc8" + b"d" * 200 + b"\x1b\xe1\x01\xf0\x03abc" + b"\x06\xe1\x00\xf0\x00")
    other = section(2, 9, b"\xe1\x02\xf0\x00" + b"\x06\xe1\x02\xf0\x00")
    foreign = section(2, 8, b"\xe1\x05\xf0\x00" + b"\x06\xe1\x05\xf0\x00")
    out = packet(0, 0, b"\x00" + pat, start=True) + packet(0x200, 0, b"\x00" + long[:183], start=True) + packet(0x200, 1, bytes([len(long) - 183]) + long[183:], start=True)
    out += packet(0x300, 0, b"\x00" + foreign + other, start=True)
    out += packet(0x101, 5, elementary(b"picture", 900), start=True, field=b"\x40") + packet(0x100, 14, elementary(b"words", 7), start=True)
    return out + packet(0x101, 6, b" goes on") + between + packet(0x102, 3, elementary(b"nine", None), start=True) + packet(0x101, 7, b" and ends")


def test_programs_and_tables_over_packet_bounds():
    read = media.demux(two_programs())
    assert (read["payload"], read["stamps"], read["random"], read["packets"], read["errors"]) == (b"picture goes on and ends", [900], [4], 9, 0)
    assert media.demux(two_programs(), program=7, stream_type=6)["payload"] == b"words"
    nine = media.demux(two_programs(), program=9)
    assert (nine["payload"], nine["stamps"]) == (b"nine", [None])
    with pytest.raises(ValueError):
        media.demux(two_programs(), program=8)


@pytest.mark.parametrize(
    "between, errors",
    [
        (packet(0x101, 6, b" goes on"), 0),
        (packet(0x101, 6, b" goes on") * 2, 1),
        (packet(0x101, 6, b"", full=False), 0),
        (packet(0x101, 9, b"", full=False), 2),
        (packet(0x101, 6, b"", full=False, field=b"\x80"), 0),
        (packet(0x1FFF, 0, b"idle"), 0),
    ],
)
def test_repeats_and_packets_without_payload(between, errors):
    read = media.demux(two_programs(between))
    assert (read["payload"], read["errors"]) == (b"picture goes on and ends", errors)


def test_an_announced_jump_is_no_error():
    jump = lambda flags: two_programs() + packet(0x101, 13, b", later", field=flags)
    assert media.demux(jump(b"\x00"))["errors"] == 1 and media.demux(jump(b"\x80"))["errors"] == 0
    assert media.demux(jump(b"\x80"))["payload"] == b"picture goes on and ends, later"


def bits(data):
    return int.from_bytes(data, "big"), 8 * len(data)


def plain_read(stream):
    """A reader of its own, field by field as the standard lists them, for streams of one program: payload, time stamps, packets that are random-access points."""

    def fields(data, *widths):
        value, left = bits(data)
        out = []
        for w in widths:
            left -= w
            out.append(value >> left & (1 << w) - 1)
        return out

    def remainder(data):
        """Of the division by the section's polynomial, bit by bit; zero if its checksum fits."""
        register = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                top = register >> 31 ^ byte >> k & 1
                register = (register << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
        return register

    def section_of(body):
        start = 1 + body[0]
        table, syntax, zero, _, length = fields(body[start : start + 3], 8, 1, 1, 2, 12)
        whole = body[start : start + 3 + length]
        assert (syntax, zero) == (1, 0) and remainder(whole) == 0 and set(body[start + 3 + length :]) <= {0xFF}
        _, _, current, number, last = fields(whole[5:8], 2, 5, 1, 8, 8)
        assert (current, number, last) == (1, 0, 0)
        return table, whole[3:5], whole[8:-4]

    counters, bodies, random = {}, {}, []
    for n in range(0, len(stream), 188):
        sync, error, start, _, pid, scrambled, has_field, has_body, counter = fields(stream[n : n + 4], 8, 1, 1, 1, 13, 2, 1, 1, 4)
        assert (sync, error, scrambled, has_body) == (0x47, 0, 0, 1)
        assert counter == counters.get(pid, counter if pid not in counters else None)
        counters[pid] = (counter + 1) % 16
        body = stream[n + 4 : n + 188]
        if has_field:
            size = body[0]
            assert size <= 182
            if size:
                assert body[1] & ~0x40 == 0 and set(body[2 : 1 + size]) <= {0xFF}
                if body[1] & 0x40:
                    random.append((pid, n // 188))
            body = body[1 + size :]
        bodies.setdefault(pid, []).append((start, body))
    table, _, entries = section_of(bodies[0][0][1])
    assert table == 0 and len(entries) == 4
    program, _, map_pid = fields(entries, 16, 3, 13)
    table, number, body = section_of(bodies[map_pid][0][1])
    assert table == 2 and int.from_bytes(number, "big") == program
    _, clock, _, info = fields(body[:4], 3, 13, 4, 12)
    kind, _, data_pid, _, more = fields(body[4 + info :], 8, 3, 13, 4, 12)
    assert (kind, clock, more, len(body)) == (6, data_pid, 0, 9 + info) and set(bodies) == {0, map_pid, data_pid}
    units = []
    for start, part in bodies[data_pid]:
        if start:
            units.append(b"")
        units[-1] += part
    payload, stamps = b"", []
    for unit in units:
        code, stream_id, length = fields(unit[:6], 24, 8, 16)
        mark, *_, pts, dts, _, header = fields(unit[6:9], 2, 2, 1, 1, 1, 1, 1, 1, 6, 8)
        assert (code, stream_id, length, mark, pts, dts, header) == (1, 0xBD, len(unit) - 6, 2, 1, 0, 5)
        lead, high, m1, middle, m2, low, m3 = fields(unit[9:14], 4, 3, 1, 15, 1, 15, 1)
        assert (lead, m1, m2, m3) == (2, 1, 1, 1)
        stamps.append(high << 30 | middle << 15 | low)
        payload += unit[14:]
    assert {pid for pid, _ in random} == {data_pid}
    return payload, stamps, [n for _, n in random]


def test_whole_table_by_another_reader(spark, data, odd):
    """What the query stores of every document, read by the plain reader: the payload, its hashes, time stamps and random-access points."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    more = odd.select(odd["doc_id"].cast("long"), odd["text"]).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).selectExpr("-1 - doc_id AS doc_id", "text")
    docs = docs.unionByName(more)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    stored = {r.doc_id: r for r in media.media_table(docs).collect()}
    found = {r.doc_id: r for r in media.media_features(docs).collect()}
    assert set(stored) == set(found) == set(texts) and len(texts) > 100
    # Bit by bit is slow: of the longest texts, one is enough.
    wanted = {d for d, t in texts.items() if len(t) < 20_000} | {max(texts, key=lambda d: (len(texts[d]), d))}
    for d in wanted:
        raw, row, stream = texts[d].encode(), found[d], bytes(stored[d].stream)
        payload, stamps, points = plain_read(stream)
        assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (row.n_bytes, row.payload_bytes, row.media_bytes) == (len(raw), len(payload), len(stream))
        assert (row.payload_sha256, row.tail_crc32, row.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(stream).hexdigest())
        assert (stored[d].time_stamps, stored[d].random_access) == (stamps, points)
        assert stamps == [k * media.UNIT * 90_000 // 16_000 for k in range(-(-len(payload) // media.UNIT))]
