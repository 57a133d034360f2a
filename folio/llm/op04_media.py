"""Operator 4, media columns: MPEG transport streams (ISO/IEC 13818-1) that hold and give back bytes without loss.

The writer cuts a payload into access units, wraps each in a PES packet with a presentation timestamp and sends it in
188-byte packets behind a program association and a program map table, which return with every random-access point. The
reader follows the tables as they change (sections over several packets, descriptors, network entries, later versions), checks
the continuity counters, reassembles the PES packets of the first program's first stream and lists their timestamps and
random-access points. Both work document by document; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ddl, fresh, numbered, quoted, spread, table, text_bytes

PACKET, BLOCK, UNIT = 188, 576, 8 * 576
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0, 0x1000, 0x100, 1
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
TICKS, RANDOM_EVERY = 3600, 8  # 90 kHz at 25 units a second; a random-access point every so many units
_POLY = 0x04C11DB7


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ _POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")),
])


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """A single-program transport stream that holds the payload."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        part, entry, pts = payload[at : at + UNIT], k % RANDOM_EVERY == 0, k * TICKS & (1 << 33) - 1
        if entry:
            tables = _TABLES.copy()
            tables[:, 3] |= k // RANDOM_EVERY & 15
            out.append(tables.tobytes())
        pes = b"\0\0\1" + bytes([PRIVATE_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        # the adaptation field of the first packet: random access and the clock; that of the last: stuffing
        field = bytes([7, 0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big") if entry else b""
        room = PACKET - 4 - len(field)
        n = 1 + max(0, -(-(len(pes) - room) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        packets[:, 3] = 0x10 | counter + np.arange(n) & 15
        packets[0, 1] |= 0x40
        counter += n
        body = np.frombuffer(pes, np.uint8)
        if field:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        if n == 1:
            start = PACKET - len(body)
            if start > 4 + len(field):  # stuffing lengthens the field, or makes one
                packets[0, 3] |= 0x20
                packets[0, 4] = start - 5
                if not field and start > 5:
                    packets[0, 5] = 0
            packets[0, start:] = body
        else:
            packets[0, PACKET - room :] = body[:room]
            middle = body[room : room + 184 * (n - 2)]
            packets[1 : n - 1, 4:] = middle.reshape(n - 2, 184)
            rest = body[room + len(middle) :]
            if start := 184 - len(rest):
                packets[-1, 3] |= 0x20
                packets[-1, 4] = start - 1
                if start > 1:
                    packets[-1, 5] = 0
            packets[-1, PACKET - len(rest) :] = rest
        out.append(packets.tobytes())
    return b"".join(out)


#: Stream ids whose PES packets have no header beyond the length (maps, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directories).
BARE = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def sections(packets: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place of the packet that ends it, section) of one PID's packets; start: where each packet's payload begins. Sections may go on
    over packets or follow one another in one; a gap in the counters drops what was begun."""
    begun, last = None, -1
    for i, (p, at) in enumerate(zip(packets, start.tolist(), strict=True)):
        counter, body = int(p[3]) & 15, p[at:].tobytes()
        if counter == last:
            continue
        if last >= 0 and counter != (last + 1) & 15:
            begun = None
        last = counter
        if p[1] & 0x40:
            if not body:
                continue
            pointer = body[0]
            if begun is not None:
                yield from ((i, x) for x in _whole(begun + body[1 : 1 + pointer])[0])
            begun = body[1 + pointer :]
        elif begun is not None:
            begun += body
        else:
            continue
        found, begun = _whole(begun)
        yield from ((i, x) for x in found)


def _whole(data: bytes) -> tuple[list[bytes], bytes | None]:
    """The complete sections at the front of the bytes, and the rest; stuffing ends them."""
    out = []
    while data and data[0] != 0xFF:
        size = 3 + ((data[1] & 0x0F) << 8 | data[2]) if len(data) >= 3 else len(data) + 1
        if len(data) < size:
            return out, data
        out.append(data[:size])
        data = data[size:]
    return out, None


def _sound(section: bytes, table_id: int, known: dict[bytes, bool]) -> bool:
    """Whether it's a current section of the table with a right checksum."""
    if section not in known:
        known[section] = len(section) >= 12 and crc32_mpeg(section) == 0
    return known[section] and section[0] == table_id and section[5] & 1 == 1


def programs(section: bytes) -> list[tuple[int, int]]:
    """(program, PID of its map) of a program association section; the network's entry, program 0, isn't one."""
    entries = [section[i : i + 4] for i in range(8, len(section) - 7, 4)]
    return [(e[0] << 8 | e[1], (e[2] & 0x1F) << 8 | e[3]) for e in entries if e[0] or e[1]]


def streams(section: bytes) -> list[tuple[int, int]]:
    """(stream type, PID) of a program map section, past the descriptors of program and streams."""
    at, end, out = 12 + ((section[10] & 0x0F) << 8 | section[11]), len(section) - 4, []
    while at + 5 <= end:
        out.append((section[at], (section[at + 1] & 0x1F) << 8 | section[at + 2]))
        at += 5 + ((section[at + 3] & 0x0F) << 8 | section[at + 4])
    return out


def _own_packets(p: np.ndarray, pid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, int, int, int] | None:
    """(packets of the stream that the tables name, at each place as they stand there; sections read; the last PID and stream type)."""
    known, n_tables, maps = {}, 0, []  # maps: (place, program, PID of its map)
    version, listed = -1, {}  # the association's version, and the programs by section
    carrying = ((p[:, 3] & 0x10) > 0) & ((p[:, 1] & 0x80) == 0)  # a payload, and no transmission error
    own = np.flatnonzero((pid == PAT_PID) & carrying)
    for i, section in sections(p[own], start[own]):
        if _sound(section, 0, known):
            n_tables += 1
            if section[5] & 0x3E != version:
                version, listed = section[5] & 0x3E, {}
            listed[section[6]] = programs(section)
            every = [x for entries in listed.values() for x in entries]
            if every and (not maps or maps[-1][1:] != min(every)):
                maps.append((int(own[i]), *min(every)))
    chosen = []  # (place, PID, stream type)
    for k, (place, program, pmt) in enumerate(maps):
        until = maps[k + 1][0] if k + 1 < len(maps) else len(p)
        own = np.flatnonzero((pid == pmt) & carrying)
        own = own[(own > place) & (own < until)] if k else own[own < until]
        for i, section in sections(p[own], start[own]):
            if _sound(section, 2, known) and (section[3] << 8 | section[4]) == program:
                n_tables += 1
                if (found := streams(section)) and (not chosen or chosen[-1][1:] != found[0][::-1]):
                    chosen.append((int(own[i]), found[0][1], found[0][0]))
    if not chosen:
        return None
    # what comes before the first map belongs to its stream, too
    places = np.array([0, *[c[0] for c in chosen[1:]]])
    es = np.array([c[1] for c in chosen])[np.searchsorted(places, np.arange(len(p)), side="right") - 1]
    return np.flatnonzero((pid == es) & carrying), n_tables, chosen[-1][1], chosen[-1][2]


def read_stream(media: bytes) -> dict | None:
    """payload, units (pts, offset, length, random_access), pid, stream_type, and counts of what the stream shows; None if these are
    no packets of 188 bytes, no sound tables name a stream, or it holds no sound PES packet.

    It is the first stream of the program with the least number. A packet sent twice counts once; packets marked as erroneous are
    left out, scrambled ones too, and these are counted; a step of the counter other than one counts as broken unless the
    packet announces it; a unit of which packets are lost is as long as what is left; bytes before the first unit go.
    """
    if not media or len(media) % PACKET:
        return None
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        return None
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    field = (p[:, 3] & 0x20) > 0
    start = np.minimum(4 + np.where(field, 1 + p[:, 4].astype(np.int32), 0), PACKET)
    found = _own_packets(p, pid, start)
    if found is None:
        return None
    own, n_tables, es, kind = found
    scrambled = (p[own, 3] & 0xC0) > 0
    n_scrambled, own = int(scrambled.sum()), own[~scrambled]
    q, first, start, field = p[own], (p[own, 1] & 0x40) > 0, start[own], field[own]
    steps = np.diff((q[:, 3] & 15).astype(np.int8)) & 15
    flagged = field & (q[:, 4] > 0)
    entry, announced = flagged & ((q[:, 5] & 0x40) > 0), flagged & ((q[:, 5] & 0x80) > 0)
    again = np.r_[False, (steps == 0) & ~announced[1:] & (pid[own][1:] == pid[own][:-1])][: len(q)]
    start = np.where(again, PACKET, start)
    data = q[np.arange(PACKET) >= start[:, None]]
    at = np.r_[0, np.cumsum(PACKET - start)]
    begins = np.flatnonzero(first & ~again)
    if not len(begins):
        return None
    parts, units, offset = [], [], 0
    for i, (a, b) in enumerate(zip(at[begins], [*at[begins[1:]], len(data)], strict=True)):
        pes = data[a:b]
        if len(pes) < 9 or pes[:3].tobytes() != b"\0\0\1":
            continue
        size, bare = int(pes[4]) << 8 | int(pes[5]), int(pes[3]) in BARE
        body = pes[6 if bare else 9 + int(pes[8]) : 6 + size if size else len(pes)]
        pts = -1
        if not bare and pes[7] & 0x80 and len(pes) >= 14:
            h = pes[9:14].astype(np.int64)
            pts = int((h[0] & 0x0E) << 29 | h[1] << 22 | (h[2] & 0xFE) << 14 | h[3] << 7 | h[4] >> 1)
        units.append({"pts": pts, "offset": offset, "length": len(body), "random_access": bool(entry[begins[i]])})
        parts.append(body)
        offset += len(body)
    if not units:
        return None
    broken = (steps != 1) & (steps != 0) & ~announced[1:] & (pid[own][1:] == pid[own][:-1])
    return {"payload": np.concatenate(parts).tobytes(), "units": units, "pid": es, "stream_type": kind, "n_packets": len(p), "n_tables": n_tables, "n_broken": int(broken.sum()), "n_scrambled": n_scrambled}


_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_())]))


def _slices(batches, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch's streams stay small."""
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield b.slice(k, most)


def to_transport_streams(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text), media (a transport stream of the text and bytes 255 up to a positive multiple of 576).

    A null text is empty; a null key stays null; repeated rows each have their stream; an empty table gives an empty
    result; other columns are ignored.
    """

    def write(batches):
        for b in _slices(batches):
            data, bounds = text_bytes(b.column(1))
            data = data.tobytes()
            texts = [data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
            media = [write_stream(t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK), b"\xff")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return spread(df.select(*quoted([key, text]))).mapInArrow(write, "doc_id long, n_bytes long, media binary")


_READ = {
    "payload": ("binary", pa.binary()), "units": ("array<struct<pts:long,offset:long,length:long,random_access:boolean>>", _UNITS), "pid": ("int", pa.int32()), "stream_type": ("int", pa.int32()),
    "n_packets": ("long", pa.int64()), "n_tables": ("long", pa.int64()), "n_broken": ("long", pa.int64()), "n_scrambled": ("long", pa.int64()),
}


def read_transport_streams(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload, units, pid, stream_type, n_packets, n_tables, n_broken, n_scrambled behind its columns; all null where media is
    null or no such stream. A new name that df has already gets underscores."""
    names = [*df.columns, *[fresh(df, c) for c in _READ]]
    df, (media,) = numbered(df, media)
    where = df.columns.index(media)

    def read(batches):
        for b in _slices(batches):
            got = [read_stream(x) if x else None for x in b.column(where).to_pylist()]
            cols = [pa.array([g and g[k] for g in got], t) for k, (_, t) in _READ.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *_READ])

    return df.mapInArrow(read, f"{ddl(df)}, " + ", ".join(f"{k} {t}" for k, (t, _) in _READ.items())).toDF(*names)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_transport_streams(to_transport_streams(table(spark, sf_dir, "documents")))
    feature = F.format_string(
        "packets=%d;tables=%d;units=%d;broken=%d;entries=%d;pts=%d-%d",
        "n_packets", "n_tables", F.size("units"), "n_broken", F.size(F.filter("units", lambda u: u.random_access)), F.element_at("units", 1).pts, F.element_at("units", -1).pts,
    )
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
