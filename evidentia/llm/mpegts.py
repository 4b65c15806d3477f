"""MPEG transport streams as a media column.

A payload becomes one program with one private data stream: packets of 188
bytes that carry a program association table, a program map table and
packetised elementary (PES) packets with presentation timestamps. Reading
parses the tables, checks continuity counters, reassembles the PES packets and
notes timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import slices

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0, 0x100, 0x101, 0x06, 0xBD
#: Payload is padded to a multiple of FRAME; UNIT bytes are one PES packet,
#: each RAP-th of which is a random-access point with tables before it.
FRAME, UNIT, RAP, TICKS = 576, 576 * 16, 8, 3003


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + struct.pack(">H", 0xB000 | (len(body) + 9)) + struct.pack(">H", number) + b"\xc1\x00\x00"
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 255, (ticks >> 14) & 255 | 1, (ticks >> 7) & 255, (ticks << 1) & 255 | 1])


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of a positive multiple of FRAME bytes."""
    pat = _table_packet(PAT_PID, _PAT)
    pmt = _table_packet(PMT_PID, _PMT)
    out, tables, counter = [], 0, 0
    for unit, low in enumerate(range(0, len(payload), UNIT)):
        body = payload[low : low + UNIT]
        ticks = unit * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + struct.pack(">H", len(body) + 8) + b"\x84\x80\x05" + _timestamp(ticks) + body
        point = unit % RAP == 0
        if point:
            for t in (pat, pmt):
                t = t.copy()
                t[3] |= tables & 15
                out.append(t[None, :])
            tables += 1
        # the first packet has the clock and the mark of a random-access point
        first = BODY - 8 if point else BODY
        n = 1 + max(0, -(-(len(pes) - first) // BODY))
        rows = np.zeros((n, PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        data = np.frombuffer(pes, np.uint8)
        free = np.zeros(n, np.int64)  # bytes of adaptation field
        if point:
            free[0] = 8
        free[-1] += int((BODY - free).sum()) - len(data)
        for i in {0, n - 1}:
            if free[i]:
                rows[i, 3] |= 0x20
                rows[i, 4] = free[i] - 1
                if free[i] > 1:
                    rows[i, 6 : 4 + free[i]] = 255
                    if i == 0 and point:
                        rows[i, 5] = 0x50
                        rows[i, 6:12] = np.frombuffer((ticks << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        rows[np.arange(PACKET) >= (4 + free)[:, None]] = data
        out.append(rows)
    return np.concatenate(out).tobytes()


def _payload(p: np.ndarray) -> bytes:
    """A packet's bytes after its header and adaptation field."""
    return p[4 + (1 + int(p[4]) if p[3] & 0x20 else 0) :].tobytes() if p[3] & 0x10 else b""


def _read_section(packets: np.ndarray, table: int) -> bytes | None:
    """The section that begins in the first of the packets of a PID, which may
    go on in those after it; None if it ends too soon, or its checksum or number
    of table is wrong."""
    first = _payload(packets[0])
    body = first[1 + first[0] :] if first else b""
    for p in packets[1:]:
        if len(body) >= 3 and len(body) >= 3 + ((body[1] & 15) << 8 | body[2]):
            break
        if p[1] & 0x40:  # the next section's packet: what stands before its pointer
            rest = _payload(p)
            body += rest[1 : 1 + rest[0]] if rest else b""
            break
        body += _payload(p)
    if len(body) < 3:
        return None
    section = body[: 3 + ((body[1] & 15) << 8 | body[2])]
    return section if section[0] == table and len(section) > 7 and section[-4:] == struct.pack(">I", crc32_mpeg(section[:-4])) else None


def _lost(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets of a PID without those sent twice, which a stream may do, and
    the breaks in their counter."""
    counter = rows[:, 3].astype(np.int64) & 15
    twice = np.zeros(len(rows), bool)
    twice[1:] = (counter[1:] == counter[:-1]) & (rows[1:] == rows[:-1]).all(axis=1)
    twice[1:] &= ~twice[:-1]  # once more at most
    kept = ~twice
    return kept, int((np.diff(counter[kept]) % 16 != 1).sum())


def demux(media: bytes) -> dict:
    """payload; programs {number: map pid}, streams {pid: type}, packets,
    pes (packets reassembled), pts (timestamps), random_access (timestamp and
    number of the packet of each point), lost (breaks of continuity, those of the
    tables among them), clipped (PES packets with a wrong length)."""
    found = {"payload": b"", "programs": {}, "streams": {}, "packets": 0, "pes": 0, "pts": [], "random_access": [], "lost": 0, "clipped": 0}
    if not media or len(media) % PACKET:
        return found | {"lost": 1 if media else 0}
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    found["packets"] = len(rows)
    found["lost"] += int((rows[:, 0] != 0x47).sum())
    pid = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]

    def section(of: int, table: int) -> bytes | None:
        mine = rows[(pid == of) & ((rows[:, 3] & 0x10) > 0)]
        if len(mine):
            kept, lost = _lost(mine)
            found["lost"] += lost
            mine = mine[kept]
        return _first_section(mine, table)

    pat = section(PAT_PID, 0)
    for i in range(8, len(pat or b"") - 4, 4):
        found["programs"][pat[i] << 8 | pat[i + 1]] = (pat[i + 2] & 31) << 8 | pat[i + 3]
    for map_pid in found["programs"].values():
        pmt = section(map_pid, 2)
        at = 12 + ((pmt[10] & 15) << 8 | pmt[11]) if pmt else 0
        while pmt and at < len(pmt) - 4:
            found["streams"][(pmt[at + 1] & 31) << 8 | pmt[at + 2]] = pmt[at]
            at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    whole = []
    for es in found["streams"]:
        places = np.flatnonzero((pid == es) & ((rows[:, 3] & 0x10) > 0))
        if not len(places):
            continue
        kept, lost = _lost(rows[places])
        found["lost"] += lost
        places = places[kept]
        mine = rows[places]
        has = (mine[:, 3] & 0x20) > 0
        skip = np.where(has, 1 + mine[:, 4].astype(np.int64), 0)
        data = mine[np.arange(PACKET) >= (4 + skip)[:, None]]
        at = np.concatenate([[0], np.cumsum(BODY - skip)])
        new = np.flatnonzero((mine[:, 1] & 0x40) > 0)
        if not len(new):  # no packet begins one
            continue
        point = has & (mine[:, 4] > 0) & ((mine[:, 5] & 0x40) > 0)
        for k, (low, high) in enumerate(zip(at[new], np.append(at[new[1:]], at[-1]), strict=True)):
            pes = data[low:high]
            head = pes[:14].tobytes().ljust(14, b"\0")
            size = head[4] << 8 | head[5]
            if head[:3] != b"\x00\x00\x01" or len(pes) != size + 6:
                found["clipped"] += 1
            pts = (head[9] & 14) << 29 | head[10] << 22 | (head[11] & 254) << 14 | head[12] << 7 | head[13] >> 1 if head[7] & 0x80 else None
            if pts is not None:
                found["pts"].append(pts)
            if point[new[k]]:
                found["random_access"].append({"pts": pts, "packet": int(places[new[k]])})
            whole.append(pes[9 + head[8] :])
        found["pes"] += len(new)
    found["payload"] = np.concatenate(whole).tobytes() if whole else b""
    return found


_CHECKED: dict[tuple[bytes, int], bytes | None] = {}


def _first_section(packets: np.ndarray, table: int) -> bytes | None:
    """The first section that is whole. Sections of one packet are remembered:
    nearly all streams have the same tables."""
    for i in np.flatnonzero((packets[:, 1] & 0x40) > 0):
        key = (packets[i].tobytes(), table)
        if key not in _CHECKED:
            if len(_CHECKED) > 1000:
                _CHECKED.clear()
            _CHECKED[key] = _read_section(packets[i : i + 1], table)
        if found := _CHECKED[key] or _read_section(packets[i : i + 8], table):  # a section has 1024 bytes at most
            return found
    return None


_PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
_PMT = _section(2, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + bytes([STREAM_TYPE]) + struct.pack(">HH", 0xE000 | ES_PID, 0xF000))

READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, n_programs int, n_packets long, n_pes long, first_pts long, last_pts long, random_access array<struct<pts:bigint,packet:int>>, lost long, clipped long, streams string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<struct<pts:bigint,packet:int>>": pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int32())]))}
_READ = pa.struct([(name, _ARROW[kind]) for name, kind in (c.split() for c in READ.split(", "))])


def read_back(media: bytes | None) -> tuple:
    """READ of what a stored transport stream holds. Null media, or such as is
    no stream, gives no payload, lost 1 if it isn't empty."""
    x = demux(media or b"")
    p, pts = x["payload"], x["pts"]
    return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(x["programs"]), x["packets"], x["pes"], pts[0] if pts else None, pts[-1] if pts else None, x["random_access"], x["lost"], x["clipped"], ",".join(f"{k}:{v}" for k, v in x["streams"].items()))


def _stored(batches):
    for b in slices(batches, 0):
        media = [mux(pad((t or "").encode("utf-8", "surrogatepass"))) for t in b.column(0).to_pylist()]
        read = [dict(zip(_READ.names, read_back(m), strict=True)) for m in media]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(media, pa.binary()), pa.array(read, _READ)], [*b.schema.names[1:], "media", "read"])


def add_streams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with media (binary): the transport stream of the UTF-8 bytes of a
    text (null as empty), padded with 255 to a positive multiple of FRAME; its
    media_bytes and media_sha256, and read, the struct READ parsed from the
    stored bytes. Columns named alike are replaced.

    Each row by itself, equal texts alike, texts whole; no shuffle. Tasks hold
    some megabytes of texts and their streams at a time. An empty table gives an
    empty table."""
    kept = [c for c in docs.columns if c not in ("media", "media_bytes", "media_sha256", "read")]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(f"media binary, read struct<{READ.replace(' ', ':').replace(',:', ',')}>").fields])
    made = rows.mapInArrow(_stored, schema)
    return made.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
