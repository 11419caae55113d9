"""MPEG transport streams as a media column (ISO/IEC 13818-1).

`mux` stores a payload as one program: a PAT, a PMT and one private elementary stream whose
access units are PES packets with presentation timestamps; random access points are marked in the
adaptation field, which also carries the program clock. `demux` parses streams again, its own and others: it
reads the program tables (sections may span packets), checks the continuity counter of every packet identifier, leaves out legal repeats of
a packet, takes tables that are in force only, puts the elementary packets of each stream together (of declared or of open length) and keeps each one's timestamp (null if it has none), random-access mark and place.

Damage never raises. What can't be trusted is left out and counted: bytes between packets (sync_errors), breaks of a counter (continuity_errors), table
sections with a wrong checksum (table_errors), packets that are marked as erroneous or scrambled (packet_errors), elementary packets that are cut short, lost their start code or had a break inside (unit_errors).

Defined results: null text is an empty text (one padding unit of 255 bytes); equal texts give equal
streams; null media gives status `null` and null digests, a stream with any error `damaged`, any other `ok`; an empty table gives an empty table; only the named columns are read, so extra columns don't
matter; a null id is passed through.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mapped, session_defaults, texts_of

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE_PRIVATE = 0x06
PAT_TABLE, PMT_TABLE = 0x00, 0x02
PRIVATE_STREAM = 0xBD
CLOCK = 90_000

#: Bytes that a payload is padded to a multiple of, access-unit size, units between random access points.
UNIT = 576
ACCESS_UNIT = 16 * UNIT
RAP_EVERY = 8
FRAME_TICKS = 3_600


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section: polynomial 0x04C11DB7, unreflected. Tables repeat, so their checksums are kept."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(body: bytes) -> bytes:
    return body + crc32_mpeg(body).to_bytes(4, "big")


def _table_packet(pid: int, body: bytes, counter: int = 0) -> bytes:
    head = bytes((SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter, 0))
    return (head + _section(body)).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, bytes((0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255)))
_PMT = _table_packet(
    PMT_PID,
    bytes((0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE_PRIVATE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0)),
)


def pack_timestamp(prefix: int, pts: int) -> bytes:
    return bytes((prefix << 4 | (pts >> 29 & 0x0E) | 1, pts >> 22 & 255, (pts >> 14 & 0xFE) | 1, pts >> 7 & 255, (pts << 1 & 0xFE) | 1))


def read_timestamp(raw: bytes) -> int:
    return (raw[0] & 0x0E) << 29 | raw[1] << 22 | (raw[2] & 0xFE) << 14 | raw[3] << 7 | raw[4] >> 1


def _packets_of(pes: bytes, counter: int, rap: bool, pcr: int) -> np.ndarray:
    """The packets of one PES packet: the first has the adaptation field, the last is stuffed."""
    n = len(pes)
    first_room = PACKET - 4 - 8
    count = 1 + max(0, -(-(n - first_room) // (PACKET - 4)))
    out = np.full((count, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | ((counter + np.arange(count)) & 15)
    data = np.frombuffer(pes, np.uint8)

    def stuffed(row: int, part: np.ndarray, flags: int, clock: bytes) -> None:
        room = PACKET - 4 - len(part)
        out[row, 3] |= 0x20
        out[row, 4] = room - 1
        if room > 1:
            out[row, 5] = flags
            out[row, 6 : 6 + len(clock)] = np.frombuffer(clock, np.uint8)
        out[row, PACKET - len(part) :] = part

    out[0, 1] |= 0x40
    clock = bytes((pcr >> 25 & 255, pcr >> 17 & 255, pcr >> 9 & 255, pcr >> 1 & 255, (pcr & 1) << 7 | 0x7E, 0))
    stuffed(0, data[:first_room], 0x10 | 0x40 * rap, clock)
    if count > 1:
        rest = data[first_room:]
        whole = len(rest) // (PACKET - 4)
        out[1 : 1 + whole, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if 1 + whole < count:
            stuffed(count - 1, rest[whole * (PACKET - 4) :], 0, b"")
    return out


def mux(payload: bytes) -> bytes:
    """One program that holds the payload; tables come before every random access point."""
    parts, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), ACCESS_UNIT)):
        unit, pts = payload[at : at + ACCESS_UNIT], (CLOCK + k * FRAME_TICKS) & ((1 << 33) - 1)
        rap = k % RAP_EVERY == 0
        if rap:
            pat, pmt = bytearray(_PAT), bytearray(_PMT)
            pat[3] = pmt[3] = 0x10 | tables & 15
            parts += [bytes(pat), bytes(pmt)]
            tables += 1
        pes = b"\x00\x00\x01" + bytes((PRIVATE_STREAM,)) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + pack_timestamp(2, pts) + unit
        rows = _packets_of(pes, counter, rap, pts)
        counter = (counter + len(rows)) & 15
        parts.append(rows.tobytes())
    return b"".join(parts)


@dataclass
class Elementary:
    """One elementary stream: its access units, their timestamps, and which of them are random access points."""

    stream_type: int
    units: list[bytes] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)
    elementary: dict[int, Elementary] = field(default_factory=dict)
    packets: int = 0
    repeats: int = 0
    sync_errors: int = 0
    packet_errors: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    unit_errors: int = 0

    @property
    def streams(self) -> dict[int, int]:
        return {pid: e.stream_type for pid, e in self.elementary.items()}

    @property
    def payload(self) -> bytes:
        """Access units of all streams, stream after stream by packet identifier."""
        return b"".join(u for _, e in sorted(self.elementary.items()) for u in e.units)

    @property
    def status(self) -> str:
        return "damaged" if self.sync_errors or self.packet_errors or self.continuity_errors or self.table_errors or self.unit_errors else "ok"

    def first(self) -> Elementary:
        return min(self.elementary.items())[1] if self.elementary else Elementary(0)

    def feature(self) -> str:
        pts, access = self.first().pts, self.first().random_access
        return (
            f"packets={self.packets};programs={len(self.programs)};stream_type={','.join(str(v) for _, v in sorted(self.streams.items()))};"
            f"continuity_errors={self.continuity_errors};table_errors={self.table_errors};access_units={len(pts)};"
            f"first_pts={pts[0] if pts else -1};last_pts={pts[-1] if pts else -1};pts_step={pts[1] - pts[0] if len(pts) > 1 else 0};"
            f"random_access_points={len(access)};last_random_access={access[-1] if access else -1}"
        )


def packet_rows(stream: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and how many runs of bytes between them were passed over."""
    whole = len(stream) // PACKET * PACKET
    rows = np.frombuffer(stream[:whole], np.uint8).reshape(-1, PACKET)
    if whole == len(stream) and np.all(rows[:, 0] == SYNC):
        return rows, 0
    at, found, lost = 0, [], 0
    while at + PACKET <= len(stream):
        if stream[at] == SYNC and (at + PACKET == len(stream) or stream[at + PACKET] == SYNC or found and found[-1] == at - PACKET):
            found.append(at)
            at += PACKET
            continue
        lost += 1
        at = stream.find(SYNC, at + 1)
        while 0 <= at and at + PACKET < len(stream) and stream[at + PACKET] != SYNC:
            at = stream.find(SYNC, at + 1)
        if at < 0:
            break
    rest = found[-1] + PACKET if found else 0
    lost += bool(0 <= at < len(stream) and at == rest)
    return np.frombuffer(b"".join(stream[k : k + PACKET] for k in found), np.uint8).reshape(-1, PACKET), lost


def continuity(rows: np.ndarray, has_payload: np.ndarray, offset: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one packet identifier's packets: which break the count, and which only repeat the one before.

    The counter goes up by one with a payload and stays without one; one packet may be sent twice; a marked discontinuity is no break.
    """
    counters = rows[:, 3] & 15
    broken, repeated = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    due = (counters[:-1] + has_payload[1:]) & 15
    broken[1:] = (counters[1:] != due) & ~jumps[1:]
    for k in np.flatnonzero(broken & (np.concatenate(([255], counters[:-1])) == counters)).tolist():
        before = k - 1
        if has_payload[before] and not repeated[before] and offset[k] == offset[before] and np.array_equal(rows[k, offset[k] :], rows[before, offset[before] :]):
            repeated[k], broken[k] = True, False
    return broken, repeated


def sections(rows: np.ndarray, starts: np.ndarray, offset: np.ndarray, out: Stream) -> list[bytes]:
    """Distinct table sections of one identifier's packets, put together over packets; those with a wrong checksum are counted."""
    found: dict[bytes, None] = {}
    held = b""

    def take(more: bytes, last: bool) -> None:
        nonlocal held
        held += more
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                break
            if size < 12 or crc32_mpeg(held[: size - 4]) != int.from_bytes(held[size - 4 : size], "big"):
                out.table_errors += 1
            else:
                found[held[:size]] = None
            held = held[size:]
        if last:
            # A section that doesn't end before the next one begins is cut.
            out.table_errors += bool(held and held[0] != 0xFF)
            held = b""

    begun = False
    for row, start, skip in zip(rows, starts.tolist(), offset.tolist()):
        body = row[skip:].tobytes()
        if start and body:
            if begun:
                take(body[1 : 1 + body[0]], True)
            held, begun = b"", True
            take(body[1 + body[0] :], False)
        elif begun:
            take(body, False)
    if begun:
        take(b"", True)
    return list(found)


def elementary(out: Elementary, rows: np.ndarray, starts: np.ndarray, offset: np.ndarray, access: np.ndarray, broken: np.ndarray, cut: bool) -> int:
    """Put the access units of one stream together; returns how many were left out. cut: packets may be missing after the last one."""
    lost = 0
    data = rows[np.arange(PACKET)[None, :] >= offset[:, None]].tobytes()
    at = np.concatenate(([0], np.cumsum(PACKET - offset)))
    heads = np.flatnonzero(starts)
    breaks = np.concatenate(([0], np.cumsum(broken)))
    for first, last in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)]):
        pes = data[at[first] : at[last]]
        size = 6 + (pes[4] << 8 | pes[5]) if len(pes) > 8 else 0
        open_length = size == 6
        # A break inside spoils the unit; one at the next head may have cut the end of a unit of open length.
        spoilt = breaks[last] - breaks[first + 1] > 0 or open_length and (broken[last] if last < len(rows) else cut)
        if spoilt or pes[:3] != b"\x00\x00\x01" or len(pes) < max(9, size) or 9 + pes[8] > (len(pes) if open_length else size):
            lost += 1
            continue
        out.pts.append(read_timestamp(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else None)
        if access[first]:
            out.random_access.append(len(out.units))
        out.units.append(pes[9 + pes[8] :] if open_length else pes[9 + pes[8] : size])
    return lost


def demux(stream: bytes) -> Stream:
    """Parse a transport stream; damaged parts are left out and counted."""
    rows, lost = packet_rows(stream)
    out = Stream(packets=len(rows), sync_errors=lost)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    # Of a packet with the transport-error bit not even the identifier can be trusted; a scrambled one can't be read.
    bad = (rows[:, 1] & 0x80 > 0) | (rows[:, 3] & 0xC0 > 0) & (pid != NULL_PID)
    out.packet_errors = int(bad.sum())
    after_bad = int(np.flatnonzero(bad)[-1]) - out.packet_errors + 1 if out.packet_errors else 0
    rows, pid = rows[~bad], pid[~bad]
    control = rows[:, 3] >> 4 & 3
    has_adaptation, has_payload = (control & 2) > 0, (control & 1) > 0
    length = np.where(has_adaptation, rows[:, 4].astype(np.int32), -1)
    flags = np.where(length > 0, rows[:, 5], 0)
    offset = np.minimum(np.where(has_adaptation, 5 + length, 4), PACKET)
    starts = (rows[:, 1] & 0x40) > 0
    broken, repeated = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    for p in np.unique(pid).tolist():
        own = pid == p
        if p != NULL_PID:
            broken[own], repeated[own] = continuity(rows[own], has_payload[own], offset[own], (flags[own] & 0x80) > 0)
    out.continuity_errors, out.repeats = int(broken.sum()), int(repeated.sum())

    def of(wanted: int) -> np.ndarray:
        return np.flatnonzero((pid == wanted) & has_payload & ~repeated)

    def tables(wanted: int, kind: int) -> list[bytes]:
        own = of(wanted)
        return [t for t in sections(rows[own], starts[own], offset[own], out) if t[0] == kind and t[5] & 1]

    for table in tables(PAT_PID, PAT_TABLE):
        for at in range(8, len(table) - 4, 4):
            number = table[at] << 8 | table[at + 1]
            if number:
                out.programs[number] = (table[at + 2] & 0x1F) << 8 | table[at + 3]
    for map_pid in sorted(set(out.programs.values())):
        for table in tables(map_pid, PMT_TABLE):
            at = 12 + ((table[10] & 0x0F) << 8 | table[11])
            while at + 5 <= len(table) - 4:
                out.elementary.setdefault((table[at + 1] & 0x1F) << 8 | table[at + 2], Elementary(table[at]))
                at += 5 + ((table[at + 3] & 0x0F) << 8 | table[at + 4])
    for es, held in out.elementary.items():
        own = of(es)
        if len(own):
            out.unit_errors += elementary(held, rows[own], starts[own], offset[own], (flags[own] & 0x40) > 0, broken[own], bool(own[-1] < after_bad))
    return out


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 are appended up to a positive multiple of the unit."""
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


SCHEMA = "id long, n_bytes long, media binary"
FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, status string, continuity_errors long, access_units long, streams array<struct<pid: int, stream_type: int, pts: array<long>, random_access: array<int>>>"


def store(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: each text as a transport stream. Columns id, n_bytes, media."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, SCHEMA)


def features(media: DataFrame) -> DataFrame:
    """Read stored streams back. Columns as in FEATURES: digests of what was read, and of each elementary stream its timestamps and random access points."""
    session_defaults(media.sparkSession)
    kind = pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32()))]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), kind]

    def row(raw: bytes | None) -> tuple:
        if raw is None:
            return (None, None, None, None, None, None, "null", None, None, None)
        s = demux(raw)
        payload = s.payload
        streams = [{"pid": pid, "stream_type": e.stream_type, "pts": e.pts, "random_access": e.random_access} for pid, e in sorted(s.elementary.items())]
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), s.feature(), s.status, s.continuity_errors, sum(len(e.units) for e in s.elementary.values()), streams)

    def make(batch: pa.RecordBatch):
        rows = [row(raw) for raw in batch.column(2).to_pylist()]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status", "continuity_errors", "access_units", "streams"])

    return mapped(media.select(F.col("id").cast("long").alias("id"), "n_bytes", "media"), make, FEATURES)
