"""Media columns: MPEG transport streams.

A payload travels in a stream of one program: a program association table, a
program map table, and elementary packets of private data with presentation
timestamps. Reading parses the tables (checking their CRC), follows the
continuity counters, puts the elementary packets together again, and gives the
timestamps with their random-access points.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch, small_batches, table
from .textnum import utf8

UNIT_BYTES = 576
#: Units per elementary packet, packets from one random-access point to the next, and 90 kHz ticks per unit.
PES_UNITS, RANDOM_ACCESS_EVERY, UNIT_TICKS = 64, 4, 1_080
#: Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, PRIVATE_TYPE, PRIVATE_STREAM = 188, 0x47, 0, 0x1000, 0x100, 1, 0x06, 0xBD


@lru_cache(256)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return b"".join(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s + b"\xff" * (PACKET - 5 - len(s)) for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """The stream of a payload of whole units."""
    out, counter = [_tables()], 0
    head = bytes([SYNC, MEDIA_PID >> 8, MEDIA_PID & 255])
    start = bytes([SYNC, 0x40 | MEDIA_PID >> 8, MEDIA_PID & 255])
    plain = [head + bytes([0x10 | c]) for c in range(16)]
    step = PES_UNITS * UNIT_BYTES
    for k, at in enumerate(range(0, len(payload), step)):
        body = payload[at : at + step]
        pts = at // UNIT_BYTES * UNIT_TICKS & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(pts) + body
        pos, first = 0, True
        while pos < len(data):
            fields = b""
            if first and k % RANDOM_ACCESS_EVERY == 0:
                fields = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
            room = PACKET - 4 - (len(fields) + 1 if fields else 0)
            left = len(data) - pos
            if left < room:
                gap = room - left
                if fields:
                    fields += b"\xff" * gap
                elif gap > 1:
                    fields = b"\x00" + b"\xff" * (gap - 2)
                field = bytes([len(fields)]) + fields
            else:
                field = bytes([len(fields)]) + fields if fields else b""
            n = PACKET - 4 - len(field)
            if first or field:
                out.append((start if first else head) + bytes([(0x30 if field else 0x10) | counter]) + field)
            else:
                out.append(plain[counter])
            out.append(data[pos : pos + n])
            pos += n
            counter = counter + 1 & 15
            first = False
    return b"".join(out)


def _read_section(packet: bytes) -> bytes | None:
    at = 5 + packet[4] if packet[3] & 0x20 else 4
    if at >= PACKET - 12:
        return None
    at += 1 + packet[at]
    size = 3 + ((packet[at + 1] & 15) << 8 | packet[at + 2])
    s = packet[at : at + size]
    return s if len(s) == size and size >= 12 and crc32_mpeg(s[:-4]) == int.from_bytes(s[-4:], "big") else None


def demux(media: bytes) -> dict:
    """payload, program_pid, media_pid, stream_type, errors, and stamps (pts, random_access, at: offset in the payload).

    Packets without sync, sections with a wrong CRC and steps of a continuity
    counter that no discontinuity flag announces are counted as errors; what can
    be read is returned. A packet that is sent twice counts once.
    """
    errors, pmt_pid, pid, kind, last = 0, None, None, None, None
    packets: list[tuple] = []
    parts: list[bytes] = []
    flag, before, repeated = False, b"", False
    for at in range(0, len(media), PACKET):
        p = media[at : at + PACKET]
        if len(p) < PACKET or p[0] != SYNC:
            errors += 1
            continue
        this = (p[1] & 0x1F) << 8 | p[2]
        if this == pid:
            control = p[3]
            if not control & 0x10:
                continue
            body, access, jump = 4, False, False
            if control & 0x20:
                body = 5 + p[4]
                access, jump = (p[4] > 0 and bool(p[5] & flag_) for flag_ in (0x40, 0x80))
            if last is not None and not jump and control & 15 != last + 1 & 15:
                if control & 15 == last and p[body:] == before and not repeated:
                    repeated = True  # a packet may be sent twice
                    continue
                errors += 1
            last, before, repeated = control & 15, p[body:], False
            if p[1] & 0x40:
                if parts:
                    packets.append((b"".join(parts), flag))
                parts, flag = [], access
            parts.append(p[body:])
        elif this == PAT_PID or this == pmt_pid:
            s = _read_section(p)
            if s is None:
                errors += 1
            elif this == PAT_PID:
                for i in range(8, len(s) - 4, 4):
                    if s[i] << 8 | s[i + 1]:
                        pmt_pid = (s[i + 2] & 0x1F) << 8 | s[i + 3]
                        break
            else:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                if i + 5 <= len(s) - 4:
                    kind, pid = s[i], (s[i + 1] & 0x1F) << 8 | s[i + 2]
    if parts:
        packets.append((b"".join(parts), flag))
    bodies, stamps, size = [], [], 0
    for data, access in packets:
        if data[:3] != b"\x00\x00\x01" or len(data) < 9:
            errors += 1
            continue
        length = int.from_bytes(data[4:6], "big")
        if len(data) != length + 6:
            errors += 1
        if data[7] & 0x80:
            t = data[9:14]
            stamps.append({"pts": (t[0] & 14) << 29 | t[1] << 22 | (t[2] & 254) << 14 | t[3] << 7 | t[4] >> 1, "random_access": access, "at": size})
        bodies.append(data[9 + data[8] : length + 6])
        size += len(bodies[-1])
    return {"payload": b"".join(bodies), "program_pid": pmt_pid, "media_pid": pid, "stream_type": kind, "errors": errors, "stamps": stamps}


def padded(text: str | None) -> tuple[int, bytes]:
    raw = utf8(text)
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT_BYTES if raw else UNIT_BYTES)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the stream of each whole text, and n_bytes of it before padding; null is an empty text.

    Equal texts have equal streams. Rows and other columns stay; columns named as the results are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(media, "n_bytes")
    place = base.columns.index(text)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                sizes, payloads = zip(*map(padded, part.column(place).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(map(mux, payloads), pa.binary())], names=[*part.schema.names, "n_bytes", media])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add("n_bytes", "long").add(media, "binary"))


STREAM = "payload binary, program_pid int, media_pid int, stream_type int, errors int, stamps array<struct<pts: long, random_access: boolean, at: long>>"
_STREAM = pa.struct([("payload", pa.binary()), ("program_pid", pa.int32()), ("media_pid", pa.int32()), ("stream_type", pa.int32()), ("errors", pa.int32()), ("stamps", pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("at", pa.int64())])))])


def read(df: DataFrame, media: str = "media", stream: str = "stream") -> DataFrame:
    """df with what its streams hold, as STREAM; a null stream gives null. The media column stays."""
    base = df.drop(stream)
    place = base.columns.index(media)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found = pa.array([None if m is None else demux(m) for m in part.column(place).to_pylist()], _STREAM)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, stream])

    return base.mapInArrow(run, StructType([*base.schema.fields]).add(stream, StructType.fromDDL(STREAM)))


def _tails(batches):
    """The digests of a stream read back; the last 32 bytes' checksum is of the payload."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        out = []
        for media, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            p, t = s["payload"], s["stamps"]
            feature = f"type={s['stream_type']};pid={s['media_pid']};packets={len(t)};access={sum(x['random_access'] for x in t)};errors={s['errors']};pts={t[0]['pts']}-{t[-1]['pts']}"
            out.append((len(p), sha256(p).hexdigest(), crc32(p[-32:]), len(media), sha256(media).hexdigest(), feature))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every document's stream.

    The streams are written as a media column and read back from there. Null
    texts are empty ones, of one unit; equal texts have equal values.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch(spark, "streams")
    store(docs).select("doc_id", "n_bytes", "media").write.option("compression", "zstd").parquet(path)
    streams = read(spark.read.parquet(path))
    return streams.mapInArrow(_tails, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
