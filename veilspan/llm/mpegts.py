"""Media columns: MPEG transport streams that carry a document's bytes.

to_media() stores each payload in packetised elementary stream (PES) packets with timestamps, cut into transport packets
of 188 bytes behind a program association and a program map table.  read_media() parses the tables (over several packets, and again wherever they change), checks continuity counters, puts the
PES packets of the first program's first stream together again and gives payload, timestamps and random-access points.

Edge cases: a null text counts as empty; an empty payload is 64 zero bytes; a broken stream (bad sync, table checksum or
a missing table) gives a null payload and says so in `error`; a jump of the continuity counter is counted unless the stream
announces it, and a packet that is legally sent twice counts once; a PES packet that isn't whole is counted and left out,
the payload is what the others hold, and `error` says so; one without a length goes on to the next; repeated rows are
streams of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
#: Payload bytes of a PES packet; every RAP_EVERY-th starts at a random-access point; ticks of 90 kHz between them.
CHUNK, RAP_EVERY, TICKS = 16_384, 4, 3_600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A program table in one transport packet."""
    section = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += section_crc(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = table_packet(0, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + table_packet(PMT_PID, 2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def pes(chunk: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])
    return b"\x00\x00\x01\xbd" + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + chunk


def packets(data: bytes, counter: int, pcr: int | None) -> tuple[bytes, int]:
    """Transport packets of one PES packet and the counter after them; pcr: of a random-access point, else None."""
    field = b"" if pcr is None else bytes([0x50]) + (pcr << 15 | 0x7E00).to_bytes(6, "big")
    room = 184 - (len(field) + 1 if field else 0)
    out = bytearray()

    def one(piece: bytes, field: bytes, start: bool) -> None:
        nonlocal counter
        spare = 184 - len(piece) - (len(field) + 1 if field else 0)
        if spare or field:
            if not field and spare > 1:
                field, spare = b"\x00", spare - 2
            elif not field:
                spare = 0
            field = field + b"\xff" * spare
            head = bytes([0x30 | counter, len(field)]) + field
        else:
            head = bytes([0x10 | counter])
        out.extend(bytes([SYNC, (0x40 if start else 0) | ES_PID >> 8, ES_PID & 0xFF]) + head + piece)
        counter = counter + 1 & 15

    one(data[:room], field, True)
    rest = data[room:]
    n = len(rest) // 184
    if n:
        block = np.empty((n, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        block[:, 4:] = np.frombuffer(rest, np.uint8, n * 184).reshape(n, 184)
        out.extend(block.tobytes())
        counter = counter + n & 15
    if len(rest) > n * 184:
        one(rest[n * 184 :], b"", False)
    return bytes(out), counter


def mux(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for i in range(0, len(payload), CHUNK):
        k = i // CHUNK
        part, counter = packets(pes(payload[i : i + CHUNK], k * TICKS), counter, k * TICKS if k % RAP_EVERY == 0 else None)
        out.append(part)
    return b"".join(out)


def sections(rows: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes]]:
    """(packet, checked body) of each table section in the packets `at` of one table's stream, those that change nothing
    left out."""
    out: list[tuple[int, bytes]] = []
    held, before = b"", b""

    def whole(k: int) -> None:
        nonlocal held
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            data, held = held[:size], held[size:]
            if size < 12 or section_crc(data):
                raise ValueError("table checksum")
            if not out or out[-1][1] != data[8:-4]:
                out.append((k, data[8:-4]))

    for k in at.tolist():
        p = rows[k].tobytes()
        if not p[3] & 0x10 or p[4:] == before:
            continue
        before, data = p[4:], p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40:
            rest, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            if held:
                held += rest
                whole(k)
            held = b""
        elif not held:
            continue
        held += data
        whole(k)
    return out


def streams(rows: np.ndarray, pid: np.ndarray) -> np.ndarray:
    """For each packet the stream in which the first program's payload then is, as the tables so far say."""
    tables: list[tuple[int, int]] = []
    for k, body in sections(rows, np.flatnonzero(pid == 0)):
        programs = ((int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(body), 4))
        tables += [(k, next(p for n, p in programs if n))]
    if not tables:
        raise ValueError("no program association table")
    out, first = np.full(len(rows), -1, np.int32), True
    for i, (k, table) in enumerate(tables):
        end = tables[i + 1][0] if i + 1 < len(tables) else len(rows)
        maps = np.flatnonzero(pid[:end] == table)
        for j, body in sections(rows, maps[maps >= k] if i else maps):
            stream = body[4 + (int.from_bytes(body[2:4], "big") & 0x0FFF) :]
            out[0 if first else j :] = int.from_bytes(stream[1:3], "big") & 0x1FFF
            first = False
    if first:
        raise ValueError("no program map table")
    return out


def demux(media: bytes) -> dict:
    """payload, packets, pes, jumps (of the continuity counter), broken (PES packets that aren't whole), pts list, rap list
    of (packet, pts)."""
    if not media or len(media) % PACKET:
        raise ValueError("length")
    a = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (a[:, 0] != SYNC).any():
        raise ValueError("sync")
    pid = (a[:, 1] & 0x1F).astype(np.int32) << 8 | a[:, 2]
    at = np.flatnonzero((pid == streams(a, pid)) & (a[:, 1] & 0x80 == 0))
    e = a[at]
    has, count = e[:, 3] & 0x10 != 0, e[:, 3] & 15
    field = np.where(e[:, 3] & 0x20 != 0, e[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(field > 1, e[:, 5], 0)
    step = np.append([1], count[1:] - count[:-1] & 15)
    twice = np.flatnonzero((step == 0) & has)
    if len(twice):
        # a packet may come twice, the same but for its clock
        same = e[twice] == e[twice - 1]
        same[:, 6:12] |= (flags[twice] & 0x10 != 0)[:, None]
        one = np.ones(len(e), bool)
        one[twice[same.all(axis=1)]] = False
        at, e, has, count, field, flags = (x[one] for x in (at, e, has, count, field, flags))
        step = np.append([1], count[1:] - count[:-1] & 15)
    jump = (step != has) & (flags & 0x80 == 0)
    jump[:1] = False
    skip = np.where(has, 4 + field, PACKET)
    data = e[np.arange(PACKET)[None, :] >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    starts = np.flatnonzero(e[:, 1] & 0x40)
    begin = (ends[starts] - (PACKET - skip[starts])).tolist()
    lost = np.add.reduceat(np.append(jump, False), np.append(starts, len(e)))[:-1] - jump[starts] if len(starts) else starts
    parts, pts, rap, broken = [], [], [], 0
    for k, (i, j) in enumerate(zip(begin, [*begin[1:], len(data)], strict=True)):
        p = data[i : i + 14]
        size = int.from_bytes(p[4:6], "big")
        if len(p) < 9 or p[:3] != b"\x00\x00\x01" or lost[k] or size and i + 6 + size > j:
            broken += 1
            continue
        if p[3] == 0xBE:  # padding
            continue
        parts.append(data[i + 9 + p[8] : i + 6 + size if size else j])
        stamped = p[7] & 0x80 and len(p) == 14
        pts.append((p[9] & 0x0E) << 29 | p[10] << 22 | (p[11] & 0xFE) << 14 | p[12] << 7 | p[13] >> 1 if stamped else None)
        if flags[starts[k]] & 0x40:
            rap.append((int(at[starts[k]]), pts[-1]))
    return {"payload": b"".join(parts), "packets": len(a), "pes": len(parts), "jumps": int(jump.sum()), "broken": broken, "pts": pts, "rap": rap}


def padded(data: bytes) -> bytes:
    return data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a transport stream of the text's bytes, padded with 0 to a positive multiple of 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            texts = utf8(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, pes long, jumps long, pts array<long>, random_access array<struct<packet:bigint,pts:bigint>>, error string, payload binary"


def read_media(media: DataFrame, payload: bool = True) -> DataFrame:
    """The columns of `media` but the stream itself, and COLUMNS read from it; payload: whether to give it back, too."""
    others = [f for f in media.schema.fields if f.name != "media"]
    rap = pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            rows = []
            for m in batch["media"].to_pylist():
                m = m or b""
                row = {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
                try:
                    d = demux(m)
                    p = d["payload"]
                    row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:]), "payload": p if payload else None}
                    if d["jumps"] or d["broken"]:
                        row["error"] = f"{d['jumps']} jumps, {d['broken']} broken PES packets"
                    row |= {k: d[k] for k in ("packets", "pes", "jumps", "pts")} | {"random_access": [{"packet": a, "pts": b} for a, b in d["rap"]]}
                except (ValueError, StopIteration, IndexError) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "pts": pa.list_(pa.int64()), "random_access": rap, "error": pa.string(), "payload": pa.binary()}
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), *(pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in names)], names=[*(f.name for f in others), *names])

    return media.select(*(f.name for f in others), "media").mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [COLUMNS]))


def op3_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_media(to_media(table(spark, sf_dir, "documents")), payload=False)
    points = F.array_join(F.transform("random_access", lambda r: F.concat_ws("@", r["packet"].cast("string"), r["pts"].cast("string"))), "+")
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("pes="), "pes"), F.concat(F.lit("jumps="), "jumps"), F.concat(F.lit("last_pts="), F.array_max("pts")), F.concat(F.lit("rap="), points), "error")
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
