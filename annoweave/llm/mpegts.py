"""Media columns: documents carried in MPEG transport streams.

`mux` stores a payload losslessly as the private stream of a one-program transport stream
(ISO/IEC 13818-1): a PAT and a PMT, then PES packets of up to `PES_BYTES` payload bytes, each with
a PTS and starting with the random-access indicator and a PCR. `demux` parses any such stream from
its bytes: program tables (with their CRC), continuity counters, PES reassembly, timestamps and
random-access points. Work is per row, in Arrow batches, without a shuffle: it scales with the
number of input splits and a lost executor only repeats its own splits.

Nulls count as empty payloads, which still give one padded unit; equal payloads, repeated rows too, give equal streams. A very long
text is many PES packets. An empty table gives an empty result; other columns are ignored, whatever their names.
A damaged stream does not raise: lost packets show up as `continuity_errors`, bad tables as
`table_errors`, and only bytes that were really carried come back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table, text_or_empty, type_of

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_STREAM_1, STREAM_TYPE_PRIVATE = 0xBD, 0x06
CLOCK = 90_000

#: Payload bytes in one PES packet, and the time between two of them in 90 kHz ticks.
PES_BYTES = 32_768
PES_TICKS = 3_600
UNIT = 64


def _crc32_mpeg_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc32_mpeg_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables; over a section with its own CRC it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with bytes 0 up to a positive multiple of unit."""
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0")


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + struct.pack(">H", 0xB000 | (len(body) + 4))
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0x00, struct.pack(">HBBBHH", 1, 0xC1, 0, 0, 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, struct.pack(">HBBBHHBHH", 1, 0xC1, 0, 0, 0xE000 | DATA_PID, 0xF000, STREAM_TYPE_PRIVATE, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, pes_bytes: int = PES_BYTES) -> bytes:
    """A transport stream that carries the payload."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, max(1, len(payload)), pes_bytes)):
        part, pts = payload[at : at + pes_bytes], k * PES_TICKS
        # PTS flag set, header of 5 bytes; the length counts what follows it.
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM_1, len(part) + 8, 0x84, 0x80, 5) + _stamp(pts) + part
        pcr = struct.pack(">BB", 7, 0x50) + struct.pack(">IH", (pts >> 1) & 0xFFFFFFFF, (pts & 1) << 15 | 0x7E00)
        n_first = PACKET - 4 - len(pcr)
        if len(pes) < n_first:  # all in one packet, the adaptation field takes up the rest
            pcr = bytes([7 + n_first - len(pes)]) + pcr[1:] + b"\xff" * (n_first - len(pes))
        first = struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, 0x30 | counter & 15) + pcr + pes[:n_first]
        out.append(first)
        counter += 1
        rest = pes[n_first:]
        whole = len(rest) // (PACKET - 4)
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(block.tobytes())
            counter += whole
        tail = rest[whole * (PACKET - 4) :]
        if tail:
            stuff = PACKET - 5 - len(tail)
            field = b"\0" if stuff == 0 else bytes([stuff, 0]) + b"\xff" * (stuff - 1)
            if stuff == 0:
                field = bytes([0])
            out.append(struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter & 15) + field + tail)
            counter += 1
    return b"".join(out)


def _program_pid(packets: np.ndarray, pid: np.ndarray, at: int, table_id: int) -> tuple[list[tuple[int, int]], int]:
    """(number or stream type, PID) pairs of the tables on one PID, and how many sections were bad."""
    found: list[tuple[int, int]] = []
    bad = 0
    for row in packets[(pid == at) & (packets[:, 1] & 0x40 > 0)]:
        b = row.tobytes()
        start = 4 + (1 + b[4] if b[3] & 0x20 else 0)
        if start >= PACKET:
            bad += 1
            continue
        start += 1 + b[start]
        size = struct.unpack(">H", b[start + 1 : start + 3])[0] & 0xFFF if start + 3 <= PACKET else 0
        section = b[start : start + 3 + size]
        if len(section) < 12 or section[0] != table_id or len(section) != 3 + size or crc32_mpeg(section):
            bad += 1
            continue
        if table_id == 0:
            found += [(n, p & 0x1FFF) for n, p in struct.iter_unpack(">HH", section[8 : len(section) - 4 - (len(section) - 12) % 4]) if n]
        else:
            i = 12 + (struct.unpack(">H", section[10:12])[0] & 0xFFF)
            while i + 5 <= len(section) - 4:
                kind, p, more = struct.unpack(">BHH", section[i : i + 5])
                found.append((kind, p & 0x1FFF))
                i += 5 + (more & 0xFFF)
    return list(dict.fromkeys(found)), bad


def elementary(own: np.ndarray) -> dict:
    """What the packets of one PID carry: payload, timestamps, random-access points and faults.

    A packet may be sent twice in a row with the same counter (the clock reference in it may differ); the repeat is dropped and is
    no error. A jump of the counter is none where the adaptation field announces a discontinuity.
    """
    out = {"continuity_errors": 0, "repeated": 0, "bad_packets": 0, "pts": [], "random_access": [], "payload": b""}
    has_data = own[:, 3] & 0x10 > 0
    has_field = own[:, 3] & 0x20 > 0
    start = np.where(has_field, 5 + own[:, 4].astype(int), 4)
    counter = own[:, 3].astype(int) & 15
    keep, last = has_data.copy(), None
    for i in np.flatnonzero(has_data):
        if last is not None:
            step = (counter[i] - counter[last]) % 16
            announced = bool(has_field[i] and own[i, 4] and own[i, 5] & 0x80)
            if step == 0 and not announced and (own[i, 1:4] == own[last, 1:4]).all() and start[i] == start[last] and (own[i, start[i] :] == own[last, start[last] :]).all():
                keep[i] = False
                out["repeated"] += 1
                continue
            if step != 1 and not announced:
                out["continuity_errors"] += 1
        last = i
    own, start, has_field = own[keep], start[keep], has_field[keep]
    payload = []
    begins = np.flatnonzero(own[:, 1] & 0x40)
    for k, b in enumerate(begins):
        e = begins[k + 1] if k + 1 < len(begins) else len(own)
        pieces, i = [], b
        while i < e:
            if has_field[i]:
                pieces.append(own[i, start[i] :].tobytes())
                i += 1
            else:  # a run of packets without an adaptation field
                stop = np.flatnonzero(has_field[i:e])
                j = i + int(stop[0]) if len(stop) else e
                pieces.append(own[i:j, 4:].tobytes())
                i = j
        pes = b"".join(pieces)
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            out["bad_packets"] += 1
            continue
        size, flags, more = struct.unpack(">H", pes[4:6])[0], pes[7], pes[8]
        if flags & 0x80 and more >= 5:
            out["pts"].append(_read_stamp(pes[9:14]))
        if has_field[b] and own[b, 4] and own[b, 5] & 0x40:
            out["random_access"].append(len(payload))
        payload.append(pes[9 + more : 6 + size if size else None])
    out["payload"] = b"".join(payload)
    return out


def demux(stream: bytes) -> dict:
    """What a transport stream carries: all elementary streams of all programs (`elementary`, by PID), and its faults.

    `payload`, `pts` and `random_access` are those of the first stream of the first program; continuity errors and repeats are
    counted over all streams.
    """
    n = len(stream) // PACKET
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    packets = packets[packets[:, 0] == SYNC]
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    programs, bad = _program_pid(packets, pid, PAT_PID, 0x00)
    out = {"packets": n, "lost_sync": n - len(packets), "programs": programs, "streams": [], "table_errors": bad, "continuity_errors": 0, "repeated": 0, "pts": [], "random_access": [], "payload": b"", "elementary": {}}
    for _, table_pid in programs:
        streams, bad = _program_pid(packets, pid, table_pid, 0x02)
        out["streams"] += streams
        out["table_errors"] += bad
    for _, own_pid in out["streams"]:
        if own_pid not in out["elementary"]:
            found = out["elementary"][own_pid] = elementary(packets[pid == own_pid])
            out["continuity_errors"] += found["continuity_errors"]
            out["repeated"] += found["repeated"]
            out["table_errors"] += found["bad_packets"]
    if out["elementary"]:
        first = next(iter(out["elementary"].values()))
        out |= {k: first[k] for k in ("pts", "random_access", "payload")}
    return out


def store_streams(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every text as UTF-8, padded to whole units and stored in a transport stream."""

    def kernel():
        def run(part: dict) -> dict:
            raw = [t.encode() for t in part["text"].to_pylist()]
            return {"doc_id": part["doc_id"], "n_bytes": [len(r) for r in raw], "media": [mux(padded(r)) for r in raw]}

        return run

    rows = text_or_empty(df, doc_id, text=text).toDF("doc_id", "text")
    return map_slices(rows, kernel, f"doc_id {type_of(df, doc_id)}, n_bytes long, media binary", rows=100)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, continuity_errors long, random_access array<long>, pts array<long>"


def stream_features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns and what `demux` reads from each stored stream; a null stream counts as an empty one."""
    inner = [f"_k{k}" for k in range(len(keep))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(keep, inner, strict=True)], F.coalesce(df[media], F.lit(b"")).alias("_media"))
    head = "".join(f"{n} {type_of(df, c)}, " for c, n in zip(keep, inner, strict=True))
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def kernel():
        def run(part: dict) -> dict:
            found = []
            for m in part["_media"].to_pylist():
                x = demux(m)
                p, pts = x["payload"], x["pts"]
                length = (pts[-1] - pts[0] + PES_TICKS) / CLOCK if pts else 0
                feature = f"packets={x['packets']};programs={len(x['programs'])};streams={len(x['streams'])};pes={len(pts)};seconds={length:.3f};random_access={len(x['random_access'])};continuity_errors={x['continuity_errors']};table_errors={x['table_errors']}"
                found.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, x["continuity_errors"], x["random_access"], pts))
            return {n: part[n] for n in inner} | {n: [f[k] for f in found] for k, n in enumerate(names)}

        return run

    return map_slices(rows, kernel, head + FEATURES, rows=100).withColumnsRenamed(dict(zip(inner, keep, strict=True)))


def op3(spark, sf_dir):
    return stream_features(store_streams(table(spark, sf_dir, "documents")))
