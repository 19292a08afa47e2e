"""Media columns: texts stored as MPEG transport streams and read back.

A payload is the text in UTF-8, filled with bytes 255 to a positive multiple of FRAME. Each frame of FRAME 8-bit
samples is one elementary-stream packet with a presentation time; it fills four transport packets, the first with a
clock reference, and with the random-access flag at every RANDOM_ACCESS-th frame. The stream opens with its program
association and program map tables.

Reading back trusts nothing but the bytes: it checks sync bytes, the tables' checksums and the continuity counters,
finds the elementary stream through the tables, reassembles its packets and takes times and random-access points.

Cases: a null or empty text is one frame of bytes 255; texts of any length are stored whole; equal texts give equal
values; repeated rows give repeated results; extra columns are kept, and columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fintally.llm.common import slices, table

FRAME, RANDOM_ACCESS = 576, 8
# Fixed values of the container format and of this stream.
PACKET, SYNC, PROGRAM, MAP_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 1, 0x1000, 0x0100, 0x06, 0xBD
#: Ticks of the 90 kHz clock for a frame at 48,000 samples a second.
TICKS = FRAME * 90_000 // 48_000
_PARTS = 4  # transport packets of a frame: 590 bytes with the header, in 176 + 3 x 184 bytes less stuffing


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section_packet(pid: int, table_id: int, extension: int, body: bytes) -> np.ndarray:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, extension >> 8, extension & 255, 0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


TABLES = np.stack(
    [
        _section_packet(0, 0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | MAP_PID >> 8, MAP_PID & 255])),
        _section_packet(MAP_PID, 2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0])),
    ]
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The filled payload of a text, and its bytes before filling."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload of whole frames."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    n = len(frames)
    pts = np.arange(n, dtype=np.int64) * TICKS % (1 << 33)
    head = np.zeros((n, 14), np.uint8)  # elementary packet: start code, id, length, flags, presentation time
    head[:, :9] = (0, 0, 1, STREAM_ID, (FRAME + 8) >> 8, (FRAME + 8) & 255, 0x80, 0x80, 5)
    head[:, 9] = 0x21 | (pts >> 30 & 7) << 1
    head[:, 10] = pts >> 22 & 255
    head[:, 11] = (pts >> 15 & 127) << 1 | 1
    head[:, 12] = pts >> 7 & 255
    head[:, 13] = (pts & 127) << 1 | 1
    unit = np.concatenate([head, frames], axis=1)
    out = np.full((n, _PARTS, PACKET), 255, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = MEDIA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = MEDIA_PID & 255
    counter = np.arange(n * _PARTS).reshape(n, _PARTS) % 16
    out[:, :, 3] = 0x10 | counter
    # first packet: adaptation field of 8 bytes with the clock reference; last: stuffing
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 7
    out[:, 0, 5] = 0x10 | np.where(np.arange(n) % RANDOM_ACCESS == 0, 0x40, 0)
    out[:, 0, 6] = pts >> 25 & 255
    out[:, 0, 7] = pts >> 17 & 255
    out[:, 0, 8] = pts >> 9 & 255
    out[:, 0, 9] = pts >> 1 & 255
    out[:, 0, 10] = (pts & 1) << 7 | 0x7E
    out[:, 0, 11] = 0
    rest = unit.shape[1] - 176 - 2 * 184
    stuffed = 184 - rest
    out[:, 0, 12:] = unit[:, :176]
    out[:, 1, 4:] = unit[:, 176:360]
    out[:, 2, 4:] = unit[:, 360:544]
    out[:, 3, 3] |= 0x20
    out[:, 3, 4] = stuffed - 1
    out[:, 3, 5] = 0
    out[:, 3, 4 + stuffed :] = unit[:, 544:]
    return TABLES.tobytes() + out.tobytes()


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes
    program: int
    pid: int
    times: list[int]
    random_access: list[int]  # byte positions of packets that start at a random-access point
    lost: int  # continuity errors


def _section(packet: np.ndarray) -> bytes:
    start = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    start += 1 + int(packet[start])
    size = 3 + (int(packet[start + 1] & 15) << 8 | int(packet[start + 2]))
    section = packet[start : start + size].tobytes()
    if crc32_mpeg(section):
        raise ValueError("a program table's checksum is wrong")
    return section


_sections: dict[bytes, bytes] = {}


def _checked(packet: np.ndarray) -> bytes:
    """The section of a packet; its checksum is computed once for equal bytes."""
    raw = packet.tobytes()
    if raw not in _sections:
        if len(_sections) > 64:
            _sections.clear()
        _sections[raw] = _section(packet)
    return _sections[raw]


def read_stream(media: bytes) -> Stream:
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 > 0
    association = _checked(packets[np.flatnonzero((pid == 0) & starts)[0]])
    program, map_pid = association[8] << 8 | association[9], (association[10] & 31) << 8 | association[11]
    table_ = _checked(packets[np.flatnonzero((pid == map_pid) & starts)[0]])
    at = 12 + ((table_[10] & 15) << 8 | table_[11])
    media_pid = (table_[at + 1] & 31) << 8 | table_[at + 2]
    of = np.flatnonzero(pid == media_pid)
    own, starts = packets[of], starts[of]
    adapted = own[:, 3] & 0x20 > 0
    begin = 4 + np.where(adapted, 1 + own[:, 4].astype(np.int64), 0)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    counter = own[:, 3] & 15
    lost = int(((counter[1:] - counter[:-1]) % 16 != 1).sum())
    body = own[np.arange(PACKET)[None] >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    first = (ends - (PACKET - begin))[starts]
    head = body[first[:, None] + np.arange(14)[None]].astype(np.int64)
    if (head[:, :3] != (0, 0, 1)).any():
        raise ValueError("an elementary packet has no start code")
    times = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    skip = 9 + head[:, 8]
    keep = np.ones(len(body), bool)
    for k in range(int(skip.max())):
        keep[first[skip > k] + k] = False
    return Stream(body[keep].tobytes(), program, media_pid, times.tolist(), (of[starts & (flags & 0x40 > 0)] * PACKET).tolist(), lost)


def stored(df: DataFrame, *, text_col: str = "text", media: bool = True) -> DataFrame:
    """df with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with media also
    the stream itself (media), its times (pts) and the byte positions of its random-access points (random_access)."""
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    names = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    if media:
        types |= {"media": pa.binary(), "pts": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}
        names |= {"media": "binary", "pts": T.ArrayType(T.LongType()), "random_access": T.ArrayType(T.LongType())}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = type(df.schema)([*kept])
    for name, kind in names.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            rows = []
            for text in part.column(text_col).to_pylist():
                payload, n = payload_of(text)
                stream = write_stream(payload)
                back = read_stream(stream)
                if back.payload != payload or back.lost:
                    raise ValueError("a stream gives back other bytes than were stored")
                feature = f"program={back.program};pid={back.pid};frames={len(back.times)};pts={back.times[0]}-{back.times[-1]};random_access={len(back.random_access)};lost={back.lost}"
                row = [n, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature]
                rows.append(row + ([stream, back.times, back.random_access] if media else []))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the digests of every document's stream."""
    out = stored(table(spark, sf_dir, "documents").select("doc_id", "text"), media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
