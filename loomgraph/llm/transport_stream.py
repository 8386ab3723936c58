"""Media columns: texts stored as MPEG transport streams and read back.

A text's UTF-8 bytes are padded with zeros to a positive multiple of 64 and stored as the elementary stream of a
one-program transport stream: packets of 188 bytes, a program association and a program map table, and elementary
packets of up to UNIT bytes with presentation timestamps, every KEY_EVERY-th of them a random-access point that carries
the program's clock reference. Reading
parses the tables (checking their CRC), checks the continuity counters, reassembles the elementary packets and lists
timestamps, clock references and random-access points, which are stored as columns. Null texts count as empty; equal texts give equal values; a stream with a lost,
repeated or damaged packet is refused with ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM, PRIVATE_DATA = 0x0000, 0x0100, 0x0101, 1, 0x06
STREAM_ID = 0xBD
UNIT = 16_384
#: 90 kHz ticks between elementary packets (25 a second).
TICKS = 3_600
KEY_EVERY = 8


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, not reflected, all ones first; 0 over a sound section."""
    c, known = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ known[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big") + bytes([PRIVATE_DATA]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + (0xF000).to_bytes(2, "big"))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [np.frombuffer(_tables(), np.uint8)], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        key = unit % KEY_EVERY == 0
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(unit * TICKS) + data
        # The first packet's adaptation field carries the random-access flag, the last one's pads; others are full.
        lead = 8 if key else 0
        n = 1 + max(0, -(-(len(pes) - (BODY - lead)) // BODY))
        spare = n * BODY - lead - len(pes)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = MEDIA_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        field = np.zeros(n, np.int64)  # bytes of adaptation field, its length byte included
        field[0] = lead
        field[-1] += spare
        for i in {0, n - 1}:
            if field[i]:
                packets[i, 3] |= 0x20
                packets[i, 4] = field[i] - 1
                if field[i] > 1:
                    packets[i, 5] = 0x50 if key and i == 0 else 0x00
                if key and i == 0:
                    packets[i, 6:12] = np.frombuffer(((unit * TICKS) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        room = np.arange(BODY) >= field[:, None]
        body = packets[:, 4:]
        body[room] = np.frombuffer(pes, np.uint8)
        out.append(packets.ravel())
    return np.concatenate(out).tobytes()


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    start = 5 + raw[4]
    length = int.from_bytes(raw[start + 1 : start + 3], "big") & 0x0FFF
    section = raw[start : start + 3 + length]
    if raw[start] != table_id or crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, list[int], list[int], list[int]]:
    """(payload, timestamps of the elementary packets, numbers of those that are random-access points, clock references)."""
    packets = np.frombuffer(stream, np.uint8)
    if len(packets) % PACKET:
        raise ValueError("a packet is cut off")
    packets = packets.reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pids = (packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]
    starts = packets[:, 1] & 0x40 > 0

    def first(pid: int) -> np.ndarray:
        at = np.flatnonzero((pids == pid) & starts)
        if not len(at):
            raise ValueError(f"there is no table on {pid}")
        return packets[at[0]]

    programs = _read_section(first(PAT_PID), 0x00)
    pmt_pid = int.from_bytes(programs[2:4], "big") & 0x1FFF
    streams = _read_section(first(pmt_pid), 0x02)
    at = 4 + (int.from_bytes(streams[2:4], "big") & 0x0FFF)
    media_pid = int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
    own = np.flatnonzero(pids == media_pid)
    media, starts = packets[own], starts[own]
    if ((media[:, 3] & 0x0F) != np.arange(len(media)) % 16).any():
        raise ValueError("the continuity counter jumps")
    has_field = media[:, 3] & 0x20 > 0
    field = np.where(has_field, media[:, 4].astype(int) + 1, 0)
    room = np.arange(BODY) >= field[:, None]
    access = has_field & (field > 1) & (media[:, 5] & 0x40 > 0)
    bounds = np.append(np.flatnonzero(starts), len(media))
    clocked = np.flatnonzero(has_field & (field > 7) & (media[:, 5] & 0x10 > 0))
    clocks = [int.from_bytes(media[i, 6:12].tobytes(), "big") >> 15 for i in clocked]
    payload, stamps, keys = [], [], []
    for unit in range(len(bounds) - 1):
        part = slice(bounds[unit], bounds[unit + 1])
        pes = media[part, 4:][room[part]].tobytes()
        if pes[:3] != b"\x00\x00\x01" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("an elementary packet is damaged")
        t = pes[9:14]
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        if access[bounds[unit]]:
            keys.append(unit)
        payload.append(pes[9 + pes[8] :])
    return b"".join(payload), stamps, keys, clocks


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream as column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of the payload and of the stored stream, the timestamps and the random-access points of each stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload, stamps, keys, _ = demux(media)
                packets = len(media) // PACKET
                feature = f"packets={packets};units={len(stamps)};keys={','.join(map(str, keys))};last_pts={stamps[-1]};rate={round(8 * len(media) * 90_000 / (TICKS * len(stamps)))}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, stamps, keys))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in SHAPE[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c, (_, kind) in zip(columns, SHAPE[1:], strict=True))], names=[n for n, _ in SHAPE])

    return stored.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, timestamps array<bigint>, access_points array<int>")


SHAPE = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int32()))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
