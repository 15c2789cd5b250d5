"""MCAP and SQLite recordings: catalogs from summaries, messages by ranges of chunks or rows.

Written from the public MCAP format: magic, then records of an opcode byte, a 64-bit length and a body.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from tideline.sources.stores import plain, store_of

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK = 1, 2, 3, 4, 5, 6
CHUNK_INDEX, STATISTICS, DATA_END = 8, 11, 15


class Body:
    """Little-endian fields of a record, read from the front."""

    def __init__(self, data: memoryview | bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, code: str):
        value = struct.unpack_from(f"<{code}", self.data, self.at)
        self.at += struct.calcsize(f"<{code}")
        return value[0] if len(value) == 1 else value

    def blob(self, size: str = "I") -> memoryview:
        n = self.take(size)
        if self.at + n > len(self.data):
            raise ValueError("record ends early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def text(self) -> str:
        return bytes(self.blob()).decode()

    def pairs(self, code: str) -> list:
        inner = Body(self.blob())
        out = []
        while inner.at < len(inner.data):
            out.append(inner.take(code))
        return out


@dataclass
class Channel:
    """A topic's channel of one file."""

    id: int
    topic: str
    type: str
    encoding: str
    definition: str
    count: int | None = None


@dataclass
class Chunk:
    start: int
    end: int
    offset: int
    length: int
    channels: frozenset[int] | None


@dataclass
class Summary:
    channels: dict[int, Channel] = field(default_factory=dict)
    chunks: list[Chunk] = field(default_factory=list)
    messages: int | None = None


def open_file(path: str) -> pa.NativeFile:
    """A seekable binary file: local ones are mapped into memory, so chunks that aren't compressed are never copied."""
    store, inner, before = store_of(path)
    if not before and store.get_file_info(inner).size:
        return pa.memory_map(inner)
    return store.open_input_file(inner)


def records(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Opcode and body of each whole record."""
    at = 0
    while at + 9 <= len(data):
        op, n = struct.unpack_from("<BQ", data, at)
        if at + 9 + n > len(data):
            return
        yield op, data[at + 9 : at + 9 + n]
        at += 9 + n


def _schema(body: memoryview) -> tuple[int, str, str, bytes]:
    b = Body(body)
    return b.take("H"), b.text(), b.text(), bytes(b.blob())


def _collect(found: Iterator[tuple[int, memoryview]], out: Summary, schemas: dict) -> None:
    for op, body in found:
        if op == SCHEMA:
            i, name, encoding, data = _schema(body)
            schemas[i] = name, encoding, data
        elif op == CHANNEL:
            b = Body(body)
            i, s = b.take("H"), b.take("H")
            name, encoding, data = schemas.get(s, ("", "", b""))
            known = out.channels.get(i)
            out.channels[i] = Channel(i, b.text(), name, encoding, data.decode("utf-8", "replace"), known.count if known else None)
        elif op == CHUNK_INDEX:
            b = Body(body)
            start, end, offset, length = b.take("QQQQ")
            has = frozenset(c for c, _ in b.pairs("HQ"))
            out.chunks.append(Chunk(start, end, offset, length, has or None))
        elif op == STATISTICS:
            b = Body(body)
            out.messages = b.take("QHIIIIQQ")[0]
            for c, n in b.pairs("HQ"):
                if c in out.channels:
                    out.channels[c].count = n


def read_summary(path: str) -> Summary:
    """Channels and chunks: from the summary section, or by walking the file if it has none or lists no chunks."""
    out, schemas = Summary(), {}
    with open_file(path) as f:
        size = f.size()
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        start = 0
        if size > 45:
            f.seek(size - 37)
            tail = f.read(37)
            if tail.endswith(MAGIC) and tail[0] == FOOTER:
                start = struct.unpack_from("<Q", tail, 9)[0]
        if start:
            f.seek(start)
            _collect(records(memoryview(f.read(size - 37 - start))), out, schemas)
            if out.channels and (out.chunks or out.messages == 0):
                return out
        at = 8
        while at + 9 <= size:
            f.seek(at)
            op, n = struct.unpack("<BQ", f.read(9))
            if op == CHUNK:
                body = f.read(n)
                if len(body) < n:
                    break
                b = Body(body)
                first, last = b.take("QQ")
                _collect(((o, x) for o, x in records(unpacked(body)) if o in (SCHEMA, CHANNEL)), out, schemas)
                out.chunks.append(Chunk(first, last, at, n + 9, None))
            elif op in (SCHEMA, CHANNEL):
                _collect(iter([(op, memoryview(f.read(n)))]), out, schemas)
            elif op == MESSAGE and (not out.chunks or out.chunks[-1].offset + out.chunks[-1].length != at):
                out.chunks.append(Chunk(0, 2**63 - 1, at, n + 9, None))
            elif op == MESSAGE:
                out.chunks[-1].length += n + 9
            elif op == DATA_END:
                break
            at += 9 + n
    return out


def unpacked(body: bytes | memoryview) -> memoryview:
    """The records of a chunk."""
    b = Body(body)
    b.take("QQ")
    size = b.take("Q")
    b.take("I")
    how, data = b.text(), b.blob("Q")
    if not how:
        return data
    if how not in ("lz4", "zstd"):
        raise ValueError(f"unknown chunk compression {how!r}")
    return memoryview(pa.Codec(how).decompress(data, size, asbytes=True)) if size else memoryview(b"")


def mcap_messages(path: str, chunks: list[Chunk], channels: frozenset[int], start: int, end: int, payload: bool = True) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(channel, log time, publish time, place of the chunk, place in the chunk, payload) of messages in ``start <= log
    time <= end``. Without ``payload`` only headers are read, and the payloads are empty."""
    with open_file(path) as f:
        for c in chunks:
            f.seek(c.offset)
            data = memoryview(f.read_buffer(c.length))
            inner = unpacked(data[9:]) if data and data[0] == CHUNK else data
            for k, (op, body) in enumerate(records(inner)):
                if op == MESSAGE:
                    channel, _, log, published = struct.unpack_from("<HIQQ", body)
                    if channel in channels and start <= log <= end:
                        yield channel, log, published, c.offset, k, bytes(body[22:]) if payload else b""


def sqlite_summary(path: str) -> Summary:
    """Topics of an SQLite recording, with counts; definitions are not embedded."""
    out = Summary()
    with _sqlite(path) as db:
        counts = dict(db.execute("SELECT topic_id, count(*) FROM messages GROUP BY topic_id"))
        for i, name, kind in db.execute("SELECT id, name, type FROM topics"):
            out.channels[i] = Channel(i, name, kind, "", "", counts.get(i, 0))
        low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
    if low is not None:
        step = 50_000
        out.chunks = [Chunk(0, 2**63 - 1, at, step, None) for at in range(low, high + 1, step)]
    return out


def _sqlite(path: str):
    from contextlib import closing

    return closing(sqlite3.connect(f"file:{plain(path)}?mode=ro&immutable=1", uri=True))


def sqlite_messages(path: str, chunks: list[Chunk], channels: frozenset[int], start: int, end: int, payload: bool = True) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    data = "data" if payload else "x''"
    marks = ",".join("?" * len(channels))
    with _sqlite(path) as db:
        for c in chunks:
            sql = f"SELECT topic_id, timestamp, id, {data} FROM messages WHERE id >= ? AND id < ? AND topic_id IN ({marks}) AND timestamp BETWEEN ? AND ? ORDER BY id"
            for topic, ts, i, raw in db.execute(sql, [c.offset, c.offset + c.length, *sorted(channels), start, end]):
                yield topic, ts, ts, i, 0, bytes(raw)


def is_mcap(path: str) -> bool:
    return os.path.splitext(path)[1] == ".mcap"


def summary_of(path: str) -> Summary:
    return read_summary(path) if is_mcap(path) else sqlite_summary(path)


def messages_of(path: str, *args) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    return (mcap_messages if is_mcap(path) else sqlite_messages)(path, *args)
