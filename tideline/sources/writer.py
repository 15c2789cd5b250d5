"""Recordings written by Spark: CDR payloads of flat messages, and MCAP files of a frame of messages.

``df.write.format("rosbag_messages").option("types", json).save(folder)`` writes one file a task; the frame has
``topic, recv_time_ns, publish_time_ns, data``, as the source of that name gives them back.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from tideline.sources import stores
from tideline.sources.containers import CHANNEL, CHUNK, CHUNK_INDEX, DATA_END, FOOTER, HEADER, MAGIC, MESSAGE, SCHEMA, STATISTICS
from tideline.sources.msgdef import PRIMITIVES

#: Bytes of the messages of one chunk.
CHUNK_BYTES = 1 << 20


def payload(**fields: tuple[str, Column]) -> Column:
    """The CDR payload (``binary``) of a message of numbers, little-endian: ``name=(primitive type, column)`` in order.

    A null number is written as 0, as messages have no nulls.
    """
    names, at, places = [], 0, []
    for name, (base, _) in fields.items():
        code = PRIMITIVES[base][0]
        n = struct.calcsize(f"<{code}")
        at += -at % n
        places.append((name, f"<{code}", at))
        at += n
        names.append(name)
    record = np.dtype({"names": names, "formats": [c for _, c, _ in places], "offsets": [4 + o for _, _, o in places], "itemsize": 4 + at})

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(rows), record)
        for name in names:
            out[name] = rows[name].fillna(0)
        raw = out.view(np.uint8).reshape(len(rows), -1)
        raw[:, 1] = 1  # little-endian CDR
        return pd.Series([r.tobytes() for r in raw], dtype=object)

    return encode(F.struct(*[c.alias(n) for n, (_, c) in fields.items()]))


def _text(s: str) -> bytes:
    return struct.pack("<I", len(s.encode())) + s.encode()


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


class Mcap:
    """One file, chunk by chunk. Channels are numbered from 1 in the order of ``types`` (topic -> (type, definition))."""

    def __init__(self, out, types: dict[str, tuple[str, str]], compression: str = "zstd"):
        self.out, self.at, self.compression = out, 0, compression
        self.ids = {topic: i for i, topic in enumerate(types, 1)}
        self.known = b""
        for topic, i in self.ids.items():
            kind, definition = types[topic]
            raw = definition.encode()
            self.known += _record(SCHEMA, struct.pack("<H", i) + _text(kind) + _text("ros2msg") + struct.pack("<I", len(raw)) + raw)
            self.known += _record(CHANNEL, struct.pack("<HH", i, i) + _text(topic) + _text("cdr") + struct.pack("<I", 0))
        self.index, self.counts, self.messages = [], dict.fromkeys(self.ids.values(), 0), 0
        self._begin()
        self._put(MAGIC + _record(HEADER, _text("") + _text("tideline")) + self.known)

    def _begin(self) -> None:
        self.inner, self.start, self.end, self.has = bytearray(), 2**63 - 1, 0, set()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def message(self, topic: str, log: int, published: int, data: bytes) -> None:
        i = self.ids[topic]
        self.inner += _record(MESSAGE, struct.pack("<HIQQ", i, self.messages & 0xFFFFFFFF, log, published) + data)
        self.start, self.end = min(self.start, log), max(self.end, log)
        self.has.add(i)
        self.counts[i] += 1
        self.messages += 1
        if len(self.inner) >= CHUNK_BYTES:
            self._chunk()

    def _chunk(self) -> None:
        inner, how = bytes(self.inner), self.compression
        packed = pa.Codec(how).compress(inner, asbytes=True) if how else inner
        offset = self.at
        self._put(_record(CHUNK, struct.pack("<QQQI", self.start, self.end, len(inner), 0) + _text(how) + struct.pack("<Q", len(packed)) + packed))
        has = b"".join(struct.pack("<HQ", c, 0) for c in sorted(self.has))
        times = struct.pack("<QQQQI", self.start, self.end, offset, self.at - offset, len(has))
        self.index.append(_record(CHUNK_INDEX, times + has + struct.pack("<Q", 0) + _text(how) + struct.pack("<QQ", len(packed), len(inner))))
        self._begin()

    def close(self) -> None:
        if self.inner:
            self._chunk()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        where = self.at
        pairs = b"".join(struct.pack("<HQ", c, n) for c, n in self.counts.items())
        stats = struct.pack("<QHIIIIQQI", self.messages, len(self.ids), len(self.ids), 0, 0, len(self.index), 0, 0, len(pairs)) + pairs
        self._put(self.known + b"".join(self.index) + _record(STATISTICS, stats) + _record(FOOTER, struct.pack("<QQI", where, 0, 0)) + MAGIC)


@dataclass
class Written(WriterCommitMessage):
    file: str


class McapWriter(DataSourceArrowWriter):
    """A file a task, under a name of its own; those of failed tasks and jobs are deleted, so a retry leaves no copies."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.compression = options["path"], options.get("compression", "zstd")
        self.types = {topic: tuple(t) for topic, t in json.loads(options["types"]).items()}
        if overwrite:
            stores.delete(self.folder)
        stores.make_folder(self.folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        path = f"{self.folder.rstrip('/')}/{uuid.uuid4().hex}.mcap.part"
        store, inner, _ = stores.store_of(path)
        with store.open_output_stream(inner) as out:
            file = Mcap(out, self.types, self.compression)
            for b in batches:
                columns = (b.column(n).to_pylist() for n in ("topic", "recv_time_ns", "publish_time_ns", "data"))
                for topic, log, published, data in zip(*columns, strict=True):
                    file.message(topic, log, published, data)
            file.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        """Only files of committed tasks get a name that readers see."""
        for m in messages:
            if m is not None:
                store, inner, _ = stores.store_of(m.file)
                store.move(inner, inner.removesuffix(".part"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                stores.delete(m.file)
