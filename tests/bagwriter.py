"""Small writers of recordings for tests: CDR payloads, MCAP files, SQLite files."""

import os
import sqlite3
import struct

import pyarrow as pa

from tideline.sources.containers import CHANNEL, CHUNK, CHUNK_INDEX, DATA_END, FOOTER, HEADER, MAGIC, MESSAGE, SCHEMA, STATISTICS


class Cdr:
    """Builds a payload field by field."""

    def __init__(self, order="<"):
        self.order, self.data = order, bytearray()

    def put(self, code, *values):
        for v in values:
            n = struct.calcsize("<" + code)
            self.data += b"\0" * (-len(self.data) % n) + struct.pack(self.order + code, v)
        return self

    def text(self, s):
        raw = s.encode() + b"\0"
        self.put("I", len(raw))
        self.data += raw
        return self

    def array(self, code, values, count=True):
        if count:
            self.put("I", len(values))
        return self.put(code, *values)

    def bytes(self):
        return (b"\0\1\0\0" if self.order == "<" else b"\0\0\0\0") + bytes(self.data)


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def write_mcap(path, channels, messages, compression="", per_chunk=50, summary=True):
    """channels: {id: (topic, type, definition[, encoding])}; messages: (channel, log, published, payload)."""
    out, index, counts = bytearray(MAGIC + record(HEADER, text("") + text("tests"))), [], {}
    known = b""
    for i, (topic, kind, definition, *encoding) in channels.items():
        raw = definition.encode()
        known += record(SCHEMA, struct.pack("<H", i) + text(kind) + text(encoding[0] if encoding else "ros2msg") + struct.pack("<I", len(raw)) + raw)
        known += record(CHANNEL, struct.pack("<HH", i, i) + text(topic) + text("cdr") + struct.pack("<I", 0))
    for at in range(0, len(messages), per_chunk):
        part = messages[at : at + per_chunk]
        inner = (b"" if at else known) + b"".join(record(MESSAGE, struct.pack("<HIQQ", c, k, log, pub) + data) for k, (c, log, pub, data) in enumerate(part))
        packed = pa.Codec(compression).compress(inner, asbytes=True) if compression else inner
        start, end = min(m[1] for m in part), max(m[1] for m in part)
        body = struct.pack("<QQQI", start, end, len(inner), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed
        offset = len(out)
        out += record(CHUNK, body)
        has = b"".join(struct.pack("<HQ", c, 0) for c in sorted({m[0] for m in part}))
        index.append(record(CHUNK_INDEX, struct.pack("<QQQQ", start, end, offset, len(out) - offset) + struct.pack("<I", len(has)) + has + struct.pack("<Q", 0) + text(compression) + struct.pack("<QQ", len(packed), len(inner))))
        for m in part:
            counts[m[0]] = counts.get(m[0], 0) + 1
    if not messages:
        out += known
    out += record(DATA_END, struct.pack("<I", 0))
    where = len(out) if summary else 0
    if summary:
        pairs = b"".join(struct.pack("<HQ", c, n) for c, n in counts.items())
        stats = struct.pack("<QHIIIIQQ", len(messages), len(channels), len(channels), 0, 0, len(index), 0, 0) + struct.pack("<I", len(pairs)) + pairs
        out += known + b"".join(index) + record(STATISTICS, stats)
    out += record(FOOTER, struct.pack("<QQI", where, 0, 0)) + MAGIC
    with open(path, "wb") as f:
        f.write(out)


def write_db3(path, topics, messages):
    """topics: {id: (topic, type)}; messages: (topic id, timestamp, payload)."""
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT, serialization_format TEXT, offered_qos_profiles TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.executemany("INSERT INTO topics VALUES (?, ?, ?, 'cdr', '')", [(i, *t) for i, t in topics.items()])
    db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", messages)
    db.commit()
    db.close()


def metadata(folder, files, storage="mcap"):
    with open(os.path.join(folder, "metadata.yaml"), "w") as f:
        f.write(f"rosbag2_bagfile_information:\n  storage_identifier: '{storage}'\n  relative_file_paths: [{', '.join(files)}]\n")


TWIST = """std_msgs/Header header
geometry_msgs/Twist twist
================================================================================
MSG: std_msgs/Header
builtin_interfaces/Time stamp
string frame_id  # a frame
================================================================================
MSG: geometry_msgs/Twist
Vector3 linear
Vector3 angular
================================================================================
MSG: geometry_msgs/Vector3
float64 x
float64 y
float64 z
"""


def twist(ns, x, order="<"):
    return Cdr(order).put("i", ns // 10**9).put("I", ns % 10**9).text("base_link").put("d", x, 0.0, 0.0, 0.0, 0.0, -x).bytes()
