"""Recordings: the ``rosbag`` and ``rosbag_messages`` data sources, a catalog of topics, and a Parquet cache.

``spark.read.format("rosbag").option("topic", "/odom").load(path)`` after :func:`register`; or
``open_recording(spark, path)["/odom"]``. Messages come as nested structs beside ``recv_time_ns``,
``publish_time_ns`` and ``seq`` (with the receive time a unique order). ``rosbag_messages`` reads the raw messages of
any number of topics in one pass, and writes them. Partitions are ranges of chunks; chunks that lack the topics, or
lie outside the times asked for, are not read, be these named by options or by filters on ``recv_time_ns`` and ``topic``.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tideline.operators.fields import leaves
from tideline.sources import stores
from tideline.sources.cdr import DecodeError, Plan
from tideline.sources.containers import Channel, Chunk, Summary, messages_of, summary_of
from tideline.sources.msgdef import Layouts, common_layouts, parse_schema, register_msg_types, short, spark_type
from tideline.sources.writer import McapWriter

DATA = (".mcap", ".db3")
READERS = ("mcap", "sqlite3")
TIMES = [T.StructField("recv_time_ns", T.LongType()), T.StructField("publish_time_ns", T.LongType()), T.StructField("seq", T.LongType())]
#: Rows, and bytes of payloads, of one batch.
BATCH, BATCH_BYTES = 4096, 8 << 20
MAX_NS = 2**63 - 1


def available_readers() -> tuple[str, ...]:
    return READERS


def _metadata(path: str) -> dict:
    try:
        import yaml
    except ImportError:
        return {}
    try:
        return (yaml.safe_load(stores.read_text(f"{path.rstrip('/')}/metadata.yaml")) or {}).get("rosbag2_bagfile_information", {})
    except OSError:
        return {}


def _files(path: str) -> list[stores.Entry]:
    path = stores.plain(path)
    there = stores.listed(path)
    if len(there) == 1 and there[0].path == path:
        return there
    by_name = {os.path.basename(e.path): e for e in there if e.path.endswith(DATA)}
    first = [f for f in _metadata(path).get("relative_file_paths", []) if f in by_name]
    return [by_name[f] for f in first + [f for f in by_name if f not in first]]


def data_files(path: str) -> list[str]:
    """The recording's data files: in the metadata's order, others by name."""
    return [e.path for e in _files(path)]


def storage_of(path: str) -> str:
    """``mcap`` or ``sqlite3``: as the metadata says, else by extension. Nothing is written back."""
    said = _metadata(stores.plain(path)).get("storage_identifier")
    files = data_files(path)
    return said or ("mcap" if files and files[0].endswith(".mcap") else "sqlite3")


def find_bags(pattern: str) -> list[str]:
    """Folders with a data file, in order of their newest data file. The last part of the pattern may hold wildcards."""
    above, _, name = stores.plain(pattern).rstrip("/").rpartition("/")
    store, inner, before = stores.store_of(above or "/")
    found = []
    for d in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if d.type == fs.FileType.Directory and fnmatch(d.base_name, name):
            files = [e for e in stores.listed(before + d.path) if e.path.endswith(DATA)]
            if files:
                found.append((max(e.mtime_ns for e in files), before + d.path))
    return [d for _, d in sorted(found)]


def latest_bag(pattern: str) -> str:
    """The newest recording; the choice without a terminal."""
    found = find_bags(pattern)
    if not found:
        raise FileNotFoundError(f"no recordings match {pattern}")
    return found[-1]


@dataclass(frozen=True)
class Part(InputPartition):
    file: str
    chunks: tuple[Chunk, ...]
    channels: frozenset[int]


def _layouts(type_name: str, definition: str, msg_paths: Sequence[str]) -> Layouts:
    if definition:
        return parse_schema(definition, type_name)
    layouts = common_layouts()
    register_msg_types(msg_paths, layouts)
    if short(type_name) not in layouts:
        raise ValueError(f"no definition of {type_name}; give its folder with msg_paths")
    return layouts


class _ChunkReader(DataSourceReader):
    """What both sources share: which chunks of which files hold messages of the topics and times asked for."""

    def __init__(self, options: dict[str, str], topics: set[str] | None):
        entries = _files(options["path"])
        self.topics = topics
        self.start, self.end = int(options.get("start_ns", 0)), int(options.get("end_ns", MAX_NS))
        self.per_part = max(1, int(options.get("chunks_per_partition", 64)))
        self.before, total = {}, 0
        for e in entries:
            self.before[e.path] = total
            total += e.size
        self.shift = min(20, 62 - total.bit_length())
        with ThreadPoolExecutor(16) as pool:
            self.summaries = dict(zip(self.before, pool.map(summary_of, self.before), strict=True))
        self.known: dict[str, Channel] = {}
        for s in self.summaries.values():
            for c in s.channels.values():
                self.known.setdefault(c.topic, c)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ``recv_time_ns`` and sets of topics; the others are left to Spark."""
        for f in filters:
            if f.attribute == ("recv_time_ns",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif f.attribute == ("recv_time_ns",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value - isinstance(f, LessThan))
            elif f.attribute == ("recv_time_ns",) and isinstance(f, EqualTo):
                self.start, self.end = max(self.start, f.value), min(self.end, f.value)
            elif f.attribute == ("topic",) and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.topics = wanted if self.topics is None else self.topics & wanted
            else:
                yield f

    def partitions(self) -> list[Part]:
        parts = []
        for f, s in self.summaries.items():
            mine = frozenset(i for i, c in s.channels.items() if self.topics is None or c.topic in self.topics)
            use = [c for c in s.chunks if (c.channels is None or c.channels & mine) and c.end >= self.start and c.start <= self.end] if mine else []
            parts += [Part(f, tuple(use[i : i + self.per_part]), mine) for i in range(0, len(use), self.per_part)]
        return parts or [Part("", (), frozenset())]

    def messages(self, part: Part, payload: bool = True) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(channel, receive time, publish time, seq, payload)"""
        if not part.file or self.start > self.end:
            return
        before = self.before[part.file]
        for channel, log, published, place, k, data in messages_of(part.file, list(part.chunks), part.channels, self.start, self.end, payload):
            if k >> self.shift:
                raise ValueError(f"{part.file}: a chunk holds too many messages for a recording of this size")
            yield channel, log, published, (before + place << self.shift) + k, data


class RosbagReader(_ChunkReader):
    """One topic, decoded."""

    def __init__(self, options: dict[str, str]):
        self.topic = options.get("topic", "")
        super().__init__(options, {self.topic})
        self.fields = [f.strip() for f in options.get("fields", "").split(",") if f.strip()] or None
        self.strict = options.get("mode", "permissive").lower() == "failfast"
        if self.topic not in self.known:
            raise KeyError(f"no topic {self.topic!r}; there are {sorted(self.known)}")
        if any(c.encoding not in ("", "ros2msg") for s in self.summaries.values() for c in s.channels.values() if c.topic == self.topic):
            raise ValueError(f"{self.topic}: only ros2msg definitions are supported")
        self.type = short(self.known[self.topic].type)
        self.layouts = _layouts(self.type, self.known[self.topic].definition, [p for p in options.get("msg_paths", "").split(",") if p])
        Plan(self.layouts, self.type, self.fields)  # KeyError for fields that aren't there

    def schema(self) -> T.StructType:
        message = spark_type(self.layouts, self.type)
        return T.StructType(TIMES + (_pruned(message, set(self.fields)) if self.fields else message).fields)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        messages = self.messages(part)
        return decoded(((log, published, seq, data) for _, log, published, seq, data in messages), Plan(self.layouts, self.type, self.fields), self.strict)


def decoded(messages: Iterable[tuple[int, int, int, bytes]], plan: Plan, strict: bool) -> Iterator[pa.RecordBatch]:
    """Batches of the times and decoded fields of (receive time, publish time, seq, payload). Payloads that don't fit
    are skipped, or raise if ``strict``."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        kept, columns = plan.decode_all([m[3] for m in held], strict)
        keys = [pa.array([held[k][i] for k in kept], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*keys, *columns.values()], names=[*(f.name for f in TIMES), *columns])

    for message in messages:
        held.append(message)
        size += len(message[3])
        if len(held) >= BATCH or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class MessagesReader(_ChunkReader):
    """Several topics in one pass: each chunk is read and unpacked once, whatever the number of topics."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options, set(json.loads(options["topics"])) if "topics" in options else None)
        self.payload = options.get("payload", "true").lower() == "true"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = {i: c.topic for i, c in self.summaries[part.file].channels.items()} if part.file else {}
        schema = pa.schema([("topic", pa.string()), *((f.name, pa.int64()) for f in TIMES), *([("data", pa.binary())] if self.payload else [])])
        rows: list[tuple] = []
        size = 0
        for channel, log, published, seq, data in self.messages(part, self.payload):
            rows.append((names[channel], log, published, seq, data))
            size += len(data)
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)


def _pruned(s: T.StructType, fields: set[str], prefix: str = "") -> T.StructType:
    """The struct with only the wanted leaves, in definition order."""
    out = []
    for f in s.fields:
        path = prefix + f.name
        if path in fields:
            out.append(f)
        elif isinstance(f.dataType, T.StructType) and (inner := _pruned(f.dataType, fields, f"{path}.")).fields:
            out.append(T.StructField(f.name, inner))
    return T.StructType(out)


class RosbagSource(DataSource):
    """Options: ``topic``; ``fields`` (leaf paths, comma-separated: the source's column pruning); ``start_ns``,
    ``end_ns``; ``msg_paths``; ``mode`` (permissive skips bad payloads, failfast raises); ``chunks_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> T.StructType:
        return RosbagReader(dict(self.options)).schema()

    def reader(self, schema: T.StructType) -> RosbagReader:
        return RosbagReader(dict(self.options))


class MessagesSource(DataSource):
    """Raw messages: ``topic, recv_time_ns, publish_time_ns, seq, data``. Options: ``topics`` (a JSON list; all if
    absent); ``payload`` (``false`` reads headers only, without ``data``); ``start_ns``, ``end_ns``;
    ``chunks_per_partition``. To write: ``types`` (JSON: topic -> [type, definition]), ``compression``."""

    @classmethod
    def name(cls) -> str:
        return "rosbag_messages"

    def schema(self) -> T.StructType:
        data = [T.StructField("data", T.BinaryType())] if self.options.get("payload", "true").lower() == "true" else []
        return T.StructType([T.StructField("topic", T.StringType()), *TIMES, *data])

    def reader(self, schema: T.StructType) -> MessagesReader:
        return MessagesReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> McapWriter:
        return McapWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RosbagSource)
    spark.dataSource.register(MessagesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Recording:
    """A lazy catalog of one recording: topics and their frames. Also a context manager."""

    def __init__(self, spark: SparkSession, path: str, msg_paths: Iterable[str] = (), use_cache: bool = True, backend: str = "auto"):
        if backend not in ("auto", *READERS):
            raise ValueError(f"Unknown backend: {backend!r} (auto, {', '.join(READERS)})")
        self.path = stores.plain(path)
        if stores.kind(self.path) == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        self.spark, self.msg_paths, self.use_cache = spark, tuple(msg_paths), use_cache
        if backend != "auto" and backend != storage_of(self.path):
            raise ValueError(f"{self.path} holds {storage_of(self.path)}, not {backend}")
        register(spark)
        self._frames: dict[tuple, DataFrame] = {}
        self._read: tuple[dict, list[Summary]] | None = None

    @property
    def topics(self) -> dict[str, str]:
        """Topic -> message type, from the files' summaries."""
        return dict(sorted({c.topic: c.type for s in self._summaries() for c in s.channels.values()}.items()))

    def _summaries(self) -> list[Summary]:
        """Read anew when the files have changed."""
        mark = self._fingerprint()
        if self._read is None or self._read[0] != mark:
            with ThreadPoolExecutor(16) as pool:
                self._read = mark, list(pool.map(summary_of, data_files(self.path)))
        return self._read[1]

    def catalog(self) -> DataFrame:
        """``topic, msg_type, message_count`` (null where the file has no statistics)."""
        rows: dict[str, list] = {}
        for s in self._summaries():
            for c in s.channels.values():
                row = rows.setdefault(c.topic, [c.topic, c.type, 0])
                row[2] = None if row[2] is None or c.count is None else row[2] + c.count
        return self.spark.createDataFrame([tuple(rows[k]) for k in sorted(rows)], "topic string, msg_type string, message_count long")

    def __getitem__(self, key: str | tuple[str, Sequence[str]]) -> DataFrame:
        topic, fields = key if isinstance(key, tuple) else (key, None)
        if topic not in self.topics:
            raise KeyError(f"no topic {topic!r}; there are {list(self.topics)}")
        slot = (topic, tuple(fields) if fields else None)
        if slot not in self._frames:
            self._frames[slot] = self._frame(topic, fields)
        return self._frames[slot]

    def _frame(self, topic: str, fields: Sequence[str] | None) -> DataFrame:
        if self.use_cache and self._cached(topic):
            df = self.spark.read.parquet(self._spark_path(self._cache_path(topic)))
            known = leaves(df.drop("recv_time_ns", "publish_time_ns", "seq", "bag", "topic").schema)
            if fields and (missing := [f for f in fields if f not in known]):
                raise KeyError(f"no leaf fields {missing}; there are {known}")
        else:
            r = self.spark.read.format("rosbag").option("topic", topic).option("msg_paths", ",".join(self.msg_paths))
            df = (r.option("fields", ",".join(fields)) if fields else r).load(self.path)
            df = df.withColumns({"bag": F.lit(self.path), "topic": F.lit(topic)})
        if fields:
            df = df.select("recv_time_ns", "publish_time_ns", "seq", "bag", "topic", *[F.col(f).alias(f) for f in fields])
        return df

    def _cache_path(self, topic: str) -> str:
        return f"{_cache_of(self.path)}/{hashlib.sha256(topic.encode()).hexdigest()[:24]}"

    def _fingerprint(self) -> dict:
        return {"version": 2, "files": {os.path.basename(e.path): [e.mtime_ns, e.size] for e in _files(self.path)}}

    def _cached(self, topic: str) -> bool:
        try:
            return json.loads(stores.read_text(f"{self._cache_path(topic)}.json")) == self._fingerprint()
        except (OSError, ValueError):
            return False

    def _spark_path(self, path: str) -> str:
        return path if "://" in path else f"file://{os.path.abspath(path)}"

    def preload(self, topics: Iterable[str]) -> None:
        """Write each known topic as Parquet beside the recording, sorted by receive time; unknown ones are skipped.

        The recording is read once for all of them: one pass deals the raw messages out by topic, and each topic is
        decoded from its own part of these.
        """
        known = self.topics
        missing = [t for t in dict.fromkeys(topics) if t in known and not self._cached(t)]
        if not missing:
            return
        spool = f"{_cache_of(self.path)}/{uuid.uuid4().hex}"
        raw = self.spark.read.format("rosbag_messages").option("topics", json.dumps(missing)).load(self.path)
        place = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(missing) for x in (t, i)]), F.col("topic")).alias("place")
        raw.select(place, *[f.name for f in TIMES], "data").write.partitionBy("place").parquet(self._spark_path(spool))
        columns = T.StructType([*TIMES, T.StructField("data", T.BinaryType())])
        for i, topic in enumerate(missing):
            try:
                mine = self.spark.read.schema(columns).parquet(f"{self._spark_path(spool)}/place={i}")
            except Exception as e:  # no messages, so no folder
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                mine = self.spark.createDataFrame([], columns)
            out = self._decoded(mine, topic).withColumns({"bag": F.lit(self.path), "topic": F.lit(topic)})
            out.sortWithinPartitions("recv_time_ns", "seq").write.mode("overwrite").parquet(self._spark_path(self._cache_path(topic)))
            stores.write_bytes(f"{self._cache_path(topic)}.json", json.dumps(self._fingerprint()).encode())
            self._frames.pop((topic, None), None)
        stores.delete(spool)

    def _decoded(self, raw: DataFrame, topic: str) -> DataFrame:
        """The messages of one topic from their times and payloads."""
        reader = RosbagReader({"path": self.path, "topic": topic, "msg_paths": ",".join(self.msg_paths)})
        layouts, kind = reader.layouts, reader.type

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
            return decoded(rows, Plan(layouts, kind), False)

        return raw.mapInArrow(decode, reader.schema())

    def messages(self, topics: Iterable[str] | None = None) -> DataFrame:
        """``topic, recv_time_ns, publish_time_ns, seq`` of several topics, for rates, gaps and latencies: headers only,
        in one pass over the recording. Messages whose payloads can't be decoded count here."""
        wanted = list(topics) if topics is not None else list(self.topics)
        if missing := [t for t in wanted if t not in self.topics]:
            raise KeyError(f"no topics {missing}; there are {list(self.topics)}")
        return self.spark.read.format("rosbag_messages").option("topics", json.dumps(wanted)).option("payload", "false").load(self.path)

    def close(self) -> None:
        self._frames.clear()

    def __enter__(self) -> Recording:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"Recording({self.path!r}, {len(self.topics)} topics)"

    def _repr_html_(self) -> str:
        rows = "".join(f"<tr><td>{t}</td><td>{k}</td></tr>" for t, k in self.topics.items())
        return f"<table><tr><th>topic</th><th>type</th></tr>{rows}</table>"


def open_recording(spark: SparkSession, path: str, topics: Iterable[str] | dict[str, Sequence[str]] | None = None, msg_paths: Iterable[str] = (), *, use_cache: bool = True, backend: str = "auto") -> Recording:
    """A recording; listed topics are preloaded to the cache, a dict's topics are read with these fields only."""
    rec = Recording(spark, path, msg_paths, use_cache, backend)
    if isinstance(topics, dict):
        for topic, fields in topics.items():
            rec[topic, list(fields)]
    elif topics is not None:
        rec.preload(topics)
    return rec


def _cache_of(path: str) -> str:
    base = path if stores.kind(path) == fs.FileType.Directory else path.rpartition("/")[0] or "."
    return f"{base.rstrip('/')}/.tideline_cache"


def clear_cache(path: str) -> None:
    """Delete the cache beside a recording."""
    stores.delete(_cache_of(stores.plain(path)))
