"""Recordings written by our own bytes and read back: schemas, CDR, MCAP, SQLite, catalog, cache."""

import os
import struct
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))
from bagwriter import TWIST, Cdr, metadata, record, twist, write_db3, write_mcap  # noqa: E402

from tideline.sources import containers  # noqa: E402
from tideline.sources import recording as R  # noqa: E402
from tideline.sources.cdr import DecodeError, Plan  # noqa: E402
from tideline.sources.msgdef import common_layouts, parse_schema, register_msg_types, spark_type  # noqa: E402

START = 1_773_585_473_896_158_980
ARRAYS = """float64[] empty
uint8 after
Point[3] fixed
string[2] names
PoseStamped[] poses
uint64 big
byte B=1
int32 k 7
string s "a # b"
================
MSG: geometry_msgs/Point
float64 x
float64 y
float64 z
================
MSG: geometry_msgs/PoseStamped
Point position
string<=8 label
float32[<=4] few
"""


def messages(n=120, topic=1):
    return [(topic, START + i * 10_000_000, START + i * 10_000_000 - 500, twist(START + i * 10_000_000, i * 0.5)) for i in range(n)]


@pytest.fixture(scope="module", params=["", "lz4", "zstd"])
def bag(request, tmp_path_factory):
    d = tmp_path_factory.mktemp("bag")
    both = {1: ("/twist", "geometry_msgs/msg/TwistStamped", TWIST), 2: ("/other", "std_msgs/msg/String", "string data")}
    mixed = sorted(messages() + [(2, START + i, START, Cdr().text(f"m{i}").bytes()) for i in range(30)], key=lambda m: m[1])
    write_mcap(d / "a_0.mcap", both, mixed, request.param)
    write_mcap(d / "a_1.mcap", {5: both[1]}, [(5, START + 10**10, START, twist(START + 10**10, -1.0, ">"))], request.param)
    metadata(str(d), ["a_0.mcap", "a_1.mcap"])
    return str(d)


def test_reads_all_files_in_definition_order(spark, bag):
    with R.open_recording(spark, bag) as rec:
        assert rec.topics == {"/other": "std_msgs/msg/String", "/twist": "geometry_msgs/msg/TwistStamped"}
        df = rec["/twist"]
        assert df.columns == ["recv_time_ns", "publish_time_ns", "seq", "header", "twist", "bag", "topic"]
        rows = df.orderBy("recv_time_ns", "seq").collect()
        assert len(rows) == 121 and [r["twist"]["linear"]["x"] for r in rows] == [i * 0.5 for i in range(120)] + [-1.0]
        assert rows[0]["recv_time_ns"] == START and rows[0]["publish_time_ns"] == START - 500
        assert rows[-1]["header"]["stamp"]["sec"] == (START + 10**10) // 10**9 and rows[0]["header"]["frame_id"] == "base_link"
        assert {r["topic"]: r["message_count"] for r in rec.catalog().collect()} == {"/other": 30, "/twist": 121}
        assert "2 topics" in repr(rec) and "<table>" in rec._repr_html_()
        assert rec.messages().groupBy("topic").count().count() == 2
        with pytest.raises(KeyError, match="no topic"):
            rec["/nope"]


def test_projection_and_time_pruning(spark, bag):
    rec = R.open_recording(spark, bag)
    df = rec["/twist", ["twist.angular.z", "header.frame_id"]]
    assert df.columns[-2:] == ["z", "frame_id"] or df.columns[-2:] == ["twist.angular.z", "header.frame_id"]
    assert df.count() == 121
    with pytest.raises(Exception, match="no leaf fields"):
        rec["/twist", ["twist.angular.q"]].count()
    some = spark.read.format("rosbag").option("topic", "/twist").option("start_ns", START + 10_000_000).option("end_ns", START + 20_000_000).load(bag)
    assert some.count() == 2


def test_filters_reach_the_source(bag):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    reader = R.MessagesReader({"path": bag, "chunks_per_partition": "1"})
    everything = len(reader.partitions())
    left = list(reader.pushFilters([GreaterThan(("recv_time_ns",), START + 10**9), LessThanOrEqual(("recv_time_ns",), START + 10**10), EqualTo(("topic",), "/twist"), IsNotNull(("topic",))]))
    assert left == [IsNotNull(("topic",))] and len(reader.partitions()) < everything
    times = [log for p in reader.partitions() for _, log, *_ in reader.messages(p)]
    assert times and min(times) == START + 10**9 + 10**7 and max(times) == START + 10**10


def test_filters_on_frames(spark, bag):
    df = R.open_recording(spark, bag)["/twist"].where(f"recv_time_ns >= {START + 10**7} and recv_time_ns < {START + 3 * 10**7}")
    assert df.count() == 2
    assert ">=" not in df._jdf.queryExecution().executedPlan().toString()  # the bounds aren't left to Spark


def test_headers_of_all_topics_in_one_pass(spark, bag):
    rec = R.open_recording(spark, bag)
    m = rec.messages()
    assert m.columns == ["topic", "recv_time_ns", "publish_time_ns", "seq"]
    assert m._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert {r["topic"]: r["count"] for r in m.groupBy("topic").count().collect()} == {"/other": 30, "/twist": 121}
    assert m.distinct().count() == 151
    with pytest.raises(KeyError, match="no topics"):
        rec.messages(["/nope"])


def test_preload_reads_the_recording_once(spark, bag, monkeypatch):
    rec = R.open_recording(spark, bag)
    plain = {t: sorted(map(str, rec[t].collect())) for t in rec.topics}
    asked = []
    frame = R.Recording._frame
    monkeypatch.setattr(R.Recording, "_frame", lambda self, topic, fields: asked.append(topic) or frame(self, topic, fields))
    try:
        rec.preload([*rec.topics, "/nope"])
        assert not asked  # no topic was scanned on its own
        assert {t: sorted(map(str, rec[t].collect())) for t in rec.topics} == plain
        assert sorted(f.rpartition(".")[2] for f in os.listdir(os.path.join(bag, ".tideline_cache")) if "." in f) == ["json", "json"]
    finally:
        R.clear_cache(bag)


def test_written_messages_come_back(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from tideline.sources.writer import payload

    R.register(spark)
    df = spark.range(1000, numPartitions=3).select(
        F.when(F.col("id") % 3 == 0, "/a").otherwise("/b").alias("topic"), (F.col("id") + START).alias("recv_time_ns"), F.col("id").alias("publish_time_ns"),
        payload(n=("uint8", F.col("id") % 200), x=("float64", F.col("id") / 4), k=("int64", F.when(F.col("id") != 7, -F.col("id")))).alias("data"),
    )
    types = json.dumps(dict.fromkeys(["/a", "/b", "/none"], ["t/msg/N", "uint8 n\nfloat64 x\nint64 k"]))
    for how in ("", "zstd"):
        folder = str(tmp_path / f"rec{how}")
        df.write.format("rosbag_messages").mode("append").option("types", types).option("compression", how).save(folder)
        rec = R.open_recording(spark, folder, ["/a", "/none"])
        assert rec["/a"].count() == 334 and rec["/none"].count() == 0 and rec["/none"].columns == rec["/a"].columns
        rows = {r["publish_time_ns"]: r for r in rec["/b"].unionByName(rec["/a"]).collect()}
        assert len(rows) == 1000 and all((r["n"], r["x"], r["k"]) == (i % 200, i / 4, -i if i != 7 else 0) for i, r in rows.items())
        assert {r["topic"]: r["message_count"] for r in rec.catalog().collect()} == {"/a": 334, "/b": 666, "/none": 0}


def test_cache_round_trip(spark, bag):
    rec = R.open_recording(spark, bag, ["/twist", "/nope"])
    try:
        assert rec._cached("/twist")
        assert "rosbag" not in rec["/twist"]._jdf.queryExecution().toString().lower().split("parquet")[0]
        assert rec["/twist"].count() == 121
        os.utime(os.path.join(bag, "a_0.mcap"))
        assert not rec._cached("/twist")
    finally:
        R.clear_cache(bag)
    assert not os.path.exists(os.path.join(bag, ".tideline_cache"))


def test_no_summary_and_uncompressed_messages(spark, tmp_path):
    write_mcap(tmp_path / "x.mcap", {1: ("/t", "geometry_msgs/msg/TwistStamped", TWIST)}, messages(70), summary=False)
    assert R.open_recording(spark, str(tmp_path))["/t"].count() == 70


def test_summary_without_chunks(spark, tmp_path):
    topic = {1: ("/t", "geometry_msgs/msg/TwistStamped", TWIST)}
    write_mcap(tmp_path / "x.mcap", topic, [])
    data = (tmp_path / "x.mcap").read_bytes()
    end = data.index(struct.pack("<BQI", containers.DATA_END, 4, 0))
    loose = b"".join(record(containers.MESSAGE, struct.pack("<HIQQ", c, k, log, pub) + x) for k, (c, log, pub, x) in enumerate(messages(70)))
    stats = data.index(struct.pack("<BQ", containers.STATISTICS, 46), end)
    tail = data[end:stats] + record(containers.STATISTICS, struct.pack("<QHIIIIQQI", 70, 1, 1, 0, 0, 0, 0, 0, 10) + struct.pack("<HQ", 1, 70))
    where = end + len(loose) + 13
    (tmp_path / "x.mcap").write_bytes(data[:end] + loose + tail + record(containers.FOOTER, struct.pack("<QQI", where, 0, 0)) + containers.MAGIC)
    assert R.open_recording(spark, str(tmp_path))["/t"].count() == 70


def test_empty_topic_has_its_columns(spark, tmp_path):
    write_mcap(tmp_path / "x.mcap", {1: ("/t", "geometry_msgs/msg/TwistStamped", TWIST)}, [])
    df = R.open_recording(spark, str(tmp_path))["/t"]
    assert df.count() == 0 and "twist" in df.columns


def test_bad_payloads(spark, tmp_path):
    good = messages(3)
    bad = [(1, START + 1, START, twist(START, 1.0)[:-9]), (1, START + 2, START, b"\x00\x07\x00\x00" + b"\0" * 80)]
    write_mcap(tmp_path / "x.mcap", {1: ("/t", "geometry_msgs/msg/TwistStamped", TWIST)}, [good[0], *bad, *good[1:]])
    assert R.open_recording(spark, str(tmp_path))["/t"].count() == 3
    with pytest.raises(Exception, match="payload ends early|encapsulation"):
        spark.read.format("rosbag").option("topic", "/t").option("mode", "failfast").load(str(tmp_path)).count()


def test_idl_definitions_are_refused(spark, tmp_path):
    write_mcap(tmp_path / "x.mcap", {1: ("/t", "a/msg/B", "module a {}", "ros2idl")}, messages(1))
    with pytest.raises(Exception, match="ros2msg"):
        R.open_recording(spark, str(tmp_path))["/t"].count()


@pytest.mark.parametrize("order", ["<", ">"])
def test_arrays_strings_and_skips(order):
    layouts = parse_schema(ARRAYS, "geometry_msgs/msg/Thing")
    c = Cdr(order).array("d", []).put("B", 7)
    c.put("d", *range(9)).text("one").text("two").put("I", 2)
    for i in range(2):
        c.put("d", i, i, i).text(f"p{i}").array("f", [0.5] * i)
    c.put("Q", 2**64 - 1).put("i", 4).text("s")
    plan = Plan(layouts, "geometry_msgs/Thing")
    row = plan.nested(plan.decode(c.bytes()))
    assert row["empty"] == [] and row["after"] == 7 and row["big"] == 2**64 - 1 and row["names"] == ["one", "two"]
    assert row["fixed"][2] == {"x": 6.0, "y": 7.0, "z": 8.0}
    assert row["poses"][1] == {"position": {"x": 1.0, "y": 1.0, "z": 1.0}, "label": "p1", "few": [0.5]}
    assert Plan(layouts, "geometry_msgs/Thing", ["after", "k"]).decode(c.bytes()) == [7, 4]
    assert plan.columns([plan.decode(c.bytes())])["big"].to_pylist()[0] == 2**64 - 1
    with pytest.raises(DecodeError):
        plan.decode(c.bytes()[:-3])
    with pytest.raises(DecodeError):
        plan.decode(b"\0")


FLAT = "bool ok\nuint8 a\nstring name\nfloat64 x\nint16[3] three\nuint64 big\nstring label\nfloat32 y\nfloat64[0] none\nint32 k"


def test_payloads_of_a_batch_decode_as_one_by_one():
    import random

    layouts = parse_schema(FLAT, "t/Flat")
    rng = random.Random(3)
    good = []
    for i in range(300):
        c = Cdr("<>"[i % 5 == 0]).put("?", i % 2).put("B", i % 250).text(["a", "bb", "", "ünï", "n" * (i % 90)][i % 5])
        good.append(c.put("d", i / 7).put("h", i, -i, 3).put("Q", 2**63 + i).text("l" * (i % 3)).put("f", 0.5 * i).put("i", -i).bytes() + b"\0" * (i % 2))
    bad = [b"", b"\0", b"\0\7\0\0" + b"\0" * 60, good[0][:-9], good[3][:7], b"\0\1\0\0\1\2\0\0\xff\xff\xff\xff" + b"\0" * 50]
    mixed = good + bad
    rng.shuffle(mixed)
    for fields in (None, ["x", "label"], ["three", "ok", "big"], ["none", "k"]):
        plan = Plan(layouts, "t/Flat", fields)
        want, rows = [], []
        for k, data in enumerate(mixed):
            try:
                rows.append(plan.decode(data))
                want.append(k)
            except DecodeError:
                pass
        kept, columns = plan.decode_all(mixed)
        assert plan.flat and kept == want and len(want) == 300
        assert {n: a.to_pylist() for n, a in columns.items()} == {n: a.to_pylist() for n, a in plan.columns(rows).items()}
        assert {n: a.type for n, a in columns.items()} == {n: a.type for n, a in plan.columns(rows).items()}
        with pytest.raises(DecodeError):
            plan.decode_all(mixed, strict=True)
        assert plan.decode_all([])[0] == [] and plan.decode_all(bad)[0] == []
    few = Plan(parse_schema(ARRAYS, "geometry_msgs/msg/Thing"), "geometry_msgs/Thing", ["after"])
    assert few.flat is None


def test_spark_types_widen_unsigned():
    s = spark_type(parse_schema(ARRAYS, "geometry_msgs/Thing"), "geometry_msgs/Thing")
    assert s["after"].dataType == T.ShortType() and s["big"].dataType == T.DecimalType(20, 0)
    assert isinstance(s["poses"].dataType.elementType, T.StructType) and s.names == ["empty", "after", "fixed", "names", "poses", "big", "k", "s"]
    with pytest.raises(ValueError, match="wstring"):
        parse_schema("wstring w", "a/B")
    with pytest.raises(ValueError, match="unknown message type"):
        parse_schema("Nope n", "a/B")


def test_sqlite_with_custom_definitions(spark, tmp_path):
    msgs = tmp_path / "defs" / "my_pkg" / "msg"
    msgs.mkdir(parents=True)
    (msgs / "Pair.msg").write_text("# two\nint32 a\nfloat64 b\nOther o\n")
    (msgs / "Other.msg").write_text("string name\n")
    (msgs / "Broken.msg").write_text("Missing m\n")
    bag = tmp_path / "bag"
    bag.mkdir()
    rows = [(1, START + i, Cdr().put("i", i).put("d", i / 2).text("n").bytes()) for i in range(10)]
    write_db3(str(bag / "b.db3"), {1: ("/pair", "my_pkg/msg/Pair"), 2: ("/twist", "geometry_msgs/msg/TwistStamped")}, rows + [(2, START, twist(START, 3.0))])
    rec = R.open_recording(spark, str(bag), msg_paths=[str(tmp_path / "defs")])
    got = rec["/pair"].orderBy("recv_time_ns").collect()
    assert [(r["a"], r["b"], r["o"]["name"]) for r in got] == [(i, i / 2, "n") for i in range(10)]
    assert rec["/twist"].first()["twist"]["linear"]["x"] == 3.0
    assert register_msg_types([str(tmp_path / "defs")], common_layouts()) == 2
    assert R.storage_of(str(bag)) == "sqlite3"


def test_catalog_helpers(spark, tmp_path):
    for k, name in enumerate(["b", "a", "c"]):
        (tmp_path / name).mkdir()
        if name != "c":
            p = tmp_path / name / "x.mcap"
            write_mcap(p, {}, [])
            os.utime(p, (k + 1, k + 1))
    assert [os.path.basename(d) for d in R.find_bags(f"{tmp_path}/*")] == ["b", "a"]
    assert os.path.basename(R.latest_bag(f"{tmp_path}/*")) == "a"
    with pytest.raises(FileNotFoundError):
        R.latest_bag(f"{tmp_path}/zzz*")
    with pytest.raises(FileNotFoundError):
        R.open_recording(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError, match="Unknown backend"):
        R.open_recording(spark, str(tmp_path / "a"), backend="x")
    assert R.available_readers() == ("mcap", "sqlite3")
