"""Queries over a recording: ``events`` written as MCAP files to the shared folder (a topic an event type) and read back.

The same rows in DuckDB's SQL come from ``events`` itself.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import summary
from tideline.plans.telemetry import EV, MICROS, r6
from tideline.shared import delete_on_exit, shared_dir
from tideline.sources.recording import Recording, open_recording, register
from tideline.sources.writer import payload

TYPE, DEFINITION = "tideline_msgs/msg/Event", "int64 event_id\nint64 user_id\nfloat64 value\n"
#: (application, tables) -> the folder of their recording, written once.
_WRITTEN: dict[tuple[str, str], str] = {}


def recording(spark: SparkSession, sf_dir: str) -> Recording:
    """The recording of a folder's events, in files by ranges of time."""
    slot = spark.sparkContext.applicationId, sf_dir
    register(spark)
    if slot not in _WRITTEN:
        e = spark.read.parquet(f"{sf_dir}/events.parquet")
        topics = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # one row a topic
        ns = (F.expr(MICROS) * 1000).alias("recv_time_ns")
        data = payload(event_id=("int64", F.col("event_id")), user_id=("int64", F.col("user_id")), value=("float64", F.col("value")))
        rows = e.select(F.concat(F.lit("/"), "event_type").alias("topic"), ns, ns.alias("publish_time_ns"), data.alias("data"))
        folder = f"{shared_dir(spark)}/recording-{uuid.uuid4().hex}"
        rows = rows.repartitionByRange("recv_time_ns").sortWithinPartitions("recv_time_ns")
        rows.write.format("rosbag_messages").mode("append").option("types", json.dumps({f"/{t}": [TYPE, DEFINITION] for t in topics})).save(folder)
        delete_on_exit(spark, folder)
        _WRITTEN[slot] = folder
    return open_recording(spark, _WRITTEN[slot])


def rosbag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic, two of its fields, and a span of time that reaches the source as a filter."""
    rec = recording(spark, sf_dir)
    topic = min(rec.topics)
    lo = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(F.expr(MICROS))).first()[0] or 0
    df = rec[topic, ["event_id", "value"]]
    span = (F.col("recv_time_ns") >= F.lit((lo + 86_400_000_000) * 1000)) & (F.col("recv_time_ns") <= F.lit((lo + 864_000_000_000) * 1000))
    return df.where(span).select("topic", "recv_time_ns", "event_id", r6("value").alias("value"))


def rosbag_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All topics, decoded in one pass over the files and read from the cache."""
    rec = recording(spark, sf_dir)
    rec.preload(rec.topics)
    out = None
    for topic in rec.topics:
        df = rec[topic].select("topic", "recv_time_ns", "event_id", "user_id", r6("value").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


def rosbag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every topic from message headers alone."""
    rec = recording(spark, sf_dir)
    m = rec.messages().withColumn("t", F.col("recv_time_ns") / F.lit(1e9))
    rates = summary.topic_rate(m, "t", ["topic"], ["recv_time_ns", "seq"])
    return rates.select("topic", "count", r6("mean_hz").alias("mean_hz"), F.round("duration", 3).alias("duration"))


QUERIES = {"rosbag_scan": rosbag_scan, "rosbag_preload": rosbag_preload, "rosbag_rates": rosbag_rates}
ORACLES = {
    "rosbag_scan": f"""WITH {EV} SELECT '/' || event_type AS topic, us * 1000 AS recv_time_ns, event_id, round(value, 6) + 0.0 AS value FROM ev
 WHERE event_type = (SELECT min(event_type) FROM ev) AND us - (SELECT min(us) FROM ev) BETWEEN 86400000000 AND 864000000000""",
    "rosbag_preload": f"WITH {EV} SELECT '/' || event_type AS topic, us * 1000 AS recv_time_ns, event_id, user_id, round(value, 6) + 0.0 AS value FROM ev",
    "rosbag_rates": f"""WITH {EV} SELECT '/' || event_type AS topic, count(*) AS count, CASE WHEN count(*) < 2 THEN 0 ELSE round((count(*) - 1) / (max(t) - min(t)), 6) END AS mean_hz,
 round(max(t) - min(t), 3) AS duration FROM ev GROUP BY event_type""",
}
