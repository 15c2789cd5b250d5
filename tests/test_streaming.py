"""Rates over a stream of files equal rates over the table."""

import os

import pytest
from pyspark.sql import functions as F

from tideline.operators import summary
from tideline.streaming import rates

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for k, f in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(f, (1_000_000 + k, 1_000_000 + k))  # files arrive in order of time: later rows of older times would be dropped
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_running_rate(spark, stream, tmp_path):
    e, s = stream
    got = run(rates.running_rate(s, "event_type", "t"), "update", "running", tmp_path)
    last = got.groupBy("event_type").agg(F.max_by(F.struct("count", "mean_hz", "std_hz", "duration"), "count").alias("r")).select("event_type", "r.*").collect()
    want = {r["event_type"]: r for r in summary.topic_rate(e, "t", ["event_type"], ["t", "event_id"]).collect()}
    for r in last:
        w = want[r["event_type"]]
        assert r["count"] == w["count"] and r["mean_hz"] == pytest.approx(w["mean_hz"]) and r["std_hz"] == pytest.approx(w["std_hz"], rel=1e-4)


def test_windowed_rate(spark, stream, tmp_path):
    e, s = stream
    got = run(rates.windowed_rate(s, "ts", ["event_type"], "1 day", "1 hour"), "append", "windowed", tmp_path)
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()}
    rows = got.collect()
    assert rows and all(want[r["window"]["start"], r["event_type"]] == r["count"] for r in rows)
