"""The driver's contract, and each telemetry query against its SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import recordings, telemetry

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(telemetry.QUERIES | recordings.QUERIES) <= set(q)
    df = entry.entry(spark)
    assert df.columns[0] == "event_type" and df.count() > 0


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_rest_works_without_the_training_data_operators(tmp_path):
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tideline.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
assert "topic_rate" in e.queries() and not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries()
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


@pytest.mark.parametrize("name", sorted(telemetry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, telemetry.QUERIES[name], telemetry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(recordings.ORACLES))
def test_recording_query_equals_its_sql(spark, name):
    assert_same(spark, recordings.QUERIES[name], recordings.ORACLES[name], SF)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """A folder with each event three times: a second row at its time, a third a microsecond later, by other users."""
    folder = tmp_path_factory.mktemp("repeated")
    copies = f"SELECT event_id + k * 1000000 AS event_id, ts + to_microseconds(k // 2) AS ts, user_id + k * 1500 AS user_id, event_type, value + k // 2 AS value, props FROM '{SF}/events.parquet', range(3) r(k)"
    duckdb.connect().execute(f"COPY ({copies}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def rows_of_both(spark, name, folder):
    """A query's rows and its SQL's, exactly: nulls, NaN and infinities apart."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    theirs = con.execute(telemetry.ORACLES[name])
    names = [d[0] for d in theirs.description]
    mine = telemetry.QUERIES[name](spark, folder).select(*names).collect()
    return sorted(repr(tuple(r)) for r in mine), sorted(map(repr, theirs.fetchall()))


@pytest.mark.parametrize("name", ["align_time", "velocity_from_pose", "yaw_rate_from_pose"])
def test_query_equals_its_sql_where_times_repeat(spark, repeated, name):
    mine, theirs = rows_of_both(spark, name, repeated)
    assert len(mine) > 1000 and mine == theirs


def test_diff_is_rounded_as_its_sql_rounds(spark, tmp_path):
    """Quotients of over a million, whose sixth digit depends on how they are rounded, and rows of one time."""
    rows = "SELECT i AS event_id, make_timestamp(1704067200000000 + i // 50 * 501 + least(i % 50, 48) * 10) AS ts, 1 AS user_id, 'view' AS event_type, (hash(i) % 1000000007) / 1000003 AS value, '{}' AS props FROM range(20000) r(i)"
    duckdb.connect().execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    mine, theirs = rows_of_both(spark, "diff", str(tmp_path))
    assert any("inf" in r for r in mine) and mine == theirs


@pytest.mark.parametrize("name", ["match_by_time", "align_time", "interp_pose", "integrate", "unwrap", "cumulative_distance", "diff", "moving_average", "velocity_from_pose", "topic_rate", "message_gaps", "pose_error_path", "lowpass"])
def test_no_table_is_one_task(spark, name):
    plan = telemetry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_seg" in plan


def test_plans_push_down_and_prune(spark):
    """Only the columns that a query needs are read, and alignment needs no nested loop."""
    plan = telemetry.QUERIES["topic_rate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan
    plan = telemetry.QUERIES["resample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
