"""Every registered query of the library against its SQL in DuckDB, and streaming against its batch form."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import registry
from millrace.streaming import activity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(int(x)) if isinstance(x, int) and not isinstance(x, bool) else str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    as_float = lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    return sorted(tuple(plain(as_float(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, found) == rows(names, want.fetchall())
    else:
        assert found


def test_streamed_windows_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    late = events.limit(1).selectExpr("999999L AS event_id", "ts + INTERVAL 400 DAYS AS ts", "user_id", "event_type", "value", "props")
    stream = activity.windows(activity.read_events(spark, f"{tmp_path}/in", events.schema))
    activity.upsert_sink(stream, f"{tmp_path}/out", f"{tmp_path}/check", ("user_id", "window")).awaitTermination()
    late.write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark past all windows
    again = activity.windows(activity.read_events(spark, f"{tmp_path}/in", events.schema))
    activity.upsert_sink(again, f"{tmp_path}/out", f"{tmp_path}/check", ("user_id", "window")).awaitTermination()
    cols = ("user_id", "window", "n", "n_view", "first", "last")
    got = spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, activity.windows(events).select(*cols).collect()))
