"""The keyset source over a database file, as a table and as a stream, and streams into a table."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.operators import sync
from millrace.sources import keyset

COLUMNS = "id bigint, title string, views bigint, score double"


@pytest.fixture
def base(spark, tmp_path):
    keyset.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    at = f"{tmp_path}/posts.db"
    db = sqlite3.connect(at)
    db.execute("CREATE TABLE posts (id INTEGER PRIMARY KEY, title TEXT, views INTEGER, score REAL)")
    put(at, range(1, 101))
    yield at
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def put(at, ids, title="t"):
    with sqlite3.connect(at) as db:
        db.executemany("INSERT OR REPLACE INTO posts VALUES (?, ?, ?, ?)", [(i, f"{title}{i}" if i % 7 else None, i % 10, i / 4) for i in ids])


def options(at, **more):
    return {"database": at, "table": "posts", "key": "id", "columns": COLUMNS, **{k: str(v) for k, v in more.items()}}


def test_every_range_is_read_once(spark, base, monkeypatch):
    put(base, [-5, 10_000, 10_001])
    rows = spark.read.format("keyset").options(**options(base, ranges=6, fetch=7)).load()
    found = rows.withColumn("part", F.spark_partition_id())
    assert rows.count() == 103 and rows.select("id").distinct().count() == 103 and rows.where("title IS NULL").count() == 14
    # A task reads keys between those of the tasks before and behind it.
    ends = found.groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("part").collect()
    assert len(ends) >= 2 and all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))
    assert rows.rdd.getNumPartitions() <= 6
    asked = []
    monkeypatch.setattr(keyset.Table, "_ask", lambda self, sql, values: iter(asked.append((sql, values)) or ()))
    table = keyset.Table("sqlite3", {}, "posts", "id", rows.schema, ranges=4)
    parts = table.split(1, 10)
    for part in parts:
        list(table.rows(part))
    assert [v for _, v in asked] == [(0, 3), (3, 6), (6, 9), (9, 10)] and all("id > ? AND id <= ?" in sql and "ORDER BY id" in sql for sql, _ in asked)


def test_comparisons_reach_the_database(spark, base):
    load = lambda: spark.read.format("keyset").options(**options(base, ranges=4)).load()
    rows = load()
    some = load().where("id > 40 AND id <= 60 AND views >= 5 AND title = 't44'")
    assert [r.id for r in some.collect()] == [] and [r.id for r in load().where("id > 40 AND id <= 60 AND views = 4").collect()] == [44, 54]
    assert sorted(r.id for r in load().where("score < 1.0 OR id = 100").collect()) == [1, 2, 3, 100]
    reader = keyset._Reader(keyset.Table("sqlite3", {"database": base}, "posts", "id", rows.schema, 4))
    left = list(reader.pushFilters([keyset.GreaterThan(("id",), 40), keyset.LessThanOrEqual(("id",), 60), keyset.EqualTo(("title",), "t44"), keyset.EqualTo(("views",), True)]))
    assert len(left) == 2 and {(p.after, p.upto) for p in reader.partitions()} == {(40, 45), (45, 50), (50, 55), (55, 60)}
    assert [b.column("id").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[44]]


def test_odd_tables(spark, tmp_path, base):
    with sqlite3.connect(base) as db:
        db.execute("DELETE FROM posts")
    assert spark.read.format("keyset").options(**options(base)).load().collect() == []
    for wrong in ({"table": "posts; DROP TABLE posts"}, {"key": "id --"}, {"ranges": 0}):
        with pytest.raises(Exception, match="is no name|at least one range"):
            spark.read.format("keyset").options(**(options(base) | {k: str(v) for k, v in wrong.items()})).load().collect()


def stream(spark, at, **more):
    return spark.readStream.format("keyset").options(**options(at, ranges=4, **more)).load()


def test_stop_resume_append_and_full_give_one_table(spark, base, tmp_path):
    target, at = sync.DeltaTable(spark, f"file://{tmp_path}/table", "id"), f"file://{tmp_path}/checkpoint"
    assert sync.stream_into(stream(spark, base), target, at) == 1 and target.read().count() == 100
    # Nothing new, then new rows: the checkpoint's offset is the last key.
    assert sync.stream_into(stream(spark, base), target, at) == 0
    put(base, range(101, 131))
    assert sync.stream_into(stream(spark, base), target, at) == 1 and target.read().count() == 130
    # A run that breaks in its batch leaves no rows, and the next run plays the batch again.
    put(base, range(131, 141))
    broken = lambda df: df.withColumn("title", F.when(F.col("id") < 140, F.col("title")).otherwise(F.raise_error(F.lit("gone")).cast("string")))
    with pytest.raises(Exception, match="gone"):
        sync.stream_into(stream(spark, base), target, at, broken)
    assert target.read().count() == 130
    assert sync.stream_into(stream(spark, base), target, at) == 1
    # Changed rows come in by a full run; the same batch twice changes nothing.
    put(base, range(1, 51), "new")
    for _ in range(2):
        sync.stream_into(stream(spark, base, after=0), target, f"file://{tmp_path}/full{_}")
    target.compact()
    rows = {r.id: r.title for r in target.read().collect()}
    assert len(rows) == 140 and rows[1] == "new1" and rows[60] == "t60" and rows[7] is None


def test_rows_that_repeat_a_key_in_a_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, "d", 1)], "id long, title string, at long").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long, title string, at long").parquet(f"{tmp_path}/in")
    target = sync.DeltaTable(spark, f"file://{tmp_path}/table", "id")
    sync.stream_into(rows, target, f"file://{tmp_path}/c", lambda df: df.withColumnRenamed("at", "_at"))
    assert sorted(map(tuple, target.read().collect())) == [(1, "b"), (2, "d")]


def test_a_delta_that_breaks_half_way_is_not_read(spark, tmp_path):
    target = sync.DeltaTable(spark, f"file://{tmp_path}/table", "id")
    target.upsert(spark.range(1, 4))
    bad = spark.range(4, 9).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("gone")).cast("long")))
    with pytest.raises(Exception, match="gone"):
        target.upsert(bad)
    assert target.read().count() == 3
    target.upsert(spark.range(4, 6))
    assert sorted(r.id for r in target.read().collect()) == [1, 2, 3, 4, 5]
