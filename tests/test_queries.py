"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_stream_counts_an_event_once(spark, sf, tmp_path):
    from studyloom.streaming.learning_stream import read_state, state_stream

    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    state_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.user_id: r.events for r in read_state(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_stream_drops_repeated_ids_of_any_age(spark, tmp_path):
    from studyloom.streaming.learning_stream import read_state, state_stream

    schema = "event_id long, user_id long, ts timestamp, value double"
    for rows in ([(1, 7, "2026-01-01", 1.0), (1, 7, "2026-01-01", 1.0), (2, 7, "2026-01-02", 1.0)], [(1, 7, "2026-01-01", 1.0), (3, 7, "2025-01-01", 1.0), (None, 7, "2026-03-01", 1.0), (None, 7, "2026-03-01", 1.0)]):
        df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.user_id, r.events, r.total) for r in read_state(spark.read.parquet(str(tmp_path / "out"))).collect()] == [(7, 5, 5.0)]


def test_stream_state_equals_replay(spark, sf, tmp_path):
    from studyloom.operators.learning import fold_mastery
    from studyloom.plans.queries import learning_events
    from studyloom.streaming.learning_stream import mastery_stream

    events = learning_events(spark, sf).where("topic < 3")
    middle = events.selectExpr("percentile_approx(event_id, 0.5) AS m").first().m
    for k, part in enumerate((events.where(f"event_id <= {middle}"), events.where(f"event_id > {middle}"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        keep = lambda batch, _: got.extend(batch.collect())
        stream = mastery_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        state = {(r.user_id, r.topic): (r.mastery, r.events) for r in got}
        last = state if k == 0 else last | state
    assert last == {(r.user_id, r.topic): (r.mastery, r.events) for r in fold_mastery(events, ["user_id", "topic"]).collect()}
