"""The stream of topic states: how many stores it opens, many keys in a bucket, ids that doubles can't tell apart."""

import random
from collections import Counter

from pyspark.sql import functions as F

from studyloom.operators.folds import topic_history
from studyloom.streaming import topic_stream as T

from test_topic_stream import last, made, rounded, run


def test_a_batch_opens_a_store_a_core_and_keys_share_buckets(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(T.topic_states, "__defaults__", ("3 hours", 3))  # six keys in three buckets
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        _, events = made(spark, random.Random(5), 150)
        half = F.unix_seconds("ts") < 1_700_045_000
        got = run(spark, [events.where(half), events.where(~half).unionByName(events.where(half & F.col("event_id").isNotNull()))], tmp_path, "3 hours")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        stores = [p for p in (tmp_path / "progress" / "state" / "0").iterdir() if p.name.isdigit()]
        assert len(stores) == spark.sparkContext.defaultParallelism
        assert rounded(got) == rounded(last(topic_history(events, ["user_id", "topic"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_ids_count_apart_next_to_rows_without_id(spark, tmp_path):
    _, events = made(spark, random.Random(6), 40)
    events = events.withColumn("event_id", F.col("event_id") + F.lit(2**53))
    got = run(spark, [events], tmp_path, "3 hours")
    assert Counter(r.version for r in got.collect()) == Counter(r["count"] for r in events.groupBy("user_id", "topic").count().collect())
    assert rounded(got) == rounded(last(topic_history(events, ["user_id", "topic"])))
