"""The event-time stream of topic states against a replay."""

import random

from pyspark.sql import functions as F

from studyloom.operators.folds import topic_history
from studyloom.operators.learning import updates
from studyloom.streaming import learning_stream as S
from studyloom.streaming import topic_stream as T

RAW = "event_id long, ts timestamp, user_id long, topic long, kind string, correct boolean, hint boolean, grade string, difficulty string"


def made(spark, rnd, n):
    rows = [(k if k % 37 else None, 1_700_000_000 + k * 600, rnd.randrange(3), rnd.randrange(2), rnd.choice(["MASTERED", "CONFUSED", "REVIEW", "ANSWER", "OTHER"]), rnd.random() < 0.5, rnd.random() < 0.3, rnd.choice(["AGAIN", "HARD", "GOOD", "EASY"]), rnd.choice(["EASY", "MEDIUM", "HARD"])) for k in range(n)]
    return rows, updates(spark.createDataFrame(rows, RAW.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s"))


def last(history):
    return history.groupBy("user_id", "topic").agg(F.max_by(F.struct(*T.NAMES), "version").alias("s")).select("user_id", "topic", "s.*")


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("user_id", "topic", *T.NAMES).collect())


def run(spark, batches, tmp_path, delay):
    with T.rocksdb(spark):
        for b in batches:
            b.write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(b.schema).parquet(str(tmp_path / "in"))
            out = S.run_to_table(T.topic_states(source, ["user_id", "topic"], delay), ["user_id", "topic"], str(tmp_path / "out"), str(tmp_path / "progress"))
    return out


def test_late_and_repeated_rows_give_the_replay(spark, tmp_path):
    rnd = random.Random(3)
    rows, events = made(spark, rnd, 400)
    events = events.withColumn("k", F.unix_seconds("ts") - 1_700_000_000)
    batches = []
    for b in range(4):
        # up to two hours late; every row with an id comes once more in the next batch
        shift = F.pmod(F.xxhash64("k"), F.lit(7200))
        at = F.least(F.lit(3), F.floor((F.col("k") + shift) / 60_000))
        again = events.where((F.col("event_id") % 3 == 0) & (F.least(F.lit(3), at + 1) == b))
        batches.append(events.where(at == b).unionByName(again).drop("k"))
    got = run(spark, batches, tmp_path, "3 hours")
    assert got.agg(F.sum("late")).first()[0] == 0
    assert rounded(got) == rounded(last(topic_history(events, ["user_id", "topic"])))


def test_rows_later_than_the_delay_count_and_are_repaired(spark, tmp_path):
    rnd = random.Random(4)
    rows, events = made(spark, rnd, 120)
    old = F.coalesce(F.col("event_id") % 5 == 0, F.lit(False))
    batches = [events.where(~old & (F.unix_seconds("ts") < 1_700_050_000)), events.where(~old & (F.unix_seconds("ts") >= 1_700_050_000)), events.where(old)]
    got = run(spark, batches, tmp_path, "1 hour")
    want = last(topic_history(events, ["user_id", "topic"]))
    assert got.agg(F.sum("late")).first()[0] > 0
    assert rounded(got.withColumn("mastery", F.lit(0.0)).select("user_id", "topic", "version", "attempts")
                   .join(want.drop("version", "attempts"), ["user_id", "topic"])) == rounded(want)  # every row counts
    assert rounded(T.repaired(got, events.unionByName(events.where("event_id IS NOT NULL")), ["user_id", "topic"])) == rounded(want)
