"""Rows without a key to look up stay where they are."""

from pyspark.sql import functions as F

from studyloom.operators import workflow as W


def test_memories_without_a_message_stay_spread(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        i = F.col("id")
        c = spark.range(0, 8000, 1, 8).select("id", F.lit("FACT").alias("type"), F.lit("x").alias("content"), F.lit(0.7).alias("confidence"), F.when(i % 10 == 0, i).alias("message"), F.lit(1).cast("long").alias("days"))
        got = W.memory_errors(c, spark.range(0, 8000, 20).select(i.alias("message"))).withColumn("part", F.spark_partition_id())
        assert max(r["count"] for r in got.groupBy("part").count().collect()) <= 1000
        assert {r.error: r["count"] for r in got.groupBy("error").count().collect()} == {None: 7600, "message": 400}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
