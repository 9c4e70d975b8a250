"""Registered queries that run streams over the test tables, next to the SQL of their batch twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.text import half_up
from ..operators import learning as L
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import records
from ..streaming import learning_stream as S
from ..streaming import topic_stream
from .queries import EVENT, EXACT, LEXICAL, _exact, _lexical, learning_events
from .registry import query, table
from .study_queries import NUMBERS, ROUNDED, STATES


def _folder(spark) -> str:
    """A new folder where the session keeps its checkpoints, for a stream's output and progress."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/studyloom-stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files: a stream takes one file by a pattern only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    where = _folder(spark)
    S.state_stream(_stream(spark, sf_dir, "events"), f"{where}/out", f"{where}/progress").awaitTermination()
    return S.read_state(spark.read.parquet(f"{where}/out")).withColumn("total", F.round("total", 4))


@query(f"""WITH RECURSIVE {EVENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS k FROM up WHERE topic IS NOT NULL),
s AS (SELECT user_id, topic, k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + delta)) AS mastery FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.topic, n.k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s.mastery + n.delta)) FROM s JOIN n ON n.user_id = s.user_id AND n.topic = s.topic AND n.k = s.k + 1)
SELECT user_id, topic, round(arg_max(mastery, k), 6) AS mastery, max(k) AS events FROM s GROUP BY 1, 2""")
def stream_mastery(spark, sf_dir):
    where = _folder(spark)
    events = _stream(spark, sf_dir, "events")
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("event_id") % n).cast("int"))
    t = F.col("event_type")
    kind = F.when(t == "purchase", "MASTERED").when(t == "error", "CONFUSED").when(t == "signup", "REVIEW").when(t == "click", "ANSWER").otherwise("OTHER")
    rows = L.updates(events.select("event_id", "ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 25).alias("topic"), kind.alias("kind"), (F.col("value") >= 100).alias("correct"), (F.col("event_id") % 5 == 0).alias("hint"), pick(4, "AGAIN", "HARD", "GOOD", "EASY").alias("grade"), pick(3, "EASY", "MEDIUM", "HARD").alias("difficulty")))
    return S.run_to_table(S.mastery_stream(rows.where("topic IS NOT NULL")), ["user_id", "topic"], f"{where}/out", f"{where}/progress")


@query("""WITH m AS (SELECT conv_id, turn, least(900, greatest(1, (length(coalesce(text, '')) + 3) // 4)) AS tokens FROM conversations), w AS (SELECT *, row_number() OVER x AS n, sum(tokens) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m WINDOW x AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, min(turn) AS first, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens FROM w WHERE n <= 12 AND (s <= 300 OR n <= 2) GROUP BY 1""")
def stream_turn_windows(spark, sf_dir):
    where = _folder(spark)
    return S.run_to_table(S.turn_windows(_stream(spark, sf_dir, "conversations"), budget=300), ["conv_id"], f"{where}/out", f"{where}/progress")


@query("""WITH a AS (SELECT user_id AS consumer, ts, event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 3 = 0 UNION ALL SELECT user_id, ts, event_id FROM events WHERE event_id % 7 = 0) SELECT consumer, max((ts, event_id)).ts AS mark, max((ts, event_id)).event_id AS id FROM (SELECT consumer, {'ts': ts, 'event_id': event_id} AS p, ts, event_id FROM a) GROUP BY 1""".replace("max((ts, event_id))", "max(p)"))
def advanced_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("consumer"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    marks = M.advanced_marks(e.where("at < TIMESTAMP '2024-01-20' AND consumer % 3 = 0").limit(0), e.where("at < TIMESTAMP '2024-01-20' AND consumer % 3 = 0"), ["consumer"])
    return M.advanced_marks(marks, e.where("id % 7 = 0"), ["consumer"]).withColumnRenamed("at", "mark")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 600) AS snippet FROM r JOIN documents ON doc_id = id WHERE rank <= 8""")
def semantic_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = R.vector_recall(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), records.clamped(None, 8, 30))
    return hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), R.preview(F.col("text")).alias("snippet")), "id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE query_id % 200 = 0 OR label IN (1, 2)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 32""")
def evidence_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return R.evidence_search(q.where("query_id % 200 = 0"), v, "label", []).unionByName(R.evidence_search(q.where("query_id % 200 <> 0"), v, "label", [1, 2]))


@query(f"""WITH {LEXICAL}, {EXACT}, al AS (SELECT 'lexical' AS channel, query_id, id, rank FROM lex UNION ALL SELECT 'exact', query_id, id, rank FROM ex)
SELECT query_id, count(*) FILTER (channel = 'lexical') AS lexical, count(*) FILTER (channel = 'exact') AS exact, count(DISTINCT id) AS different, count(DISTINCT channel) < 2 AS partial FROM al GROUP BY 1""")
def retrieval_diagnostics(spark, sf_dir):
    return R.diagnostics({"lexical": _lexical(spark, sf_dir), "exact": _exact(spark, sf_dir)})


#: Micro-batches of stream_topic_states.
BATCHES = 10


def arrivals(events, parts: int, hours: int = 6):
    """Events with the number of the batch they come in: late by up to so many hours, and one in seven comes again in the next batch or the one after."""
    late = F.pmod(F.xxhash64("event_id"), F.lit(hours * 3600))
    rows = events.withColumn("__at", F.unix_seconds(F.col("ts").cast("timestamp")) + late)
    first, last = rows.agg(F.min("__at"), F.max("__at")).first()
    batch = F.floor((F.col("__at") - (first or 0)) * parts / ((last or 0) - (first or 0) + 1)).cast("int")
    rows = rows.withColumn("batch", batch)
    again = rows.where(F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(7)) == 0).withColumn("batch", F.least(F.lit(parts - 1), F.col("batch") + 1 + F.pmod(F.xxhash64("event_id", F.lit(2)), F.lit(2)).cast("int")))
    return rows.unionByName(again).drop("__at")


@query(f"WITH RECURSIVE {STATES} SELECT user_id, topic, k AS version, {ROUNDED}, CAST(attempts AS BIGINT) AS attempts, CAST(good AS BIGINT) AS correct_streak, CAST(wrong AS BIGINT) AS wrong_streak, needs_review, review_days, 0::BIGINT AS late FROM (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY k DESC) AS z FROM s) WHERE z = 1")
def stream_topic_states(spark, sf_dir):
    """The events come in ten micro-batches, out of order and partly twice; the last states equal the replay in event time."""
    where = _folder(spark)
    rows = arrivals(learning_events(spark, sf_dir).where("topic IS NOT NULL"), BATCHES)
    rows.write.partitionBy("batch").parquet(f"{where}/all")
    come = spark.read.schema(rows.schema).parquet(f"{where}/all")
    with topic_stream.rocksdb(spark):
        for b in range(BATCHES):  # the stream stops after each and goes on from its checkpoint
            come.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{where}/in")
            source = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{where}/in")
            last = S.run_to_table(topic_stream.topic_states(source, ["user_id", "topic"]), ["user_id", "topic"], f"{where}/out", f"{where}/progress")
    return last.withColumns({c: half_up(F.col(c), 6) for c in NUMBERS})
