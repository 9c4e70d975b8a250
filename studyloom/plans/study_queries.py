"""Registered queries of learning memory and study analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import half_up
from ..operators import folds, study
from .queries import EVENT, FUSED, TOK, _fused, learning_events
from .registry import CHUNKS, chunks, query, table

UPDATE = f"""{EVENT}, u2 AS (SELECT *, kind IN ('REVIEW', 'ANSWER') AS attempt, CASE WHEN kind = 'REVIEW' THEN grade <> 'AGAIN' ELSE correct END AS hit,
 CASE kind WHEN 'MASTERED' THEN 1.0::DOUBLE WHEN 'CONFUSED' THEN -1.0::DOUBLE WHEN 'REVIEW' THEN CASE grade WHEN 'AGAIN' THEN -1.0::DOUBLE WHEN 'HARD' THEN 0.2 WHEN 'GOOD' THEN 0.7 ELSE 1.0 END WHEN 'ANSWER' THEN CASE WHEN correct THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.05::DOUBLE END AS signal,
 CASE kind WHEN 'MASTERED' THEN 14 WHEN 'CONFUSED' THEN 1 WHEN 'REVIEW' THEN CASE grade WHEN 'AGAIN' THEN 1 WHEN 'HARD' THEN 2 WHEN 'GOOD' THEN 5 ELSE 10 END WHEN 'ANSWER' THEN CASE WHEN correct THEN 5 ELSE 1 END ELSE 3 END AS days FROM up),
n AS (SELECT *, attempt AND hit AS ok, attempt AND NOT hit AS bad, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS k FROM u2)"""
STATES = f"""{UPDATE}, s AS (SELECT user_id, topic, k, event_id, greatest(0::DOUBLE, least(1::DOUBLE, 0.5 + delta)) AS mastery, greatest(0::DOUBLE, least(1::DOUBLE, weight * 0.08) - CASE WHEN attempt THEN 0.02 ELSE 0 END) AS confidence, weight::DOUBLE AS evidence, CASE WHEN attempt THEN 1 ELSE 0 END AS attempts,
  CASE WHEN ok THEN 1 ELSE 0 END AS good, CASE WHEN bad THEN 1 ELSE 0 END AS wrong, signal::DOUBLE AS trend, (CASE WHEN ok THEN least(365::DOUBLE, 1 + greatest(1::DOUBLE, weight * 2)) ELSE 1 END)::DOUBLE AS stability, (CASE WHEN attempt THEN 0.1 ELSE 0 END)::DOUBLE AS calibration,
  (kind = 'CONFUSED' OR bad OR greatest(0::DOUBLE, least(1::DOUBLE, 0.5 + delta)) < 0.7) AS needs_review, days::BIGINT AS review_days FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.topic, n.k, n.event_id, greatest(0::DOUBLE, least(1::DOUBLE, s.mastery + delta)), greatest(0::DOUBLE, least(1::DOUBLE, s.confidence + weight * 0.08 - CASE WHEN attempt THEN abs(s.mastery - CASE WHEN ok THEN 1 ELSE 0 END) ELSE 0 END * 0.04)), s.evidence + weight, s.attempts + CASE WHEN attempt THEN 1 ELSE 0 END,
  CASE WHEN ok THEN s.good + 1 WHEN bad THEN 0 ELSE s.good END, CASE WHEN bad THEN s.wrong + 1 WHEN ok THEN 0 ELSE s.wrong END, s.trend * 0.7 + signal * 0.3, CASE WHEN bad THEN greatest(1::DOUBLE, s.stability * 0.55) WHEN ok THEN least(365::DOUBLE, s.stability + greatest(1::DOUBLE, weight * 2)) ELSE s.stability END,
  CASE WHEN attempt THEN s.calibration * 0.8 + abs(s.mastery - CASE WHEN ok THEN 1 ELSE 0 END) * 0.2 ELSE s.calibration END, greatest(0::DOUBLE, least(1::DOUBLE, s.mastery + delta)) < 0.7 OR bad,
  CASE WHEN ok THEN CAST(ceil(least(365::DOUBLE, s.stability + greatest(1::DOUBLE, weight * 2))) AS BIGINT) ELSE days END FROM s JOIN n ON n.user_id = s.user_id AND n.topic = s.topic AND n.k = s.k + 1)"""
NUMBERS = ("mastery", "confidence", "evidence", "trend", "stability", "calibration")


def _history(spark, sf_dir):
    return folds.topic_history(learning_events(spark, sf_dir).where("topic IS NOT NULL"), ["user_id", "topic"])


def _last(spark, sf_dir):
    h = _history(spark, sf_dir)
    rest = [c for c in h.columns if c not in ("user_id", "topic")]
    return h.groupBy("user_id", "topic").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("user_id", "topic", "s.*")


ROUNDED = ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in NUMBERS)


@query(f"WITH RECURSIVE {STATES} SELECT user_id, topic, k AS version, event_id, {ROUNDED}, CAST(attempts AS BIGINT) AS attempts, CAST(good AS BIGINT) AS correct_streak, CAST(wrong AS BIGINT) AS wrong_streak, needs_review, review_days FROM s")
def state_history(spark, sf_dir):
    return _history(spark, sf_dir).withColumns({c: half_up(F.col(c), 6) for c in NUMBERS})


@query(f"WITH RECURSIVE {STATES} SELECT user_id, topic, version, event_id, {ROUNDED}, needs_review, review_days FROM (SELECT *, k AS version, row_number() OVER (PARTITION BY user_id, topic ORDER BY k DESC) AS z FROM s) WHERE z = 1")
def topic_states(spark, sf_dir):
    return _last(spark, sf_dir).withColumns({c: half_up(F.col(c), 6) for c in NUMBERS}).drop("attempts", "correct_streak", "wrong_streak")


LAST = f"{STATES}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY k DESC) AS z FROM s) WHERE z = 1)"


@query(f"""WITH RECURSIVE {LAST}, g AS (SELECT topic, sum(mastery * greatest(evidence, 0.1)) / sum(greatest(evidence, 0.1)) AS m, bool_or(needs_review) AS due, count(*) AS states FROM lt WHERE mastery < 0.75 OR needs_review GROUP BY 1)
SELECT topic, round(m, 6) AS mastery, round(1 - m, 4) AS weakness, states, concat_ws(',', CASE WHEN m < 0.75 THEN 'low mastery' END, CASE WHEN due THEN 'needs review' END) AS reasons FROM g""")
def weak_topics(spark, sf_dir):
    return study.weak_topics(_last(spark, sf_dir), "topic")


MISTAKES = f"""{EVENT}, ms AS (SELECT topic, sha256(upper(kind) || chr(10) || lower(difficulty)) AS mistake, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_id, (ts, event_id)) AS last_event
 FROM up WHERE kind = 'CONFUSED' OR (kind = 'ANSWER' AND NOT correct) GROUP BY 1, 2)"""


def _mistakes(spark, sf_dir):
    e = learning_events(spark, sf_dir).where("kind = 'CONFUSED' OR (kind = 'ANSWER' AND NOT correct)")
    return study.mistakes(e.select("topic", F.col("kind").alias("mistake_type"), F.col("difficulty").alias("summary"), "ts", "event_id"), ["topic"])


@query(f"WITH {MISTAKES} SELECT * FROM ms")
def mistake_memory(spark, sf_dir):
    return _mistakes(spark, sf_dir)


@query(f"WITH {MISTAKES}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY occurrences DESC, mistake) AS rank FROM ms) SELECT topic, string_agg(mistake, ',' ORDER BY rank) AS top FROM r WHERE rank <= 3 GROUP BY 1")
def top_mistakes(spark, sf_dir):
    return study.top_mistakes(_mistakes(spark, sf_dir), ["topic"]).withColumn("top", F.array_join("top", ","))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w IS DISTINCT FROM event_type AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, arg_max(event_type, n) AS event_type, CAST(max(n) - max(n) FILTER (c) + 1 AS BIGINT) AS evidence FROM n GROUP BY 1) SELECT *, least(0.95::DOUBLE, evidence / 10) AS confidence, evidence >= 5 AS visible FROM g""")
def behaviour_preference(spark, sf_dir):
    return study.preferences(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT l_partkey AS a, l_suppkey AS b, round(avg(l_discount), 6) AS weight, count(*) AS evidence FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def edge_means(spark, sf_dir):
    return study.edge_means(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_discount").alias("weight")))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 400000 < 0.25 AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 45 DAY")
def stale_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 400000).alias("confidence"), F.col("o_orderdate").alias("last"))
    return study.stale(o, "1998-01-01 00:00:00", 45).select("o_orderkey")


@query("""WITH v AS (SELECT ['DUE_FIRST', 'WEAK_FIRST'][CAST(CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS INT) + 1] AS variant, greatest(-1, least(1, value - 1)) AS outcome FROM events)
SELECT variant, round(sum(outcome), 4) AS outcome, count(*) AS n FROM v GROUP BY 1""")
def experiment_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(study.variant(F.col("user_id"), ["DUE_FIRST", "WEAK_FIRST"]).alias("variant"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") - 1)).alias("o"))
    return e.groupBy("variant").agg(F.round(F.sum("o"), 4).alias("outcome"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(props->>'k' AS INT) AS topic, ts, value FROM events), t AS (SELECT user_id, topic, max(epoch_us(ts)) AS last, round(avg(value), 4) AS mean FROM e GROUP BY 1, 2),
d AS (SELECT user_id, topic, 0 AS t, topic % 2 <> 0 AS g, 'REVIEW' AS action, 15 AS b, row_number() OVER (PARTITION BY user_id ORDER BY last, topic) AS r FROM t),
w AS (SELECT user_id, topic, 1, topic % 2 <> 0, 'PRACTICE', 20, row_number() OVER (PARTITION BY user_id ORDER BY mean, topic) FROM t WHERE mean < 60),
u AS (SELECT * FROM d WHERE r <= 12 UNION ALL SELECT * FROM w AS x(user_id, topic, t, g, action, b, r) WHERE r <= 12), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY t, g, r) AS k FROM u),
p AS (SELECT *, row_number() OVER z AS step, sum(b) OVER (z ROWS UNBOUNDED PRECEDING) - b AS s FROM o WHERE k = 1 WINDOW z AS (PARTITION BY user_id ORDER BY t, g, r)) SELECT user_id, step, topic, action, CAST(least(b, 240 - s) AS BIGINT) AS minutes FROM p WHERE s < 240""")
def study_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("topic", F.get_json_object("props", "$.k").cast("int"))
    t = e.groupBy("user_id", "topic").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last"), F.round(F.avg("value"), 4).alias("mean")).withColumn("in_goal", F.col("topic") % 2 == 0)
    return study.study_plan(t.withColumn("place", F.col("last")), t.where("mean < 60").withColumn("place", F.col("mean")), "user_id", 240)


LINES = f"{CHUNKS}, ln AS (SELECT doc_id, chunk_index, greatest(1, (length(content) + 3) // 4) AS tokens FROM c)"


def _lines(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.greatest(F.lit(1), F.floor((F.length("content") + 3) / 4)).cast("long").alias("tokens"))


GROUPS = f"""{LINES}, pk AS (SELECT doc_id, chunk_index, tokens AS size, 0::BIGINT AS gi FROM ln WHERE chunk_index = 0
 UNION ALL SELECT ln.doc_id, ln.chunk_index, CASE WHEN pk.size >= 120 OR pk.size + ln.tokens > 200 THEN ln.tokens ELSE pk.size + ln.tokens END, pk.gi + CASE WHEN pk.size >= 120 OR pk.size + ln.tokens > 200 THEN 1 ELSE 0 END FROM pk JOIN ln ON ln.doc_id = pk.doc_id AND ln.chunk_index = pk.chunk_index + 1)"""


@query(f"WITH RECURSIVE {GROUPS} SELECT doc_id, chunk_index, gi AS group_index FROM pk")
def source_groups(spark, sf_dir):
    return folds.source_groups(_lines(spark, sf_dir), ["doc_id"], "chunk_index", 120, 200)


@query("""WITH g AS (SELECT o_custkey AS deck, o_orderkey AS group_index, CAST(floor(o_totalprice / 100) AS BIGINT) AS tokens FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY deck) AS n, sum(tokens) OVER (PARTITION BY deck) AS t FROM g),
a AS (SELECT *, least(greatest(40, n), greatest(n, round_even(t / 1000 * 2.5::DOUBLE, 0))) AS al FROM n), r AS (SELECT *, (al - n) * tokens / CASE WHEN t > 0 THEN t ELSE n END AS raw FROM a), q AS (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY round(raw - floor(raw), 9) DESC, group_index) AS rn, al - n - sum(floor(raw)) OVER (PARTITION BY deck) AS free FROM r)
SELECT deck, group_index, tokens, CAST(1 + floor(raw) + CASE WHEN rn <= free THEN 1 ELSE 0 END AS BIGINT) AS items FROM q""")
def item_targets(spark, sf_dir):
    return study.item_targets(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deck"), F.col("o_orderkey").alias("group_index"), F.floor(F.col("o_totalprice") / 100).alias("tokens")), "deck", 2.5, 40)


@query("SELECT DISTINCT l_orderkey AS item, unnest(range(p_size::BIGINT, p_size + 1 + p_partkey % 4)) AS page FROM lineitem JOIN part ON p_partkey = l_partkey")
def cited_pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("source"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("long").alias("page_start"), (F.col("p_size") + F.col("p_partkey") % 4).cast("long").alias("page_end"))
    return study.cited_pages(li, p)


@query("""SELECT q.l_orderkey, q.l_linenumber, CASE WHEN q.l_quantity > 45 AND a.l_orderkey IS NOT NULL THEN NULL WHEN q.l_returnflag = upper(trim(a.given)) THEN q.l_quantity ELSE 0.0 END AS awarded, q.l_quantity > 45 AND a.l_orderkey IS NOT NULL AS waits
FROM lineitem q LEFT JOIN (SELECT l_orderkey, l_linenumber, ' ' || lower(CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END) AS given FROM lineitem WHERE l_linenumber <> 2) a ON q.l_orderkey = a.l_orderkey AND q.l_linenumber = a.l_linenumber""")
def objective_grading(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    given = F.concat(F.lit(" "), F.lower(F.when(F.col("l_linestatus") == "F", "R").otherwise("N")))
    q = li.select(*key, F.col("l_returnflag").alias("expected"), F.col("l_quantity").alias("points"), (F.col("l_quantity") <= 45).alias("objective"))
    return study.grade_objective(q, li.where("l_linenumber <> 2").select(*key, given.alias("given")), key)


@query("""SELECT l_orderkey AS artifact, count(*) AS items, count(*) FILTER (l_discount >= 0.09) AS ungrounded, count(*) FILTER (l_tax >= 0.08) AS unsure, count(*) - count(DISTINCT l_suppkey) AS repeated,
count(*) >= 2 AND count(*) FILTER (l_discount >= 0.09) = 0 AND count(*) FILTER (l_tax >= 0.08) = 0 AND count(*) = count(DISTINCT l_suppkey) AS passes FROM lineitem GROUP BY 1""")
def artifact_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "artifact")
    return study.artifact_gate(li, "artifact", "l_suppkey", F.col("l_discount") < 0.09, F.col("l_tax") < 0.08, F.lit(2))


@query("""WITH q AS (SELECT o_custkey AS topic, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS ratio, count(*) FILTER (o_orderpriority LIKE '1%') AS due FROM orders GROUP BY 1) SELECT c_custkey AS topic, round((1 - coalesce(ratio, 0)) * 100 + least(30, 3 * coalesce(due, 0)), 4)::DOUBLE AS priority FROM customer LEFT JOIN q ON topic = c_custkey""")
def review_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("topic")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("ratio"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("due"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic")).join(o, "topic", "left")
    return c.select("topic", study.review_priority(F.coalesce("ratio", F.lit(0.0)), F.coalesce("due", F.lit(0))).alias("priority"))


@query("SELECT o_orderkey AS task, floor((0.45::DOUBLE * (o_orderkey % 11) + 0.55::DOUBLE * (o_custkey % 11)) / sqrt(greatest(o_orderkey % 5, 0.25)) * 1e6 + 0.5) / 1e6 AS score FROM orders")
def task_scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), study.task_score(F.col("o_orderkey") % 11, F.col("o_custkey") % 11, (F.col("o_orderkey") % 5).cast("double")).alias("score"))


@query(f"""WITH a AS (SELECT item_id AS id, list_distinct({TOK.format('b.text')}) AS c, {TOK.format('d.text')} AS e FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), s AS (SELECT id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, list_distinct(e))) / len(c) ELSE 0 END, 6) AS overlap FROM a) SELECT id, overlap, overlap < 0.35 AS unsupported FROM s""")
def claim_support(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return study.claim_support(b.select(F.col("item_id").alias("id"), F.col("text").alias("claim")).join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("evidence")), "id"))


@query("SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING count(*) >= any_value(1 + o_custkey % 6)")
def finished_groups(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 6).alias("expected"))
    return study.finished_groups(table(spark, sf_dir, "lineitem"), want, ["l_orderkey"])


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey AS root, 0 AS depth FROM part WHERE p_partkey BETWEEN 5 AND 9 UNION ALL SELECT p.p_partkey, t.root, t.depth + 1 FROM t JOIN part p ON p.p_partkey > 1 AND p.p_partkey // 3 = t.node) SELECT * FROM t""")
def folder_subtree(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return study.subtree(nodes, p.where("p_partkey BETWEEN 5 AND 9").select(F.col("p_partkey").alias("node")))


@query(f"""WITH {FUSED}, hit AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, evidence DESC, id) AS rank FROM f), x AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
m AS (SELECT query_id, count(*) AS wanted, count(*) FILTER (rank <= 5) AS got, min(rank) AS first FROM x LEFT JOIN hit USING (query_id, id) GROUP BY 1) SELECT query_id, round(got / least(wanted, 5), 6) AS recall, round(coalesce(1 / first, 0.0::DOUBLE), 6) AS reciprocal_rank FROM m""")
def retrieval_quality(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    want = d.join(b.select("item_id", F.col("text").alias("s")), d.text.contains(F.col("s"))).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    return study.retrieval_quality(_fused(spark, sf_dir).select("query_id", "id", "rank"), want)
