"""Registered queries of predicates, aggregates and status rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from .registry import CHUNKS, chunks, query, table
from .study_queries import STATES, _history, _last

HALF = "floor({0} * 1e{1} + 0.5) / 1e{1}"


def half(x: str, n: int = 6) -> str:
    return HALF.format(f"({x})", n)


@query("SELECT p_partkey, substr(p_name, 1, 6) AS short FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_size IN (3, 5, 8, 13, 21)")
def text_search(spark, sf_dir):
    found = R.matching(table(spark, sf_dir, "part"), " Ring ", ["p_name", "p_type"])
    return R.among(R.among(R.matching(found, "", ["p_brand"]), "p_size", [3, 5, 8, 13, 21]), "p_partkey", []).select("p_partkey", R.excerpt(F.col("p_name"), 6).alias("short"))


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 7 DAY END IS NULL OR ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20'")
def alive_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("expires", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 7 DAY")))
    return R.alive(e, "expires", "2024-01-20 00:00:00").select("event_id")


@query("""WITH m AS (SELECT user_id, max((ts, event_id)) AS m FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 2 = 0 GROUP BY 1) SELECT e.event_id FROM events e LEFT JOIN m USING (user_id) WHERE m.m IS NULL OR (e.ts, e.event_id) > m.m""")
def after_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.where("ts < TIMESTAMP '2024-01-15' AND user_id % 2 = 0").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.*")
    return R.after_mark(e, m, "user_id", "ts", "event_id").select("event_id")


TASKS = "tk AS (SELECT o_custkey AS doc_id, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, o_orderdate AS created FROM orders)"


def _tasks(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("task_id"), F.when(s == "F", "FAILED").when(s == "O", "PROCESSING").otherwise("COMPLETED").alias("status"), F.col("o_orderdate").alias("created"))


@query(f"""WITH {TASKS}, l AS (SELECT doc_id, arg_max(status, (created, task_id)) AS s FROM tk GROUP BY 1)
SELECT c_custkey AS doc_id, CASE WHEN s IN ('PENDING', 'PROCESSING', 'RETRYING') THEN 'PROCESSING' WHEN c_acctbal > 5000 THEN 'READY' WHEN s = 'FAILED' THEN 'FAILED' ELSE 'NOT_STARTED' END AS status FROM customer LEFT JOIN l ON doc_id = c_custkey""")
def pipeline_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") > 5000).alias("has_result"))
    return R.pipeline_status(c, _tasks(spark, sf_dir), "doc_id")


@query("SELECT event_id, TRY_CAST(props->>'k' AS INT) AS k, CAST(NULL AS DOUBLE) AS weight FROM events")
def json_projection(spark, sf_dir):
    return R.json_fields(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "int", "weight": "double"}).drop("props")


@query(f"""WITH {CHUNKS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE source = (SELECT min(source) FROM documents)), s AS (SELECT c.doc_id, chunk_index, place, 'part ' || (chunk_index // 4) AS section FROM c JOIN o USING (doc_id))
SELECT doc_id, chunk_index, place FROM s WHERE chunk_index % 2 = 0 AND contains(section, 'part 1')""")
def chunk_scope(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    mine = d.join(d.agg(F.min("source").alias("source")), "source", "left_semi")
    order = R.top(mine.withColumn("all", F.lit(1)), ["all"], [F.desc("n_chars"), F.col("doc_id")], 1 << 30, "place").select("doc_id", F.col("place").cast("long").alias("place"))
    c = chunks(spark, sf_dir).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    c = c.withColumn("id", F.concat_ws("/", "doc_id", "chunk_index")).withColumn("section", F.concat(F.lit("part "), F.floor(F.col("chunk_index") / 4).cast("string")))
    return R.chunk_scope(c, order, c.where("chunk_index % 2 = 0").select("id"), "Part 1").select("doc_id", "chunk_index", "place")


@query("""WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"limit": 5}' WHEN 1 THEN '{"limit": "many", "mode": "FAST"}' WHEN 2 THEN '{"mode": "OTHER", "limit": 3, "extra": 1}' WHEN 3 THEN '[]' ELSE '{"mode": "SLOW", "limit": -2}' END AS j FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing mode' WHEN 1 THEN 'wrong limit' WHEN 2 THEN 'unknown extra,wrong mode' WHEN 3 THEN 'no object' ELSE '' END AS errors FROM a""")
def argument_check(spark, sf_dir):
    i = F.col("event_id") % 5
    j = F.when(i == 0, '{"limit": 5}').when(i == 1, '{"limit": "many", "mode": "FAST"}').when(i == 2, '{"mode": "OTHER", "limit": 3, "extra": 1}').when(i == 3, "[]").otherwise('{"mode": "SLOW", "limit": -2}')
    schema = {"limit": ("integer", True, ()), "mode": ("string", True, ("FAST", "SLOW"))}
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.argument_errors(j, schema), ",").alias("errors"))


@query("""SELECT c_custkey, 'apiKey=[redacted],name=' || c_name || ',sessionToken=[redacted]' AS shown FROM customer""")
def redacted_arguments(spark, sf_dir):
    m = R.redacted(F.create_map(F.lit("apiKey"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("sessionToken"), F.lit("x")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("shown"))


ANSWERS = "an AS (SELECT l_orderkey AS attempt, l_suppkey % 40 AS topic, l_partkey % 9 AS digest, l_returnflag <> 'R' AS correct, l_quantity AS score, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE 50.0 END::DOUBLE AS max, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS ms FROM lineitem)"


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt"), (F.col("l_suppkey") % 40).alias("topic"), (F.col("l_partkey") % 9).alias("digest"), (F.col("l_returnflag") != "R").alias("correct"), F.col("l_quantity").alias("score"),
        F.when(F.col("l_linenumber") == 3, 0.0).otherwise(50.0).alias("of"), F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("ms"))


@query(f"""WITH {ANSWERS}, g AS (SELECT attempt, count(*) AS answers, count(*) FILTER (NOT correct) AS wrong, count(DISTINCT digest) AS different, avg(score / max) FILTER (max > 0) AS r, avg(ms) AS t FROM an GROUP BY 1)
SELECT attempt, answers, wrong, different, answers - different AS repeated, round(coalesce(r, 0), 6) AS mean_ratio, {half('coalesce(t, 0)')} AS mean_ms FROM g""")
def attempt_counts(spark, sf_dir):
    return R.attempt_counts(_answers(spark, sf_dir), "attempt").withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(f"""WITH {ANSWERS}, g AS (SELECT topic, count(*) AS answers, count(*) FILTER (NOT correct) AS wrong, coalesce(avg(score / max) FILTER (max > 0), 0) AS r FROM an GROUP BY 1)
SELECT topic, answers, wrong, {half('r')} AS ratio, {half('1 - r', 4)} AS weakness, r < 0.5 AS weak, wrong >= 300 AS often_wrong, {half('(SELECT sum(r * answers) / sum(answers) FROM g)')} AS overall FROM g""")
def topic_performance(spark, sf_dir):
    return R.topic_performance(_answers(spark, sf_dir), 0.5, 300)


@query("SELECT role, CAST(turn AS BIGINT) AS turn, count(*) AS n FROM conversations GROUP BY 1, 2")
def role_distribution(spark, sf_dir):
    return R.distribution(table(spark, sf_dir, "conversations"), "role", "turn")


@query(f"""WITH {CHUNKS}, h AS (SELECT doc_id, count(*) AS matching FROM c WHERE contains(lower(content), 'the') GROUP BY 1), j AS (SELECT d.doc_id, contains(lower(source), '3') AS titled, coalesce(matching, 0) AS matching, n_chars FROM documents d LEFT JOIN h USING (doc_id))
SELECT doc_id, titled, matching, row_number() OVER (ORDER BY titled DESC, matching DESC, n_chars DESC, doc_id) AS place FROM j WHERE titled OR matching > 0 ORDER BY place LIMIT 25""")
def document_search(spark, sf_dir):
    # the term is looked for in the texts, a digit in the titles
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source").contains("3"), "The best").otherwise("").alias("title"), F.col("n_chars").alias("created"))
    found = R.matching_chunks(d, chunks(spark, sf_dir), "the")
    first = R.first_rows(found, [F.desc("titled"), F.desc("matching"), F.desc("created"), F.col("doc_id")], 900, 8, 25)
    return R.top(first.withColumn("all", F.lit(1)), ["all"], [F.desc("titled"), F.desc("matching"), F.desc("created"), F.col("doc_id")], 25, "place").select("doc_id", "titled", "matching", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey AS scope, coalesce((SELECT max(o_orderkey % 11) FROM orders WHERE o_custkey = c_custkey), 0) + 1 AS version FROM customer")
def version_allocation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 11).alias("version"))
    return R.next_version(o, ["scope"], table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope")))


@query("SELECT event_type AS provider, count(*) AS calls, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens FROM events GROUP BY 1")
def provider_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    return R.usage(e, ["provider"], ["input_tokens", "output_tokens"])


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_totalprice NULLS LAST, o_orderkey) AS place FROM orders""")
def ordered_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return R.top(o, ["o_custkey"], [F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), at.desc_nulls_first(), F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")], 1 << 30, "place").select("o_orderkey", "place")


@query("""WITH g AS (SELECT l_orderkey AS item, list_distinct(list(l_suppkey % 10)) AS w, list_distinct(list(l_partkey % 10)) AS f FROM lineitem GROUP BY 1)
SELECT item, floor(len(list_intersect(w, f)) / len(w) * 1e6 + 0.5) / 1e6 AS ratio, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(f, x))), ',') AS missing FROM g""")
def topic_coverage(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("w"), F.collect_set(F.col("l_partkey") % 10).alias("f"))
    c = R.coverage(F.col("f"), F.col("w"))
    return g.select("item", c.alias("c")).select("item", "c.ratio", F.array_join(F.transform("c.missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("SELECT c_custkey, round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal), 2) AS c_acctbal FROM customer")
def updated_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.updated_from(c, o, "c_custkey", "c_acctbal", F.sum("o_totalprice")).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT s_suppkey, coalesce(n_name, 'Untitled') AS title FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON n_nationkey = s_nationkey")
def titled_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("title"))
    return R.with_titles(table(spark, sf_dir, "supplier"), n, "s_nationkey").select("s_suppkey", "title")


@query("""SELECT c_custkey, lower(trim(regexp_replace(' ' || c_mktsegment || '   ' || c_name || ' ', '\\s+', ' ', 'g'))) AS topic_key, CASE c_custkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.07 WHEN 3 THEN NULL ELSE NULL END::DOUBLE AS confidence FROM customer""")
def normal_values(spark, sf_dir):
    i = F.col("c_custkey") % 5
    raw = F.when(i == 0, "0.5").when(i == 1, "80").when(i == 2, "7").when(i == 3, "high").otherwise("180")
    return table(spark, sf_dir, "customer").select("c_custkey", R.topic_key(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("   "), F.col("c_name"), F.lit(" "))).alias("topic_key"), F.round(R.confidence(raw), 6).alias("confidence"))


@query("""WITH e AS (SELECT o_custkey AS run, o_orderpriority AS name, max(o_orderkey % 13) AS n FROM orders GROUP BY 1, 2) SELECT run, string_agg(name || '=' || n, ',' ORDER BY name) AS expected FROM e GROUP BY 1""")
def merged_expectations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.create_map("o_orderpriority", (F.col("o_orderkey") % 13)).alias("expected"))
    m = R.merged_expectations(o, ["run"])
    return m.select("run", F.array_join(F.transform(F.array_sort(F.map_entries("expected")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("expected"))


@query("""WITH g AS (SELECT o_custkey AS owner, o_orderkey % 4 AS goal, CAST(floor(o_totalprice / 3000) - 10 AS BIGINT) AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS deadline, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'ACTIVE' END AS status, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey DESC) AS n FROM orders),
l AS (SELECT owner, goal, greatest(0, least(100, p)) AS priority, deadline FROM g WHERE n = 1 AND status = 'ACTIVE') SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority DESC, deadline NULLS LAST, goal) AS place FROM l""")
def goal_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 4).alias("goal"), (F.floor(F.col("o_totalprice") / 3000) - 10).alias("priority"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("deadline"), F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("ACTIVE").alias("status"), F.col("o_orderkey").alias("at"))
    return R.goals(g, "owner")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS artifact FROM lineitem), e AS (SELECT l_partkey AS artifact, count(*) AS uses, count(*) FILTER (l_returnflag = 'A') AS good FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT owner, artifact, coalesce(uses, 0) AS uses, coalesce(good, 0) AS good FROM l LEFT JOIN e USING (artifact)""")
def artifact_use(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    links = li.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("artifact"))
    return R.interactions(links, li.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("artifact"), (F.col("l_returnflag") == "A").alias("correct")), "owner")


@query(f"""WITH RECURSIVE {STATES}, r AS (SELECT user_id, topic, k, mastery, row_number() OVER (PARTITION BY user_id, topic ORDER BY k DESC) AS place FROM s) SELECT user_id, topic, k AS version, {half('mastery')} AS mastery, place FROM r WHERE place <= 3""")
def mastery_trend(spark, sf_dir):
    return R.trend(_history(spark, sf_dir), ["user_id", "topic"], 3).select("user_id", "topic", "version", (F.floor(F.col("mastery") * 1e6 + 0.5) / 1e6).alias("mastery"), "place")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 4 = p_partkey % 4 THEN greatest(0, least(1, p_retailprice / 950)) ELSE p_size / 50 END::DOUBLE AS mastery, CASE WHEN p_partkey % 3 = 0 AND p_size % 4 = p_partkey % 4 THEN p_size % 4 + 1 ELSE p_size % 4 END AS version, CASE WHEN p_partkey % 3 = 0 AND p_size % 4 = p_partkey % 4 THEN 'asked' END AS reason FROM part""")
def corrections(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    states = p.select("p_partkey", (F.col("p_size") / 50).alias("mastery"), (F.col("p_size") % 4).alias("version"))
    wanted = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_retailprice") / 950).alias("mastery"), (F.col("p_partkey") % 4).cast("int").alias("expected"), F.lit("asked").alias("reason"))
    after, log = R.corrected(states, wanted, "p_partkey")
    return after.join(log.select("p_partkey", "reason"), "p_partkey", "left")


@query("""SELECT o_custkey AS "user", 'quiz:' || l_orderkey || ':' || l_linenumber AS event, lower(p_name) AS topic, l_returnflag <> 'R' AS correct FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' AND o_orderstatus = 'F'""")
def quiz_events(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag") != "R").alias("correct"))
    key = F.concat_ws("#", "number", "part")
    q = a.select(key.alias("question"), "part").distinct().join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("topic"), F.lit("MEDIUM").alias("difficulty")), "part")
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("finished"))
    e = R.attempt_events(a.withColumn("question", key), q, at)
    return e.select("user", F.regexp_replace("event", "#.*$", "").alias("event"), "topic", "correct")


@query("""SELECT event_id AS id, user_id AS "user", CASE event_type WHEN 'click' THEN 'CONFUSED' WHEN 'view' THEN 'MASTERED' END AS event, CASE event_type WHEN 'purchase' THEN 'HARD' WHEN 'signup' THEN 'MORE' END AS preference FROM events WHERE event_type <> 'error'""")
def feedback_events(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "click", "TOO_HARD").when(t == "view", "ALREADY_KNOWN").when(t == "purchase", "TOO_EASY").when(t == "signup", "MORE_PRACTICE").otherwise("NOT_RELEVANT")
    return R.feedback_events(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.lit("t").alias("topic"), kind.alias("kind"))).drop("topic")


@query("""WITH t AS (SELECT l_suppkey AS doc, l_partkey AS topic, max(l_shipdate) AS day FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY day DESC, topic) AS n FROM t) SELECT event_id AS id, doc, topic FROM events JOIN r ON doc = user_id WHERE n <= 4""")
def activity_fan_out(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("topic")).agg(F.max("l_shipdate").alias("at"))
    return R.fan_out(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("doc")), t, 4)


@query(f"""WITH {TASKS}, n AS (SELECT l_suppkey AS doc_id, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS note FROM lineitem GROUP BY 1), t AS (SELECT doc_id, arg_max(status, (created, task_id)) AS embedding FROM tk GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(note, 'NOT_STARTED') AS note, coalesce(embedding, 'NOT_STARTED') AS embedding FROM customer LEFT JOIN n ON n.doc_id = c_custkey LEFT JOIN t ON t.doc_id = c_custkey""")
def document_list(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), F.col("l_returnflag").alias("status"))
    return R.document_list(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), n, _tasks(spark, sf_dir))


@query("""SELECT event_id, ts + to_days(CAST(ceil(value / 50) AS INT)) AS due, ts < TIMESTAMP '2024-01-20' - to_minutes(CAST(event_id % 3000 AS INT)) AS late FROM events""")
def date_sums(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", R.days_later(at, F.col("value") / 50).alias("due"), (at < R.minutes_before("2024-01-20 00:00:00", (F.col("event_id") % 3000).cast("int"))).alias("late"))


@query("""SELECT o_orderkey AS attempt, o_orderstatus AS status, o_totalprice AS total, coalesce((SELECT string_agg(l_linenumber || ':' || l_returnflag || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_returnflag, l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS answers FROM orders""")
def attempt_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("given"), F.col("l_quantity").alias("awarded"))
    r = R.attempt_results(o, a)
    return r.withColumn("answers", F.array_join(F.transform("answers", lambda x: F.concat_ws(":", x["number"].cast("string"), x["given"], x["awarded"].cast("long").cast("string"))), ","))


@query(f"""WITH RECURSIVE {STATES}, l AS (SELECT user_id, topic, arg_max(mastery, k) AS m, arg_max(attempts, k) AS a, arg_max(needs_review, k) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS topics, CAST(sum(a) AS BIGINT) AS attempts, {half('avg(m)', 9)} AS mastery, count(*) FILTER (n) AS due FROM l GROUP BY 1""")
def learning_profiles(spark, sf_dir):
    return R.learning_profile(_last(spark, sf_dir), ["user_id"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def rows_of_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return R.of_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", keys, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "place")
