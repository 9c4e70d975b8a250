"""Registered queries of generated material, memory steps and task states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..operators import workflow as W
from .memory_queries import COS
from .registry import CHUNKS, chunks, query, table


@query(None)
def sequence_ratios(spark, sf_dir):
    """Lines of documents that are 0.86 alike or more to the line after, both whole. No SQL: matching blocks are found within what others leave; tests hold it against brute force."""
    # a text's lines meet in its own row, nothing is joined
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("a")).select("doc_id", "a", F.slice("a", 2, 1 << 30).alias("b"))
    pairs = lines.select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("chunk_index", "pair")).where("pair.b IS NOT NULL").select("doc_id", "chunk_index", "pair.a", "pair.b")
    return W.similar_sequences(pairs, 0.86).select("doc_id", "chunk_index", F.round("ratio", 6).alias("ratio"))


@query(None)
def accepted_candidates(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").alias("position"), F.col("content").alias("text"), (F.col("chunk_index") % 10 / 10).alias("confidence"), F.array("chunk_index").alias("sources"))
    return W.accepted_candidates(c, ["doc_id"], 12)


@query(None)
def repaired_json(spark, sf_dir):
    """Props of events as a model might write them: fenced, cut off, with lone backslashes or raw line breaks."""
    i, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(i == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 1, F.lit('{"tex": "\\alpha + \\frac{1}{2}"}')).when(i == 2, F.lit('{"a": ["one", "two')).when(i == 3, F.lit('{"t": "line\nbreak"}')).otherwise(F.lit("no json"))
    return table(spark, sf_dir, "events").select("event_id", W.repaired_json(raw).alias("json"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey % 23 AS total FROM orders), p AS (SELECT id, total, unnest([{'part': 'EASY', 'w': 0.3::DOUBLE, 'i': 0}, {'part': 'MEDIUM', 'w': 0.5::DOUBLE, 'i': 1}, {'part': 'HARD', 'w': 0.2::DOUBLE, 'i': 2}], recursive := true) FROM t),
f AS (SELECT *, floor(total * w + 1e-9) AS n, floor((total * w - floor(total * w + 1e-9)) * 1e9 + 0.5) / 1e9 AS rest FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rest DESC, i) AS k, total - sum(n) OVER (PARTITION BY id) AS free FROM f)
SELECT id, string_agg(part || '=' || CAST(n + CASE WHEN k <= free THEN 1 ELSE 0 END AS BIGINT), ',' ORDER BY i) AS mix FROM r GROUP BY 1""")
def difficulty_mix(spark, sf_dir):
    m = W.mix_counts(F.col("o_custkey") % 23)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(m, lambda p: F.concat(p["part"], F.lit("="), p["n"].cast("string"))), ",").alias("mix"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_partkey % 11 = 0 THEN 'kind' END, CASE WHEN l_suppkey % 13 = 0 THEN 'empty' END, CASE WHEN l_quantity <= 2 THEN 'points' END, CASE WHEN l_linenumber = 7 THEN 'rubric' END,
 CASE WHEN l_returnflag = 'A' AND l_partkey % 11 > 0 AND l_suppkey % 5 = 0 THEN 'options' END, CASE WHEN l_returnflag = 'A' AND l_partkey % 11 > 0 AND l_suppkey % 5 = 1 THEN 'rationales' END, CASE WHEN l_tax = 0 THEN 'sources' END, CASE WHEN l_discount > 0.09 THEN 'confidence' END) AS errors FROM lineitem WHERE l_orderkey % 3 = 0""")
def question_validation(spark, sf_dir):
    c = F.col
    points = F.when(c("l_quantity") <= 2, 0.0).otherwise(c("l_quantity"))
    q = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_partkey") % 11 == 0, "RIDDLE").when(c("l_returnflag") == "A", "MULTIPLE_CHOICE").otherwise("SHORT_ANSWER").alias("type"), F.lit("EASY").alias("difficulty"), F.when(c("l_suppkey") % 13 == 0, " ").otherwise("stem").alias("stem"), F.lit("topic").alias("topic"), F.lit("yes").alias("answer"),
        points.alias("points"), F.array(points / 2, F.when(c("l_linenumber") == 7, points / 2 + 1).otherwise(points / 2)).alias("weights"), F.when(c("l_suppkey") % 5 == 0, F.array(F.lit("no"), F.lit("perhaps"))).otherwise(F.array(F.lit("no"), F.lit("yes"))).alias("options"),
        F.when(c("l_suppkey") % 5 == 1, 2).otherwise(1).alias("rationales"), F.when(c("l_tax") == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("sources"), F.when(c("l_discount") > 0.09, "sure").otherwise("80").alias("confidence"))
    sound, bad = W.split_valid(q, W.question_errors(q))
    keep = ["l_orderkey", "l_linenumber", "l_partkey"]
    return sound.select(*keep, F.lit("").alias("errors")).unionByName(bad.select(*keep, F.array_join("errors", ",").alias("errors")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN FALSE ELSE l_quantity / 50 >= 0.6 END AS passed FROM lineitem")
def free_text_passes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", W.passed(F.col("l_quantity"), F.when(F.col("l_linenumber") == 3, 0).otherwise(50)).alias("passed"))


@query("""WITH s AS (SELECT l_orderkey AS note, l_suppkey % 4 * 1000 + l_linenumber * 10 + l_partkey % 10 AS i, l_returnflag AS t, CAST(l_partkey AS VARCHAR) AS c, l_suppkey AS s FROM lineitem), u AS (SELECT note, s, min((i, t, c, s)) AS f FROM s GROUP BY 1, 2)
SELECT a.note, a.sections, md5(a.m) AS digest, b.sources FROM (SELECT note, CAST(count(*) AS INT) AS sections, string_agg('## ' || t || chr(10) || chr(10) || c, chr(10) || chr(10) ORDER BY i, t, c, s) AS m FROM s GROUP BY 1) a JOIN (SELECT note, string_agg(CAST(s AS VARCHAR), ',' ORDER BY f) AS sources FROM u GROUP BY 1) b ON a.note = b.note""")
def assembled_notes(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), (F.col("l_suppkey") % 4).alias("group"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("number"), F.col("l_returnflag").alias("title"), F.concat(F.col("l_partkey").cast("string"), F.lit(" ")).alias("content"), F.array("l_suppkey").alias("sources"))
    n = W.assembled_notes(s, "note")
    return n.select("note", "sections", F.md5("markdown").alias("digest"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("""WITH g AS (SELECT o_custkey AS deck, o_orderkey AS grp, 1 + o_orderkey % 3 AS expected FROM orders), i AS (SELECT l_orderkey AS grp, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT o_custkey AS deck, l_returnflag AS w, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' GROUP BY 1, 2),
a AS (SELECT deck, count(*) AS groups, count(*) FILTER (coalesce(n, 0) >= expected) AS done, CAST(coalesce(sum(n), 0) AS BIGINT) AS items FROM g LEFT JOIN i USING (grp) GROUP BY 1) SELECT a.*, floor(done / groups * 1e4 + 0.5) / 1e4 AS coverage, coalesce((SELECT string_agg(w || '=' || c, ',' ORDER BY w) FROM w WHERE w.deck = a.deck), '') AS warnings FROM a""")
def generation_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deck"), F.col("o_orderkey").alias("group"), (1 + F.col("o_orderkey") % 3).alias("expected"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.when(F.col("l_returnflag") != "N", F.array("l_returnflag")).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return W.generation_report(o, li.join(o.select("deck", "group"), "group"), "deck")


@query("""WITH e AS (SELECT o_orderkey AS artifact, o_custkey AS scope, o_orderpriority AS options, CASE o_orderstatus WHEN 'O' THEN 'GENERATING' WHEN 'P' THEN 'READY' ELSE 'FAILED' END AS status, o_orderkey % 50 AS version FROM orders), q AS (SELECT c_custkey AS id, c_custkey AS scope, '1-URGENT' AS options FROM customer),
r AS (SELECT scope, options, arg_max(artifact, (version, artifact)) AS reuse FROM e WHERE status = 'GENERATING' GROUP BY 1, 2), l AS (SELECT scope, max(version) AS v FROM e GROUP BY 1) SELECT id, reuse, CASE WHEN reuse IS NULL THEN coalesce(v, 0) + 1 END AS version FROM q LEFT JOIN r USING (scope, options) LEFT JOIN l USING (scope)""")
def request_reuse(spark, sf_dir):
    s = F.col("o_orderstatus")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("options"), F.when(s == "O", "GENERATING").when(s == "P", "READY").otherwise("FAILED").alias("status"), (F.col("o_orderkey") % 50).alias("version"))
    return W.requests_resolved(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("scope"), F.lit("1-URGENT").alias("options")), e)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_custkey % 4 > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM orders")
def failed_generations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", W.failed_status(F.when(F.col("o_orderstatus") == "F", "READY").otherwise("GENERATING"), F.col("o_custkey") % 4).alias("status"))


@query(f"""WITH m AS (SELECT vec_id AS memory, label AS owner, embedding AS v FROM embeddings WHERE vec_id % 20 <> 0), q AS (SELECT vec_id AS id, label AS owner, CASE WHEN vec_id % 40 = 0 THEN embedding END AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT id, memory, {COS.format('q.v', 'm.v')} AS similarity FROM q JOIN m USING (owner) WHERE q.v IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, memory) AS rank FROM s WHERE similarity >= 0.1),
l AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY memory % 17 DESC, memory) AS rank FROM m) SELECT * FROM a WHERE rank <= 5 UNION ALL SELECT id, memory, NULL, rank FROM q JOIN l USING (owner) WHERE q.v IS NULL AND rank <= 3""")
def recalled_memories(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory"), F.col("label").alias("owner"), F.col("embedding").alias("vector"), (F.col("vec_id") % 17).alias("updated"))
    q = e.where("memory % 20 = 0").select(F.col("memory").alias("id"), "owner", F.when(F.col("memory") % 40 == 0, F.col("vector")).alias("vector"))
    return W.recalled_memories(q, e.where("memory % 20 <> 0"), least=0.1)


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'type' WHEN event_id % 7 = 0 THEN 'content' WHEN value > 400 THEN 'confidence' WHEN event_id % 5 = 0 AND event_id % 2 = 1 THEN 'message' END AS error, event_type <> 'error' AND event_id % 7 <> 0 AND value <= 400 AND NOT (event_id % 5 = 0 AND event_id % 2 = 1) AND value / 400 >= 0.5 AS kept, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS days FROM events""")
def memory_validation(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    c = e.select(i.alias("id"), F.when(F.col("event_type") != "error", "FACT").alias("type"), F.when(i % 7 == 0, " ").otherwise("likes tea").alias("content"), (F.col("value") / 400).alias("confidence"), F.when(i % 5 == 0, i).alias("message"), (i % 3).alias("days"))
    return W.memory_errors(c, e.where("event_id % 2 = 0").select(i.alias("message")))


@query("""SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'DARK' WHEN 'click' THEN 'deep Sea' END AS value, CASE event_type WHEN 'purchase' THEN 'unknown' WHEN 'signup' THEN 'value' WHEN 'error' THEN 'empty' END AS error FROM events""")
def preference_values(spark, sf_dir):
    t = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(t == "purchase", "SHOE_SIZE").when(t.isin("view", "signup"), "THEME").otherwise("TONE").alias("key"), F.when(t == "view", " dark ").when(t == "click", "deep Sea ").when(t == "error", "  ").otherwise("blue").alias("value"))
    rules = spark.createDataFrame([("THEME", ["DARK", "LIGHT"]), ("TONE", None)], "key string, allowed array<string>")
    return W.preference_values(rows, rules)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'EXAMPLE' WHEN 'R' THEN 'CONCEPT' ELSE 'SUMMARY' END AS kind, l_suppkey % 5 * 1000 + l_linenumber AS index, CASE WHEN l_tax > 0.04 THEN 'short,long' ELSE 'short' END AS warnings FROM lineitem""")
def note_sections(spark, sf_dir):
    r = F.col("l_returnflag")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 5).alias("group"), F.col("l_linenumber").alias("number"), F.when(r == "A", "example").when(r == "R", "riddle!").otherwise(" Summary").alias("kind"), F.array(F.lit("short"), F.when(F.col("l_tax") > 0.04, "long").otherwise("short"), F.lit("short")).alias("warnings"))
    return W.note_sections(s).select("l_orderkey", "l_linenumber", "l_partkey", "kind", "index", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 5 END AS BIGINT) AS easy, CAST(o_custkey % 3 AS BIGINT) AS medium, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 ELSE o_custkey % 5 + o_custkey % 3 END AS total,
 CASE WHEN o_orderkey % 4 = 0 THEN 'count' WHEN o_custkey % 5 + o_custkey % 3 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'types' END AS error FROM orders""")
def quiz_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "many").otherwise((F.col("o_custkey") % 5).cast("string")).alias("easy"), (F.col("o_custkey") % 3).cast("string").alias("medium"), F.lit(None).cast("string").alias("hard"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("riddle"))).otherwise(F.array(F.lit(" essay "), F.lit("riddle"))).alias("types"))
    return W.requested_counts(r).select("id", "easy", "medium", "total", "error")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), s AS (SELECT *, l_linenumber % 2 = 0 AS free, CASE WHEN l_orderkey % 3 = 0 THEN 1.0 END AS awarded FROM a), g AS (SELECT l_orderkey, l_linenumber, arg_min(l_quantity, (l_partkey * 1000 + l_suppkey) * 100 + l_quantity) AS p FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, free AND awarded IS NULL AS waited, coalesce(awarded, CASE WHEN free THEN p END) AS awarded FROM s LEFT JOIN g USING (l_orderkey, l_linenumber)""")
def grading_queue(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    li = table(spark, sf_dir, "lineitem")
    a = li.select(*keys).distinct().select(*keys, (F.col("l_linenumber") % 2 == 0).alias("free"), F.when(F.col("l_orderkey") % 3 == 0, 1.0).alias("awarded"))
    waiting, after = W.to_grade(a, li.where("l_orderkey % 2 = 0").select(*keys, F.col("l_quantity").alias("points"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")).alias("at")), keys)
    return after.join(waiting.select(*keys, F.lit(True).alias("w")), keys, "left").select(*keys, F.col("w").isNotNull().alias("waited"), "awarded")


@query("""WITH p AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey AS id, bool_and(l_suppkey % 7 > 0) AS ok, count(DISTINCT l_suppkey) AS n, bool_and(l_partkey % 50 > 0 OR l_linenumber <> 1) AS own FROM lineitem GROUP BY 1) SELECT id, ok AND n <= 8 AND own AS valid FROM g""")
def study_scopes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("/", "l_suppkey", "l_partkey", "l_linenumber")
    wanted = F.when((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 50 == 0), F.concat(F.lit("x"), key)).otherwise(key)
    r = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("docs"), F.collect_list(wanted).alias("chunk_ids"))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 7 > 0).alias("ready"), F.col("s_name").alias("title"))
    return W.scopes(r, d, li.select(key.alias("chunk_id"), F.col("l_suppkey").alias("doc_id")).distinct()).select("id", "valid")


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS attempt, l_linenumber AS question FROM lineitem), c AS (SELECT l_orderkey AS attempt, l_linenumber AS question, arg_max(l_returnflag, (l_partkey * 1000 + l_suppkey) * 100 + l_quantity) AS given FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber < 6 GROUP BY 1, 2)
SELECT attempt, question, coalesce(c.given, 'old') AS given, CASE WHEN c.given IS NULL THEN 1.0::DOUBLE END AS awarded FROM q LEFT JOIN c USING (attempt, question)""")
def saved_answers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("question"), F.col("l_returnflag").alias("given"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")).alias("at"))
    old = li.select("attempt", "question").distinct().select("attempt", "question", F.lit("old").alias("given"), F.lit(1.0).alias("awarded"))
    quiz = li.select("attempt", F.lit(1).alias("quiz")).distinct()
    return W.saved_answers(old, li.where("attempt % 2 = 0"), spark.range(1, 6).select(F.lit(1).alias("quiz"), F.col("id").cast("int").alias("question")), quiz)


@query("""SELECT conv_id, turn, length(trim(coalesce(text, ''))) BETWEEN 1 AND 400 AND conv_id % 6 <> 5 AS valid, CASE WHEN length(trim(coalesce(text, ''))) > 40 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 40) || '…' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS title FROM conversations""")
def sendable_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"), "text", F.array(F.col("conv_id") % 6, F.lit(0).cast("long")).alias("docs"))
    return W.sendable(c, spark.range(0, 5).withColumnRenamed("id", "doc_id"), 400).select("id.*", "valid", "title")


@query("""WITH e AS (SELECT user_id AS conv, event_id AS a, event_type AS t, CAST(props->>'k' AS BIGINT) AS k FROM events) SELECT conv, coalesce(arg_max(t, a) FILTER (t IN ('click', 'error')), 'ACTIVE') AS status, max(a) AS changed, coalesce(array_to_string(list_sort(list_distinct(arg_max([k, k % 5, k], a) FILTER (t = 'view'))), ','), '') AS sources FROM e GROUP BY 1""")
def conversation_states(spark, sf_dir):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("at"), F.when(t.isin("click", "error"), "status").when(t == "view", "sources").otherwise("other").alias("kind"), t.alias("value"), F.array(k, k % 5, k).alias("sources"))
    return W.conversation_states(e).select("conv", "status", "changed", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("""SELECT p_partkey AS memory, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'SUPERSEDED' WHEN p_size % 2 = 0 THEN 'ACTIVE' ELSE 'EXPIRED' END AS status, greatest(TIMESTAMP '1995-06-01', (SELECT max(l_shipdate) FROM lineitem WHERE l_partkey = p_partkey)) AS used FROM part""")
def superseded_memories(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("memory"), F.when(F.col("p_size") % 2 == 0, "ACTIVE").otherwise("EXPIRED").alias("status"), F.lit("1995-06-01").cast("timestamp").alias("used"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("memory"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return W.superseded(p, p.where("memory % 3 = 0"), t)


@query("""WITH m AS (SELECT conv_id, turn, greatest(1, (length(coalesce(text, '')) + 3) // 4) AS tokens FROM conversations), w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS a, row_number() OVER x AS n, sum(tokens) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m WINDOW x AS (PARTITION BY conv_id ORDER BY turn DESC)),
e AS (SELECT * FROM w WHERE a > 500 AND NOT (s <= 200 OR n = 1)), o AS (SELECT DISTINCT conv_id, 2 AS version, 0::BIGINT AS through FROM conversations WHERE conv_id % 2 = 0), g AS (SELECT e.conv_id, max(turn) AS t, count(*) AS evicted FROM e LEFT JOIN o USING (conv_id) WHERE turn > coalesce(through, -1) GROUP BY 1)
SELECT coalesce(o.conv_id, g.conv_id) AS conv_id, coalesce(version, 0) + CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END AS version, coalesce(t, through) AS through, coalesce(evicted, 0) AS evicted FROM o FULL JOIN g ON o.conv_id = g.conv_id""")
def compression_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.where("conv_id % 2 = 0").select("conv_id", F.lit(2).alias("version"), F.lit(0).cast("long").alias("through")).distinct()
    return W.compression_step(M.water_marks(c, 500, 200), s)


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS text, floor(list_sum(list_transform(embedding, lambda x: CAST(printf('%.6f', x::DOUBLE) AS DOUBLE))) * 1e5 + 0.5) / 1e5 AS total FROM embeddings")
def vector_texts(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", W.vector_text(F.col("embedding")).alias("text"))
    total = F.aggregate(W.parsed_vector(F.col("text")), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", "text", T.half_up(total, 5).alias("total"))


@query("""WITH l AS (SELECT user_id AS task, arg_max(event_type, ts) AS k, max(ts) AS updated FROM events GROUP BY 1) SELECT c_custkey AS task, CASE k WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status, CASE k WHEN 'purchase' THEN 100 WHEN 'click' THEN 10 ELSE 0 END AS progress, CASE WHEN k = 'error' THEN repeat('m', 20) END AS message, updated FROM customer LEFT JOIN l ON task = c_custkey""")
def task_states(spark, sf_dir):
    k = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("ts").alias("at"), F.when(k == "click", "start").when(k == "purchase", "done").when(k == "error", "error").otherwise("seen").alias("kind"), F.repeat(F.lit("m"), 99).alias("message"))
    return W.task_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")), e, 20)


@query("""WITH s AS (SELECT conv_id AS run, CAST(turn AS BIGINT) AS step, role AS tool, CASE WHEN length(text) > 12 THEN substr(text, 1, 12) || '…' ELSE text END AS o FROM conversations) SELECT run, count(*) AS steps, string_agg(step || ' ' || tool || ' ' || coalesce(o, ''), chr(10) ORDER BY step, tool, o) AS trace FROM s GROUP BY 1""")
def agent_traces(spark, sf_dir):
    t = W.trace_steps(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.col("role").alias("tool"), F.col("text").alias("observation")), 12)
    steps = F.from_json("trace", "array<struct<step:bigint,tool:string,observation:string>>")
    return t.select("run", "steps", F.array_join(F.transform(steps, lambda x: F.concat(x["step"].cast("string"), F.lit(" "), x["tool"], F.lit(" "), F.coalesce(x["observation"], F.lit("")))), "\n").alias("trace"))


@query("""WITH e AS (SELECT event_id AS id, event_type IN ('error', 'view') AND user_id % 5 + 1 < 4 AS again, user_id % 5 + 1 AS attempt FROM events) SELECT id, again, CASE WHEN again THEN least(30.0::DOUBLE, pow(2.0::DOUBLE, attempt - 1)) END AS seconds FROM e""")
def retry_plans(spark, sf_dir):
    k = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(k == "error", "HTTP 503 from server").when(k == "view", "Read TIMED OUT").otherwise("bad request").alias("message"), (F.col("user_id") % 5 + 1).alias("attempt"))
    return W.retry_plan(e)


@query(f"""WITH {CHUNKS} SELECT doc_id, md5(string_agg('[source ' || chunk_index || ' | ' || CASE WHEN chunk_index % 3 = 0 THEN 'untitled' ELSE 's' END || ' | page ' || CASE WHEN chunk_index % 4 = 0 THEN '?' ELSE CAST(chunk_index // 5 AS VARCHAR) END || ']' || chr(10) || trim(content), chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM c GROUP BY 1""")
def source_texts(spark, sf_dir):
    i = F.col("chunk_index").cast("long")
    c = chunks(spark, sf_dir).select("doc_id", i.alias("index"), F.when(i % 3 != 0, "s").alias("title"), F.when(i % 4 != 0, F.floor(i / 5)).alias("page"), "content")
    return W.source_text(c, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT p_partkey AS id, '1. ' || p_name || chr(10) || '2. ' || p_type AS tasks, p_size % 2 = 0 AS valid FROM part")
def chosen_actions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("tasks"), F.array(F.lit("read"), F.lit("solve")).alias("candidates"), F.when(F.col("p_size") % 2 == 0, "solve").otherwise("sleep").alias("recommended"))
    return W.chosen_actions(p)


@query("SELECT o_orderkey AS artifact, o_custkey || ',' || o_orderkey % 9 AS docs, CAST(o_orderkey % 20 AS INT) AS n FROM orders WHERE o_orderkey % 4 = 1 AND o_orderstatus IN ('F', 'P')")
def retried_artifacts(spark, sf_dir):
    s = F.col("o_orderstatus")
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.when(s == "F", "FAILED").when(s == "P", "PARTIAL").otherwise("READY").alias("status"), F.concat(F.lit('{"docs": ['), F.col("o_custkey").cast("string"), F.lit(", "), (F.col("o_orderkey") % 9).cast("string"), F.lit('], "n": '), (F.col("o_orderkey") % 20).cast("string"), F.lit("}")).alias("scope"))
    r = W.retried(a, a.where("artifact % 4 = 1"))
    return r.select("artifact", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"), "n")


TREE = "p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 3 END AS parent"


@query(f"""WITH RECURSIVE n AS (SELECT {TREE} FROM part), mv AS (SELECT p_partkey AS node, p_partkey * 7 % 500 AS target FROM part WHERE p_partkey BETWEEN 2 AND 300), u AS (SELECT node, target, target AS place FROM mv UNION ALL SELECT u.node, u.target, n.parent FROM u JOIN n ON n.node = u.place WHERE n.parent IS NOT NULL AND u.place <> u.node)
SELECT mv.node, mv.target, NOT EXISTS (SELECT 1 FROM u WHERE u.node = mv.node AND u.target = mv.target AND u.place = mv.node) AS allowed FROM mv""")
def checked_moves(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return W.moves_checked(nodes, p.where("p_partkey BETWEEN 2 AND 300").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7 % 500).alias("target")))


@query("SELECT o_orderkey AS note, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS folder FROM orders")
def unfiled_notes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("node"))
    return W.unfiled(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.col("o_custkey").alias("folder")), c)


@query("""WITH s AS (SELECT o_custkey AS card, CASE WHEN o_custkey % 6 = 0 THEN 'SUSPENDED' ELSE 'REVIEW' END AS status, max(o_orderdate) AS due FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1, 2) SELECT c_custkey AS card, due FROM customer LEFT JOIN s ON card = c_custkey WHERE due IS NULL OR (due <= TIMESTAMP '2000-06-01' AND status <> 'SUSPENDED')""")
def due_cards(spark, sf_dir):
    s = table(spark, sf_dir, "orders").where("o_custkey % 5 > 0").groupBy(F.col("o_custkey").alias("card")).agg(F.max("o_orderdate").alias("due")).withColumn("status", F.when(F.col("card") % 6 == 0, "SUSPENDED").otherwise("REVIEW"))
    return W.missing_or_due(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card")), s, "2000-06-01 00:00:00")


@query("""WITH t AS (SELECT o_orderkey AS task_id, CAST(o_orderkey % 3 AS INT) AS priority, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders), p AS (SELECT task_id, priority, CAST(CASE priority WHEN 0 THEN r // 3 * 8 + [0, 2, 4][CAST(r % 3 AS INT) + 1] WHEN 1 THEN r // 3 * 8 + [1, 3, 6][CAST(r % 3 AS INT) + 1] ELSE r // 2 * 8 + [5, 7][CAST(r % 2 AS INT) + 1] END AS BIGINT) AS position FROM t)
SELECT * FROM p WHERE priority IN (0, 1) AND task_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 7) ORDER BY position, task_id LIMIT 100 - (SELECT count(*) FROM orders WHERE o_orderkey % 500 = 7)""")
def claimed_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), F.col("o_orderdate").alias("enqueued"))
    return W.claimed(M.round_robin(o), o.where("task_id % 500 = 7"), [0, 1], 100)


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS run, l_suppkey AS task FROM lineitem), f AS (SELECT s_suppkey AS task, CASE WHEN s_suppkey % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM supplier WHERE s_suppkey % 3 < 2) SELECT run, count(*) FILTER (status = 'FAILED') AS failed FROM w LEFT JOIN f USING (task) GROUP BY 1 HAVING bool_and(status IS NOT NULL)""")
def resumed_waiters(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("task"), F.when(F.col("s_suppkey") % 9 == 0, "FAILED").otherwise("COMPLETED").alias("status"))
    return W.resumed_waiters(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("task")), f)


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN 'New conversation' WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS title FROM t""")
def abbreviated_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.abbreviated(F.col("text")).alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '# A' || chr(10) || p_name || chr(10) || '## B' || chr(10) || 'new ' || p_brand || chr(10) || '# C' || chr(10) || 'end' WHEN 1 THEN '# A' || chr(10) || p_name || chr(10) || '## B' || chr(10) || 'new ' || p_brand ELSE '# A' || chr(10) || p_name || chr(10) || '## B' || chr(10) || 'old' END AS text FROM part""")
def edited_sections(spark, sf_dir):
    i, lf = F.col("p_partkey") % 3, F.lit("\n")
    text = F.concat(F.lit("# A"), lf, F.col("p_name"), lf, F.lit("## B\nold"), F.when(i == 0, "\n### sub\nmore\n# C\nend").otherwise(""))
    digest = F.when(i == 2, "stale").otherwise(F.sha2(text, 256))
    return table(spark, sf_dir, "part").select("p_partkey", W.edited_section(text, "## B", F.concat(F.lit("new "), F.col("p_brand")), digest).alias("text"))


@query("SELECT item_id AS query_id, CASE WHEN length(text) % 3 > 0 THEN 'An answer to: ' || substr(text, 1, 30) END AS supposed, CASE WHEN length(text) % 3 = 0 THEN 'model is away' END AS error FROM benchmark")
def supposed_answers(spark, sf_dir):
    def stub(q: str) -> str:
        if len(q) % 3 == 0:
            raise RuntimeError("model is away")
        return f"An answer to: {q[:30]}"

    return W.expanded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), stub)


@query("""WITH s AS (SELECT o_orderkey AS id, o_totalprice / 400000 AS confidence, o_orderdate AS last, o_orderstatus <> 'P' AS active FROM orders), g AS (SELECT *, active AND confidence < 0.25 AND last < TIMESTAMP '1998-01-01' - INTERVAL 45 DAY AS gone FROM s) SELECT id, active AND NOT gone AS active, CASE WHEN gone THEN 'expired' END AS reason FROM g""")
def scheduled_expiry(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 400000).alias("confidence"), F.col("o_orderdate").alias("last"), (F.col("o_orderstatus") != "P").alias("active"))
    after, log = W.expiry(s, "1998-01-01 00:00:00", 45)
    return after.join(log.select("id", "reason"), "id", "left").select("id", "active", "reason")
