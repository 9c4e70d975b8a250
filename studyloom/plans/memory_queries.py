"""Registered queries of retrieval steps, conversation memory, tasks and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..operators import memory as M
from ..operators import retrieval as R
from ..sources import upsert as U
from ..sources.texts import page_lines
from .queries import FUSED, TOK, WS, _fused
from .registry import CHUNKS, chunks, query, table

SIGNAL_SQL = " || ".join(f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', {g})" for p, g in R.SIGNALS)
STOPS = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
VAGUE = ", ".join(f"'{w}'" for w in R.VAGUE)


@query(f"""WITH s AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(list_transform({SIGNAL_SQL}, lambda x: trim(x)), lambda x: length(x) >= 2))) AS s, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOPS}))) AS t, trim(lower(text)) AS q FROM documents)
SELECT doc_id, array_to_string(s, ' | ') AS signals, len(t) AS terms, CASE WHEN q = '' THEN FALSE ELSE len(regexp_split_to_array(q, '\\s+')) <= 3 OR length(q) <= 18 OR (len(regexp_split_to_array(q, '\\s+')) <= 8 AND len(list_filter(regexp_split_to_array(q, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({VAGUE}))) <= 2) END AS expand FROM s""")
def query_analysis(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(R.query_signals(t)), " | ").alias("signals"), F.size(R.query_terms(t)).cast("long").alias("terms"), R.needs_expansion(t).alias("expand"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'AI_NOTE' ELSE 'PDF' END AS domain, o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'READY' ELSE 'OPEN' END AS status, o_orderkey % 7 AS version FROM orders), k AS (SELECT * FROM r WHERE status = 'READY' AND doc_id % 2 = 0)
SELECT id, domain FROM k WHERE domain = 'PDF' UNION ALL SELECT id, domain FROM k WHERE domain = 'AI_NOTE' AND version = (SELECT max(version) FROM k x WHERE x.domain = 'AI_NOTE' AND x.doc_id = k.doc_id)""")
def scope_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "AI_NOTE").otherwise("PDF").alias("domain"), F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("OPEN").alias("status"), (F.col("o_orderkey") % 7).alias("version"))
    chosen = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"))
    return R.in_scope(r, chosen, chosen).select("id", "domain")


@query(f"""WITH {CHUNKS}, e AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'DOCUMENT_CHUNK' WHEN vec_id % 3 = 1 THEN 'AI_NOTE_SECTION' ELSE 'NOTE' END AS type, CASE WHEN vec_id % 2 = 0 THEN '{{"text": "stored ' || vec_id || '"}}' ELSE '{{}}' END AS metadata FROM embeddings)
SELECT e.id, e.type, coalesce(c.content, s.text, metadata->>'text', '') AS content FROM e LEFT JOIN c ON e.type = 'DOCUMENT_CHUNK' AND c.chunk_index = 0 AND c.doc_id = e.id LEFT JOIN benchmark s ON e.type = 'AI_NOTE_SECTION' AND s.item_id = e.id""")
def candidate_contents(spark, sf_dir):
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(i.alias("id"), F.when(i % 3 == 0, "DOCUMENT_CHUNK").when(i % 3 == 1, "AI_NOTE_SECTION").otherwise("NOTE").alias("type"), F.when(i % 2 == 0, F.concat(F.lit('{"text": "stored '), i.cast("string"), F.lit('"}'))).otherwise("{}").alias("metadata"))
    c = chunks(spark, sf_dir).where("chunk_index = 0").select(F.col("doc_id").alias("id"), "content")
    return R.with_contents(e, c, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))).select("id", "type", "content")


@query("SELECT user_id, event_type, max(value) AS score FROM events GROUP BY 1, 2")
def best_of_source(spark, sf_dir):
    return R.best_of_source(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").alias("score")), ["user_id", "event_type"]).select("user_id", "event_type", "score")


COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, {COS.format('q', 'embedding')} AS score FROM q, embeddings), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 30),
b AS (SELECT query_id, id, score FROM r UNION ALL SELECT (query_id + 100) % 500, id, score * 0.9::DOUBLE FROM r), g AS (SELECT query_id, id, floor(max(score) * 1e6 + 0.5) / 1e6 AS score FROM b GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g) SELECT * FROM z WHERE rank <= 30""")
def hypothetical_merge(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = R.vector_recall(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return R.merge_hypothetical(hits, hits.withColumn("query_id", (F.col("query_id") + 100) % 500))


@query("""WITH RECURSIVE i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, 1 + CAST(floor(value) AS BIGINT) AS t FROM events), b AS (SELECT user_id, rank, 1::BIGINT AS n, t AS total, TRUE AS taken, t FROM i WHERE rank = 1
 UNION ALL SELECT user_id, rank, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN total + t ELSE total END, ok, t FROM (SELECT i.user_id, i.rank, b.n, b.total, i.t, b.n < 8 AND (b.n = 0 OR b.total + i.t <= 280) AS ok FROM b JOIN i ON i.user_id = b.user_id AND i.rank = b.rank + 1)) SELECT user_id, rank, n - 1 AS position, t AS tokens FROM b WHERE taken""")
def evidence_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = R.top(e, ["user_id"], [F.col("ts"), F.col("event_id")], 1 << 30)
    return folds.within_budget(r, ["user_id"], 1 + F.floor("value"), 8, 280)


@query("""SELECT doc_id FROM documents WHERE (n_chars % 10 / 10 >= 0.25 OR doc_id % 50 = 1 OR doc_id % 10 / 10 >= 0.48) AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 20
AND NOT regexp_matches(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'completely blank|no visible text|no discernible content|image region is blank|the page is blank')""")
def quality_filtered(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.quality_filter(d.select("doc_id", "text", (F.col("n_chars") % 10 / 10).alias("exact"), F.when(F.col("doc_id") % 50 == 1, 0.5).alias("lexical"), (F.col("doc_id") % 10 / 10).alias("vector"))).select("doc_id")


@query(f"""WITH RECURSIVE {CHUNKS}, t AS (SELECT doc_id, chunk_index AS i, list_sort(list_distinct({TOK.format('content')})) AS s FROM c), g AS (SELECT doc_id, i, TRUE AS kept, [s] AS k FROM t WHERE i = 0
 UNION ALL SELECT doc_id, i, kept, CASE WHEN kept THEN list_append(k, s) ELSE k END FROM (SELECT t.doc_id, t.i, t.s, g.k, len(list_filter(g.k, lambda x: x = t.s OR (len(t.s) + len(x) > 0 AND len(list_intersect(x, t.s)) >= 0.88::DOUBLE * (len(x) + len(t.s) - len(list_intersect(x, t.s)))))) = 0 AS kept FROM g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i + 1))
SELECT doc_id, i AS position FROM g WHERE kept""")
def greedy_distinct(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return folds.greedy_distinct(c.select("doc_id", F.col("chunk_index").alias("position"), T.tokens(F.col("content")).alias("tokens")), "doc_id")


RANKED = f"{FUSED}, rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, evidence DESC, id) AS rank FROM f)"


@query(f"""WITH {RANKED}, w AS (SELECT *, count(*) OVER p AS n, min(rank) FILTER (id % 7 = 3) OVER p AS fst FROM rk WINDOW p AS (PARTITION BY query_id)), o AS (SELECT *, least(3, n) + 1 AS goal FROM w)
SELECT query_id, id, CAST(CASE WHEN fst IS NULL OR fst <= 5 OR fst < least(goal, 5) THEN rank WHEN rank = fst THEN least(goal, 5) WHEN rank >= least(goal, 5) AND rank < fst THEN rank + 1 ELSE rank END AS INT) AS rank FROM o""")
def domain_guarantee(spark, sf_dir):
    return R.ensure_domain(_fused(spark, sf_dir).select("query_id", "id", "rank"), ["query_id"], F.col("id") % 7 == 3, 5)


@query(f"""WITH {RANKED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 12 THEN 0 ELSE 1 END, CASE WHEN rank <= 12 AND id % 3 <> 0 THEN id % 11 END DESC NULLS LAST, rank) AS rank FROM rk""")
def external_rerank(spark, sf_dir):
    ranked = _fused(spark, sf_dir).select("query_id", "id", "rank")
    return R.apply_scores(ranked, ranked.where("id % 3 <> 0").select("query_id", "id", (F.col("id") % 11).alias("model_score")), ["query_id"]).select("query_id", "id", "rank")


@query(None)
def context_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return folds.context_items(_fused(spark, sf_dir).where("rank <= 12").select("query_id", "id", "rank").join(d, "id").withColumn("sources", F.array("id")), ["query_id"])


@query(f"""WITH e AS (SELECT vec_id AS id, label, embedding AS v, (vec_id % 10) / 10 AS confidence, vec_id % 37 AS digest FROM embeddings), ca AS (SELECT * FROM e WHERE id % 20 = 0), me AS (SELECT * FROM e WHERE id % 20 <> 0),
j AS (SELECT ca.label, ca.id, ca.confidence, me.id AS memory, me.confidence AS c, me.digest = ca.digest AS eq, {COS.format('ca.v', 'me.v')} AS s FROM ca LEFT JOIN me ON me.label = ca.label),
g AS (SELECT label, id, any_value(confidence) AS confidence, min(memory) FILTER (eq) AS equal, arg_max(memory, (s, -memory)) FILTER (s > 0) AS memory, arg_max(c, (s, -memory)) FILTER (s > 0) AS c, coalesce(max(s) FILTER (s > 0), 0) AS s FROM j GROUP BY 1, 2)
SELECT label, id, CASE WHEN equal IS NOT NULL THEN 'SKIP' WHEN s >= 0.3 THEN CASE WHEN confidence > c THEN 'UPDATE' ELSE 'SKIP' END WHEN s >= 0.2 THEN 'UPDATE' ELSE 'ADD' END AS decision, CASE WHEN equal IS NOT NULL THEN equal WHEN s >= 0.2 THEN memory END AS memory, CASE WHEN equal IS NOT NULL THEN 1.0 ELSE s END AS similarity FROM g""")
def consolidation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), (F.col("vec_id") % 10 / 10).alias("confidence"), (F.col("vec_id") % 37).alias("digest"))
    return M.consolidate(e.where("id % 20 = 0"), e.where("id % 20 <> 0"), ["label"], 0.3, 0.2)


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, (vec_id % 10) / 10 AS confidence, vec_id % 997 AS digest FROM embeddings), ca AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY -id) AS k FROM e WHERE id % 3 = 0),
o AS (SELECT label, list({'id': id, 'v': v, 'c': confidence, 'd': digest} ORDER BY id) FILTER (id % 3 <> 0) AS m FROM e GROUP BY 1),
s AS (SELECT label, 0::BIGINT AS k, coalesce(m, []) AS m, NULL::BIGINT AS id, NULL::VARCHAR AS decision, NULL::BIGINT AS memory, NULL::DOUBLE AS similarity FROM o
 UNION ALL SELECT label, k, CASE decision WHEN 'SKIP' THEN m WHEN 'ADD' THEN list_append(m, me) ELSE list_append(list_filter(m, lambda x: x.id <> memory), me) END, id, decision, memory, similarity FROM (
  SELECT *, CASE WHEN eq IS NOT NULL THEN 'SKIP' WHEN best >= 0.9 THEN CASE WHEN confidence > m[pos].c THEN 'UPDATE' ELSE 'SKIP' END WHEN best >= 0.78 THEN 'UPDATE' ELSE 'ADD' END AS decision,
   CASE WHEN eq IS NOT NULL THEN m[eq].id WHEN best >= 0.78 THEN m[pos].id END AS memory, CASE WHEN eq IS NOT NULL THEN 1.0::DOUBLE WHEN best >= 0.78 THEN best END AS similarity FROM (
   SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pos FROM (
    SELECT s.label, ca.k, s.m, ca.id, ca.confidence, {'id': ca.id, 'v': ca.v, 'c': ca.confidence, 'd': ca.digest} AS me, list_position(list_transform(s.m, lambda x: x.d), ca.digest) AS eq, list_transform(s.m, lambda x: round(list_cosine_similarity(x.v, ca.v), 6)) AS sims
    FROM s JOIN ca ON ca.label = s.label AND ca.k = s.k + 1)))) SELECT label, id, decision, memory, similarity FROM s WHERE k > 0""")
def sequential_consolidation(spark, sf_dir):
    """A third of all vectors come as candidates, the last first, each meeting what the ones before have left."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), (F.col("vec_id") % 10 / 10).alias("confidence"), (F.col("vec_id") % 997).alias("digest"))
    return folds.consolidated(e.where("id % 3 = 0").withColumn("place", -F.col("id")), e.where("id % 3 <> 0"), ["label"])


@query("""WITH m AS (SELECT conv_id, turn, greatest(1, (length(coalesce(text, '')) + 3) // 4) AS t, CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 ELSE -1 END AS c, CASE WHEN conv_id % 3 > 0 THEN conv_id % 5 ELSE -1 END AS x FROM conversations),
g AS (SELECT conv_id, CAST(sum(CASE WHEN turn > c THEN t ELSE 0 END) AS BIGINT) AS uncovered, CAST(sum(CASE WHEN turn > x THEN t ELSE 0 END) AS BIGINT) AS unextracted FROM m GROUP BY 1) SELECT *, uncovered > 3200 OR unextracted >= 120 AS due FROM g""")
def maintenance_backlog(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return M.backlog(c, c.where("conv_id % 3 > 0").select("conv_id", (F.col("conv_id") % 3).alias("covered"), (F.col("conv_id") % 5).alias("extracted")).distinct())


@query("""WITH f AS (SELECT l_orderkey, l_suppkey AS source, min((l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, source, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, source) AS index FROM f""")
def merged_evidence(spark, sf_dir):
    return M.merge_evidence(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("call"), F.col("l_partkey").alias("place")), ["l_orderkey"])


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS asked, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END) AS transcript FROM conversations GROUP BY 1""")
def conversation_transcript(spark, sf_dir):
    t = M.transcript(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "asked", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["text"], F.lit("")))), "\n").alias("transcript"))


TASKS = "t AS (SELECT o_orderkey AS task_id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'PROCESSING' WHEN 'O' THEN 'PENDING' ELSE 'COMPLETED' END AS status, o_orderdate AS created, o_orderkey % 4 AS retried FROM orders)"


def _tasks(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("owner"), F.when(s == "F", "PROCESSING").when(s == "O", "PENDING").otherwise("COMPLETED").alias("status"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 4).alias("retried"))


@query(f"WITH {TASKS}, x AS (SELECT *, status = 'PROCESSING' AND created < TIMESTAMP '1996-06-01' - INTERVAL 30 MINUTE AS late FROM t) SELECT task_id, CASE WHEN late AND retried < 3 THEN 'RETRYING' WHEN late THEN 'FAILED' ELSE status END AS status, CASE WHEN late AND retried < 3 THEN retried + 1 ELSE retried END AS retried FROM x")
def stale_tasks(spark, sf_dir):
    return M.stale_tasks(_tasks(spark, sf_dir).withColumnRenamed("created", "updated"), "1996-06-01 00:00:00", 30, 3).select("task_id", "status", "retried")


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created DESC, task_id DESC) AS n FROM t) SELECT task_id, owner FROM r WHERE status = 'PROCESSING' OR n <= 4")
def active_or_recent(spark, sf_dir):
    return M.active_or_recent(_tasks(spark, sf_dir).withColumn("active", F.col("status") == "PROCESSING"), ["owner"], 4).select("task_id", "owner")


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY (retried = 3) DESC, created, task_id) AS place FROM t) SELECT task_id, owner, place FROM r WHERE retried = 3 OR place <= 5")
def tiered_selection(spark, sf_dir):
    return M.tiered(_tasks(spark, sf_dir), ["owner"], F.col("retried") == 3, [F.col("created"), F.col("task_id")], 5).select("task_id", "owner", "place")


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey) AS d FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY d, l_linenumber) AS place FROM d) SELECT l_suppkey, l_linenumber, l_orderkey, place FROM p WHERE place <= 20")
def depth_first_pages(spark, sf_dir):
    return M.by_depth(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", [F.col("l_orderkey"), F.col("l_partkey")], 20).select("l_suppkey", "l_linenumber", "l_orderkey", "place")


@query("SELECT event_id, CASE WHEN event_type IN ('click') THEN 0 WHEN event_type IN ('error', 'view') THEN 2 ELSE 1 END AS priority FROM events")
def task_priority(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.task_priority(F.col("event_type"), ["click"], ["error", "view"]).alias("priority"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return U.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def orphaned_files(spark, sf_dir):
    return U.orphans(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def listing_page(spark, sf_dir):
    return U.page_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 100, 50)


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents")
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", page_lines().alias("text"))


@query(f"""WITH {CHUNKS}, a AS (SELECT *, CASE WHEN chunk_index // 4 % 3 = 2 THEN NULL ELSE chunk_index // 4 END AS s, CASE WHEN chunk_index % 5 = 0 THEN NULL ELSE chunk_index * 2 // 3 END AS p, CASE WHEN {WS} = '' THEN 0 ELSE CAST(greatest(ceil(length(content) / 4), ceil(len(string_split({WS}, ' ')) * 13 / 10)) AS BIGINT) END AS t FROM c),
l AS (SELECT *, coalesce(lag(s) OVER w = s AND coalesce(abs(lag(p) OVER w - p) <= 1, TRUE), FALSE) AND t + lag(t) OVER w <= 60 AS b, coalesce(lead(s) OVER w = s AND coalesce(abs(lead(p) OVER w - p) <= 1, TRUE), FALSE) AS n, lag(t) OVER w AS tb, lead(t) OVER w AS ta, lag(content) OVER w AS cb, lead(content) OVER w AS ca FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT doc_id, chunk_index, length(concat_ws(chr(10) || chr(10), CASE WHEN b THEN cb END, content, CASE WHEN n AND t + CASE WHEN b THEN tb ELSE 0 END + ta <= 60 THEN ca END)) AS chars FROM l""")
def section_neighbours(spark, sf_dir):
    c, i = chunks(spark, sf_dir), F.col("chunk_index")
    q = F.floor(i / 4)
    section = F.when(q % 3 == 2, F.concat(F.lit("Chunk "), q.cast("string"))).otherwise(F.concat(F.lit("Part  "), q.cast("string")))
    c = c.withColumns({"section": section, "page": F.when(i % 5 != 0, F.floor(i * 2 / 3))})
    return R.section_neighbours(c, 60).select("doc_id", i.cast("long").alias("chunk_index"), F.length("context").cast("long").alias("chars"))
