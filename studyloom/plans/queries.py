"""Registered queries: each operator applied to whole test tables, next to equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learning as L
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import text_index, vector_index
from ..sources import upsert as U
from ..sources.shared import stored
from .registry import CHUNKS, FOUND, chunks, query, table

WS = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query(f"""WITH {CHUNKS}, t AS (SELECT *, {WS} AS x FROM c), u AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS w FROM t)
SELECT doc_id, chunk_index, CAST(CASE WHEN x = '' THEN 0 ELSE greatest(ceil(length(content) / 4), ceil(w * 13 / 10)) END AS BIGINT) AS retrieval,
 CAST(greatest(floor(w * 13 / 10), 1, length(content) // 4) AS BIGINT) AS document, CAST(greatest(1, (length(content) + 3) // 4) AS BIGINT) AS message FROM u""")
def token_estimates(spark, sf_dir):
    c = F.col("content")
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), T.tokens_retrieval(c).alias("retrieval"), T.tokens_document(c).alias("document"), T.tokens_message(c).alias("message"))


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, sha256(lower(x)) AS digest, left(x, 600) AS preview, length(regexp_replace(lower(x), '[0-9]+', '#', 'g')) AS fingerprint_chars FROM d""")
def text_digests(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(t).alias("digest"), T.preview(t).alias("preview"), F.length(T.number_fingerprint(t)).cast("long").alias("fingerprint_chars"))


@query("""SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0""")
def hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").where(T.sampled(F.col("event_id"))).select("event_id", "event_type")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 30""")
def vector_recall(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return R.vector_recall(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), v


@query(None)
def indexed_recall(spark, sf_dir):
    """Vector recall through the stored index, with the rank that each hit has in exact recall (null: none), which measures it."""
    q, v = _vectors(spark, sf_dir)
    build = lambda rows, path: vector_index.build(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    rows, book = vector_index.open_index(spark, stored("vector_index", table(spark, sf_dir, "embeddings"), build))
    exact = R.vector_recall(q, v).select("query_id", "id", F.col("rank").alias("exact_rank"))
    return vector_index.search(rows, book, q).join(exact, ["query_id", "id"], "left")


@query(None)
def half_precision_recall(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return R.vector_recall(q, vector_index.packed(v))


TOK = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')"
STOPS = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
LEXICAL = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOPS})))) AS term FROM benchmark),
t0 AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term, 1 AS a, 0 AS b FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 600)), '[\\p{{L}}\\p{{N}}_]{{2,}}')), 0, 1 FROM documents),
h AS (SELECT query_id, id, sum(a) + 0.4::DOUBLE * sum(b) AS x FROM t0 JOIN q USING (term) GROUP BY 1, 2), s AS (SELECT query_id, id, x / (1 + x) AS y FROM h), s2 AS (SELECT query_id, id, floor(y / (1 + y) * 1e6 + 0.5) / 1e6 AS score FROM s),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s2) WHERE rank <= 30)"""


def _index(spark, sf_dir):
    """The stored index of the documents' texts, built once an application."""
    build = lambda docs, path: text_index.build(docs.select(F.col("doc_id").alias("id"), "text"), path)
    return text_index.open_index(spark, stored("text_index", table(spark, sf_dir, "documents"), build))


def _lexical(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return text_index.search(_index(spark, sf_dir), q)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS a FROM w GROUP BY 1, 2)
SELECT term, count(*) AS n, CAST(sum(a) AS BIGINT) AS a, max(a) AS most FROM c GROUP BY 1""")
def stored_postings(spark, sf_dir):
    return text_index.statistics(_index(spark, sf_dir)[0])


@query(f"WITH {LEXICAL} SELECT query_id, id, score, rank FROM lex")
def lexical_recall(spark, sf_dir):
    return _lexical(spark, sf_dir)


NORM = "regexp_replace(translate(lower({0}), '[]{{}}', '()()'), '\\s+', '', 'g')"
EXACT = f"""sg0 AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 120))) AS signal FROM benchmark), sg AS (SELECT *, {NORM.format('signal')} AS sn FROM sg0), n AS (SELECT query_id, count(*) AS n FROM sg GROUP BY 1),
tx AS (SELECT doc_id AS id, source AS title, {NORM.format('text')} AS norm FROM documents),
p AS (SELECT query_id, id, CASE WHEN contains(title, signal) THEN 2.0 WHEN contains(norm, sn) THEN 1.5 END AS pts FROM tx, sg),
e0 AS (SELECT query_id, id, round(least(1.0, sum(pts) / (2 * any_value(n))), 6)::DOUBLE AS score FROM p JOIN n USING (query_id) WHERE pts IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM e0) WHERE rank <= 15)"""


def phrases(text):
    """Sentences of a whole text, of a quoted phrase's length."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[.!?\\n]+"), lambda x: F.trim(x)), lambda x: F.length(x).between(20, 120)))


def _exact(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(phrases(F.col("text"))).alias("signal"))
    return R.exact_recall(s, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"))


@query(f"WITH {EXACT} SELECT query_id, id, score, rank FROM ex")
def exact_recall(spark, sf_dir):
    return _exact(spark, sf_dir)


FUSED = f"""{LEXICAL}, {EXACT}, al AS (SELECT 'lexical' AS channel, query_id, id, score, rank FROM lex UNION ALL SELECT 'exact', query_id, id, score, rank FROM ex),
g AS (SELECT query_id, id, sum(CASE channel WHEN 'exact' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) AS raw, max(score) AS evidence, count(*) AS channels FROM al GROUP BY 1, 2),
f AS (SELECT query_id, id, evidence, channels, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS fused FROM g)"""


def _fused(spark, sf_dir):
    return R.fuse(_lexical(spark, sf_dir).withColumn("channel", F.lit("lexical")).unionByName(_exact(spark, sf_dir).withColumn("channel", F.lit("exact"))))


@query(f"WITH {FUSED} SELECT query_id, id, evidence, channels, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, evidence DESC, id) AS rank FROM f")
def weighted_rrf(spark, sf_dir):
    return _fused(spark, sf_dir)


COVER = "CASE WHEN len(q) > 0 THEN len(list_intersect(q, {0})) / len(q) ELSE 0.0 END"
RERANK_STOPS = ", ".join(f"'{w}'" for w in R.RERANK_STOP_WORDS)
TELLING = f"list_distinct(list_filter({TOK}, lambda w: length(w) > 1 AND w NOT IN ({RERANK_STOPS})))"


@query(f"""WITH {FUSED}, b AS (SELECT item_id AS query_id, {TELLING.format('text')} AS q FROM benchmark),
k AS (SELECT query_id, id, fused, channels, floor((0.65::DOUBLE * {COVER.format(TELLING.format("source"))} + 0.35::DOUBLE * {COVER.format(TELLING.format("text"))}) * 1e6 + 0.5) / 1e6 AS coverage FROM f JOIN b USING (query_id) JOIN documents d ON d.doc_id = f.id),
r AS (SELECT *, floor((0.75::DOUBLE * fused + 0.25::DOUBLE * coverage) * 1e6 + 0.5) / 1e6 AS combined FROM k), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS rank FROM r)
SELECT query_id, id, coverage, combined, rank FROM z WHERE rank <= 2 OR channels > 1 OR fused >= 0.45 OR coverage >= 0.2""")
def query_aware_rerank(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return R.rerank(_fused(spark, sf_dir).drop("rank"), q, d).select("query_id", "id", "coverage", "combined", "rank")


@query(f"""WITH {FUSED}, zz AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, evidence DESC, id) AS rank, lang = 'en' AS doc FROM f JOIN documents ON doc_id = id),
gg AS (SELECT query_id, arg_min(evidence, rank) AS first, bool_or(doc) AS doc, count(*) AS n FROM zz WHERE rank <= 8 GROUP BY 1)
SELECT query_id, CASE WHEN first >= 0.6 AND (doc OR n >= 2) THEN 'SUFFICIENT' WHEN first >= 0.52 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS grade, n AS items FROM gg""")
def evidence_grade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("is_document"))
    return R.grade(_fused(spark, sf_dir).where("rank <= 8").withColumn("score", F.col("evidence")).join(d, "id"))


@query(f"""WITH {CHUNKS} SELECT doc_id, chunk_index, length(concat_ws(chr(10) || chr(10), lag(content) OVER w, content, lead(content) OVER w)) AS chars FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def neighbour_context(spark, sf_dir):
    return R.neighbours(chunks(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("context").cast("long").alias("chars"))


@query(f"""WITH {CHUNKS}, h AS (SELECT doc_id, chunk_index FROM c WHERE contains(content, 'token')) SELECT DISTINCT c.doc_id, c.chunk_index, length(c.content) AS chars FROM c JOIN h ON c.doc_id = h.doc_id AND c.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2""")
def band_join(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return R.band_join(c, c.where(F.col("content").contains("token")).select("doc_id", "chunk_index"), 2).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"))


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_index, list_distinct({TOK.format('content')}) AS s FROM c), u AS (SELECT * FROM t WHERE len(s) > 0),
p AS (SELECT a.doc_id, a.chunk_index AS a, b.chunk_index AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.chunk_index < b.chunk_index) SELECT doc_id, a, b, round(i / (n - i), 6) AS similarity FROM p WHERE 100 * i >= 88 * (n - i)""")
def near_duplicate_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("position"), F.col("content").alias("text"))
    return R.near_pairs(c, "doc_id")


EVENT = """e AS (SELECT event_id, ts, user_id, CAST(props->>'k' AS INT) % 25 AS topic,
 CASE event_type WHEN 'purchase' THEN 'MASTERED' WHEN 'error' THEN 'CONFUSED' WHEN 'signup' THEN 'REVIEW' WHEN 'click' THEN 'ANSWER' ELSE 'OTHER' END AS kind,
 value >= 100 AS correct, event_id % 5 = 0 AS hint, ['AGAIN','HARD','GOOD','EASY'][CAST(event_id % 4 AS INT) + 1] AS grade, ['EASY','MEDIUM','HARD'][CAST(event_id % 3 AS INT) + 1] AS difficulty FROM events),
m AS (SELECT *, CASE difficulty WHEN 'EASY' THEN 0.75::DOUBLE WHEN 'HARD' THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS mult FROM e),
up AS (SELECT *, CASE kind WHEN 'MASTERED' THEN 0.2::DOUBLE WHEN 'CONFUSED' THEN -0.16::DOUBLE WHEN 'REVIEW' THEN CASE grade WHEN 'AGAIN' THEN -0.08::DOUBLE WHEN 'HARD' THEN 0.012 WHEN 'GOOD' THEN 0.035 ELSE 0.055 END
  WHEN 'ANSWER' THEN (CASE WHEN correct THEN 0.06::DOUBLE ELSE -0.1::DOUBLE END) * mult * (CASE WHEN hint AND correct THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.005::DOUBLE END AS delta,
 CASE kind WHEN 'MASTERED' THEN 2.0::DOUBLE WHEN 'CONFUSED' THEN 2.0::DOUBLE WHEN 'REVIEW' THEN CASE grade WHEN 'AGAIN' THEN 1.0::DOUBLE WHEN 'HARD' THEN 0.8 WHEN 'GOOD' THEN 1.0 ELSE 1.2 END
  WHEN 'ANSWER' THEN mult * (CASE WHEN hint THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.15::DOUBLE END AS weight FROM m)"""


def learning_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("event_id") % n).cast("int"))
    kind = F.col("event_type")
    kind = F.when(kind == "purchase", "MASTERED").when(kind == "error", "CONFUSED").when(kind == "signup", "REVIEW").when(kind == "click", "ANSWER").otherwise("OTHER")
    return L.updates(e.select("event_id", "ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 25).alias("topic"), kind.alias("kind"), (F.col("value") >= 100).alias("correct"), (F.col("event_id") % 5 == 0).alias("hint"),
        pick(4, "AGAIN", "HARD", "GOOD", "EASY").alias("grade"), pick(3, "EASY", "MEDIUM", "HARD").alias("difficulty")))


@query(f"WITH {EVENT} SELECT event_id, topic, round(delta, 6) AS delta, round(weight, 6) AS weight FROM up")
def event_updates(spark, sf_dir):
    return learning_events(spark, sf_dir).select("event_id", "topic", F.round("delta", 6).alias("delta"), F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE {EVENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS k FROM up),
s AS (SELECT user_id, topic, k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + delta)) AS mastery, CASE WHEN correct THEN 1 ELSE 0 END AS streak FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.topic, n.k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s.mastery + n.delta)), CASE WHEN n.correct THEN s.streak + 1 ELSE 0 END FROM s JOIN n ON n.user_id = s.user_id AND n.topic = s.topic AND n.k = s.k + 1)
SELECT user_id, topic, round(arg_max(mastery, k), 6) AS mastery, max(k) AS events, CAST(arg_max(streak, k) AS BIGINT) AS streak FROM s GROUP BY 1, 2""")
def topic_state_fold(spark, sf_dir):
    return L.fold_mastery(learning_events(spark, sf_dir), ["user_id", "topic"])


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(props->>'k' AS INT) ORDER BY ts, event_id) AS r FROM events),
k AS (SELECT user_id, event_type, CAST(props->>'k' AS INT) AS k FROM events WHERE ts < TIMESTAMP '2024-01-05') SELECT event_id, user_id, event_type, CAST(props->>'k' AS INT) AS k FROM e WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.k = CAST(e.props->>'k' AS INT))""")
def idempotent_ingest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return L.ingest(e, ["user_id", "event_type", "k"], e.where("ts < TIMESTAMP '2024-01-05'")).select("event_id", "user_id", "event_type", "k")


@query("""SELECT l_suppkey AS topic, round(sum(l_discount * 10 * greatest(l_quantity / 50, 0.1::DOUBLE)) / sum(greatest(l_quantity / 50, 0.1::DOUBLE)), 6) AS mastery, max(l_shipdate) AS last, sum(l_linenumber) AS attempts, bool_or(l_returnflag = 'R') AS review FROM lineitem GROUP BY 1""")
def weighted_mastery(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_suppkey").alias("topic"), (F.col("l_discount") * 10).alias("mastery"), (F.col("l_quantity") / 50).alias("weight"), F.col("l_shipdate").alias("last"), F.col("l_linenumber").alias("attempts"), (F.col("l_returnflag") == "R").alias("review"))
    return L.weighted_mastery(s, ["topic"])


REVIEW = "r AS (SELECT user_id AS card, ts, event_id, ['AGAIN','HARD','GOOD','EASY'][CAST(event_id % 4 AS INT) + 1] AS grade, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'signup')"


@query(f"""WITH RECURSIVE {REVIEW}, q AS (SELECT *, CASE grade WHEN 'AGAIN' THEN 1 WHEN 'HARD' THEN 3 WHEN 'GOOD' THEN 4 ELSE 5 END AS q FROM r),
s AS (SELECT card, 0::BIGINT AS k, 2.5::DOUBLE AS ease, 0 AS reps, 0.0::DOUBLE AS days FROM r WHERE k = 1
 UNION ALL SELECT card, k, round(e, 4), reps, CASE WHEN grade = 'AGAIN' THEN 1.0 ELSE greatest(1.0::DOUBLE, least(36500.0::DOUBLE, CASE grade WHEN 'HARD' THEN round_even(b * 0.8::DOUBLE, 0) WHEN 'EASY' THEN round_even(b * 1.3::DOUBLE, 0) ELSE b END)) END
  FROM (SELECT *, CASE WHEN reps = 1 THEN 1.0::DOUBLE WHEN reps = 2 THEN 6.0::DOUBLE ELSE round_even(days * e, 0) END AS b FROM (SELECT q.card, q.k, q.grade, s.days, greatest(1.3::DOUBLE, s.ease + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + 0.02::DOUBLE * (5 - q))) AS e, CASE WHEN q.grade = 'AGAIN' THEN 0 ELSE s.reps + 1 END AS reps FROM s JOIN q ON q.card = s.card AND q.k = s.k + 1)))
SELECT card, arg_max(ease, k) AS ease, CAST(arg_max(reps, k) AS BIGINT) AS reps, CAST(arg_max(days, k) AS BIGINT) AS days, CASE WHEN arg_max(reps, k) >= 2 THEN 'REVIEW' ELSE 'LEARNING' END AS status FROM s GROUP BY 1""")
def spaced_repetition(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return L.review_cards(e.select(F.col("user_id").alias("card"), "ts", "event_id", F.get(F.array(*map(F.lit, ("AGAIN", "HARD", "GOOD", "EASY"))), (F.col("event_id") % 4).cast("int")).alias("grade")))


@query("""WITH g AS (SELECT c_nationkey AS nation, c_mktsegment AS part, count(*) AS weight, 17::BIGINT AS seats FROM customer GROUP BY 1, 2), x AS (SELECT *, seats * weight / sum(weight) OVER w AS ex FROM g WINDOW w AS (PARTITION BY nation)),
y AS (SELECT *, floor(ex + 1e-9) AS fl, round(ex - floor(ex + 1e-9), 9) AS rest FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY rest DESC, weight DESC, part) AS rn, seats - sum(fl) OVER (PARTITION BY nation) AS free FROM y)
SELECT nation, part, weight, seats, CAST(fl + CASE WHEN rn <= free THEN 1 ELSE 0 END AS BIGINT) AS given FROM z""")
def largest_remainder(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("part")).agg(F.count("*").alias("weight")).withColumn("seats", F.lit(17).cast("long"))
    return L.apportion(g, ["nation"], "seats", "weight", "part")


EDGES = "d AS (SELECT DISTINCT l_orderkey AS artifact, l_suppkey AS topic FROM lineitem), ed AS (SELECT x.topic AS a, y.topic AS b, count(*) AS artifacts FROM d x JOIN d y ON x.artifact = y.artifact AND x.topic < y.topic GROUP BY 1, 2)"


def _edges(spark, sf_dir):
    return L.cooccurrence(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.col("l_suppkey").alias("topic")))


@query(f"WITH {EDGES} SELECT a, b, artifacts, round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.02::DOUBLE * (artifacts - 1)), 6) AS weight FROM ed")
def cooccurrence_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT a, b FROM ed WHERE artifacts >= 25 UNION ALL SELECT b, a FROM ed WHERE artifacts >= 25), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT s.b, r.depth + 1 FROM r JOIN s ON r.node = s.a WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def topic_graph(spark, sf_dir):
    return L.reachable(_edges(spark, sf_dir).where("artifacts >= 25"), spark.range(1, 2).select(F.col("id").alias("node")))


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT a, b, round(least(1.0::DOUBLE, 0.4::DOUBLE + 0.02::DOUBLE * (artifacts - 1)), 6) AS weight FROM ed),
g AS (SELECT a AS start, a, b, weight, 1 AS depth, [a, b] AS path, count(*) OVER (PARTITION BY a) AS n FROM e
 UNION ALL SELECT start, e.a, e.b, e.weight, depth + 1, list_append(path, e.b), count(*) OVER (PARTITION BY start) FROM g JOIN e ON e.a = g.b WHERE depth < 4 AND n < 200 AND NOT list_contains(path, e.b)),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, weight DESC, path) AS rank FROM g) SELECT start, a, b, weight, depth, CAST(path AS VARCHAR) AS path, rank FROM r WHERE rank <= 200""")
def topic_paths(spark, sf_dir):
    """Every topic as a start, over the whole table of edges, in their direction."""
    e = _edges(spark, sf_dir)
    found = L.topic_paths(e, e.select(F.col("a").alias("start")))
    return found.withColumn("path", F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("""WITH p AS (SELECT l_orderkey AS attempt, l_suppkey % 7 AS topic, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS got, sum(50.0::DOUBLE) AS possible, count(*) FILTER (l_linestatus <> 'F') AS l FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, round(coalesce(got, 0) / possible, 4) AS ratio FROM p) SELECT attempt, round(coalesce(sum(got), 0), 4) AS total, CAST(sum(l) AS BIGINT) AS ungraded, coalesce(string_agg(CAST(topic AS VARCHAR), ',' ORDER BY ratio, topic) FILTER (ratio < 0.7), '') AS weak_topics FROM w GROUP BY 1""")
def quiz_results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return L.quiz_results(li.select(F.col("l_orderkey").alias("attempt"), (F.col("l_suppkey") % 7).alias("topic"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("awarded"), F.lit(50.0).alias("possible")))


MSG = "m AS (SELECT conv_id, turn, greatest(1, (length(coalesce(text, '')) + 3) // 4) AS tokens FROM conversations)"


@query(f"""WITH {MSG}, c AS (SELECT conv_id, turn, least(tokens, 900) AS tokens FROM m), w AS (SELECT *, row_number() OVER x AS n, sum(tokens) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM c WINDOW x AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, tokens FROM w WHERE n <= 12 AND (s <= 600 OR n <= 2)""")
def token_window(spark, sf_dir):
    return M.token_window(table(spark, sf_dir, "conversations"), budget=600)


@query(f"""WITH {MSG}, w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS a, row_number() OVER x AS n, sum(tokens) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m WINDOW x AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, CASE WHEN a <= 500 THEN 'whole' WHEN s <= 200 OR n = 1 THEN 'kept' ELSE 'evicted' END AS state FROM w""")
def water_marks(spark, sf_dir):
    return M.water_marks(table(spark, sf_dir, "conversations"), 500, 200)


@query("""SELECT event_id AS id, round(0.6::DOUBLE * (value / 500) + 0.2::DOUBLE * exp(-ln(2.0::DOUBLE) * greatest((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400, 0) / 14) + 0.2::DOUBLE * greatest(0, least(1, value / 400)), 6) AS score FROM events WHERE value / 500 >= 0.55""")
def recall_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.recall_rank(e.select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("similarity"), F.col("ts").cast("timestamp").alias("updated"), (F.col("value") / 400).alias("confidence")), "2024-02-01 00:00:00")


@query("""WITH e AS (SELECT event_id AS id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS r FROM events) SELECT id, user_id FROM e WHERE r <= n - 40""")
def capacity_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("confidence"), F.col("ts").alias("last_used"))
    return M.evict(e, ["user_id"], 40).select("id", "user_id")


@query("""WITH t AS (SELECT o_orderkey AS task_id, CAST(o_orderkey % 3 AS INT) AS priority, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
SELECT task_id, priority, CAST(CASE priority WHEN 0 THEN r // 3 * 8 + [0, 2, 4][CAST(r % 3 AS INT) + 1] WHEN 1 THEN r // 3 * 8 + [1, 3, 6][CAST(r % 3 AS INT) + 1] ELSE r // 2 * 8 + [5, 7][CAST(r % 2 AS INT) + 1] END AS BIGINT) AS position FROM t""")
def weighted_round_robin(spark, sf_dir):
    return M.round_robin(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), F.col("o_orderdate").alias("enqueued")))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 4""")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 10 = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 10 = 4").withColumn("c_custkey", F.col("c_custkey") + 1000000000))
    return U.upsert(c, new, ["c_custkey"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 3 = 0""")
def insert_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return U.insert_ignore(c.where("c_custkey % 3 <> 0"), c.withColumn("c_name", F.concat(F.lit("new "), "c_name")), ["c_custkey"])


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 'changed' ELSE p_name END AS p_name, CAST(CASE WHEN p_size % 4 = 1 AND p_partkey % 2 = 0 THEN 2 ELSE p_size % 4 END AS INT) AS version FROM part""")
def optimistic_update(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 4).cast("int").alias("version"))
    return U.update_if_version(p, p.where("p_partkey % 2 = 0").select("p_partkey", F.lit(1).alias("expected"), F.lit("changed").alias("value")), "p_partkey", "p_name")


@query("""SELECT l_orderkey, l_linenumber, l_comment FROM (SELECT l_orderkey, l_linenumber, 'old' AS l_comment FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 1, 'new' FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1)""")
def replace_parents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("l_comment"))
    return U.replace_parents(li, li.where("l_orderkey % 5 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit("new").alias("l_comment")), "l_orderkey")


@query("""SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 7 = 0 OR doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def incremental_refresh(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    stored = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return U.changed(d, stored.withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("digest"))), "doc_id", "digest")


@query("""WITH d AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS a, length(regexp_replace(text, '\\s+', '', 'g')) AS v, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS b FROM documents),
q AS (SELECT doc_id, n, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * least(1, n / 240) + 0.45::DOUBLE * a / greatest(v, 1) - least(0.6::DOUBLE, 4 * b / greatest(v, 1)))) * 1e4 + 0.5) / 1e4 AS quality FROM d)
SELECT doc_id, quality, n >= 120 AND quality >= 0.55 AS reliable, n < 60 OR quality < 0.35 AS weak FROM q""")
def page_profile(spark, sf_dir):
    from ..operators.documents import page_profile as profile

    return profile(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT source, doc_id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS k FROM l0), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
f AS (SELECT source, k, count(DISTINCT doc_id) AS seen FROM l WHERE length(k) BETWEEN 1 AND 140 GROUP BY 1, 2) SELECT source, k AS line, seen FROM f JOIN n USING (source) WHERE pages >= 8 AND seen >= greatest(5, ceil(pages * 0.05))""")
def repeated_lines(spark, sf_dir):
    from ..operators.documents import repeated_lines as repeated

    return repeated(table(spark, sf_dir, "documents").select(F.col("source").alias("parent"), F.col("doc_id").alias("page"), "text"), share=0.05).withColumnRenamed("parent", "source")


@query(f"""WITH {CHUNKS}, x AS (SELECT doc_id, chunk_index, content, CASE WHEN regexp_matches(content, '^\\s*([-*+]|[0-9]+[.)])\\s+') THEN 'LIST' WHEN contains(content, '|') THEN 'TABLE' WHEN length(trim(content)) <= 60 AND NOT regexp_matches(content, '[.,;:!?]\\s*$') THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind FROM c WHERE trim(content) <> ''),
y AS (SELECT *, CASE WHEN kind = 'HEADING' OR lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)), z AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS block FROM y)
SELECT doc_id, CAST(block AS BIGINT) AS block, any_value(kind) AS kind, count(*) AS lines, CAST(sum(length(content)) AS BIGINT) AS chars FROM z GROUP BY 1, 2""")
def line_blocks(spark, sf_dir):
    from ..operators.documents import line_blocks as blocks

    return blocks(chunks(spark, sf_dir))


@query("""WITH r AS (SELECT c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey) SELECT c_custkey, o_orderkey, o_orderdate FROM r WHERE n = 1""")
def latest_per_key(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    last = R.top(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1)
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderdate")


@query("""WITH a AS (SELECT o_custkey AS k, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS q FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS f FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, round(CASE WHEN q IS NOT NULL AND f IS NOT NULL THEN 0.7 * q + 0.3 * f ELSE coalesce(q, f) END, 6) AS mastery FROM a FULL JOIN b ON a.k = b.k""")
def mastery_estimate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("q"))
    b = o.where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"))
    both = 0.7 * F.col("q") + 0.3 * F.col("f")
    return a.join(b, "k", "full").select("k", F.round(F.coalesce(both, "q", "f"), 6).alias("mastery"))


@query("""WITH v AS (SELECT row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, event_type, value FROM events)
SELECT event_type, max(value) FILTER (i = CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)) AS p50, max(value) FILTER (i = CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT)) AS p95, max(value) FILTER (i = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT)) AS p99 FROM v GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    from ..operators.records import percentiles_by_index

    return percentiles_by_index(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# The other modules add their queries to the same registry.
from . import document_queries, geometry_queries, markdown_queries, memory_queries, page_queries, record_queries, stream_queries, study_queries, workflow_queries  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in FOUND.items() if s}
