"""Registered queries of pages: strategies, boilerplate, structural chunks, tables and visuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from .queries import WS
from .registry import CHUNKS, chunks, query, table

EDGE = "chunk_index / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1)"


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    c = chunks(spark, sf_dir).join(d, "doc_id").withColumn("chunk_index", F.col("chunk_index").cast("long"))
    place = F.col("chunk_index") / F.greatest(F.lit(1), F.count("*").over(P.Window.partitionBy("doc_id")) - 1)
    return c.withColumn("edge", (place <= 0.18) | (place >= 0.82))


LINED = f"{CHUNKS}, ln AS (SELECT c.doc_id, source, chunk_index, content, {EDGE.replace('doc_id', 'c.doc_id')} <= 0.18 OR {EDGE.replace('doc_id', 'c.doc_id')} >= 0.82 AS edge FROM c JOIN documents d ON d.doc_id = c.doc_id)"


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'HANDWRITTEN_NOTES' WHEN 1 THEN 'LECTURE_SLIDES' WHEN 2 THEN 'COURSE_NOTES' WHEN 3 THEN 'RESEARCH_PAPER' WHEN 4 THEN 'ASSIGNMENT' WHEN 5 THEN 'PAST_EXAM' WHEN 6 THEN 'BOOK' END AS k, CASE doc_id % 3 WHEN 0 THEN 'SCANNED_PDF' WHEN 1 THEN 'TEXT_PDF' END AS s FROM documents)
SELECT doc_id, CASE WHEN k = 'HANDWRITTEN_NOTES' THEN 'FULL_PAGE_VLM' WHEN s = 'SCANNED_PDF' THEN 'PAGE_LEVEL_VISUAL' WHEN k = 'LECTURE_SLIDES' THEN 'SLIDE_LAYOUT' WHEN k = 'COURSE_NOTES' THEN 'STRUCTURAL_NOTES' WHEN k = 'RESEARCH_PAPER' THEN 'PAPER_SECTIONS' WHEN k IN ('ASSIGNMENT', 'PAST_EXAM') THEN 'QUESTION_STRUCTURE' ELSE 'MIXED_LAYOUT' END AS markdown,
 CASE WHEN k = 'HANDWRITTEN_NOTES' OR s = 'SCANNED_PDF' THEN 'PAGE_AWARE' WHEN k = 'LECTURE_SLIDES' THEN 'SLIDE_AWARE' WHEN k = 'COURSE_NOTES' THEN 'TOPIC_AWARE' WHEN k = 'RESEARCH_PAPER' THEN 'PAPER_SECTION_AWARE' WHEN k IN ('ASSIGNMENT', 'PAST_EXAM') THEN 'QUESTION_AWARE' ELSE 'MIXED_FALLBACK' END AS chunks, coalesce(k = 'HANDWRITTEN_NOTES', FALSE) OR coalesce(s = 'SCANNED_PDF', FALSE) AS whole_pages FROM t""")
def processing_strategies(spark, sf_dir):
    i, j = F.col("doc_id") % 8, F.col("doc_id") % 3
    kinds = ["HANDWRITTEN_NOTES", "LECTURE_SLIDES", "COURSE_NOTES", "RESEARCH_PAPER", "ASSIGNMENT", "PAST_EXAM", "BOOK"]
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, kinds)), i.cast("int")).alias("document_type"), F.when(j == 0, "SCANNED_PDF").when(j == 1, "TEXT_PDF").alias("source_type"))
    return P.strategies(d)


@query(f"""WITH {LINED}, x AS (SELECT source, doc_id, chunk_index, lower({WS}) AS exact FROM ln WHERE edge AND length(trim(content)) BETWEEN 1 AND 140 AND NOT contains(content, '=')), k AS (SELECT *, array_to_string(string_split(regexp_replace(exact, '[0-9]+', '#', 'g'), ' ')[1:8], ' ') AS kin FROM x),
n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 8), a AS (SELECT source, exact, count(DISTINCT doc_id) AS ne FROM k GROUP BY 1, 2), b AS (SELECT source, kin, count(DISTINCT doc_id) AS nk FROM k GROUP BY 1, 2)
SELECT source AS doc, doc_id AS page, chunk_index AS line FROM k JOIN n USING (source) JOIN a USING (source, exact) JOIN b USING (source, kin) WHERE ne >= greatest(5, ceil(0.05::DOUBLE * pages)) OR nk >= greatest(6, ceil(0.08::DOUBLE * pages))""")
def boilerplate_lines(spark, sf_dir):
    x = _lines(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.col("chunk_index").alias("line"), F.col("content").alias("text"), "edge", (~F.col("content").contains("=")).alias("plain"))
    return P.boilerplate_lines(x, 0.05, 0.08)


@query(f"""WITH {LINED}, b0 AS (SELECT source AS doc, doc_id AS page, chunk_index // 2 AS block, string_agg(content, chr(10) ORDER BY chunk_index) AS text, bool_or(edge) AS edge FROM ln GROUP BY 1, 2, 3),
b1 AS (SELECT *, greatest(1, (length(text) + 3) // 4) AS tokens, contains(text, '=') AS protected, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS exact FROM b0),
b AS (SELECT *, regexp_replace(exact, '[0-9]+', '#', 'g') AS kin FROM b1 WHERE edge AND tokens <= 28 AND len(l) BETWEEN 1 AND 3), pg AS (SELECT source AS doc, count(*) AS pages, greatest(5, ceil(0.05::DOUBLE * count(*))) AS need FROM documents GROUP BY 1 HAVING count(*) >= 8),
li AS (SELECT doc, page, block, unnest(l) AS l FROM b), lx AS (SELECT *, lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))) AS lx FROM li), lk AS (SELECT *, regexp_replace(lx, '[0-9]+', '#', 'g') AS lk FROM lx),
nx AS (SELECT doc, lx, count(DISTINCT page) AS nlx FROM lk GROUP BY 1, 2), nk AS (SELECT doc, lk, count(DISTINCT page) AS nlk, count(DISTINCT lx) AS vlk FROM lk GROUP BY 1, 2),
t AS (SELECT doc, page, block, count(*) FILTER (nlx >= need OR nlk >= need) / count(*) AS covered, count(*) FILTER (NOT nlx >= need AND nlk >= need AND vlk >= 3) AS numbered FROM lk JOIN pg USING (doc) JOIN nx USING (doc, lx) JOIN nk USING (doc, lk) GROUP BY 1, 2, 3),
ex AS (SELECT doc, exact, count(DISTINCT page) AS n_x FROM b GROUP BY 1, 2), ek AS (SELECT doc, kin, count(DISTINCT page) AS n_k, count(DISTINCT exact) AS v_k FROM b GROUP BY 1, 2),
s AS (SELECT doc, page, block, CASE WHEN protected THEN 0 ELSE floor(least(1::DOUBLE, 0.30::DOUBLE + CASE WHEN n_x >= need THEN 0.50::DOUBLE WHEN n_k >= need THEN 0.32::DOUBLE + CASE WHEN v_k >= 3 THEN 0.12::DOUBLE ELSE 0 END ELSE 0 END + CASE WHEN covered >= 0.66 THEN 0.46::DOUBLE ELSE 0 END + CASE WHEN covered >= 0.66 AND numbered > 0 THEN 0.08::DOUBLE ELSE 0 END
 + CASE WHEN tokens <= 12 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN n_x >= 0.65 * pages OR n_k >= 0.75 * pages THEN 0.08::DOUBLE ELSE 0 END) * 1e3 + 0.5) / 1e3 END AS score FROM b JOIN pg USING (doc) JOIN ex USING (doc, exact) JOIN ek USING (doc, kin) JOIN t USING (doc, page, block))
SELECT doc, page, block, score, CASE WHEN score >= 0.84 THEN 'exclude' WHEN score >= 0.62 THEN 'annotate' ELSE 'keep' END AS action FROM s""")
def block_noise(spark, sf_dir):
    b = _lines(spark, sf_dir).groupBy(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.floor(F.col("chunk_index") / 2).alias("block"))
    b = b.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("text"), F.bool_or("edge").alias("edge"))
    return P.block_noise(b.withColumn("tokens", F.greatest(F.lit(1), F.floor((F.length("text") + 3) / 4))).withColumn("protected", F.col("text").contains("=")), 0.05)


KINDS = "CASE chunk_index % 11 WHEN 0 THEN 'HEADING' WHEN 4 THEN 'CODE' WHEN 7 THEN 'TABLE' ELSE 'PARAGRAPH' END"
BLOCKS = f"{CHUNKS}, bl AS (SELECT doc_id, chunk_index AS pos, chunk_index // 6 AS page, 's' || (chunk_index // 11) AS section, {KINDS} AS kind, content, greatest(1, (length(content) + 3) // 4) AS tokens FROM c)"


def _blocks(spark, sf_dir):
    i = F.col("chunk_index").cast("long")
    kind = F.when(i % 11 == 0, "HEADING").when(i % 11 == 4, "CODE").when(i % 11 == 7, "TABLE").otherwise("PARAGRAPH")
    return chunks(spark, sf_dir).select("doc_id", i.alias("position"), F.floor(i / 6).alias("page"), F.concat(F.lit("s"), F.floor(i / 11).cast("string")).alias("section"), kind.alias("kind"), F.greatest(F.lit(1), F.floor((F.length("content") + 3) / 4)).cast("long").alias("tokens"), F.col("content").alias("text"))


@query(f"""WITH RECURSIVE {BLOCKS}, f AS (SELECT doc_id, pos, CASE WHEN kind <> 'PARAGRAPH' OR tokens >= 80 THEN 1 ELSE 0 END AS alone, tokens FROM bl),
s AS (SELECT doc_id, pos, 0::BIGINT AS block, CASE WHEN alone = 1 THEN 1::BIGINT ELSE CASE WHEN tokens >= 120 THEN 1 ELSE 0 END END AS next, CASE WHEN alone = 1 OR tokens >= 120 THEN 0 ELSE tokens END AS held FROM f WHERE pos = 0
 UNION ALL SELECT f.doc_id, f.pos, s.next + CASE WHEN alone = 1 AND held > 0 THEN 1 ELSE 0 END, s.next + CASE WHEN alone = 1 THEN CASE WHEN held > 0 THEN 2 ELSE 1 END WHEN held + tokens >= 120 THEN 1 ELSE 0 END, CASE WHEN alone = 1 OR held + tokens >= 120 THEN 0 ELSE held + tokens END FROM s JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos + 1)
SELECT s.doc_id, block, count(*) AS blocks, CASE WHEN count(*) > 1 THEN 'PARAGRAPH' ELSE any_value(kind) END AS kind, CAST(sum(tokens) AS BIGINT) AS tokens, md5(string_agg(content, chr(10) ORDER BY s.pos)) AS digest FROM s JOIN bl ON bl.doc_id = s.doc_id AND bl.pos = s.pos GROUP BY 1, 2""")
def small_blocks_merged(spark, sf_dir):
    return P.small_blocks_merged(_blocks(spark, sf_dir)).select("doc_id", "block", "blocks", "kind", "tokens", F.md5("text").alias("digest"))


def chunk_sql(target: int, most: int, section: str, marked: str, table_alone: str) -> str:
    """Recursive steps of a chunking rule; fresh: nothing is held."""
    return f"""f AS (SELECT *, ({table_alone}) AS alone, {marked} AS marked, {section} AS title FROM bl),
s AS (SELECT doc_id, pos, 0::BIGINT AS chunk, CASE WHEN alone THEN 1 ELSE 0 END::BIGINT AS nxt, CASE WHEN alone THEN 0 ELSE tokens END AS size, alone AS fresh, page, title, NOT alone AND kind <> 'HEADING' AS plain FROM f WHERE pos = 0
 UNION ALL SELECT doc_id, pos, CASE WHEN alone THEN nxt + CASE WHEN fresh THEN 0 ELSE 1 END ELSE nxt + cut END, CASE WHEN alone THEN nxt + CASE WHEN fresh THEN 1 ELSE 2 END ELSE nxt + cut END, CASE WHEN alone THEN 0 WHEN cut = 1 THEN tokens ELSE size + tokens END, alone, page, title, NOT alone AND ((cut = 0 AND plain) OR kind <> 'HEADING')
  FROM (SELECT f.*, s.nxt, s.size, s.fresh, s.plain, CASE WHEN NOT s.fresh AND s.plain AND (f.kind = 'HEADING' OR f.title IS DISTINCT FROM s.title OR s.size + f.tokens > {most} OR (s.size >= {target} AND f.page <> s.page) OR f.marked) THEN 1 ELSE 0 END::BIGINT AS cut FROM s JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos + 1))"""


STRUCTURAL = chunk_sql(450, 800, "section", "FALSE", "kind = 'TABLE' OR (kind = 'CODE' AND tokens >= 120)")


@query(f"""WITH RECURSIVE {BLOCKS}, {STRUCTURAL}, g AS (SELECT s.doc_id, chunk, list_sort(list_distinct(list(kind))) AS kinds, min(bl.page) AS page_start, max(bl.page) AS page_end, string_agg(content, chr(10) || chr(10) ORDER BY s.pos) AS content FROM s JOIN bl ON bl.doc_id = s.doc_id AND bl.pos = s.pos GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN kinds = ['HEADING'] THEN 'HEADING' WHEN list_contains(kinds, 'TABLE') THEN 'TABLE' WHEN list_contains(kinds, 'CODE') THEN 'CODE' ELSE 'PARAGRAPH' END AS kind, list_filter(string_split({WS}, ' '), lambda w: w <> '') AS w FROM g), l AS (SELECT *, lag(kind) OVER o AS pk, lag(w) OVER o AS pw FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY chunk))
SELECT doc_id, chunk, kind, array_to_string(kinds, ',') AS kinds, page_start, page_end, md5(CASE WHEN kind = 'PARAGRAPH' AND pk NOT IN ('CODE', 'TABLE', 'FORMULA') AND len(pw) >= 90 THEN array_to_string(pw[-90:], ' ') || chr(10) || chr(10) ELSE '' END || content) AS digest FROM l""")
def structural_chunks(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return P.assembled(P.structural_chunks(b), b).select("doc_id", "chunk", "kind", F.array_join("kinds", ",").alias("kinds"), "page_start", "page_end", F.md5("content").alias("digest"))


TOPICS = chunk_sql(650, 1000, "section", "regexp_matches(content, '(?i)^(the|und|la)(\\s|$)')", "kind IN ('TABLE', 'CODE', 'FORMULA') AND tokens >= 120")


@query(f"WITH RECURSIVE {BLOCKS}, {TOPICS} SELECT doc_id, chunk, pos AS position FROM s")
def topic_chunks(spark, sf_dir):
    return P.strategy_chunks(_blocks(spark, sf_dir).withColumnRenamed("section", "root"), "TOPIC_AWARE", "(?i)^(the|und|la)(\\s|$)")


@query("""WITH RECURSIVE p AS (SELECT source AS doc, doc_id AS page, greatest(1, (n_chars + 3) // 4) AS tokens, doc_id // 40 AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), s AS (SELECT doc, page, k, topic, 0::BIGINT AS chunk, tokens AS size FROM p WHERE k = 1
 UNION ALL SELECT doc, page, k, topic, chunk + cut, CASE WHEN cut = 1 THEN tokens ELSE size + tokens END FROM (SELECT p.*, s.chunk, s.size, CASE WHEN (p.topic <> s.topic AND s.size >= 60) OR s.size >= 650 OR s.size + p.tokens > 1000 THEN 1 ELSE 0 END AS cut FROM s JOIN p ON p.doc = s.doc AND p.k = s.k + 1)) SELECT doc, page, chunk FROM s""")
def page_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.greatest(F.lit(1), F.floor((F.col("n_chars") + 3) / 4)).alias("tokens"), F.floor(F.col("doc_id") / 40).alias("topic"))
    return P.page_chunks(d).withColumnRenamed("doc_id", "doc")


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, chunk_index, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS x, regexp_replace(lower(substr(content, 5, 40)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS y FROM c)
SELECT a.doc_id AS page, a.chunk_index AS element, min(b.chunk_index) AS block FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.chunk_index % 2 = 0 AND a.x <> '' AND b.y <> '' AND (contains(a.x, b.y) OR contains(b.y, a.x)) GROUP BY 1, 2""")
def linked_elements(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("chunk_index").cast("long").alias("k"), "content")
    return P.linked_elements(c.where("k % 2 = 0").withColumnRenamed("k", "element"), c.select("page", F.col("k").alias("block"), F.substring("content", 5, 40).alias("content")))


@query("""WITH k AS (SELECT l_suppkey AS doc, l_orderkey AS page, bool_or(l_linenumber = 1) AS f, bool_or(l_linenumber = 2) AS c, bool_or(l_linenumber = 3) AS t, bool_or(l_linenumber IN (4, 5)) AS v FROM lineitem GROUP BY 1, 2), j AS (SELECT l_suppkey AS doc, l_orderkey AS page, bool_or(l_linenumber NOT IN (4, 5)) AS x FROM lineitem GROUP BY 1, 2)
SELECT doc, page, CASE WHEN v AND x THEN 'hybrid' WHEN v THEN 'vlm' ELSE 'text' END AS source, concat_ws(',', CASE WHEN f THEN 'formula' END, CASE WHEN c THEN 'code' END, CASE WHEN t THEN 'table' END, CASE WHEN v THEN 'visual' END) AS tags,
 concat_ws(',', CASE WHEN f THEN 'derivation' END, CASE WHEN c THEN 'implementation' END, CASE WHEN t THEN 'comparison' END, CASE WHEN v THEN 'figure' END, CASE WHEN x THEN 'concept' END) AS serves FROM k JOIN j USING (doc, page)""")
def retrieval_profile(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "FORMULA").when(n == 2, "CODE").when(n == 3, "TABLE").when(n == 4, "IMAGE").when(n == 5, "DIAGRAM").otherwise("PARAGRAPH")
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page")).agg(F.collect_set(kind).alias("kinds"))
    r = P.retrieval_profile(p)
    return r.select("doc", "page", "source", F.array_join("tags", ",").alias("tags"), F.array_join("serves", ",").alias("serves"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '| ' || p_name || ' | ' || p_type || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' |  |' WHEN 1 THEN '| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |' || chr(10) || '| --- | --- | --- |' ELSE '| ' || p_name || ' |' || chr(10) || '| --- |' END AS md FROM part""")
def markdown_tables(spark, sf_dir):
    i, lf = F.col("p_partkey") % 3, F.lit("\n")
    t = F.when(i == 0, F.concat("p_name", F.lit(" | "), "p_type", F.lit("|"), lf, lf, F.lit("|"), "p_brand", F.lit("|"))).when(i == 1, F.concat(F.lit(" "), "p_name", F.lit("   "), "p_brand", F.lit("  "), F.col("p_size").cast("string"))).otherwise(F.concat("p_name", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", P.markdown_table(t).alias("md"))


@query("""WITH k AS (SELECT l_orderkey AS block, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS code, count(*) FILTER (l_returnflag = 'N' AND l_linenumber > 3) AS tab, count(*) FILTER (l_returnflag = 'N' AND l_linenumber <= 3) AS lst, arg_min(l_returnflag, (l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY 1)
SELECT block, CASE WHEN code >= greatest(1, (n + 1) // 2) THEN 'CODE' WHEN n >= 2 AND tab >= 2 THEN 'TABLE' WHEN n <= 2 AND f = 'R' THEN 'HEADING' WHEN lst >= greatest(1, n // 2) THEN 'LIST' ELSE 'PARAGRAPH' END AS kind FROM k""")
def block_kinds(spark, sf_dir):
    k = F.when(F.col("l_returnflag") == "A", "CODE").when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 3), "TABLE").when(F.col("l_returnflag") == "N", "LIST").otherwise("HEADING")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", k.alias("k")))).alias("s"))
    kinds = F.transform("s", lambda x: x["k"])
    return g.select("block", P.block_kind(kinds, F.transform(kinds, lambda x: F.lit("plain line"))).alias("kind"))


@query(f"""WITH t AS (SELECT item_id, b.text AS a, d.text AS d FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id), w AS (SELECT item_id, d, list_distinct(list_filter(string_split(lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))), ' '), lambda x: length(x) >= 3)) AS x, list_distinct(list_filter(string_split(lower(trim(regexp_replace(d, '\\s+', ' ', 'g'))), ' '), lambda x: length(x) >= 3)) AS y FROM t)
SELECT item_id, count(*) AS pairs, count(*) FILTER (least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) >= 0.3::DOUBLE * least(len(x), len(y))) AS held FROM w GROUP BY 1""")
def word_containment(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    j = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "text").join(b, "item_id")
    return j.groupBy("item_id").agg(F.count("*").alias("pairs"), F.count_if(P.containment(F.col("a"), F.col("text"), 0.3)).alias("held"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, '```|[`*#>|]', ' ', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')), '[^a-z0-9_+\\-*/=<>≤≥∑∞]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents""")
def similarity_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.similarity_text(F.col("text"))).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN 'HANDWRITTEN' WHEN l_quantity / 50 > 0.65 THEN 'FULL_PAGE_VISUAL' WHEN l_partkey % 5 = 0 THEN 'CODE_IMAGE' WHEN l_linenumber >= 6 THEN 'DIAGRAM' WHEN l_extendedprice < 20000 AND l_tax > 0.03 THEN 'TEXT_IMAGE' ELSE 'IMAGE' END AS kind FROM lineitem""")
def region_kinds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = P.region_kind(F.when(F.col("l_suppkey") % 9 == 0, "HANDWRITTEN_NOTES").otherwise("OTHER"), F.col("l_quantity") / 50, F.when(F.col("l_partkey") % 5 == 0, "for(;;){x=1;}").when(F.col("l_partkey") % 5 == 1, "some words"), F.col("l_linenumber") + 2, F.col("l_extendedprice") * 120 / 20000, F.when(F.col("l_tax") > 0.03, 1).otherwise(0))
    return li.select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("""WITH p AS (SELECT o_orderkey AS page, o_orderstatus <> 'P' AS visual, o_totalprice / 500000 AS coverage, o_custkey % 3 AS images, o_custkey AS length FROM orders), r AS (SELECT DISTINCT l_orderkey AS page, l_returnflag AS kind FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT page, kind FROM r UNION ALL SELECT page, 'FULL_PAGE_VISUAL' FROM p WHERE visual AND (coverage >= 0.12 OR (images > 0 AND length <= 160)) AND page NOT IN (SELECT page FROM r)""")
def fallback_regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), F.col("o_orderkey").alias("page"), (F.col("o_orderstatus") != "P").alias("visual"), (F.col("o_totalprice") / 500000).alias("coverage"), (F.col("o_custkey") % 3).alias("images"), F.col("o_custkey").alias("length"))
    r = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind")).distinct()
    return P.fallback_regions(o, r).select("page", "kind")


@query("SELECT doc_id, doc_id % 3 < 2 AND doc_id * 5 >= 200 AND n_chars < 0.45 * (doc_id * 5) AS suspect FROM documents")
def incomplete_transcriptions(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", P.suspect(F.when(i % 3 == 0, "HANDWRITTEN").when(i % 3 == 1, "FULL_PAGE_VISUAL").otherwise("IMAGE"), i * 5, F.col("n_chars")).alias("suspect"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'DECORATIVE_IMAGE' WHEN 1 THEN 'DIAGRAM' WHEN 2 THEN 'TEXT_IMAGE' WHEN 3 THEN 'CODE_IMAGE' WHEN 4 THEN 'FORMULA_IMAGE' WHEN 5 THEN 'TABLE_IMAGE' WHEN 6 THEN 'TEXT_IMAGE' WHEN 7 THEN 'DIAGRAM' ELSE 'DECORATIVE_IMAGE' END AS kind FROM events""")
def visual_kinds(spark, sf_dir):
    rows = [("decorative", "x", "", "", ""), ("chart", "", "", "", ""), ("handwriting", "", "", "", ""), ("unknown", "", "a long story of code", "", "f()"), (None, "a \\frac b", "words about a formula", "", ""), ("", "a|b|c|d|e", "", "", ""), ("other", "some words", "", "", ""), ("other", "", "a tall tree in the garden", "", ""), ("other", "", "a wooden floor in the sun", "", "")]
    cell = lambda k: F.get(F.array(*[F.lit(r[k]) for r in rows]), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.visual_kind(*[cell(k) for k in range(5)]).alias("kind"))


@query("SELECT p_partkey AS region FROM part WHERE NOT (p_partkey % 4 = 1 AND p_size % 5 <> 0)")
def resumed_regions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), F.sha2(F.concat_ws(":", "p_partkey", "p_name"), 256).alias("image"), F.lit("stub").alias("model"), F.lit("v2").alias("prompt"), "p_size")
    done = p.where("region % 4 IN (1, 2)").select(F.sha2(F.concat_ws("|", "image", "model", F.when(F.col("region") % 4 == 1, "v2").otherwise("v1")), 256).alias("fingerprint"), F.when(F.col("p_size") % 5 == 0, "timeout").alias("error"))
    return P.resumed(p, done).select("region")


HEADS = "CASE WHEN chunk_index % 4 = 0 THEN array_to_string(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')[1:1 + doc_id % 9], ' ') END"


@query(f"""WITH {CHUNKS}, h AS (SELECT doc_id, chunk_index, nullif(trim({HEADS}), '') AS h FROM c), r AS (SELECT *, CASE WHEN contains(h, ':') OR len(regexp_split_to_array(h, '\\s+')) <= 6 THEN h END AS root FROM h),
l AS (SELECT doc_id, chunk_index, coalesce(last_value(root IGNORE NULLS) OVER w, first_value(h IGNORE NULLS) OVER w) AS root, last_value(h IGNORE NULLS) OVER w AS last FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, chunk_index, CASE WHEN root = last THEN root ELSE concat_ws(' / ', root, last) END AS path FROM l""")
def heading_paths(spark, sf_dir):
    words = F.split(F.trim(F.regexp_replace("content", "\\s+", " ")), " ")
    c = chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content").withColumn("position", F.col("chunk_index"))
    c = c.withColumn("heading", F.when(F.col("chunk_index") % 4 == 0, F.array_join(F.slice(words, F.lit(1), (1 + F.col("doc_id") % 9).cast("int")), " ")))
    p = P.heading_paths(c)
    return p.select("doc_id", "chunk_index", F.when(F.size("path") > 0, F.array_join("path", " / ")).otherwise("").alias("path"))


@query("SELECT l_orderkey AS doc, count(*) AS results, CASE WHEN bool_and(l_returnflag = 'N') THEN 'PAGE_AWARE' ELSE 'MIXED_FALLBACK' END AS chunks FROM lineitem GROUP BY 1")
def inferred_strategies(spark, sf_dir):
    return P.inferred_strategy(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_returnflag") == "N", "FULL_PAGE_VISUAL").otherwise("IMAGE").alias("kind")))


@query(f"WITH {CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS lines FROM c) SELECT doc_id AS page, chunk_index AS line, CAST(lines AS INT) AS lines, floor(chunk_index / greatest(1, lines - 1) * 1e6 + 0.5) / 1e6 AS place FROM n")
def page_lines(spark, sf_dir):
    return P.page_lines(table(spark, sf_dir, "documents").select(F.lit(1).alias("doc"), F.col("doc_id").alias("page"), "text")).select("page", F.col("line").cast("long").alias("line"), "lines", "place")


@query("""WITH k AS (SELECT l_orderkey AS chunk, CASE WHEN l_linenumber = 1 THEN 'HEADING' ELSE l_returnflag END AS kind, count(*) AS n, min(l_linenumber * 100000 + l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT chunk, coalesce(arg_max(kind, (n, -p)) FILTER (kind <> 'HEADING'), 'HEADING') AS kind FROM k GROUP BY 1""")
def dominant_kinds(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("position"), F.when(F.col("l_linenumber") == 1, "HEADING").otherwise(F.col("l_returnflag")).alias("kind"))
    return P.dominant_kind(m, ["chunk"])


@query("""WITH b AS (SELECT l_suppkey AS doc, l_orderkey AS page, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_quantity, l_partkey, l_linenumber) - 1 AS i, CAST(l_partkey AS VARCHAR) AS t, l_returnflag AS k FROM lineitem)
SELECT doc, count(*) AS blocks, md5(string_agg(t, chr(10) || chr(10) ORDER BY page, i, t)) AS digest, substr(trim(regexp_replace(string_agg(t, ' ' ORDER BY page, i, t), '\\s+', ' ', 'g')), 1, 600) AS preview FROM b WHERE k <> 'R' GROUP BY 1""")
def full_texts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    b = li.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("block"), F.when(F.col("l_returnflag") == "R", "BOILERPLATE").otherwise("PARAGRAPH").alias("kind"), F.col("l_partkey").cast("string").alias("text"))
    return P.full_texts(b).select("doc", "blocks", F.md5("text").alias("digest"), "preview")


@query(f"""WITH RECURSIVE {BLOCKS}, f AS (SELECT doc_id, pos, tokens, kind IN ('TABLE', 'CODE') AND tokens >= 750 AS alone, pos % 5 = 2 AS o FROM bl), s AS (SELECT doc_id, pos, 0::BIGINT AS chunk, CASE WHEN alone THEN 1 ELSE 0 END::BIGINT AS nxt, CASE WHEN alone THEN NULL ELSE tokens END AS size FROM f WHERE pos = 0
 UNION ALL SELECT doc_id, pos, nxt + cut, nxt + cut + CASE WHEN alone THEN 1 ELSE 0 END, CASE WHEN alone THEN NULL WHEN cut = 1 OR size IS NULL THEN tokens ELSE size + tokens END FROM (SELECT f.*, s.nxt, s.size, CASE WHEN s.size IS NOT NULL AND (f.alone OR (f.o AND s.size >= 80) OR s.size + f.tokens > 1200) THEN 1 ELSE 0 END::BIGINT AS cut FROM s JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos + 1)) SELECT doc_id, pos AS position, chunk FROM s""")
def question_chunks(spark, sf_dir):
    return P.question_chunks(_blocks(spark, sf_dir).withColumn("opens", F.col("position") % 5 == 2))


SHOWN = "CASE p_partkey % 6 WHEN 0 THEN 'int ' || p_name WHEN 1 THEN p_name || ' = (a + b) * c / d' WHEN 2 THEN '| ' || p_name || ' | x |' || chr(10) || '| 1 | 2 |' WHEN 3 THEN 'a  ' || p_name || chr(10) || 'b  c' WHEN 4 THEN 'Axis of ' || p_type ELSE 'x=1;' || chr(10) || p_name END"


@query(rf"""WITH t AS (SELECT p_partkey, {SHOWN} AS t FROM part), k AS (SELECT *, contains(t, '#include') OR contains(t, 'return ') OR contains(t, 'printf') OR contains(t, 'malloc') OR contains(t, 'int ') OR contains(t, 'char ') OR contains(t, 'void ') OR contains(t, 'struct ') OR contains(t, 'assert(') OR (regexp_matches(t, '(?m)[{{}};][ \t]*$') AND regexp_matches(t, '[a-zA-Z_][a-zA-Z0-9_]*\s*[=(]')) AS code FROM t)
SELECT p_partkey, code, contains(t, 'lim') OR contains(t, '^') OR (length(regexp_replace(t, '[^=+\-*/^()\[\]{{}}|]', '', 'g')) >= 5 AND len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ')) <= 45 AND NOT code) AS formula,
 p_partkey % 6 IN (2, 3) AS table, regexp_matches(lower(t), '\b({"|".join(P.DIAGRAM_TERMS)})\b') AS diagram FROM k""")
def visual_texts(spark, sf_dir):
    i, n, lf = F.col("p_partkey") % 6, F.col("p_name"), F.lit("\n")
    t = F.when(i == 0, F.concat(F.lit("int "), n)).when(i == 1, F.concat(n, F.lit(" = (a + b) * c / d"))).when(i == 2, F.concat(F.lit("| "), n, F.lit(" | x |\n| 1 | 2 |"))).when(i == 3, F.concat(F.lit("a  "), n, F.lit("\nb  c"))).when(i == 4, F.concat(F.lit("Axis of "), F.col("p_type"))).otherwise(F.concat(F.lit("x=1;"), lf, n))
    return table(spark, sf_dir, "part").select("p_partkey", P.visual_text(t).alias("v")).select("p_partkey", "v.*")


@query("""WITH m AS (SELECT l_orderkey AS chunk, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS position, l_suppkey AS page, CASE l_linenumber WHEN 1 THEN 'HEADING' WHEN 2 THEN 'CODE' WHEN 3 THEN 'TABLE' WHEN 4 THEN 'MIXED_VISUAL' ELSE 'PARAGRAPH' END AS kind, CASE WHEN l_linenumber = 4 THEN l_partkey END AS asset FROM lineitem),
g AS (SELECT chunk, min(page) AS page_start, max(page) AS page_end, list_sort(list_distinct(list(kind) FILTER (kind <> 'HEADING'))) AS k, bool_or(kind = 'MIXED_VISUAL') AS has_image, bool_or(kind = 'TABLE') AS has_table, FALSE AS has_formula, bool_or(kind = 'CODE') AS has_code, 'p' || arg_min(page, position) AS path, list_sort(list_distinct(list(asset) FILTER (asset IS NOT NULL))) AS a FROM m GROUP BY 1)
SELECT chunk, page_start, page_end, CASE WHEN coalesce(len(k), 0) = 0 THEN 'HEADING' WHEN len(k) > 1 THEN 'MIXED' ELSE k[1] END AS kind, path, has_image, has_table, has_formula, has_code, coalesce(array_to_string(a, ','), '') AS assets, CASE WHEN len(a) = 1 THEN a[1] END AS asset FROM g""")
def chunk_facts(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "HEADING").when(n == 2, "CODE").when(n == 3, "TABLE").when(n == 4, "MIXED_VISUAL").otherwise("PARAGRAPH")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), (n * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("position"), F.col("l_suppkey").alias("page"), kind.alias("kind"), F.array(F.concat(F.lit("p"), F.col("l_suppkey").cast("string"))).alias("path"), F.when(n == 4, F.col("l_partkey")).alias("asset"))
    return P.chunk_facts(m, ["chunk"]).withColumns({"path": F.array_join("path", "/"), "assets": F.array_join(F.transform("assets", lambda x: x.cast("string")), ",")})


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '$$' || chr(10) || 'x^' || p_size || chr(10) || '$$' || chr(10) || chr(10) || 'Formula transcription: x to the ' || p_size WHEN 2 THEN p_name WHEN 3 THEN '```' || chr(10) || 'f(' || p_size || ')' || chr(10) || '```' WHEN 4 THEN '| a | ' || p_brand || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |'
 ELSE '<figure data-page="' || p_size || '" data-region="3" data-type="diagram">' || chr(10) || chr(10) || 'Visible text:' || chr(10) || p_name || chr(10) || chr(10) || 'Explanation:' || chr(10) || 'a flow' || chr(10) || chr(10) || '</figure>' END AS md FROM part""")
def rendered_visuals(spark, sf_dir):
    i, size, n, empty = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_name"), F.lit(None).cast("string")
    kinds = ["DECORATIVE_IMAGE", "FORMULA_IMAGE", "TEXT_IMAGE", "CODE_IMAGE", "TABLE_IMAGE", "DIAGRAM"]
    said = F.when(i == 1, F.concat(F.lit("x to the "), size)).when(i == 4, F.concat(F.lit("a | "), F.col("p_brand"), F.lit("\n1 | 2"))).when(i == 3, empty).otherwise(n)
    md = P.rendered_visual(F.get(F.array(*map(F.lit, kinds)), i.cast("int")), said, F.when(i == 5, "a flow "), F.when(i == 1, F.concat(F.lit("$x^"), size, F.lit("$"))), F.when(i == 3, F.concat(F.lit("```\nf("), size, F.lit(")\n```"))), F.col("p_size"), F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", md.alias("md"))


@query("""WITH v AS (SELECT doc_id AS page, r AS region, CASE r WHEN 0 THEN substr(text, 1, 50) WHEN 1 THEN 'entirely new picture text ' || doc_id WHEN 2 THEN 'Entirely new picture text ' || doc_id WHEN 3 THEN '***' ELSE 'other words here' END AS t FROM documents, range(5) AS x(r)) SELECT page, region FROM v JOIN documents ON doc_id = page WHERE region IN (1, 4)""")
def kept_visuals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    r, fresh = F.col("region"), F.concat(F.lit("ntirely new picture text "), F.col("page").cast("string"))
    t = F.when(r == 0, F.substring("text", 1, 50)).when(r == 1, F.concat(F.lit("e"), fresh)).when(r == 2, F.concat(F.lit("E"), fresh)).when(r == 3, "***").otherwise("other words here")
    return P.visuals_kept(d.withColumn("region", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select("page", "region", t.alias("text")), d)
