"""Registered queries of document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math_text as X
from ..functions import text as T
from ..operators import documents as D
from ..operators import folds, layout
from .queries import WS
from .registry import CHUNKS, chunks, query, table

PROFILE = """pf0 AS (SELECT doc_id, source, length(text) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS a, length(regexp_replace(text, '\\s+', '', 'g')) AS v, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS b FROM documents),
pf1 AS (SELECT doc_id, source, n, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * least(1, n / 240) + 0.45::DOUBLE * a / greatest(v, 1) - least(0.6::DOUBLE, 4 * b / greatest(v, 1)))) * 1e4 + 0.5) / 1e4 AS quality FROM pf0),
pf AS (SELECT *, n >= 120 AND quality >= 0.55 AS reliable, n < 60 OR quality < 0.35 AS weak FROM pf1)"""


def _profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return D.page_profile(d).join(d.select("doc_id", "source", F.length("text").alias("n")), "doc_id")


@query(f"""WITH {PROFILE}, g AS (SELECT source, count(*) AS pages, count(*) FILTER (reliable) AS reliable, count(*) FILTER (weak) AS weak FROM pf GROUP BY 1), r AS (SELECT *, weak / pages AS w, reliable / pages AS s FROM g)
SELECT source, pages, reliable, weak, CASE WHEN w >= 0.85 THEN 'SCANNED_PDF' WHEN s >= 0.85 AND weak = 0 THEN 'TEXT_PDF' ELSE 'MIXED' END AS source_class, floor(CASE WHEN w >= 0.85 THEN w WHEN s >= 0.85 AND weak = 0 THEN s ELSE 1 - abs(s - w) * 0.25::DOUBLE END * 1e4 + 0.5) / 1e4 AS confidence FROM r""")
def document_class(spark, sf_dir):
    return D.document_class(_profile(spark, sf_dir), ["source"])


@query(f"""WITH {PROFILE}, x AS (SELECT *, doc_id % 3 = 0 AS vis, doc_id % 400 AS o, n < 80 OR quality < 0.38 AS poor, CASE doc_id % 5 WHEN 0 THEN 'HANDWRITTEN_NOTES' WHEN 1 THEN 'LECTURE_SLIDES' WHEN 2 THEN 'BOOK' END AS k FROM pf), y AS (SELECT *, CASE WHEN k = 'HANDWRITTEN_NOTES' THEN 1 WHEN n < 24 AND (vis OR o > 0) THEN 2 WHEN poor AND o > greatest(40, n * 2) THEN 3 WHEN vis THEN 4 ELSE 5 END AS r FROM x)
SELECT doc_id, CASE WHEN r <= 3 THEN 'FULL_PAGE_VLM' WHEN r = 4 THEN 'HYBRID' ELSE 'NATIVE_TEXT' END AS route, CASE r WHEN 1 THEN 'declared handwritten' WHEN 2 THEN 'almost no text,something to see' WHEN 3 THEN 'weak text,much more text in the picture' WHEN 4 THEN concat_ws(',', 'pictures or drawings', CASE WHEN poor THEN 'weak text' END, CASE WHEN k = 'LECTURE_SLIDES' THEN 'slides' END) ELSE CASE WHEN poor THEN 'no better text' ELSE 'reliable text' END END AS reasons FROM y""")
def page_route(spark, sf_dir):
    i = F.col("doc_id") % 5
    kind = F.when(i == 0, "HANDWRITTEN_NOTES").when(i == 1, "LECTURE_SLIDES").when(i == 2, "BOOK")
    r = _profile(spark, sf_dir).select("doc_id", D.page_route(F.col("n"), F.col("quality"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 400, kind).alias("r"))
    return r.select("doc_id", "r.route", F.array_join("r.reasons", ",").alias("reasons"))


MARKED = "CASE chunk_index % 8 WHEN 0 THEN '## Theorem 4' WHEN 1 THEN 'Question 12 of it' WHEN 2 THEN '3) ' || content WHEN 3 THEN 'Related work: ' || substr(content, 1, 10) WHEN 4 THEN upper(substr(content, 1, 12)) WHEN 5 THEN 'q7. why' ELSE content END"


@query(f"""WITH {CHUNKS}, m AS (SELECT doc_id, chunk_index, {MARKED} AS t FROM c), b AS (SELECT *, lower(regexp_replace(t, '^[#: ]+|[#: ]+$', '', 'g')) AS bare, regexp_replace(t, '[^\\p{{L}}]+', '', 'g') AS l, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS u FROM m)
SELECT doc_id, chunk_index, regexp_matches(bare, '^({"|".join(D.UNITS)})') AS unit, chunk_index % 2 = 1 AND regexp_matches(bare, '^({"|".join(D.PAPER_SECTIONS)})') AS paper_section, regexp_matches(lower(trim(t)), '^({"|".join(D.QUESTIONS)})') AS question,
 length(t) BETWEEN 4 AND 80 AND l <> '' AND (regexp_matches(lower(t), '^({"|".join(D.TOPICS)})') OR (coalesce(u / nullif(length(l), 0) >= 0.72, FALSE) AND len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) <= 6)) AS topic FROM b""")
def line_boundaries(spark, sf_dir):
    i, c = F.col("chunk_index"), F.col("content")
    t = F.when(i % 8 == 0, "## Theorem 4").when(i % 8 == 1, "Question 12 of it").when(i % 8 == 2, F.concat(F.lit("3) "), c)).when(i % 8 == 3, F.concat(F.lit("Related work: "), F.substring(c, 1, 10))).when(i % 8 == 4, T.upper_each(F.substring(c, 1, 12))).when(i % 8 == 5, "q7. why").otherwise(c)
    return chunks(spark, sf_dir).select("doc_id", i.cast("long").alias("chunk_index"), D.boundaries(t, i % 2 == 1).alias("b")).select("doc_id", "chunk_index", "b.*")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?im)^\\s*(select|insert|update|delete|create)\\b') THEN 'sql' WHEN regexp_matches(text, '(?m)^\\s*\\((define|lambda|let\\*?|cond)\\b') THEN 'scheme'
 WHEN regexp_matches(text, '(?m)^\\s*(async\\s+def|def|from\\s+\\S+\\s+import|import\\s+\\S+)') THEN 'python' WHEN contains(text, 'console.log(') OR contains(text, '=>') OR regexp_matches(text, '(?m)^\\s*(const|let|var)\\s+\\w+') THEN 'javascript'
 WHEN contains(lower(text), 'system.out.') OR contains(lower(text), 'public static') OR regexp_matches(lower(text), '\\bpublic\\s+class\\b') THEN 'java' WHEN contains(text, 'std::') THEN 'cpp' WHEN contains(text, '#include') THEN CASE WHEN contains(lower(text), 'using namespace') THEN 'cpp' ELSE 'c' END
 WHEN contains(text, '<- function(') OR regexp_matches(text, '\\bfunction\\s*\\([^)]*\\)\\s*\\{') THEN 'r' WHEN starts_with(ltrim(text), '#!') OR regexp_matches(text, '(?m)^\\s*(echo|export|set -[a-z])\\b') THEN 'bash' ELSE 'text' END AS language,
 CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^=+*/^_<>|{}\\[\\]\\\\]', '', 'g')) / length(text), 6) ELSE 0 END AS density FROM documents""")
def code_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.code_language(F.col("text")).alias("language"), D.symbol_density(F.col("text")).alias("density"))


HEAD = "length(trim(content)) <= 60 AND NOT regexp_matches(content, '[.,;:!?]\\s*$') AND NOT regexp_matches(content, '^\\s*([-*+]|[0-9]+[.)])\\s+') AND NOT contains(content, '|')"


@query(f"""WITH {CHUNKS} SELECT doc_id, chunk_index, last_value(CASE WHEN {HEAD} THEN trim(content) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS heading,
 chunk_index / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1) <= 0.18 OR chunk_index / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1) >= 0.82 AS edge FROM c""")
def section_carry(spark, sf_dir):
    return D.lines_in_place(chunks(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading", "edge")


@query(f"""WITH {CHUNKS}, t AS (SELECT *, list_filter(string_split({WS}, ' '), lambda w: w <> '') AS w FROM c), l AS (SELECT doc_id, chunk_index, lag(w) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM t) SELECT doc_id, chunk_index, CASE WHEN len(b) >= 30 THEN array_to_string(b[len(b) - 29:], ' ') END AS overlap FROM l""")
def overlap_tails(spark, sf_dir):
    return D.overlap_tails(chunks(spark, sf_dir), 30).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "overlap")


@query("""WITH p AS (SELECT l_orderkey AS doc, count(DISTINCT l_shipdate) AS warnings, count(*) FILTER (l_returnflag = 'R') AS filtered, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1)
SELECT doc, floor(greatest(0::DOUBLE, 1 - (CASE WHEN tokens < 20 THEN 0.2::DOUBLE ELSE 0 END + least(0.35::DOUBLE, 0.07::DOUBLE * warnings) + least(0.15::DOUBLE, 0.02::DOUBLE * filtered))) * 1e3 + 0.5) / 1e3 AS quality FROM p""")
def page_quality(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.countDistinct("l_shipdate").alias("warnings"), F.count_if(F.col("l_returnflag") == "R").alias("filtered"), F.sum("l_quantity").cast("long").alias("tokens"))
    return p.select("doc", D.page_quality(F.col("tokens"), F.col("warnings"), F.col("filtered")).alias("quality"))


RATIO = """rl0 AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), rl AS (SELECT DISTINCT source, doc_id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS k FROM rl0),
rn AS (SELECT source, k, count(*) AS n FROM rl WHERE length(k) >= 12 GROUP BY 1, 2), rr AS (SELECT source, count(*) AS lines, round(count(*) FILTER (n >= 2) / count(*), 6) AS ratio FROM rn GROUP BY 1)"""


def _ratio(spark, sf_dir):
    return D.repeated_line_ratio(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text"), "source")


@query(f"WITH {RATIO} SELECT * FROM rr")
def repeated_line_ratio(spark, sf_dir):
    return _ratio(spark, sf_dir)


@query(f"""WITH {RATIO}, t AS (SELECT doc_id, text, ratio, (doc_id % 100) / 100 AS cov FROM documents JOIN rr USING (source)) SELECT doc_id, concat_ws(',', CASE WHEN cov < 0.82 THEN 'coverage' END, CASE WHEN ((length(text) - length(replace(text, '$$', ''))) // 2) % 2 <> 0 THEN 'formulas' END,
 CASE WHEN ((length(text) - length(replace(text, '```', ''))) // 3) % 2 <> 0 THEN 'code' END, CASE WHEN ratio > 0.18 THEN 'repeats' END) AS failed FROM t""")
def markdown_gates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(_ratio(spark, sf_dir), "source")
    return d.select("doc_id", D.markdown_gates(F.col("text"), F.col("doc_id") % 100 / 100, F.col("ratio")).alias("failed"))


ELEMENTS = """md AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 9 = 0 THEN '# ' || content WHEN chunk_index % 9 IN (3, 5) THEN '```' WHEN chunk_index % 9 = 7 THEN '| ' || content ELSE content END AS content FROM c), mf AS (SELECT *, regexp_matches(content, '^\\s*```') AS f, sum(CASE WHEN regexp_matches(content, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS fs FROM md),
mk AS (SELECT *, CASE WHEN f OR fs % 2 = 1 THEN 'CODE' WHEN regexp_matches(content, '^#{1,6}\\s') THEN 'HEADING' WHEN regexp_matches(content, '^\\s*\\|') THEN 'TABLE' WHEN regexp_matches(content, '^\\s*\\$\\$') THEN 'FORMULA' WHEN regexp_matches(content, '^\\s*([-*+]|[0-9]+[.)])\\s+') THEN 'LIST' WHEN regexp_matches(content, '^\\s*$') THEN NULL ELSE 'PARAGRAPH' END AS kind FROM mf),
mn AS (SELECT *, last_value(CASE WHEN kind = 'HEADING' THEN trim(regexp_replace(content, '^#{1,6}\\s+', '')) END IGNORE NULLS) OVER w AS section, CASE WHEN kind IS NOT NULL AND (kind = 'HEADING' OR lag(kind) OVER w IS DISTINCT FROM kind) THEN 1 ELSE 0 END AS nw FROM mk WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
me AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS element FROM mn)"""


@query(f"WITH {CHUNKS}, {ELEMENTS} SELECT doc_id, CAST(element AS BIGINT) AS element, any_value(kind) AS kind, any_value(section) AS section, count(*) AS lines FROM me WHERE kind IS NOT NULL GROUP BY 1, 2")
def markdown_elements(spark, sf_dir):
    i, c = F.col("chunk_index") % 9, F.col("content")
    m = F.when(i == 0, F.concat(F.lit("# "), c)).when(i.isin(3, 5), "```").when(i == 7, F.concat(F.lit("| "), c)).otherwise(c)
    return D.markdown_elements(chunks(spark, sf_dir).withColumn("content", m))


@query("""SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || text AS embedding_text, '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata FROM documents""")
def embedding_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return D.embedding_sources(d, ["lang", "source"]).select("doc_id", "embedding_text", "metadata")


#: The open chunk of each document as a list of its blocks; a chunk that ends hands up to two of its last blocks on.
NATIVE = f"""{CHUNKS}, nb AS (SELECT doc_id, chunk_index AS pos, chunk_index // 5 AS page, CASE (chunk_index // 7) % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS section, CASE WHEN chunk_index % 9 = 4 THEN 'CODE' ELSE 'PARAGRAPH' END AS kind, content,
 CAST(greatest(floor(len(list_filter(string_split({WS}, ' '), lambda w: w <> '')) * 13 / 10), 1, length(content) // 4) AS BIGINT) AS tokens FROM c),
b AS (SELECT doc_id, pos, page, section, {{'pos': pos, 'page': page, 'kind': kind, 'tokens': tokens}} AS x, tokens FROM nb),
s AS (SELECT doc_id, pos, CASE WHEN tokens > 800 THEN 1 ELSE 0 END::BIGINT AS number, CASE WHEN tokens > 800 THEN [] ELSE [x] END AS held, section AS last, [{{'n': 0::BIGINT, 'pos': pos}}] AS made FROM b WHERE pos = 0
 UNION ALL SELECT doc_id, pos, CASE WHEN len(held) = 0 AND tokens > 800 THEN number + 1 ELSE number + cut END, CASE WHEN len(held) = 0 AND tokens > 800 THEN [] ELSE list_append(base, x) END, section,
   list_append(CASE WHEN cut = 1 THEN list_transform(base, lambda r: {{'n': number + 1, 'pos': r.pos}}) ELSE [] END, {{'n': number + cut, 'pos': pos}})
  FROM (SELECT *, CASE WHEN cut = 0 THEN held WHEN NOT keep THEN [] WHEN len(tail) > 0 AND tail[-1].tokens >= 80 THEN tail[-1:] ELSE tail[-2:] END AS base
   FROM (SELECT *, CASE WHEN big OR paged OR wide OR named THEN 1 ELSE 0 END::BIGINT AS cut, big OR paged AS keep, list_filter(held, lambda r: NOT (r.kind = 'CODE' AND r.tokens > 120)) AS tail
    FROM (SELECT b.*, s.number, s.held, len(s.held) > 0 AND size + b.tokens > 800 AS big, len(s.held) > 0 AND size >= 450 AND b.page <> s.held[-1].page AS paged, len(s.held) > 0 AND greatest(b.page, hi) - least(b.page, lo) >= 3 AS wide,
      coalesce(len(s.held) > 0 AND b.section <> s.last AND size >= 80, FALSE) AS named
     FROM (SELECT *, coalesce(list_sum(list_transform(held, lambda r: r.tokens)), 0) AS size, list_min(list_transform(held, lambda r: r.page)) AS lo, list_max(list_transform(held, lambda r: r.page)) AS hi FROM s) s JOIN b ON b.doc_id = s.doc_id AND b.pos = s.pos + 1)))),
m AS (SELECT doc_id, unnest(made, recursive := true) FROM s), g AS (SELECT m.doc_id, m.n, min(m.pos) AS first, max(m.pos) AS last, count(*) AS blocks, sum(tokens) AS tokens, min(page) AS page_start, max(page) AS page_end, string_agg(content, chr(10) || chr(10) ORDER BY m.pos) AS content FROM m JOIN nb ON nb.doc_id = m.doc_id AND nb.pos = m.pos GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {WS} ORDER BY n) AS r FROM g)"""


def _native(spark, sf_dir):
    i, c = F.col("chunk_index"), F.col("content")
    section = F.when(F.floor(i / 7) % 3 == 1, "a").when(F.floor(i / 7) % 3 == 2, "b")
    b = chunks(spark, sf_dir).select("doc_id", i.cast("long").alias("position"), F.floor(i / 5).alias("page"), section.alias("section"), F.when(i % 9 == 4, "CODE").otherwise("PARAGRAPH").alias("kind"), T.tokens_document(c).alias("tokens"), c.alias("text"))
    return folds.native_chunks(b)


@query(f"WITH RECURSIVE {NATIVE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk, first, last, blocks, CAST(tokens AS BIGINT) AS tokens, page_start, page_end, md5(content) AS digest FROM o WHERE r = 1")
def native_chunks(spark, sf_dir):
    return _native(spark, sf_dir).select("doc_id", "chunk", "first", "last", "blocks", "tokens", "page_start", "page_end", F.md5("content").alias("digest"))


BOXES = "bx AS (SELECT l_orderkey AS page, l_linenumber AS block, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0, l_partkey % 400 + l_quantity * 9 AS x1, l_suppkey % 700 + l_linenumber * 30.0::DOUBLE AS y1, l_discount AS d FROM lineitem)"


def _boxes(spark, sf_dir):
    x, y = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 9).alias("x1"), (y + F.col("l_linenumber") * 30.0).alias("y1"), F.col("l_discount").alias("d"))


@query(f"""WITH {BOXES}, o AS (SELECT b.page, b.block, r.block AS region, round(greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS share FROM bx b JOIN bx r ON b.page = r.page WHERE r.d > 0.05) SELECT * FROM o WHERE share >= 0.45""")
def blocks_in_regions(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return layout.blocks_in_regions(b, b.where("d > 0.05").withColumnRenamed("block", "region"))


@query(f"WITH {BOXES}, g AS (SELECT page, count(*) AS images, floor(least(1, sum((x1 - x0) * (y1 - y0)) / 480000) * 1e6 + 0.5) / 1e6 AS coverage FROM bx GROUP BY 1) SELECT *, coverage >= 0.12 AS full_page FROM g")
def image_coverage(spark, sf_dir):
    return layout.image_coverage(_boxes(spark, sf_dir), 480000.0)


@query(f"""WITH {BOXES}, k AS (SELECT *, d > 0.08 AS fo, x1 - x0 AS w, y1 - y0 AS h FROM bx) SELECT page, block, x0 FROM k WHERE (w * h / 480000 >= 0.03 OR fo) AND w >= 40 AND h >= CASE WHEN fo THEN 24 ELSE 40 END AND w <= h * 12 AND h <= w * 12""")
def usable_regions(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("kind", F.when(F.col("d") > 0.08, "FORMULA").otherwise("FIGURE"))
    return layout.usable_regions(b, 480000.0).select("page", "block", "x0")


@query("""WITH i AS (SELECT l_suppkey % 40 AS doc, l_orderkey AS page, l_linenumber * 100000 + l_partkey AS image, CASE WHEN l_linenumber < 7 THEN l_partkey % 6 END AS hash, CASE l_returnflag WHEN 'A' THEN 'CODE_IMAGE' ELSE 'IMAGE' END AS kind, l_discount AS area FROM lineitem), n AS (SELECT doc, count(DISTINCT page) AS pages FROM i GROUP BY 1), s AS (SELECT doc, hash, count(*) AS seen FROM i WHERE hash IS NOT NULL GROUP BY 1, 2)
SELECT doc, page, image, hash, seen FROM i JOIN s USING (doc, hash) JOIN n USING (doc) WHERE seen >= greatest(3, ceil(pages * 0.15)) AND kind <> 'CODE_IMAGE' AND area < 0.08""")
def repeated_images(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("doc"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("image"), F.when(F.col("l_linenumber") < 7, F.col("l_partkey") % 6).alias("hash"), F.when(F.col("l_returnflag") == "A", "CODE_IMAGE").otherwise("IMAGE").alias("kind"), F.col("l_discount").alias("area"))
    return layout.repeated_images(i, i, "doc")


@query(f"""WITH {BOXES}, u AS (SELECT page, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1 FROM bx GROUP BY 1, 2), a AS (SELECT *, CASE WHEN x1 - x0 >= 360 THEN 1 ELSE 0 END AS w FROM u), b AS (SELECT *, sum(w) OVER (PARTITION BY page ORDER BY y0, x0, block) * 2 - w AS band FROM a)
SELECT page, block, row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN w = 1 THEN 0 WHEN (x0 + x1) / 2 < 300 THEN 0 ELSE 1 END, y0, x0, block) AS position FROM b""")
def reading_order(spark, sf_dir):
    u = _boxes(spark, sf_dir).groupBy("page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"))
    return layout.reading_order(u, 600.0).select("page", "block", "position")


@query(f"""WITH {BOXES}, a AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM bx), b AS (SELECT *, sum(CASE WHEN m IS NULL OR y0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, y1, x0, x1 ROWS UNBOUNDED PRECEDING) AS band FROM a)
SELECT page, CAST(band AS BIGINT) AS band, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS boxes FROM b GROUP BY 1, 2""")
def formula_bands(spark, sf_dir):
    return layout.merge_bands(_boxes(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey AS line, l_linenumber * 10.0 AS x0, l_linenumber * 10.0 + l_quantity / 5 AS x1, CAST(l_partkey AS VARCHAR) AS text FROM lineitem), g AS (SELECT *, row_number() OVER w AS n, CASE WHEN x0 - lag(x1) OVER w >= greatest(0.8, 0.16::DOUBLE * 12) THEN ' ' ELSE '' END || text AS p FROM s WINDOW w AS (PARTITION BY line ORDER BY x0, x1, text)) SELECT line, string_agg(p, '' ORDER BY n) AS text FROM g GROUP BY 1""")
def join_spans(spark, sf_dir):
    x = F.col("l_linenumber") * 10.0
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), x.alias("x0"), (x + F.col("l_quantity") / 5).alias("x1"), F.lit(12.0).alias("size"), F.col("l_partkey").cast("string").alias("text"))
    return layout.join_spans(s)


@query(f"""WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, round(avg(greatest(1, (length(content) + 3) // 4)), 6) AS mean, count(*) FILTER (greatest(1, (length(content) + 3) // 4) < 80) AS tiny FROM c GROUP BY 1""")
def chunk_stats(spark, sf_dir):
    n = F.greatest(F.lit(1), F.floor((F.length("content") + 3) / 4))
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n < 80).alias("tiny"))


def _any(names, column="t"):
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in names) + ")"


def _number(pattern, column="t"):
    return f"len(regexp_extract_all({column}, '{pattern}'))"


#: Lines of the documents, some made into code, formulas, tables and headings.
TYPED = "CASE chunk_index % 9 WHEN 1 THEN 'return ' || content WHEN 2 THEN 'a = b / c' WHEN 3 THEN 'x | y | z' WHEN 4 THEN '- ' || content WHEN 5 THEN 'Chapter One: ' || substr(content, 1, 9) WHEN 6 THEN 'if (x) { y(); }' WHEN 7 THEN '∑ of ' || substr(content, 1, 20) ELSE content END"


@query(f"""WITH {CHUNKS}, l AS (SELECT doc_id, chunk_index, trim({TYPED}) AS t FROM c), k AS (SELECT *, {_number('[^ ]+')} AS tokens0, {_number('[A-Za-z]{2,}')} AS words, len(regexp_extract_all(t, '\\S+')) AS tokens,
 {" OR ".join(f"regexp_matches(t, '{p}')" for p in D.CODE_PATTERNS)} OR {_any(D.CODE_MARKS)} AS sure, regexp_matches(t, '\\^[A-Za-z0-9]|[≤≥∑∫]') AND NOT {_any([';', '{', '}', '#include', 'return '])} AS powers FROM l),
d AS (SELECT *, sure OR (NOT powers AND regexp_matches(t, '{D.STATEMENT}') AND (t LIKE '%;' OR contains(t, '{{') OR contains(t, '}}'))) AS code, words >= 6 AND words >= 0.45 * greatest(1, tokens) AS prose FROM k),
f AS (SELECT *, {_any(D.LATEX_MARKS)} OR CASE WHEN {_any(D.MATH_MARKS)} AND NOT prose THEN tokens <= 28 OR regexp_matches(t, '[=<>≤≥]') ELSE regexp_matches(t, '[=^]|[A-Za-z]\\s*/\\s*[A-Za-z0-9]') AND tokens <= 16 AND regexp_matches(t, '[A-Za-z0-9\\])]') AND NOT prose AND NOT code END AS formula FROM d),
h AS (SELECT *, NOT regexp_matches(t, '{D.PROMPTS.replace(chr(39), chr(39) * 2)}') AND length(t) <= 90 AND tokens <= 10 AND NOT regexp_matches(t, '[.;,]$') AND NOT formula AND NOT code AND regexp_matches(t, '^[A-Z][A-Za-z0-9]') AND (contains(t, ':') OR (tokens <= 5 AND {_number('(?:^|\\s)[A-Z][a-z]+')} >= 1 AND {_number('(?:^|\\s)[a-z]+')} <= greatest(1, tokens // 2))) AS heading FROM f)
SELECT doc_id, chunk_index, CASE WHEN code THEN 'CODE' WHEN formula THEN 'FORMULA' WHEN {_number('\\bO\\([^)]+\\)')} >= 2 OR {_number('\\|')} >= 2 OR (len(regexp_split_to_array(t, '\\s{{2,}}')) >= 3 AND length(t) <= 180) THEN 'TABLE' WHEN regexp_matches(t, '^([-*•]|\\d+[.)])\\s+\\S') THEN 'LIST' WHEN heading THEN 'HEADING' ELSE 'PARAGRAPH' END AS kind FROM h""")
def line_types(spark, sf_dir):
    i, c = F.col("chunk_index") % 9, F.col("content")
    t = F.when(i == 1, F.concat(F.lit("return "), c)).when(i == 2, "a = b / c").when(i == 3, "x | y | z").when(i == 4, F.concat(F.lit("- "), c)).when(i == 5, F.concat(F.lit("Chapter One: "), F.substring(c, 1, 9))).when(i == 6, "if (x) { y(); }").when(i == 7, F.concat(F.lit("∑ of "), F.substring(c, 1, 20))).otherwise(c)
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), D.line_type(t).alias("kind"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'v is ' || p_name || ' ≠ 3' WHEN 1 THEN '(' || p_name || ')' || chr(10) || '\\begin{cases}' || chr(10) || 'x' || chr(10) || '\\end{cases}' WHEN 2 THEN p_name || chr(10) || chr(10) || 'b ∉ C' ELSE p_name END AS math,
 CASE p_partkey % 2 WHEN 0 THEN '$$' || chr(10) || 'a + ' || p_size || chr(10) || '$$' || chr(10) || chr(10) || '$$' || chr(10) || '\\begin{array}x\\end{array}' || chr(10) || '$$' ELSE '' END AS latex, 'def f():' || chr(10) || '    return ' || p_size AS code FROM part""")
def formula_texts(spark, sf_dir):
    i, n, size = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_size").cast("string")
    math = F.when(i == 0, F.concat(F.lit("𝑣is   "), n, F.lit(" \u0338= 𝟑"))).when(i == 1, F.concat(F.lit("\uf8eb\uf8ec"), n, F.lit("\x11 \uf8f1\uf8f2x"))).when(i == 2, F.concat(n, F.lit("\n\n \n\t\nb ∈\u0338  𝐶\x12"))).otherwise(F.concat(F.lit(" "), n, F.lit("\n")))
    latex = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$a + "), size, F.lit("$ ---FORMULA---  $$\\begin{tabular}x\\end{tabular}$$"))).otherwise(" \n ")
    code = F.concat(F.lit("```python\n\n  def f():\n\t  return "), size, F.lit("  \n\n```"))
    return table(spark, sf_dir, "part").select("p_partkey", X.math_text(math).alias("math"), X.latex_blocks(latex).alias("latex"), X.code_text(code).alias("code"))
