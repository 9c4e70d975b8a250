"""Markdown queries: lines of the documents, marked as Markdown by their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import markdown as M
from ..sources.shared import settle
from .registry import CHUNKS, chunks, query

#: Every line keeps its whole text, or is a mark.
MARKED = f"""{CHUNKS}, mk AS (SELECT doc_id, chunk_index, content, (doc_id * 5 + chunk_index * 7) % 17 AS k FROM c),
md AS (SELECT doc_id, chunk_index AS i, CASE k WHEN 0 THEN CASE WHEN chunk_index % 2 = 0 THEN '# Methods ' ELSE '# ' END || content WHEN 1 THEN '## Example ' || content WHEN 2 THEN '#### ' || content WHEN 3 THEN '```' WHEN 4 THEN '```' || content WHEN 5 THEN '$$' WHEN 6 THEN '<figure>' || content WHEN 7 THEN content || '</figure>'
 WHEN 8 THEN '<!-- page: ' || (doc_id % 7 + chunk_index) || ' -->' WHEN 9 THEN '| ' || content WHEN 10 THEN content || ' |' WHEN 11 THEN '---' WHEN 12 THEN '' WHEN 13 THEN '  ' || content || '  ' WHEN 14 THEN '7) ' || content WHEN 15 THEN 'NOTES ON IT' ELSE content END AS line FROM mk)"""


def marked(spark, sf_dir):
    i, c = F.col("chunk_index"), F.col("content")
    put = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = {
        0: put(F.when(i % 2 == 0, "# Methods ").otherwise("# "), c), 1: put("## Example ", c), 2: put("#### ", c), 3: F.lit("```"), 4: put("```", c), 5: F.lit("$$"), 6: put("<figure>", c), 7: put(c, "</figure>"),
        8: put("<!-- page: ", (F.col("doc_id") % 7 + i).cast("string"), " -->"), 9: put("| ", c), 10: put(c, " |"), 11: F.lit("---"), 12: F.lit(""), 13: put("  ", c, "  "), 14: put("7) ", c), 15: F.lit("NOTES ON IT"),
    }
    k = (F.col("doc_id") * 5 + i * 7) % 17
    return chunks(spark, sf_dir).withColumn("content", F.coalesce(*[F.when(k == n, form) for n, form in forms.items()], c))


#: One line after the other, the state carried as a row; lines are in md.
STEPS = """ml AS (SELECT doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM md),
ms AS (SELECT DISTINCT doc_id, -1::BIGINT AS i, ''::VARCHAR AS line, 'TEXT' AS mode, NULL::VARCHAR AS kind, 1::BIGINT AS page, []::VARCHAR[] AS stack, 0::BIGINT AS element FROM md
 UNION ALL SELECT doc_id, i, line, CASE role WHEN 'PAGE' THEN 'TEXT' WHEN 'INSIDE' THEN CASE WHEN (mode = 'CODE' AND t LIKE '```%') OR (mode = 'FORMULA' AND t LIKE '$$%') OR (mode = 'MIXED_VISUAL' AND contains(t, '</figure>')) THEN 'TEXT' ELSE mode END
   WHEN 'OPEN CODE' THEN 'CODE' WHEN 'OPEN FORMULA' THEN 'FORMULA' WHEN 'OPEN FIGURE' THEN CASE WHEN contains(t, '</figure>') THEN 'TEXT' ELSE 'MIXED_VISUAL' END ELSE 'TEXT' END,
  kd, CASE WHEN role = 'PAGE' THEN CAST(regexp_extract(t, '[0-9]+') AS BIGINT) ELSE page END,
  CASE WHEN role = 'HEADING' THEN list_append(CASE WHEN len(stack) >= level THEN stack[1:level - 1] ELSE stack END, regexp_replace(t, '^#+\\s+', '')) ELSE stack END,
  element + CASE WHEN kd IS NULL OR role = 'INSIDE' THEN 0 WHEN role IN ('TABLE', 'PARAGRAPH') AND kd = kind THEN 0 ELSE 1 END
 FROM (SELECT *, CASE role WHEN 'INSIDE' THEN mode WHEN 'OPEN CODE' THEN 'CODE' WHEN 'OPEN FORMULA' THEN 'FORMULA' WHEN 'OPEN FIGURE' THEN 'MIXED_VISUAL' WHEN 'PAGE' THEN NULL WHEN 'NOTHING' THEN NULL ELSE role END AS kd, len(regexp_extract(t, '^#+')) AS level
  FROM (SELECT ml.doc_id, ml.i, ml.line, ml.t, ms.mode, ms.kind, ms.page, ms.stack, ms.element, CASE WHEN regexp_matches(t, '(?i)^<!--\\s*page\\s*:\\s*[0-9]+\\s*-->') THEN 'PAGE' WHEN mode <> 'TEXT' THEN 'INSIDE' WHEN regexp_matches(t, '^#+\\s+\\S') THEN 'HEADING' WHEN t LIKE '```%' THEN 'OPEN CODE'
    WHEN t LIKE '$$%' THEN 'OPEN FORMULA' WHEN contains(t, '<figure') THEN 'OPEN FIGURE' WHEN contains(ml.line, '|') THEN 'TABLE' WHEN t IN ('', '---') THEN 'NOTHING' ELSE 'PARAGRAPH' END AS role FROM ms JOIN ml ON ml.doc_id = ms.doc_id AND ml.i = ms.i + 1))),
el AS (SELECT doc_id, element, min(kind) AS kind, min(page) AS page, arg_min(stack, i) AS path, min(i) AS first_line, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS content FROM ms WHERE kind IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {MARKED}, {STEPS} SELECT doc_id, element, kind, page, array_to_string(path, ' > ') AS path, first_line, lines, md5(CASE WHEN kind = 'HEADING' THEN content ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END) AS digest FROM el""")
def markdown_structure(spark, sf_dir):
    s = M.structure(marked(spark, sf_dir))
    return s.select("doc_id", "element", "kind", "page", F.array_join("path", " > ").alias("path"), "first_line", "lines", F.md5("content").alias("digest"))


#: Lines of each document under a heading before every third one; SQL finds a section by its lines, never by a pattern over the text.
SECTIONED = f"""{CHUNKS}, x AS (SELECT doc_id, list(CASE chunk_index % 6 WHEN 0 THEN '# Part ' || (chunk_index // 6) || chr(10) || content WHEN 3 THEN '### Part 1' || chr(10) || content ELSE content END ORDER BY chunk_index) AS p FROM c GROUP BY 1),
y AS (SELECT doc_id, array_to_string(p, chr(10)) AS md, string_split(array_to_string(p, chr(10)), chr(10)) AS l FROM x),
z AS (SELECT *, list_position(list_transform(l, lambda s: regexp_matches(s, '^#{{1,6}}\\s+Part 1\\s*$')), true) AS a FROM y),
u AS (SELECT *, CASE WHEN a IS NULL OR a = 0 THEN NULL ELSE list_position(list_transform(l[a + 1:], lambda s: regexp_matches(s, '^#+\\s') AND len(regexp_extract(s, '^#+')) <= len(regexp_extract(l[a], '^#+'))), true) END AS b FROM z),
v AS (SELECT doc_id, md, a IS NOT NULL AND a > 0 AS found, array_to_string(l[1:a - 1], chr(10)) AS before, array_to_string(CASE WHEN b > 0 THEN l[a:a + b - 1] ELSE l[a:] END, chr(10)) AS own, array_to_string(CASE WHEN b > 0 THEN l[a + b:] ELSE [] END, chr(10)) AS behind FROM u)"""


@query(f"""WITH {SECTIONED}, w AS (SELECT *, regexp_replace(before, '\\s+$', '') AS bf, regexp_replace(behind, '^\\s+', '') AS bh, regexp_replace(before || CASE WHEN before = '' THEN '' ELSE chr(10) END || own, '\\s+$', '') AS upto FROM v)
SELECT doc_id, md5(CASE WHEN contains(md, ' the ') THEN replace(md, ' the ', ' THE ') ELSE md END) AS all_replaced, md5(CASE WHEN contains(md, '. ') THEN substr(md, 1, strpos(md, '. ') - 1) || '! ' || substr(md, strpos(md, '. ') + 2) ELSE md END) AS one_replaced,
 md5(CASE WHEN found THEN bf || chr(10) || chr(10) || '# New' || chr(10) || chr(10) || regexp_replace(own || CASE WHEN behind = '' THEN '' ELSE chr(10) || behind END, '^\\s+', '') ELSE md END) AS put_before,
 md5(CASE WHEN found THEN upto || chr(10) || chr(10) || '# New' || chr(10) || chr(10) || bh ELSE md END) AS put_after, md5(regexp_replace(md, '\\s+$', '') || chr(10) || chr(10) || '# New' || chr(10)) AS put_last,
 md5(CASE WHEN found AND doc_id % 3 > 0 THEN regexp_replace(bf || chr(10) || chr(10) || bh, '^\\s+|\\s+$', '', 'g') || chr(10) ELSE md END) AS taken_out,
 CASE WHEN NOT found THEN 'heading not found' WHEN doc_id % 3 = 0 THEN 'confirmation required' END AS error, CASE WHEN doc_id % 2 = 0 THEN 'changed since it was read' END AS stale FROM w""")
def edited_markdown(spark, sf_dir):
    i, c = F.col("chunk_index"), F.col("content")
    line = F.when(i % 6 == 0, F.concat(F.lit("# Part "), F.floor(i / 6).cast("string"), F.lit("\n"), c)).when(i % 6 == 3, F.concat(F.lit("### Part 1\n"), c)).otherwise(c)
    p = chunks(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", line.alias("line")))).alias("l"))
    text, new, title = F.col("md"), F.lit("\n# New "), F.lit(" Part 1")
    d = p.select("doc_id", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("md"))
    d = d.withColumn("gone", M.deleted(text, title, F.col("doc_id") % 3 > 0)).withColumn("read", F.when(F.col("doc_id") % 2 == 0, "of another text").otherwise(F.sha2(text, 256)))
    return d.select(
        "doc_id", F.md5(M.replaced(text, F.lit(" the "), F.lit(" THE "), F.lit(True))["text"]).alias("all_replaced"), F.md5(M.replaced(text, F.lit(". "), F.lit("! "), F.lit(False))["text"]).alias("one_replaced"),
        F.md5(M.inserted(text, new, F.lit("BEFORE"), title)["text"]).alias("put_before"), F.md5(M.inserted(text, new, F.lit("AFTER"), title)["text"]).alias("put_after"), F.md5(M.inserted(text, new, F.lit("END"), title)["text"]).alias("put_last"),
        F.md5(F.col("gone")["text"]).alias("taken_out"), F.col("gone")["error"].alias("error"), M.inserted(text, new, F.lit("END"), title, F.col("read"))["error"].alias("stale"),
    )


#: Twelve documents make one, so that chunks fill; each has one of the six strategies. A chunk ends by a rule of its strategy, one element after the other.
CHUNKED = f"""{MARKED.replace("md AS (", "m0 AS (")}, md AS (SELECT doc_id // 12 AS doc_id, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id, i) - 1 AS i, line FROM m0), {STEPS},
ea AS (SELECT doc_id, element, kind, page, path, CASE WHEN kind = 'HEADING' THEN content ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END AS content FROM el),
eb AS (SELECT *, CAST(greatest(floor(len(list_filter(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) * 13 / 10), 1, length(content) // 4) AS BIGINT) AS tokens, doc_id % 6 AS st,
 list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1] AS one, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^[ #\\t]+|[ #\\t]+$', '', 'g')), lambda x: x <> '')[1] AS bare FROM ea),
ec AS (SELECT *, [650, 700, 650, 800, 750, 650][st + 1] AS target, [1000, 1100, 1000, 1200, 1200, 1000][st + 1] AS most, [60, 80, 80, 100, 80, 80][st + 1] AS least, lower(regexp_replace(one, '^[#: ]+|[#: ]+$', '', 'g')) AS low, path[1] AS root, path[-1] AS title,
 CASE WHEN bare IS NOT NULL THEN length(bare) BETWEEN 4 AND 80 AND regexp_matches(bare, '\\pL') AND (regexp_matches(lower(bare), '^(theorem|proof|example|definition|lemma|corollary|roadmap|notes|setup)')
  OR (length(regexp_replace(bare, '[^\\p{{Lu}}]', '', 'g')) >= 0.72 * length(regexp_replace(bare, '[^\\pL]', '', 'g')) AND len(string_split(trim(regexp_replace(bare, '\\s+', ' ', 'g')), ' ')) <= 6)) END AS topic, CASE WHEN lag(page) OVER o IS DISTINCT FROM page THEN 1 ELSE 0 END AS turn FROM eb WINDOW o AS (PARTITION BY doc_id ORDER BY element)),
ed AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY element) AS run, CASE st WHEN 2 THEN regexp_matches(low, '^(definition|theorem|lemma|corollary|proposition|proof|example|solution|remark)')
 WHEN 3 THEN kind = 'HEADING' AND regexp_matches(low, '^(abstract|introduction|background|related work|method|methodology|experiment|results|discussion|conclusion|references)')
 WHEN 4 THEN regexp_matches(lower(one), '^(#{{1,6}}\\s*)?(question|problem|exercise)\\s+[0-9]+|^q\\s*[0-9]+[).:\\s]|^[0-9]+[.)]\\s+') ELSE FALSE END AS begins FROM ec),
ee AS (SELECT *, sum(tokens) OVER r AS pt, coalesce(first_value(topic IGNORE NULLS) OVER r, FALSE) AS ptopic, last_value(title IGNORE NULLS) OVER r AS ptitle FROM ed WINDOW r AS (PARTITION BY doc_id, run ORDER BY element ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT doc_id, 0::BIGINT AS element, -1::BIGINT AS chunk, NULL::BIGINT AS size, 0::HUGEINT AS run, NULL::VARCHAR AS title, FALSE AS large, FALSE AS plain, 0::BIGINT AS page, NULL::VARCHAR AS root FROM ee WHERE element = 1
 UNION ALL SELECT doc_id, element, chunk + cut, CASE WHEN alone THEN NULL WHEN cut = 1 THEN tokens ELSE size + tokens END, run, CASE WHEN cut = 1 THEN title ELSE coalesce(title, kt) END, CASE WHEN cut = 1 OR run <> kr THEN CASE WHEN run = kr THEN large ELSE pt > most END ELSE large END, (cut = 0 AND plain) OR kind <> 'HEADING', page, root
 FROM (SELECT *, CASE WHEN size IS NULL OR alone THEN 1 WHEN st < 2 THEN CASE WHEN run = kr THEN large AND size + tokens > most ELSE large OR pt > most OR size >= target OR size + pt > most OR (size >= least AND (ptopic OR (st = 1 AND coalesce(kt <> ptitle, FALSE)))) END
   WHEN st = 4 THEN size + tokens > most OR (begins AND size >= least) ELSE plain AND (size + tokens > most OR begins OR kind = 'HEADING' OR coalesce(root <> kroot, FALSE) OR (size >= target AND page <> kp)) END::INT AS cut
  FROM (SELECT ee.*, k.chunk, k.size, k.run AS kr, k.title AS kt, k.large, k.plain, k.page AS kp, k.root AS kroot, st > 1 AND (kind = 'MIXED_VISUAL' OR (kind IN ('TABLE', 'CODE', 'FORMULA') AND tokens >= 120)) AND (st <> 4 OR tokens >= 750) AS alone FROM k JOIN ee ON ee.doc_id = k.doc_id AND ee.element = k.element + 1))),
ka AS (SELECT k.doc_id, k.chunk, min(st) AS st, list_sort(list_distinct(list(kind))) AS kinds, min(ee.page) AS page_start, max(ee.page) AS page_end, arg_min(path, k.element) AS path, count(*) AS elements, string_agg(content, chr(10) || chr(10) ORDER BY k.element) AS content FROM k JOIN ee ON ee.doc_id = k.doc_id AND ee.element = k.element GROUP BY 1, 2),
kb AS (SELECT *, list_filter(kinds, lambda x: x <> 'HEADING') AS pk, list_filter(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM ka), kc AS (SELECT *, CASE len(pk) WHEN 0 THEN 'HEADING' WHEN 1 THEN pk[1] ELSE 'MIXED' END AS kind FROM kb),
kd AS (SELECT *, st > 1 AND kind IN ('PARAGRAPH', 'MIXED') AND coalesce(lag(kind) OVER o NOT IN ('CODE', 'TABLE', 'FORMULA', 'MIXED_VISUAL') AND len(lag(w) OVER o) >= 90, FALSE) AS overlap, lag(w) OVER o AS pw FROM kc WINDOW o AS (PARTITION BY doc_id ORDER BY chunk))"""


@query(f"""WITH RECURSIVE {CHUNKED} SELECT doc_id, chunk, kind, array_to_string(kinds, ',') AS kinds, page_start, page_end, array_to_string(path, ' > ') AS path, elements, overlap, md5(CASE WHEN overlap THEN array_to_string(pw[-90:], ' ') || chr(10) || chr(10) ELSE '' END || content) AS digest FROM kd""")
def markdown_chunks(spark, sf_dir):
    # places need an order, no gapless numbers
    place = F.shiftleft(F.col("doc_id") % 12, 40) + F.col("chunk_index")
    lines = marked(spark, sf_dir).select(F.floor(F.col("doc_id") / 12).alias("doc_id"), place.alias("chunk_index"), "content")
    names = F.array(*[F.lit(s) for s in ("PAGE_AWARE", "SLIDE_AWARE", "TOPIC_AWARE", "PAPER_SECTION_AWARE", "QUESTION_AWARE", "MIXED_FALLBACK")])
    c = C.markdown_chunks(settle(M.structure(lines)).withColumn("strategy", F.get(names, (F.col("doc_id") % 6).cast("int"))))
    return c.select("doc_id", "chunk", "kind", F.array_join("kinds", ",").alias("kinds"), "page_start", "page_end", F.array_join("path", " > ").alias("path"), "elements", "overlap", F.md5("content").alias("digest"))
