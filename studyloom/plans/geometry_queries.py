"""Registered queries of page geometry: formula boxes, columns, hashes of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from .registry import CHUNKS, chunks, query, table

BITS = "u AS (SELECT vec_id AS image, list_transform(embedding, lambda x: CAST(floor((x + 1) * 127.5::DOUBLE) AS BIGINT)) AS g FROM embeddings), h AS (SELECT image, CASE WHEN len(g) = 64 THEN array_to_string(list_transform(g, lambda x: CASE WHEN x * 64 >= list_sum(g) THEN '1' ELSE '0' END), '') END AS b FROM u)"
HEX = "lpad(lower(to_hex(CAST(list_sum(list_transform(range(64), lambda k: CASE WHEN substr({0}, 64 - CAST(k AS INT), 1) = '1' THEN CAST(1 AS HUGEINT) << CAST(k AS INT) ELSE CAST(0 AS HUGEINT) END)) AS UBIGINT))), 16, '0')"


def _hashes(spark, sf_dir):
    # the sum is of the vectors' own 32 bits, as in SQL: in doubles it falls below a whole number where that reaches it
    grey = F.transform("embedding", lambda x: F.floor((x + F.lit(1.0).cast("float")).cast("double") * 127.5).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), G.average_hash(grey).alias("hash"))


@query(f"WITH {BITS} SELECT image, CASE WHEN b IS NOT NULL THEN {HEX.format('b')} END AS hash FROM h")
def average_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir)


@query(f"""WITH {BITS}, d AS (SELECT DISTINCT b, {HEX.format('b')} AS hash FROM h WHERE b IS NOT NULL), p AS (SELECT x.hash AS a, y.hash AS b, bit_count(xor(CAST(x.b AS BIT), CAST(y.b AS BIT))) AS bits FROM d x JOIN d y ON x.hash < y.hash) SELECT a, b, CAST(bits AS INTEGER) AS bits FROM p WHERE bits <= 15""")
def similar_hashes(spark, sf_dir):
    return G.similar_hashes(_hashes(spark, sf_dir), most=15)


FORMULAS = "fb AS (SELECT l_suppkey * 16 + l_orderkey % 16 AS page, CAST(l_partkey * 7 % 550 AS DOUBLE) AS x0, CAST(l_orderkey * 3 % 780 AS DOUBLE) AS y0, l_partkey * 7 % 550 + CAST(l_quantity AS DOUBLE) AS x1, l_orderkey * 3 % 780 + 6.0::DOUBLE + l_linenumber * 4 AS y1, bool_or(l_discount >= 0.09::DOUBLE) AS seed FROM lineitem GROUP BY ALL)"


def _formulas(spark, sf_dir):
    x, y = (F.col("l_partkey") * 7 % 550).cast("double"), (F.col("l_orderkey") * 3 % 780).cast("double")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 16 + F.col("l_orderkey") % 16).alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 6.0 + F.col("l_linenumber") * 4).alias("y1"), (F.col("l_discount") >= 0.09).alias("seed"))


@query(f"""WITH RECURSIVE {FORMULAS}, n AS (SELECT *, row_number() OVER (ORDER BY page, x0, y0, x1, y1) AS id FROM fb),
e AS (SELECT p.id AS a, q.id AS b FROM n p JOIN n q ON p.page = q.page AND p.id <> q.id WHERE greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) / greatest(1, least(p.y1 - p.y0, q.y1 - q.y0)) >= 0.2::DOUBLE AND greatest(p.x0, q.x0) - least(p.x1, q.x1) <= 18),
r AS (SELECT id FROM n WHERE seed UNION SELECT b FROM r JOIN e ON r.id = e.a) SELECT page, x0, y0, x1, y1, seed FROM n WHERE id IN (SELECT id FROM r)""")
def formula_fragments(spark, sf_dir):
    return G.formula_fragments(_formulas(spark, sf_dir), 600.0)


@query(None)
def formula_boxes(spark, sf_dir):
    """No SQL: what a fragment joins depends on the boxes that the ones before have made; tests hold it against brute force."""
    return G.merged_formulas(G.formula_fragments(_formulas(spark, sf_dir), 600.0), 600.0)


LAID = "lb AS (SELECT doc_id AS page, chunk_index AS block, content AS text, len(regexp_extract_all(content, '\\S+')) AS tokens, CASE WHEN chunk_index % 11 < 10 THEN CASE WHEN doc_id % 3 > 0 AND chunk_index % 7 > 0 THEN chunk_index % 2 * 320 + 10.0::DOUBLE ELSE 10.0::DOUBLE END END AS x0, (chunk_index // 2) * 40.0::DOUBLE + chunk_index % 3 AS y0, CASE WHEN chunk_index % 7 = 0 THEN 500.0::DOUBLE WHEN chunk_index % 13 = 0 THEN 330.0::DOUBLE ELSE 240.0::DOUBLE END AS w FROM c)"


@query(f"""WITH {CHUNKS}, {LAID}, b AS (SELECT *, x0 + w AS x1, y0 + 36 AS y1, x0 + w / 2 AS m, len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: regexp_matches(x, '[A-Za-z]{{2}}'))) AS l FROM lb),
s AS (SELECT *, tokens >= 10 AND l >= 8 AND l >= 0.62 * tokens AND w <= 312 AND m <= 252 AS lf, tokens >= 10 AND l >= 8 AND l >= 0.62 * tokens AND w <= 312 AND m >= 348 AS rt FROM b),
g AS (SELECT page, count(x0) AS n, count(*) FILTER (lf) AS ln, count(*) FILTER (rt) AS rn, sum(tokens) FILTER (lf) AS lt, sum(tokens) FILTER (rt) AS rtt, min(y0) FILTER (lf) AS l0, max(y1) FILTER (lf) AS l1, min(y0) FILTER (rt) AS r0, max(y1) FILTER (rt) AS r1 FROM s GROUP BY 1),
t AS (SELECT page FROM g WHERE n >= 4 AND ln > 0 AND rn > 0 AND (ln + rn >= 4 OR (lt >= 25 AND rtt >= 25)) AND greatest(0, least(l1, r1) - greatest(l0, r0)) / greatest(1, least(l1 - l0, r1 - r0)) >= 0.35::DOUBLE),
z AS (SELECT s.page, block, x0, y0, w, m, t.page IS NOT NULL AS columns, coalesce(x0 + w - x0 > 432, FALSE) AS wide FROM s LEFT JOIN t USING (page)),
a AS (SELECT *, (SELECT count(*) FROM z v WHERE v.page = z.page AND v.wide AND v.y0 < z.y0) AS above, row_number() OVER (PARTITION BY page, wide ORDER BY y0, block) - 1 AS rank FROM z)
SELECT page, CAST(block AS INTEGER) AS block, columns, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN columns AND x0 IS NULL THEN 1 ELSE 0 END, CASE WHEN columns AND x0 IS NOT NULL THEN CASE WHEN wide THEN 2 * rank ELSE 2 * above + 1 END END, CASE WHEN columns AND x0 IS NOT NULL THEN CASE WHEN wide OR m < 300 THEN 0 ELSE 1 END END, CASE WHEN columns AND x0 IS NOT NULL THEN y0 END, CASE WHEN columns AND x0 IS NOT NULL THEN x0 END, block) AS position FROM a""")
def column_order(spark, sf_dir):
    i, d = F.col("chunk_index"), F.col("doc_id")
    x0 = F.when(i % 11 < 10, F.when((d % 3 > 0) & (i % 7 > 0), i % 2 * 320 + 10.0).otherwise(10.0))
    y0 = F.floor(i / 2) * 40.0 + i % 3
    x1 = x0 + F.when(i % 7 == 0, 500.0).when(i % 13 == 0, 330.0).otherwise(240.0)
    tokens = F.size(F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0)))
    b = chunks(spark, sf_dir).select(d.alias("page"), i.alias("block"), F.lit("PARAGRAPH").alias("kind"), tokens.alias("tokens"), F.col("content").alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 36).alias("y1"))
    return G.column_order(b, 600.0)
