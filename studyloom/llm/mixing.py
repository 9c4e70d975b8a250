"""Mixing sources to target weights, in blocks dealt by a multivariate-hypergeometric splitting tree.

A source's documents, in a fixed pseudo-random order, make one stream of words, which is cut in blocks of
BLOCK_WORDS (doubled for very large mixes). A source's target is a number of blocks: whole passes over its stream, and then a part of one more. The
blocks of all sources are split over the output shards by a tree: each node deals its blocks, by source, to its
two halves as a draw without replacement would, so every shard gets exact quotas that fit together.
Quotas turn into ranges of each source's permuted blocks, and inside a shard the blocks' pieces are
shuffled by a hash. Only sums by (source, bucket) and by (shard, source) are ever gathered, not documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 1024
BUCKETS = 1024
#: A shard has about SHARD_BLOCKS blocks; LEAST_SHARDS and MOST_SHARDS bound their number, so shards may be smaller or larger.
SHARD_BLOCKS = 4096
LEAST_SHARDS, MOST_SHARDS = 16, 4096
#: The quotas are drawn from fewer blocks than this; the unit of a block doubles until there are.
MOST_BLOCKS = 1 << 29
SEED = 20


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> with target: total * weight / weights, capped at MOST sizes, the excess reshared by weight."""
    total, weights = Window.partitionBy(), Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(rank) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("total", F.sum("source_size").over(total).cast("double")).withColumn("all", F.sum("weight").over(weights))
    # sources in the order in which a rising level (words per unit of weight) reaches their caps
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(total)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _key() -> Column:
    """Orders a source's documents: a digest of the id, the same in any SQL dialect."""
    return F.md5(F.concat_ws("-", F.lit(str(SEED)), F.col("doc_id").cast("string")))


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document's place in its source's stream of words (doc_id, source, size, at), and sources with targets.

    Null texts have size 0; a null source is one source; rows of one id follow each other by size and text; an empty table gives two empty ones.
    """
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("tie"), _key().alias("order"))
    sized = settle(sized.withColumn("bucket", (F.conv(F.substring("order", 1, 5), 16, 10).cast("long") * BUCKETS / (1 << 20)).cast("int")))
    sums = settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = settle(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    start = sums.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    placed = sized.join(settle(start), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("at", F.col("start") + inside - F.col("size")).select("doc_id", "source", "size", "at", "order"), goal


def split_tree(counts: dict[int, int], shards: int, seed: int = SEED) -> pd.DataFrame:
    """Blocks by source -> (shard, source, quota): from the root, each node draws what its left half gets."""
    names = list(counts)
    out: list[tuple[int, int, int]] = []
    stack = [(0, shards, np.array([counts[k] for k in names], np.int64))]
    while stack:
        lo, n, have = stack.pop()
        if n == 1:
            out += [(lo, k, int(c)) for k, c in zip(names, have) if c]
            continue
        total, left = int(have.sum()), n // 2
        draw = np.random.default_rng([seed, lo, n]).multivariate_hypergeometric(have, total * left // n, method="marginals") if total else have * 0
        stack += [(lo, left, draw), (lo + left, n - left, have - draw)]
    return pd.DataFrame(out, columns=["shard", "sid", "quota"]).astype("int64")


def unit(targets: list[int]) -> int:
    """Words of a block."""
    words = BLOCK_WORDS
    while sum(-(-t // words) for t in targets) >= MOST_BLOCKS:
        words *= 2
    return words


def pieces(placed: DataFrame, goal: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself, from streams(): (shard, position, doc_id, source, at, pass, block, start, words).

    start is the place in the document of a piece's first word. Blocks of a source are permuted by an affine map; a shard takes the next ones of each source
    that its quota names, so no block is in two shards. position puts a shard's blocks in random order. The driver holds the sources and the quotas. Rows of size 0 have no piece; nothing to mix gives no rows.
    """
    spark = placed.sparkSession
    sources = [r for r in goal.orderBy(F.col("source").asc_nulls_last()).collect() if r.source_size]
    goal_words = [round(r.target) for r in sources]
    size = unit(goal_words)
    counts = {k: -(-w // size) for k, w in enumerate(goal_words)}
    total = sum(counts.values())
    shards = max(1, min(shards or min(MOST_SHARDS, max(LEAST_SHARDS, -(-total // SHARD_BLOCKS))), total))
    quotas = spark.createDataFrame(split_tree(counts, shards), "shard long, sid long, quota long")
    upto = F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))
    quotas = quotas.select("shard", F.col("sid").alias("qs"), (upto - F.col("quota")).alias("first"), upto.alias("last")).where("first < last")
    # each range once for each stretch of slots that it touches, so that the join below is on equal stretches
    quotas = quotas.withColumn("qc", F.explode(F.sequence(F.floor(F.col("first") / SHARD_BLOCKS), F.floor((F.col("last") - 1) / SHARD_BLOCKS))))
    # an affine permutation of 0 .. count-1: a step that shares no factor with the count
    step = {k: next(x for x in range(max(1, int(0.618 * n)), 2 * n + 2) if np.gcd(x, n) == 1) for k, n in counts.items()}
    rows = [(k, r.source, r.source_size, w, counts[k], step[k], (SEED * 7919 + k) % counts[k]) for k, (r, w) in enumerate(zip(sources, goal_words)) if counts[k]]
    known = spark.createDataFrame(rows, "sid long, name string, length long, want long, count long, step long, shift long")
    rows = placed.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("name")))
    # a document once for each pass that reaches it, then once for each block that it touches
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("want"), F.lit(1)) - 1) / F.col("length")))))
    rows = rows.withColumn("lo", F.col("pass") * F.col("length") + F.col("at")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("want"))).where("lo < hi")
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    rows = rows.withColumn("from", F.greatest(F.col("lo"), F.col("block") * size)).withColumn("to", F.least(F.col("hi"), (F.col("block") + 1) * size))
    rows = rows.withColumn("slot", F.pmod(F.col("block") * F.col("step") + F.col("shift"), "count"))
    rows = rows.join(quotas, (F.col("sid") == F.col("qs")) & (F.floor(F.col("slot") / SHARD_BLOCKS) == F.col("qc")) & (F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("last")))
    spot = F.xxhash64("shard", "sid", "block", F.lit(SEED))
    return rows.select("shard", spot.alias("position"), "doc_id", "source", "at", "pass", "block", (F.col("from") - F.col("lo")).alias("start"), (F.col("to") - F.col("from")).alias("words"))


def shuffled(dealt: DataFrame) -> DataFrame:
    """pieces() as the shards' own order: all pieces of a shard in one partition, its blocks by position, a block's pieces by their place in the stream."""
    return dealt.repartition("shard").sortWithinPartitions("shard", "position", "source", "block", "pass", "at")


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, size, source_size, target, taken, pieces), a row for each; pieces is the number of blocks' parts that it is taken in.

    Null texts have size 0 and are never taken; a null source is one source, ranked last. Null and repeated ids are
    ordered by size and text, so reruns agree. An empty table gives an empty result.
    """
    placed, goal = streams(docs)
    placed = settle(placed)
    words = pieces(placed, goal).groupBy("source", "at").agg(F.sum("words").alias("words"), F.count("*").alias("pieces"))
    words = settle(words.select(F.col("source").alias("ws"), F.col("at").alias("wa"), "words", "pieces"))
    got = placed.join(words, F.col("source").eqNullSafe(F.col("ws")) & (F.col("at") == F.col("wa")) & (F.col("size") > 0), "left")
    got = got.join(goal.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return got.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.lit(0)).alias("pieces"))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text, md5(concat_ws('-', '{SEED}', CAST(doc_id AS VARCHAR))) AS k,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM w WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(f.level * weight, cap)) AS target FROM l, f),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS pos FROM sized)
SELECT doc_id, size, source_size, target,
  CAST(floor(target / greatest(source_size, 1)) * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - CAST(floor(target / greatest(source_size, 1)) AS BIGINT) * source_size - pos)) AS BIGINT) AS taken,
  CAST(CASE WHEN size = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(0, 1 + CAST(floor(target / source_size) AS BIGINT)), lambda k:
    CASE WHEN k * source_size + pos < CAST(round(target) AS BIGINT) THEN (least(k * source_size + pos + size, CAST(round(target) AS BIGINT)) - 1) // {BLOCK_WORDS} - (k * source_size + pos) // {BLOCK_WORDS} + 1 ELSE 0 END)), 0) END AS BIGINT) AS pieces
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
