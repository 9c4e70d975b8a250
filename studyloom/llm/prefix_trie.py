"""A trie of conversations' turns by smallest-member ownership.

A node is a sequence of first turns; the smallest conversation that starts with it owns it. What starts with a longer sequence starts
with a shorter one, so the nodes that a conversation owns are a suffix of its path, and (owner, depth) names a node. Windows mark
owned nodes; then, on each conversation's path, windows sum the tokens of what follows, all and owned, and one group-by of prefixes
adds up over the members: tokens of all occurrences less those of owned ones, owned leaves, owned children.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle
from .merkle import CRC

#: Conversations of one base, the most turns taken over plus one, pieces of a prefix's rows, ids in one string of a hash.
FAMILY, HEADS, SALTS, PACKED = 20, 4, 32, 500
PREFIX = ["depth", "a", "b"]


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, sign, words) of each row with a conv_id: a SHA-256 of role and text in place of both."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sign = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", sign.alias("sign"), n_words(text).alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns_of() -> (conv_id, depth, sign, words): each conversation with the first h turns of its family's base for its own.

    depth counts from 1; each conversation also has a row of depth 0, the root, without sign or words. A base sends at most three turns
    to 20 conversations.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = turns.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "sign")))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("k") < HEADS)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("k", "sign", "words"))).alias("heads"))
    convs = turns.select("conv_id").distinct()
    first = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base")
    first = first.select("conv_id", F.lit(1).alias("src"), F.explode(F.slice("heads", F.lit(1), taken.cast("int"))).alias("h")).select("conv_id", "src", "h.*")
    rest = own.where(F.col("k") > taken).select("conv_id", F.lit(2).alias("src"), "k", "sign", "words")
    roots = convs.select("conv_id", F.lit(0).alias("src"), F.lit(0).alias("k"), F.lit("").alias("sign"), F.lit(0).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy("src", "k")
    return roots.unionByName(first).unionByName(rest).select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("depth"), "sign", "words")


def occurrences(turns: DataFrame) -> DataFrame:
    """rebuilt() -> (conv_id, depth, a, b, words, len): where each conversation's path comes by, and how long it is.

    a and b, 128 bits, stand for the first turns: the exclusive or of the hashes of their places and signs, a running window.
    """
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    row = turns.select("conv_id", "depth", "words", F.xxhash64(F.lit(1), "depth", "sign").alias("x"), F.xxhash64(F.lit(2), "depth", "sign").alias("y"))
    return row.select("conv_id", "depth", F.bit_xor("x").over(path).alias("a"), F.bit_xor("y").over(path).alias("b"), "words", F.max("depth").over(Window.partitionBy("conv_id")).alias("len"))


def owned(rows: DataFrame) -> DataFrame:
    """occurrences(), settled, with owner, the smallest member of the row's node, and deepest, the longest member's length.

    A prefix's rows are cut into salted pieces, as the root has every conversation. A window finds each piece's smallest member, a window
    over those the node's, which goes back to the pieces, each a small part of a hot node.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    piece, node = Window.partitionBy(*PREFIX, "salt"), Window.partitionBy(*PREFIX)
    marked = rows.withColumn("first", F.row_number().over(piece.orderBy("conv_id")) == 1).withColumn("deepest", F.max("len").over(piece))
    firsts = marked.where("first").select(*PREFIX, "salt", F.min("conv_id").over(node).alias("owner"), F.max("deepest").over(node).alias("deepest"))
    return rows.join(firsts, [*PREFIX, "salt"]).drop("salt")


def ends(rows: DataFrame) -> DataFrame:
    """(owner, depth, conv_id) of conversations that end at a node -> (conv_id, depth, ends_sha256), conv_id being the owner.

    Ids are sorted by ranges and packed into strings where they stand, so a node with very many has few rows; its hash is then fed string
    by string, in one task, as a digest takes its bytes in order, which holds one batch at a time.
    """

    def pack(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            owner, depth, ids = (pdf[c].to_numpy() for c in ("owner", "depth", "conv_id"))
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
            starts = np.array([s for lo, hi in zip([0, *cuts], [*cuts, len(ids)]) for s in range(lo, hi, PACKED)])
            until = np.minimum([*starts[1:], len(ids)], len(ids))
            texts = list(map(str, ids.tolist()))
            yield pd.DataFrame({"owner": owner[starts], "depth": depth[starts], "least": ids[starts], "ids": [",".join(texts[lo:hi]) for lo, hi in zip(starts, until)]})

    def digest(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for owner, depth, ids in zip(pdf["owner"].tolist(), pdf["depth"].tolist(), pdf["ids"]):
                if (owner, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (owner, depth), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    keys = ["owner", "depth"]
    packed = rows.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInPandas(pack, "owner long, depth long, least long, ids string")
    return packed.repartition(*keys).sortWithinPartitions(*keys, "least").mapInPandas(digest, "conv_id long, depth long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Rows without a conv_id belong to no conversation. Null roles and texts are empty ones. Null turns come first; rows of one turn are
    ordered by their hash, and equal rows are all kept. An empty table has no node, not even a root. Other columns are ignored, whatever
    their names.
    """
    rows = settle(occurrences(rebuilt(turns_of(conversations.select("conv_id", "turn", "role", "text")))))
    rows = settle(owned(rows))
    path = Window.partitionBy("conv_id").orderBy("depth")
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("owner") == F.col("conv_id")
    leaf = F.max(own & (F.col("depth") == F.col("len")) & (F.col("deepest") == F.col("len"))).over(Window.partitionBy("conv_id"))
    member = rows.select(
        *PREFIX, "owner", F.lag("owner").over(path).alias("parent"), F.coalesce(F.lead(own).over(path), F.lit(False)).cast("long").alias("child"),
        leaf.cast("long").alias("leaf"), F.sum(F.when(own, 0).otherwise(F.col("words"))).over(below).alias("saved"),
    )
    sums = member.groupBy(*PREFIX).agg(
        F.min("owner").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    ended = ends(rows.where("depth = len"))
    none = hashlib.sha256(b"").hexdigest()
    return sums.drop("a", "b").join(ended, ["conv_id", "depth"], "left").fillna(none, ["ends_sha256"])


SQL = rf"""
WITH t0 AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sign,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sign) AS k FROM t0),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {CRC.format('conv_id')} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS src, k, sign, words FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, 1, k, sign, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sign, '') OVER w AS prefix, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
o AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM p),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, max(len) AS deepest, left(prefix, 64 * (depth - 1)) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256 FROM o GROUP BY 1, 2),
s AS (SELECT left(n.prefix, 64 * d.d) AS prefix, sum((n_convs - 1) * words) AS saved, count(*) FILTER (deepest = depth) AS leaves, count(*) FILTER (depth = d.d + 1) AS children FROM n, range((SELECT max(depth) + 1 FROM n)) d(d) WHERE d.d <= depth GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.prefix = n.prefix LEFT JOIN n u ON n.depth > 0 AND u.prefix = n.up
"""
