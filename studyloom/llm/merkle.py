"""A Merkle manifest of a dataset: a tree over each source's leaves, and one over the sources' roots.

A parent is stored as its preimage, the concatenated hashes of its children. Five levels stand in one row, a block of 243 nodes, so
a leaf joins its block once and gets the preimages of all its ancestors. It excises its own 64 characters of each for its siblings
(the proof), and splices the hash it has into each to fold up to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, placed, settle

#: Children of a parent, levels in a block, hex digits of a hash.
WIDTH, LEVELS, DIGITS = 3, 5, 64
BLOCK = WIDTH**LEVELS
STEPS = "array<struct<pre:string,slot:int>>"


def encoded(value: Column) -> Column:
    """"-" for null, else the bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def leaves(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """Settled (doc_id, grp, leaf, found_leaf, tie) of each row. found: the text as it is found now, the row's own if not given.

    grp is the source as a string that sorts as sources do, null before all. Hashes leave the texts behind: nothing else is shuffled.
    """
    leaf = leaf_hash(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("grp"), leaf.alias("leaf"), (leaf if found is None else leaf_hash(found)).alias("found_leaf"))
    return settle(rows.withColumn("tie", F.monotonically_increasing_id()))


def _levels(n: Column) -> Column:
    """How many levels a block of a group of n nodes has: as many as it takes to one node, five at most."""
    return sum((n > WIDTH**k).cast("int") for k in range(LEVELS))


def _preimages(hashes: Column, levels: Column) -> Column:
    """The preimages of a block's parents, level by level, as an array of arrays."""

    def parents(nodes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int")), lambda p: F.array_join(F.slice(nodes, p * WIDTH + 1, WIDTH), ""))

    def level(acc: Column, _: Column) -> Column:
        nodes = F.when(F.size(acc) == 0, hashes).otherwise(F.transform(F.get(acc, F.size(acc) - 1), lambda p: F.sha2(p, 256)))
        return F.concat(acc, F.array(let(nodes, parents)))

    return F.aggregate(F.slice(F.array(*map(F.lit, range(LEVELS))), 1, levels), F.array().cast("array<array<string>>"), level)


def _upper(n: Column) -> Column:
    return F.floor((n + BLOCK - 1) / BLOCK).cast("long")


def _block(i: Column) -> Column:
    return F.floor(i / BLOCK).cast("long")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes(grp, i, n, h) -> the stored blocks(grp, block, n, pre, top) from the lowest up, and each group's root (grp, h).

    A block has 243 nodes at most, whatever the group's size; a group that is down to one node goes on as it is.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    stored = []
    while True:
        met = nodes.groupBy("grp", _block(F.col("i")).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "h"))).alias("hs"))
        met = met.select("grp", "block", "n", F.transform("hs", lambda x: x["h"]).alias("hs"))
        met = met.withColumn("pre", _preimages(F.col("hs"), _levels(F.col("n"))))
        top = F.when(F.size("pre") == 0, F.get("hs", F.lit(0))).otherwise(F.sha2(F.get(F.get("pre", F.size("pre") - 1), F.lit(0)), 256))
        stored.append(settle(met.select("grp", "block", "n", "pre", top.alias("top"))))
        nodes = stored[-1].select("grp", F.col("block").alias("i"), _upper(F.col("n")).alias("n"), F.col("top").alias("h"))
        most = -(-most // BLOCK)
        if most <= 1:
            return stored, nodes.select("grp", "h")


def _steps(pre: Column, place: Column) -> Column:
    """The ancestors of the node at a place of a block: their preimages, and which slot of each is the node's own side."""
    power = lambda k: F.get(F.array(*[F.lit(WIDTH**e) for e in range(LEVELS + 1)]), k)
    up = lambda k: F.floor(place / power(k)).cast("int")
    return F.transform(pre, lambda p, k: F.struct(F.get(p, up(k + 1)).alias("pre"), (up(k) % WIDTH).alias("slot")))


def paths(stored: list[DataFrame], above: DataFrame) -> DataFrame:
    """above(grp, steps, ...): the steps from each group's root on -> (grp, block, pre, steps, ...) of the lowest blocks.

    From the top down, a block takes over the steps of the one above it, which 243 blocks share at most.
    """
    rest = [c for c in above.columns if c not in ("grp", "steps")]
    higher = stored[-1].select("grp", "block", "pre").join(above, "grp")
    for blocks in stored[-2::-1]:
        up = higher.select("grp", F.col("block").alias("up"), F.col("pre").alias("up_pre"), F.col("steps").alias("up_steps"), *rest)
        mine = blocks.select("grp", "block", "pre", _block(F.col("block")).alias("up")).join(up, ["grp", "up"])
        higher = mine.select("grp", "block", "pre", F.concat(_steps(F.col("up_pre"), F.col("block") % BLOCK), "up_steps").alias("steps"), *rest)
    return higher


def with_steps(nodes: DataFrame, lowest: DataFrame) -> DataFrame:
    """nodes(grp, i, ...) with steps, all its ancestors' preimages from its parent to the root, and what else lowest has."""
    met = nodes.withColumn("block", _block(F.col("i"))).join(lowest.withColumnRenamed("steps", "above"), ["grp", "block"])
    return met.withColumn("steps", F.concat(_steps(F.col("pre"), F.col("i") % BLOCK), "above")).drop("block", "pre", "above")


def excised(steps: Column) -> Column:
    """The siblings' hashes from the leaf's run to the root, each run from left to right, as one string."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.substring(s["pre"], F.lit(1), s["slot"] * DIGITS), F.substring(s["pre"], s["slot"] * DIGITS + DIGITS + 1, F.lit(WIDTH * DIGITS)))), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's hash gives with the siblings that its ancestors' preimages hold."""

    def splice(node: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.substring(s["pre"], F.lit(1), s["slot"] * DIGITS), node, F.substring(s["pre"], s["slot"] * DIGITS + DIGITS + 1, F.lit(WIDTH * DIGITS))), 256)

    return F.aggregate(steps, leaf, splice)


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs(doc_id, source, lang, n_chars, text).

    found: the text as it is found now; a row is verified if the hash it gives, folded with the stored siblings, gives the root.
    Leaves ascend by doc_id, null first; rows of one doc_id by their hash, and rows that are equal have each a leaf of their own. Nulls
    in any column are encoded as such, an empty text as such; a null source is one source. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    rows = leaves(docs.select("doc_id", "source", "lang", "n_chars", "text"), found)
    rows = settle(placed(rows, "grp", ["doc_id", "leaf", "tie"]))
    stored, subroots = tree(rows.select("grp", "i", "n", F.col("leaf").alias("h")))
    # the sources' roots as the leaves of one more tree, whose only group is ""
    tops = settle(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "h"))
    tops = settle(placed(tops, "grp", ["source"]))
    over, root = tree(tops.select("grp", "i", "n", "h"))
    top = paths(over, root.select("grp", F.col("h").alias("root"), F.array().cast(STEPS).alias("steps")))
    sources = with_steps(tops, top).select(F.col("source").alias("grp"), F.col("h").alias("subroot"), "root", "steps")
    met = with_steps(rows, paths(stored, sources))
    out = met.select("doc_id", "leaf", "subroot", "root", F.sha2(excised(F.col("steps")), 256).alias("proof_sha256"), folded(F.col("found_leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered() -> Column:
    """The text without its line feeds where 2 divides the unsigned crc32 of the decimal doc_id; rows without an id are left alone."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


#: The checksum of a decimal number {0}, byte by byte and bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda z: ascii(z)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"


def _enc(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, {_enc('doc_id')} || {_enc('source')} || {_enc('lang')} || {_enc('n_chars')} AS head, text,
    CASE WHEN {CRC.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
l AS (SELECT doc_id, grp, sha256(head || {_enc('text')}) AS leaf, sha256(head || {_enc('found')}) AS found_leaf FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM l),
t AS (SELECT grp, 0 AS lv, i, n, leaf AS h, '' AS pre FROM o
  UNION ALL SELECT grp, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i) FROM t WHERE n > 1 GROUP BY grp, lv, i // 3, n),
s AS (SELECT grp, lv, h, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, i, n, h, '' AS pre FROM s
  UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i) FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
p AS (SELECT s.grp AS grp, t.lv AS lv, t.i AS i, t.pre AS pre FROM t JOIN s USING (grp) WHERE t.lv > 0
  UNION ALL SELECT s.grp, s.lv + u.lv, s.i // CAST(3 ** u.lv AS BIGINT), u.pre FROM u, s WHERE u.lv > 0 AND u.i = s.i // CAST(3 ** u.lv AS BIGINT)),
f AS (SELECT o.doc_id, o.leaf, o.found_leaf, o.grp, CASE WHEN s.lv = 0 THEN s.i ELSE o.i END AS i, s.i AS si, s.lv AS top, 0 AS lv, o.found_leaf AS cur, '' AS proof FROM o JOIN s USING (grp)
  UNION ALL SELECT f.doc_id, f.leaf, f.found_leaf, f.grp, CASE WHEN f.lv + 1 = f.top THEN f.si ELSE f.i // 3 END, f.si, f.top, f.lv + 1,
    sha256(left(p.pre, 64 * (f.i % 3)) || f.cur || substr(p.pre, 64 * (f.i % 3) + 65)), f.proof || left(p.pre, 64 * (f.i % 3)) || substr(p.pre, 64 * (f.i % 3) + 65)
  FROM f JOIN p ON p.grp = f.grp AND p.lv = f.lv + 1 AND p.i = f.i // 3),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT f.doc_id, f.leaf, s.h AS subroot, root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root AS verified
FROM f JOIN s USING (grp), r WHERE f.lv = s.lv + (SELECT max(lv) FROM u)
"""
