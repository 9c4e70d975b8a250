"""A stored inverted index with block maxima, and exact top-k search in it.

A task deals the texts that it reads into blocks of like length, as a text's score is a sum over its words, and counts each block's
words where they are: building shuffles nothing. A posting row holds one term in one block: which of its texts have it, what it counts in
each, and the most it counts in any. A frequent term is thus many rows of bounded size. A search adds up the maxima of a query's
terms by block, scores the most promising blocks in full, and of the others only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import half_up, preview
from ..sources.shared import settle
from .retrieval import query_terms, top, words_of

#: Folders that terms are dealt into, texts of a block and their bytes, query terms that meet the index at once, blocks scored before any is left out.
BUCKETS, BLOCK, BLOCK_BYTES, TERMS, AHEAD = 8, 1024, 4 << 20, 200_000, 2
#: Characters that Java and Arrow may lower or take for letters differently, as their Unicode differs (İ and Σ by rule); else they agree. Texts with such a one are split by Spark.
ODD = r"\x{130}\x{3A3}\x{530}-\x{1FFF}\x{2070}-\x{10FFFF}"
#: Characters that part words: ASCII ones, as bytes that become a space, and all the others.
SPACES = bytes(b if b >= 128 or chr(b).isalnum() or b == ord("_") else 32 for b in range(256))
BETWEEN = rf"[^\x00-\x{{7F}}\p{{L}}\p{{N}}{ODD}]"
POSTINGS = "block long, term string, n int, most_a int, most_b int, docs array<int>, a array<int>, b array<int>"


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts in lower case with spaces for what is in no word; what Spark has split stays."""
    texts = pc.if_else(pc.match_substring_regex(texts, f"[{ODD}]"), texts, pc.utf8_lower(texts))
    if texts.buffers()[2] is None:
        return texts
    seen, places, data = texts.buffers()
    texts = pa.StringArray.from_buffers(len(texts), places, pa.py_buffer(data.to_pybytes().translate(SPACES)), seen, texts.null_count, texts.offset)
    more = pc.match_substring_regex(texts, BETWEEN)
    return pc.replace_with_mask(texts, more, pc.replace_substring_regex(texts.filter(more), BETWEEN, " "))


def _block(ids: pa.Array, texts: list[pa.Array], number: int, kind: pa.DataType) -> pa.RecordBatch:
    """The postings of one block: a row for each term, its texts as places in the block, and a row without a term for the ids in their places. texts: whole ones and heads."""
    words = pa.chunked_array([pc.split_pattern(_spaced(t), " ") for t in texts]).combine_chunks()
    coded = words.flatten().dictionary_encode()
    d, terms, place, names = len(ids), coded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(words).to_numpy(), coded.dictionary.cast(pa.string())
    word = pc.greater_equal(pc.utf8_length(names), 2).to_numpy(zero_copy_only=False)[terms]
    terms, place = terms[word], place[word]
    weight = place < d
    keys, inverse = np.unique(terms * d + place % d, return_inverse=True)
    a = np.bincount(inverse, weight, len(keys)).astype(np.int32)
    b = np.bincount(inverse, ~weight, len(keys)).astype(np.int32)
    term, doc = keys // d, (keys % d).astype(np.int32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(keys)]]).astype(np.int32) if len(keys) else np.zeros(1, np.int32)
    most = lambda x: np.maximum.reduceat(x, starts[:-1]) if len(keys) else x
    array = lambda x: pa.ListArray.from_arrays(pa.array(starts), pa.array(x, pa.int32()))
    count = np.diff(starts).astype(np.int32)
    columns = [pa.array(np.full(len(count), number)), names.take(pa.array(term[starts[:-1]])), pa.array(count), pa.array(most(a)), pa.array(most(b)), array(doc), array(a), array(b)]
    columns = [pa.concat_arrays([c, pa.array([number if k == 0 else None], c.type)]) for k, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([*[None] * len(count), ids.to_pylist()], pa.list_(kind))], ["block", "term", "n", "most_a", "most_b", "docs", "a", "b", "ids"])


def _blocks(batch: pa.RecordBatch, size: int, most: int) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """The ids and [texts, heads] of a batch of texts in blocks of so many texts and bytes of both at most (one text may have more), longest texts first; a block's texts are sorted by id."""
    ids, texts = batch.column(0), batch.columns[1:]
    keys, length = ids.to_pylist(), sum(pc.binary_length(t).to_numpy().astype(np.int64) for t in texts)
    order = sorted(range(len(keys)), key=lambda k: (-length[k], keys[k]))
    lo = 0
    while lo < len(order):
        within = np.searchsorted(np.cumsum(length[order[lo : lo + size]]), most, side="right")
        part = pa.array(sorted(order[lo : lo + max(1, int(within))], key=lambda k: keys[k]))
        yield ids.take(part), [t.take(part) for t in texts]
        lo += len(part)


def build(texts: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """texts(id, text), ids unique -> rows(bucket, block, term, n, most_a, most_b, docs, a, b, ids) under path; bucket -1 has the blocks' ids.

    docs are places in the block; a and b say how often the term is in the text and in its preview. Null and empty texts have no
    postings. Texts are split into words and counted as arrays, one block at a time: a task holds its batch and one block, which
    has BLOCK_BYTES at most but for a text that has more. Ids are strings or integers.
    """
    plain = lambda t: F.when((F.octet_length(t) > F.length(t)) & t.rlike(f"[{ODD}]"), F.array_join(words_of(t), " ")).otherwise(t)
    rows = texts.where("text IS NOT NULL AND id IS NOT NULL").select("id", plain(F.col("text")).alias("texts"), plain(preview(F.col("text"))).alias("heads"))
    kind = dict(texts.dtypes)["id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def counted(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for ids, split in _blocks(batch, block, BLOCK_BYTES):
                yield _block(ids, split, number, arrow)
                number += 1

    found = rows.mapInArrow(counted, f"{POSTINGS}, ids array<{kind}>").withColumn("bucket", F.coalesce(_bucket(F.col("term"), buckets), F.lit(-1)))
    found.sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def open_index(spark: SparkSession, path: str, kind: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """The postings, and (block, doc, id). kind: the type of the ids."""
    rows = spark.read.schema(f"{POSTINGS}, ids array<{kind}>, bucket int").parquet(path)
    return rows.where("bucket >= 0").drop("ids"), rows.where("bucket = -1").select("block", F.posexplode("ids").alias("doc", "id"))


def statistics(postings: DataFrame) -> DataFrame:
    """(term, n, a, most): texts that have each term, its places in all of them, and the most in one.

    What only the cut at a preview's end has made a word is no term of a text.
    """
    n = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + (x > 0).cast("long"))
    a = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x)
    return postings.where("most_a > 0").groupBy("term").agg(F.sum(n).alias("n"), F.sum(a).alias("a"), F.max("most_a").alias("most"))


def score(a: Column, b: Column) -> Column:
    """A term counts 1 in a text and 0.4 more in its preview; x / (1 + x) twice."""
    x = a + 0.4 * b
    y = x / (1 + x)
    return half_up(y / (1 + y), 6)


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """queries(query_id, query) -> (query_id, id, score, rank): the k best texts with any of a query's terms, ties by id; exact.

    index comes from open_index, buckets is what it was built with. Queries meet the postings in sets of a bounded number of terms, broadcast;
    the texts are not read.
    """
    terms = settle(queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets)))
    sets = max(1, -(-terms.count() // TERMS))
    best = None
    for s in range(sets):
        mine = F.broadcast(terms.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == s))
        found = _search(*index, mine, k)
        best = found if best is None else best.unionByName(found)
    return best


def _search(postings: DataFrame, members: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    keys = ["query_id", "block"]
    met = postings.select("bucket", "term", "block", "most_a", "most_b").join(terms, ["bucket", "term"])
    bound = met.groupBy(*keys).agg(F.sum("most_a").alias("a"), F.sum("most_b").alias("b")).select(*keys, score(F.col("a"), F.col("b")).alias("bound"))
    bound = settle(bound)

    def scored(blocks: DataFrame) -> DataFrame:
        rows = postings.select("bucket", "term", "block", "docs", "a", "b").join(terms, ["bucket", "term"]).join(blocks.select(*keys), keys)
        sums = rows.select(*keys, F.explode(F.arrays_zip("docs", "a", "b")).alias("d")).groupBy(*keys, F.col("d.docs").alias("doc")).agg(F.sum("d.a").alias("a"), F.sum("d.b").alias("b"))
        named = sums.select(*keys, "doc", score(F.col("a"), F.col("b")).alias("score")).join(members, ["block", "doc"])
        return top(named.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.col("id")], k)

    ahead = settle(top(bound, ["query_id"], [F.desc("bound"), F.col("block")], AHEAD, "place"))
    first = settle(scored(ahead))
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # scores are rounded to six places, so a bound that is less by more than that can't reach the k-th
    rest = bound.join(ahead.select(*keys), keys, "left_anti").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6))
    return top(first.drop("rank").unionByName(scored(rest).drop("rank")), ["query_id"], [F.desc("score"), F.col("id")], k)
