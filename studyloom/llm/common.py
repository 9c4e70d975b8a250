"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables that were settled inside; what is wanted of them has to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The table stays until the end of the innermost scratch() around the call, else for good.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/studyloom-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_to_all(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A settled table with the hint to broadcast it, if it has no more rows than that; else Spark chooses how to join it."""
    return F.broadcast(df) if df.count() <= most else df


#: Bits for each value of may_hold, and the most it has for all (as a power of two), which is 8 MB.
BITS_EACH, MOST_BITS = 16, 26


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """A test by a Bloom filter: true for each value that ids (one column, settled) has, and seldom for others; it lets rows go before a join moves them.

    Its bits are set by an aggregation and have a fixed limit; with more ids than it is made for, only more other values pass.
    """
    spark, (name,) = ids.sparkSession, ids.columns
    size = 1 << min(MOST_BITS, max(15, (BITS_EACH * ids.count()).bit_length()))
    spots = lambda c: [F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(size - 1)) for k in range(3)]
    flat = ids.select(F.explode(F.array(*spots(F.col(name)))).alias("at"))
    pages = flat.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(size >> 3, np.uint8)
    for page, own in pages.collect():
        bits[page << 12 : (page + 1) << 12] = np.frombuffer(own, np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        ok = np.ones(len(a), bool)
        for at in (x.to_numpy() for x in (a, b, c)):
            ok &= (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return lambda c: test(*spots(c))


def placed(rows: DataFrame, group: str, order: list[str], weight: str | None = None) -> DataFrame:
    """rows, settled, with long columns i and n: the gapless place from 0 in its group by order, and the group's rows.

    With weight (a long column, never null) also before and total: the weight of the rows ahead in the group, and the group's.
    Rows are dealt by ranges of (group, order), so a group of any size is cut into pieces; only pieces are numbered together, at most
    one for each group and range. Rows of equal order need a last column that tells them apart, else they share a range. rows must come
    from a settled table, as ranges are found by reading it once more, and has none of these names nor one that starts with __.
    """
    far = 1 << 33  # a task numbers its rows from its own multiple of this
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    if weight:
        inside = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    dealt = settle(dealt).withColumn("__part", F.floor(F.col("__at") / far))
    sums = [F.min("__at").alias("__first"), F.count("*").alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    whole = Window.partitionBy(group)
    ahead = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    more = [F.coalesce(F.sum("__w").over(ahead), zero).alias("__w_ahead"), F.sum("__w").over(whole).alias("total")] if weight else []
    pieces = dealt.groupBy(group, "__part").agg(*sums)
    pieces = settle(pieces.select(group, "__part", (F.coalesce(F.sum("__n").over(ahead), zero) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"), *more))
    if weight:
        dealt = dealt.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), zero))
    out = dealt.join(sent_to_all(pieces), [group, "__part"])
    kept = [*rows.columns, (F.col("__at") + F.col("__shift")).alias("i"), "n"]
    return out.select(*kept, *([(F.col("__w_ahead") + F.col("__inside")).alias("before"), "total"] if weight else []))


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that body can use it many times while it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and tab to carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def star_forest(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, component), component the least node; nodes without edges are absent.

    Alternating large-star and small-star rounds, each one plan that ends in the shared folder: its shuffles are few, and both
    uses of a shuffled table share it. No link or component reaches the driver, only whether a node doesn't yet hang directly on its root.
    """
    cur = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cur.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v")
        # a node also links to the least node of its own neighbourhood
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        cur = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = cur.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(cur.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if seen.groupBy("x").agg(F.sum("down").alias("d"), F.max("up").alias("p")).where("d > 1 OR (d > 0 AND p > 0)").isEmpty():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed string; bytes of equal rank are a block, which has a code of its own, so small numbers cost little."""
    out = zstandard.ZstdCompressor(level=1).compressobj()
    parts = [out.compress(np.array([len(arrays), *map(len, arrays)], np.int64).tobytes())]
    for a in arrays:
        for plane in np.ascontiguousarray(np.asarray(a).astype(np.int64).view(np.uint8).reshape(-1, 8).T):
            parts += [out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK), out.compress(plane.tobytes())]
    return b"".join([*parts, out.flush()])


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int64, count, 8)
    out, at = [], 8 * (count + 1)
    for n in lengths.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel())
        at += 8 * n
    return out


def narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, without compression."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<i8").ravel()


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of equal key from batches that are sorted by it; holds one run at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[lo:hi]
            if held and held[-1][key].iloc[-1] != values[lo]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser; each salt gives another order of the same tokens."""
    x = x.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
