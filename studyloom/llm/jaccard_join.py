"""Exact n-gram Jaccard join by prefix filters under several global token orders.

Plan, with the data that each step moves:

1. One row a document: a digest of its word sequence (of its first window, if that is its only shingle) and its
   number of shingles. Documents of one digest have one set, so they are one node of the join, however many there are.
2. Of each row only the first shingles by hash are sent at first, 40 bits of each: as many as hold some common ones with any partner.
   Rows of which too few are sent by any other row too have no partner. Only texts of the other nodes move, as a Bloom filter
   of bounded size lets most of the rest go where they are read.
3. These texts become shingle hashes (56 of 64 bits travel). Each task sends them sorted and packed to the range of
   hashes that they fall in; there it is counted in how many nodes each occurs. A node is sent as its place in its chunk of about a
   million shingles, and the chunk's nodes travel once, however many ranges there are. A shingle that HOT nodes or more of one
   chunk have is only sent as a count, as its answer is known; so no shingle brings more than HOT rows a chunk
   to one task. Only shingles of two nodes or more go back, packed again, to their chunk.
4. A node can only have a partner if ceil(0.85 n) of its n shingles occur elsewhere. For those
   that remain the prefix of n - ceil(0.85 n) + 1 shingles is taken under three global orders (all put the
   shingles without partner first; then by rising frequency, counted up to HOT, or by one of two hashes).
5. Nodes that share enough shingles of a somewhat longer prefix under the first order form clusters. In a large cluster all nodes first meet a block of pivots,
   which costs rows in proportion to its size; what the pivots join needs no more comparing among itself. What is left is dealt in
   blocks, and a task gets one pair of blocks of different pieces. Pairs that share a prefix shingle under every
   order are verified by their common shingles. A task returns a spanning forest of the links, not all pairs.
6. Connected components of these forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import may_hold, mix64, narrow, pack, runs, settle, star_forest, unpack, wide

#: Bits of a shingle's hash that are sent; sizes of sets are counted with all 64.
HASH_BITS = 56
HOT = 16
BLOCK = 64
#: Nodes from which a cluster meets pivots first, and how many times.
LARGE = 256
PIVOT_ROUNDS = 1
#: Bytes of a shingle's hash that are sent at first, and how many common shingles (in percent of a set's size) the first ones hold.
HEAD_BYTES, HEAD_SHARE = 5, 10
#: How many common shingles (in percent of a set's size) the prefixes hold by which nodes become clusters.
LINK_SHARE = 3
#: Ranges of shingles, at least, and about how many shingles a chunk of nodes has.
LEAST_PARTS = 256
CHUNK_SHINGLES = 1_000_000


def folded_words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and bytes.split() splits at space and tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; the whole sequence is one shingle if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mix64(out ^ h[k : k + len(out)], 2 * k + 1)
    return np.unique(out)


def set_key(words: list[bytes], n: int, size: int) -> bytes:
    """One shingle: one word over and over, however often; its first window stands for the set."""
    return hashlib.md5(b" ".join(words[:size] if n == 1 else words)).digest()


def need(n, percent: int):
    """Least number of common shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _held(n, share: int = HEAD_SHARE):
    """How many common shingles of a set of n and a partner of its size at least are among the first ones of both."""
    return -(-share * n // 100)


def _digests(size: int, percent: int):
    """heads: the first shingles of a set by hash, by low bytes. The k-th common one of two sets is the n - need(n) + k-th of each at most."""

    def heads(s: np.ndarray) -> bytes:
        return narrow(s[: len(s) - need(len(s), percent) + _held(len(s))], HEAD_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = folded_words(text)
                s = shingles(words, size)
                rows.append((set_key(words, len(s), size), len(s), heads(s)))
            out = pd.DataFrame(rows, columns=["key", "n", "heads"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "key", "n", "heads"]]

    return run


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in a sorted array, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _own_part(chunk: int, parts: int) -> int:
    return int(mix64(np.array([chunk]), 7)[0] % np.uint64(parts))


def _head_requests(percent: int, parts: int):
    """From rows (doc_id, n, heads): rows (part, chunk, told, blob). A blob of told = false has a chunk's heads of a range in order: those that one row
    has once, each one's place, and those that are there more often. That of told = true has the chunk's ids, and how many more shared heads each needs."""

    def flush(chunk: int, held: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bool, bytes]]:
        tokens = wide(b"".join(h for _, _, h in held), HEAD_BYTES)
        place = np.repeat(np.arange(len(held)), [len(h) // HEAD_BYTES for _, _, h in held])
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        starts, times = _runs(tokens)
        shared = np.bincount(place[np.repeat(times > 1, times)], minlength=len(held))
        # a partner has need(n) shingles at least
        left = _held(need(np.array([n for _, n, _ in held], np.int64), percent)) - shared
        rows = [(_own_part(chunk, parts), chunk, True, pack(np.array([i for i, _, _ in held], np.int64), left))]
        once, place, more = tokens[starts[times == 1]], place[starts[times == 1]], tokens[starts[times > 1]]
        edges = [(p << 8 * HEAD_BYTES) // parts for p in range(parts + 1)]
        cuts, more_cuts = np.searchsorted(once, edges), np.searchsorted(more, edges)
        for p in range(parts):
            t, d, m = once[cuts[p] : cuts[p + 1]], place[cuts[p] : cuts[p + 1]], more[more_cuts[p] : more_cuts[p + 1]]
            if len(t) or len(m):
                rows.append((p, chunk, False, pack(np.diff(t, prepend=edges[p]), d, np.diff(m, prepend=edges[p]))))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        chunk = TaskContext.get().partitionId() << 32
        frame = lambda rows: pd.DataFrame(rows, columns=["part", "chunk", "told", "blob"])
        for pdf in batches:
            for row in zip(pdf["doc_id"].tolist(), pdf["n"].tolist(), pdf["heads"]):
                held.append(row)
                total += len(row[2]) // HEAD_BYTES
                if total >= CHUNK_SHINGLES:
                    yield frame(flush(chunk, held))
                    held, total, chunk = [], 0, chunk + 1
        if held:
            yield frame(flush(chunk, held))

    return run


def _head_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """From all heads of a range: of each chunk the places of those that another chunk has too."""
    rows, chunk, token, place, more = [], [], [], [], [np.empty(0, np.int64)]
    for c, told, blob in zip(pdf["chunk"], pdf["told"], pdf["blob"]):
        if told:
            rows.append((c, blob))
            continue
        t, d, m = unpack(blob)
        chunk.append(c)
        token.append(np.cumsum(t))
        place.append(d)
        more.append(np.cumsum(m))
    if token:
        ends = np.cumsum([0, *map(len, token)])
        token = np.concatenate(token)
        first, at, times = np.unique(token, return_inverse=True, return_counts=True)
        shared = ((times > 1) | np.isin(first, np.concatenate(more)))[at]
        for c, d, lo, hi in zip(chunk, place, ends, ends[1:]):
            d = np.sort(d[shared[lo:hi]])
            if len(d):
                rows.append((c, pack(np.diff(d, prepend=0))))
    return pd.DataFrame(rows, columns=["chunk", "blob"])


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """From a chunk's answers: the ids that may have a partner."""
    got = [unpack(blob) for blob in pdf["blob"]]
    ids, left = next(g for g in got if len(g) == 2)
    for g in got:
        if len(g) == 1:
            left = left - np.bincount(np.cumsum(g[0]), minlength=len(ids))
    return pd.DataFrame({"doc_id": ids[left <= 0]})


def _requests(size: int, parts: int):
    """From rows (node, key, text): rows (part, chunk, told, blob). A task cuts its nodes into chunks, and a node is known by its place in one.

    A blob of told = false holds a chunk's shingles of a range in order as differences, the place of each one's node, and the hot shingles
    with how many nodes have each. Those of told = true only pass through: answers for hot shingles, and once a chunk its nodes and their set sizes.
    """

    def flush(chunk: int, held: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int, bool, bytes]]:
        tokens = np.concatenate([s for _, s, _ in held])
        place = np.repeat(np.arange(len(held)), [len(s) for _, s, _ in held])
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order].astype(np.int64), place[order]
        starts, times = _runs(tokens)
        common = np.repeat(times >= HOT, times)
        hot, weight = tokens[starts[times >= HOT]], times[times >= HOT]
        own = _own_part(chunk, parts)
        rows = [(own, chunk, True, pack(np.array([i for i, _, _ in held], np.int64), np.array([n for _, _, n in held], np.int64)))]
        if common.any():
            rows.append((own, chunk, True, pack(np.diff(tokens[common], prepend=0), place[common], np.full(int(common.sum()), HOT))))
        tokens, place = tokens[~common], place[~common]
        edges = [(p << HASH_BITS) // parts for p in range(parts + 1)]
        cuts, hot_cuts = np.searchsorted(tokens, edges), np.searchsorted(hot, edges)
        for p in range(parts):
            t, d, h = tokens[cuts[p] : cuts[p + 1]], place[cuts[p] : cuts[p + 1]], slice(hot_cuts[p], hot_cuts[p + 1])
            if len(t) or len(hot[h]):
                rows.append((p, chunk, False, pack(np.diff(t, prepend=edges[p]), d, np.diff(hot[h], prepend=edges[p]), weight[h])))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, seen = [], 0, set()
        chunk = TaskContext.get().partitionId() << 32
        frame = lambda rows: pd.DataFrame(rows, columns=["part", "chunk", "told", "blob"])
        for pdf in batches:
            for node, key, text in zip(pdf["node"].tolist(), pdf["key"], pdf["text"]):
                words = folded_words(text)
                s = shingles(words, size)
                # of rows of one doc_id only one with the node's own text counts
                if node in seen or set_key(words, len(s), size) != bytes(key):
                    continue
                seen.add(node)
                held.append((node, np.unique(s >> np.uint64(64 - HASH_BITS)), len(s)))
                total += len(s)
                if total >= CHUNK_SHINGLES:
                    yield frame(flush(chunk, held))
                    held, total, chunk = [], 0, chunk + 1
        if held:
            yield frame(flush(chunk, held))

    return run


def _answers(parts: int):
    """From all requests of a range of shingles: of each chunk those of two nodes or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = (int(pdf["part"].iloc[0]) << HASH_BITS) // parts
        rows, chunk, token, place, hot, weight = [], [], [], [], [], []
        for c, told, blob in zip(pdf["chunk"], pdf["told"], pdf["blob"]):
            if told:
                rows.append((c, blob))
                continue
            t, d, h, w = unpack(blob)
            chunk.append(c)
            token.append(low + np.cumsum(t))
            place.append(d)
            hot.append(low + np.cumsum(h))
            weight.append(w)
        if token:
            ends = np.cumsum([0, *map(len, token)])
            token, place, hot, weight = map(np.concatenate, (token, place, hot, weight))
            order = np.argsort(token, kind="stable")
            starts, times = _runs(token[order])
            first = token[order[starts]]
            known, at = np.unique(hot, return_inverse=True)
            more = np.append(np.bincount(at, weights=weight, minlength=len(known)), 0).astype(np.int64)
            spot = np.searchsorted(known, first)
            spot[(spot < len(known)) & (np.append(known, -1)[spot] != first)] = len(known)
            df = np.empty(len(token), np.int64)
            df[order] = np.repeat(np.minimum(times + more[spot], HOT), times)
            for c, lo, hi in zip(chunk, ends, ends[1:]):
                keep = lo + np.flatnonzero(df[lo:hi] > 1)
                if len(keep):
                    rows.append((c, pack(np.diff(token[keep], prepend=0), place[keep], df[keep])))
        return pd.DataFrame(rows, columns=["chunk", "blob"])

    return run


def _candidates(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(blob) for blob in pdf["blob"]]
        ids, sizes = next(g for g in got if len(g) == 2)
        got = [(np.cumsum(t), d, df) for t, d, df in (g for g in got if len(g) == 3)]
        rows = []
        token, place, df = map(np.concatenate, zip(*got)) if got else (np.empty(0, np.int64),) * 3
        order = np.argsort(place, kind="stable")
        token, place, df = token[order], place[order], df[order]
        for lo, c in zip(*_runs(place)):
            hi, node, size = lo + c, int(ids[place[lo]]), int(sizes[place[lo]])
            t = token[lo:hi]
            take = (hi - lo) - need(size, percent) + 1
            if take < 1:
                continue
            first = t[np.lexsort((mix64(t, 11), df[lo:hi]))][: take - 1 + _held(size, LINK_SHARE)]
            rows.append((node, size, _held(need(size, percent), LINK_SHARE), narrow(np.sort(t), HASH_BITS // 8), first))
        return pd.DataFrame(rows, columns=["node", "n", "least", "tokens", "heads"])

    return run


def _common(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Matrix of the numbers of common tokens, a few thousand token columns at a time."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    token = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(token, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    col, row = place[at[keep]], row[keep]
    for lo in range(0, int((times > 1).sum()), wide):
        here = (col >= lo) & (col < lo + wide)
        x = np.zeros((m, wide), np.float32)
        x[row[here], col[here] - lo] = 1
        out += x @ x.T
    return out


def linked(n: np.ndarray, full: list, orders: list[list], block: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of the links between documents (of different blocks, if there are two)."""
    ok = (percent * np.maximum.outer(n, n)) <= 100 * np.minimum.outer(n, n)
    if block.min() != block.max():
        ok &= block[:, None] != block[None, :]
    np.fill_diagonal(ok, False)
    for order in orders:
        if not ok.any():
            return ok
        ok &= _common(order) > 0
    live = np.flatnonzero(ok.any(1))
    if len(live):
        both = _common([full[k] for k in live]).astype(np.int64)
        sizes = n[live]
        ok[np.ix_(live, live)] &= 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return ok


def _verify(percent: int):
    """From rows of one cell together: a spanning forest of the links between its nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "cell"):
            node, n, side = (pdf[c].to_numpy() for c in ("node", "n", "side"))
            tokens = [wide(x, HASH_BITS // 8) for x in pdf["tokens"]]
            take = [len(t) - need(int(k), percent) + 1 for t, k in zip(tokens, n)]
            first = [np.asarray(x, np.int64)[:k] for x, k in zip(pdf["heads"], take)]
            other = [[t[np.argsort(mix64(t, salt))][:k] for t, k in zip(tokens, take)] for salt in (101, 1009)]
            ok = linked(n, tokens, [first, *other], side, percent)
            if not ok.any():
                continue
            label = node.copy()
            while True:  # the least node of each local component
                low = np.minimum(label, np.where(ok, label[None, :], np.iinfo(np.int64).max).min(1))
                if (low == label).all():
                    break
                label = low
            off = label != node
            yield pd.DataFrame({"a": node[off], "b": label[off]})

    return run


def _compared(near: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """dealt(node, cell, side) -> links (a, b) between nodes of one cell and different sides (of any, if a cell has one side)."""
    rows = near.select("node", "n", "tokens", "heads").join(dealt, "node")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_verify(percent), "a long, b long")


def _near_links(near: DataFrame) -> DataFrame:
    """Links (a, b) whose components hold every pair that is linked, and few that only have some shingles in common.

    Of two linked nodes' heads as many are common as each has in `least`, at least. A head of HOT nodes or fewer counts for each pair of them. Common
    heads of more nodes are missing in that count, so it has to reach what such heads of either node leave of `least`; nodes that have as many of
    these as their `least` says are linked by each of them as well.
    """
    heads = settle(near.select("node", "least", F.explode("heads").alias("token")))
    many = settle(heads.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    hot = settle(heads.join(many.where(F.col("c") > HOT), "token"))
    heavy = settle(hot.groupBy("node", "least").agg(F.count("*").alias("h")))
    groups = heads.join(many.where(F.col("c") <= HOT), "token").groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("all"))
    lows = groups.select(F.posexplode("all").alias("k", "a"), "all")
    pairs = lows.select("a", F.explode(F.slice("all", F.col("k") + 2, F.greatest(F.size("all") - F.col("k") - 1, F.lit(0)))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    own = settle(near.select("node", "least").join(heavy.select("node", "h"), "node", "left").fillna(0, "h"))
    side = lambda x: own.select(F.col("node").alias(x), F.col("least").alias(f"l{x}"), F.col("h").alias(f"h{x}"))
    enough = F.greatest("la", "lb") - F.least("ha", "hb")
    light = settle(pairs).join(side("a"), "a").join(side("b"), "b").where(F.col("c") >= enough).select("a", "b")
    full = hot.join(heavy.where(F.col("h") >= F.col("least")).select("node"), "node", "left_semi").select("node", "token")
    lowest = full.groupBy("token").agg(F.min("node").alias("b"))
    return light.unionByName(full.join(lowest, "token").select(F.col("node").alias("a"), "b"))


def _unfinished(cluster: DataFrame) -> DataFrame:
    """Large clusters of more than one piece, with their sizes."""
    return cluster.groupBy("component").agg(F.count("*").alias("m"), F.min("piece").alias("p1"), F.max("piece").alias("p2")).where((F.col("m") >= LARGE) & (F.col("p1") < F.col("p2"))).select("component", "m")


def _pivots(near: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """cluster(node, component, piece) -> links between all nodes of each cluster and its pivots, a node of each of its largest pieces."""
    sizes = settle(_unfinished(cluster))
    pieces = cluster.join(sizes.select("component"), "component", "left_semi").groupBy("component", "piece").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    best = pieces.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("c"), F.xxhash64("piece"), "piece"))).where(F.col("r") <= BLOCK)
    number = F.ceil(F.col("m") / (4 * BLOCK)).cast("long")
    cell = lambda k: F.concat_ws("/", F.col("component"), k)
    members = cluster.join(sizes, "component").select("node", cell(F.pmod(F.xxhash64("node"), number)).alias("cell"), F.lit(1).alias("side"))
    pivots = best.join(sizes, "component").select("node", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("k"), "component").select("node", cell(F.col("k")).alias("cell"), F.lit(0).alias("side"))
    return settle(_compared(near, settle(members.unionByName(pivots)), percent))


def _dealt(cluster: DataFrame) -> DataFrame:
    """cluster(node, component, piece) -> (node, cell, side): all pairs of blocks of a cluster but those within one large piece."""
    piece = cluster.groupBy("component", "piece").agg(F.count("*").alias("c"))
    piece = settle(piece.withColumn("pk", F.when(F.col("c") >= BLOCK, F.col("piece")).otherwise(F.lit(-1))))
    blocks = piece.groupBy("component", "pk").agg(F.ceil(F.sum("c") / BLOCK).cast("long").alias("nb"))
    every = settle(blocks.groupBy("component").agg(F.collect_list(F.struct("pk", "nb")).alias("all")))
    own = F.struct(F.col("pk").alias("pk"), F.pmod(F.xxhash64("node"), F.element_at(F.filter("all", lambda x: x["pk"] == F.col("pk")), 1)["nb"]).alias("k"))
    rows = cluster.join(piece.select("component", "piece", "pk"), ["component", "piece"]).join(every, "component").withColumn("own", own)
    others = F.filter("all", lambda x: (x["pk"] != F.col("pk")) | (F.col("pk") == -1))
    spelt = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["nb"] - 1), lambda j: F.struct(x["pk"].alias("pk"), j.alias("k")))))
    rows = rows.select("node", "component", "own", F.explode(spelt).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("node", F.concat_ws("/", "component", lo["pk"], lo["k"], hi["pk"], hi["k"]).alias("cell"), (F.col("own") == lo).cast("int").alias("side"))


def components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id), a row for each row of docs.

    A null or wordless text has no shingles and links with nothing; its component is its own doc_id. Rows with a null
    doc_id get a null component. Rows of one doc_id count as linked, whatever their texts. Equal texts are linked. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = max(LEAST_PARTS, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = settle(docs.mapInPandas(_digests(size, percent), "doc_id long, key binary, n long, heads binary"))
    some = each.where("n > 0 AND doc_id IS NOT NULL")
    # a number for each set, written once with it
    nodes = settle(some.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    pairable = (F.col("n") > 1) | F.lit(percent <= 50)
    heads = some.where(pairable).select("doc_id", "n", "heads").mapInPandas(_head_requests(percent, parts), "part int, chunk long, told boolean, blob binary")
    heads = heads.groupBy("part").applyInPandas(_head_answers, "chunk long, blob binary").groupBy("chunk").applyInPandas(_survivors, "doc_id long")
    wanted = settle(nodes.where(pairable).select(F.col("least").alias("doc_id"), "key", "node").join(heads, "doc_id", "left_semi"))
    # in order, so that a task that is run again cuts the same chunks
    texts = docs.where(may_hold(wanted.select("doc_id"))(F.col("doc_id"))).join(wanted.hint("shuffle_hash"), "doc_id").select("node", "key", "text").sortWithinPartitions("node")
    asked = texts.mapInPandas(_requests(size, parts), "part int, chunk long, told boolean, blob binary")
    told = asked.groupBy("part").applyInPandas(_answers(parts), "chunk long, blob binary")
    near = settle(told.groupBy("chunk").applyInPandas(_candidates(percent), "node long, n long, least long, tokens binary, heads array<long>"))
    cluster = settle(star_forest(_near_links(near)).withColumn("piece", F.col("node")))
    # rows of one doc_id
    many = settle(some.groupBy("doc_id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select("doc_id"))
    same = some.join(many, "doc_id", "left_semi").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    links = settle(same.join(same.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    for _ in range(PIVOT_ROUNDS):
        if _unfinished(cluster).isEmpty():
            break
        links = links.unionByName(_pivots(near, cluster, percent))
        joined = star_forest(links).select("node", F.col("component").alias("to"))
        cluster = settle(cluster.join(joined, "node", "left").select("node", "component", F.coalesce("to", "node").alias("piece")))
    links = links.unionByName(_compared(near, settle(_dealt(cluster)), percent))
    found = settle(star_forest(links))
    named = found.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    final = settle(nodes.select("key", "node", "least").join(found.join(named, "component").select("node", "component_id"), "node", "left").select("key", F.coalesce("component_id", "least").alias("component_id")))
    out = each.drop("heads").join(final, "key", "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
