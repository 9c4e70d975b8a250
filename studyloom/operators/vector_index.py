"""Approximate nearest neighbours: an inverted file of product-quantised vectors, stored by list, with an exact rescore; half-precision vectors.

Centres and codewords are fitted on a sample of bounded size; every row is indexed. A row's list is that of its nearest centre, its code
one byte for each four coordinates of what is left of it. A search reads the codes of the lists nearest to a query, and the vectors
of its best candidates only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _query_blocks, top

#: Rows that centres and codewords are fitted on at most (about eight megabytes of 96 coordinates), coordinates of a code byte, codewords, rounds of fitting.
SAMPLE, WIDE, WORDS, ROUNDS = 20_000, 4, 256, 12
#: How many lists a search reads is measured on the sample: so many of its vectors ask for so many neighbours, and this part of them has to lie in those lists.
ASKED, NEAREST, TARGET = 200, 30, 0.97
#: Queries that meet the lists at once, and candidates that are rescored for each place of the result.
BLOCK, RESCORED = 256, 8
#: Rows whose distances to all centres are held at a time.
ROW_TILE = 1024


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, tile by tile."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(rows[lo : lo + ROW_TILE] @ centres.T - half, axis=1) for lo in range(0, max(1, len(rows)), ROW_TILE)])


@dataclass
class Codebook:
    """Centres (lists, size) of unit vectors and codewords (bytes, WORDS, WIDE) of what is left; size is a multiple of WIDE, true_size the vectors' own."""

    centres: np.ndarray
    words: np.ndarray
    true_size: int
    probes: int

    def padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.centres.shape[1] - v.shape[1])))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(unit, self.centres)
        rest = unit - self.centres[lists]
        codes = [_nearest(rest[:, WIDE * j : WIDE * (j + 1)], w) for j, w in enumerate(self.words)]
        return lists, np.stack(codes, 1).astype(np.uint8)


def _means(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from rows spread evenly over the sample; a centre that loses all its rows stays where it is."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _units(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which vectors have this size and a length; the others are zero."""
    good = np.array([v is not None and len(v) == size for v in column], bool)
    out = np.zeros((len(good), size))
    if good.any():
        out[good] = np.stack([np.asarray(v, float) for v, g in zip(column, good) if g])
    norm = np.linalg.norm(out, axis=1)
    good &= norm > 0
    out[good] /= norm[good, None]
    return out * good[:, None], good


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Codebook | None:
    """Centres and codewords from at most `sample` vectors of the most frequent size, in the order of their ids' hash. lists: by default the root of the rows' number, 4096 at most."""
    whole = vectors.where(F.size("vector") > 0)
    size = whole.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return None
    rows = whole.where(F.size("vector") == size["size"]).select("vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    unit, good = _units([r.vector for r in rows], size["size"])
    if not good.any():
        return None
    unit = np.pad(unit[good], ((0, 0), (0, -size["size"] % WIDE)))
    k = min(len(unit), lists or min(4096, max(1, int(size["count"] ** 0.5))))
    centres = _means(unit, k)
    near = _nearest(unit, centres)
    rest = unit - centres[near]
    words = np.stack([_means(rest[:, a : a + WIDE], min(WORDS, len(rest))) for a in range(0, unit.shape[1], WIDE)])
    return Codebook(centres, words, size["size"], _probes(unit, centres, near))


def _probes(unit: np.ndarray, centres: np.ndarray, lists: np.ndarray) -> int:
    """How many lists, nearest first, hold the TARGET part of the sample's neighbours of some of its vectors. Neighbours in all rows are nearer still."""
    q = unit[np.linspace(0, len(unit) - 1, min(ASKED, len(unit))).astype(int)]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    best = np.argsort(-(q @ unit.T), axis=1, kind="stable")[:, :NEAREST]
    ranks = np.take_along_axis(place, lists[best], 1)
    return int(np.quantile(ranks, TARGET, method="higher")) + 1


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """vectors(id, vector), ids unique -> rows(list, id, code, vector) and the codebook under path. Vectors of another size or without length are kept in list -1."""
    spark, book = vectors.sparkSession, fit(vectors, lists, sample)
    kind, vector = dict(vectors.dtypes)["id"], dict(vectors.dtypes)["vector"]

    def coded(batches):
        for pdf in batches:
            if book is None or not len(pdf):
                yield pdf.assign(list=-1, code=None)[["list", "id", "code", "vector"]]
                continue
            unit, good = _units(pdf["vector"], book.true_size)
            number, codes = book.encode(book.padded(unit))
            yield pd.DataFrame({"list": np.where(good, number, -1), "id": pdf["id"], "code": [c.tobytes() if g else None for c, g in zip(codes, good)], "vector": pdf["vector"]})

    rows = vectors.select("id", "vector").mapInPandas(coded, f"list int, id {kind}, code binary, vector {vector}")
    rows.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    made = [(book.true_size, book.probes, *book.centres.shape, *book.words.shape[:2], book.centres.tobytes(), book.words.tobytes())] if book else []
    spark.createDataFrame(made, "size int, probes int, lists int, padded int, bytes int, words int, centres binary, codewords binary").coalesce(1).write.parquet(f"{path}/codebook")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, Codebook | None]:
    r = spark.read.parquet(f"{path}/codebook").first()
    book = r and Codebook(np.frombuffer(bytes(r.centres)).reshape(r.lists, r.padded), np.frombuffer(bytes(r.codewords)).reshape(r.bytes, r.words, WIDE), r["size"], r.probes)
    return spark.read.parquet(f"{path}/rows"), book


def search(rows: DataFrame, book: Codebook | None, queries: DataFrame, k: int = 30, probes: int | None = None) -> DataFrame:
    """queries(query_id, query) -> (query_id, id, score, rank): the k best of the nearest lists, by cosine, ties by id. probes: how many lists, by default what fit() has measured.

    Scores are exact; what is missing is what lay in other lists or whose code looked worse than RESCORED x k others. Rows of list -1 are
    not found, nor anything for a query of another size or without length.
    """
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    none = top(queries.select("query_id", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(0.0).alias("score")).limit(0), ["query_id"], [F.col("id")], k)
    found = None
    for part in _query_blocks(queries.where("query IS NOT NULL"), BLOCK) if book else []:
        asked = part.select("query_id", "query").collect()  # about BLOCK
        unit, good = _units([r.query for r in asked], book.true_size)
        if not good.any():
            continue
        ids, unit = [r.query_id for r, g in zip(asked, good) if g], book.padded(unit[good])
        nearest = np.argsort(-(unit @ book.centres.T), axis=1, kind="stable")[:, : probes or book.probes]
        best = _block(rows, book, ids, unit, nearest, k, kinds)
        found = best if found is None else found.unionByName(best)
    return none if found is None else found


def _block(rows, book, ids, unit, probes, k, kinds):
    head = RESCORED * k
    asking = {int(n): np.flatnonzero((probes == n).any(1)) for n in np.unique(probes)}

    def candidates(batches):
        tables = np.einsum("qjw,jcw->qjc", unit.reshape(len(unit), -1, WIDE), book.words).astype(np.float32)
        kept: dict[int, list] = {}
        for pdf in batches:
            for number, run in pdf.groupby("list", sort=False):
                codes = np.frombuffer(b"".join(run["code"]), np.uint8).reshape(len(run), -1)
                who = asking[number]
                score = np.repeat((unit[who] @ book.centres[number])[:, None], len(run), 1)
                for j in range(codes.shape[1]):
                    score += tables[who, j][:, codes[:, j]]
                keys = run["id"].to_numpy()
                for q, s in zip(who.tolist(), score):
                    cut = np.argpartition(-s, head)[:head] if len(s) > head else np.arange(len(s))
                    old = kept.get(q)
                    s, i, n = s[cut], keys[cut], np.full(len(cut), number)
                    if old is not None:
                        s, i, n = np.concatenate([old[0], s]), np.concatenate([old[1], i]), np.concatenate([old[2], n])
                        if len(s) > head:
                            cut = np.argpartition(-s, head)[:head]
                            s, i, n = s[cut], i[cut], n[cut]
                    kept[q] = (s, i, n)
        for q, (s, i, n) in kept.items():
            yield pd.DataFrame({"q": q, "list": n, "id": i, "guess": s})

    wanted = rows.where(F.col("list").isin([int(n) for n in asking]))
    guessed = wanted.select("list", "id", "code").mapInPandas(candidates, f"q int, list int, id {kinds['id']}, guess double")
    heads = top(guessed, ["q"], [F.desc("guess"), F.col("id")], head, "place").select("q", "list", "id")

    def rescored(batches):
        for pdf in batches:
            v, _ = _units(pdf["vector"], book.true_size)
            score = np.round((book.padded(v) * unit[pdf["q"].to_numpy()]).sum(1), 6) + 0.0
            yield pd.DataFrame({"query_id": [ids[q] for q in pdf["q"]], "id": pdf["id"], "score": score})

    # BLOCK queries have BLOCK x RESCORED x k candidates at most
    met = wanted.select("list", "id", "vector").join(F.broadcast(heads), ["list", "id"]).select("q", "id", "vector")
    return top(met.mapInPandas(rescored, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), ["query_id"], [F.desc("score"), F.col("id")], k)


def packed(vectors: DataFrame) -> DataFrame:
    """vectors(id, vector) -> (id, vector) with 16-bit floats in one binary: half the bytes. Coordinates beyond the format's range, and nulls, become its limits and zero."""

    def pack(batches):
        for pdf in batches:
            half = [None if v is None else np.clip(np.nan_to_num(np.asarray(v, float)), -65504, 65504).astype(np.float16).tobytes() for v in pdf["vector"]]
            yield pd.DataFrame({"id": pdf["id"], "vector": half})

    return vectors.select("id", "vector").mapInPandas(pack, f"id {dict(vectors.dtypes)['id']}, vector binary")
