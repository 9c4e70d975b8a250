"""Compression classifier: how much better a text shrinks with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are built from a bounded sample of labelled texts; the difference of compressed
sizes, divided by the text's size, becomes a score by logistic calibration on sampled texts that the
dictionaries haven't seen. Scoring streams over the documents; only the two dictionaries go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample: at most so many texts of each label, in an order by hash of the id, and so many bytes, of which half are each label's own.
SAMPLE_TEXTS = 1500
SAMPLE_BYTES = 8_000_000
DICTIONARY_BYTES = 65_536
#: A text is compressed in pieces, so that the dictionary and not its own earlier part tells of it, however long it is.
PIECE = 2048
LEVEL = 3
LIMIT = 0.7


def _pieces(data: bytes) -> list[bytes]:
    return [data[k : k + PIECE] for k in range(0, len(data), PIECE)]


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the texts' own first bytes if there are too few to train one."""
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n".join(texts)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Difference:
    """(size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in _pieces(data)) for c in self.both)
        return (bad - good) / len(data)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method; (slope, offset)."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
    return float(w[0] / scale), float(w[1])


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of the bounded training sample; of rows of one doc_id the label is the larger, the text the least.

    A text that doesn't fit in what is left of its label's bytes is passed over. Of a label without any that fits, the first part of the shortest is taken.
    """
    train = labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("quality").isin(0, 1))
    train = train.groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("order", F.xxhash64("doc_id", F.lit(9)))
    ids = [r for k in (0, 1) for r in train.where(F.col("label") == k).orderBy("order", "doc_id").limit(SAMPLE_TEXTS).collect()]
    if not ids:
        return []
    label = {r.doc_id: r.label for r in ids}
    known = docs.sparkSession.createDataFrame([(r.doc_id, r.order) for r in ids], "doc_id long, order long")
    found = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").join(F.broadcast(known), "doc_id")
    sizes = found.groupBy("doc_id", "order").agg(F.min(F.octet_length("text")).alias("n")).orderBy("order").collect()
    keep, share = [], SAMPLE_BYTES // 2
    both = sorted(([r for r in sizes if label[r.doc_id] == k] for k in (0, 1)), key=lambda mine: sum(r.n for r in mine))
    # what the label with fewer bytes leaves of its half is the other one's
    for mine in both:
        left, fits = max(share, SAMPLE_BYTES - sum(n for _, n in keep)) if keep else share, []
        for r in mine:
            if r.n <= left:
                left -= r.n
                fits.append((r.doc_id, r.n))
        keep += fits or [(r.doc_id, r.n) for r in sorted(mine, key=lambda r: r.n)[:1]]
    chosen = docs.sparkSession.createDataFrame(keep, "doc_id long, n long")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") == F.col("n")).groupBy("doc_id", "n").agg(F.min("text").alias("text"))
    # a character has four bytes at most
    rows = rows.select("doc_id", F.when(F.col("n") > share, F.substring("text", 1, share // 4)).otherwise(F.col("text")).alias("text")).collect()
    return sorted((r.doc_id, r.text, label[r.doc_id]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float, float] | None:
    """Dictionaries from two thirds of the sample, calibration from the rest; None if a label is missing. Null and empty texts and labels other than 0 and 1 are not in the sample."""
    rows = sample(docs, labels)
    part = lambda k, held: [t.encode("utf-8", "surrogatepass") for n, (_, t, y) in enumerate([r for r in rows if r[2] == k]) if (n % 3 == 2) == held]
    if not part(0, False) or not part(1, False):
        return None
    good, bad = dictionary(part(1, False)).as_bytes(), dictionary(part(0, False)).as_bytes()
    diff = Difference(good, bad)
    held = [(diff(t.decode("utf-8", "surrogatepass")), k) for k in (0, 1) for t in (part(k, True) or part(k, False))]
    return good, bad, *calibrate(np.array([x for x, _ in held]), np.array([y for _, y in held], float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> (doc_id, held_out, score, predicted), a row for each document.

    Null text: empty; empty texts get the score of no difference. Without labels of both kinds every score is 0.5. A null
    doc_id isn't held out. Other columns are never read.
    """
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        diff = Difference(*model[:2])
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(model[2] * np.array([diff(t) for t in texts], float) + model[3], -700, 700))))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), (scored("text") if model else F.lit(0.5)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
