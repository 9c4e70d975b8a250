"""The approximate index and half precision against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.operators import retrieval as R
from studyloom.operators import vector_index as V


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 20))
    return [(k, (centres[k % 20] + rnd.normal(size=20) * 0.6).tolist()) for k in range(1500)] + [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [0.0] * 20)]


def test_index_holds_every_row_and_finds_most(spark, rows, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    V.build(df.repartition(5), str(tmp_path / "index"))
    index, book = V.open_index(spark, str(tmp_path / "index"))
    assert sorted(r.id for r in index.select("id").collect()) == [r[0] for r in rows]
    assert {r.id for r in index.where("list = -1").collect()} == {2000, 2001, 2002, 2003}
    assert len(book.centres) == 38 and index.where("list >= 0").select(F.max(F.length("code"))).first()[0] == 5  # 20 coordinates
    queries = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exact = {(r.query_id, r.id): r.score for r in R.vector_recall(queries.where("query_id < 1500"), df).collect()}
    monkeypatch.setattr(V, "BLOCK", 7)
    got = V.search(index, book, queries).collect()
    assert sorted(r["rank"] for r in got if r.query_id == 0) == list(range(1, 31))
    hits = [(r.query_id, r.id) for r in got if (r.query_id, r.id) in exact]
    assert len(hits) >= 0.9 * len(exact)
    assert all(abs(r.score - exact[r.query_id, r.id]) < 2e-6 for r in got if (r.query_id, r.id) in exact)
    every = V.search(index, book, queries.where("query_id < 300"), probes=38)
    assert {(r.query_id, r.id) for r in every.collect()} == {k for k in exact if k[0] < 300}


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    V.build(df, str(tmp_path / "index"))
    index, book = V.open_index(spark, str(tmp_path / "index"))
    assert book is None and V.search(index, book, df.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))).count() == 0


def test_half_precision_equals_rounded_vectors(spark, rows):
    more = rows + [(3000, [1e9] + [0.1] * 19), (3001, [1e-8] * 20)]
    df = spark.createDataFrame(more, "id long, vector array<double>")
    small = V.packed(df)
    assert {r.n for r in small.where("id < 1500").select(F.length("vector").alias("n")).collect()} == {40}
    queries = df.where("id % 100 = 0 AND id < 1500").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in R.vector_recall(queries, small, 10).collect()}
    half = lambda v: np.clip(np.array(v), -65504, 65504).astype(np.float16).astype(float)
    for q, v in rows[:1500:100]:
        scored = []
        for i, w in more:
            if w is not None:
                a, b = half(v), half(w)
                s = float(np.round(a @ b / np.linalg.norm(a) / np.linalg.norm(b), 6)) if len(w) == 20 and np.linalg.norm(b) > 0 else 0.0
                scored.append((-s, i))
        for n, (s, i) in enumerate(sorted(scored)[:10], 1):
            assert abs(got[q, n][1] + s) < 2e-6
