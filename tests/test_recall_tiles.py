"""Vector recall in tiles of queries against brute force."""

import numpy as np

from studyloom.operators import retrieval as R


def test_vector_recall_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_TILE", 3)
    rnd = np.random.default_rng(2)
    q, v = rnd.normal(size=(8, 6)), rnd.normal(size=(70, 6))
    v[40:50] = v[:10]  # ties go by id
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)] + [(50, [1.0, 2.0]), (51, None)], "query_id long, query array<double>")
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in R.vector_recall(queries, df, 5).collect()}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.vstack([np.round(unit(q) @ unit(v).T, 6), np.zeros(70)])
    best = np.lexsort((np.broadcast_to(np.arange(70), s.shape), -s))[:, :5]
    assert got == {(50 if k == 8 else k, r + 1): (int(best[k, r]), float(s[k, best[k, r]])) for k in range(9) for r in range(5)}
