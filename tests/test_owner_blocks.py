"""The closest memories of an owner, found block by block, against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.operators import memory as M
from studyloom.operators import retrieval as R
from studyloom.operators import workflow as W


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    norm = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
    return float(np.round(np.dot(a, b) / norm, 6)) if norm > 0 else 0.0


def vector(rnd):
    return rnd.choice([None, [], [0.0] * 3, [1.0, None, 2.0], [1.0, 0.0], [1.0, 2.0, 3.0], *[[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(12)]])


def test_recall_and_consolidation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "OWNER_ROWS", 7)
    monkeypatch.setattr(R, "OWNER_QUERIES", 3)
    rnd = random.Random(9)
    own = lambda: rnd.choice([None, "a", "a", "a", "b", "c"])
    queries = [(own(), n, vector(rnd), n % 5, n % 4 / 4) for n in range(40)] + [("alone", 99, [1.0, 2.0, 3.0], 1, 0.5)]
    rows = [(own(), n, vector(rnd), n % 11, n % 3 / 3) for n in range(200, 300)]
    q = spark.createDataFrame(queries, "owner string, id long, vector array<double>, digest long, confidence double")
    m = spark.createDataFrame(rows, "owner string, id long, vector array<double>, digest long, confidence double")
    met = {i: sorted((-cosine(v, w), j, c) for p, j, w, _, c in rows if p == o and o is not None) for o, i, v, _, _ in queries}

    near = W.recalled_memories(q.where("vector IS NOT NULL").drop("digest", "confidence"), m.select("owner", F.col("id").alias("memory"), "vector", F.col("digest").alias("updated")), k=4, least=0.0)
    assert sorted((r.id, r["rank"], r.memory, r.similarity) for r in near.collect()) == sorted((i, n + 1, j, -s + 0.0) for o, i, v, _, _ in queries if v is not None for n, (s, j, _) in enumerate([x for x in met[i] if -x[0] >= 0][:4]))

    want = []
    for o, i, _, d, confidence in queries:
        equal = min((j for p, j, _, e, _ in rows if p == o and o is not None and e == d), default=None)
        s, j, c = next(((-s, j, c) for s, j, c in met[i] if -s > 0), (0.0, None, None))
        verdict = "SKIP" if equal is not None else ("UPDATE" if confidence > c else "SKIP") if s >= 0.9 else "UPDATE" if s >= 0.7 else "ADD"
        want.append((i, verdict, equal if equal is not None else j if s >= 0.7 else None, 1.0 if equal is not None else s))
    got = M.consolidate(q, m, ["owner"], 0.9, 0.7)
    assert sorted((r.id, r.decision, r.memory, r.similarity) for r in got.collect()) == sorted(want)
