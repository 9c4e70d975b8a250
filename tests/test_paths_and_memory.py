"""Paths, moves and sequential consolidation against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.operators import folds, learning, study, workflow


def all_paths(edges, start, depth, most):
    out, level = [], [([start], None)]
    for d in range(1, depth + 1):
        level = [([*p, b], w) for p, _ in level for a, b, w in edges if a == p[-1] and (d == 1 or b not in p)]
        out += [(d, -w, p) for p, w in level]
    return [(start, p[-2], p[-1], -w, d, p, n) for n, (d, w, p) in enumerate(sorted(out)[:most], 1)]


def test_paths_equal_enumeration(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(12), rnd.randrange(12), rnd.choice([0.1, 0.5, 0.9])) for _ in range(40)] + [(3, 3, 0.5), (None, 1, 0.5)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    starts = spark.createDataFrame([(k,) for k in [*range(13), 3]], "start long")
    real = [e for e in edges if e[0] is not None]
    for depth, most in ((4, 15), (3, 200), (1, 2)):
        got = [tuple(r) for r in learning.topic_paths(df, starts, depth, most).collect()]
        assert sorted(got) == sorted(x for k in range(13) for x in all_paths(real, k, depth, most))
    assert learning.topic_paths(df.limit(0), starts).count() == 0


def test_moves_in_a_deep_tree(spark):
    parent = {k: k - 1 for k in range(1, 150)} | {k: (k - 150) // 2 for k in range(150, 220)}
    nodes = spark.createDataFrame([(k, parent.get(k)) for k in range(220)], "node long, parent long")
    rnd = random.Random(6)
    moves = [(rnd.randrange(220), rnd.randrange(225)) for _ in range(200)] + [(0, 149), (149, 0), (5, 5), (70, 0)]

    def up(x):
        while x is not None:
            yield x
            x = parent.get(x)

    got = workflow.moves_checked(nodes, spark.createDataFrame(moves, "node long, target long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, t, n not in up(t)) for n, t in moves)


def test_a_cycle_of_parents_is_an_error(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long")
    monkeypatch.setattr(workflow, "settle", lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    try:
        workflow.jumps(nodes)
        raise AssertionError
    except ValueError:
        pass


def test_subtree_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(25)], "node long, parent long")
    got = study.subtree(nodes, spark.createDataFrame([(3,), (99,)], "node long")).collect()
    assert sorted(map(tuple, got)) == [(k, 3, k - 3) for k in range(3, 25)]


def plain_consolidation(candidates, memories, same, update):
    out = []
    for key in sorted({r[0] for r in candidates}):
        live = [(i, d, v, c or 0.0) for o, i, d, v, c in sorted((m for m in memories if m[0] == key), key=lambda m: m[1])]
        for _, place, i, d, v, c in sorted((x for x in candidates if x[0] == key), key=lambda x: (x[1], x[2])):
            equal = next((m for m in live if d is not None and m[1] == d), None)
            if equal:
                out.append((key, i, "SKIP", equal[0], 1.0))
                continue
            cos = lambda a, b: 0.0 if a is None or b is None or not any(a) or not any(b) else round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
            best = max(live, key=lambda m: cos(v, m[2]), default=None)
            s = cos(v, best[2]) if best else 0.0
            if s < update:
                out.append((key, i, "ADD", None, None))
            elif s >= same and not (c or 0.0) > best[3]:
                out.append((key, i, "SKIP", best[0], s))
                continue
            else:
                out.append((key, i, "UPDATE", best[0], s))
                live.remove(best)
            live.append((i, d, v, c or 0.0))
    return out


def test_candidates_meet_what_earlier_ones_left(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, 24))
    vector = lambda: None if rnd.random() < 0.05 else [0.0] * 24 if rnd.random() < 0.05 else (centres[rnd.integers(6)] + rnd.normal(size=24) * 0.35).tolist()
    rows = [(int(k % 3), k, None if k % 11 == 0 else f"d{k % 90}", vector(), None if k % 13 == 0 else float(rnd.integers(5)) / 5) for k in range(260)]
    memories, late = rows[:80], [(o, k % 7, k, d, v, c) for o, k, d, v, c in rows[80:]]
    made = folds.consolidated(spark.createDataFrame(late, "owner int, place long, id long, digest string, vector array<double>, confidence double"), spark.createDataFrame(memories, "owner int, id long, digest string, vector array<double>, confidence double"), ["owner"], 0.9, 0.78)
    got = sorted((r.owner, r.id, r.decision, r.memory, r.similarity) for r in made.collect())
    want = sorted(plain_consolidation(late, memories, 0.9, 0.78))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(a[4] == b[4] or abs(a[4] - b[4]) < 2e-6 for a, b in zip(got, want))
    assert {d for _, _, d, _, _ in got} == {"ADD", "SKIP", "UPDATE"}
    assert any(m is not None and m >= 80 for _, _, _, m, _ in got)  # memories that candidates have made


def test_consolidation_without_memories(spark):
    c = spark.createDataFrame([(1, 0, 1, "a", [1.0, 0.0], 0.5), (1, 1, 2, "b", [1.0, 0.01], 0.9)], "owner int, place long, id long, digest string, vector array<double>, confidence double")
    m = c.drop("place").limit(0)
    assert [(r.id, r.decision, r.memory) for r in folds.consolidated(c, m, ["owner"]).orderBy("id").collect()] == [(1, "ADD", None), (2, "UPDATE", 1)]
    assert folds.consolidated(c.where(F.lit(False)), m, ["owner"]).count() == 0
