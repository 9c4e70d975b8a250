"""Pairs of links that one task counts."""

import random
from collections import Counter
from itertools import combinations

from studyloom.operators import learning as L


def test_links_are_dealt_by_their_number_and_meet_without_a_join(spark, monkeypatch, capsys):
    monkeypatch.setattr(L, "LINK_BLOCK", 20)
    rnd = random.Random(2)
    links = [(rnd.choice([None, *range(30)]), rnd.choice([None, *range(12)])) for _ in range(300)]
    got = L.cooccurrence(spark.createDataFrame(links, "artifact long, topic long"))
    topics = {}
    for a, t in links:
        if a is not None and t is not None:
            topics.setdefault(a, set()).add(t)
    want = Counter(p for ts in topics.values() for p in combinations(sorted(ts), 2))
    assert {(r.a, r.b): r.artifacts for r in got.collect()} == want and all(r.weight == round(min(1.0, 0.4 + 0.02 * (r.artifacts - 1)), 6) for r in got.collect())
    got.explain()
    plan = capsys.readouterr().out
    known = sum(a is not None and t is not None for a, t in links)
    assert "Join" not in plan and f", {-(-known // 20)}), REPARTITION_BY_NUM" in plan
