"""Near copies are found without moving the texts that have none."""

import random

import numpy as np
import pandas as pd

import corpus_pipeline as cp
from studyloom.llm import common
from studyloom.llm import jaccard_join as J


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    seq = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(seq.apply(k).shuffleWriteBytes() for k in range(seq.size()))


def corpus():
    r = random.Random(9)
    rows = [(k, " ".join(str(r.randrange(10**6)) for _ in range(400))) for k in range(500)]
    near = [(1000 + k, rows[k][1] + " one more") for k in range(0, 500, 50)]
    return rows + near, {k: k for k, _ in rows} | {i: i - 1000 for i, _ in near}


def test_join_moves_less_than_its_texts(spark, tmp_path):
    rows, want = corpus()
    spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    before = shuffled(spark)
    out = {r.doc_id: r.component_id for r in J.components(df).collect()}
    assert out == want
    assert shuffled(spark) - before < 0.5 * sum(len(t) for _, t in rows)


def test_pipeline_keeps_rows_where_they_are(spark, sf, tmp_path):
    rows, want = corpus()
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    components = J.components
    before = shuffled(spark)
    found = components(docs, size=5, percent=80).collect()
    join, before = shuffled(spark) - before, shuffled(spark)
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, sf).collect()} == {i for i, c in want.items() if i == c} and len(found) == len(rows)
    assert shuffled(spark) - before - join < 0.1 * sum(len(t) for _, t in rows)


def test_passages_in_common_do_not_join_clusters(spark, monkeypatch):
    r, sizes, dealt = random.Random(2), [], J._dealt
    word = lambda: str(r.randrange(10**6))
    passages = [[word() for _ in range(24)] for _ in range(61)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(170)]
        rows += [(2 * k, " ".join([*passages[k], *own, *passages[k + 1]])), (2 * k + 1, " ".join([*passages[k], *own[:-1], "x", *passages[k + 1]]))]
    monkeypatch.setattr(J, "_dealt", lambda cluster: sizes.extend(x["count"] for x in cluster.groupBy("component").count().collect()) or dealt(cluster))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert {(x.doc_id, x.component_id) for x in J.components(df).collect()} == {(i, i - i % 2) for i, _ in rows}
    assert sizes == [2] * 60


def brute_links(sets, percent):
    return [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_heads_of_linked_sets_hold_enough_common_ones():
    r = np.random.default_rng(3)
    for percent in (30, 80, 85, 95):
        sets = []
        for _ in range(40):
            base = r.integers(0, 1 << 62, int(r.integers(1, 90))).astype(np.uint64)
            for _ in range(4):
                drop = base[r.random(len(base)) > r.random() * 0.1]
                sets.append(set(drop.tolist()) | set(r.integers(0, 1 << 62, int(r.integers(0, 4))).tolist()))
        sets = [s for s in sets if s]
        heads = []
        for s in sets:
            t = np.array(sorted(s), np.uint64)
            heads.append(set(t[: len(t) - J.need(len(t), percent) + J._held(len(t))].tolist()))
        links = brute_links(sets, percent)
        assert len(links) >= 5
        assert all(len(heads[x] & heads[y]) >= J._held(J.need(len(sets[x]), percent)) for a, b in links for x, y in ((a, b), (b, a)))


def test_filter_passes_all_its_values_and_few_others(spark):
    ids = spark.range(0, 30_000, 3)
    test = common.may_hold(ids)
    got = spark.range(30_000).select("id", test(common.F.col("id")).alias("may")).collect()
    assert all(r.may for r in got if r.id % 3 == 0) and sum(r.may for r in got if r.id % 3) < 600
    none = common.may_hold(ids.limit(0))
    assert not any(r.may for r in spark.range(100).select(none(common.F.col("id")).alias("may")).collect())
