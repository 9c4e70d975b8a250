"""The stored index and the automata against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from studyloom.operators import retrieval as R
from studyloom.operators import text_index as I


def plain_search(texts, queries, k):
    words = lambda t: re.findall(r"[\w]{2,}", t.lower())
    out = []
    for q, query in queries:
        terms = {w for w in words(query or "") if w not in R.STOP_WORDS}
        rows = []
        for i, t in texts:
            if t is not None:
                a = sum(w in terms for w in words(t))
                b = sum(w in terms for w in words(re.sub(r"\s+", " ", t).strip(" ")[:600]))
                if a + b:
                    y = (a + 0.4 * b) / (1 + a + 0.4 * b)
                    rows.append((-int(y / (1 + y) * 1e6 + 0.5) / 1e6, i))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 40])
def test_index_equals_scan(spark, tmp_path, monkeypatch, block):
    rnd = random.Random(block)
    lexicon = [f"w{k}" for k in range(40)] + ["the", "é1", "x"]
    texts = [(k, rnd.choice([None, "", " \n"]) if k % 29 == 0 else " ".join(rnd.choice(lexicon) for _ in range(rnd.choice([1, 3, 30, 400])))) for k in range(300)]
    queries = [(q, " ".join(rnd.choice(lexicon) for _ in range(rnd.randrange(1, 7)))) for q in range(25)] + [(90, None), (91, ""), (92, "the of"), (93, "absent")]
    I.build(spark.createDataFrame(texts, "id long, text string").repartition(3), str(tmp_path / "index"), buckets=4, block=block)
    index = I.open_index(spark, str(tmp_path / "index"))
    assert index[0].agg(F.max(F.size("docs"))).first()[0] <= block and index[1].count() == sum(t is not None for _, t in texts)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for k, terms in ((1, 200_000), (7, 9)):
        monkeypatch.setattr(I, "TERMS", terms)
        got = I.search(index, asked, k, buckets=4)
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == plain_search(texts, queries, k)


def test_search_reads_no_text_and_shuffles_no_posting_before_blocks_are_chosen(spark, tmp_path):
    I.build(spark.createDataFrame([(k, f"alpha beta {k}") for k in range(50)], "id long, text string"), str(tmp_path / "index"))
    plan = I.search(I.open_index(spark, str(tmp_path / "index")), spark.createDataFrame([(1, "alpha")], "query_id long, query string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_index(spark, tmp_path):
    I.build(spark.createDataFrame([(1, None), (None, "alpha")], "id string, text string"), str(tmp_path / "index"))
    assert I.search(I.open_index(spark, str(tmp_path / "index"), "string"), spark.createDataFrame([(1, "alpha")], "query_id long, query string")).count() == 0
    I.build(spark.createDataFrame([("a", "alpha"), ("b", "")], "id string, text string"), str(tmp_path / "more"))
    assert [r.id for r in I.search(I.open_index(spark, str(tmp_path / "more"), "string"), spark.createDataFrame([(1, "alpha")], "query_id long, query string")).collect()] == ["a"]


def test_automata_equal_containment(spark, monkeypatch):
    rnd = random.Random(5)
    bits = ["ab", "a b", "[x]", "(x)", "B", "", "é", "aba"]
    signals = [(q, rnd.choice([*bits, "".join(rnd.choice(bits) for _ in range(3))])) for q in range(12) for _ in range(3)]
    texts = [(k, rnd.choice([None, "ab", "[x] é", ""]), rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(6))])) for k in range(60)]
    norm = lambda x: re.sub(r"\s+", "", x.lower().translate(str.maketrans("[]{}", "()()")))
    want = []
    for q in range(12):
        mine, rows = [s for p, s in signals if p == q], []
        for i, title, text in texts:
            points = sum(2.0 if title is not None and s in title else 1.5 if text is not None and norm(s) in norm(text) else 0.0 for s in mine)
            if points:
                rows.append((-round(min(1.0, points / (2 * len(mine))), 6), i))
        want += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(rows)[:15], 1)]
    sig, tx = spark.createDataFrame(signals, "query_id long, signal string"), spark.createDataFrame(texts, "id long, title string, text string")
    for size in (2000, 5):
        monkeypatch.setattr(R, "QUERY_BLOCK", size)
        got = R.exact_recall(sig, tx)
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert R.exact_recall(sig.limit(0), tx).count() == 0
