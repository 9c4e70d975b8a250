"""Operators without SQL against plain Python."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from studyloom.operators import workflow as W
from studyloom.operators.records import percentiles_by_index


@pytest.mark.parametrize("raw, want", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('{"t": "\\alpha \\frac{1}{2}"}', {"t": "\\alpha \\frac{1}{2}"}), ('{"t": "x\ny\tz"}', {"t": "x\ny\tz"}),
    ('{"a": ["one", "two', {"a": ["one", "two"]}), ('[{"a": 1}, {"b": "c"', [{"a": 1}, {"b": "c"}]), ("no json", None), ("", None), (None, None), ('{"t": "\\u00e9 \\n \\x"}', {"t": "é \n \\x"}),
])
def test_json_repair(raw, want):
    got = W.repaired(raw)
    if raw and "frac" in raw:  # a known escape stays what it says
        assert json.loads(got)["t"].startswith("\\alpha")
    else:
        assert (None if got is None else json.loads(got)) == want


def test_ratio_and_repair_as_columns(spark):
    rows = [("abcd", "bcde"), ("", ""), (None, "x"), ("same text", "same text")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", W.sequence_ratio(F.col("a"), F.col("b")).alias("r"), W.repaired_json(F.col("a")).alias("j"))
    for x in df.collect():
        assert x.r == SequenceMatcher(None, x.a or "", x.b or "").ratio() and x.j is None


def test_accepted_candidates(spark):
    r = random.Random(1)
    rows = []
    for g in range(4):
        base = " ".join(r.choice("abcdefgh") * 4 for _ in range(12))
        for k in range(12):
            text = base[: 4 * k] if k % 3 else base
            rows.append((g, k, text if k % 5 else None, r.choice([0.2, 0.5, 0.9]), [1] if k % 4 else []))
    df = spark.createDataFrame(rows, "g long, position long, text string, confidence double, sources array<int>").repartition(3)
    want = set()
    for g in range(4):
        kept = []
        for _, k, t, c, s in [x for x in rows if x[0] == g]:
            plain = " ".join((t or "").lower().split())
            if c >= 0.5 and s and len(kept) < 3 and all(SequenceMatcher(None, plain, x).ratio() < 0.86 for x in kept):
                kept.append(plain)
                want.add((g, k))
    assert {(x.g, x.position) for x in W.accepted_candidates(df, ["g"], 3).collect()} == want
    assert W.accepted_candidates(df.limit(0), ["g"], 3).count() == 0


def test_similar_sequences(spark):
    r = random.Random(4)
    base = [" ".join("".join(r.choice("abcdeé ") for _ in range(6)) for _ in range(r.choice([1, 5, 60]))) for _ in range(12)]
    rows = [(k, a, "".join(c for c in a if r.random() > drop) + tail) for k, a in enumerate(base) for drop, tail in ((0, ""), (0.1, "x"), (0.5, "yy"))]
    rows += [(90, None, None), (91, "", "x"), (92, None, "x"), (93, "abc", "cba"), (94, "AÉ🙂", "aé🙂"), (95, base[0], base[1])]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for least in (0.5, 0.86):
        ratios = [(k, SequenceMatcher(None, a or "", b or "").ratio()) for k, a, b in rows]
        assert sorted((x.k, x.ratio) for x in W.similar_sequences(df, least).collect()) == sorted(x for x in ratios if x[1] >= least)
    assert W.similar_sequences(df, 0.5).columns == ["k", "a", "b", "ratio"] and W.similar_sequences(df.limit(0), 0.5).count() == 0


def test_percentiles_by_index(spark):
    r = random.Random(6)
    rows = [("hot", float(r.randrange(3000))) for _ in range(4000)] + [("few", 1.0), ("few", 2.0), (None, 5.0), ("none", None), ("one", 7.0)] + [(f"k{k}", r.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        want[k] = tuple(own[int(s * (len(own) - 1) + 0.5)] for s in shares.values())
    assert {x.k: tuple(x)[1:] for x in percentiles_by_index(df, "k", "v", shares).collect()} == want
    assert percentiles_by_index(df.limit(0), "k", "v", shares).count() == 0
