"""Lines meet the next line in their own row."""

from difflib import SequenceMatcher

from studyloom.plans import workflow_queries as Q


def test_lines_meet_without_a_shuffle(spark, tmp_path):
    texts = {1: "the first line\nthe first lines\nsomething else\n\n\nab", 2: "alone", 3: None, 4: "", 5: "same\nsame\nsame", 6: "x\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.sequence_ratios(spark, str(tmp_path))
    want = []
    for k, t in texts.items():
        lines = (t or "").split("\n")
        want += [(k, i, round(SequenceMatcher(None, a, b).ratio(), 6)) for i, (a, b) in enumerate(zip(lines, lines[1:])) if SequenceMatcher(None, a, b).ratio() >= 0.86]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 4
    assert dict(got.dtypes) == {"doc_id": "bigint", "chunk_index": "int", "ratio": "double"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
