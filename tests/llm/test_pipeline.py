from pyspark.sql import functions as F

import corpus_pipeline as cp


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_document_of_each_group_stays(spark, sf):
    base = [f"w{k}" for k in range(80)]
    near = [*base[:40], "other", *base[41:]]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base).upper()), (1, "alone here"), (None, " ".join(base)), (5, " ".join(base)), (2, None)]
    out = cp.near_duplicates(spark, frame(spark, rows), sf)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([3, 1, 2, None], key=str)
    assert out.columns == frame(spark, rows).columns


def test_copies_with_an_extra_passage_go(spark, sf):
    base = [f"w{k}" for k in range(100)]
    more = [*base, *(f"x{k}" for k in range(22))]  # 96 of 118 shingles of five words, 0.81
    less = [*base, *(f"y{k}" for k in range(30))]  # 96 of 126, 0.76
    rows = [(1, " ".join(base)), (2, " ".join(more)), (3, " ".join(less)), (4, None), (4, "later text"), (4, "first text")]
    for shuffled in (rows, rows[::-1]):
        out = cp.near_duplicates(spark, frame(spark, shuffled).repartition(3), sf)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, rows[0][1], len(rows[0][1])), (3, rows[2][1], len(rows[2][1])), (4, "first text", 10)]


def test_redaction_replaces_spans(spark, sf):
    out = cp.personal_data(spark, frame(spark, [(1, "mail a.b@c.org or 10.0.0.1 now"), (2, "nothing 12 here"), (3, None)]), sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("mail <email> or <ip> now", 24), 2: ("nothing 12 here", 15), 3: (None, None)}


ODD = ["__both", "__row", "__none", "s", "g", "bin", "kept", "shard", "words", "component_id"]


def test_stages_take_odd_rows_and_columns(spark, sf):
    rows = [(1, "mail a.b@c.org " * 30), (1, "mail a.b@c.org " * 30), (2, None), (3, ""), (None, "alone " * 60), (4, "x" * 200_000), (5, "w " * 70), (5, "later text " * 40)]
    docs = frame(spark, rows).select("*", *[F.create_map(F.lit("k"), F.lit(c)).alias(c) for c in ODD])
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[c] == {"k": c} for r in out.collect() for c in ODD), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, docs, sf).collect()) == ["1", "2", "3", "4", "5", "None"]
    assert {r.doc_id for r in cp.mixture(spark, docs, sf).collect()} == {1, 2, 3, None, 4, 5}


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.taken <= 3 * r["size"] and r["size"] >= 40
        assert not any(item in docs[r.doc_id] for item in items)
    assert len({docs[r.doc_id] for r in rows}) == len(rows)
