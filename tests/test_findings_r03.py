"""Queries against their SQL on small odd tables of the third round's findings."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from studyloom.operators import geometry as G
from studyloom.plans import queries as plans


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's, both sorted, over these tables only; each is a table or a list of them, which makes a folder of files."""
    con = duckdb.connect()
    for table, data in tables.items():
        path = folder / f"{table}.parquet"
        if isinstance(data, list):
            path.mkdir()
            for k, part in enumerate(data):
                pq.write_table(part, path / f"part-{k}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        else:
            pq.write_table(data, path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    got = plans.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def vectors(rows):
    return pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array([np.asarray(r, np.float32) for r in rows], pa.list_(pa.float32()))})


def test_turns_stream_from_a_folder_of_files(spark, tmp_path):
    part = lambda ids: pa.table({"conv_id": pa.array(ids, pa.int64()), "turn": pa.array(range(len(ids)), pa.int64()), "role": ["user"] * len(ids), "text": ["x" * 400] * len(ids)})
    got, want = against_sql(spark, tmp_path, "stream_turn_windows", conversations=[part([1, 1, 1, 1]), part([2, 3, 3])])
    assert got == want and len(got) == 3


def test_line_boundaries_of_letters_without_one_capital(spark, tmp_path):
    lines = ["aß1", "ßßß", "ŉab", "ﬁab", " 1. x", "　1. x", "1.\x0bx", "İntroduction", "A\x0bB C D E F G"]
    texts = ["\n".join([""] * k + [t] * 8) for t in lines for k in (0, 4)]
    d = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    got, want = against_sql(spark, tmp_path, "line_boundaries", documents=d)
    assert got == want


def test_average_hashes_where_32_bits_round_to_a_whole_number(spark, tmp_path):
    x = np.arange(np.float32(0.01), np.float32(0.5), np.float32(3e-8), dtype=np.float32)
    narrow, wide = (x + np.float32(1)).astype(np.float64) * 127.5, (x.astype(np.float64) + 1) * 127.5
    odd = x[np.floor(narrow) != np.floor(wide)][:20]
    assert len(odd)
    rows = [[v, *[(np.floor((np.float64(v + np.float32(1))) * 127.5) + 0.5) / 127.5 - 1] * 63] for v in odd]
    got, want = against_sql(spark, tmp_path, "average_hashes", embeddings=vectors(rows))
    assert got == want


def test_vector_texts_of_halves(spark, tmp_path):
    rows = [[k / 128 for k in range(-64, 64)], [1e-7, -1e-7, 0.0, -0.0, 0.1, 1.5, 123456.789]]
    got, want = against_sql(spark, tmp_path, "vector_texts", embeddings=vectors(rows))
    assert got == want


def test_hashes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "HASH_BLOCK", 32)
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    known = sorted({int(v) ^ int(sum(1 << int(k) for k in rnd.choice(64, n, replace=False))) for v in base for n in (0, 3, 7, 8, 15, 16, 20)})
    df = spark.createDataFrame([(f"{v:016x}",) for v in known + known[:9]] + [(None,)], "hash string")
    want = {(f"{a:016x}", f"{b:016x}", n) for a in known for b in known if a < b and (n := (a ^ b).bit_count()) <= 15}
    plan = G.similar_hashes(df, 15)
    got = [tuple(r) for r in plan.collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert "FlatMapGroupsInPandas" in plan._jdf.queryExecution().toString()  # not a join by runs of four bits, which joins almost all


def test_mastery_stream_orders_a_batch_that_comes_in_pieces(spark, tmp_path):
    from studyloom.streaming.learning_stream import mastery_stream

    # the newest first, in frames of two rows; some keys have no user or topic
    rows = [(1, t, f"2026-01-01 00:{k:02d}:00", k * 10 + t, 0.1 if k % 3 else -0.9) for k in range(9, -1, -1) for t in (1, 2, 3)] + [(None, 1, "2026-01-01", 900, 0.2), (2, None, "2026-01-01", 901, 0.2)]
    df = spark.createDataFrame(rows, "user_id long, topic int, ts string, event_id long, delta double").withColumn("ts", F.col("ts").cast("timestamp"))
    first, got = (lambda r: r[3] < 50), {}
    keep = lambda batch, _: got.update({(r.user_id, r.topic): (r.mastery, r.events) for r in batch.collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for part in (df.where("event_id < 50"), df.where("event_id >= 50")):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = mastery_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for own in (first, lambda r: not first(r)):
        for u, t, _, _, delta in sorted(filter(own, rows), key=lambda r: (r[2], r[3])):
            m, n = want.get((u, t), (0.5, 0))
            want[u, t] = (max(0.0, min(1.0, m + delta)), n + 1)
    assert got == {k: (round(m, 6), n) for k, (m, n) in want.items()}
