"""Blocks of the text index are bounded by their bytes of words, and tiles of texts by their number."""

import pyarrow as pa
from pyspark.sql import functions as F

from studyloom.operators import retrieval as R
from studyloom.operators import text_index as I


def test_blocks_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", 1000)
    texts = [(k, " ".join(f"w{k % 7}x{j}" for j in range(1 + k % 40))) for k in range(200)] + [(500, "long " * 900), (501, ""), (502, "..")]
    I.build(spark.createDataFrame(texts, "id long, text string").coalesce(1), str(tmp_path / "index"))
    rows, members = I.open_index(spark, str(tmp_path / "index"))
    size = {k: len(t) + len(t[:600]) for k, t in texts}
    by_block = {}
    for r in members.collect():
        by_block.setdefault(r.block, []).append(r.id)
    assert sorted(k for ks in by_block.values() for k in ks) == sorted(size)
    assert all(len(ks) == 1 or sum(size[k] for k in ks) <= 1000 for ks in by_block.values()) and all(ks == sorted(ks) for ks in by_block.values())
    assert rows.where("term = ''").count() == 0 and rows.where("term = 'long'").select(F.col("a")[0]).first()[0] == 900


def test_hits_come_tile_by_tile(monkeypatch):
    monkeypatch.setattr(R, "TEXT_TILE", 3)
    batch = pa.RecordBatch.from_pydict({"id": list(range(10)), "title": ["t", "nine", None] * 3 + ["t"], "__norm": ["abc", None, "nine"] * 3 + [""]})
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("points", pa.float64())])
    got = list(R._signal_hits([batch], [(1, "nine", "nine"), (2, "abc", "abc")], schema))
    assert len(got) == 3 and max(b.num_rows for b in got) == 3
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [x for k in range(0, 9, 3) for x in ((2, k, 1.5), (1, k + 1, 2.0), (1, k + 2, 1.5))]


def test_words_are_those_that_spark_finds(spark, tmp_path):
    """Texts are split outside Spark; whatever the character, the words are Spark's."""
    chars = [chr(c) for c in [*range(1, 0x2000), *range(0x2000, 0x3100), *range(0x9FE0, 0xA010), *range(0xA7B0, 0xA800), *range(0xABF0, 0xAC10), *range(0xD7A0, 0xD800), *range(0xFE00, 0x10600), *range(0x1F600, 0x1F610), 0x10FFFF]]
    texts = [(k, f"Ab{c}cd  {c}{c} x{c} {c}") for k, c in enumerate(chars)] + [(90_000, "İstanbul ΑΣ Ⱥb naïve«été» l’eau — _a1 9"), (90_001, "  " + " \n" * 900 + "Tail end " * 300), (90_002, "x " * 650 + "yy")]
    d = spark.createDataFrame(texts, "id long, text string")
    I.build(d, str(tmp_path / "index"))
    rows, members = I.open_index(spark, str(tmp_path / "index"))
    cells = rows.select("block", "term", F.explode(F.arrays_zip("docs", "a", "b")).alias("c")).select("block", F.col("c.docs").alias("doc"), "term", F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    got = cells.join(members, ["block", "doc"]).select("id", "term", "a", "b")
    head = F.substring(F.trim(F.regexp_replace("text", "\\s+", " ")), 1, 600)
    words = lambda t, a, b: d.select("id", F.explode(R.words_of(t)).alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    want = words(F.col("text"), 1, 0).unionByName(words(head, 0, 1)).groupBy("id", "term").agg(F.sum("a").cast("int").alias("a"), F.sum("b").cast("int").alias("b"))
    assert got.count() == want.count() > 30_000 and got.exceptAll(want).count() == 0


def test_signals_meet_texts_in_lower_case(spark):
    signals = spark.createDataFrame([(1, "F[x] {Y}"), (2, "É tude"), (3, "a\x0bb\tc")], "query_id long, signal string")
    texts = spark.createDataFrame([(1, None, "so f(X)\n\n(y)"), (2, None, "é TUDE"), (3, None, "étude"), (4, None, "A\fB c"), (5, "t", None), (6, None, "İ ſ ä")], "id long, title string, text string")
    assert sorted((r.query_id, r.id) for r in R.exact_recall(signals, texts).collect()) == [(1, 1), (2, 2), (3, 4)]


def test_a_block_splits_its_texts(spark):
    """Spark hands whole texts over; its regular expressions took most of the time of building."""
    got = I._block(pa.array([7, 8]), [pa.array(["ab-cd, ab x", "«été»_1"]), pa.array(["ab", ""])], 0, pa.int64())
    assert sorted((r["term"], r["n"], r["most_a"], r["most_b"]) for r in got.to_pylist() if r["term"]) == [("_1", 1, 1, 0), ("ab", 1, 2, 1), ("cd", 1, 1, 0), ("été", 1, 1, 0)]
