"""Ordered folds and text files against plain Python."""

from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import folds
from studyloom.operators import retrieval as R
from studyloom.sources import texts


def plain_chunks(blocks, least, target, most, span):
    """blocks (position, page, section, kind, tokens) in order -> ranges of positions."""
    out, held = [], []
    for b in blocks:
        if held:
            size, pages = sum(x[4] for x in held), {x[1] for x in held} | {b[1]}
            big, paged = size + b[4] > most, size >= target and b[1] != held[-1][1]
            new = b[2] and held[-1][2] and b[2] != held[-1][2] and size >= least
            if big or paged or new or max(pages) - min(pages) >= span:
                out.append((held[0][0], held[-1][0]))
                kept = []
                for x in held[::-1] if big or paged else []:
                    if not (x[3] == "CODE" and x[4] > 120):
                        kept = [x, *kept]
                        if sum(y[4] for y in kept) >= 80 or len(kept) == 2:
                            break
                held = kept
            held = [*held, b]
        elif b[4] > most:
            out.append((b[0], b[0]))
        else:
            held = [b]
    return out + ([(held[0][0], held[-1][0])] if held else [])


def test_native_chunks_match_plain_rule(spark):
    rows = [(d, i, i // 4, [None, "a", "b"][(i // 7) % 3], "CODE" if i % 5 == 0 else "PARAGRAPH", (i * 37 + d * 11) % 170 + (900 if i == 20 else 0)) for d in range(6) for i in range(30 * (d % 3))]
    df = spark.createDataFrame([*rows, (99, 0, 0, None, "TEXT", None)], "doc_id long, position long, page long, section string, kind string, tokens long").withColumn("text", F.concat_ws(" ", F.lit("block"), "position"))
    got = {}
    for r in folds.native_chunks(df).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.first, r.last))
    want = {d: plain_chunks([r[1:] for r in rows if r[0] == d], 80, 450, 800, 3) for d in range(6) if any(r[0] == d for r in rows)}
    assert got == want | {99: [(0, 0)]}


def test_equal_chunks_stay_once(spark):
    rows = [(1, k, k, None, "TEXT", 900, text) for k, text in enumerate(["same  words", "other", "same words", "other one"])]
    df = spark.createDataFrame(rows, "doc_id long, position long, page long, section string, kind string, tokens long, text string")
    assert [(r.chunk, r.first, r.content) for r in folds.native_chunks(df).orderBy("chunk").collect()] == [(0, 0, "same  words"), (1, 1, "other"), (2, 3, "other one")]
    assert folds.native_chunks(df.limit(0)).collect() == []


def test_fold_keeps_null_keys_apart(spark):
    df = spark.createDataFrame([(None, 1, 5), (1, 1, 5), (None, 2, 90), (1, 2, None)], "k long, at long, tokens long")
    rows = folds.source_groups(df, ["k"], "at", 10, 50).collect()
    assert sorted(((r.k is None, r.at, r.group_index) for r in rows)) == [(False, 1, 0), (False, 2, 0), (True, 1, 0), (True, 2, 1)]
    assert folds.source_groups(df.limit(0), ["k"], "at", 10, 50).collect() == []


def test_context_stays_within_budget(spark):
    words = "alpha beta gamma delta " * 40
    rows = [(1, 1, ["a", "b"], words), (1, 2, ["b"], words), (1, 3, ["c"], "  "), (1, 4, ["d"], words), (1, 5, ["e"], words), (2, 1, ["x"], None)]
    df = spark.createDataFrame(rows, "q long, rank long, sources array<string>, content string")
    got = folds.context_items(df, ["q"], 3, 400, 300).orderBy("rank").collect()
    assert [(r.rank, r.citation, r.truncated) for r in got] == [(1, "S1", False), (4, "S2", True)]
    assert sum(r.tokens for r in got) <= 400 and words.startswith(got[1].content)
    sizes = spark.createDataFrame([(w,) for w in ("", "one", words, " x ")], "t string").select("t", T.tokens_retrieval(F.col("t")).alias("n")).collect()
    assert all(folds.estimate(r.t) == r.n for r in sizes)


def test_signals_and_expansion(spark):
    q = spark.createDataFrame([('find "exact phrase" in 3.2.1 for my_var T[n]^2 and O(n log n)',), ("what is it",), ("",)], "q string")
    got = q.select(R.query_signals(F.col("q")).alias("s"), R.query_terms(F.col("q")).alias("t"), R.needs_expansion(F.col("q")).alias("e")).collect()
    assert got[0].s == ["exact phrase", "3.2.1", "my_var", "T[n]^2", "O(n log n)"] and not got[0].e
    assert got[1].t == [] and got[1].e and not got[2].e


def test_notes_come_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "My notes.md").write_text("line one\nline two")
    notes = texts.import_notes(spark, str(tmp_path / "in"))
    assert [(r.title, r.content) for r in notes.collect()] == [("My notes", "line one\nline two")]
    texts.export_markdown(notes.select(F.lit(7).alias("id"), "title", "content"), str(tmp_path / "out"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == "# My notes\n\nline one\nline two"
    lines = spark.createDataFrame([("  0 a 0 \n\n 1b",)], "text string").select(texts.page_lines().alias("t")).first().t
    assert lines == "0 a 0\n1b"
