"""The Markdown machine against one that walks lines, and edits against the same rules in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from studyloom.operators import markdown as M


def walked(lines):
    """Elements of one document, line by line."""
    mode, page, stack, out, before = None, 1, [], [], None
    closes = {"CODE": lambda t: t.startswith("```"), "FORMULA": lambda t: t.startswith("$$"), "MIXED_VISUAL": lambda t: "</figure>" in t}
    for i, line in enumerate(lines):
        t = (line or "").strip()
        mark = re.match(r"<!--\s*page\s*:\s*(\d+)\s*-->", t, re.I)
        kind, fresh = None, False
        if mark:
            page, mode = int(mark[1]), None
        elif mode:
            kind = mode
            mode = None if closes[mode](t) else mode
        elif head := re.match(r"(#+)\s+(.+)", t):
            stack, kind, fresh = [*stack[: len(head[1]) - 1], head[2].strip()], "HEADING", True
        elif found := next((k for k, on in (("CODE", t.startswith("```")), ("FORMULA", t.startswith("$$")), ("MIXED_VISUAL", "<figure" in t)) if on), None):
            kind, fresh = found, True
            mode = None if kind == "MIXED_VISUAL" and "</figure>" in t else kind
        elif "|" in t:
            kind = "TABLE"
        elif t not in ("", "---"):
            kind = "PARAGRAPH"
        if kind and (fresh or kind != before or (kind in ("TABLE", "PARAGRAPH") and before != kind)):
            out.append([kind, page, list(stack), i, []])
        if kind:
            out[-1][4].append(line or "")
        before = kind
    return [(k, p, s, i, len(c), c[0] if k == "HEADING" else "\n".join(c).strip()) for k, p, s, i, c in out]


PIECES = ["# One", "## Two", " ### Three ", "#### Four", "####### Seven", "#none", "# ", "```", "```python", "$$", "$$ x $$", "<figure>", "see <figure src='a'>", "</figure>", "<figure>x</figure>", "<!-- page: 4 -->", "<!--PAGE:12--> rest", "<!-- page: x -->", "| a | b |", "a|b", "---", "", None, "  ", "plain", "- item", "  in  ", "😀 text"]


@pytest.mark.parametrize("span", [1, 3, 512])
def test_structure_equals_the_walk(spark, monkeypatch, span):
    monkeypatch.setattr(M, "SPAN", span)
    rng = random.Random(7)
    docs = {d: [rng.choice(PIECES) for _ in range(rng.randrange(1, 60))] for d in range(60)}
    docs[60] = [f"{'#' * n} h{n}" for n in range(1, 13)] + ["deep", "### up", "low"]
    docs[None] = ["# null id", "```", "<!-- page: 3 -->", "text"]
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    got = {}
    for r in M.structure(spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")).orderBy("doc_id", "element").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.page, list(r.path), r.first_line, r.lines, r.content))
    assert got == {d: w for d, lines in docs.items() if (w := walked(lines))}


def test_structure_of_nothing(spark):
    assert M.structure(spark.createDataFrame([], "doc_id long, chunk_index int, content string")).collect() == []


TEXT = "# A\nfirst\n\n## B (1)\nbody 😀\n### C\ndeep\n## D\\E\nlast\n# B (1)\nother\n"
HEADS = ["A", " B (1) ", "C", "D\\E", "none", "", "firs"]


def span(text, heading):
    m = re.search(rf"(?m)^(#{{1,6}})\s+{re.escape(heading.strip())}\s*$", text)
    if m:
        n = re.compile(rf"(?m)^#{{1,{len(m[1])}}}\s+").search(text, m.end())
        return m.start(), n.start() if n else len(text)


@pytest.mark.parametrize("text", [TEXT, "😀😀 # A\n# A", "## A\n\n\n# A\n", "no heading", "", "x\n# A  \n\n  y\n#A\n"])
def test_sections(spark, text):
    rows = [(text, h) for h in HEADS]
    t, h = F.col("t"), F.col("h")
    put = lambda where: M.inserted(t, F.lit(" # New\nx\n"), F.lit(where), h)
    df = spark.createDataFrame(rows, "t string, h string").select("h", M.section_span(t, h).alias("s"), put("BEFORE").alias("b"), put("AFTER").alias("a"), put("END").alias("e"), M.deleted(t, h, F.lit(True)).alias("d"), M.deleted(t, h, F.lit(None).cast("boolean")).alias("p"))
    for r in df.collect():
        s = span(text, r.h)
        assert (tuple(r.s) if r.s else None) == s
        assert r.e.text == text.rstrip() + "\n\n# New\nx\n" and r.e.error is None
        if not s:
            assert [x.error for x in (r.b, r.a, r.d, r.p)] == ["heading not found"] * 4 and {x.text for x in (r.b, r.a, r.d, r.p)} == {text}
            continue
        for x, at in ((r.b, s[0]), (r.a, s[1])):
            assert x.text == text[:at].rstrip() + "\n\n# New\nx\n\n" + text[at:].lstrip() and x.error is None
        assert r.d.text == (text[: s[0]].rstrip() + "\n\n" + text[s[1] :].lstrip()).strip() + "\n" and r.d.preview is None
        assert (r.p.text, r.p.error, r.p.preview) == (text, "confirmation required", text[s[0] : s[1]][:1200])


def test_replacements(spark):
    digest = hashlib.sha256(TEXT.encode()).hexdigest()
    rows = [(TEXT, "B (1)", "$1\\", False, None), (TEXT, "B (1)", "", True, digest), (TEXT, "zzz", "y", True, ""), (TEXT, "", "y", False, None), (TEXT, "A", "y", False, "stale"), (None, "A", "y", False, None), (TEXT, None, "y", False, None)]
    df = spark.createDataFrame(rows, "t string, n string, r string, a boolean, e string")
    got = [tuple(x.v) for x in df.select(M.replaced(*[F.col(c) for c in "tnrae"]).alias("v")).collect()]
    assert got[:2] == [(TEXT.replace("B (1)", "$1\\", 1), None), (TEXT.replace("B (1)", ""), None)]
    assert got[2:] == [(TEXT, "text not found"), (TEXT, "text not found"), (TEXT, "changed since it was read"), ("", "text not found"), (TEXT, "text not found")]


def test_steps_of_lines_are_found_once(spark):
    """Lines are read once for their steps, which are written; the two readers of the steps read no line."""
    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    d = spark.createDataFrame([(k % 5, k, line) for k, line in enumerate(["a", "```", "b", "```", "<figure>x", "c</figure>", "$$", "", "# H", "<!-- page: 2 -->"] * 4)], "doc_id long, chunk_index long, content string")
    got = M.mode_changes(d.withColumn("content", once("content"))).collect()
    assert seen.value == 40
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mode_changes(d).collect())) and got
