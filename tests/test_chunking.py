"""Chunks by strategy on elements written for each rule."""

from studyloom.operators import chunking as C

SCHEMA = "doc_id string, element int, strategy string, kind string, page int, path array<string>, content string"


def words(n, start="w"):
    return " ".join(f"{start}{i}" for i in range(n))


def members(spark, strategy, elements):
    """Elements as (kind, page, path, content) -> their chunks in order."""
    rows = [("d", i + 1, strategy, *e) for i, e in enumerate(elements)]
    got = {r.position: r.chunk for r in C.chunk_members(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got.get(i + 1) for i in range(len(elements))]


def p(page, n, path=(), content=None, kind="PARAGRAPH"):
    return (kind, page, list(path), content or words(n))


def test_small_pages_merge_until_a_topic_or_the_target(spark):
    # 40 words are 52 tokens, with PROOF 53, below the least of 60; PROOF begins a topic
    assert members(spark, "PAGE_AWARE", [p(1, 40), p(2, 0, content="PROOF\n" + words(40)), p(3, 0, content="PROOF\n" + words(40)), p(4, 40)]) == [0, 0, 1, 1]
    assert members(spark, "PAGE_AWARE", [p(1, 510), p(2, 10), p(3, 10)]) == [0, 1, 1]
    assert members(spark, "PAGE_AWARE", [p(1, 400), p(2, 400)]) == [0, 1]


def test_a_large_page_is_cut_by_itself(spark):
    assert members(spark, "PAGE_AWARE", [p(1, 10), p(2, 400), p(2, 300), p(2, 200), p(3, 10), p(4, 10)]) == [0, 1, 1, 2, 3, 3]
    assert members(spark, "PAGE_AWARE", [p(1, 10), p(2, 0, content="No extractable content on page 2"), p(3, 10)]) == [0, None, 0]
    # pictures do not stand alone among pages
    assert members(spark, "SLIDE_AWARE", [p(1, 10), p(1, 10, kind="MIXED_VISUAL"), p(2, 10)]) == [0, 0, 0]


def test_slides_end_where_the_heading_changes(spark):
    slides = [p(1, 90, ["A"]), p(2, 90, ["A"]), p(3, 90, ["A", "B"]), p(4, 10), p(5, 10, ["C"])]
    assert members(spark, "SLIDE_AWARE", slides) == [0, 0, 1, 1, 2]
    assert members(spark, "PAGE_AWARE", slides) == [0, 0, 0, 0, 0]


def test_units_sections_and_questions(spark):
    body = [p(1, 0, ["A"], "# A", "HEADING"), p(1, 20, ["A"]), p(1, 0, ["A"], "Theorem 1 holds"), p(1, 20, ["A"])]
    assert members(spark, "TOPIC_AWARE", body) == [0, 0, 1, 1]
    assert members(spark, "MIXED_FALLBACK", body) == members(spark, None, body) == members(spark, "else", body) == [0, 0, 0, 0]
    paper = [p(1, 20), p(1, 0, ["M"], "# Methods", "HEADING"), p(1, 0, ["M"], "# M2", "HEADING"), p(1, 20, ["M"]), p(1, 20), p(1, 20, ["R"])]
    assert members(spark, "PAPER_SECTION_AWARE", paper) == [0, 1, 1, 1, 1, 1]
    assert members(spark, "PAPER_SECTION_AWARE", [*paper[:4], p(1, 20, ["R"])]) == [0, 1, 1, 1, 2]
    asked = [p(1, 20, content="1. " + words(20)), p(1, 0, content="2. " + words(70)), p(1, 0, content="Q3: " + words(5)), p(1, 0, ["A"], "# A", "HEADING")]
    assert members(spark, "QUESTION_AWARE", asked) == [0, 0, 1, 1]
    assert members(spark, "QUESTION_AWARE", [p(1, 10), p(1, 100, kind="CODE"), p(1, 600, kind="CODE"), p(1, 5)]) == [0, 0, 1, 2]


def test_solid_elements_size_and_pages(spark):
    assert members(spark, "MIXED_FALLBACK", [p(1, 10), p(1, 100, kind="TABLE"), p(1, 10), p(1, 90, kind="TABLE"), p(1, 1, kind="MIXED_VISUAL"), p(1, 1)]) == [0, 1, 2, 2, 3, 4]
    assert members(spark, "MIXED_FALLBACK", [p(1, 500), p(1, 300), p(1, 300), p(1, 300), p(2, 1)]) == [0, 1, 1, 2, 2]
    assert members(spark, "MIXED_FALLBACK", [p(1, 510), p(1, 1), p(2, 1)]) == [0, 0, 1]


def test_chunks_take_the_end_of_prose_before(spark):
    rows = [("d", 1, "TOPIC_AWARE", "HEADING", 1, ["A"], "# A"), ("d", 2, "TOPIC_AWARE", "PARAGRAPH", 1, ["A"], words(100)), ("d", 3, "TOPIC_AWARE", "HEADING", 2, ["B"], "# B"), ("d", 4, "TOPIC_AWARE", "PARAGRAPH", 3, ["B"], "end"), ("d", 5, "TOPIC_AWARE", "MIXED_VISUAL", 3, ["B"], None), (None, 1, None, "PARAGRAPH", None, None, "x")]
    got = {(r.doc_id, r.chunk): r for r in C.markdown_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4 and not got["d", 0].overlap and got["d", 0].kind == "PARAGRAPH" and got["d", 0].path == ["A"]
    b = got["d", 1]
    assert b.overlap and b.content == " ".join(f"w{i}" for i in range(10, 100)) + "\n\n# B\n\nend" and (b.page_start, b.page_end, b.elements, b.kinds) == (2, 3, 2, ["HEADING", "PARAGRAPH"])
    assert (got["d", 2].kind, got["d", 2].content, got["d", 2].tokens) == ("MIXED_VISUAL", "", 1)
    assert (got[None, 0].strategy, got[None, 0].content, got[None, 0].path) == ("MIXED_FALLBACK", "x", None)


def test_no_elements(spark):
    assert C.markdown_chunks(spark.createDataFrame([], SCHEMA)).collect() == []
