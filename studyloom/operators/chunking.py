"""Chunks of Markdown elements, each document by its own strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, tokens_document
from .documents import boundaries
from .folds import fold_rows
from .markdown import stripped
from .pages import BUDGETS

#: Tokens from which tables, code and formulas stand alone (pictures always do), words repeated in the next chunk, what an empty page says.
SOLID, OVERLAP, NO_CONTENT = 120, 90, "No extractable content on page"
BY_PAGE = ("PAGE_AWARE", "SLIDE_AWARE")
FIELDS = ["position", "strategy", "kind", "tokens", "page", "root", "title", "begins", "run", "page_tokens", "page_topic", "page_title"]


def _first_line(content: Column, trimmed) -> Column:
    """The first line that is neither empty nor a comment."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(content, "\n"), trimmed), lambda x: (x != "") & ~x.startswith("<!--")), 0), F.lit(""))


def chunk_features(elements: DataFrame) -> DataFrame:
    """What the fold reads of each element and of its page: no text goes on from here. A page is a run of elements of one page number."""
    own = F.col("strategy")
    e = elements.withColumn("strategy", F.when(own.isin(*BUDGETS), own).otherwise("MIXED_FALLBACK"))
    e = e.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("position", F.col("element").cast("long")).withColumn("tokens", tokens_document(F.col("content")))
    here, bare = _first_line(F.col("content"), stripped), _first_line(F.col("content"), lambda x: F.btrim(x, F.lit(" #\t")))
    e = e.withColumn("__here", here).withColumn("__bare", bare)  # as columns, so that a text is split once each, not with each word looked for
    here, bare = F.col("__here"), F.col("__bare")
    says = boundaries(here, F.col("kind") == "HEADING")
    begins = F.when(own == "TOPIC_AWARE", says["unit"]).when(own == "PAPER_SECTION_AWARE", says["paper_section"]).when(own == "QUESTION_AWARE", says["question"])
    path = F.coalesce("path", F.array().cast("array<string>"))
    e = e.select(
        "doc_id", "position", "strategy", "kind", "tokens", F.col("page").cast("long").alias("page"), F.get(path, 0).alias("root"), F.when(F.size(path) > 0, F.element_at(path, -1)).alias("title"), F.coalesce(begins, F.lit(False)).alias("begins"),
        F.when(bare != "", boundaries(bare, F.lit(False))["topic"]).alias("__topic"), ((F.trim("content") != "") & ~F.col("content").contains(NO_CONTENT)).alias("__full"),
    )
    w = Window.partitionBy("doc_id").orderBy("position")
    e = e.withColumn("run", F.sum((~F.lag("page").over(w).eqNullSafe(F.col("page"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "run").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumn("page_tokens", F.sum("tokens").over(whole)).withColumn("page_topic", F.coalesce(F.first("__topic", ignorenulls=True).over(whole), F.lit(False))).withColumn("page_title", F.last("title", ignorenulls=True).over(whole))
    return e.withColumn("__any", F.bool_or("__full").over(whole)).where("__any OR strategy NOT IN ('PAGE_AWARE', 'SLIDE_AWARE')").select("doc_id", *FIELDS)


def _ends(state: tuple, strategy, kind, tokens, page, root, begins, run, page_tokens, page_topic, page_title) -> bool:
    """Whether the open chunk ends before this element."""
    target, most, least = BUDGETS[strategy]
    size, last_run, title, large, plain, last_page, last_root = state
    if strategy in BY_PAGE:
        if run == last_run:
            return large and size + tokens > most
        # pages are kept whole: a larger one is cut by itself
        new_topic = page_topic or bool(strategy == "SLIDE_AWARE" and title and page_title and title != page_title)
        return large or page_tokens > most or size >= target or size + page_tokens > most or (new_topic and size >= least)
    if size + tokens > most:
        # headings alone are no chunk, but questions have no such rule
        return plain or strategy == "QUESTION_AWARE"
    if strategy == "QUESTION_AWARE":
        return begins and size >= least
    return plain and (begins or kind == "HEADING" or bool(root and last_root and root != last_root) or (size >= target and page != last_page))


def chunk_members(elements: DataFrame) -> DataFrame:
    """elements(doc_id, element, strategy, kind, page, path, content) -> (doc_id, position, chunk), by one fold with a state of a few numbers.

    PAGE_AWARE and SLIDE_AWARE pack whole pages: a chunk ends at its target, before a page that would pass the most, or, once it has the least, before
    a page that begins a topic (of slides, also under another heading); so pages too small merge. A page above the most is cut by itself. QUESTION_AWARE ends
    before a question once it has the least. The others end before headings, another first heading, a new page from the target on, and before a unit of teaching
    (TOPIC_AWARE) or a section of a paper (PAPER_SECTION_AWARE). Pictures and long tables, code and formulas stand alone, among questions from the
    target on, in pages never. Pages that say that they have no content go. A strategy that is null or unknown is MIXED_FALLBACK.
    """

    def step(state, position, strategy, kind, tokens, page, root, title, begins, run, page_tokens, page_topic, page_title):
        chunk, now = state
        solid = kind == "MIXED_VISUAL" or (kind in ("TABLE", "CODE", "FORMULA") and tokens >= SOLID)
        alone = solid and strategy not in BY_PAGE and (strategy != "QUESTION_AWARE" or tokens >= BUDGETS[strategy][0])
        if now is not None and (alone or _ends(now, strategy, kind, tokens, page, root, begins, run, page_tokens, page_topic, page_title)):
            now = None
        chunk += now is None
        if alone:
            return (chunk, None), [(position, chunk)]
        size, last_run, last_title, large, plain = now[:5] if now else (0, None, None, False, False)
        large = large if run == last_run else page_tokens > BUDGETS[strategy][1]
        return (chunk, (size + tokens, run, title or last_title, large, plain or kind != "HEADING", page, root)), [(position, chunk)]

    return fold_rows(chunk_features(elements), ["doc_id"], ["position"], FIELDS, "position long, chunk long", lambda: (-1, None), step)


def markdown_chunks(elements: DataFrame) -> DataFrame:
    """elements(doc_id, element, strategy, kind, page, path, content) -> (doc_id, chunk, strategy, kind, kinds, page_start, page_end, path, elements, tokens, overlap, content).

    kind is that of its elements other than headings, MIXED if they differ, HEADING if there is none. But for chunks by page, prose begins with the last 90
    words of the chunk before, if that is prose or mixed and has so many. Tokens count what was put before. A null content is an empty one.
    """
    e = elements.select(F.col("doc_id").alias("__d"), F.col("element").cast("long").alias("__p"), F.col("kind").alias("__k"), F.col("page").alias("__g"), "path", "strategy", F.coalesce("content", F.lit("")).alias("content"))
    j = chunk_members(elements).join(e, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("position") == F.col("__p")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda r: r["content"]), "\n\n")
    own = F.first("strategy")
    g = j.groupBy("doc_id", "chunk").agg(
        F.when(own.isin(*BUDGETS), own).otherwise("MIXED_FALLBACK").alias("strategy"), F.array_sort(F.collect_set("__k")).alias("kinds"), F.min("__g").alias("page_start"), F.max("__g").alias("page_end"),
        F.min_by("path", "position").alias("path"), F.count("*").alias("elements"), text.alias("content"),
    )
    plain = F.array_remove("kinds", "HEADING")
    g = g.withColumn("kind", F.when(F.size(plain) == 0, "HEADING").when(F.size(plain) > 1, "MIXED").otherwise(F.get(plain, 0)))
    w = Window.partitionBy("doc_id").orderBy("chunk")
    before = F.filter(F.split(collapse(F.lag("content").over(w)), " "), lambda x: x != "")
    takes = F.col("kind").isin("PARAGRAPH", "MIXED") & ~F.col("strategy").isin(*BY_PAGE) & ~F.lag("kind").over(w).isin("CODE", "TABLE", "FORMULA", "MIXED_VISUAL") & (F.size(before) >= OVERLAP)
    g = g.withColumn("__tail", F.when(takes, F.array_join(F.slice(before, -OVERLAP, OVERLAP), " ")))
    g = g.withColumn("content", F.concat_ws("\n\n", "__tail", "content"))
    return g.select("doc_id", "chunk", "strategy", "kind", "kinds", "page_start", "page_end", "path", "elements", tokens_document(F.col("content")).alias("tokens"), F.col("__tail").isNotNull().alias("overlap"), "content")
